"""No limit, prefix or size drops data unless a caller asks for one."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from quire.functions import units
from quire.operators import changes, clusters, detections, layout, numeric, page_plans, readings, searching
from quire.plans import ranks
from quire.plans.folds import fold_groups
from quire.sources import readers
from quire.streaming import live


def test_every_hit_of_a_phrase(spark):
    df = spark.createDataFrame([(1, 1, "ab " * 6001), (1, 2, "ab")], "d long, p int, text string")
    assert searching.phrase_search(df, "ab", "d", "p").count() == 6002
    assert searching.phrase_search(df, "ab", "d", "p", limit=6001).filter("p = 2").count() == 0


def test_decomposed_text_is_found_and_replaced(spark):
    text = unicodedata.normalize("NFD", "é ou été")
    df = spark.createDataFrame([(1, text)], "d long, text string")
    assert [(r.start, r.end) for r in searching.phrase_search(df, "été", "d", None).collect()] == [(5, 8)]
    row = searching.find_replace(df, unicodedata.normalize("NFD", "É"), "a").first()
    assert (row.text, row.hits) == ("a ou ata", 3)
    same = readings.agreement(df, df.withColumn("text", F.lit("é ou été")), ["d"]).first()
    assert same.agreement == 1.0


@pytest.mark.parametrize("lines", [1, 7, 60, 2500])
def test_line_diff_of_any_length(spark, lines):
    a = [f"line {i % 97} {i // 3}" for i in range(lines)]
    b = [x for i, x in enumerate(a) if i % 11] + ["new"]
    df = spark.createDataFrame([(1, "\n".join(a), "\n".join(b))], "doc_id long, a string, b string")
    out = changes.line_diff(df.selectExpr("doc_id", "a AS text"), df.selectExpr("doc_id", "b AS text"))
    assert out.filter("NOT changed AND side = 'before'").count() == len(b) - 1
    assert [r.line for r in out.filter("changed AND side = 'after'").collect()] == ["new"]


def test_long_chains_of_boxes(spark):
    n = 1500
    df = spark.range(n).select(F.lit(1).alias("p"), "id", (F.col("id") * 9 % (9 * n)).cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(10.0).alias("w"), F.lit(10.0).alias("h"))
    got = clusters.cluster_boxes(df, ["p"], "id").collect()
    assert [(r.cluster, r.x, r.w, r.boxes) for r in got] == [(0, 0.0, 9.0 * (n - 1) + 10, n)]


def test_null_keys_are_one_group(spark):
    df = spark.createDataFrame([(None, "a", 1), (None, "a", 2), (None, None, 3), (1, None, 4), (1, None, 5), (None, None, 6)], "k long, s string, v int")
    out = fold_groups(df, ["k", "s"], ["v"], "n int, total int", lambda g: {"n": [len(g["v"])], "total": [int(g["v"].sum())]})
    assert sorted((r.n, r.total) for r in out.collect()) == [(2, 3), (2, 9), (2, 9)]


def test_an_overflowing_picture_ends_its_page_only(spark):
    rows = [(1, 1, 1, 60), (1, 1, 2, 50), (1, 1, 3, 1), (1, 2, 1, 40), (1, 3, 1, 1), (2, 1, 1, 200)]
    df = spark.createDataFrame(rows, "doc_id long, page_no int, region_no int, bytes int")
    got = layout.budgeted_top(df, ["doc_id", "page_no"], ["doc_id"], ["region_no"], "bytes", 5, 100)
    assert sorted((r.page_no, r.region_no) for r in got.collect()) == [(1, 1), (2, 1)]


def test_large_files_are_read_and_refused_ones_named(spark, tmp_path):
    (tmp_path / "big.txt").write_text("x" * (6 << 20))
    (tmp_path / "other.bin").write_text("x")
    rows = {r.path.rsplit("/", 1)[1]: (r.problem, r.text and len(r.text)) for r in readers.read_text_corpus(spark, str(tmp_path)).collect()}
    assert rows == {"big.txt": (None, 6 << 20), "other.bin": ("not a text file", None)}
    assert {r.problem for r in readers.read_text_corpus(spark, str(tmp_path), 10).collect()} == {"too large", "not a text file"}


def test_page_lists_of_any_size(spark):
    specs = spark.createDataFrame([(1, ",".join(str(i) for i in range(1, 601))), (2, "100000-100001")], "doc long, spec string")
    counts = spark.createDataFrame([(1, 700), (2, 100001)], "doc long, pages int")
    assert page_plans.parse_specs(specs, counts, "doc").filter("problem IS NOT NULL").count() == 0
    assert page_plans.parse_specs(specs, counts, "doc", max_ranges=500).filter("problem = 'too many'").count() == 600


def test_one_dense_group_snaps_bucket_by_bucket(spark):
    """Values without a gap, far more than a bucket holds, cluster as one walk over all of them would."""
    import numpy as np

    from quire.operators import numeric

    values = np.unique(np.round(np.random.default_rng(3).uniform(0, 900, 6000), 3))
    df = spark.createDataFrame([(None, float(v)) for v in values], "g long, v double")
    want, start = {}, None
    for v in values:
        start = v if start is None or v - start > 2.0 else start
        want[float(v)] = float(start)
    assert {r.v: r.snapped for r in numeric.snap(df, ["g"], "v").collect()} == want
    assert {r.v: r.snapped for r in numeric.snap(df, [], "v").collect()} == want


def test_ranks_of_one_large_group(spark):
    from quire.plans import ranks

    df = spark.range(50001).selectExpr("1 AS g", "cast(id * 7919 % 50001 AS double) AS v")
    assert ranks.median(df, ["g"], "v").first().median == 25000.0
    assert ranks.upper_median(df.filter("v < 10"), ["g"], "v").first().upper_median == 5.0


def test_ranks_cut_as_often_as_needed(spark):
    """The same order statistics whether a group is ordered whole or cut, and cut again, down to a few values."""
    rows = [(None if i % 3 == 0 else "ab"[i % 3 - 1], float(i * 7919 % 10007)) for i in range(9000)] + [("few", 1.0), ("few", 4.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    expected = {k: (len(v), sorted(v)[len(v) // 2], sorted(v)[len(v) // 10]) for k, v in groups.items()}
    ranks_wanted = {"middle": F.floor(F.col("n") / 2), "low": F.floor(F.col("n") / 10)}
    for ordered in (10, 100, 1 << 18):
        found = ranks.order_statistics(df, ["k"], "v", ranks_wanted, ordered=ordered).collect()
        assert {r.k: (r.n, r.middle, r.low) for r in found} == expected
    assert ranks.order_statistics(df.limit(0), ["k"], "v", ranks_wanted).collect() == []


def test_outliers_of_a_null_group(spark):
    """Rows without a group are a group; equal values count as often as they occur."""
    rows = [(i, None if i % 2 else "a", 500.0 if i in (4, 5) else float(i // 2 % 5)) for i in range(200)] + [(200, "a", None)]
    found = numeric.mad_outliers(spark.createDataFrame(rows, "id long, k string, v double"), ["k"], "v").collect()
    assert sorted((r.id, r.k, r.median, r.mad) for r in found) == [(4, "a", 2.0, 1.0), (5, None, 2.0, 1.0)]


def test_a_table_of_several_files_is_streamed_whole(spark, tmp_path):
    spark.range(40).selectExpr("id AS doc_id", "concat('a  b', id) AS text").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out, _ = live.run_to_table(live.event_stream(spark, str(tmp_path), "documents"), "docs", "append")
    assert sorted(r.doc_id for r in out.collect()) == list(range(40))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def few_documents(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("few"))
    text = "\n".join(f"{n} " + "some words of a line " * 9 for n in range(40))
    spark.createDataFrame([(i, text[i:]) for i in (1, 2, 3, 3)], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("query", ["char_runs", "pdf_lines", "visual_lines", "build_table", "text_blocks", "engine_lines", "document_text"])
def test_what_pages_hold_is_not_shuffled(spark, few_documents, query):
    from quire import catalog

    plan = _plan(catalog.queries()[query](spark, few_documents))
    assert plan.count("Exchange") == 1 and "Exchange hashpartitioning(doc_id" in plan.replace("REPARTITION_BY_NUM", "")


def test_rows_that_lie_together_are_put_in_order_as_a_shuffle_would(spark, few_documents):
    """One document's id is there twice: its pages are one group each all the same."""
    from quire.operators import flow
    from quire.sources import derive

    words = derive.pdf_words(spark, few_documents)
    rows = [sorted(map(str, flow.pdf_lines(words, together=t).drop("text").collect())) for t in (False, True)]
    assert rows[0] == rows[1] and len(rows[0]) > 100


def test_overlapping_boxes_meet_where_their_documents_lie(spark, few_documents):
    from quire import catalog

    plan = _plan(catalog.queries()["overlap_pairs"](spark, few_documents))
    assert "Scan ExistingRDD" not in plan and plan.count("Exchange hashpartitioning(doc_id") == plan.count("Exchange hashpartitioning(") > 0


def test_rules_are_read_once_for_all_sides_of_a_box(spark, few_documents):
    from quire import catalog

    assert "FileScan" not in _plan(catalog.queries()["find_boxes"](spark, few_documents))


def test_sizes_of_any_magnitude_snap_and_few_beginnings_are_followed(spark, monkeypatch):
    made, fold = [], numeric.fold_groups
    monkeypatch.setattr(numeric, "fold_groups", lambda *a, **b: made.append(fold(*a, **b)) or made[-1])
    values = sorted({-70.5, -3.0, -2.9, 0.0} | {round(0.01 * 1.002**i, 7) for i in range(9000)})
    df = spark.createDataFrame([("a", v) for v in values], "g string, v double")
    start, members = None, {}
    for v in values:
        if start is None or v > 1.22 * start:
            start = v
        members.setdefault(start, []).append(v)
    want = {v: (m[(len(m) - 1) // 2] + m[len(m) // 2]) / 2 for m in members.values() for v in m}
    got = {r.v: r.size for r in numeric.snap_sizes(df, ["g"], "v").collect()}
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) <= 1e-12 * abs(want[v]) for v in values)
    assert made[0].count() < len(values) / 4


class _Store:
    """A state store of one value that counts its writes."""

    def __init__(self):
        self.value, self.writes, self.timers = None, 0, set()

    def getValueState(self, *_):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value, self.writes = value, self.writes + 1

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


def test_jobs_of_a_slot_are_folded_with_one_write_a_batch():
    import pandas as pd

    rows = [dict(job=str(j), place=f"{k:020d}/{k:020d}", us=k * 10**6, status={0: "queued", 1: "processing", 4: "completed"}.get(k), step="reading" if k == 2 else None, done=7 if k == 2 else 0, total=9 if k == 2 else 0,
                 files=int(k == 3), bytes=50 * (k == 3), error=None, summary=f'{{"n": "{k}"}}' if k in (1, 3) else None) for j in range(500) for k in range(5)]
    part = pd.DataFrame(rows)
    late = part.place.str.endswith("1") | part.place.str.endswith("2")
    seen = []
    for batches in ([part], [part[~late], part[late]], [part[late], part[~late]]):
        store, fold = _Store(), live.JobFold(30)
        fold.init(store)
        for b in batches:
            (out,) = fold.handleInputRows((0,), iter([b]), None)
        assert store.writes == len(batches) and store.timers == {4000 + 30 * 60_000} and len(out) == 500
        seen.append(out.sort_values("job_id").to_dict("records"))
    assert seen[0] == seen[1] == seen[2]
    assert seen[0][3] == {"job_id": 3, "status": "completed", "step": "completed", "done": 7, "total": 9, "files": 1, "bytes": 50, "error": None, "created_us": 0, "ended_us": 4 * 10**6, "summary": '{"n": "3"}', "event": "state"}


def test_ratios_round_the_exact_value_and_ties_to_even(spark):
    pairs = [(57, 8), (59, 8), (201, 200), (8, 57), (1999, 1000), (9000, 6000), (33, 1), (3299, 100), (1, 3300)]
    df = spark.createDataFrame(pairs, "w int, h int").select("w", "h", units.ratio_label(F.col("w") * 33, F.col("h") * 33).alias("r"), units.two_decimals(F.greatest("w", "h") / F.least("w", "h")).alias("two"))
    for r in df.collect():
        assert r.two == f"{max(r.w, r.h) / min(r.w, r.h):.2f}"
    assert {(r.w, r.h): r.r for r in df.collect()}[57, 8] == "7.12:1"


def test_words_of_any_line_have_their_places(spark):
    import re

    from quire.functions import text as tx

    rows = ["", " ", "one", "two words here", " lead", "trail ", "a  b", "tab\tand\u00a0space", "é \U0001f600 ü x", "\u3000wide\u2003x", "नमस्ते सबै  जना", "w " * 300 + "end", "x" * 400, "line\u2028break a", None]
    lines = spark.createDataFrame([(i, t, 3.0, 5.0, 60.0, 12.0) for i, t in enumerate(rows)], "n int, text string, x double, y double, w double, h double")
    wanted = [(n, k, 3.0 + 60.0 * m.start() / max(1, len(t)), 60.0 * len(m[0]) / max(1, len(t)), m[0]) for n, t in enumerate(rows) if t for k, m in enumerate(re.finditer("[^" + re.escape(tx.SPACE_CHARS) + "]+", t))]
    assert sorted((r.n, r.word_no, r.x, r.w, r.text) for r in layout.word_boxes(lines, ["n"]).collect()) == sorted(wanted)


@pytest.mark.parametrize("name", ["claim_words", "underlined_words", "remaining_rules", "bullets", "page_class", "page_scorecard", "pdf_page_flow"])
def test_page_words_are_not_written_nor_shuffled_by_joins(spark, name):
    from quire import catalog

    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan
    moved = [line for line in plan.split("\n") if "Exchange" in line and "word_no" in line]
    assert not moved or name == "pdf_page_flow"


def test_detections_of_one_size_are_walked_at_once(spark):
    import random

    import numpy as np

    dice = random.Random(5)
    rows = [(image, n, dice.choice(["text", "text", "overlay"]), dice.random(), dice.randrange(9) * 40.0, dice.randrange(4) * 20.0, dice.randrange(1, 8) * 20.0, dice.choice([10.0, 12.0, 20.0]), dice.choice([0.0, 5.0, 20.0]), dice.choice([10.0, 12.0, 20.0]), 2.0) for image in range(60) for n in range(1 + image % 9)]
    df = spark.createDataFrame(rows, "image_id long, region_no int, type string, score double, x double, y double, w double, h double, angle double, line_height double, elongation double")
    joined = {(r.image_id, r.region_no): (r.x, r.y, r.w, r.h, r.score) for r in detections.join_text_regions(df.filter("type = 'text'")).collect()}
    wanted = {}
    for image in range(60):
        kept = []
        for _, no, _, score, x, y, w, h, angle, lh, _ in sorted((r for r in rows if r[0] == image and r[2] == "text"), key=lambda r: (r[4], r[1])):
            for k in kept:
                if abs(k[6] - angle) < 8 and abs(k[2] + k[4] / 2 - y - h / 2) < max(k[4], h) * 0.5 and x - (k[1] + k[3]) < max(k[7], lh) * 1.2 and x + w > k[1]:
                    left, top, right, bottom = min(k[1], x), min(k[2], y), max(k[1] + k[3], x + w), max(k[2] + k[4], y + h)
                    k[1:6] = [left, top, right - left, bottom - top, max(k[5], score)]
                    break
            else:
                kept.append([no, x, y, w, h, score, angle, lh])
        wanted.update({(image, k[0]): tuple(k[1:6]) for k in kept})
    assert joined == wanted
    heights = np.array([dice.choice([1.0, 1.2, 1.25, 1.5, 0.96, 7.0, 0.0]) for _ in range(300)])
    slow = [int((np.abs(heights - v) <= v * detections.SIMILAR).sum()) for v in heights]
    assert detections._similar(heights[None, :])[0].tolist() == slow and detections._similar(heights[:60][None, :]).shape == (1, 60)


@pytest.mark.parametrize("minimum", [0.2, 0.5, 1.0])
def test_unknown_words_and_far_lengths_lose_no_similar_passage(spark, minimum, monkeypatch):
    import random
    from collections import Counter

    dice = random.Random(7)
    words = lambda known, strange: " ".join(dice.choice("abcdefgh") for _ in range(known)) + "".join(f" z{dice.randrange(10**6)}" for _ in range(strange))
    docs = [(i, words(dice.randrange(30), dice.choice([0, 1, 5, 40, 300]))) for i in range(80)] + [(80, ""), (81, "a b c d")]
    items = [(i, words(dice.randrange(1, 25), 0)) for i in range(20)] + [(20, "a b c d"), (21, "")]
    written = []
    monkeypatch.setattr(readings, "checkpoint", lambda df: written.append(df) or df)
    out = readings.similar_passages(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string"), minimum)
    wanted = set()
    for d, a in docs:
        for i, b in items:
            n, m = Counter(a.split()), Counter(b.split())
            shared, total = sum((n & m).values()), sum(n.values()) + sum(m.values())
            if shared and 2 * shared >= minimum * total:
                wanted.add((d, i, shared))
    assert {(r.doc_id, r.item_id, r.shared) for r in out.collect()} == wanted
    assert not any(df.filter("word LIKE 'z%'").count() for df in written if "doc_words" in df.columns and "word" in df.columns)
    none = spark.createDataFrame([], "item_id int, text string")
    assert readings.similar_passages(spark.createDataFrame(docs, "doc_id int, text string"), none, minimum).count() == 0


def _fold_inputs(monkeypatch):
    """The rules that the layout folds hand to Spark, with how they take their groups."""
    made, fold = [], layout.fold_groups
    monkeypatch.setattr(layout, "fold_groups", lambda df, keys, order, schema, rule, *a, **how: made.append((rule, how)) or fold(df, keys, order, schema, rule, *a, **how))
    return made


def test_pages_are_walked_many_at_a_time(spark, monkeypatch):
    made = _fold_inputs(monkeypatch)
    box = "doc_id int, page_no int, {} int, x double, y double, w double, h double"
    layout.visual_lines(spark.createDataFrame([], box.format("line_no") + ", text_height double, confidence double, text string"))
    layout.suppress_regions(spark.createDataFrame([], box.format("region_no") + ", kind string, priority int, score double"))
    layout.reading_order(spark.createDataFrame([], box.format("block_no")))
    assert [how for _, how in made] == [{"all_at_once": True}, {"alike": True}, {"alike": True}]


def test_stacked_pieces_are_lines_as_they_are(spark):
    """Pages of stacked pieces, of pieces side by side, of boxes without height, of infinite ones; pieces of several groups in one batch."""
    rows = [(1, 1, i, 5.1 * i, 20.3 * i, 7.7, 12.1, f" t{i}  ") for i in range(9)]
    rows += [(1, 2, 0, 0.0, 0.0, 10.0, 10.0, "a"), (1, 2, 1, 13.0, 1.0, 10.0, 10.0, "b"), (1, 2, 2, 0.0, 30.0, 10.0, 10.0, "c"), (1, 2, 3, 40.0, 30.0, 10.0, 10.0, "")]
    rows += [(2, 1, 0, 0.0, 0.0, 5.0, 0.0, "a"), (2, 1, 1, 4.0, 0.0, 5.0, 0.0, "b"), (2, 1, 2, 0.0, 9.0, 5.0, 0.0, "c")]
    rows += [(2, 2, 0, 0.0, 0.0, 5.0, float("inf"), "a"), (2, 2, 1, 0.0, 9.0, 5.0, 3.0, "b")]
    df = spark.createDataFrame([(*r[:7], r[6], 0.3, r[7]) for r in rows], "doc_id int, page_no int, line_no int, x double, y double, w double, h double, text_height double, confidence double, text string")
    out = {(r.doc_id, r.page_no, r.line_no): r for r in layout.visual_lines(df.repartition(1)).collect()}
    for _, _, i, x, y, w, h, text in rows[:9]:
        r = out[1, 1, i]
        assert (r.x, r.y, r.w, r.h, r.text, r.pieces, r.text_height) == (x, y, (x + w) - x, (y + h) - y, text.strip(), 1, h) and abs(r.confidence - 0.3) < 1e-12
    page = lambda d, p: [(n, out[d, p, n].text, out[d, p, n].pieces) for _, q, n in sorted(k for k in out if k[0] == d and k[1] == p) if q == p]
    assert page(1, 2) == [(0, "a b", 2), (1, "c", 1), (2, "", 1)] and out[1, 2, 2].confidence == 0.0
    assert page(2, 1) == [(0, "ab", 2), (1, "c", 1)] and page(2, 2) == [(0, "ba", 2)]


def test_regions_and_orders_of_many_pages_equal_brute_force(spark):
    import functools
    import random

    rng = random.Random(3)
    rows = [(1, p, i, rng.choice([0.0, 40.0, 90.0]) + rng.random(), rng.uniform(0, 200), rng.uniform(30, 60), rng.uniform(10, 50), rng.randrange(3), rng.choice([0.5, 0.7, 0.9])) for p in range(40) for i in range(rng.choice([1, 2, 5, 5, 5, 9, 70]))]
    df = spark.createDataFrame(rows, "doc_id int, page_no int, region_no int, x double, y double, w double, h double, priority int, score double").withColumn("kind", F.lit("text"))
    kept = layout.suppress_regions(df).collect()
    order = layout.reading_order(df.withColumnRenamed("region_no", "block_no")).collect()
    for p in range(40):
        page, want = [r for r in rows if r[1] == p], []
        for r in sorted(page, key=lambda r: (r[7], -r[8])):
            shared = lambda o: max(min(o[3] + o[5], r[3] + r[5]) - max(o[3], r[3]), 0) * max(min(o[4] + o[6], r[4] + r[6]) - max(o[4], r[4]), 0)  # noqa: B023, E731
            if all(shared(o) <= layout.DUPLICATE_REGION * min(o[5] * o[6], r[5] * r[6]) for o in want):
                want.append(r)
        assert sorted((k["rank"], k.region_no) for k in kept if k.page_no == p) == [(n, r[2]) for n, r in enumerate(want)]

        def compare(a, b):
            beside = min(a[4] + a[6], b[4] + b[6]) - max(a[4], b[4]) > 0 and (a[3] + a[5] <= b[3] or b[3] + b[5] <= a[3])
            return a[3] - b[3] if beside else a[4] - b[4]

        assert [o.block_no for o in sorted((o for o in order if o.page_no == p), key=lambda o: o.position)] == [r[2] for r in sorted(page, key=functools.cmp_to_key(compare))]


def test_a_job_expires_when_the_watermark_reaches_its_end(spark, tmp_path, monkeypatch):
    """Ends before and at the watermark expire, though one slot holds both; an end just after it does not."""
    monkeypatch.setattr(live, "SLOTS", 1)
    base = 1704067200
    rows = [(1, (base - 60) * 10**6, "failed"), (2, base * 10**6, "completed"), (3, base * 10**6 + 1, "completed"), (4, (base + 1800 + 600) * 10**6, "queued")]
    events = spark.createDataFrame([(j, t, n, s) for n, (j, t, s) in enumerate(rows)], "job_id long, t long, seq long, status string")
    more = {"step": "string", "done": "int", "total": "int", "file": "struct<name:string,size:long>", "summary": "map<string,string>", "error": "string", "client": "long", "heavy": "boolean", "mark": "string", "stage": "string"}
    events = events.select("job_id", F.timestamp_micros("t").alias("ts"), "seq", "status", *[F.lit(None).cast(t).alias(c) for c, t in more.items()])
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    made = live.ops_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), str(tmp_path / "ops"))
    assert sorted(r.job_id for r in made["expired"].collect()) == [1, 2]


def test_boxes_overlap_however_far_apart_their_corners_are(spark):
    """A word under the far end of a long one, and boxes of all sizes against every pair of their page."""
    import random

    from quire.plans import composed

    rnd = random.Random(7)
    rows = [(1, 1, 1, 30.0, 0.0, 300.0, 22.0), (1, 1, 2, 200.0, 12.0, 60.0, 12.0), (1, 2, 1, 0.0, 0.0, 0.0, 5.0), (1, 2, 2, 0.0, 2.0, float("nan"), 9.0)]
    rows += [(d, p, n, rnd.choice([-40.0, 0.0, 3.5, 19.0]) + rnd.randint(0, 300), float(rnd.randint(0, 90)), float(rnd.randint(0, 120)), rnd.choice([0.0, 4.0, 12.0, 12.5, 70.0])) for d in (2, 3) for p in (1, 2) for n in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, page_no int, word_id int, x double, y double, w double, h double")
    wanted = set()
    for i, (d, p, n, x, y, w, h) in enumerate(rows):
        for e, q, m, u, v, s, t in rows[:i]:
            over = max(0.0, min(x + w, u + s) - max(x, u)) * max(0.0, min(y + h, v + t) - max(y, v))
            if (d, p) == (e, q) and min(w * h, s * t) > 0 and abs(y - v) >= 0.5 * min(h, t) and over > 0.3 * min(w * h, s * t):
                wanted.add((d, p, min(n, m), max(n, m), over))
    assert (1, 1, 1, 2, 600.0) in wanted
    assert sorted((r.doc_id, r.page_no, r.first, r.second, r.overlap) for r in layout.all_overlaps(df, ["doc_id", "page_no"], "word_id").collect()) == sorted(wanted)
    side = {"words": df.filter("doc_id = 1").withColumn("text", F.lit("a")), "rules": df.limit(0), "pictures": df.limit(0)}
    card = composed.page_scorecard(side, side, F.lit(400.0), F.lit(400.0))
    assert {r.page_no: r.overlap for r in card.collect()} == {1: 1, 2: 0}


def _line_words(rnd, pages, odd=True):
    """Words of lines, some high enough to meet the line above, some far apart, some of no extent."""
    rows = []
    for d in range(pages):
        for line in range(rnd.randint(1, 9)):
            x, h = rnd.choice([30.0, 50.0]), rnd.choice([12.0, 16.0, 22.0])
            for k in range(rnd.randint(1, 8)):
                w = 6.0 * rnd.randint(1, 9)
                rows.append((d, 1, line * 100 + k, x, 20.0 * line - rnd.choice([0.0] * 9 + [11.0]), w, rnd.choice([h] * 12 + [0.0, float("nan")]) if odd and d % 4 == 3 else h, h, rnd.random(), rnd.choice(["a", " bc", "def ", " é", ""])))
                x += w + rnd.choice([6.0, 6.0, 6.0, 2.0, 0.0, 40.0, -3.0])
    return rows


def test_visual_lines_of_many_pages_equal_pieces_placed_one_by_one(spark):
    import random

    rows = _line_words(random.Random(3), 120, odd=False)
    wanted = set()
    for d in {r[0] for r in rows}:
        page = sorted((r for r in rows if r[0] == d), key=lambda r: (r[4] + r[6] / 2, r[2]))
        lines = []
        for p in page:
            fits = lambda o: min(p[4] + p[6], o[4] + o[6]) - max(p[4], o[4]) >= 0.6 * min((p[4] + p[6]) - p[4], (o[4] + o[6]) - o[4]) and max(p[3], o[3]) - min(p[3] + p[5], o[3] + o[5]) < 1.6 * max(p[6], o[6])  # noqa: B023,E731
            found = next((line for line in lines if any(map(fits, line))), None)
            lines.append([p]) if found is None else found.append(p)
        for line in lines:
            line.sort(key=lambda r: r[3])
            text = line[0][9].strip()
            for a, b in zip(line, line[1:]):
                text += ("" if b[3] - (a[3] + a[5]) < min(a[6], b[6]) * 0.25 else " ") + b[9].strip()
            sure = sum(r[8] * len(r[9]) for r in line) / max(1, sum(len(r[9]) for r in line))
            wanted.add((d, min(r[3] for r in line), min(r[4] for r in line), text, len(line), sorted(r[7] for r in line)[len(line) // 2], round(sure, 9)))
    df = spark.createDataFrame(rows, "doc_id long, page_no int, line_no int, x double, y double, w double, h double, text_height double, confidence double, text string")
    made = layout.visual_lines(df)
    assert "MapInArrow" in made._jdf.queryExecution().executedPlan().toString()
    assert {(r.doc_id, r.x, r.y, r.text, r.pieces, r.text_height, round(r.confidence, 9)) for r in made.collect()} == wanted


@pytest.mark.parametrize("odd", [False, True])
def test_tables_of_many_blocks_equal_tables_built_one_by_one(odd):
    """Cells on lines and scattered ones, of no or negative extent, or without a number."""
    import random

    import numpy as np
    import pyarrow as pa

    rnd = random.Random(11)
    groups = []
    for n in range(300):
        rows = rnd.randint(1, 6)
        scattered = odd and n % 3 == 0
        groups.append([(
            rnd.uniform(0, 300) if scattered else 100.0 * k + rnd.choice([0.0, 4.0, 8.0]), 20.0 * r + (rnd.uniform(0, 20) if scattered else 0.0),
            rnd.choice([-9.0, 0.0, 30.0, float("nan")] if scattered and n % 2 else [6.0, 36.0, 150.0]), rnd.choice([0.0, 12.0, 16.0]) if scattered else 12.0, rnd.choice(["a", " b ", "é c"])) for r in range(rows) for k in range(rnd.randint(1, 5))])
    cells = [c for g in groups for c in g]
    g = {k: np.array([c[i] for c in cells]) for i, k in enumerate("xywh")}
    starts = np.cumsum([0, *map(len, groups[:-1])])
    made = layout._tables({**g, "text": pa.array([c[4] for c in cells])}, starts)
    got = list(zip(made["table"].tolist(), made["row_no"].tolist(), made["col_no"].tolist(), made["text"].to_pylist(), made["col_share"].tolist(), made["row_share"].tolist()))
    wanted = []
    for n, (lo, size) in enumerate(zip(starts, map(len, groups))):
        x, y, w, h = (g[c][lo:lo + size] for c in "xywh")
        found = layout._table(x, y, w, h)
        if found:
            row, col, across, down = found
            wide, tall = (np.floor(s / s.sum() * 1000 + 0.5) / 1000 for s in (np.maximum(1.0, np.diff(v)) for v in (across, down)))
            for r in range(len(tall)):
                for c in range(len(wide)):
                    inside = sorted((i for i in np.argsort(y + h / 2, kind="stable") if (row[i], col[i]) == (r, c)), key=lambda i: x[i])
                    wanted.append((n, r, c, " ".join(cells[lo + i][4].strip() for i in inside), wide[c], tall[r]))
    assert len(wanted) > 500 and str(got) == str([tuple(v.item() if hasattr(v, "item") else v for v in t) for t in wanted])


def test_texts_of_tables_are_joined_where_they_are_built(spark):
    from quire import catalog

    rows = [(d, 1, 10 * r + c, 100.0 * c, 20.0 * r, 30.0, 12.0, f" {d}.{r}.{c}") for d in range(9) for r in range(d % 4) for c in range(3) if (r, c) != (1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, page_no int, line_no int, x double, y double, w double, h double, text string")
    keys = ["doc_id", "page_no"]
    got, wanted = (sorted(map(tuple, t.collect())) for t in (layout.built_texts(df, keys), layout.table_texts(layout.build_table(df, keys), keys)))
    assert got == wanted and got[0] == (2, 1, "2.0.0\t2.0.1\t2.0.2\n2.1.0\t\t2.1.2", 2)
    plan = catalog.queries()["table_texts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_lines_and_blocks_of_many_pages_equal_words_placed_one_by_one(spark):
    """Rows by their first word, in order of bottoms; a page's blocks are the same alone as among others."""
    import random

    import numpy as np

    from quire.operators import flow

    rnd = random.Random(5)
    rows = [(d, p, n, t, x, x + w, y, y + h, s) for d, p, n, x, y, w, h, s, _, t in _line_words(rnd, 90, odd=False)]
    rows += [(d, 2, n, "z", x := rnd.uniform(0, 300), x + 20, y := rnd.uniform(0, 200), y + rnd.choice([0.0, 8.0, 12.5, 30.0]), 12.0) for d in range(30) for n in range(60)]
    wanted = []
    for key in sorted({r[:2] for r in rows}):
        words = [r for r in rows if r[:2] == key]
        firsts, members = [], []
        for r in sorted(words, key=lambda r: (np.round(r[7]), r[4])):
            mid, tall = (r[6] + r[7]) / 2, r[7] - r[6]
            hit = next((k for k, (m, t) in enumerate(firsts) if abs(m - mid) < 0.45 * max(t, tall)), None)
            if hit is None:
                firsts.append((mid, tall))
                members.append([])
                hit = len(members) - 1
            members[hit].append(r)
        for row in members:
            row.sort(key=lambda r: r[4])
            line = [row[0]]
            for a, b in zip(row, row[1:]):
                if b[4] - a[5] > max(1.6 * max(a[8], b[8]), 14.0):
                    wanted.append((*key, line))
                    line = []
                line.append(b)
            wanted.append((*key, line))
    wanted = sorted((d, p, min(r[4] for r in w), min(r[6] for r in w), max(r[5] for r in w), max(r[7] for r in w), float(np.median([r[8] for r in w])), " ".join(r[3] for r in w), len(w)) for d, p, w in wanted)
    df = spark.createDataFrame(rows, "doc_id long, page_no int, word_no int, text string, x0 double, x1 double, top double, bottom double, size double")
    made = flow.pdf_lines(df)
    lines = made.collect()
    assert sorted(tuple(r[c] for c in ("doc_id", "page_no", "x0", "top", "x1", "bottom", "size", "text", "words")) for r in lines) == wanted
    placed = flow.text_blocks(made)
    assert "MapInArrow" in placed._jdf.queryExecution().executedPlan().toString() and "MapInPandas" not in placed._jdf.queryExecution().executedPlan().toString()
    together = {r for r in placed.collect() if r.doc_id == 7}
    assert together == set(flow.text_blocks(made.filter("doc_id = 7")).collect()) and len({r.block_no for r in together}) > 1


def test_runs_of_characters_in_rows_of_one_or_of_a_line(spark):
    """Characters one by one against a walk, and the same with those of a line in one row."""
    import random

    from quire.operators import flow
    from quire.sources import derive

    rnd = random.Random(2)
    rows = []
    for d in range(60):
        x, y, bold, size, colour = 0.0, 700.0, False, 12.0, "#000000"
        for n in range(rnd.randint(1, 80)):
            ch = rnd.choice(["a", "b", "é", " ", " ", "\t", "\n", "\x02", "c", "d"])
            bold, size, colour = rnd.choice([bold] * 9 + [not bold]), rnd.choice([size] * 9 + [12.5, 13.0]), rnd.choice([colour] * 12 + ["#ff0000", None])
            x, y = (0.0, y - 14) if ch == "\n" and d % 2 else (x + rnd.choice([6.0] * 9 + [30.0, -40.0]), y + rnd.choice([0.0] * 15 + [9.0]))
            rows.append((d, 1, n, ch, x, x + 6, y, y + size, size, bold, False, colour))
    wanted = []
    for d in range(60):
        run, low, high, reach = None, 0, 0, 0
        for _, _, _, ch, l, r, b, t, size, bold, italic, colour in (c for c in rows if c[0] == d):
            if ch in "\n\x02":
                run = None
            elif ch.isspace():
                if run:
                    run[1] += " "
            else:
                if run and [bold, italic, colour] == run[7:] and abs(run[6] - size) < 0.6 and (min(run[5], t) - max(run[4], b) > 0.4 * min(run[5] - run[4], t - b) or t <= b) and l - run[3] < max(2.0, size * 1.5):
                    run[1], run[2], run[3], run[4], run[5] = run[1] + ch, min(run[2], l), max(run[3], r), min(run[4], b), max(run[5], t)
                else:
                    run = [d, ch, l, r, b, t, size, bold, italic, colour]
                    wanted.append(run)
    df = spark.createDataFrame(rows, "doc_id long, page_no int, char_no int, ch string, l double, r double, b double, t double, size double, bold boolean, italic boolean, colour string")
    order = lambda runs: sorted(map(str, runs))
    assert order(tuple(r[c] for c in ("doc_id", "text", "l", "r", "b", "t", "size", "bold", "italic", "colour")) for r in flow.char_runs(df).collect()) == order(map(tuple, wanted))
    data = "/root/testdata/sf0.001"
    one, line = (flow.char_runs(chars.filter("doc_id % 5 = 0")) for chars in (derive.page_chars(spark, data), derive.line_chars(spark, data)))
    assert "MapInArrow" in one._jdf.queryExecution().executedPlan().toString()
    assert order(one.collect()) == order(line.collect())


def test_a_pages_words_are_counted_without_being_shuffled(spark):
    from quire import catalog
    from quire.plans import composed

    plan = catalog.queries()["page_scorecard"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.split("\n") if "Exchange" in line and "word#" in line]
    words = [(1, 1, 1, 0.0, "Café"), (1, 1, 2, 500.0, "ने"), (1, 1, 3, 0.0, "a,a"), (1, 2, 1, 0.0, None), (2, 1, 1, 0.0, "ΟΣ")]
    kept = [(1, 1, 1, 0.0, "CAFÉ"), (1, 1, 3, -9.0, "a"), (1, 2, 1, 0.0, "new"), (3, 1, 1, 900.0, "ος")]
    sides = [spark.createDataFrame(rows, "doc_id long, page_no int, word_id int, x double, text string").withColumns({"y": F.lit(0.0), "w": F.lit(9.0), "h": F.lit(9.0)}) for rows in (words, kept)]
    none = sides[0].limit(0)
    before, after = ({"words": side, "rules": none, "pictures": none} for side in sides)
    card = composed.page_scorecard(before, after, F.lit(400.0), F.lit(400.0))
    assert {(r.doc_id, r.page_no): (r.text, r.clipped) for r in card.collect()} == {(1, 1): (0.667, 1), (1, 2): (0.0, 0), (2, 1): (0.0, 0), (3, 1): (0.0, 1)}


def test_blocks_of_a_page_flow_are_made_where_their_words_lie(spark):
    import random

    from quire import catalog
    from quire.operators import flow

    plan = catalog.queries()["pdf_page_flow"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # Documents and rules as texts, and what the pages are made of in the end; no words.
    assert not [line for line in plan.split("\n") if "Exchange" in line and "block_no" in line] and plan.count("Exchange hashpartitioning(doc_id") == plan.count("REPARTITION_BY_NUM") and "MapInPandas" not in plan
    rows = [(d, p, n, t, x, x + w, y, y + h, s) for d, p, n, x, y, w, h, s, _, t in _line_words(random.Random(8), 40, odd=False)]
    lines = flow.pdf_lines(spark.createDataFrame(rows, "doc_id long, page_no int, word_no int, text string, x0 double, x1 double, top double, bottom double, size double"))
    keys = ["doc_id", "page_no"]
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top", "x0", "line_no", "text"))), lambda v: v["text"]), "\n")
    wanted = flow.text_blocks(lines, keys, keep=True).groupBy(*keys, "block_no").agg(F.min("x0"), F.min("top"), F.max("x1"), F.max("bottom"), F.count(F.lit(1)).cast("int"), text)
    assert sorted(map(tuple, flow.block_boxes(lines).collect())) == sorted(map(tuple, wanted.collect()))
