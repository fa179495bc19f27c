"""Literal cases, and brute force where SQL cannot say the rule."""

import random

import pytest
from pyspark.sql import functions as F

from quire.functions import style
from quire.functions import text as tx
from quire.operators import assets, changes, cleaning, clusters, flow, jobs, layout, numeric, page_plans, profile, readings, searching
from quire.plans import composed, ranks, segments
from quire.sources import readers

PAGE = ["doc_id", "page_no"]


def rows(df):
    return [tuple(r) for r in df.collect()]


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("text, cleaned", [("one,two", "one, two"), ("end.Next", "end. Next"), ("e.g. x", "e.g. x"), ("wait !", "wait!"), ("a!!??", "a!?"), (",,", ","), (".....", "..."), ("“q” ‘r’", "\"q\" 'r'"), ("a​b­c", "abc"), ("नेपाल ।अब", "नेपाल। अब")])
def test_inline_rules(spark, text, cleaned):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert cleaning.clean_documents(df, ["specialCharacters", "punctuation", "ocrSpacing", "extraSpaces"]).first().text == cleaned


def test_join_lines(spark):
    df = spark.createDataFrame([(1, "a long exam-\nple here\n\nStop.\nnext"), (2, "हामी\nअब")], "doc_id long, text string")
    out = {r.doc_id: (r.text, r.joinLines) for r in cleaning.join_lines(df).collect()}
    assert out == {1: ("a long example here\n\nStop.\nnext", 1), 2: ("हामी अब", 1)}


def test_blank_and_repeated_lines(spark):
    df = spark.createDataFrame([(1, "a\n  \nb\n\n  \n\nc"), (2, "x\nx\n\ny\n\nx")], "doc_id long, text string")
    assert {r.doc_id: r.blankParagraphs for r in cleaning.drop_blanks(df).collect()} == {1: 2, 2: 0}
    assert {r.doc_id: (r.text, r.duplicateLines) for r in cleaning.dedup_lines(df).collect()}[2] == ("x\n\ny", 2)


def test_cleaning_twice_changes_nothing(spark):
    df = spark.createDataFrame([(1, "one,two  three !!\nend.Next\n\n“x”")], "doc_id long, text string")
    once = cleaning.clean_documents(df).select("doc_id", "text")
    assert cleaning.clean_documents(once).first().text == once.first().text


def test_profile_counts_graphemes(spark):
    df = spark.createDataFrame([("ne", "नेपाली abc")], "lang string, text string")
    r = profile.text_profile(df, ["lang"], rollup=False).first()
    assert (r.characters, r.characters_no_spaces, r.words) == (7, 6, 2)


@pytest.mark.parametrize("mode, expected", [("title", "The Cat of the Été. A Day"), ("sentence", "The cat of the été. A day"), ("alternating", "tHe CaT oF tHe ÉtÉ. a DaY"), ("upper", "THE CAT OF THE ÉTÉ. A DAY")])
def test_case(spark, mode, expected):
    assert one(spark, tx.convert_case(F.lit("the cat of the été. a day"), mode)) == expected


def test_keyword_search(spark):
    tools = spark.createDataFrame([("a", 0, "Image Compressor", "Smaller files, same look", "reduce shrink"), ("b", 1, "Compress PDF", "Reduce PDF size", ""), ("c", 2, "Background Remover", "Transparent cut-outs", "cutout")], "id string, n int, name string, description string, keywords string")
    found = lambda q: [r.id for r in searching.keyword_search(tools, q, 10, "name", ["description", "keywords"], "n").collect()]
    assert found("compress") == ["b", "a"] and found("shrink") == ["a"] and found("BACKGROUND cutout") == ["c"] and found("pdf background") == [] and found("   ") == []


@pytest.mark.parametrize("text, query, expected", [("Compress PDF", "comp press", [(0, 8)]), ("PDF to PDF", "pdf", [(0, 3), (7, 10)]), ("Crop", "zoom", []), ("Crop", "  ", [])])
def test_highlights(spark, text, query, expected):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert sorted((r.start, r.end) for r in searching.highlights(df, query, "doc_id").collect()) == expected


def test_merge_ranges_across_buckets(spark):
    ranges = [(1, 0, 5), (1, 5, 9), (1, 10, 5000), (1, 4100, 4200), (1, 9000, 9001)]
    df = spark.createDataFrame(ranges, "k int, start int, end int")
    assert sorted(rows(segments.merge_ranges(df, ["k"]))) == [(1, 0, 9), (1, 10, 5000), (1, 9000, 9001)]


def test_page_lists(spark):
    pages = spark.createDataFrame([(d, p) for d in range(1, 7) for p in range(1, 11)], "doc long, page int")
    specs = spark.createDataFrame([(1, "1-3, 5, 8-"), (2, "3-1"), (3, "12"), (4, "x"), (5, " "), (6, "2;2;1-2")], "doc long, spec string")
    chosen = {}
    for r in page_plans.select_pages(pages, specs, "doc", "page").collect():
        chosen.setdefault(r.doc, []).append(r.page)
    assert {k: sorted(v) for k, v in chosen.items()} == {1: [1, 2, 3, 5, 8, 9, 10], 6: [1, 2]}
    counts = pages.groupBy("doc").agg(F.count("page").cast("int").alias("pages"))
    assert {r.doc: r.problem for r in page_plans.spec_problems(page_plans.parse_specs(specs, counts, "doc"), "doc").collect()} == {2: "backwards", 3: "outside", 4: "syntax", 5: "empty"}
    some = spark.createDataFrame([(1, p) for p in (1, 2, 3, 5, 7, 8)], "doc long, page int")
    assert page_plans.format_pages(some, "doc", "page").first().pages == "1-3, 5, 7-8"


def test_agreement(spark):
    df = lambda *r: spark.createDataFrame(list(r), "k int, text string")
    out = {r.k: r.agreement for r in readings.agreement(df((1, "a b b c"), (2, "")), df((1, "b b d"), (2, "--")), ["k"]).collect()}
    assert out[1] == pytest.approx(4 / 7) and out[2] == 1.0
    assert one(spark, readings.row_agreement(F.lit("a b b c"), F.lit("b b d"))) == pytest.approx(4 / 7)


def test_reconcile_devanagari(spark):
    good, far = "नेपाली पाठ यहाँ छ र पढ्न सकिन्छ भनेर लेखिएको", "पूरै अर्कै कुरा"
    layer = spark.createDataFrame([(1, good, 0, ["Mangal"]), (2, good, 0, ["Mangal"]), (3, "", 1, []), (4, "x" * 30, 0, ["AB+Preeti"])], "k int, text string, images int, fonts array<string>")
    read = spark.createDataFrame([(1, good, 0.9), (2, far, 0.9), (4, "ocr text", 0.5)], "k int, ocr_text string, confidence double")
    out = {r.k: (r.method, r.reason, r.note) for r in readings.reconcile_readings(layer, read, ["k"]).collect()}
    assert out == {1: ("text", None, None), 2: ("ocr", "mismatch", None), 3: ("none", None, "unavailable"), 4: ("ocr", "legacy-font", None)}


def test_similar_passages_equals_brute_force(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("abcdefghij") for _ in range(n))
    docs, items = [(i, text(rng.randint(1, 12))) for i in range(60)], [(i, text(rng.randint(1, 8))) for i in range(20)]
    def dice(a, b):
        from collections import Counter
        x, y = Counter(a.split()), Counter(b.split())
        return 2 * sum((x & y).values()) / (sum(x.values()) + sum(y.values()))
    for minimum in (0.3, 0.7):
        want = {(d, i) for d, a in docs for i, b in items if dice(a, b) >= minimum}
        out = readings.similar_passages(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string"), minimum)
        assert {(r.doc_id, r.item_id) for r in out.collect()} == want


def test_upper_median(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (1, 2, 3, 4)] + [(2, 7.0)], "k int, v double")
    assert {r.k: r.upper_median for r in ranks.upper_median(df, ["k"], "v").collect()} == {1: 3.0, 2: 7.0}


def test_one_hot_group_matches_sorting(spark):
    rng = random.Random(5)
    values = [rng.choice([rng.gauss(0, 1), 3.0, rng.random() * 1e6]) for _ in range(5000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").withColumn("k", F.lit(1))
    assert ranks.upper_median(df, ["k"], "v").first().upper_median == sorted(values)[2500]


def test_snap_compares_with_the_kept_value(spark):
    df = spark.createDataFrame([(1, v) for v in (0.0, 1.5, 3.0, 4.5, 20.0)], "k int, v double")
    assert {r.v: r.snapped for r in numeric.snap(df, ["k"], "v", 2.0).collect()} == {0.0: 0.0, 1.5: 0.0, 3.0: 3.0, 4.5: 3.0, 20.0: 20.0}


def test_line_split(spark):
    words = [(1, 1, i, t, x, x + 5.0 * len(t), 100.0, 110.0, 10.0) for i, (t, x) in enumerate((("Ref:", 50.0), ("ST/114", 75.0), ("Date:", 400.0)))]
    df = spark.createDataFrame(words, "doc_id long, page_no int, word_no int, text string, x0 double, x1 double, top double, bottom double, size double")
    assert [r.text for r in flow.pdf_lines(df).orderBy("line_no").collect()] == ["Ref: ST/114", "Date:"]


def test_dashed_rule(spark):
    df = spark.createDataFrame([(1, "h", 50.0, 10.0 + 4 * i, 12.0 + 4 * i, 1.0, "000000") for i in range(20)], "page_no int, dir string, pos double, a double, b double, thick double, colour string")
    (r,) = flow.merge_rules(df, ["page_no"]).collect()
    assert r.dashed and r.b == 88.0


def test_find_boxes(spark):
    rules = [(1, 0, "h", 100.0, 50.0, 250.0), (1, 1, "h", 160.0, 50.0, 250.0), (1, 2, "v", 50.0, 100.0, 160.0), (1, 3, "v", 250.0, 100.0, 160.0)]
    df = spark.createDataFrame(rules, "page_no int, ordinal int, dir string, pos double, a double, b double")
    assert [(r.x0, r.top, r.x1, r.bottom) for r in flow.find_boxes(df, ["page_no"]).collect()] == [(50.0, 100.0, 250.0, 160.0)]


def test_list_items_start_blocks(spark):
    lines = [("• First item that runs on", 100.0), ("and continues here below", 109.0 + 2), ("• Second item of the list", 123.0), ("body text that follows on", 145.0)]
    df = spark.createDataFrame([(1, 1, i, 50.0, top, 200.0, top + 10, 10.0, t) for i, (t, top) in enumerate(lines)], "doc_id long, page_no int, line_no int, x0 double, top double, x1 double, bottom double, size double, text string")
    blocks = [r.block_no for r in flow.text_blocks(df).orderBy("line_no").collect()]
    assert [blocks.count(b) for b in sorted(set(blocks))] == [2, 1, 1]


@pytest.mark.parametrize("name, family, bold, italic", [("AAAAAA+Helvetica-Bold", "Arial", True, False), ("NimbusRomNo9L-ReguItal", "Times New Roman", False, True), ("CMBX10", "Times New Roman", True, False), ("KohinoorDevanagari-Regular", "Kohinoor Devanagari", False, False)])
def test_fonts(spark, name, family, bold, italic):
    assert tuple(one(spark, style.font_style(F.lit(name)))) == (family, bold, italic)


def test_column_order(spark):
    left = [(i, 0.0, 100.0 + 20 * i) for i in range(4)]
    right = [(i + 4, 300.0, 100.0 + 20 * i) for i in range(4)]
    items = [(1, 1, 90, "text", 0.0, 10.0, 500.0, 40.0, 1)] + [(1, 1, n, "text", x, y, x + 200.0, y + 10, 1) for n, x, y in left + right]
    df = spark.createDataFrame(items, "doc_id long, page_no int, element_no int, kind string, x0 double, top double, x1 double, bottom double, lines int")
    assert [r.element_no for r in flow.xy_cut_order(df).orderBy("position").collect()] == [90, 0, 1, 2, 3, 4, 5, 6, 7]


def test_invoice_table(spark):
    grid = [["Item", "Description", "Qty", "Rate", "Amount"]] + [[str(r), f"Service {r}", str(r * 2), "100.00", f"{r * 200}.00"] for r in range(1, 5)]
    cells = [(1, 1, r * 5 + c, 20.0 + 110 * c, 20.0 * r, 6.0 * len(t), 12.0, t) for r, row in enumerate(grid) for c, t in enumerate(row)]
    df = spark.createDataFrame(cells, "doc_id long, page_no int, line_no int, x double, y double, w double, h double, text string")
    out = {(r.row_no, r.col_no): r.text for r in layout.build_table(df, PAGE).collect()}
    assert len(out) == 25 and out[(1, 1)] == "Service 1" and out[(4, 4)] == "800.00"
    assert layout.build_table(df.filter("line_no < 3"), PAGE).count() == 0


def test_visual_lines_equals_brute_force(spark):
    rng = random.Random(7)
    pieces = [(1, p, i, rng.uniform(0, 200), rng.uniform(0, 120), rng.uniform(5, 40), rng.choice([8.0, 12.0, 20.0])) for p in range(6) for i in range(40)]
    def brute(page):
        ps = sorted((q for q in pieces if q[1] == page), key=lambda q: q[4] + q[6] / 2)
        made = []
        for q in ps:
            for row in made:
                if any(min(o[4] + o[6], q[4] + q[6]) - max(o[4], q[4]) >= 0.6 * min(o[6], q[6]) and max(o[3], q[3]) - min(o[3] + o[5], q[3] + q[5]) < 1.6 * max(o[6], q[6]) for o in row):
                    row.append(q)
                    break
            else:
                made.append([q])
        return sorted(sorted(o[2] for o in row) for row in made)
    df = spark.createDataFrame([(*q, q[6], 0.5, str(q[2])) for q in pieces], "doc_id int, page_no int, line_no int, x double, y double, w double, h double, text_height double, confidence double, text string")
    out = layout.visual_lines(df).collect()
    for page in range(6):
        sizes = sorted(r.pieces for r in out if r.page_no == page)
        assert sizes == sorted(len(row) for row in brute(page))


def test_cluster_boxes_equals_brute_force(spark):
    rng = random.Random(11)
    boxes = [(1, i, rng.uniform(0, 400), rng.uniform(0, 900), rng.uniform(5, 40), rng.uniform(5, 40)) for i in range(80)]
    made = [[x, y, x + w, y + h, 1] for _, _, x, y, w, h in boxes]
    changed = True
    while changed:
        changed = False
        for i in range(len(made)):
            for j in range(i + 1, len(made)):
                a, b = made[i], made[j]
                if a[0] < b[2] + 2 and b[0] < a[2] + 2 and a[1] < b[3] + 2 and b[1] < a[3] + 2:
                    made[i] = [min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]), a[4] + b[4]]
                    del made[j]
                    changed = True
                    break
            if changed:
                break
    df = spark.createDataFrame(boxes, "page int, id int, x double, y double, w double, h double")
    out = clusters.cluster_boxes(df, ["page"], "id", 2.0).collect()
    got = sorted((round(r.x, 6), round(r.y, 6), r.boxes) for r in out)
    assert got == sorted((round(m[0], 6), round(m[1], 6), m[4]) for m in made)


def test_line_diff_equals_brute_force(spark):
    rng = random.Random(2)
    def kept(a, b):
        n, m = len(a), len(b)
        t = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n - 1, -1, -1):
            for j in range(m - 1, -1, -1):
                t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
        x, y, i, j = set(), set(), 0, 0
        while i < n and j < m:
            if a[i] == b[j]:
                x.add(i), y.add(j)
                i, j = i + 1, j + 1
            elif t[i + 1][j] >= t[i][j + 1]:
                i += 1
            else:
                j += 1
        return x, y
    pairs = [(k, [rng.choice("abc") for _ in range(rng.randint(1, 15))], [rng.choice("abc") for _ in range(rng.randint(1, 15))]) for k in range(30)]
    side = lambda n: spark.createDataFrame([(p[0], "\n".join(p[n])) for p in pairs], "doc_id int, text string")
    out = {}
    for r in changes.line_diff(side(1), side(2)).collect():
        if not r.changed:
            out.setdefault((r.doc_id, r.side), set()).add(r.line_no)
    for k, a, b in pairs:
        if a != b:
            x, y = kept(a, b)
            assert out.get((k, "before"), set()) == x and out.get((k, "after"), set()) == y


def test_dominant_face_boundary(spark):
    images = spark.createDataFrame([(1,), (2,), (3,)], "image_id int")
    faces = spark.createDataFrame([(1, 0, 10.0, 10.0), (1, 1, 10.0, 4.0), (2, 0, 10.0, 10.0), (2, 1, 10.0, 3.9)], "image_id int, face_no int, w double, h double")
    assert {r.image_id: r.problem for r in assets.dominant(images, faces).collect()} == {1: "MULTIPLE_FACES", 2: None, 3: "NO_FACE"}


def test_unique_names(spark):
    df = spark.createDataFrame([("g", i, n) for i, n in enumerate(("a.pdf", "a.pdf", "a-2.pdf", "a.pdf"))] + [("h", i, "b.pdf") for i in range(3)], "grp string, n int, name string")
    out = {(r.grp, r.n): r.unique_name for r in assets.unique_names(df, "grp", "name", "n").collect()}
    assert [out[("g", i)] for i in range(4)] == ["a.pdf", "a-2.pdf", "a-2-2.pdf", "a-3.pdf"] and [out[("h", i)] for i in range(3)] == ["b.pdf", "b-2.pdf", "b-3.pdf"]


def test_checked_scenes(spark):
    raw = ['{"version":1,"savedAt":5,"scene":"s","view":{"scrollX":1,"scrollY":2,"zoom":0}}', '{"version":2,"scene":"s"}', "nonsense", '{"version":1,"scene":"s","view":{"scrollX":1,"scrollY":2,"zoom":2},"name":" t "}']
    good, bad = readers.checked_scenes(spark.createDataFrame([(r,) for r in raw], "raw string"), "raw")
    assert [(r.r.savedAt, r.r.view is None) for r in good.collect()] == [(5.0, True), (0.0, False)] and bad.count() == 2


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"one\r\ntwo")
    (tmp_path / "in" / "b.html").write_text("<p>x &lt; y</p><script>no()</script>")
    (tmp_path / "in" / "c.bin").write_bytes(b"\xff\xd8\xff\xe0 not text")
    texts = {r.path.rsplit("/", 1)[1]: r.text for r in readers.read_text_corpus(spark, str(tmp_path / "in")).filter("problem IS NULL").collect()}
    assert texts == {"a.txt": "one\ntwo", "b.html": "\nx < y\n"}
    manifest = {r.path.rsplit("/", 1)[1]: r.format for r in readers.asset_manifest(spark, str(tmp_path / "in")).collect()}
    assert manifest == {"a.txt": None, "b.html": None, "c.bin": "jpeg"}
    readers.write_corpus(spark.createDataFrame([("en", "a\nb")], "lang string, text string"), str(tmp_path / "out"), "txt", "lang")
    (part,) = (tmp_path / "out" / "lang=en").glob("part-*")
    assert part.read_bytes() == b"a\r\nb\r\n"


def test_recogniser_output(spark, tmp_path):
    lines = ["level\tpage_num\tblock\tpar\tline\tword\tleft\ttop\twidth\theight\tconf\ttext", "1\t1\t0\t0\t0\t0\t0\t0\t500\t700\t-1\t", "5\t1\t1\t1\t1\t1\t10\t20\t30\t12\t91\thello\tthere", "5\t1\t1\t1\t1\t2\t50\t20\t30\t12\t-1\t  "]
    (tmp_path / "page.tsv").write_text("\n".join(lines))
    (r,) = readers.read_ocr_tsv(spark, str(tmp_path)).collect()
    assert (r.x, r.conf, r.text) == (10.0, 0.91, "hello\tthere")


def test_late_events_are_dropped_and_counted(spark, tmp_path):
    from quire.streaming import live

    base = 1704067200
    for n, batch in enumerate(([base, base + 60], [base + 7200], [base + 7260], [base + 30])):
        spark.createDataFrame([(1, t) for t in batch], "client int, s long").select("client", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(str(tmp_path / f"d/b{n}"))
        # Files in order of time, one to a batch.
        (f,) = (tmp_path / f"d/b{n}").glob("part-*")
        (tmp_path / "in").mkdir(exist_ok=True)
        f.rename(tmp_path / "in" / f"{n}.parquet")
    import os
    for n in range(4):
        os.utime(tmp_path / "in" / f"{n}.parquet", (base + n, base + n))
    stream = spark.readStream.schema("client int, ts timestamp").option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
    out, query = live.run_to_table(jobs.rate_windows(stream, "client", watermark="10 minutes"), "late", "update", ["client", "window_start"])
    # A batch is judged by the watermark the batch before it began with, so the late row comes two batches on.
    assert sorted(r.requests for r in out.collect()) == [2, 2]
    assert live.dropped_rows(query) == 1


def test_running_values_match_a_plain_window(spark):
    from pyspark.sql import Window

    rng = random.Random(4)
    df = spark.createDataFrame([(rng.choice("ab"), i, rng.choice([None, rng.randint(0, 9)])) for i in range(500)], "k string, n int, v int")
    w = Window.partitionBy("k").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    plain = df.select("k", "n", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("s"), F.max("v").over(w).alias("m"), F.lag("v").over(Window.partitionBy("k").orderBy("n")).alias("l"))
    split = segments.with_previous(df, ["k"], ["n"], F.floor(F.col("n") / 37), {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("v"))}).select("k", "n", "s", "m", "l")
    assert sorted(rows(plain), key=str) == sorted(rows(split), key=str)


def test_null_groups_keep_their_rows(spark):
    """A group whose key is null is a group like any other."""
    from quire.operators import numeric
    from quire.plans import composed

    rows = [(g, float(i % 40)) for g in ("a", None) for i in range(200)] + [("a", 900.0), (None, 950.0), (None, 960.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    assert {r["g"]: r["count"] for r in numeric.robust_stretch(df, ["g"], "v").groupBy("g").count().collect()} == {"a": 201, None: 202}
    assert sorted((str(r["g"]), r["v"]) for r in numeric.mad_outliers(df, ["g"], "v").collect()) == [("None", 950.0), ("None", 960.0), ("a", 900.0)]
    assert {r["g"]: r["outliers"] for r in composed.numeric_profile(df, ["g"], "v", 0, 256).collect()} == {"a": 1, None: 2}
    docs = spark.createDataFrame([(i, "word " * 60, g) for i, g in enumerate(["x", "x", None, "y", None])], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, quality int")
    assert {r["lang"] for r in composed.profile_corpus(docs, labels, ["lang"]).collect()} == {"x", "y", None}


def test_detections_follow_the_order_of_joined_texts(spark):
    """Texts go left to right from the join on: an overlay takes the leftmost one, and ties in score follow it."""
    columns = "image_id int, region_no int, type string, score double, x double, y double, w double, h double, angle double, line_height double, elongation double"
    texts = spark.createDataFrame([(1, 1, "text", 0.8, 300.0, 550.0, 50.0, 20.0, 0.0, 20.0, 3.0), (1, 2, "text", 0.8, 10.0, 550.0, 50.0, 20.0, 0.0, 20.0, 3.0)], columns)
    overlay = spark.createDataFrame([(1, 0, "overlay", 0.8, 0.0, 540.0, 400.0, 40.0, 0.0, 20.0, 3.0)], columns)
    for overlays, kinds in ((overlay.limit(0), ["text", "text"]), (overlay, ["logo", "text"])):
        found = composed.detection_review(texts, overlays, F.lit(800.0), F.lit(600.0)).orderBy("rank").collect()
        assert [(r["rank"], r.region_no, r.type) for r in found] == [(1, 2, kinds[0]), (2, 1, kinds[1])]
