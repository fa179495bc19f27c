"""Periodic runs, hard negatives and MinHash near-duplicates against brute force."""

import hashlib
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from conftest_corpus import words
from pyspark.sql import functions as F

from quire.llm import hard_negatives, minhash, periodic_runs, queries, rolling, set_links
from quire.llm.periodic_runs import PRIME


def runs_by_hand(w, periods=4, shortest=6):
    names = {}
    v = np.array([names.setdefault(x, len(names)) for x in w])
    out = []
    for q in range(1, len(v) // periods + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (v[:-q] == v[q:]).astype(int), [0]])))
        for s, e in zip(edges[::2].tolist(), (edges[1::2] + q).tolist()):
            if e - s >= max(shortest, periods * q) and not any((v[s:e - r] == v[s + r:e]).all() for r in range(1, q)):
                out.append((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize("periods, shortest, longest", [(4, 6, periodic_runs.LONGEST), (4, 6, 4), (2, 2, periodic_runs.LONGEST), (3, 5, 8)])
def test_runs_of_texts_laid_end_to_end(periods, shortest, longest):
    rng = np.random.default_rng(7)
    for _ in range(40):
        texts = []
        for _ in range(rng.integers(1, 6)):
            kinds = int(rng.choice([1, 2, 3, 50]))
            text = rng.integers(0, kinds, rng.choice([0, 1, 5, 20, 80])).tolist()
            for _ in range(rng.integers(0, 3)):
                text += (rng.integers(0, kinds, rng.integers(1, 20)).tolist() * int(rng.integers(2, 7)))[:int(rng.integers(1, 150))]
            texts.append(text)
        bounds = np.cumsum([0, *map(len, texts)])
        tokens = rolling.mix(np.array([v for t in texts for v in t], np.uint64) + np.uint64(9))
        start, end, period = periodic_runs.runs(tokens, bounds, periods, shortest, longest)
        want = [(s + bounds[i], n, q) for i, t in enumerate(texts) for s, n, q in runs_by_hand(t, periods, shortest)]
        assert list(zip(start.tolist(), (end - start).tolist(), period.tolist())) == sorted(want, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("n", [4, 64, 256, 8192])
def test_transform_convolves_exactly(n):
    rng = np.random.default_rng(n)
    a, b = rng.integers(0, PRIME, (3, n)).astype(float), rng.integers(0, PRIME, (3, n)).astype(float)
    got = periodic_runs.inverse(periodic_runs.reduced(periodic_runs.transform(a) * periodic_runs.transform(b)))
    for place in rng.integers(0, n, 5):
        want = [sum(int(x) * int(y) for x, y in zip(a[i], np.roll(b[i][::-1], place + 1))) % PRIME for i in range(3)]
        assert got[:, place].astype(int).tolist() == want
    assert (periodic_runs.inverse(periodic_runs.transform(a)) == a).all()


def test_one_word_over_and_over_is_one_run():
    """Multiples of a period are no runs of their own, and the work doesn't grow with their number."""
    n = 300_000
    start, end, period = periodic_runs.runs(np.full(n, 77, np.uint64), np.array([0, n]))
    assert (start.tolist(), end.tolist(), period.tolist()) == ([0], [n], [1])


def test_collapse(docs, none):
    repeated = docs.union(docs.withColumn("text", F.concat(F.lit("a "), F.repeat(F.lit("b c d "), 9), "text", F.repeat(F.lit(" x"), 30))))
    rows = repeated.select("doc_id", "text").collect()
    got = periodic_runs.collapse(repeated)
    assert set(got.columns) == {*docs.columns, "runs"}
    want = Counter((r["doc_id"], len(w), tuple(runs_by_hand(w)), collapsed(w, runs_by_hand(w))) for r in rows for w in [words(r["text"])])
    assert Counter((r["doc_id"], r["n_words"], tuple(map(tuple, r["runs"])), r["text"]) for r in got.collect()) == want
    assert periodic_runs.collapse(none).count() == 0


def test_op11_over_its_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = {r["doc_id"]: r for r in queries.op11_periodic_runs(spark, folder).collect()}
    texts = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(rows) == len(texts)
    for r in texts:
        w, h = words(r["text"]), zlib.crc32(str(r["doc_id"]).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = runs_by_hand(w)
        first = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
        want = [len(found), *((first[0], first[1], first[2], 1000 * first[1] // first[2]) if first else [None] * 4),
                hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest(), hashlib.sha256(collapsed(w, found).encode()).hexdigest()]
        assert [rows[r["doc_id"]][c] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")] == want


def mined_by_hand(rows, positives, negatives, low, high):
    take = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v], k) for i, v, k in rows if i is not None and k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a in sorted({i for i, _, _ in take if i % 100 == 0}):
        _, v, kind = min((r for r in take if r[0] == a), key=lambda r: (r[2], r[1]))
        others = sorted((-score(v, w), i, k == kind) for i, w, k in take if i != a)
        for s, p, _ in [o for o in others if o[2]][:positives]:
            fit = [o for o in others if not o[2] and low * -s <= 100 * -o[0] <= high * -s]
            out += [(a, p, rank, i, -s, -t) for rank, (t, i, _) in enumerate(fit[:negatives], 1)]
    return Counter(out)


@pytest.mark.parametrize("how", [{}, {"positives": 3, "negatives": 2, "low": 50, "high": 95}, {"block": 256, "positives": 9, "negatives": 40}])
def test_hard_negatives(spark, how, monkeypatch):
    how = dict(how)
    if how.pop("block", None):
        monkeypatch.setattr(hard_negatives, "BLOCK", 256)
        monkeypatch.setattr(hard_negatives, "CHUNK", 2)
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(6, 8))
    rows = [(i, (centers[i % 6] + rng.normal(size=8) * 0.7).round(2).tolist(), int(rng.integers(0, 4)) if i % 5 else 0) for i in range(700)]
    # Ties, repeated rows and ids, nulls, odd components, shorter vectors, zero.
    rows += [(1000 + i, rows[3][1], i % 3) for i in range(20)] + [rows[7], rows[7], (100, rows[8][1], 1), (100, rows[8][1], 1), (None, rows[1][1], 1), (2000, None, 1), (2001, rows[1][1], None)]
    rows += [(2002, [1.0, None] + [0.0] * 6, 1), (2003, [float("nan")] * 8, 1), (2004, [float("inf")] + [0.0] * 7, 1), (2100, [0.0] * 8, 1), (2200, [], 2), (2300, [9.0, 8.0], 2), (2400, [-9.0] * 8, 77)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"row": F.lit("x"), "part": F.lit(1), "score": F.lit(2), "all": F.lit(3)}).repartition(5)
    got = hard_negatives.mine(table, **how)
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert got.columns == columns
    want = mined_by_hand(rows, how.get("positives", 5), how.get("negatives", 5), how.get("low", 80), how.get("high", 100))
    assert len(want) > 20 and Counter(tuple(r[c] for c in columns) for r in got.collect()) == want
    assert hard_negatives.mine(table.where("false")).count() == 0


def grouped_by_hand(rows, similarity):
    sets = [{tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} if w else set() for w in (words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for _, t in rows)]
    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j, k in Counter(j for x in s for j in where[x] if j > i).items():
            if 100 * k >= similarity * (len(s) + len(sets[j]) - k):
                root[find(j)] = find(i)
    least = {}
    for i, (name, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), (True, 0)), (name is None, name or 0))
    return Counter((name, len(sets[i]), None if least[find(i)][0] else least[find(i)][1]) for i, (name, _) in enumerate(rows))


@pytest.mark.parametrize("how", [{}, {"chunk": 4, "words": 4000}])
def test_minhash_near_duplicates(spark, docs, none, how, monkeypatch):
    if how:
        monkeypatch.setattr(set_links, "SPLIT", 3)
    rng = np.random.default_rng(3)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    # Families whose members are alike in part: stars don't reach all links, whole buckets do.
    for family in range(12):
        base = [f"{family}w{i}" for i in range(int(rng.integers(40, 200)))]
        for n in range(25):
            made = list(base)
            for at in rng.integers(0, len(base), int(rng.integers(0, 6))):
                made[at] = f"x{rng.integers(99)}"
            rows.append((1000 + 100 * family + n, " ".join(made)))
    # Six and seven common shingles: of seven, and of nine.
    rows += [(5000, "a b c d e f g h i j k"), (5001, "a b c d e f g h i j"), (5002, "K l m n o p q r s t u"), (5003, "k l m n o p q r s t v"), (5004, "A  b\tc"), (5005, "a b c"), (5006, "a b")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "size": F.lit("s"), "shape": F.lit(2), "set": F.lit(3), "keys": F.lit(4), "id": F.lit(5)}).repartition(6)
    got = minhash.near_duplicates(table, **how)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == grouped_by_hand(rows, 85)
    assert minhash.near_duplicates(none).count() == 0


def test_star_leaves_no_link_behind(spark):
    """Two sets that are alike, but unlike the smallest of their bucket, are linked."""
    made = {5: range(0, 100), 6: range(50, 150), 7: range(52, 150), 8: range(51, 150), 9: range(53, 153)}
    sets = spark.createDataFrame([(k + 10, sorted(v)) for k, v in made.items()] + [(1, [1, 2])], "row long, set array<long>")
    shapes = spark.createDataFrame([(k, k + 10, len(v)) for k, v in made.items()], "shape long, row long, size long")
    buckets = spark.createDataFrame([(key, k) for key in (1, 2) for k in made], "key long, shape long")
    found = set_links.links(buckets, shapes, sets, Fraction(9, 10)).collect()
    joined = {frozenset((r["a"], r["b"])) for r in found}
    assert 5 not in {x for pair in joined for x in pair} and {x for pair in joined for x in pair} == {6, 7, 8, 9} and len(joined) == 3


@pytest.mark.parametrize("share, most", [(6 / 7, 0.02), (0.85, 0.02)])
def test_signs_agree_as_sets_do(share, most):
    """Bins of one permutation agree with the chance of the sets' likeness, filled or not."""
    rng = np.random.default_rng(5)
    for size in (7, 60, 2000):
        common = round(size * share)
        agree = []
        for _ in range(300 if size < 100 else 40):
            x = rng.integers(0, 2**64, size, dtype=np.uint64)
            a, b = np.sort(x), np.sort(x[:common])
            both = minhash.signs(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 160)
            agree.append((both[0] == both[1]).mean())
        assert abs(np.mean(agree) - common / size) < most
