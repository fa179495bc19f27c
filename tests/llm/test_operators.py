"""The operators against brute force on a small corpus of odd cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from conftest_corpus import WORD, words

from quire.llm import kd_shards, kneser_ney, mixing, pivot_search, quality_rules, simhash, substring_dedup, suffix_dedup
from quire.llm.components import components

BIG = 2**63 - 1


def plain(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=str)


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def without_repeats(rows, depth):
    first = {}
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - depth + 1):
            k = tuple(w[p:p + depth])
            first[k] = min(first.get(k, BIG), BIG if i is None else i)
    want = []
    for i, t in rows:
        w, gone = words(t), set()
        for p in range(len(w) - depth + 1):
            if first[tuple(w[p:p + depth])] < (BIG if i is None else i):
                gone.update(range(p, p + depth))
        want.append((i, " ".join(x for j, x in enumerate(w) if j not in gone), len(w), len(gone)))
    return sorted(want, key=str)


def without_repeated_bytes(rows, depth):
    rows = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[p:p + depth] for _, t in rows for p in range(len(t) - depth + 1))
    want = []
    for i, t in rows:
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - depth + 1):
            if seen[t[p:p + depth]] > 1:
                gone[p:p + depth] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        want.append((i, bytes(x for x, g in zip(t, gone) if not g), len(t), int(gone.sum()), spans))
    return sorted(want, key=str)


def bytes_left(cut):
    return sorted(((r["doc_id"], bytes(r["kept"]), r["n_bytes"], r["n_removed"], r["n_spans"]) for r in cut.collect()), key=str)


@pytest.mark.parametrize("depth", [50, 7])
def test_substring_dedup(docs, none, depth):
    cut = substring_dedup.drop_repeats(docs, depth)
    assert set(cut.columns) == {*docs.columns, "n_removed"}
    assert plain(cut, "doc_id", "text", "n_words", "n_removed") == without_repeats(rows_of(docs), depth)
    assert substring_dedup.drop_repeats(none, depth).count() == 0


@pytest.mark.parametrize("depth", [200, 9])
def test_suffix_dedup(docs, none, depth):
    assert bytes_left(suffix_dedup.drop_repeated_bytes(docs, depth)) == without_repeated_bytes(rows_of(docs), depth)
    assert suffix_dedup.drop_repeated_bytes(none, depth).count() == 0


def test_many_rows_without_ids_or_of_one_id(spark):
    """Passages of rows with ids stand, in parts and in full, in rows without ids and rows of one id, some of them equal."""
    rng = np.random.default_rng(8)
    passages = [" ".join(map(str, rng.integers(0, 10**6, 30))) for _ in range(12)]

    def text():
        taken = [passages[k].split()[slice(*sorted(rng.integers(0, 31, 2)))] if rng.random() < 0.5 else passages[k].split() for k in rng.integers(0, 12, 2)]
        return " ".join([str(rng.integers(0, 10**6)), *taken[0], str(rng.integers(0, 10**6)), *taken[1]])

    rows = [(i, text()) for i in range(10)] + [(None, text()) for _ in range(30)] + [(7, text()) for _ in range(30)]
    rows += [(i, t) for i, t in rows[-40:-20]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert plain(substring_dedup.drop_repeats(df, 10), "doc_id", "text", "n_words", "n_removed") == without_repeats(rows, 10)
    assert bytes_left(suffix_dedup.drop_repeated_bytes(df, 60, 20)) == without_repeated_bytes(rows, 60)


def by_hand(text, size=3):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i:i + size]) for i in range(len(w) - size + 1)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(prints, linked):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if linked(a, b):
                root[find(a)] = find(b)
    return {p: find(p) for p in prints}


def test_simhash(docs, none):
    rows = [(i, by_hand(t)) for i, t in rows_of(docs)]
    root = reach(sorted({p for _, p in rows}), lambda a, b: (a ^ b).bit_count() <= 3)
    least = defaultdict(lambda: BIG)
    for i, p in rows:
        least[root[p]] = min(least[root[p]], BIG if i is None else i)
    want = sorted(((i, p, least[root[p]]) for i, p in rows), key=str)
    got = simhash.near_duplicates(docs)
    assert sorted(((r["doc_id"], r["fingerprint"] % 2**64, r["component_id"]) for r in got.collect()), key=str) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    # One of the copies, one of the near copies, and no text of its own is lost; shorter texts are their only shingle.
    assert not {6, 7} & ids and not ids & set(range(100, 240)) and {3, 4, 5, 10, 14, 15, 17} <= ids
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


@pytest.mark.parametrize("radius", [1, 3, 5, 12])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    a = rng.integers(0, 2**64, 300, dtype=np.uint64)
    b = np.concatenate([a[:200] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (rng.integers(1, 20), 200)).astype(np.uint64), axis=0), a[:11]])
    got = np.unpackbits(simhash.near(a, simhash.planes(b), radius).view(np.uint8), axis=1, bitorder="little")[:, :len(b)]
    assert (got.astype(bool) == (np.bitwise_count(a[:, None] ^ b) <= radius)).all()


def test_chunked_buckets_keep_links(spark):
    """A bucket dealt into many chunks gives the same components as one task would."""
    rng = np.random.default_rng(1)
    prints = [0]
    for _ in range(400):
        prints.append(prints[int(rng.integers(0, len(prints)))] ^ (1 << int(rng.integers(0, 38))) ^ (1 << int(rng.integers(0, 38))))
    prints = sorted(set(prints))
    root = reach(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    links = simhash.links(spark.createDataFrame([(p,) for p in prints], "fingerprint long"), chunk=16)
    named = {r["node"]: r["root"] for r in components(links).collect()}
    groups = lambda f: sorted(sorted(p for p in prints if f(p) == r) for r in {f(p) for p in prints})
    assert groups(lambda p: named.get(p, p)) == groups(root.get)


@pytest.mark.parametrize("how", [{}, {"chunk": 16, "words": 4000}])
def test_near_copies_are_exact(spark, how):
    """Texts link at a similarity of 0.8 or more and never below, in one unit or chunk by chunk."""
    rng = np.random.default_rng(8)
    rows = []
    for family in range(30):
        base = [f"{family}w{i}" for i in range(int(rng.integers(60, 300)))]
        rows.append(" ".join(base))
        for part in rng.uniform(0.0, 0.12, 12):
            made = [f"{w}x{rng.integers(9)}" if rng.random() < part else w for w in base]
            rows.append(" ".join(made[:int(len(made) * rng.uniform(0.8, 1))]))
    # Four and three common shingles of five: at 0.8 and just below it.
    rows += ["a b c d e f g h", "a b c d e f g h i", "k l m n o p q", "k l m n o p q r", "w " * 90, "w " * 9, "W w w w", "", None]
    sets = [{tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} if w else set() for w in (words((t or "").lower()) for t in rows)]
    alike = lambda i, j: 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    root, least = reach(range(len(rows)), alike), {}
    for i in range(len(rows)):
        least.setdefault(root[i], i)
    got = simhash.near_copies(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), **how)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {i: least[r] for i, r in root.items()}


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 300)], "a long, b long")
    assert {(r["node"], r["root"]) for r in components(chain).collect()} == {(i, 1) for i in range(2, 301)}
    assert components(chain.where("false")).count() == 0


def counted(t):
    t = t or ""
    w = words(t)
    three = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if three[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_quality_features_and_rules(spark, docs, none):
    rows = rows_of(docs)
    labels = spark.createDataFrame([(100 + i, 1, 0) for i in range(40)] + [(16, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_rules.judged(docs, labels)
    base = list(quality_rules.BASE)
    assert plain(got, "doc_id", *base) == sorted(((i, *counted(t)) for i, t in rows), key=str)
    for r in got.collect():
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == got.where("kept").count()
    assert quality_rules.judged(none, labels).count() == 0
    assert quality_rules.judged(docs, labels.where("false")).where("kept = base_failed").count() == 0


def test_learned_list_on_held_out_labels(spark):
    """Most bad documents of one half are found by the list of the other half; good ones stay."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = quality_rules.judged(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id")
    seen = {(r["quality"], r["kept"]): r["count"] for r in got.where("NOT base_failed").groupBy("quality", "kept").count().collect()}
    assert seen.get((0, False), 0) >= 0.9 * (seen.get((0, False), 0) + seen.get((0, True), 0))
    assert seen.get((1, False), 0) <= 0.01 * seen[(1, True)]


def test_perplexity_is_the_model_by_hand(spark, docs, none):
    rows = rows_of(docs)
    framed = lambda t: ["<s>", *(x.lower() if x.isascii() else x for x in words(t)), "</s>"]
    trusted = [t for i, t in rows if i and i % 2]
    pairs = Counter(p for t in trusted for p in zip(framed(t), framed(t)[1:]))

    def discounts(counts):
        n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
        if min(n) == 0:
            return [0.5, 0.75, 0.9]
        y = n[0] / (n[0] + 2 * n[1])
        return [min(max(k + 1 - (k + 2) * y * n[k + 1] / n[k], 0), k + 1) for k in range(3)]

    total, taken, before = Counter(), Counter(), Counter()
    d2 = discounts(pairs.values())
    for (v, w), c in pairs.items():
        total[v] += c
        taken[v] += d2[min(c, 3) - 1]
        before[w] += 1
    d1 = discounts(before.values())
    unknown = sum(d1[min(c, 3) - 1] for c in before.values()) / sum(before.values()) / (len(before) + 1)
    single = lambda w: (max(before[w] - d1[min(before[w], 3) - 1], 0) / sum(before.values()) if w in before else 0) + unknown

    def both(v, w):
        c = pairs.get((v, w), 0)
        return single(w) if v not in total else (max(c - d2[min(c, 3) - 1], 0) / total[v] if c else 0) + taken[v] / total[v] * single(w)

    assert sum(both("<s>", w) for w in before) + taken["<s>"] / total["<s>"] * unknown == pytest.approx(1)
    own = docs.selectExpr("xxhash64(doc_id, text) AS row", "text", "doc_id")
    got = kneser_ney.perplexities(own.select("row", "text"), own.where("doc_id % 2 = 1"), shards=3, frequent=20).join(own, "row").collect()
    assert len(got) == len(rows)
    for r in got:
        w = framed(r["text"])
        assert r["perplexity"] == pytest.approx(math.exp(-sum(math.log(both(a, b)) for a, b in zip(w, w[1:])) / (len(w) - 1)))
    labels = spark.createDataFrame([(5, 1, 0), (6, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    assert kneser_ney.judged(docs, labels, shards=2).count() == len(rows)
    assert kneser_ney.judged(docs, labels.where("false"), shards=2).where("NOT kept").count() == 0
    assert kneser_ney.judged(none, labels, shards=2).count() == 0


def test_shards(spark, docs, none):
    rows = rows_of(docs)
    got = kd_shards.shard(docs).collect()
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=str)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert kd_shards.shard(none).count() == 0
    again = lambda df: sorted(map(str, df.collect()))
    assert again(kd_shards.shard(docs)) == again(kd_shards.shard(docs.repartition(3)))


def test_shards_balance_and_keep_copies(spark):
    """Shards differ by little; copies stay together, but for a group too large for any shard."""
    rows = [(i, "x" * (i * 7919 % 900 + 1) + str(i), "en", f"s{i % 5}") for i in range(4000)] + [(5000 + i, "copy" * 100, "en", "hot") for i in range(3000)] + [(9000 + i, "few" * 50, "de", "s1") for i in range(30)]
    got = kd_shards.shard(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    size, where = Counter(), defaultdict(set)
    for r in got:
        size[r["shard"]] += r["size"]
        where[r["text_crc32"]].add(r["shard"])
    mean = sum(size.values()) / 8
    assert len(size) == 8 and max(abs(s - mean) for s in size.values()) < 0.02 * mean
    assert [c for c, s in where.items() if len(s) > 1] == [zlib.crc32(b"copy" * 100)]


def test_mixing(docs, none):
    rows = [(r["doc_id"], len(words(r["text"])), r["source"]) for r in docs.collect()]
    size = Counter()
    for _, n, s in rows:
        size[s] += n
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target = {s: 0.0 for s in order}
    rest, left = float(sum(size.values())), set(order)
    while rest > 1e-9 and left:
        share = rest / sum(weight[s] for s in left)
        for s in left:
            target[s] += share * weight[s]
        rest = sum(max(0, target[s] - 3 * size[s]) for s in left)
        full = {s for s in left if target[s] >= 3 * size[s]}
        for s in full:
            target[s] = 3 * size[s]
        left -= full
    got = mixing.mix(docs).collect()
    assert Counter((r["doc_id"], r["size"], r["source"]) for r in got) == Counter(rows)
    taken = Counter()
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == size[r["source"]] and 0 <= r["times"] <= 3
        taken[r["source"]] += r["times"] * r["size"]
    longest = {s: max(n for _, n, x in rows if x == s) for s in order}
    assert all(target[s] - longest[s] - 1 <= taken[s] <= target[s] + 1 for s in order)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(2)).collect()))
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and sum(len(words(r["text"])) for r in out.collect()) == sum(taken.values())
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0


@pytest.mark.parametrize("budget", [0, 1, 17, 1000, 5003, 10**6])
def test_knapsack_uses_the_budget_up(budget):
    lengths, counts = np.array([0, 3, 7, 50, 400]), np.array([9, 2, 40, 30, 5])
    take = mixing.fit(lengths, counts, budget, window=256)
    assert (take <= counts).all() and (take >= 0).all()
    used = int((take * lengths).sum())
    best = {0}
    for x, c in zip(lengths, counts):
        best = {b + k * int(x) for b in best for k in range(int(c) + 1) if b + k * x <= budget}
    assert used == max(best)


def test_pivot_search(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist(), 1) for i in range(700)] + [(800 + i, [0.5] * 8, 2) for i in range(300)] + [(i, None, 0) for i in (1200, 1300)]
    rows += [(1400, [1.0, None] * 4, 0), (1401, [float("nan")] * 8, 0), (1402, [float("inf")] * 8, 0), (1500, [0.0] * 8, 0), (1600, [2.0, 1.0], 0), (None, [9.0] * 8, 0), (801, [0.25] * 8, 2), (1700, [], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    clean = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int)) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    clean = [(i, np.append(v, np.zeros(8 - len(v), int))) for i, v in clean]
    want = []
    for q, v in clean:
        if q % 100 == 0:
            best = sorted((-int(v @ x), i) for i, x in clean if i != q)[:10]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert plain(pivot_search.top_k(df), "query_id", "rank", "vec_id", "score") == sorted(want, key=str)
    assert pivot_search.top_k(df.where("false")).count() == 0
    assert plain(pivot_search.top_k(df.where("vec_id IN (100, 3)")), "query_id", "rank", "vec_id")[0] == (100, 1, 3)


def test_digests(spark):
    """The queries' digests are those of the kept words and bytes."""
    from quire.llm.queries import QUERIES

    row = QUERIES["op1_substring_dedup"](spark, "/root/testdata/sf0.001").where("n_removed = 0").first()
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(f"doc_id = {row['doc_id']}").first()["text"]
    assert row["kept_sha256"] == hashlib.sha256(" ".join(words(text)).encode()).hexdigest()


def test_frequent_words_and_pairs_are_neither_asked_for_nor_lost(spark):
    """Texts whose words and pairs are all in the bounded tables send their two sums; with small tables they score the same."""
    texts = ["a b a b c", "b a b", "c c a b", "", "a"]
    rows = spark.createDataFrame([(n * 7919 - 9000, t) for n, t in enumerate(texts)], "row long, text string")
    model = kneser_ney.Model(rows.select("text"), 6, 1000)
    asked = [r for shard in range(6) for r in kneser_ney._asked(rows, model, shard).collect()]
    assert sorted(r.key for r in asked) == sorted(k for n in range(len(texts)) for k in (n * 7919 - 9000, ~(n * 7919 - 9000)))
    scores = [{r.row: (r.n_tokens, round(r.log_prob, 9)) for r in kneser_ney.perplexities(rows, rows, shards=6, frequent=n).collect()} for n in (1000, 3, 0)]
    assert scores[0] == scores[1] == scores[2] and len(scores[0]) == len(texts)


def test_a_shard_reads_the_pairs_of_its_own_table(spark):
    rows = spark.createDataFrame([(n, f"w{n} w{n + 1} x w{n % 7}") for n in range(60)], "row long, text string")
    model = kneser_ney.Model(rows.select("text"), 6, 4)
    files = [set(t.inputFiles()) for t in model.turns]
    for shard in range(6):
        read = {f for f in model.entries(shard).inputFiles() if "/pairs-" in f or "-pairs-" in f}
        assert read == files[shard % 2]
    wanted = model.turns[0].union(model.turns[1]).selectExpr("xxhash64(v, w)").union(model.single.select("key")).collect()
    assert sorted(r.key for shard in range(6) for r in model.entries(shard).collect()) == sorted(r[0] for r in wanted)


def test_words_are_told_apart_by_all_their_bytes(spark):
    """Equal words in any case and place have one value, others not; a pair's shard is the same for numpy and Spark."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from quire.llm import rolling

    stem = "abcdefgh" * 12
    own = [stem[:n] for n in range(1, 97)] + [stem[:n] + "\0" for n in range(1, 97)] + [stem[:n - 1] + "é" for n in range(1, 97)] + ["É", "[", "{", "@", "`"]
    block = next(rolling.texts(pa.array([" ".join(own), "\t".join(reversed([w.upper().replace("É", "é") if "é" in w else w if w in "É[{@`" else w.upper() for w in own])), "", None])))
    tokens, bounds = kneser_ney._words(block)
    assert bounds.tolist() == [0, len(own), 2 * len(own), 2 * len(own), 2 * len(own)]
    assert tokens[:len(own)].tolist() == tokens[len(own):][::-1].tolist() and len(set(tokens.tolist())) == len(own)
    _, _, v, w = kneser_ney._pairs(block)
    assert len(v) == len(w) == 2 * len(own) + 4 and (v[1:len(own) + 1] == tokens[:len(own)]).all() and v[len(own) + 1] == kneser_ney.START and w[len(own)] == w[-1] == kneser_ney.END
    crossed = kneser_ney._crossed(v, w)
    table = spark.createDataFrame([(int(x),) for x in crossed.view(np.int64)], "x long")
    assert [r[0] for r in table.select(kneser_ney._shard(F.col("x"), 12)).collect()] == kneser_ney._shard_of(crossed, 12).tolist()


def test_contexts_and_words_are_joined_once_per_table_of_pairs(spark, monkeypatch):
    rows = spark.createDataFrame([(n, f"w{n} w{n + 1} x w{n % 7}") for n in range(60)], "row long, text string")
    made = []
    monkeypatch.setattr(kneser_ney, "save", lambda df, name, *by, save=kneser_ney.save: made.append(name) or save(df, name, *by))
    kneser_ney.perplexities(rows, rows, shards=6, frequent=4).count()
    assert made.count("pairs") == made.count("entries") == 2 and made.count("sums") == 6


def test_a_worker_gives_back_what_it_kept_once_a_task_ends(monkeypatch):
    from quire.llm import common, rolling

    told = []
    monkeypatch.setattr(common, "_trim", lambda: told.append(1))
    assert list(common.released(lambda batches: batches)(iter([1, 2, 3]))) == [1, 2, 3] and told == [1]
    monkeypatch.setattr(rolling, "_powers", {})
    assert len(rolling.powers(10)) == 10 and rolling._powers["base"].nbytes <= 1 << 19
