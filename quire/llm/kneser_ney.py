"""Quality by perplexity under an interpolated modified Kneser-Ney model of word pairs.

The model counts all trusted text. Its probability of w after v,

    p(w|v) = max(c(vw) - D(c(vw)), 0) / c(v) + g(v) p(w),

is kept as additive entries: one per word, log p(w) + log g(w) (as a target and as the next word's context), and one
per pair seen, log p(w|v) - log g(v) - log p(w). A document's log probability is then a sum over its words and
pairs, whatever is missing adding nothing but the unknown word's share, and it needs no second lookup for back-off.
Counts meet their contexts and words table by table, a few shards of the key space each, and texts their entries shard by
shard: what either needs on disk goes before the next one begins. The
most frequent words' and pairs' entries, two bounded tables, are added in the tasks that read the texts.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import rolling
from quire.llm.common import discard, map_batches, save, signed
from quire.llm.rolling import U64

START, END = U64(0x51A7E5), U64(0xE4D0F5)
#: Bytes of a word that are read eight at a time.
LONG = 64
#: Which bytes of eight belong to a word, by their number.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)
_STEP = U64(0x9E3779B97F4A7C15)


def _words(block: rolling.Texts) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit value per word (A-Z as a-z), and each document's bounds among the words.

    Words are read eight bytes at a time; those of more than ``LONG`` bytes take a hash over prefix sums.
    """
    start, end, bounds = rolling.word_spans(block)
    n = end - start
    data = np.zeros(len(block.data) + 8, np.uint8)
    data[:-8] = block.data
    data += (data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5)  # A-Z
    eight = np.ndarray(len(block.data), "<u8", data, strides=(1,))
    out = rolling.mix((eight[start] & _FIRST[np.minimum(n, 8)]) + n.astype(U64) * _STEP)
    more = np.flatnonzero((n > 8) & (n <= LONG))
    for at in range(8, LONG, 8):
        more = more[n[more] > at]
        if not len(more):
            break
        out[more] = rolling.mix(out[more] * _STEP + (eight[start[more] + at] & _FIRST[np.minimum(n[more] - at, 8)]))
    long = np.flatnonzero(n > LONG)
    if len(long):
        own = rolling.Texts(0, data[rolling.ranges(start[long], n[long])], np.zeros(0, np.int64))
        ends = np.cumsum(n[long])
        out[long] = rolling.Slices(rolling.byte_tokens(own)).at(ends - n[long], ends)
    return out, bounds


def _pairs(block: rolling.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes (A-Z as a-z) and bounds; contexts and targets of all pairs, each document framed by start and end."""
    tokens, bounds = _words(block)
    docs = len(bounds) - 1
    v, w = np.empty((2, len(tokens) + docs), U64)
    at = np.ones(len(v), bool)
    ends = bounds[1:] + np.arange(docs)
    at[ends] = False
    w[at], w[ends] = tokens, END
    v[1:] = w[:-1]
    v[bounds[:-1] + np.arange(docs)] = START
    return tokens, bounds, v, w


def _xxh64(x: np.ndarray, seed: np.ndarray | U64) -> np.ndarray:
    """XXH64 of 64-bit values, as Spark's xxhash64 chains it over columns."""
    p1, p2, p3, p4, p5 = (U64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda a, n: (a << U64(n)) | (a >> U64(64 - n))
    with np.errstate(over="ignore"):
        h = (seed + p5 + U64(8)) ^ (turn(x * p2, 31) * p1)
        h = turn(h, 27) * p1 + p4
        h = (h ^ (h >> U64(33))) * p2
        h = (h ^ (h >> U64(29))) * p3
    return h ^ (h >> U64(32))


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A pair's name: Spark's ``xxhash64(v, w)``."""
    return _xxh64(w, _xxh64(v, U64(42)))


def _shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    """A word's shard by its hash, as ``_shard``."""
    return (key >> U64(32)) * U64(shards) >> U64(32)


def _crossed(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """What chooses a pair's shard: cheaper than its name, which only its shard needs."""
    return v ^ (w >> U64(1))


def _counted(trusted: DataFrame, shard: int, shards: int, of: int) -> DataFrame:
    """Pairs (v, w, n) of the shards, ``of`` in all, whose number leaves ``shard`` by ``shards``."""
    def rule(batch: pa.RecordBatch) -> dict | None:
        out: dict[str, list] = {"v": [], "w": [], "n": []}
        for block in rolling.texts(batch.column(0), 1 << 22):
            _, _, v, w = _pairs(block)
            mine = np.flatnonzero(_shard_of(_crossed(v, w), of) % U64(shards) == U64(shard))
            v, w = v[mine], w[mine]
            _, first, n = np.unique(pair_key(v, w), return_index=True, return_counts=True)
            for name, values in zip(out, (signed(v[first]), signed(w[first]), n)):
                out[name].append(values)
        return {k: np.concatenate(x) for k, x in out.items()} if out["v"] else None

    return map_batches(trusted, rule, "v long, w long, n long").groupBy("v", "w").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> list[float]:
    """D(1), D(2), D(3 and more) from how many entries were seen one to four times; plain values where too few were."""
    r = counts.agg(*[F.count_if(F.col("n") == i).alias(f"n{i}") for i in range(1, 5)]).first()
    n = [r[f"n{i}"] for i in range(1, 5)]
    if min(n) == 0:
        return [0.5, 0.75, 0.9]
    y = n[0] / (n[0] + 2 * n[1])
    found = [i + 1 - (i + 2) * y * n[i + 1] / n[i] for i in range(3)]
    return [min(max(d, 0.0), i + 1.0) for i, d in enumerate(found)]


def _discount(d: list[float]) -> Column:
    return F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])


def _taken(d: list[float]) -> Column:
    """The mass that discounts take from a group's counts."""
    return d[0] * F.count_if(F.col("n") == 1) + d[1] * F.count_if(F.col("n") == 2) + d[2] * F.count_if(F.col("n") > 2)


class Model:
    """Pairs, contexts, words as tables; constants; the most frequent entries as arrays."""

    def __init__(self, trusted: DataFrame, shards: int, frequent: int):
        # A shard's pairs lie in one of the tables, by the remainder of its number.
        turns = next(n for n in range(max(1, shards // 3), 0, -1) if shards % n == 0)
        self.turns, self.shards = [save(_counted(trusted, turn, turns, shards), "pairs") for turn in range(turns)], shards
        pairs = functools.reduce(DataFrame.unionByName, self.turns)
        self.d = _discounts(pairs)
        contexts = pairs.groupBy("v").agg(F.sum("n").alias("total"), _taken(self.d).alias("taken"))
        self.contexts = save(contexts.select("v", "total", (F.col("taken") / F.col("total")).alias("g")), "contexts")
        words = save(pairs.groupBy("w").agg(F.count("*").alias("n")), "words")
        d1 = _discounts(words)
        sums = words.agg(F.sum("n").alias("total"), _taken(d1).alias("taken"), F.count("*").alias("kinds")).first()
        total = sums["total"] or 1
        share = (sums["taken"] or 1.0) / total if sums["kinds"] else 1.0
        self.unknown = share / ((sums["kinds"] or 0) + 1)
        p = F.greatest(F.col("n") - _discount(d1), F.lit(0.0)) / total + self.unknown
        self.words = save(words.select("w", p.alias("p")), "probabilities")
        # An entry per word, relative to an unknown one that is no context.
        single = self.words.join(self.contexts, F.col("w") == F.col("v"), "left")
        single = single.select(F.col("w").alias("key"), (F.log("p") - math.log(self.unknown) + F.coalesce(F.log("g"), F.lit(0.0))).alias("value"), F.coalesce("total", F.lit(0)).alias("total"))
        self.single = save(single, "single")
        top = self.single.where(~F.col("key").isin(*self._marks())).orderBy(F.desc("total"), "key").limit(frequent).select("key", "value").collect()  # bounded by ``frequent``
        start = self.contexts.where(F.col("v") == int(START)).select(F.log("g")).first()
        end = self.words.where(F.col("w") == int(END)).select(F.log("p")).first()
        self.frame = (start[0] if start else 0.0) + (end[0] if end else math.log(self.unknown))
        often = F.broadcast(pairs.orderBy(F.desc("n"), "v", "w").limit(frequent))
        top += self._priced(F.broadcast(self.contexts.join(often, "v")).join(self.words, "w")).collect()  # bounded by ``frequent``
        keys = np.array([r[0] for r in top], np.int64)
        order = np.argsort(keys)
        self.frequent = Frequent(keys[order], np.array([r[1] for r in top], np.float64)[order])

    @staticmethod
    def _marks() -> list[int]:
        return [int(START), int(END)]

    def entries(self, shard: int) -> DataFrame:
        """(key, value) of the shard's pairs and words."""
        return self.turn(shard % len(self.turns)).where(F.col("shard") == shard).drop("shard")

    def turn(self, turn: int) -> DataFrame:
        """(key, value, shard) of the pairs of one table and the words of its shards."""
        mine = self.turns[turn].withColumn("shard", _shard(F.col("v").bitwiseXOR(F.shiftrightunsigned("w", 1)), self.shards))
        pairs = self._priced(mine.join(self.contexts, "v").join(self.words, "w"), "shard")
        words = self.single.select("key", "value", _shard(F.col("key"), self.shards).alias("shard"))
        return pairs.union(words.where(F.col("shard") % len(self.turns) == turn))

    def _priced(self, pairs: DataFrame, *also: str) -> DataFrame:
        """(key, value) of pairs that have met their contexts and words."""
        p = F.greatest(F.col("n") - _discount(self.d), F.lit(0.0)) / F.col("total") + F.col("g") * F.col("p")
        return pairs.select(F.xxhash64("v", "w").alias("key"), (F.log(p) - F.log("g") - F.log("p")).alias("value"), *also)


class Frequent:
    """Sorted keys and their values; most keys that are not among them are told by their first bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        self.begins = np.zeros(1 << 20, bool)
        self.begins[keys.view(U64) >> U64(44)] = True

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``keys`` are there, and their values."""
        at = np.flatnonzero(self.begins[keys >> U64(44)])
        asked = signed(keys[at])
        place = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        there = self.keys[place] == asked if len(at) else np.zeros(0, bool)
        return at[there], self.values[place[there]]


def _shard(key: Column, shards: int) -> Column:
    """The key's shard, by its upper half."""
    return F.shiftright(F.shiftrightunsigned(key, 32) * shards, 32)


def _asked(rows: DataFrame, model: Model, shard: int) -> DataFrame:
    """(key, row, n): a document's keys of the shard and how often each occurs.

    The first shard also has two rows per document that find no entry: under the row itself the number of tokens, under its
    complement the sum of what needs no lookup.
    """
    shards, unknown, frame = model.shards, math.log(model.unknown), model.frame
    sent = rows.sparkSession.sparkContext.broadcast(model.frequent)

    def rule(batch: pa.RecordBatch) -> dict | None:
        ids = batch.column(0).to_numpy()
        frequent = sent.value
        out: dict[str, list] = {"key": [], "row": [], "n": []}

        def put(key: np.ndarray, row: np.ndarray, n: np.ndarray) -> None:
            for name, x in zip(out, (key, row, n)):
                out[name].append(x)

        for block in rolling.texts(batch.column(1)):
            tokens, bounds, v, w = _pairs(block)
            n = np.diff(bounds)
            docs = len(n)
            own = ids[block.first:block.first + docs]
            if shard == 0:
                sums = n * unknown + frame
                for keys, ends in ((tokens, bounds), (pair_key(v, w), bounds + np.arange(docs + 1))):
                    at, value = frequent.find(keys)
                    sums += np.bincount(np.searchsorted(ends, at, side="right") - 1, value, docs)
                put(own, own, n + 1.0)
                put(~own, own, sums)
            words = np.flatnonzero(_shard_of(tokens, shards) == U64(shard))
            pairs = np.flatnonzero(_shard_of(_crossed(v, w), shards) == U64(shard))
            keys = np.concatenate([tokens[words], pair_key(v[pairs], w[pairs])])
            owner = np.concatenate([np.searchsorted(bounds, words, side="right"), np.searchsorted(bounds + np.arange(docs + 1), pairs, side="right")]) - 1
            # What is frequent is in the sums.
            rare = np.ones(len(keys), bool)
            rare[frequent.find(keys)[0]] = False
            keys, owner = keys[rare], owner[rare]
            order = np.lexsort((keys, owner))
            keys, owner = keys[order], owner[order]
            first = np.ones(len(keys), bool)
            first[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
            begin = np.flatnonzero(first)
            put(signed(keys[begin]), own[owner[begin]], np.diff(np.append(begin, len(keys))).astype(np.float64))
        return {k: np.concatenate(x) for k, x in out.items()} if out["key"] else None

    return map_batches(rows, rule, "key long, row long, n double")


def perplexities(docs: DataFrame, trusted: DataFrame, shards: int = 12, frequent: int = 1 << 16, text_col: str = "text", spent: bool = False) -> DataFrame:
    """(row, n_tokens, log_prob, perplexity) per distinct row of ``docs`` (row long, text), under the model of ``trusted`` (text).

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z as a-z; the end of a text counts as a token. A null or empty text has that
    one token. Without trusted text every word is unknown. ``spent`` deletes the saved trusted table as soon as
    it is counted.
    """
    model = Model(trusted.select(text_col), shards, frequent)
    if spent:
        discard(trusted)
    rows = docs.select("row", text_col)
    total = None
    for turn, pairs in enumerate(model.turns):
        entries = save(model.turn(turn), "entries", "shard")
        discard(pairs)
        for shard in range(turn, shards, len(model.turns)):
            own = entries.where(F.col("shard") == shard).drop("shard")
            met = _asked(rows, model, shard).join(own.hint("shuffle_hash"), "key", "left")
            of_row, of_sum = F.col("key") == F.col("row"), F.col("key") == F.bitwise_not("row")
            # What finds no entry adds nothing.
            met = met.where(F.col("value").isNotNull() | of_row | of_sum)
            tokens = F.when(of_row, F.col("n").cast("long")).otherwise(0)
            value = F.when(of_sum, F.col("n")).when(of_row, 0.0).otherwise(F.col("n") * F.col("value"))
            part = save(met.groupBy("row").agg(F.sum(value).alias("log_prob"), F.sum(tokens).alias("n_tokens")), "sums")
            total = part if total is None else total.unionByName(part)
        discard(entries)
    out = total.groupBy("row").agg(F.sum("log_prob").alias("log_prob"), F.sum("n_tokens").alias("n_tokens"))
    return out.withColumn("perplexity", F.exp(-F.col("log_prob") / F.col("n_tokens")))


def judged(docs: DataFrame, labels: DataFrame, quantile: float = 0.995, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **how) -> DataFrame:
    """Per row of ``docs``: its id, language, ``n_tokens``, ``perplexity``, its language's ``threshold``, and ``kept``.

    Trusted are the documents labelled quality 1 and not toxic. Four fifths of them (by a hash of the text, so that
    copies stay together) train the model; a language's threshold is the ``quantile`` of the others' perplexities, which
    the model has not seen. A language without any keeps all. A null language is one of its own; a null id is never
    trusted; equal rows score alike; several labels of one id must all be good. An empty table gives an empty one.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("row"))
    good = labels.where(f"{id_col} IS NOT NULL").groupBy(F.col(id_col).alias("id")).agg(F.min(((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")).alias("good")).where("good = 1").select("id")
    held_out = F.pmod(F.xxhash64(F.lit(11), "text"), F.lit(5)) == 0
    trusted = save(own.join(good, "id", "left_semi").where(~held_out).select("text"), "trusted")
    scored = save(perplexities(own, trusted, text_col="text", spent=True, **how), "scored")
    rows = save(own.withColumn("held_out", held_out).drop("text").join(scored, "row"), "rows")
    bounds = rows.where("held_out").join(good, "id", "left_semi").groupBy("lang").agg(F.percentile_approx("perplexity", quantile, 10000).alias("threshold"))
    bounds = bounds.withColumnRenamed("lang", "of")
    out = rows.join(bounds, F.col("lang").eqNullSafe(F.col("of")), "left")
    kept = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return out.select(F.col("id").alias(id_col), F.col("lang").alias(lang_col), "n_tokens", "perplexity", "threshold", kept.alias("kept"))
