"""SimHash near-duplicates by bit-sliced comparison.

Distinct fingerprints meet in tables keyed by several of their parts: of ``radius + 2`` parts at most ``radius``
can differ, so that two fingerprints within the radius agree in a pair of parts, for every choice of where they
differ. A bucket too large for one task is dealt into chunks that meet chunk by chunk. Within a task the
fingerprints stand as bit planes; a word operation updates 64 distances at once in carry-save counters, and a
block is left as soon as all its distances exceed the radius. Tasks report a spanning forest, never all pairs.

Near copies by a share of common shingles are proposed by fingerprints and by bands of least hashes, and link only
where the exact share is reached (``set_links``).
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import minhash, rolling
from quire.llm.common import LAST, discard, map_batches, order_id, released, save
from quire.llm.components import components
from quire.llm.set_links import dealt

U64 = np.uint64
#: Fingerprints of a bucket that are compared in one go, and small buckets that are put together.
CHUNK, TOGETHER = 4096, 512


def fingerprint(words: list[bytes], shingle: int) -> int:
    if not words:
        return 0
    size = min(shingle, len(words))
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[:len(words) - size + 1].tolist()
    ends = (ends[size - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(text[a:b], 42) for a, b in zip(starts, ends)], U64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view(U64)[0])


def prints(block: rolling.Texts, shingle: int) -> np.ndarray:
    """The fingerprint of every text of the block, as a long."""
    data = block.data.tobytes().lower()
    return np.array([fingerprint(data[a:b].split(), shingle) for a, b in zip(block.bounds[:-1], block.bounds[1:])], U64).view(np.int64)


def fingerprints(docs: DataFrame, shingle: int = 3, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """Adds the 64-bit SimHash of a text's word shingles, as a long.

    A-Z become lower case; words are ``[^\\x20\\x09-\\x0D]+``; shingles count as often as they occur; a bit is set
    if it is in over half their XXH64 values (seed 42). With fewer words the whole sequence is the one shingle;
    without words (null, empty) the fingerprint is zero.
    """
    columns = [c for c in docs.columns if c != name]
    place = columns.index(text_col)

    def rule(batch: pa.RecordBatch) -> dict:
        made = [np.zeros(0, np.int64), *(prints(block, shingle) for block in rolling.texts(batch.column(place)))]
        return {c: batch.column(i) for i, c in enumerate(columns)} | {name: np.concatenate(made)}

    schema = T.StructType([*(f for f in docs.schema.fields if f.name in columns), T.StructField(name, T.LongType())])
    return map_batches(docs.select(*columns), rule, schema)


def planes(prints: np.ndarray) -> np.ndarray:
    """64 rows, one per bit; a column of 64 fingerprints is one word."""
    padded = np.zeros((len(prints) + 63) // 64 * 64, U64)
    padded[:len(prints)] = prints
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(U64)


def near(queries: np.ndarray, vertical: np.ndarray, radius: int) -> np.ndarray:
    """Per query, the bits of the fingerprints within ``radius``.

    The counters are bit planes of the distances so far. Two planes of differences enter at a time through a
    full adder; what is carried past the last counter marks distances that can't come back.
    """
    levels = radius.bit_length()
    flipped = np.where((queries[:, None] >> np.arange(64, dtype=U64)) & U64(1), ~U64(0), U64(0))
    counters = [np.zeros((len(queries), vertical.shape[1]), U64) for _ in range(levels)]
    beyond = np.zeros_like(counters[0])

    def add(carry: np.ndarray, level: int) -> None:
        for c in counters[level:]:
            carry, c[...] = c & carry, c ^ carry
        np.bitwise_or(beyond, carry, out=beyond)

    for bit in range(0, 64, 2):
        x = vertical[bit] ^ flipped[:, bit, None]
        y = vertical[bit + 1] ^ flipped[:, bit + 1, None]
        either = x ^ y
        carry = (x & y) | (counters[0] & either)
        counters[0] ^= either
        add(carry, 1)
        if bit % 16 == 14 and (beyond == ~U64(0)).all():
            return np.zeros_like(beyond)
    # Distances below 2**levels remain; those over the radius differ first in a bit that the radius lacks.
    over, same = np.zeros_like(beyond), ~np.zeros_like(beyond)
    for level in reversed(range(levels)):
        if radius >> level & 1:
            same &= counters[level]
        else:
            over |= same & counters[level]
            same &= ~counters[level]
    return ~(beyond | over)


def forest(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, representative) links that join everything within the radius."""
    n = len(prints)
    vertical = planes(prints)
    tile = max(1, (1 << 19) // max(64, n))
    rows = [near(prints[i:i + tile], vertical, radius) for i in range(0, n, tile)]
    rows = np.concatenate(rows)
    unseen = np.packbits(np.arange(vertical.shape[1] * 64) < n, bitorder="little").view(U64)
    node, root = [], []
    for start in range(n):
        if not unseen[start >> 6] >> U64(start & 63) & U64(1):
            continue
        unseen[start >> 6] &= ~(U64(1) << U64(start & 63))
        frontier = np.array([start])
        while len(frontier):
            reach = np.bitwise_or.reduce(rows[frontier], axis=0) & unseen
            unseen &= ~reach
            frontier = np.flatnonzero(np.unpackbits(reach.view(np.uint8), bitorder="little"))
            node.append(frontier)
            root.append(np.full(len(frontier), start))
    if not node:
        return prints[:0], prints[:0]
    return prints[np.concatenate(node)], prints[np.concatenate(root)]


def _walk(radius: int):
    """Walks sorted units (unit, fingerprint), small ones together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, last = 0, None

        def linked() -> pa.RecordBatch:
            a, b = forest(np.unique(np.concatenate(held)), radius)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            unit, prints = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(U64)
            starts = np.flatnonzero(np.append(True, unit[1:] != unit[:-1])) if len(unit) else []
            for lo, hi in zip(starts, [*starts[1:], len(unit)]):
                if unit[lo] != last and size >= TOGETHER:
                    yield linked()
                    size = 0
                held.append(prints[lo:hi])
                size, last = size + hi - lo, unit[lo]
        if held:
            yield linked()

    return run


def links(prints: DataFrame, radius: int = 3, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints (column ``fingerprint``) within ``radius`` bits of each other."""
    parts = radius + 2
    width = -(-64 // parts)
    value = F.col("fingerprint")
    part = [F.shiftrightunsigned(value, i * width).bitwiseAND(F.lit((1 << min(width, 64 - i * width)) - 1)) for i in range(parts)]
    keys = [F.lit(n << 2 * width) + F.shiftleft(part[i], width) + part[j] for n, (i, j) in enumerate(combinations(range(parts), 2))]
    tables = prints.select("fingerprint", F.explode(F.array(*keys)).alias("key"))
    return _met(tables, chunk).mapInArrow(released(_walk(radius)), "a long, b long")


def _met(tables: DataFrame, chunk: int) -> DataFrame:
    """Rows (key, fingerprint) of keys that several rows share, dealt into units that are compared as a whole."""
    crowded = save(tables.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "crowded")
    members = tables.join(crowded, "key").withColumn("chunks", F.ceil(F.col("n") / chunk))
    return dealt(members, "key", "fingerprint").repartition("unit").sortWithinPartitions("unit")


def _grouped(rows: DataFrame, linked, node: str = "fingerprint") -> DataFrame:
    """Rows (id, ``node``, …) with the root and the smallest id of their component."""
    distinct = save(rows.groupBy(node).agg(F.min(order_id("id")).alias("least")), "distinct")
    roots = components(linked(distinct))
    named = distinct.join(roots.select(F.col("node").alias(node), "root"), node, "left").withColumn("root", F.coalesce("root", node))
    named = save(named, "named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(save(named.join(least, "root").select(node, "root", "component_id"), "groups"), node)


def near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, ``text_hash`` (XXH64 of the text), ``fingerprint``, ``root`` (of the component: its
    smallest fingerprint) and ``component_id``.

    Fingerprints link at ``radius`` or fewer differing bits; a component holds what links reach, and is named by its
    smallest id. Equal fingerprints are one node, however many documents have them. A null id comes after every
    other and names a component only where all ids are null (then null). Repeated rows stay rows; an empty table
    gives an empty one.
    """
    ids = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    rows = save(fingerprints(ids, shingle).drop("text"), "fingerprints")
    out = _grouped(rows, lambda prints: links(prints, radius))
    return out.select(F.col("id").alias(id_col), "text_hash", "fingerprint", "root", F.nullif("component_id", F.lit(LAST)).alias("component_id"))


def near_copies(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, radius: int = 3, bands: int = 28, rows: int = 4, id_col: str = "doc_id", text_col: str = "text", **units: int) -> DataFrame:
    """Per row: its id, ``text_hash``, ``shape`` (a hash of the text's set of word shingles), ``root`` (of the
    component: one of its shapes) and ``component_id``, as in ``near_duplicates``.

    Shapes link if the exact Jaccard similarity of their sets is at least ``similarity``. Fingerprints that links of
    ``radius`` bits join, and equal bands of least hashes, only propose what is compared; a pair at 0.8 shares none of
    28 bands in 4 of ten million cases. Texts without words are one shape.
    """
    ids = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    own = save(minhash.sets(ids, shingle, bands, rows, fingerprint=lambda block: prints(block, shingle)), "sets")
    narrow = save(own.select("id", "text_hash", "shape"), "rows")

    def alike(chosen: DataFrame) -> DataFrame:
        marked = chosen.select("fingerprint", "shape")
        near = components(links(marked.select("fingerprint").distinct(), radius)).withColumnsRenamed({"node": "fingerprint", "root": "near"})
        return marked.join(near, "fingerprint", "left").select(F.xxhash64(F.lit("near"), F.coalesce("near", "fingerprint")).alias("key"), "shape")

    named = minhash.grouped(own, Fraction(str(similarity)), alike, empty=True, **units)
    discard(own)
    out = narrow.join(named, "shape")
    return out.select(F.col("id").alias(id_col), "text_hash", "shape", "root", F.nullif("component_id", F.lit(LAST)).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` with one of each component of near copies: the smallest id, then the smallest text hash; of equal rows one."""
    rows = near_copies(docs, id_col=id_col, text_col=text_col, **how)
    keys = save(rows.groupBy(order_id(id_col).alias("__i"), F.col("text_hash").alias("__h")).agg(F.min("root").alias("root"), F.count("*").alias("n")), "keys")
    first = keys.groupBy("root").agg(F.min(F.struct("__i", "__h")).alias("first")).select("first.*")
    gone = save(keys.join(first, ["__i", "__h"], "left_anti").select("__i", "__h"), "gone")
    several = save(keys.where("n > 1").join(gone, ["__i", "__h"], "left_anti").select("__i", "__h"), "several")
    own = docs.withColumn("__i", order_id(id_col)).withColumn("__h", F.xxhash64(text_col))
    kept = own.join(gone, ["__i", "__h"], "left_anti")
    # Whole rows are only compared where an id and text come more than once.
    once = kept.join(several, ["__i", "__h"], "left_anti")
    return once.union(kept.join(several, ["__i", "__h"], "left_semi").dropDuplicates(["__i", "__h"]).select(once.columns)).drop("__i", "__h")
