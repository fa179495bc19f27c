"""MinHash near-duplicates by one-permutation hashing with optimal densification.

One hash per shingle serves all bins: its upper part chooses the bin, the least hash of a bin is the bin's sign. An empty
bin takes the sign of another one, found along a random order of bins that is its own and the same for every text, so that
two texts agree in a bin with the chance of their likeness, filled or not. Bands of signs are buckets; within a bucket
sets link along a star, and what stays apart is compared on (``set_links``), always on the whole sets.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import rolling
from quire.llm.common import LAST, discard, map_batches, order_id, save
from quire.llm.components import components
from quire.llm.set_links import links, shapes, shingle_sets

U64 = np.uint64
#: Bands and signs per band; texts whose bins are filled in one go; bytes of text handled in one go.
BANDS, ROWS, TOGETHER, BLOCK = 20, 4, 2048, 1 << 18


@cache
def _orders(bins: int) -> np.ndarray:
    """Per bin, the order in which an empty one asks the others."""
    draw = np.random.Generator(np.random.PCG64(20250311))
    return np.argsort(draw.random((bins, bins)), axis=1)


def signs(hashes: np.ndarray, bounds: np.ndarray, bins: int) -> np.ndarray:
    """Per set (sorted, none empty), the least hash of every bin; empty bins take another's."""
    n = len(bounds) - 1
    doc = np.repeat(np.arange(n), np.diff(bounds))
    place = doc * bins + ((hashes >> U64(32)) * U64(bins) >> U64(32)).astype(np.int64)
    first = np.append(True, place[1:] != place[:-1])
    out, full = np.zeros(n * bins, U64), np.zeros(n * bins, bool)
    out[place[first]] = hashes[first]
    full[place[first]] = True
    empty, order = np.flatnonzero(~full), _orders(bins)
    for turn in range(bins):
        if not len(empty):
            break
        bin_ = empty % bins
        donor = empty - bin_ + order[bin_, turn]
        given = full[donor]
        out[empty[given]] = out[donor[given]]
        empty = empty[~given]
    return out.reshape(n, bins)


def band_keys(hashes: np.ndarray, bounds: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Per set, one key per band of ``rows`` signs."""
    made = [np.zeros((0, bands), U64)]
    for lo in range(0, len(bounds) - 1, TOGETHER):
        some = bounds[lo:lo + TOGETHER + 1]
        own = signs(hashes[some[0]:some[-1]], some - some[0], bands * rows).reshape(-1, bands, rows)
        keys = np.broadcast_to(np.arange(1, bands + 1, dtype=U64), own.shape[:2]).copy()
        for row in range(rows):
            keys = rolling.mix(keys ^ own[:, :, row])
        made.append(keys)
    return np.concatenate(made)


def sets(docs: DataFrame, shingle: int, bands: int, rows: int, text_col: str = "text", **also: Callable[[rolling.Texts], np.ndarray]) -> DataFrame:
    """Turns the text into ``size`` (of a text's set of word shingles), ``shape`` (a hash of the set), ``keys`` (one per band; none for an empty set) and ``set``; ``also`` into further longs."""
    columns = [c for c in docs.columns if c != text_col]
    place = docs.columns.index(text_col)
    places = {c: docs.columns.index(c) for c in columns}

    def rule(batch: pa.RecordBatch) -> dict:
        size, shape, keys, offsets, values = [], [], [], [np.zeros(1, np.int64)], []
        more = {name: [np.zeros(0, np.int64)] for name in also}
        for block in rolling.texts(batch.column(place), BLOCK):
            for name, made in also.items():
                more[name].append(made(block))
            hashes, bounds = shingle_sets(block, shingle)
            n = np.diff(bounds)
            full = n > 0
            size.append(n)
            shape.append(shapes(hashes, bounds).view(np.int64))
            some = iter(band_keys(hashes, np.append(bounds[:-1][full], bounds[-1]), bands, rows).view(np.int64))
            keys += [next(some) if f else [] for f in full]
            offsets.append(offsets[-1][-1] + bounds[1:])
            values.append(hashes.view(np.int64))
        whole = pa.ListArray.from_arrays(pa.array(np.concatenate(offsets), pa.int32()), pa.array(np.concatenate(values) if values else [], pa.int64()))
        out = {c: batch.column(i) for c, i in places.items()}
        return out | {"size": np.concatenate(size or [np.zeros(0, np.int64)]), "shape": np.concatenate(shape or [np.zeros(0, np.int64)]), "keys": pa.array(keys, pa.list_(pa.int64())), "set": whole} | {name: np.concatenate(made) for name, made in more.items()}

    kinds = [T.StructField("size", T.LongType()), T.StructField("shape", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("set", T.ArrayType(T.LongType())), *(T.StructField(name, T.LongType()) for name in also)]
    return map_batches(docs, rule, T.StructType([*(docs.schema[c] for c in columns), *kinds]))


def near_duplicates(docs: DataFrame, similarity: float = 0.85, shingle: int = 5, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", **units: int) -> DataFrame:
    """Per row: its id, ``n_shingles`` (distinct word shingles, A-Z as lower case), ``shape`` (a hash of the set) and ``component_id``.

    Texts link if the exact Jaccard similarity of their sets is at least ``similarity``; a component holds what links reach
    and is named by its smallest id. Texts meet if they agree in one of ``bands`` bands of ``rows`` signs: at 0.85
    all bands differ in 4 of ten million pairs. A text of fewer words is one shingle; without words (null, empty)
    it has none, is linked with nothing and is its own component. A null id comes after every other and names a component
    only where all its ids are null (then null). Repeated rows stay rows; an empty table gives an empty one. Further columns
    are not read. Shingles are named by 64-bit hashes. ``units`` may set ``chunk`` and ``words`` of ``set_links.links``.
    """
    ids = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    own = save(sets(ids, shingle, bands, rows), "sets")
    narrow = save(own.select("id", "size", "shape"), "rows")
    named = grouped(own, Fraction(str(similarity)), **units)
    discard(own)
    component = F.coalesce("component_id", order_id("id"))
    return narrow.join(named, "shape", "left").select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), "shape", F.nullif(component, F.lit(LAST)).alias("component_id"))


def grouped(own: DataFrame, share: Fraction, further: Callable[[DataFrame], DataFrame] | None = None, empty: bool = False, **units: int) -> DataFrame:
    """(shape, root, component_id) of every set: of rows (row, id, size, shape, keys, set) as ``sets`` adds them.

    ``further`` gives more buckets (key, shape) from one row per shape; with ``empty`` the empty set is a shape too, linked with nothing.
    """
    # One row stands for all with its set.
    some = own if empty else own.where("size > 0")
    distinct = save(some.groupBy("shape").agg(F.min("row").alias("row"), F.min(order_id("id")).alias("least")), "distinct")
    chosen = save(own.where("size > 0").drop("id", "set").join(distinct.select("row"), "row", "left_semi"), "chosen")
    buckets = chosen.select(F.explode("keys").alias("key"), "shape")
    if further:
        buckets = buckets.union(further(chosen))
    linked = links(buckets, chosen.select("shape", "row", "size"), own.select("row", "set"), share, **units)
    roots = components(linked)
    named = save(distinct.drop("row").join(roots.withColumnRenamed("node", "shape"), "shape", "left").withColumn("root", F.coalesce("root", "shape")), "named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    out = save(named.join(least, "root").select("shape", "root", "component_id"), "groups")
    discard(distinct, chosen, linked, roots, named)
    return out
