"""Links between sets that share a bucket and are alike enough, confirmed on the whole sets.

A bucket's sets are first held against its smallest one: edges in the shape of a star, as many as the bucket has sets. What
these links leave apart is compared in full: buckets whose other sets are in more than one component are dealt into
units, equal buckets once, and only sets of different components are held against each other. So every two sets of a bucket
are compared or in one component, and no pairs are written down. Large stars and large buckets are split over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import rolling
from quire.llm.common import discard, released, save
from quire.llm.components import components

U64 = np.uint64
#: Members of a star's part; sets and set elements of a chunk whose units are compared as a whole.
SPLIT, CHUNK, WORDS = 4096, 2048, 1 << 20
#: Rows, of some 32 bytes, of a table that may be sent to every task.
SENT = 1 << 21
LINKS = "a long, b long"


def shingle_sets(block: rolling.Texts, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text's word shingles, sorted, and each text's bounds among them.

    A-Z become lower case; a text with fewer words has its whole sequence as the one shingle, one without words none.
    """
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    tokens, bounds = rolling.word_tokens(block._replace(data=lower[block.data]))
    n = np.maximum(np.diff(bounds) - shingle + 1, np.minimum(np.diff(bounds), 1))
    at = rolling.ranges(bounds[:-1], n)
    doc = np.repeat(np.arange(len(n)), n)
    hashes = rolling.Slices(tokens).at(at, np.minimum(at + shingle, bounds[1:][doc]))
    hashes = hashes[np.lexsort((hashes, doc))]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[first], np.searchsorted(doc[first], np.arange(len(n) + 1))


def shapes(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each whole set; zero for an empty one."""
    n = np.diff(bounds)
    out = np.zeros(len(n), U64)
    if len(hashes):
        out[n > 0] = rolling.mix(np.add.reduceat(rolling.mix(hashes + U64(1)), bounds[:-1][n > 0]) + n[n > 0].astype(U64))
    return out


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list<long> column as its values and each row's bounds among them."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0]:offsets[-1]].view(U64), offsets.astype(np.int64) - offsets[0]


def _stars(share: Fraction):
    """Walks sorted rows (center, part, member, shape, set), a center before its members; links those alike enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        center = np.zeros(0, U64)
        for batch in batches:
            names, parts, members, shape = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            values, bounds = _lists(batch.column(4))
            sizes = np.diff(bounds)
            alike = np.zeros(len(names), bool)
            first = np.flatnonzero(np.append(True, (names[1:] != names[:-1]) | (parts[1:] != parts[:-1]))) if len(names) else []
            for lo, hi in zip(first, [*first[1:], len(names)]):
                if not members[lo]:
                    center = values[bounds[lo]:bounds[lo + 1]].copy()
                    lo += 1
                if lo == hi:
                    continue
                mine = values[bounds[lo]:bounds[hi]]
                at = np.searchsorted(center, mine)
                at[at == len(center)] = 0
                shared = np.add.reduceat((center[at] == mine).astype(np.int64), bounds[lo:hi] - bounds[lo])
                alike[lo:hi] = share.denominator * shared >= share.numerator * (sizes[lo:hi] + len(center) - shared)
            yield pa.RecordBatch.from_arrays([pa.array(shape[alike]), pa.array(names[alike])], names=["a", "b"])

    return run


def joined(sets: list[np.ndarray], roots: np.ndarray, share: Fraction) -> tuple[list[int], list[int]]:
    """Links (by number) that, with the components known (``roots``), join all sets of a likeness of ``share`` or more.

    What is reached is held against everything not reached so far; sets of one component are reached together.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    bounds = np.append(0, np.cumsum(sizes))
    names, words = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(roots, kind="stable")
    kin = np.split(order, np.flatnonzero(np.diff(roots[order])) + 1)
    own = {int(roots[k[0]]): k for k in kin}
    has, unseen = np.zeros(len(names), bool), np.ones(n, bool)
    a, b = [], []
    for start in range(n):
        if not unseen[start]:
            continue
        frontier = own[int(roots[start])].tolist()
        unseen[frontier] = False
        while frontier:
            i = frontier.pop()
            met = np.flatnonzero(unseen)
            met = met[share.numerator * np.maximum(sizes[met], sizes[i]) <= share.denominator * np.minimum(sizes[met], sizes[i])]
            if not len(met):
                continue
            mine = words[bounds[i]:bounds[i + 1]]
            has[mine] = True
            shared = np.add.reduceat(has[words[rolling.ranges(bounds[met], sizes[met])]].astype(np.int64), np.cumsum(sizes[met]) - sizes[met])
            has[mine] = False
            for j in met[share.denominator * shared >= share.numerator * (sizes[met] + sizes[i] - shared)].tolist():
                if unseen[j]:
                    a.append(j)
                    b.append(i)
                    more = own[int(roots[j])]
                    unseen[more] = False
                    frontier += more.tolist()
    return a, b


def _units(share: Fraction):
    """Walks sorted units of rows (unit, shape, root, set); links their shapes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, roots, sets, found = [], [], [], ([], [])
        last = None

        def done() -> None:
            for out, numbers in zip(found, joined(sets, np.array(roots), share)):
                out.extend(shape[i] for i in numbers)
            for x in (shape, roots, sets):
                x.clear()

        for batch in batches:
            unit, names, root = (batch.column(i).to_pylist() for i in range(3))
            values, bounds = _lists(batch.column(3))
            for i in range(len(unit)):
                if unit[i] != last and shape:
                    done()
                last = unit[i]
                shape.append(names[i])
                roots.append(root[i])
                sets.append(values[bounds[i]:bounds[i + 1]].copy())
            if len(found[0]) >= CHUNK:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b"])
                found = ([], [])
        if shape:
            done()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b"])

    return run


def _sent(table: DataFrame) -> DataFrame:
    """A written table, sent to every task if it has few enough rows: the other side then stays where it lies."""
    return F.broadcast(table) if table.count() <= SENT else table


def links(buckets: DataFrame, shapes: DataFrame, sets: DataFrame, share: Fraction, chunk: int = CHUNK, words: int = WORDS) -> DataFrame:
    """Links (a, b) that join all sets which share a bucket and whose Jaccard similarity is at least ``share``.

    ``buckets`` has rows (key, shape), ``shapes`` one row (shape, row, size) per shape, ``sets`` rows (row, set array<long> in
    unsigned order), more than the shapes' own perhaps. Only sets that share a bucket are read on.
    """
    crowded = save(buckets.groupBy("key").agg(F.count("*").alias("n"), F.min("shape").alias("center")).where("n > 1"), "crowded")
    members = save(buckets.join(_sent(crowded), "key").where("shape <> center"), "members")
    edges = save(members.select("shape", "center").distinct(), "edges")
    wanted = shapes.join(edges.select("shape").union(edges.select("center")).distinct(), "shape", "left_semi")
    wanted = save(wanted, "wanted")
    whole = save(sets.join(_sent(wanted), "row").select("shape", "size", "set"), "wanted_sets")
    parts = edges.groupBy("center").agg(F.ceil(F.count("*") / SPLIT).alias("parts")).where("parts > 1")
    pairs = edges.join(parts, "center", "left").withColumn("part", F.pmod(F.xxhash64("shape"), F.coalesce("parts", F.lit(1).cast("long")))).drop("parts")
    pairs = save(pairs, "pairs")
    asked = whole.join(_sent(pairs), "shape").select("center", "part", F.lit(True).alias("member"), "shape", "set")
    own = whole.select(F.col("shape").alias("center"), "set")
    heads = save(pairs.select("center", "part").distinct(), "heads")
    centers = own.join(_sent(heads), "center").select("center", "part", F.lit(False).alias("member"), F.col("center").alias("shape"), "set")
    stars = asked.union(centers).repartition("center", "part").sortWithinPartitions("center", "part", "member")
    linked = save(stars.mapInArrow(released(_stars(share)), LINKS), "linked")

    found = components(linked)
    rest = members.where("n > 2").join(found.select(F.col("node").alias("shape"), "root"), "shape", "left").join(whole.select("shape", "size"), "shape")
    rest = save(rest.select("key", "shape", "size", F.coalesce("root", "shape").alias("root")), "rest")
    apart = rest.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("words"), F.min("root").alias("least"), F.max("root").alias("most"), F.bit_xor("shape").alias("x"), F.bit_xor(F.xxhash64("shape")).alias("y")).where("least < most")
    # Buckets of the same sets are compared once.
    apart = apart.groupBy("n", "words", "x", "y").agg(F.min("key").alias("key"))
    apart = save(apart.select("key", F.greatest(F.ceil(F.col("n") / chunk), F.ceil(F.col("words") / words)).alias("chunks")), "apart")
    units = save(dealt(rest.join(_sent(apart), "key").drop("size"), "key", "shape"), "units")
    met = whole.join(_sent(units), "shape").select("unit", "shape", "root", "set").repartition("unit").sortWithinPartitions("unit", "shape")
    out = save(linked.union(met.mapInArrow(released(_units(share)), LINKS)), "set_links")
    discard(crowded, members, edges, wanted, whole, pairs, heads, linked, found, rest, apart, units)
    return out


def dealt(members: DataFrame, group: str, node: str) -> DataFrame:
    """Each group's rows dealt into ``chunks`` that meet two by two; a unit is what a task compares as a whole."""
    columns = [c for c in members.columns if c not in (group, "n", "chunks")]
    members = members.withColumn("own", F.pmod(F.xxhash64(F.lit(1), node), "chunks"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    # Two chunks that meet are compared as a whole, each with itself too.
    unit = F.when(F.col("chunks") == 1, F.col(group)).otherwise(F.xxhash64(group, F.least("own", "other"), F.greatest("own", "other")))
    return members.where("chunks = 1 OR own <> other").select(unit.alias("unit"), *columns)
