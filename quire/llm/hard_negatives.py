"""Hard-negative mining by slots between the positives' limits.

Every positive of an anchor asks for the highest negatives within a window of scores, and these windows overlap. Their
upper limits cut the scores into disjoint slots, the highest first: a score lies in the slot of the smallest limit it
doesn't exceed. Blocks of rows are scored against chunks of anchors; each task keeps the k best of every slot, and so
does the merge over all blocks. The best below any limit are then the first of its own slot and the ones under it, one
after another, so that one descending list of slots answers every window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import save

#: Numbers in a block of rows, anchors of a chunk, scores computed in one go.
BLOCK, CHUNK, TILE = 1 << 20, 2048, 1 << 20
LOWEST = -(2**62)


def numbered(vectors: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(row, vec_id, label, v array<long>): floor(scale * x) of each component, for rows that take part."""
    values = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    bad = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), values.alias("x"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").where(~bad)
    whole = F.transform("x", lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", whole.alias("v"))


def _dealt(group: str | None, rows: DataFrame, anchors: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides as the cells (part of rows, chunk of anchors) they meet in, within every value of ``group``."""
    keys = [group] if group else [F.lit(0).alias("all")]
    names = [group or "all"]
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / block).alias("parts"))
    chunks = anchors.groupBy(*keys).agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    grid = save(sizes.join(chunks, names), "grid")

    def spread(side: DataFrame, own: str, other: str, value: Column, n: str, others: str) -> DataFrame:
        side = side if group else side.withColumn("all", F.lit(0))
        placed = side.join(grid, names).withColumn(own, F.pmod(F.xxhash64(F.lit(3), value), F.col(n)))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(others) - 1))).drop("parts", "chunks")

    left = spread(rows, "part", "chunk", F.col("row"), "parts", "chunks")
    return left, spread(anchors, "chunk", "part", F.col("anchor_id"), "chunks", "parts")


def _matrix(column: pa.ChunkedArray, width: int, dtype, fill=0) -> np.ndarray:
    column = column.combine_chunks()
    lengths = np.asarray(pc.list_value_length(column))
    out = np.full((len(lengths), width), fill, dtype)
    out[np.arange(width) < lengths[:, None]] = pc.list_flatten(column).to_numpy(zero_copy_only=False)
    return out


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` highest allowed scores of every row; among equals the first columns."""
    n = scores.shape[1]
    if k < n and np.abs(scores).max(initial=0) < 2**61 // n:
        rank = np.where(allowed, scores * n - np.arange(n), np.iinfo(np.int64).min)
        columns = np.argpartition(rank, n - k, axis=1)[:, n - k:]
    else:
        columns = np.argsort(np.where(allowed, -scores, np.iinfo(np.int64).max), axis=1, kind="stable")[:, :k]
    row = np.repeat(np.arange(len(scores)), columns.shape[1])
    column = columns.ravel()
    keep = allowed[row, column]
    return row[keep], column[keep]


def _scored(keys: list[str], rows: DataFrame, anchors: DataFrame, width: int, exact: bool, slots: int, k: int, same: bool) -> DataFrame:
    """(anchor_id, slot, vec_id, label, score): per cell the k best of every anchor's slots.

    ``anchors`` carry ``limits`` and ``floors``, highest first; with ``same`` only equal labels count, else only others.
    """
    kind = np.float64 if exact else np.int64
    shape = pa.schema([("anchor_id", pa.int64()), ("slot", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def multiply(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return shape.empty_table()
        order = np.argsort(a["vec_id"].to_numpy(), kind="stable")
        a = a.take(pa.array(order))
        ids, own = a["vec_id"].to_numpy(), b["anchor_id"].to_numpy()
        names = pa.concat_arrays([a["kind"].combine_chunks(), b["kind"].combine_chunks()]).dictionary_encode().indices.to_numpy()
        x, q = _matrix(a["v"], width, kind), _matrix(b["v"], width, kind)
        limits = np.concatenate([_matrix(b["limits"], slots, np.int64, LOWEST), np.full((len(b), 1), LOWEST)], axis=1)
        floors = _matrix(b["floors"], slots, np.int64, LOWEST)
        made = []
        step = max(1, TILE // len(ids))
        for lo in range(0, len(q), step):
            some = slice(lo, lo + step)
            scores = (q[some] @ x.T).astype(np.int64)
            fits = ((names[:len(ids)] == names[len(ids):][some, None]) == same) & (ids != own[some, None])
            for slot in range(slots):
                inside = fits & (scores <= limits[some, slot, None]) & (scores > limits[some, slot + 1, None]) & (scores >= floors[some, slot, None])
                row, column = best(scores, inside, k)
                made.append(pa.RecordBatch.from_arrays([pa.array(own[lo + row]), pa.array(np.full(len(row), slot, np.int32)), pa.array(ids[column]), pa.array(scores[row, column])], schema=shape))
        return pa.Table.from_batches(made, shape)

    left = rows.select(*keys, "vec_id", F.col("label").alias("kind"), "v")
    right = anchors.select(*keys, "anchor_id", F.col("label").alias("kind"), "v", "limits", "floors")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(multiply, "anchor_id long, slot int, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def mine(vectors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, every: int = 100, scale: int = 256,
         id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per anchor (rows whose id is divisible by ``every``) and positive: the hard negatives.

    Scores are inner products of floor(``scale`` * x); higher ones come first, then smaller ids. An anchor's positives are
    its first ``positives`` other rows of the same label; a positive's negatives are the first ``negatives`` rows of another
    label whose score is from ``low`` to ``high`` hundredths of the positive's. Returns anchor_id, positive_id, rank (from 1),
    negative_id, positive_score, negative_score; a positive without negatives has no rows, nor has an empty table.

    Rows with a null id, label or vector, or with a component that is null, NaN or infinite, take no part. Missing
    components of shorter vectors count as zero. Rows that repeat an id are candidates each, but never for an anchor of their
    own id; a repeated anchor id keeps its smallest label and vector. Further columns are not read. Scores must fit 64 bits.
    """
    points = save(numbered(vectors, scale, id_col, vector_col, label_col), "points")
    known = points.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    width = max(1, known[0] or 0)
    exact = (known[1] or 0) ** 2 * width < 2**52
    block = max(256, BLOCK // width)
    anchors = points.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("anchor_id")).agg(F.min(F.struct("label", "v")).alias("a"))
    anchors = save(anchors.select("anchor_id", "a.label", "a.v"), "anchors")

    # Any score is a positive's: one slot without bounds.
    whole = anchors.withColumns({"limits": F.array(F.lit(2**62)), "floors": F.array(F.lit(LOWEST + 1))})
    rows, asking = _dealt("label", points, whole, block)
    first = _scored(["label", "part", "chunk"], rows, asking, width, exact, 1, positives, True)
    chosen = save(first.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    limit = F.floor(F.lit(high) * F.col("positive_score") / 100) if high != 100 else F.col("positive_score")
    windows = chosen.withColumns({"limit": limit.cast("long"), "floor": F.ceil(F.lit(low) * F.col("positive_score").cast("decimal(38,2)") / 100).cast("long")})
    slots = windows.where("floor <= limit").groupBy("anchor_id", "limit").agg(F.min("floor").alias("floor"))
    slots = slots.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("limit", "floor")), asc=False).alias("s"))
    limited = save(anchors.join(slots.select("anchor_id", F.col("s.limit").alias("limits"), F.col("s.floor").alias("floors")), "anchor_id"), "limited")
    rows, asking = _dealt(None, points, limited, block)
    found = _scored(["part", "chunk"], rows, asking, width, exact, positives, negatives, False)

    # Slots one after another: the highest score first, and within a slot already the best k.
    merged = found.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("down"), F.col("vec_id").alias("id")))).alias("down"))
    fits = F.slice(F.filter("down", lambda n: (-n["down"] <= F.col("limit")) & (-n["down"] >= F.col("floor"))), 1, negatives)
    pairs = windows.join(merged, "anchor_id").select("anchor_id", "positive_id", "positive_score", F.posexplode(fits).alias("i", "n"))
    return pairs.select("anchor_id", "positive_id", (F.col("i") + 1).alias("rank"), F.col("n.id").alias("negative_id"), "positive_score", (-F.col("n.down")).alias("negative_score"))
