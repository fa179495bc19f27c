"""Exact top-k inner products through a pivot-distance index.

The largest inner products are the smallest distances once every vector has a further component that makes all
norms equal. Vectors are keyed by their nearest pivot and their distance to it; a pivot's cell is cut into annuli of
distances, and a large annulus into parts. A query q at distance d from a pivot can be no nearer to an annulus
[r0, r1] than max(r0 - d, d - r1, 0). Each query first visits the annuli with the best bounds until they hold enough
vectors; the k-th score found is then its threshold, and the other annuli are visited only while their bound
reaches it (equal bounds too, since ties go by id). Annuli and the queries that visit them meet as blocks: a task
multiplies one part with one chunk of queries and reports k rows per query. Every vector is indexed; nothing is
approximate: bounds are widened by more than rounding, scores are integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import map_batches, save

#: Vectors the pivots are chosen from, pivots, annuli per pivot, rows of a part and queries of a chunk.
SAMPLE, PIVOTS, ANNULI, PART, CHUNK = 1024, 32, 16, 2048, 2048


def scaled(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 1024) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of each component; vectors that are null or hold null, NaN or infinity are left out."""
    values = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    bad = F.exists(F.col("x"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(F.col("x"), lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), values.alias("x")).where(F.col("x").isNotNull() & ~bad).select("vec_id", whole.alias("v"))


def _matrix(column: pa.Array, width: int, dtype=np.int64) -> np.ndarray:
    """Rows of a list column; shorter ones end in zeros."""
    lengths = np.asarray(pc.list_value_length(column))
    values = pc.list_flatten(column).to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), width), dtype)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def _choose(sample: np.ndarray, count: int) -> np.ndarray:
    """Pivots far from each other: each next one is the sampled vector farthest from all chosen."""
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(sample)) and far.max() > 0:
        chosen.append(int(np.argmax(far)))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (points ** 2).sum(axis=1)[:, None] + (pivots ** 2).sum(axis=1) - 2 * points @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """Per query (rows whose id is divisible by ``every``): its ``k`` highest inner products with all other rows.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller id. Fewer candidates give fewer rows. A null
    id is no query and no candidate; missing components of shorter vectors count as zero. Rows that repeat an id are
    candidates each, but never of a query of their own id; a repeated query id keeps its smallest vector. No vectors
    give no rows.
    """
    spark = vectors.sparkSession
    points = save(scaled(vectors, id_col, vector_col, scale).where("vec_id IS NOT NULL").withColumn("norm", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), "vectors")
    known = points.agg(F.max(F.size("v")), F.max("norm"), F.max(F.array_max(F.transform("v", F.abs)))).first()
    width, largest = max(1, known[0] or 0), known[1] or 0.0
    exact = (known[2] or 0) ** 2 * width < 2**52

    def lifted(v: np.ndarray) -> np.ndarray:
        x = v.astype(np.float64)
        return np.concatenate([x, np.sqrt(np.maximum(largest - (x ** 2).sum(axis=1), 0))[:, None]], axis=1)

    few = points.orderBy(F.xxhash64(F.lit(7), "vec_id"), "vec_id").limit(SAMPLE).select("v").collect()
    if not few:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample = np.zeros((len(few), width), np.int64)
    for i, r in enumerate(few):
        sample[i, :len(r["v"])] = r["v"]
    pivots = _choose(lifted(sample), PIVOTS)

    def keyed(batch: pa.RecordBatch) -> dict:
        far = _distances(lifted(_matrix(batch.column(1), width)), pivots)
        pivot = far.argmin(axis=1)
        return {"vec_id": batch.column(0), "v": batch.column(1), "pivot": pivot, "distance": far[np.arange(len(pivot)), pivot]}

    cells = save(map_batches(points.select("vec_id", "v"), keyed, "vec_id long, v array<long>, pivot int, distance double"), "cells")
    marks = [i / ANNULI for i in range(1, ANNULI)]
    cuts = {r["pivot"]: r["cuts"] for r in cells.groupBy("pivot").agg(F.percentile_approx("distance", marks, 1000).alias("cuts")).collect()}  # PIVOTS rows
    bounds = F.element_at(F.create_map(*[x for p, c in cuts.items() for x in (F.lit(p), F.array(*map(F.lit, c)))]), F.col("pivot"))
    cells = cells.withColumn("annulus", F.size(F.filter(bounds, lambda c: c < F.col("distance"))))
    shape = cells.groupBy("pivot", "annulus").agg(F.min("distance").alias("r0"), F.max("distance").alias("r1"), F.count("*").alias("n")).orderBy("pivot", "annulus").collect()  # PIVOTS * ANNULI rows
    key = {(r["pivot"], r["annulus"]): i for i, r in enumerate(shape)}
    at, r0, r1, held = (np.array([r[c] for r in shape]) for c in ("pivot", "r0", "r1", "n"))
    parts = np.maximum(1, -(-held // PART))
    place = F.element_at(F.create_map(*[x for (p, a), i in key.items() for x in (F.lit(p * ANNULI + a), F.lit(i))]), F.col("pivot") * ANNULI + F.col("annulus"))
    n_parts = F.element_at(F.array(*[F.lit(int(p)) for p in parts]), F.col("ring") + 1)
    index = save(cells.withColumn("ring", place).select("ring", F.pmod(F.xxhash64("vec_id"), n_parts).cast("int").alias("part"), "vec_id", "v"), "index")

    queries = points.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    queries = save(queries, "queries")
    chunks = max(1, -(-queries.count() // CHUNK))
    slack = 1e-6 * (1 + largest)

    def visits(first: bool):
        """Rings a query visits: at first the best until they hold k vectors besides itself; later the rest that may reach its k-th score."""
        def rule(batch: pa.RecordBatch) -> dict:
            q = _matrix(batch.column(1), width).astype(np.float64)
            far = _distances(np.concatenate([q, np.zeros((len(q), 1))], axis=1), pivots)[:, at]
            near = np.maximum(np.maximum(r0 - far, far - r1), 0)
            best = ((q ** 2).sum(axis=1)[:, None] + largest - near ** 2) / 2 + slack
            order = np.argsort(-best, axis=1, kind="stable")
            counts = np.cumsum(held[order], axis=1) - held[order]
            early = np.zeros(best.shape, bool)
            np.put_along_axis(early, order, counts < 4 * k + 1, axis=1)
            take = early if first else ~early & (best >= batch.column(2).to_numpy(zero_copy_only=False)[:, None])
            row, ring = np.nonzero(take)
            number = parts[ring]
            row, ring = np.repeat(row, number), np.repeat(ring, number)
            part = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
            return {"query_id": batch.column(0).take(pa.array(row)), "v": batch.column(1).take(pa.array(row)), "ring": ring, "part": part}

        return rule

    def found(asked: DataFrame) -> DataFrame:
        """The k best of every (query, part) that meet."""
        asked = asked.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int"))
        met = save(asked.select("ring", "part", "chunk").distinct(), "met")
        blocks = index.join(met, ["ring", "part"])

        shape = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

        def multiply(a: pa.Table, b: pa.Table) -> pa.Table:
            if not len(a) or not len(b):
                return shape.empty_table()
            made = []
            kind = np.float64 if exact else np.int64
            ids, qids = a["vec_id"].to_numpy(), b["query_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            x = _matrix(a["v"].combine_chunks(), width, kind)[order]
            q = _matrix(b["v"].combine_chunks(), width, kind)
            for lo in range(0, len(q), 256):
                scores = (q[lo:lo + 256] @ x.T).astype(np.int64)
                own = qids[lo:lo + 256, None] == ids
                best = np.argsort(np.where(own, np.iinfo(np.int64).max, -scores), axis=1, kind="stable")[:, :k]
                row = np.repeat(np.arange(len(best)), best.shape[1])
                col = best.ravel()
                keep = ~own[row, col]
                row, col = row[keep], col[keep]
                made.append(pa.RecordBatch.from_arrays([pa.array(qids[lo + row]), pa.array(ids[col]), pa.array(scores[row, col])], schema=shape))
            return pa.Table.from_batches(made, shape)

        keys = ["ring", "part", "chunk"]
        return blocks.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(multiply, "query_id long, vec_id long, score long")

    ask = "query_id long, v array<long>, ring int, part int"
    one = save(found(map_batches(queries, visits(True), ask)), "first")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    kth = save(one.withColumn("rank", rank).where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("least")), "kth")
    later = queries.join(kth, "query_id", "left").select("query_id", "v", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
    both = one.union(found(map_batches(later, visits(False), ask)))
    return both.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
