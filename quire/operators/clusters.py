"""Boxes that overlap, directly or through others, become one; the merged box may then reach more."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.geometry import box
from quire.plans.spatial import band_join
from quire.session import checkpoint


def cluster_boxes(boxes: DataFrame, keys: list[str], ident: str, pad: float = 0.0) -> DataFrame:
    """(keys, cluster, x, y, w, h, boxes): repeated until no two clusters touch within ``pad``.

    In a round boxes that touch are joined in stars: a box goes to a touching one that has no smaller neighbour, else,
    where a coin says so, to one of the other side of the coin. Boxes of one id become their common box. So pairs and
    stars merge at once, and of a chain a quarter is gone each round: rounds grow with the logarithm of the longest
    chain. Every round is checkpointed; the smallest id names the cluster.
    """
    state = checkpoint(boxes.select(*keys, F.col(ident).alias("cluster"), F.col(ident).alias("_least"), "x", "y", "w", "h", F.lit(1).cast("long").alias("boxes")))
    for turn in itertools.count():
        span = (F.col("y") - pad, F.col("y") + F.col("h") + pad)
        touching = (F.col("cluster") > F.col("r_cluster")) & box().touches(box("r_"), pad)
        pairs = band_join(state, state.select(*keys, "cluster", "x", "y", "w", "h"), keys, span, (F.col("y"), F.col("y") + F.col("h")), touching)
        links = checkpoint(pairs.select(*keys, "cluster", F.col("r_cluster").alias("other")).distinct())
        if links.isEmpty():
            return state.select(*keys, F.col("_least").alias("cluster"), "x", "y", "w", "h", "boxes")
        inner = links.select(*keys, F.col("cluster").alias("other")).distinct().withColumn("_inner", F.lit(True))
        both = links.unionByName(links.select(*keys, F.col("other").alias("cluster"), F.col("cluster").alias("other"))).join(inner, [*keys, "other"], "left")
        coin = lambda c: F.pmod(F.xxhash64(F.lit(turn), *keys, c), F.lit(2))  # noqa: E731,B023
        root = F.col("_inner").isNull() & (F.col("other") < F.col("cluster"))
        hook = F.when(root, F.struct(F.lit(0), F.col("other").alias("to"))).when((coin("cluster") == 0) & (coin("other") == 1), F.struct(F.lit(1), F.col("other").alias("to")))
        to = both.groupBy(*keys, "cluster").agg(F.min(hook)["to"].alias("_to"))
        moved = state.join(to, [*keys, "cluster"], "left").withColumn("cluster", F.coalesce("_to", "cluster"))
        b = box()
        merged = moved.groupBy(*keys, "cluster").agg(
            F.min("_least").alias("_least"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(b.right).alias("_r"), F.max(b.bottom).alias("_b"), F.sum("boxes").alias("boxes"))
        state = checkpoint(merged.select(*keys, "cluster", "_least", "x", "y", (F.col("_r") - F.col("x")).alias("w"), (F.col("_b") - F.col("y")).alias("h"), "boxes"))
