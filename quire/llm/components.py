"""Connected components of a link table by alternating star contraction, every round written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import discard, save


def _both_ways(links: DataFrame) -> DataFrame:
    return links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = _both_ways(links)
    least = save(both.groupBy("a").agg(F.min("b").alias("least")), "large_star")
    out = save(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("a", "least").alias("b")).distinct(), "links")
    discard(least)
    return out


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = save(down.groupBy("a").agg(F.min("b").alias("least")), "small_star")
    moved = down.join(least, "a").where("b > least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    out = save(moved.union(least.select("a", F.col("least").alias("b"))).distinct(), "links")
    discard(least)
    return out


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a long, b long) that isn't the smallest of its component.

    Rounds go on until the links stay as they are; their number grows with the logarithm of the longest chain.
    """
    links = save(links.where("a <> b").distinct(), "links")
    state = _state(links)
    while state[0]:
        large = _large_star(links)
        small = _small_star(large)
        discard(links, large)
        links = small
        after = _state(links)
        if after == state:
            break
        state = after
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
