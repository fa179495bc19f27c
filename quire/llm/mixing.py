"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length per source. Whole passes over a source come first; what is left of its budget
is fitted on the counts alone: every length gives its share, longest lengths fill up to a bounded rest, and a
bounded knapsack over that rest finds the lengths that use it up. Documents of a length are then taken in the order
of a seeded hash, as many as the fit says, by ranks within hash buckets and counts of the buckets before.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import order_id, save

WORD = r"[^\x20\x09-\x0D]+"


def targets(sources: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """Adds ``number`` (place by code point, null last) and ``target`` to one row per (source, source_size).

    Weights repeat along the sources. All targets make up the sum of sizes; none exceeds ``most`` times its source's
    size, and what is cut off is shared by weight among the others. A source is cut if it would be above at the level
    at which all sources with a lower ceiling are cut: sorted by ceiling over weight, the cut ones come first.
    """
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    cycle = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.col("number") - 1, F.lit(len(weights))) + 1).cast("int"))
    table = sources.withColumn("number", number).withColumn("weight", cycle).withColumn("ceiling", F.lit(float(most)) * F.col("source_size"))
    order = Window.orderBy(F.col("ceiling") / F.col("weight"), "number")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    table = table.withColumn("rest", F.sum("source_size").over(whole) - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0))).withColumn("open", F.sum("weight").over(after))
    table = table.withColumn("level", F.col("rest") / F.col("open")).withColumn("cut", F.col("level") * F.col("weight") > F.col("ceiling"))
    level = F.min(F.when(~F.col("cut"), F.struct(F.col("ceiling") / F.col("weight"), "number", "level"))).over(whole)["level"]
    return table.withColumn("target", F.when(F.col("cut"), F.col("ceiling")).otherwise(level * F.col("weight"))).select("source", "number", "source_size", "target")


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int = 1 << 16) -> np.ndarray:
    """How many documents of each length to take so that their lengths sum to ``budget`` or just below it."""
    lengths, counts = [int(x) for x in lengths], [int(x) for x in counts]
    total = sum(x * c for x, c in zip(lengths, counts))
    if budget >= total:
        return np.array(counts, np.int64)
    take = [c * budget // total if x else 0 for x, c in zip(lengths, counts)]
    left = budget - sum(x * t for x, t in zip(lengths, take))
    order = sorted((i for i in range(len(lengths)) if lengths[i] > 0), key=lambda i: -lengths[i])
    for i in order:
        if left <= window:
            break
        more = min(counts[i] - take[i], (left - window) // lengths[i] + 1, left // lengths[i])
        take[i] += more
        left -= more * lengths[i]
    # Bounded knapsack: spare documents of a length enter in powers of two; each sum remembers who reached it first.
    reached = np.zeros(left + 1, bool)
    reached[0] = True
    by = np.full(left + 1, -1, np.int64)
    items: list[tuple[int, int]] = []
    for i in order:
        spare, part = min(counts[i] - take[i], left // lengths[i]), 1
        while spare > 0 and not reached[left]:
            n = min(part, spare)
            weight = n * lengths[i]
            fresh = ~reached
            fresh[weight:] &= reached[:len(reached) - weight]
            fresh[:weight] = False
            by[fresh] = len(items)
            reached |= fresh
            items.append((i, n))
            spare, part = spare - n, part * 2
        if reached[left]:
            break
    at = int(np.flatnonzero(reached)[-1])
    while at:
        i, n = items[by[at]]
        take[i] += n
        at -= n * lengths[i]
    return np.array(take, np.int64)


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3, seed: int = 17, window: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row of ``docs``: its id, ``text_hash``, ``source``, ``size`` (words), ``source_size``, ``target`` and ``times`` it is taken.

    Each source's taken words come as near below its target as its documents' lengths allow once whole passes and
    the greedy fill have left a rest of about ``window`` words. A null or empty text has size 0 and is taken as often
    as the source has whole passes; a null source is a source of its own. Equal rows are ranked among themselves, so
    that reruns agree on how many are taken. An empty table gives an empty one.
    """
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    rows = save(docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(source_col).cast("string").alias("source"), size.alias("size")), "sizes")
    lengths = save(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "lengths")
    totals = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    aims = save(targets(totals, weights, most).withColumn("passes", F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(F.lit(0)).cast("long")), "targets")
    counted = lengths.join(aims, lengths["source"].eqNullSafe(aims["source"])).select("number", "source_size", "target", "passes", "size", "n")

    def fitted(part: pd.DataFrame) -> pd.DataFrame:
        one = part.iloc[0]
        budget = 0 if one["passes"] >= most else int(round(one["target"] - one["passes"] * one["source_size"]))
        part = part.sort_values("size", kind="stable")
        return pd.DataFrame({"number": part["number"], "size": part["size"], "n": part["n"], "take": fit(part["size"].to_numpy(), part["n"].to_numpy(), budget, window)})

    plan = save(counted.groupBy("number").applyInPandas(fitted, "number int, size long, n long, take long"), "plan")
    named = rows.join(aims, rows["source"].eqNullSafe(aims["source"])).drop(aims["source"])
    chosen = named.join(plan, ["number", "size"]).withColumn("draw", F.xxhash64(F.lit(seed), "id", "text_hash"))
    chosen = chosen.withColumn("bucket", F.floor((F.col("draw") / F.lit(2.0**64) + 0.5) * F.ceil(F.col("n") / 256)))
    chosen = save(chosen.drop("n"), "drawn")
    key = ["number", "size", "bucket"]
    sums = chosen.groupBy(*key).agg(F.count("*").alias("in_bucket"))
    before = F.coalesce(F.sum("in_bucket").over(Window.partitionBy("number", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = save(sums.select(*key, before.alias("before")), "offsets")
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("draw", order_id("id"), "text_hash"))
    picked = (rank + F.col("before") <= F.col("take")).cast("long")
    out = chosen.join(offsets, key).withColumn("times", F.col("passes") + picked)
    return out.select(F.col("id").alias(id_col), "text_hash", "source", "size", "source_size", "target", "times")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them (none: gone), columns as they are."""
    source_col = how.get("source_col", "source")
    counts = mix(docs, id_col=id_col, text_col=text_col, **how).groupBy(order_id(id_col).alias("__i"), F.col("text_hash").alias("__h"), F.coalesce(F.col("source"), F.lit("")).alias("__s"), F.col("source").isNull().alias("__n"))
    counts = save(counts.agg(F.sum("times").alias("__t"), F.count("*").alias("__c")), "times")
    source = F.col(source_col).cast("string")
    keys = ["__i", "__h", "__s", "__n"]
    own = docs.withColumns({"__i": order_id(id_col), "__h": F.xxhash64(text_col), "__s": F.coalesce(source, F.lit("")), "__n": source.isNull()}).join(counts, keys)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))
    times = F.floor(F.col("__t") / F.col("__c")) + (place <= F.col("__t") % F.col("__c")).cast("long")
    return own.withColumn("__times", times).where("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times")))).select(*docs.columns)
