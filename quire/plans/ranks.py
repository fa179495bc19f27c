"""Exact order statistics per group without gathering a group.

Values are first combined into (group, value, count). Approximate quantiles of each group cut them into
buckets of similar weight; bucket totals tell which bucket holds a wanted rank; only that bucket's
values are ordered. A group of any size costs its distinct values once and one bucket's sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import checkpoint

CUTS = 64
#: Distinct values that one task orders; what holds more is cut into buckets first, again and again.
ORDERED = 1 << 18


def order_statistics(df: DataFrame, by: list[str], value: str, ranks: dict[str, Column], weight: str | None = None, ordered: int = ORDERED) -> DataFrame:
    """One row per group: ``n`` and, per name, the value at a 0-based rank given as an expression of ``n``.

    ``weight`` names a column that says how often a row counts. A group, or a wanted rank's bucket, is cut only while one of
    them holds more than ``ordered`` distinct values.
    """
    # Cuts, totals and the wanted buckets all read the counted values: written once.
    rows = checkpoint(df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_value")).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_count")))
    sizes = rows.groupBy(*by).agg(F.sum("_count").alias("n"))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("_name"), rank.cast("long").alias("_rest")) for name, rank in ranks.items()])).alias("w")
    targets, named = sizes.select(*by, "n", wanted).select(*by, "n", "w.*"), [*by, "_name"]
    if _most(rows, by) <= ordered:
        inside = with_keys(rows, targets, by)
    else:
        inside = checkpoint(_bucket_of_rank(rows, targets, by, by))
        while _most(inside, named) > ordered:
            inside = checkpoint(_bucket_of_rank(inside.drop("n", "_rest"), inside.select(*by, "n", "_name", "_rest").distinct(), named, named))
    upto = F.sum("_count").over(Window.partitionBy(*by, "_name").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0))
    found = inside.withColumn("_upto", upto).filter((F.col("_rest") < F.col("_upto")) & (F.col("_rest") >= F.col("_upto") - F.col("_count")))
    picks = [F.max(F.when(F.col("_name") == name, F.col("_value"))).alias(name) for name in ranks]
    return found.groupBy(*by).agg(F.max("n").alias("n"), *picks)


def _most(rows: DataFrame, keys: list[str]) -> int:
    """The number of values of the largest group."""
    return rows.groupBy(*keys).agg(F.count("*").alias("_values")).agg(F.max("_values")).first()[0] or 0


def _bucket_of_rank(rows: DataFrame, wanted: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The rows (keys, _value, _count) of the bucket that holds each wanted rank, with n, _name and the rank inside it.

    A bucket holds the values between two approximate quantiles of its group.
    """
    fractions = F.array(*[F.lit(i / CUTS) for i in range(1, CUTS)])
    cuts = rows.groupBy(*keys).agg(F.percentile_approx("_value", fractions, 1000).alias("_cuts"))
    bucketed = with_keys(rows, cuts, keys).withColumn("_bucket", F.size(F.filter("_cuts", lambda c: c < F.col("_value")))).drop("_cuts")
    totals = bucketed.groupBy(*keys, "_bucket").agg(F.sum("_count").alias("_total"))
    before = F.coalesce(F.sum("_total").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    targets = with_keys(totals.select(*keys, "_bucket", "_total", before.alias("_before")), wanted, by)
    targets = targets.filter((F.col("_rest") >= F.col("_before")) & (F.col("_rest") < F.col("_before") + F.col("_total")))
    more = [c for c in wanted.columns if c not in (*keys, "_rest")]
    return with_keys(bucketed, targets.select(*keys, "_bucket", *more, (F.col("_rest") - F.col("_before")).alias("_rest")), [*keys, "_bucket"]).drop("_bucket")


def with_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joined on keys that may be null: null meets null."""
    if not keys:  # the whole table is one group, and right is its one row
        one = F.lit(1).alias("_one")
        return left.select("*", one).join(right.select("*", one), "_one").drop("_one")
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])



def upper_median(df: DataFrame, by: list[str], value: str, name: str = "upper_median") -> DataFrame:
    """The middle value, of two middles the larger (not their mean)."""
    return order_statistics(df, by, value, {name: F.floor(F.col("n") / 2)})


def median(df: DataFrame, by: list[str], value: str, name: str = "median", weight: str | None = None) -> DataFrame:
    """The true median, mean of two middles."""
    out = order_statistics(df, by, value, {"_lo": F.floor((F.col("n") - 1) / 2), "_hi": F.floor(F.col("n") / 2)}, weight)
    return out.select(*by, "n", ((F.col("_lo") + F.col("_hi")) / 2).alias(name))
