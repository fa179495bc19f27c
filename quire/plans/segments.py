"""Running values that stay parallel when one key holds a large share of the rows.

A plain window gathers a whole key in one task. Here each key is cut into buckets along its order:
windows run per (key, bucket), one summary row per bucket carries the value across, and the carry is
joined back on (key, bucket). The big side is shuffled once; only summaries meet per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import checkpoint

_COMBINE = {"sum": F.sum, "max": F.max, "min": F.min}


def with_previous(df: DataFrame, keys: list[str], order: list[str], bucket: Column, values: dict[str, tuple[str, Column]]) -> DataFrame:
    """Adds, per name, the value over all earlier rows of the key: its ``sum``, ``max``, ``min`` or ``last``.

    ``bucket`` must not decrease along ``order``. ``order`` must be unique within a key.
    """
    df = df.withColumn("_bucket", bucket)
    for name, (_, expr) in values.items():
        df = df.withColumn(f"_v_{name}", expr)
    local = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)

    def over(kind: str, col: str, window) -> Column:
        # "last" keeps nulls out by boxing the value: a null value is still a value.
        return F.last(col, ignorenulls=True).over(window) if kind == "last" else _COMBINE[kind](col).over(window)

    totals, local_cols, carry_cols, results = [], {}, [], {}
    for name, (kind, _) in values.items():
        col = f"_v_{name}"
        if kind == "last":
            df = df.withColumn(col, F.struct(F.col(col)))
        total = F.max_by(col, F.struct(*order)) if kind == "last" else _COMBINE[kind](col)
        totals.append(total.alias(f"_t_{name}"))
        local_cols[f"_l_{name}"] = over(kind, col, local)
        carry_cols.append(over(kind, f"_t_{name}", across).alias(f"_c_{name}"))
        l, c = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        results[name] = {
            "sum": F.coalesce(l, F.lit(0)) + F.coalesce(c, F.lit(0)),
            "max": F.greatest(l, c),
            "min": F.least(l, c),
            "last": F.coalesce(l, c)[col] if kind == "last" else None,
        }[kind]
    carry = df.groupBy(*keys, "_bucket").agg(*totals).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bucket").alias("_k_bucket"), *carry_cols)
    run = df.withColumns(local_cols)
    condition = F.col("_bucket").eqNullSafe(F.col("_k_bucket"))
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = run.join(carry, condition, "left").withColumns(results)
    return out.drop(*[c for c in out.columns if c.startswith(("_v_", "_l_", "_c_", "_k_"))], "_bucket")


def islands(df: DataFrame, keys: list[str], order: list[str], bucket: Column, starts: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows: a row where ``starts`` is true begins a new one (from 1)."""
    marked = df.withColumn("_s", starts.cast("long"))
    out = with_previous(marked, keys, order, bucket, {"_n": ("sum", F.col("_s"))})
    return out.withColumn(name, F.col("_n") + F.col("_s")).drop("_n", "_s")


def merge_ranges(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", span: int = 4096) -> DataFrame:
    """Ranges of a key that overlap or touch become one."""
    # Two carried passes read the ranges twice each; they are written once instead of found four times.
    distinct = checkpoint(df.groupBy(*keys, start).agg(F.max(end).alias(end)))
    bucket = F.floor(F.col(start) / span)
    seen = with_previous(distinct, keys, [start], bucket, {"_reach": ("max", F.col(end))})
    fresh = F.col("_reach").isNull() | (F.col(start) > F.col("_reach"))
    numbered = islands(seen.withColumn("_fresh", fresh).drop("_reach"), keys, [start], bucket, F.col("_fresh"))
    return numbered.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island")
