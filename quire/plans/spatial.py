"""Joins of boxes that never compare all pairs of a page.

Both sides are cut into horizontal bands and meet on (page, band), so even a page with very many boxes
is spread over tasks and compares neighbours only. A pair sharing several bands is kept in the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BAND = 200.0


def held(df: DataFrame) -> DataFrame:
    """The side of a join that a task holds while the other passes: it takes little room beside it."""
    return df.hint("shuffle_hash")


def band_join(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[Column, Column], right_span: tuple[Column, Column], condition, band: float = BAND, few: str | None = None) -> DataFrame:
    """Pairs of the same ``keys`` whose vertical spans share a band and for which ``condition`` holds.

    The right side's columns come out prefixed with ``r_``; ``condition`` is an expression over both.
    Spans must cover every pair the condition can accept (widen them by its tolerance). ``few`` names the side (left or
    right) that has few boxes a page: a task holds its share of them, and the other side is not sorted.
    """
    def cut(df: DataFrame, span: tuple[Column, Column], first: str) -> DataFrame:
        low, high = F.floor(span[0] / band), F.floor(F.greatest(span[0], span[1]) / band)
        return df.withColumn(first, low).withColumn("_band", F.explode(F.sequence(low, high)))

    l = cut(left, left_span, "_lfirst")
    r = cut(right, right_span, "_rfirst")
    r = r.select(*[F.col(c).alias(f"r_{c}") for c in right.columns], F.col("_rfirst"), F.col("_band").alias("_rband"))
    on = (F.col("_band") == F.col("_rband")) & (F.col("_band") == F.greatest("_lfirst", "_rfirst")) & condition
    for k in keys:
        on = on & (F.col(k) == F.col(f"r_{k}"))
    l, r = (held(side) if few == name else side for name, side in (("left", l), ("right", r)))
    return l.join(r, on).drop("_band", "_rband", "_lfirst", "_rfirst", *[f"r_{k}" for k in keys])
