"""Robust profiles of a numeric column: middle values, two-class split, stretch, outliers, change checks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.plans import ranks
from quire.plans.folds import fold_groups
from quire.plans.segments import with_previous
from quire.session import checkpoint

# --- fixed values ---
BINS = 256
OTSU_DEFAULT = 127
LOW_CONTRAST = 110
MIN_SPREAD = 8
MAD_SCALE = 1.4826
MAD_STEPS = 6
MAD_RAISE = 1.3
MAD_SHARE = 0.04
MIN_INSIDE = 30
UNCHANGED_BELOW = 1.5
ROUGH_SHARE = 0.35
ROUGH_TEXTURE = 4
# --------------------


def bin_of(value: Column, low: Column | float, high: Column | float) -> Column:
    """0 to 255 across ``low`` to ``high``; values outside go to the end bins."""
    low, high = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))
    return F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((value - low) / (high - low) * BINS))).cast("int")


def histogram(df: DataFrame, by: list[str], value: str, low: float, high: float) -> DataFrame:
    """(group, bin, n): bins, not rows, are shuffled; at most 256 rows per group come out."""
    rows = df.filter(F.col(value).isNotNull())
    return rows.groupBy(*by, bin_of(F.col(value), low, high).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def otsu_split(df: DataFrame, by: list[str], value: str, low: float = 0, high: float = 256) -> DataFrame:
    """The bin that best separates two classes per group, and how many rows fall up to it."""
    upto = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    h = histogram(df, by, value, low, high).select(
        *by, "bin", F.sum("n").over(upto).alias("wb"), F.sum(F.col("bin") * F.col("n")).over(upto).alias("sb"),
        F.sum("n").over(whole).alias("total"), F.sum(F.col("bin") * F.col("n")).over(whole).alias("sum"))
    wf = (F.col("total") - F.col("wb")).cast("double")
    wb = F.col("wb").cast("double")
    gap = F.col("sb") / wb - (F.col("sum") - F.col("sb")) / F.nullif(wf, F.lit(0.0))
    h = h.withColumn("between", F.coalesce(wb * wf * gap * gap, F.lit(0.0)))
    best = h.groupBy(*by).agg(F.max("total").alias("n"), F.max(F.struct("between", (-F.col("bin")).alias("b"), "wb")).alias("m"))
    some = F.col("m.between") > 0
    return best.select(*by, "n", F.when(some, -F.col("m.b")).otherwise(F.lit(OTSU_DEFAULT)).alias("threshold"), F.when(some, F.col("m.wb")).otherwise(F.col("n")).alias("low_rows"))


def tonal_range(df: DataFrame, by: list[str], value: str, low: float = 0, high: float = 256, shares: tuple[float, float] = (0.01, 0.99)) -> DataFrame:
    """The bins below which the darkest and brightest share of a group falls."""
    upto = F.sum("n").over(Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    h = histogram(df, by, value, low, high).withColumn("seen", upto).withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    cut = lambda share: F.min(F.when(F.col("seen") >= F.col("total") * share, F.col("bin")))
    out = h.groupBy(*by).agg(cut(shares[0]).alias("lo"), cut(shares[1]).alias("hi"))
    return out.withColumn("low_contrast", F.col("hi") - F.col("lo") < LOW_CONTRAST).withColumn("stretch", F.col("hi") - F.col("lo") >= MIN_SPREAD)


def robust_stretch(df: DataFrame, by: list[str], value: str, low: float = 0, high: float = 256) -> DataFrame:
    """Rows with their value stretched so that the group's 1 % and 99 % bins become 0 and 255."""
    spread = tonal_range(df, by, value, low, high)
    scaled = (bin_of(F.col(value), low, high) - F.col("lo")) * (F.lit(255.0) / (F.col("hi") - F.col("lo")))
    level = F.when(F.col("stretch"), F.bround(F.greatest(F.lit(0.0), F.least(F.lit(255.0), scaled)))).otherwise(bin_of(F.col(value), low, high))
    return ranks.with_keys(df, spread, by).withColumn("stretched", level.cast("int")).drop("lo", "hi", "stretch")


def mad_outliers(df: DataFrame, by: list[str], value: str, k: float = 10.0, minimum: float = 40.0) -> DataFrame:
    """Rows above a robust ceiling: median + k times (1.4826 MAD + 1), at least ``minimum``.

    A ceiling that flags more than 4 % of a group is raised by 1.3, up to five times; all six candidates
    are counted in one pass. Rows are read to count each value and to return those above, nothing between needs them.
    """
    values = checkpoint(df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value)).agg(F.count(F.lit(1)).alias("_times")))
    middle = ranks.median(values, by, value, "_median", weight="_times").drop("n")
    spread = ranks.median(ranks.with_keys(values, middle, by).withColumn("_away", F.abs(F.col(value) - F.col("_median"))), by, "_away", "_mad", weight="_times").drop("n")
    base = ranks.with_keys(middle, spread, by).select(*by, "_median", "_mad", F.greatest(F.lit(minimum), F.col("_median") + k * (F.col("_mad") * MAD_SCALE + 1.0)).alias("_floor"))
    candidates = [F.col("_floor") * MAD_RAISE**i for i in range(MAD_STEPS)]
    above = [F.sum(F.when(F.col(value) > c, F.col("_times")).otherwise(0)).alias(f"_c{i}") for i, c in enumerate(candidates)]
    counts = ranks.with_keys(values, base, by).groupBy(*by, "_median", "_mad", "_floor").agg(F.sum("_times").alias("_n"), *above)
    ceiling = candidates[-1]
    for i in range(MAD_STEPS - 2, -1, -1):
        ceiling = F.when(F.col(f"_c{i}") / F.col("_n") <= MAD_SHARE, candidates[i]).otherwise(ceiling)
    chosen = counts.select(*by, F.col("_median").alias("median"), F.col("_mad").alias("mad"), ceiling.alias("ceiling"))
    return ranks.with_keys(df, chosen, by).filter(F.col(value) > F.col("ceiling"))


def change_check(pairs: DataFrame, series: str, order: str, bucket: int = 4096) -> DataFrame:
    """Did a selection change, and is its result as detailed as its surroundings?

    ``pairs`` holds ``before``, ``after``, ``selected`` and ``around`` per position of a series.
    """
    rows = with_previous(pairs, [series], [order], F.floor(F.col(order) / bucket), {"_prev": ("last", F.col("after"))})
    step = F.abs(F.col("after") - F.col("_prev"))
    sums = rows.groupBy(series).agg(
        F.count_if("selected").alias("inside"),
        F.avg(F.when(F.col("selected"), F.abs(F.col("before") - F.col("after")))).alias("change"),
        F.coalesce(F.avg(F.when(F.col("selected"), step)), F.lit(0.0)).alias("detail"),
        F.coalesce(F.avg(F.when(F.col("around"), step)), F.lit(0.0)).alias("detail_around"))
    verdict = (
        F.when(F.col("inside") < MIN_INSIDE, "").when(F.col("change") < UNCHANGED_BELOW, "UNCHANGED")
        .when((F.col("detail_around") > ROUGH_TEXTURE) & (F.col("detail") < F.col("detail_around") * ROUGH_SHARE), "ROUGH_RESULT").otherwise("")
    )
    return sums.withColumn("warning", verdict)


def _clusters(df: DataFrame, by: list[str], value: str, slot: Column, reach, within) -> DataFrame:
    """Distinct values with the first value of their cluster; a value joins a cluster if ``within(start, value)``, up to about ``reach(start)``.

    Where a slot's first cluster begins depends on the slot before, but only through one value: the first it does
    not take over. So each slot, some clusters wide, is walked from every value it could begin with, all slots at once; the
    results are followed from slot to slot; then all slots are walked again from where they begin.
    """
    distinct = checkpoint(df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("times")).withColumn("_slot", slot.cast("long")))
    keys = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by) + (", " if by else "")

    def nexts(v):
        """For every value the place of the first one after it that does not join it: looked up, then put right by the rule itself."""
        own = np.arange(len(v)) + 1
        at = np.maximum(np.searchsorted(v, reach(v), "right"), own)
        while (off := np.flatnonzero((at < len(v)) & within(v, v[np.minimum(at, len(v) - 1)]))).size:
            at[off] += 1
        while (off := np.flatnonzero((at > own) & ~within(v, v[at - 1]))).size:
            at[off] -= 1
        return at

    def entries(g):
        v = g[value].astype(float)
        n, after = len(v), nexts(v)
        end = np.where(after < n, np.minimum(after, n - 1), np.arange(n))
        while not np.array_equal(further := end[end], end):
            end = further
        begins = np.arange(min(after[0], n - 1) + 1)
        # Of neighbours that come to the same end, the last one says all.
        begins = begins[np.append(end[begins[1:]] != end[begins[:-1]], True)]
        return {**{c: g[c][:len(begins)] for c in (*by, "_slot")}, "_begin": v[begins], "_end": v[end[begins]]}

    walked = fold_groups(distinct, [*by, "_slot"], [value], keys + "_slot bigint, _begin double, _end double", entries)

    def follow(g):
        slots, begins, ends = g["_slot"], g["_begin"], g["_end"]
        changed = np.flatnonzero(np.append(True, slots[1:] != slots[:-1]))
        out, start = [], None
        for lo, hi in zip(changed, np.append(changed[1:], len(slots))):
            out.append(np.nan if start is None else start)
            free = np.ones(1, bool) if start is None else ~within(start, begins[lo:hi])
            start = ends[lo + int(np.argmax(free))] if free.any() else start
        return {**{c: g[c][changed] for c in (*by, "_slot")}, "_open": np.array(out)}

    opened = fold_groups(walked, by, ["_slot", "_begin"], keys + "_slot bigint, _open double", follow) if by else fold_groups(walked.withColumn("_one", F.lit(1)), ["_one"], ["_slot", "_begin"], "_slot bigint, _open double", follow)
    placed = distinct.alias("d").join(opened.alias("o"), _same(by), "left").select("d.*", "o._open")

    def finish(g):
        v, start = g[value].astype(float), np.empty(len(g[value]))
        held, after = g["_open"][0], nexts(v)
        free = ~within(held, v) if held == held else np.ones(1, bool)
        i = int(np.argmax(free)) if free.any() else len(v)
        start[:i] = held
        while i < len(v):
            start[i:after[i]] = v[i]
            i = after[i]
        return {**{c: g[c] for c in by}, value: v, "start": start, "times": g["times"]}

    return fold_groups(placed, [*by, "_slot"], [value], f"{keys}`{value}` double, start double, times bigint", finish)


def _same(by: list[str]) -> Column:
    on = F.col("d._slot") == F.col("o._slot")
    for c in by:
        on = on & F.col(f"d.{c}").eqNullSafe(F.col(f"o.{c}"))
    return on


def snap(df: DataFrame, by: list[str], value: str, tolerance: float = 2.0) -> DataFrame:
    """Each distinct value with the one it snaps to: the first of its cluster, compared with the kept value."""
    return _clusters(df, by, value, F.floor(F.col(value) / (max(tolerance, 1e-9) * 16)), lambda s: s + tolerance, lambda s, v: v - s <= tolerance).withColumnRenamed("start", "snapped")


def snap_sizes(df: DataFrame, by: list[str], value: str, ratio: float = 1.22) -> DataFrame:
    """Each distinct value with the median of its cluster: values up to ``ratio`` times the cluster's first."""
    # Slots are as wide as sixteen clusters. Below 0 a cluster is one value; those slots come before all others.
    v, wide = F.col(value), 16 * float(np.log(ratio)) if ratio > 1 else 64.0
    below = F.greatest(F.floor(v / 64), F.lit(-2**61)) - F.lit(2**61)
    clusters = _clusters(df, by, value, F.when(v > 0, F.floor((F.log(v) if ratio > 1 else v) / wide)).otherwise(below), lambda s: ratio * s, lambda s, v: v <= ratio * s)
    middles = ranks.median(clusters, [*by, "start"], value, "size", weight="times").drop("n")
    return clusters.join(middles, [*by, "start"]).select(*by, value, "size", "times")
