"""Robust numeric profiles over events and line items."""

from pyspark.sql import functions as F

from quire.operators import numeric
from quire.plans import ranks
from quire.sources.tables import events, table


def upper_median(spark, d):
    return ranks.upper_median(events(spark, d, "event_type", "value"), ["event_type"], "value")


def upper_median_prices(spark, d):
    return ranks.upper_median(table(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_extendedprice"), ["l_returnflag", "l_linestatus"], "l_extendedprice")


def otsu_split(spark, d):
    return numeric.otsu_split(events(spark, d, "event_type", "value"), ["event_type"], "value", 0, 100)


def otsu_split_prices(spark, d):
    return numeric.otsu_split(table(spark, d, "lineitem", "l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice", 0, 120000)


def tonal_range(spark, d):
    return numeric.tonal_range(table(spark, d, "lineitem", "l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice", 0, 120000)


def robust_stretch(spark, d):
    return numeric.robust_stretch(events(spark, d, "event_id", "event_type", "value"), ["event_type"], "value", 0, 100).select("event_id", "low_contrast", "stretched")


def mad_outliers(spark, d):
    out = numeric.mad_outliers(events(spark, d, "event_id", "event_type", "value"), ["event_type"], "value", k=2.0, minimum=10.0)
    return out.select("event_id", "event_type", "value", *[F.round(c, 6).alias(c) for c in ("median", "mad", "ceiling")])


def change_check(spark, d):
    """Events of a type as a series whose first part of every ten was smoothed."""
    n, v = F.col("event_id") % 10, F.col("value")
    pairs = events(spark, d, "event_id", "event_type", "value").select(
        F.col("event_type").alias("series_id"), F.col("event_id").alias("t"), v.alias("before"),
        F.when((n < 4) & (F.col("event_type") != "view"), 10 + F.floor(v / 100)).otherwise(v).alias("after"), (n < 4).alias("selected"), (n >= 5).alias("around"))
    out = numeric.change_check(pairs, "series_id", "t")
    return out.select("series_id", "inside", "warning", *[F.round(c, 6).alias(c) for c in ("change", "detail", "detail_around")])


def snap(spark, d):
    return numeric.snap(events(spark, d, "event_type", "value"), ["event_type"], "value", 2.0)


def snap_sizes(spark, d):
    return numeric.snap_sizes(table(spark, d, "lineitem", "l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice", 1.22).withColumn("size", F.round("size", 6))


QUERIES = {f.__name__: f for f in (upper_median, upper_median_prices, otsu_split, otsu_split_prices, tonal_range, robust_stretch, mad_outliers, change_check, snap, snap_sizes)}


def _bin(value: str, high: int) -> str:
    return f"greatest(0, least(255, floor({value} / {high}.0::DOUBLE * 256)))::INT"


def _otsu(table: str, by: str, value: str, high: int) -> str:
    return f"""
WITH h AS (SELECT {by}, {_bin(value, high)} AS bin, count(*) AS n FROM {table} GROUP BY ALL),
s AS (SELECT {by}, bin, sum(n) OVER w AS wb, sum(bin * n) OVER w AS sb, sum(n) OVER (PARTITION BY {by}) AS total, sum(bin * n) OVER (PARTITION BY {by}) AS sm FROM h WINDOW w AS (PARTITION BY {by} ORDER BY bin)),
b AS (SELECT *, CASE WHEN total > wb THEN wb::DOUBLE * (total - wb)::DOUBLE * (sb::DOUBLE / wb - (sm - sb)::DOUBLE / (total - wb)) * (sb::DOUBLE / wb - (sm - sb)::DOUBLE / (total - wb)) ELSE 0 END AS bt FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY bt DESC, bin) AS k FROM b)
SELECT {by}, total::BIGINT AS n, CASE WHEN bt > 0 THEN bin ELSE 127 END::INT AS threshold, CASE WHEN bt > 0 THEN wb ELSE total END::BIGINT AS low_rows FROM r WHERE k = 1"""


def _tonal(table: str, by: str, value: str, high: int) -> str:
    return f"""h AS (SELECT {by}, {_bin(value, high)} AS bin, count(*) AS n FROM {table} GROUP BY ALL),
s AS (SELECT {by}, bin, sum(n) OVER (PARTITION BY {by} ORDER BY bin) AS seen, sum(n) OVER (PARTITION BY {by}) AS total FROM h),
tones AS (SELECT {by}, min(bin) FILTER (seen >= total * 0.01::DOUBLE) AS lo, min(bin) FILTER (seen >= total * 0.99::DOUBLE) AS hi FROM s GROUP BY {by})"""


def _median(table: str, by: str, value: str) -> str:
    return f"SELECT {by}, median({value}) AS m FROM {table} GROUP BY {by}"


def _chain(source: str, by: str, value: str, reach: str) -> str:
    """Greedy clusters over distinct values: each start is the least value beyond the last start's reach."""
    return f"""WITH RECURSIVE v AS (SELECT {by}, {value} AS v, count(*) AS times FROM {source} GROUP BY ALL),
c AS (SELECT {by}, min(v) AS start FROM v GROUP BY {by}
  UNION ALL SELECT c.{by}, (SELECT min(v.v) FROM v WHERE v.{by} = c.{by} AND v.v > {reach}) AS start FROM c WHERE EXISTS (SELECT 1 FROM v WHERE v.{by} = c.{by} AND v.v > {reach})),
m AS (SELECT v.{by}, v.v, v.times, max(c.start) AS start FROM v JOIN c ON c.{by} = v.{by} AND c.start <= v.v GROUP BY ALL)"""


ORACLE = {
    "upper_median": "SELECT event_type, count(*) AS n, list_sort(list(value))[(count(*) // 2 + 1)::INT] AS upper_median FROM events GROUP BY event_type",
    "upper_median_prices": "SELECT l_returnflag, l_linestatus, count(*) AS n, list_sort(list(l_extendedprice))[(count(*) // 2 + 1)::INT] AS upper_median FROM lineitem GROUP BY ALL",
    "otsu_split": _otsu("events", "event_type", "value", 100),
    "otsu_split_prices": _otsu("lineitem", "l_returnflag", "l_extendedprice", 120000),
    "tonal_range": f"WITH {_tonal('lineitem', 'l_returnflag', 'l_extendedprice', 120000)} SELECT *, hi - lo < 110 AS low_contrast, hi - lo >= 8 AS stretch FROM tones",
    "robust_stretch": f"WITH {_tonal('events', 'event_type', 'value', 100)} SELECT event_id, hi - lo < 110 AS low_contrast, CASE WHEN hi - lo >= 8 THEN round_even(greatest(0, least(255, ({_bin('value', 100)} - lo) * (255.0::DOUBLE / (hi - lo)))), 0) ELSE {_bin('value', 100)} END::INT AS stretched FROM events JOIN tones USING (event_type)",
    "mad_outliers": f"""
WITH m AS ({_median('events', 'event_type', 'value')}), a AS (SELECT event_type, event_id, value, m, abs(value - m) AS away FROM events JOIN m USING (event_type)),
d AS (SELECT event_type, median(away) AS mad FROM a GROUP BY event_type), b AS (SELECT a.*, mad, greatest(10.0::DOUBLE, m + 2.0::DOUBLE * (mad * 1.4826::DOUBLE + 1.0::DOUBLE)) AS base FROM a JOIN d USING (event_type)),
c AS (SELECT event_type, i, base * pow(1.3::DOUBLE, i) AS ceiling, count(*) FILTER (value > base * pow(1.3::DOUBLE, i)) / count(*) AS share FROM b, range(6) t(i) GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY CASE WHEN share <= 0.04 THEN 0 ELSE 1 END, CASE WHEN share <= 0.04 THEN i ELSE -i END) AS k FROM c)
SELECT b.event_id, b.event_type, b.value, round(b.m, 6) AS median, round(b.mad, 6) AS mad, round(p.ceiling, 6) AS ceiling FROM b JOIN p ON p.event_type = b.event_type AND p.k = 1 WHERE b.value > p.ceiling""",
    "change_check": """
WITH p AS (SELECT event_type AS series_id, event_id AS t, value AS before, CASE WHEN event_id % 10 < 4 AND event_type <> 'view' THEN 10 + floor(value / 100) ELSE value END AS after, event_id % 10 < 4 AS sel, event_id % 10 >= 5 AS around FROM events),
s AS (SELECT *, abs(after - lag(after) OVER (PARTITION BY series_id ORDER BY t)) AS step FROM p),
g AS (SELECT series_id, count(*) FILTER (sel) AS inside, avg(abs(before - after)) FILTER (sel) AS change, coalesce(avg(step) FILTER (sel), 0) AS detail, coalesce(avg(step) FILTER (around), 0) AS detail_around FROM s GROUP BY series_id)
SELECT series_id, inside, round(change, 6) AS change, round(detail, 6) AS detail, round(detail_around, 6) AS detail_around,
  CASE WHEN inside < 30 THEN '' WHEN change < 1.5 THEN 'UNCHANGED' WHEN detail_around > 4 AND detail < detail_around * 0.35 THEN 'ROUGH_RESULT' ELSE '' END AS warning FROM g""",
    "snap": _chain("events", "event_type", "value", "c.start + 2.0::DOUBLE").replace("v.v > c.start + 2.0::DOUBLE", "v.v - c.start > 2.0::DOUBLE") + " SELECT event_type, v AS value, start AS snapped, times FROM m",
    "snap_sizes": _chain("lineitem", "l_returnflag", "l_extendedprice", "c.start * 1.22::DOUBLE") + """, z AS (SELECT l_returnflag, start, median(l_extendedprice) AS size FROM m JOIN lineitem l ON l.l_returnflag = m.l_returnflag AND l.l_extendedprice = m.v GROUP BY m.l_returnflag, start)
SELECT m.l_returnflag, m.v AS l_extendedprice, round(z.size, 6) AS size, m.times FROM m JOIN z USING (l_returnflag, start)""".replace("SELECT l_returnflag, start, median", "SELECT m.l_returnflag, start, median"),
}
