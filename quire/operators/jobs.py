"""Job and progress events: rate windows, job states, expiry, stage timings. Batch forms; see ``streaming``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values ---
WINDOW = "15 minutes"
API_LIMIT = 300
PROCESSING_LIMIT = 60
TTL_MINUTES = 30
# --------------------


def rate_windows(events: DataFrame, client: str, ts: str = "ts", watermark: str | None = None, all_limit: int = API_LIMIT, processing_limit: int = PROCESSING_LIMIT, processing: Column | None = None) -> DataFrame:
    """Requests per client and 15 minute window, against the general and the processing limit.

    The same function serves a stream; there ``watermark`` bounds the state. A busy client is one row per
    window and task before the shuffle.
    """
    if watermark:
        events = events.withWatermark(ts, watermark)
    heavy = processing if processing is not None else F.lit(True)
    g = events.groupBy(client, F.window(ts, WINDOW).alias("w")).agg(F.count(F.lit(1)).alias("requests"), F.count_if(heavy).alias("processing"))
    return g.select(client, F.col("w.start").alias("window_start"), "requests", "processing", (F.col("requests") > all_limit).alias("over_all"), (F.col("processing") > processing_limit).alias("over_processing"))


def job_states(events: DataFrame) -> DataFrame:
    """The state each job has reached: status, progress, files, merged summary, error and end.

    A start resets progress, an end keeps its counts, a failed job loses its files. The latest event of
    each kind is an aggregate, so a job with very many progress events is combined before the shuffle.
    """
    order = F.struct("ts", "seq")
    progress = (
        F.when(F.col("status") == "queued", F.struct(F.lit("queued").alias("step"), F.lit(0).alias("done"), F.lit(0).alias("total")))
        .when(F.col("status") == "processing", F.struct(F.lit("starting").alias("step"), F.lit(0).alias("done"), F.lit(0).alias("total")))
        .when(F.col("step").isNotNull(), F.struct("step", F.coalesce("done", F.lit(0)).alias("done"), F.coalesce("total", F.lit(0)).alias("total")))
    )
    ended = F.col("status").isin("completed", "failed")
    g = events.withColumn("_p", progress).groupBy("job_id").agg(
        F.max_by("status", F.when(F.col("status").isNotNull(), order)).alias("status"), F.max_by("_p", F.when(F.col("_p").isNotNull(), order)).alias("_p"),
        F.count("file").alias("_files"), F.coalesce(F.sum("file.size"), F.lit(0)).alias("_bytes"), F.max_by("error", F.when(F.col("status") == "failed", order)).alias("error"),
        F.max(F.when(ended, F.col("ts"))).alias("ended_at"), F.min("ts").alias("created_at"))
    failed = F.col("status") == "failed"
    states = g.select(
        "job_id", "status", F.when(F.col("status") == "completed", "completed").otherwise(F.col("_p.step")).alias("step"), "_p.done", "_p.total",
        F.when(failed, 0).otherwise(F.col("_files")).alias("files"), F.when(failed, 0).otherwise(F.col("_bytes")).alias("bytes"), F.when(failed, F.col("error")).alias("error"), "created_at",
        F.when(F.col("status").isin("completed", "failed"), F.col("ended_at")).alias("ended_at"))
    facts = events.filter("summary IS NOT NULL").select("job_id", order.alias("o"), F.explode("summary").alias("key", "value"))
    latest = facts.groupBy("job_id", "key").agg(F.max_by("value", "o").alias("value"))
    merged = latest.groupBy("job_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("summary"))
    return states.join(merged, "job_id", "left")


def expired(states: DataFrame, now: Column, ttl_minutes: int = TTL_MINUTES) -> DataFrame:
    """Finished jobs whose time after their end has run out; running ones never."""
    end = F.col("ended_at") + F.make_interval(mins=F.lit(ttl_minutes))
    return states.filter(F.col("status").isin("completed", "failed") & (end <= now)).withColumn("expires_at", end)


def stage_durations(progress: DataFrame) -> DataFrame:
    """Begin, end and seconds per run and stage; open stages have no end. Events after a run's end do not count."""
    ends = progress.filter(F.col("type").isin("result", "error")).groupBy("run_id").agg(F.min("ts").alias("_end"), F.min_by("type", "ts").alias("outcome"))
    live = progress.filter("type = 'stage'").join(ends, "run_id", "left").filter(F.col("_end").isNull() | (F.col("ts") <= F.col("_end")))
    g = live.groupBy("run_id", "stage").agg(
        F.min(F.when(F.col("status") == "active", F.col("ts"))).alias("started"), F.max(F.when(F.col("status") == "done", F.col("ts"))).alias("ended"),
        F.max_by("detail", F.when(F.col("detail").isNotNull(), F.col("ts"))).alias("detail"), F.first("outcome").alias("outcome"))
    return g.withColumn("seconds", (F.unix_micros("ended") - F.unix_micros("started")) / 1e6)
