"""The same work on unbounded tables: Structured Streaming with watermarks and keyed state."""

from __future__ import annotations

import io
import json
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quire.operators import cleaning, jobs
from quire.session import work_folder
from quire.sources.tables import utc

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
JOB_ROW = "job_id long, status string, step string, done int, total int, files long, bytes long, error string, created_us long, ended_us long, summary string, event string"
#: Jobs and clients are hashed to so many groups, each folded as one table; fixed for the life of a stream's checkpoint.
SLOTS = 256
NONE = -2**63


def event_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A parquet table, one file or a folder of files, as a stream, with ``ts`` as a timestamp."""
    path = f"{folder}/{name}.parquet"
    found = spark.read.parquet(path)
    reader = spark.readStream.schema(found.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    # A stream reads folders: of the table's own, or of all tables, where this one is a single file.
    single = any(f.rsplit("/", 2)[1:] != [f"{name}.parquet"] * 2 and f.endswith(f"/{name}.parquet") for f in found.inputFiles()[:1])
    df = reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder) if single else reader.parquet(path)
    return df.withColumn("ts", utc("ts")) if "ts" in df.columns else df


def run_to_table(df: DataFrame, name: str, mode: str, keys: list[str] | None = None) -> tuple[DataFrame, StreamingQuery]:
    """Runs a stream over what is available and returns what it wrote.

    Each epoch is its own folder, overwritten if the epoch is replayed, so a restart writes nothing twice.
    With ``keys`` (update mode) the last epoch's row of a key stands.
    """
    spark = df.sparkSession
    folder = work_folder(spark, name)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")

    query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    out = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("epoch", T.IntegerType())])).option("basePath", f"{folder}/out").parquet(f"{folder}/out")
    if keys:
        columns = [c for c in df.columns if c not in keys]
        out = out.groupBy(*keys).agg(F.max_by(F.struct(*columns), "epoch").alias("s")).select(*keys, *[F.col("s")[c].alias(c) for c in columns])
    else:
        out = out.drop("epoch")
    return out, query


def dropped_rows(query: StreamingQuery) -> int:
    """Late rows a query left out, as its progress reports count them."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"])


def stage_durations(progress: DataFrame, delay: str = "10 minutes", longest: str = "30 days") -> DataFrame:
    """Begin and end of each stage as they close: starts joined with their ends, open ones once the watermark has passed ``longest``.

    ``longest`` bounds what a stream keeps of a stage that never ends; it has to exceed every real stage.
    """
    p = progress.filter("type = 'stage'").withWatermark("ts", delay)
    begin = p.filter("status = 'active'").select(F.col("run_id"), F.col("stage"), F.col("ts").alias("started"))
    end = p.filter("status = 'done'").select(F.col("run_id").alias("r"), F.col("stage").alias("s"), F.col("ts").alias("ended"), "detail")
    on = (F.col("run_id") == F.col("r")) & (F.col("stage") == F.col("s")) & (F.col("ended") >= F.col("started")) & (F.col("ended") <= F.col("started") + F.expr(f"INTERVAL {longest}"))
    return begin.join(end, on, "left_outer").select("run_id", "stage", "started", "ended", "detail", ((F.unix_micros("ended") - F.unix_micros("started")) / 1e6).alias("seconds"))


class SlotFold(StatefulProcessor):
    """State of all keys of a slot as one table: read, folded and written once a batch, with one timer for its next end.

    A call to the state store costs as much as folding hundreds of rows, so keys don't have calls of their own.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("slot", "held binary, timer long")

    def _read(self) -> tuple[pd.DataFrame, int | None]:
        if not self.state.exists():
            return pd.DataFrame(self.EMPTY), None
        held, timer = self.state.get()
        return pa.ipc.open_stream(bytes(held)).read_pandas(), timer

    def _write(self, held: pd.DataFrame, timer: int | None) -> None:
        """Keeps the table and waits for the first of its ends."""
        ends = self._ends(held)
        first = int(ends[ends != NONE].min()) if (ends != NONE).any() else None
        if timer is not None and timer != first:
            self.handle.deleteTimer(timer)
        if first is not None and timer != first:
            self.handle.registerTimer(first)
        if not len(held):
            self.state.clear()
            return
        table, out = pa.Table.from_pandas(held, preserve_index=False), io.BytesIO()
        with pa.ipc.new_stream(out, table.schema) as sink:
            sink.write_table(table)
        self.state.update((out.getvalue(), first))

    def _expired(self, timerValues, expiredTimerInfo) -> pd.DataFrame:
        """Takes out of the state what has come to its end."""
        held, _ = self._read()
        ends, fired = self._ends(held), expiredTimerInfo.getExpiryTimeInMs()
        # A timer set here is looked at with the next batch only, so what ends at the watermark itself goes with the rest.
        over = (ends != NONE) & ((ends <= fired) | (ends <= timerValues.getCurrentWatermarkInMs()))
        self._write(held[~over].reset_index(drop=True), None)
        return held[over].reset_index(drop=True)

    def close(self) -> None:
        pass


class JobFold(SlotFold):
    """Folds the events of jobs into their states, in whatever order they arrive; some time after its end a job's state goes.

    Every field remembers the place (time and number) of the event it comes from, and only a later one replaces it, so
    that the state after any batches is that of one table of all events.
    """

    DEFAULT = {
        "job": "", "status": None, "status_at": "", "step": None, "done": 0, "total": 0, "step_at": "", "files": 0, "bytes": 0, "error": None, "error_at": "",
        "created": 2**63 - 1, "ended": NONE, "summary": "{}", "stages": "[]"}
    EMPTY = {n: pd.Series([], dtype="int64" if isinstance(v, int) else object) for n, v in DEFAULT.items()}

    def __init__(self, ttl_minutes: int):
        self.ttl_ms = ttl_minutes * 60_000

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, timer = self._read()
        held, touched = self._fold(held, pd.concat(list(rows), ignore_index=True))
        self._write(held, timer)
        yield self._rows(held.iloc[touched], "state")

    def _ends(self, held: pd.DataFrame) -> np.ndarray:
        """When each job's state goes, in whole milliseconds, none too early."""
        ended = held["ended"].to_numpy("int64")
        over = held["status"].isin(["completed", "failed"]).to_numpy() & (ended != NONE)
        return np.where(over, -(-ended // 1000) + self.ttl_ms, NONE)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Goes on from what ``job_seed`` has made of earlier events."""
        held, timer = self._read()
        more = initialState.reset_index(drop=True).assign(stages="[]")[list(self.DEFAULT)].astype({n: "int64" for n, v in self.DEFAULT.items() if isinstance(v, int)})
        self._write(pd.concat([held, more], ignore_index=True) if len(held) else more, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        over = self._expired(timerValues, expiredTimerInfo)
        if len(over):
            yield self._rows(over, "expired")

    def _fold(self, held: pd.DataFrame, part: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        """The table with a batch added, and which of its rows the batch has touched: sums once, and per field the last row that speaks of it."""
        new = pd.Index(part["job"].unique()).difference(held["job"], sort=False)
        if len(new):
            more = pd.DataFrame({n: new if n == "job" else pd.Series([v] * len(new), dtype="int64" if isinstance(v, int) else object) for n, v in self.DEFAULT.items()})
            held = pd.concat([held, more], ignore_index=True) if len(held) else more
        part = part.sort_values("place", kind="stable", ignore_index=True)
        row = pd.Index(held["job"]).get_indexer(part["job"])
        f = {c: held[c].to_numpy(object if not isinstance(v, int) else "int64", copy=True) for c, v in self.DEFAULT.items()}
        g = {c: part[c].to_numpy() if part[c].dtype.kind in "iub" else part[c].astype(object).where(part[c].notna(), None).to_numpy() for c in part.columns}
        starts, ends = part["status"].isin(["queued", "processing"]).to_numpy(), part["status"].isin(["completed", "failed"]).to_numpy()

        def newest(said: np.ndarray, at: str) -> tuple[np.ndarray, np.ndarray]:
            last = np.full(len(held), -1)
            last[row[said]] = np.flatnonzero(said)  # of several, the last one stays
            rows = np.flatnonzero(last >= 0)
            rows = rows[(g["place"][last[rows]] >= f[at][rows]).astype(bool)]
            f[at][rows] = g["place"][last[rows]]
            return rows, last[rows]

        rows, i = newest(part["status"].notna().to_numpy(), "status_at")
        f["status"][rows] = g["status"][i]
        rows, i = newest(starts | part["step"].notna().to_numpy(), "step_at")
        f["step"][rows] = np.where(starts[i], np.where(g["status"][i] == "queued", "queued", "starting").astype(object), g["step"][i])
        for name in ("done", "total"):
            f[name][rows] = np.where(starts[i], 0, g[name][i])
        rows, i = newest((part["status"] == "failed").to_numpy(bool), "error_at")
        f["error"][rows] = g["error"][i]
        np.maximum.at(f["ended"], row[ends], g["us"][ends])
        timed = g["us"] != NONE
        np.minimum.at(f["created"], row[timed], g["us"][timed])
        np.add.at(f["files"], row, g["files"])
        np.add.at(f["bytes"], row, g["bytes"])
        facts: dict[int, dict] = {}
        for i in np.flatnonzero(part["summary"].notna().to_numpy()):
            if row[i] not in facts:
                facts[row[i]] = json.loads(f["summary"][row[i]])
            known = facts[row[i]]
            for name, value in json.loads(g["summary"][i]).items():
                if name not in known or known[name][0] <= g["place"][i]:
                    known[name] = [g["place"][i], value]
        for r, known in facts.items():
            f["summary"][r] = json.dumps(known)
        return pd.DataFrame(f), np.unique(row)

    @staticmethod
    def _rows(held: pd.DataFrame, event: str) -> pd.DataFrame:
        failed, done = (held["status"] == "failed").to_numpy(bool), (held["status"] == "completed").to_numpy(bool)

        def said(text: str) -> str | None:
            facts = {name: value for name, (_, value) in sorted(json.loads(text).items())}
            return json.dumps(facts) if facts else None

        created, ended = held["created"].to_numpy("int64"), held["ended"].to_numpy("int64")
        whole = lambda values, known: pd.Series([int(v) if k else None for v, k in zip(values, known)], dtype="Int64")
        return pd.DataFrame({
            "job_id": whole([v or 0 for v in held["job"]], held["job"] != ""), "status": held["status"].to_numpy(), "step": np.where(done, "completed", held["step"].to_numpy(object)),
            "done": held["done"].to_numpy("int32"), "total": held["total"].to_numpy("int32"), "files": np.where(failed, 0, held["files"]), "bytes": np.where(failed, 0, held["bytes"]),
            "error": np.where(failed, held["error"].to_numpy(object), None), "created_us": whole(created, created != 2**63 - 1), "ended_us": whole(ended, (failed | done) & (ended != NONE)),
            "summary": [said(t) for t in held["summary"]], "event": event})


def _slot(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(SLOTS)).cast("int").alias("slot")


def _place(ts: str) -> Column:
    """An event's place among its job's: time, then number, as text."""
    micros = F.coalesce((F.unix_micros(ts) * 1000).cast("string"), F.lit(""))
    return F.concat(F.lpad(micros, 20, "0"), F.lit("/"), F.lpad(F.coalesce(F.col("seq").cast("string"), F.lit("")), 20, "0"))


def _job_input(events: DataFrame, ts: str = "ts") -> list[Column]:
    none = lambda c, instead: F.coalesce(c, F.lit(instead))
    return [
        _slot("job_id"), none(F.col("job_id").cast("string"), "").alias("job"), _place(ts).alias("place"), none(F.unix_micros(ts), NONE).alias("us"), "status", "step",
        none(F.col("done"), 0).cast("int").alias("done"), none(F.col("total"), 0).cast("int").alias("total"), F.col("file.size").isNotNull().cast("long").alias("files"),
        none(F.col("file.size"), 0).cast("long").alias("bytes"), "error", F.to_json("summary").alias("summary")]


def _by_value(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # The processors are also loaded where shipped files are not looked for, so they travel by value.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


def job_seed(events: DataFrame) -> DataFrame:
    """What ``job_states`` would hold after a table of events, one row per job: the state a stream goes on from.

    Every part is an aggregate that is combined before the shuffle, however many events a job has.
    """
    starts, ends = F.col("status").isin("queued", "processing"), F.col("status").isin("completed", "failed")
    moves = F.coalesce(starts, F.lit(False)) | F.col("step").isNotNull()
    step = F.when(F.col("status") == "queued", "queued").when(F.col("status") == "processing", "starting").otherwise(F.col("step"))
    counted = lambda c: F.when(F.coalesce(starts, F.lit(False)), 0).otherwise(F.coalesce(c, F.lit(0)))
    rows = events.withColumn("_place", _place("ts"))
    at = lambda when: F.when(when, F.col("_place"))
    latest = lambda value, when: F.max_by(value, at(when))
    said, failed = F.col("status").isNotNull(), F.col("status") == "failed"
    jobs_ = rows.groupBy("job_id").agg(
        latest(F.col("status"), said).alias("status"), F.coalesce(F.max(at(said)), F.lit("")).alias("status_at"), latest(step, moves).alias("step"),
        F.coalesce(latest(counted("done"), moves), F.lit(0)).cast("int").alias("done"), F.coalesce(latest(counted("total"), moves), F.lit(0)).cast("int").alias("total"), F.coalesce(F.max(at(moves)), F.lit("")).alias("step_at"),
        F.count("file.size").alias("files"), F.coalesce(F.sum("file.size"), F.lit(0)).cast("long").alias("bytes"), latest(F.col("error"), failed).alias("error"), F.coalesce(F.max(at(failed)), F.lit("")).alias("error_at"),
        F.coalesce(F.unix_micros(F.min("ts")), F.lit(2**63 - 1)).alias("created"), F.coalesce(F.unix_micros(F.max(F.when(ends, F.col("ts")))), F.lit(NONE)).alias("ended"))
    facts = rows.where("summary IS NOT NULL").select("job_id", "_place", F.explode("summary").alias("name", "value"))
    facts = facts.groupBy("job_id", "name").agg(F.max(F.struct("_place", "value")).alias("f"))
    facts = facts.groupBy("job_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("name", F.array("f._place", "f.value"))))).alias("summary"))
    out = jobs_.withColumn("job", F.coalesce(F.col("job_id").cast("string"), F.lit(""))).join(facts.withColumnRenamed("job_id", "j"), F.col("job_id").eqNullSafe(F.col("j")), "left")
    return out.select(_slot("job_id"), *[F.coalesce("summary", F.lit("{}")).alias("summary") if c == "summary" else c for c in JobFold.DEFAULT if c != "stages"])


def job_states(events: DataFrame, ttl_minutes: int = jobs.TTL_MINUTES, delay: str = "10 minutes", seed: DataFrame | None = None) -> DataFrame:
    """Job states as they change (update mode), and one row when a finished job expires.

    ``seed`` (from ``job_seed``) is what earlier events, read as a table, have left: the stream goes on from it.
    """
    _by_value(events.sparkSession)
    flat = events.withWatermark("ts", delay)
    flat = flat.select(*_job_input(flat), "ts")
    rows = flat.groupBy("slot").transformWithStateInPandas(
        statefulProcessor=JobFold(ttl_minutes), outputStructType=JOB_ROW, outputMode="Update", timeMode="EventTime", initialState=seed.groupBy("slot") if seed is not None else None)
    return _timed_jobs(rows, *[c.split()[0] for c in JOB_ROW.split(", ")])


def _timed_jobs(rows: DataFrame, *columns: str) -> DataFrame:
    made = {"created_us": F.timestamp_micros("created_us").alias("created_at"), "ended_us": F.timestamp_micros("ended_us").alias("ended_at"), "summary": F.from_json("summary", "map<string,string>").alias("summary")}
    return rows.select(*[made.get(c, F.col(c)) for c in columns])


#: Keys that rows without a client are spread over.
SPREAD = 256
OPS_ROW = JOB_ROW.replace("job_id long", "kind string, ts timestamp, client long, job_id long") + ", at timestamp, seq long, stage string, started timestamp, ended timestamp, heavy boolean"
RATE_ROW = OPS_ROW + ", window_start timestamp, requests long, processing long"


def _shaped(rows: pd.DataFrame, shape: str) -> pd.DataFrame:
    """The columns of ``shape``, in its order; those that ``rows`` lacks are null, whatever their type."""
    nothing = pd.Series([None] * len(rows), index=rows.index, dtype=object)
    return pd.DataFrame({name: rows[name] if name in rows else nothing for name in (c.split()[0] for c in shape.split(", "))})


def _tagged(kind: str, ts, **columns) -> pd.DataFrame:
    """Rows of one kind; what that kind hasn't is null."""
    return _shaped(pd.DataFrame({"kind": kind, "ts": ts, **columns}), OPS_ROW)


class OpsFold(JobFold):
    """A job's events in one pass: its state, its stages, its expiry, its late rows, and its requests passed on.

    Rows older than the watermark of their batch are given out as late and change nothing. ``ts`` of what goes on is
    never older than the watermark, so that the next operator's holds too.
    """

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, timer = self._read()
        part = pd.concat(list(rows), ignore_index=True)
        edge = pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms")
        late = part["at"] < edge
        made = []
        if late.any():
            some = part[late]
            made.append(_tagged("late", edge, job_id=some["job_id"], client=some["client"], at=some["at"], seq=some["seq"]))
        part = part[~late].reset_index(drop=True)
        if len(part):
            made.append(_tagged("request", part["at"], job_id=part["job_id"], client=part["client"], at=part["at"], seq=part["seq"], heavy=part["heavy"]))
            held, touched = self._fold(held, part)
            newest = part.groupby("job")["at"].max()
            jobs_ = held["job"].iloc[touched]
            made.append(_tagged("job", newest.reindex(jobs_).to_numpy(), **self._rows(held.iloc[touched], "state")))
            marked = part[part["mark"].notna()]
            if len(marked):
                made.append(self._mark(held, marked, newest))
            self._write(held, timer)
        # One table a call: every table given out is a message of its own.
        yield pd.concat(made, ignore_index=True)

    def _mark(self, held: pd.DataFrame, marked: pd.DataFrame, newest: pd.Series) -> pd.DataFrame:
        """Adds what begins and ends to the jobs' lists, and times the stages of those jobs."""
        places = dict(zip(held["job"], range(len(held))))
        lists, texts = {}, held["stages"].to_numpy(object, copy=True)
        for job, mark, stage, at in zip(marked["job"], marked["mark"], marked["stage"], marked["at"].astype("datetime64[ns]").astype("int64")):
            if job not in lists:
                lists[job] = json.loads(texts[places[job]])
            lists[job].append([mark, None if pd.isna(stage) else stage, at])
        out = []
        for job, marks in lists.items():
            texts[places[job]] = json.dumps(marks)
            out += [(job, *timed) for timed in self._timed(marks)]
        held["stages"] = texts
        job, names, begun, done = zip(*out) if out else ((), (), (), ())
        ids = pd.Series([int(j) if j else None for j in job], dtype="Int64")
        stamps = lambda values: pd.Series(values, dtype="datetime64[ns]")
        return _tagged("stage", newest.reindex(list(job)).to_numpy(), job_id=ids, stage=list(names), started=stamps(begun), ended=stamps(done))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for rows in super().handleExpiredTimer(key, timerValues, expiredTimerInfo):
            yield _tagged("expired", pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms"), **rows)

    @staticmethod
    def _timed(marks: list) -> list[tuple]:
        """Per stage its first start and its last end; what comes after the run's end doesn't count."""
        end = min((t for m, _, t in marks if m in ("result", "error")), default=None)
        live = [x for x in marks if x[1] is not None and (end is None or x[2] <= end)]
        when = lambda stage, mark: [t for m, s, t in live if s == stage and m == mark]
        stamp = lambda t: None if t is None else pd.Timestamp(t)
        return [(s, stamp(min(when(s, "active"), default=None)), stamp(max(when(s, "done"), default=None))) for s in dict.fromkeys(x[1] for x in live)]


class RateFold(SlotFold):
    """Counts the requests of clients per window and hands every other row on; windows well past the watermark are let go."""

    EMPTY = {n: pd.Series([], dtype="int64") for n in ("whose", "start", "requests", "processing")}

    def __init__(self, minutes: int):
        self.width = minutes * 60_000

    def _ends(self, held: pd.DataFrame) -> np.ndarray:
        return held["start"].to_numpy("int64") + self.width

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows), ignore_index=True)
        asked = part["kind"] == "request"
        if (~asked).any():
            yield _shaped(part[~asked], RATE_ROW)
        if not asked.any():
            return
        held, timer = self._read()
        some = part[asked]
        new = pd.DataFrame({"whose": some["whose"], "start": some["at"].astype("datetime64[ms]").astype("int64") // self.width * self.width, "requests": 1, "processing": some["heavy"].astype(bool).astype("int64")})
        counted = pd.concat([held, new], ignore_index=True).groupby(["whose", "start"], as_index=False).sum()
        self._write(counted, timer)
        touched = counted.merge(new[["whose", "start"]].drop_duplicates(), on=["whose", "start"])
        yield _shaped(pd.DataFrame({
            "kind": "rate", "ts": part["ts"].max(), "client": touched["whose"], "window_start": touched["start"].astype("datetime64[ms]"), "requests": touched["requests"], "processing": touched["processing"]}), RATE_ROW)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._expired(timerValues, expiredTimerInfo)
        return iter(())


def ops_stream(events: DataFrame, folder: str, ttl_minutes: int = jobs.TTL_MINUTES, delay: str = "10 minutes") -> dict[str, DataFrame]:
    """One query over one source of job events, and the five tables it writes: jobs, expired, stages, rates, late.

    ``events`` has the columns of ``job_states``' and ``client``, ``heavy`` (counts as processing), ``stage`` and ``mark`` (active, done,
    result, error). Jobs are folded first; their rows go on, with the watermark, to the fold of clients. Every epoch
    is written in one go, overwritten if it is replayed; the last row of a key stands. Late rows are kept, and each epoch's
    number of them is observed as ``late``.
    """
    spark = events.sparkSession
    _by_value(spark)
    # Late rows have to reach the fold, so its input has the event's time in a column that carries no watermark.
    flat = events.withWatermark("ts", delay).withColumn("at", F.timestamp_micros(F.unix_micros("ts")))
    flat = flat.select(*_job_input(flat, "at"), "job_id", "at", "seq", "client", F.coalesce("heavy", F.lit(False)).alias("heavy"), "stage", "mark")
    folded = flat.groupBy("slot").transformWithStateInPandas(statefulProcessor=OpsFold(ttl_minutes), outputStructType=OPS_ROW, outputMode="Append", timeMode="EventTime", eventTimeColumnName="ts")
    minutes = int(jobs.WINDOW.split()[0])
    # Rows without a client are spread by their job, so that no one task has them all.
    whose = F.coalesce("client", -1 - F.pmod(F.xxhash64("job_id"), F.lit(SPREAD))).alias("whose")
    rated = folded.select("*", whose).withColumn("slot", _slot("whose")).groupBy("slot").transformWithStateInPandas(statefulProcessor=RateFold(minutes), outputStructType=RATE_ROW, outputMode="Append", timeMode="EventTime")
    watched = rated.observe("ops", F.count_if(F.col("kind") == "late").alias("late"))

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/out/epoch={epoch}")

    query = watched.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    schema = T.StructType([*watched.schema.fields, T.StructField("epoch", T.IntegerType())])
    out = spark.read.schema(schema).option("basePath", f"{folder}/out").parquet(f"{folder}/out")

    def newest(kind: str, keys: list[str], columns: list[str]) -> DataFrame:
        rows = out.where(F.col("kind") == kind)
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), "epoch").alias("s")).select(*keys, "s.*")

    job = ["status", "step", "done", "total", "files", "bytes", "error", "created_us", "ended_us", "summary"]
    seconds = (F.unix_micros("ended") - F.unix_micros("started")) / 1e6
    rates = newest("rate", ["client", "window_start"], ["requests", "processing"])
    return {
        "jobs": _timed_jobs(newest("job", ["job_id"], job), "job_id", *job),
        "expired": _timed_jobs(newest("expired", ["job_id"], ["status", "ended_us"]), "job_id", "status", "ended_us").withColumn("expires_at", F.col("ended_at") + F.make_interval(mins=F.lit(ttl_minutes))),
        "stages": newest("stage", ["job_id", "stage"], ["started", "ended"]).withColumn("seconds", seconds),
        "rates": rates.withColumns({"over_all": F.col("requests") > jobs.API_LIMIT, "over_processing": F.col("processing") > jobs.PROCESSING_LIMIT}),
        "late": out.where("kind = 'late'").select("job_id", "client", "at", "seq", "epoch"),
    }


def clean_stream(docs: DataFrame, folder: str, rules=None) -> StreamingQuery:
    """Cleans arriving documents: the texts and the counts of every epoch, each written once."""
    def write(batch: DataFrame, epoch: int) -> None:
        cleaned = cleaning.clean_documents(batch, rules)
        cleaned.write.mode("overwrite").parquet(f"{folder}/texts/epoch={epoch}")

    return docs.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
