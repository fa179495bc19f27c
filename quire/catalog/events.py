"""Sources over derived text, and job events made of the event table, as tables and as streams."""

from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import cleaning, jobs
from quire.sources import derive, readers
from quire.sources.tables import documents, events, spread, table
from quire.streaming import live
from quire.session import work_folder

PAGE = ["doc_id", "page_no"]


def rate_windows(spark, d):
    return jobs.rate_windows(events(spark, d, "user_id", "ts", "event_type"), "user_id", all_limit=2, processing_limit=1, processing=F.col("event_type") == "purchase").withColumn("window_start", F.unix_seconds("window_start"))


def rate_windows_stream(spark, d):
    stream = live.event_stream(spark, d, "events")
    rates = jobs.rate_windows(stream, "user_id", watermark="1 hour", all_limit=2, processing_limit=1, processing=F.col("event_type") == "purchase")
    out, _ = live.run_to_table(rates, "rates", "update", ["user_id", "window_start"])
    return out.withColumn("window_start", F.unix_seconds("window_start"))


def _job_events(df, *more):
    """Six events to a job: queued, started, progress, a file, facts, and an end (some fail, some go on)."""
    n, k = F.col("event_id"), F.col("event_id") % 6
    going = F.col("event_type") == "view"
    end = F.when(F.col("event_type") == "error", "failed").when(~going, "completed")
    v = F.floor("value").cast("int")
    return df.select(
        F.floor(n / 6).alias("job_id"), F.timestamp_seconds(1704067200 + n * 10).alias("ts"), n.alias("seq"), F.when(k == 0, "queued").when(k == 1, "processing").when(k == 5, end).alias("status"),
        F.when(k == 2, "reading").when((k == 5) & going, "saving").alias("step"), F.when((k == 2) | ((k == 5) & going), v).alias("done"), F.when((k == 2) | ((k == 5) & going), F.lit(500)).alias("total"),
        F.when(k == 3, F.struct(F.concat(F.lit("f"), n.cast("string")).alias("name"), (v * 100).cast("long").alias("size"))).alias("file"),
        F.when(k == 4, F.create_map(F.lit("pages"), v.cast("string"), F.lit("mode"), F.col("event_type"))).when(k == 1, F.create_map(F.lit("mode"), F.lit("early"), F.lit("start"), v.cast("string"))).alias("summary"),
        F.when((k == 5) & (F.col("event_type") == "error"), "PROCESSING_FAILED").alias("error"), *more)


def job_states(spark, d):
    s = jobs.job_states(_job_events(events(spark, d)))
    return s.select("job_id", "status", "step", "done", "total", "files", "bytes", "error", F.unix_seconds("created_at").alias("created"), F.unix_seconds("ended_at").alias("ended"), F.col("summary")["pages"].alias("pages"), F.col("summary")["mode"].alias("mode"), F.col("summary")["start"].alias("start"))


def job_states_stream(spark, d):
    out, _ = live.run_to_table(live.job_states(_job_events(live.event_stream(spark, d, "events"))), "jobs", "update", ["job_id", "event"])
    states = out.filter("event = 'state'")
    return states.select("job_id", "status", "step", "done", "total", "files", "bytes", "error", F.unix_seconds("created_at").alias("created"), F.unix_seconds("ended_at").alias("ended"), F.col("summary")["pages"].alias("pages"), F.col("summary")["mode"].alias("mode"), F.col("summary")["start"].alias("start"))


def job_states_late(spark, d):
    """The same from events that arrive out of order in several batches, ends before starts: a batch per rest of the number."""
    order = F.array_position(F.array(*[F.lit(i) for i in (4, 1, 5, 0, 3, 2)]), (F.col("event_id") * 7 % 6).cast("int")) - 1
    stream = _arriving(spark, d, order, 6)
    out, _ = live.run_to_table(live.job_states(_job_events(stream), delay="3650 days"), "jobs", "update", ["job_id", "event"])
    states = out.filter("event = 'state'")
    return states.select("job_id", "status", "step", "done", "total", "files", "bytes", "error", F.unix_seconds("created_at").alias("created"), F.unix_seconds("ended_at").alias("ended"), F.col("summary")["pages"].alias("pages"), F.col("summary")["mode"].alias("mode"), F.col("summary")["start"].alias("start"))


def job_states_handed_over(spark, d):
    """The first half of every job's events read as a table, the second as a stream that goes on from it."""
    early, rest = F.col("event_id") % 6 < 3, F.col("event_id") % 6 >= 3
    first = _job_events(events(spark, d).where(early))
    stream = _job_events(live.event_stream(spark, d, "events").where(rest))
    out, _ = live.run_to_table(live.job_states(stream, seed=live.job_seed(first)), "jobs", "update", ["job_id", "event"])
    states = out.filter("event = 'state'").drop("event")
    # Jobs that the stream says nothing of are as the table left them.
    quiet = jobs.job_states(first).join(states.select("job_id"), "job_id", "left_anti")
    both = states.unionByName(quiet.select(*[F.col(f.name).cast(f.dataType) for f in states.schema.fields]))
    return both.select("job_id", "status", "step", "done", "total", "files", "bytes", "error", F.unix_seconds("created_at").alias("created"), F.unix_seconds("ended_at").alias("ended"), F.col("summary")["pages"].alias("pages"), F.col("summary")["mode"].alias("mode"), F.col("summary")["start"].alias("start"))


def _ops_events(df):
    """Job events with who asked, whether it counts as processing, and two stages that begin and end."""
    k = F.col("seq") % 6
    stage = F.when(k.isin(1, 5), "work").when(k.isin(2, 3), "read")
    mark = F.when(k.isin(1, 2), "active").when((k == 3) | F.col("status").isin("completed", "failed"), "done")
    made = _job_events(df, F.col("user_id").alias("client"), (F.col("event_type") == "purchase").alias("heavy"))
    return made.withColumns({"mark": mark, "stage": F.when(mark.isNotNull(), stage)})


def _arriving(spark, d, batch, batches):
    """The event table as a stream of ``batches`` batches, each of several files; ``batch`` numbers them."""
    folder, files = work_folder(spark, "arriving"), 4
    rows = events(spark, d, "event_id", "event_type", "value", "ts", "user_id")
    for i in range(batches):
        rows.where(batch == i).repartition(files).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", str(files)).parquet(folder)


def _share(spark, d, parts):
    """Which of ``parts`` equal stretches of time an event lies in."""
    n = events(spark, d, "event_id").agg(F.max("event_id") + 1).first()[0] or 1
    return F.floor(F.col("event_id") * parts / n)


def ops_stream(spark, d):
    """One streaming query from events to job states, expired jobs, stages and rates, as one table of its tables."""
    stream = _ops_events(_arriving(spark, d, _share(spark, d, 6), 6))
    made = live.ops_stream(stream, work_folder(spark, "ops"))
    empty = {"key": "long", "status": "string", "step": "string", "done": "long", "files": "long", "bytes": "long", "begun": "long", "ended": "long", "seconds": "double"}

    def rows(kind, key, **columns):
        return made[kind].select(F.lit(kind).alias("kind"), F.col(key).alias("key"), *[columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in empty.items() if c != "key"])

    at = F.unix_seconds
    out = rows("jobs", "job_id", **{c: F.col(c) for c in ("status", "step", "done", "files", "bytes")}, begun=at("created_at"), ended=at("ended_at"))
    out = out.union(rows("expired", "job_id", status=F.col("status"), ended=at("expires_at")))
    out = out.union(rows("stages", "job_id", step=F.col("stage"), begun=at("started"), ended=at("ended"), seconds=F.col("seconds")))
    out = out.union(rows("rates", "client", begun=at("window_start"), done=F.col("requests"), files=F.col("processing")))
    return out.union(rows("late", "job_id", begun=at("at")))


def late_rows(spark, d):
    """Events that come after the watermark of their batch, kept with the epoch they came in: every seventh arrives a stretch of time too late."""
    share = _share(spark, d, 6)
    stream = _ops_events(_arriving(spark, d, share + F.when(F.col("event_id") % 7 == 3, 1).otherwise(0), 7))
    late = live.ops_stream(stream, work_folder(spark, "late"))["late"]
    return late.select("job_id", "client", F.unix_seconds("at").alias("at"), "seq", "epoch")


def expired_jobs(spark, d):
    s = jobs.job_states(_job_events(events(spark, d)))
    return jobs.expired(s, F.lit("2024-01-01 10:00:00Z").cast("timestamp")).select("job_id", "status", F.unix_seconds("expires_at").alias("expires"))


def _progress_lines(df):
    """Eight lines to a run: three stages begun and done (a few never), a blank, and a result or an error."""
    n, k = F.col("event_id"), F.col("event_id") % 8
    stage = F.element_at(F.array(*[F.lit(s) for s in ("prepare", "read", "layout")]), (F.floor(k / 2) + 1).cast("int"))
    row = lambda kind, **more: F.to_json(F.struct(F.floor(n / 8).alias("run_id"), F.timestamp_seconds(1704067200 + n * 7).alias("ts"), F.lit(kind).alias("type"), *[c.alias(a) for a, c in more.items()]))
    status = F.when(k % 2 == 0, "active").otherwise("done")
    line = F.when(k < 6, row("stage", stage=stage, status=status, detail=F.create_map(F.lit("lines"), F.floor("value").cast("string")))).when(k == 6, F.lit("  ")).when(F.col("event_type") == "error", row("error", code=F.lit("NO_TEXT"))).otherwise(row("result"))
    return df.filter(~((k % 2 == 1) & (k < 6) & (F.col("event_type") == "view"))).select(line.alias("value"))


def progress_events(spark, d):
    p = readers.parse_progress(_progress_lines(events(spark, d)))
    return p.select("run_id", F.unix_seconds("ts").alias("at"), "type", "stage", "status", F.col("detail")["lines"].alias("lines"), "code")


def stage_durations(spark, d):
    s = jobs.stage_durations(readers.parse_progress(_progress_lines(events(spark, d))))
    return s.select("run_id", "stage", F.unix_seconds("started").alias("started"), F.unix_seconds("ended").alias("ended"), "seconds", F.col("detail")["lines"].alias("lines"), "outcome")


def stage_durations_stream(spark, d):
    """Closed stages only: an open one is reported once the watermark passes, which a finished table may not reach."""
    lines = _progress_lines(live.event_stream(spark, d, "events"))
    out, _ = live.run_to_table(live.stage_durations(readers.parse_progress(lines)), "stages", "append")
    return out.filter("ended IS NOT NULL").select("run_id", "stage", F.unix_seconds("started").alias("started"), F.unix_seconds("ended").alias("ended"), "seconds")


def clean_stream(spark, d):
    folder = work_folder(spark, "cleaned")
    docs = live.event_stream(spark, d, "documents").select("doc_id", "lang", "text")
    live.clean_stream(spread_stream(docs), folder).awaitTermination()
    out = spark.read.option("basePath", f"{folder}/texts").parquet(f"{folder}/texts")
    return out.groupBy("lang").agg(*[F.sum(r).alias(r) for r in tx.CLEAN_RULES])


def spread_stream(df):
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, "doc_id")


def ocr_table(spark, d):
    """Word boxes written as the recogniser's tab-separated lines, and read back."""
    w = derive.page_words(spark, d)
    s = lambda c: F.col(c).cast("string")
    word = F.concat_ws("\t", F.lit("5"), F.lit("1"), s("block"), s("par"), s("line"), s("word_no"), s("x"), s("y"), s("w"), s("h"), F.when(F.col("word_no") % 9 == 8, "-1").otherwise((F.col("word_no") * 7 % 100).cast("string")), "text")
    lines = w.select(*PAGE, F.explode(F.when(F.col("word_no") == 0, F.array(F.lit("level\tpage"), F.concat_ws("\t", F.lit("4"), F.lit("1"), *[F.lit("0")] * 9, F.lit(" ")), word)).otherwise(F.array(word))).alias("value"))
    return readers.parse_ocr_tsv(lines, "value", PAGE)


def page_json(spark, d):
    """Conversations as page files: one JSON value each, read back into pages."""
    turns = table(spark, d, "conversations")
    page = F.struct((F.col("turn") + 1).cast("int").alias("page"), F.when(F.col("role") == "user", "text").otherwise("ocr").alias("method"), "text", F.struct(F.lit("ocr").alias("method"), F.upper("role").alias("text")).alias("alternative"), (F.col("turn") / 8).alias("confidence"))
    files = turns.groupBy("conv_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(page)).alias("pages"))).alias("value"))
    out = readers.parse_page_json(files, "value", ["conv_id"])
    return out.select("conv_id", "page", "method", "text", F.col("alternative.text").alias("other"), "reason", "confidence")


def _scenes(spark, d):
    n = F.col("event_id")
    view = F.when(n % 5 == 0, '{"scrollX":1,"scrollY":2,"zoom":0}').when(n % 5 == 1, '{"scrollX":1}').otherwise(F.concat(F.lit('{"scrollX":1.5,"scrollY":-2,"zoom":'), F.round("value").cast("int").cast("string"), F.lit("}")))
    raw = F.when(n % 11 == 0, "not json").when(n % 11 == 1, '{"version":2,"scene":"x"}').when(n % 11 == 2, '{"version":1,"scene":""}').otherwise(
        F.concat(F.lit('{"version":1,"savedAt":'), n.cast("string"), F.lit(',"scene":"'), "event_type", F.lit('","view":'), view, F.lit(',"name":"'), F.when(n % 3 == 0, "  ").otherwise("board"), F.lit('"}')))
    return events(spark, d, "event_id", "event_type", "value").select("event_id", raw.alias("raw"))


def checked_json(spark, d):
    good, _ = readers.checked_scenes(_scenes(spark, d), "raw")
    return good.select("event_id", F.col("r.savedAt").alias("saved_at"), F.col("r.scene").alias("scene"), F.col("r.view.zoom").alias("zoom"), F.col("r.name").alias("name"))


def quarantined_json(spark, d):
    _, bad = readers.checked_scenes(_scenes(spark, d), "raw")
    return bad.select("event_id", "raw")


def corpus_export(spark, d):
    return readers.document_texts(table(spark, d, "conversations", "conv_id", "turn", "text"), "conv_id", "turn", crlf=True)


def corpus_export_html(spark, d):
    from quire.functions import html as ht

    docs = documents(spark, d, "doc_id", "source", "text")
    return docs.select("doc_id", ht.document_html(F.col("source"), F.col("text"), F.lit("en")).alias("html"))


QUERIES = {f.__name__: f for f in (
    rate_windows, rate_windows_stream, job_states, job_states_stream, job_states_late, job_states_handed_over, ops_stream, late_rows, expired_jobs, progress_events, stage_durations, stage_durations_stream, clean_stream, ocr_table, page_json, checked_json, quarantined_json,
    corpus_export, corpus_export_html)}

from quire.catalog.layout import WORDS_SQL  # noqa: E402
from quire.catalog.text_cleaning import _D, clean_sql  # noqa: E402

_RATES = "SELECT user_id, (epoch(ts)::BIGINT // 900) * 900 AS window_start, count(*) AS requests, count(*) FILTER (event_type = 'purchase') AS processing, count(*) > 2 AS over_all, count(*) FILTER (event_type = 'purchase') > 1 AS over_processing FROM (SELECT user_id, event_type, ts FROM events) GROUP BY user_id, (epoch(ts)::BIGINT // 900) * 900".replace("epoch(ts)::BIGINT", "floor(epoch(ts))::BIGINT")
_JOBS = """WITH e AS (SELECT event_id // 6 AS job_id, event_id % 6 AS k, 1704067200 + event_id * 10 AS tm, floor(value)::INT AS v, event_type AS t FROM events),
j AS (SELECT job_id, max(tm) FILTER (k = 5 AND t <> 'view') AS ended, min(tm) AS created, max(k) AS kk, max(t) FILTER (k = 5) AS t5, max(v) FILTER (k = 2) AS v2, max(v) FILTER (k = 3) AS v3, max(v) FILTER (k = 4) AS v4, max(t) FILTER (k = 4) AS t4, max(v) FILTER (k = 1) AS v1, max(v) FILTER (k = 5) AS v5 FROM e GROUP BY job_id),
s AS (SELECT *, CASE WHEN t5 = 'error' THEN 'failed' WHEN t5 IS NOT NULL AND t5 <> 'view' THEN 'completed' WHEN kk >= 1 THEN 'processing' ELSE 'queued' END AS status FROM j),
o AS (SELECT job_id, status, CASE WHEN status = 'completed' THEN 'completed' WHEN t5 = 'view' THEN 'saving' WHEN kk >= 2 THEN 'reading' WHEN kk = 1 THEN 'starting' ELSE 'queued' END AS step, CASE WHEN t5 = 'view' THEN v5 WHEN kk >= 2 THEN v2 ELSE 0 END AS done, CASE WHEN kk >= 2 THEN 500 ELSE 0 END AS total,
  CASE WHEN status = 'failed' OR v3 IS NULL THEN 0 ELSE 1 END::BIGINT AS files, CASE WHEN status = 'failed' OR v3 IS NULL THEN 0 ELSE v3 * 100 END::BIGINT AS bytes, CASE WHEN status = 'failed' THEN 'PROCESSING_FAILED' END AS error, created, ended,
  v4::VARCHAR AS pages, CASE WHEN v4 IS NOT NULL THEN t4 WHEN kk >= 1 THEN 'early' END AS mode, v1::VARCHAR AS start FROM s)"""
_PROGRESS = """e AS (SELECT event_id // 8 AS run_id, event_id % 8 AS k, 1704067200 + event_id * 7 AS tm, floor(value)::BIGINT::VARCHAR AS v, event_type AS t FROM events WHERE NOT (event_id % 8 IN (1, 3, 5) AND event_type = 'view') AND event_id % 8 <> 6),
p AS (SELECT run_id, tm, CASE WHEN k < 6 THEN 'stage' WHEN t = 'error' THEN 'error' ELSE 'result' END AS type, CASE WHEN k < 6 THEN ['prepare', 'read', 'layout'][k // 2 + 1] END AS stage, CASE WHEN k < 6 THEN CASE WHEN k % 2 = 0 THEN 'active' ELSE 'done' END END AS status, CASE WHEN k < 6 THEN v END AS lines, CASE WHEN k = 7 AND t = 'error' THEN 'NO_TEXT' END AS code FROM e)"""
_STAGES = _PROGRESS + """, s AS (SELECT run_id, stage, min(tm) FILTER (status = 'active') AS started, max(tm) FILTER (status = 'done') AS ended, arg_max(lines, tm) AS lines FROM p WHERE type = 'stage' GROUP BY ALL), o AS (SELECT run_id, type AS outcome FROM p WHERE type <> 'stage')"""
_SCENE = """s AS (SELECT event_id, event_type, value, event_id % 11 AS a, event_id % 5 AS b FROM events)"""

ORACLE = {
    "rate_windows": _RATES,
    "rate_windows_stream": _RATES,
    "job_states": _JOBS + " SELECT * FROM o",
    "job_states_stream": _JOBS + " SELECT * FROM o",
    "job_states_late": _JOBS + " SELECT * FROM o",
    "job_states_handed_over": _JOBS + " SELECT * FROM o",
    "ops_stream": _JOBS + """, w AS (SELECT max(tm) - 600 AS edge FROM e),
g AS (SELECT job_id, 'work' AS step, max(tm) FILTER (k = 1) AS begun, max(tm) FILTER (k = 5 AND t <> 'view') AS ended FROM e GROUP BY job_id UNION ALL SELECT job_id, 'read', max(tm) FILTER (k = 2), max(tm) FILTER (k = 3) FROM e GROUP BY job_id),
r AS (SELECT user_id, tm // 900 * 900 AS begun, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS heavy FROM (SELECT user_id, event_type, 1704067200 + event_id * 10 AS tm FROM events) GROUP BY ALL)
SELECT 'jobs' AS kind, job_id AS key, status, step, done::BIGINT AS done, files, bytes, created AS begun, ended, NULL::DOUBLE AS seconds FROM o
UNION ALL SELECT 'expired', job_id, status, NULL, NULL, NULL, NULL, NULL, ended + 1800, NULL FROM o, w WHERE ended + 1800 <= edge
UNION ALL SELECT 'stages', job_id, NULL, step, NULL, NULL, NULL, begun, ended, (ended - begun)::DOUBLE FROM g WHERE begun IS NOT NULL OR ended IS NOT NULL
UNION ALL SELECT 'rates', user_id, NULL, NULL, n, heavy, NULL, begun, NULL, NULL FROM r""",
    "late_rows": """WITH n AS (SELECT max(event_id) + 1 AS n FROM events),
e AS (SELECT event_id, user_id, 1704067200 + event_id * 10 AS tm, event_id * 6 // n + CASE WHEN event_id % 7 = 3 THEN 1 ELSE 0 END AS b FROM events, n),
m AS (SELECT b, max(max(tm)) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 600 AS edge FROM e GROUP BY b)
SELECT event_id // 6 AS job_id, user_id AS client, tm AS "at", event_id AS seq, e.b::INTEGER AS epoch FROM e JOIN m ON e.b = m.b WHERE tm < edge""",
    "expired_jobs": _JOBS + " SELECT job_id, status, ended + 1800 AS expires FROM o WHERE ended + 1800 <= epoch(TIMESTAMP '2024-01-01 10:00:00')",
    "progress_events": f"WITH {_PROGRESS} SELECT run_id, tm AS \"at\", type, stage, status, lines, code FROM p",
    "stage_durations": f"WITH {_STAGES} SELECT s.run_id, stage, started, ended, (ended - started)::DOUBLE AS seconds, lines, outcome FROM s LEFT JOIN o USING (run_id)",
    "stage_durations_stream": f"WITH {_STAGES} SELECT run_id, stage, started, ended, (ended - started)::DOUBLE AS seconds FROM s WHERE started IS NOT NULL AND ended IS NOT NULL",
    "clean_stream": clean_sql(_D, cleaning.ALL_RULES) + " SELECT lang, " + ", ".join(f'sum("{r}")::BIGINT AS "{r}"' for r in tx.CLEAN_RULES) + " FROM cleaned JOIN documents ON doc_id = key GROUP BY lang",
    "ocr_table": f"WITH {WORDS_SQL} SELECT doc_id, page_no, block, par, line, word_no, x, y, w, h, CASE WHEN word_no % 9 = 8 THEN 0 ELSE word_no * 7 % 100 / 100 END::DOUBLE AS conf, text FROM pw",
    "page_json": "SELECT conv_id, (turn + 1)::INT AS page, CASE WHEN role = 'user' THEN 'text' ELSE 'ocr' END AS method, text, upper(role) AS other, NULL::VARCHAR AS reason, turn / 8 AS confidence FROM conversations",
    "checked_json": f"WITH {_SCENE} SELECT event_id, event_id::DOUBLE AS saved_at, event_type AS scene, CASE WHEN b > 1 AND round(value)::INT > 0 THEN round(value)::INT::DOUBLE END AS zoom, CASE WHEN event_id % 3 <> 0 THEN 'board' END AS name FROM s WHERE a > 2",
    "quarantined_json": f"""WITH {_SCENE} SELECT event_id, CASE a WHEN 0 THEN 'not json' WHEN 1 THEN '{{"version":2,"scene":"x"}}' ELSE '{{"version":1,"scene":""}}' END AS raw FROM s WHERE a <= 2""",
    "corpus_export": "SELECT conv_id, replace(string_agg(text, chr(10) || chr(10) ORDER BY turn), chr(10), chr(13) || chr(10)) AS text FROM conversations GROUP BY conv_id",
    "corpus_export_html": r"""WITH p AS (SELECT doc_id, source, list_transform(string_split_regex(text, '\n\n+'), lambda v: '<p>' || replace(replace(replace(replace(v, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '<br>') || '</p>') AS ps FROM documents)
SELECT doc_id, '<!doctype html>' || chr(10) || '<html lang="en">' || chr(10) || '<head><meta charset="utf-8"><title>' || source || '</title></head>' || chr(10) || '<body>' || chr(10) || array_to_string(ps, '') || chr(10) || '</body>' || chr(10) || '</html>' || chr(10) AS html FROM p""",
}
