"""Readers with fixed schemas. Each has a form over a column, for text that is already in a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import html as ht
from quire.functions import text as tx
from quire.operators.assets import with_format

# --- fixed values ---
TSV_COLUMNS = 12
TEXT_EXTENSIONS = r"\.(txt|md|markdown|html?)$"
SCENE_VERSION = 1
# --------------------

READING = T.StructType([T.StructField("method", T.StringType()), T.StructField("text", T.StringType())])
PAGE = T.StructType([
    T.StructField("page", T.IntegerType()), T.StructField("method", T.StringType()), T.StructField("text", T.StringType()), T.StructField("alternative", READING),
    T.StructField("reason", T.StringType()), T.StructField("note", T.StringType()), T.StructField("confidence", T.DoubleType())])
PAGES = T.StructType([T.StructField("pages", T.ArrayType(PAGE))])
PROGRESS = T.StructType([
    T.StructField("run_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("type", T.StringType()), T.StructField("stage", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("detail", T.MapType(T.StringType(), T.StringType())), T.StructField("code", T.StringType())])
SCENE = T.StructType([
    T.StructField("version", T.LongType()), T.StructField("savedAt", T.DoubleType()), T.StructField("scene", T.StringType()),
    T.StructField("view", T.StructType([T.StructField(n, T.DoubleType()) for n in ("scrollX", "scrollY", "zoom")])), T.StructField("name", T.StringType())])


def asset_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Files under a path with their real format; the bytes are dropped in the scan's own stage."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return with_format(files.select("path", F.col("length").alias("size"), "modificationTime", "content"))


def parse_ocr_tsv(rows: DataFrame, line: str, keys: list[str]) -> DataFrame:
    """Tab-separated recogniser output: one row per word, confidences 0 to 1. A tab inside the text stays."""
    cells = F.split(line, "\t", TSV_COLUMNS)
    part = lambda i: F.get(F.col("_c"), F.lit(i))
    df = rows.select(*keys, cells.alias("_c")).filter((F.size("_c") == TSV_COLUMNS) & (part(0) == "5"))
    text = tx.strip(part(11))
    return df.select(
        *keys, *[part(i).cast("int").alias(n) for i, n in ((2, "block"), (3, "par"), (4, "line"), (5, "word_no"))],
        *[part(i).cast("double").alias(n) for i, n in ((6, "x"), (7, "y"), (8, "w"), (9, "h"))],
        (F.greatest(F.lit(0.0), part(10).cast("double")) / 100).alias("conf"), text.alias("text")).filter("text <> ''")


def parse_page_sizes(rows: DataFrame, line: str, keys: list[str]) -> DataFrame:
    cells = F.split(line, "\t", TSV_COLUMNS)
    df = rows.select(*keys, cells.alias("_c")).filter((F.size("_c") == TSV_COLUMNS) & (F.get(F.col("_c"), F.lit(0)) == "1"))
    return df.select(*keys, F.get(F.col("_c"), F.lit(8)).cast("double").alias("width"), F.get(F.col("_c"), F.lit(9)).cast("double").alias("height"))


def read_ocr_tsv(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return parse_ocr_tsv(lines, "value", ["file"])


def flatten_pages(df: DataFrame, pages: Column, keys: list[str]) -> DataFrame:
    return df.select(*keys, F.explode(pages).alias("p")).select(*keys, "p.*")


def read_page_json(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(PAGES).option("multiLine", "true").json(path).withColumn("file", F.col("_metadata.file_path"))
    return flatten_pages(df, F.col("pages"), ["file"])


def parse_page_json(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    return flatten_pages(df, F.from_json(column, PAGES)["pages"], keys)


def read_text_corpus(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """Text, Markdown and HTML files, line ends normalised, HTML as its text; ``problem`` says why a file is refused.

    Other kinds of files, and with ``max_bytes`` larger ones, come without a text.
    """
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("text"))
    name = F.lower("path")
    problem = F.when(~name.rlike(TEXT_EXTENSIONS), "not a text file")
    if max_bytes is not None:
        problem = problem.when(F.col("size") > max_bytes, "too large")
    files = files.withColumn("problem", problem).withColumn("text", F.when(F.col("problem").isNull(), F.col("text")))
    is_html = name.rlike(r"\.html?$")
    return files.withColumn("text", tx.unix_lines(F.when(is_html, ht.html_text(F.col("text"))).otherwise(F.col("text"))))


def parse_progress(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON lines of a run's progress; blank lines are skipped. Works on a stream as on a table."""
    return lines.filter(tx.strip(F.col(column)) != "").select(F.from_json(column, PROGRESS).alias("e")).select("e.*")


def read_progress(spark: SparkSession, path: str, stream: bool = True) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return parse_progress(reader.text(path))


def read_checked_json(df: DataFrame, column: str, schema: T.StructType, required: Column, optional: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Good rows with the parsed record ``r``, and the rows refused.

    ``required`` is a condition on ``r``; an ``optional`` field whose condition fails becomes null and the
    row stays.
    """
    parsed = df.withColumn("r", F.from_json(column, schema, {"mode": "PERMISSIVE"}))
    ok = F.coalesce(F.col("r").isNotNull() & required, F.lit(False))
    good = parsed.filter(ok)
    for name, condition in optional.items():
        value = F.when(F.coalesce(condition, F.lit(False)), F.col(f"r.{name}"))
        good = good.withColumn("r", F.col("r").withField(name, value))
    return good, parsed.filter(~ok).drop("r")


def checked_scenes(df: DataFrame, column: str, title: int | None = 200) -> tuple[DataFrame, DataFrame]:
    """Saved boards: version 1 with a non-empty scene; a broken view is dropped, a title is kept to ``title`` characters (none: whole)."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    view = F.col("r.view")
    good, bad = read_checked_json(
        df, column, SCENE, (F.col("r.version") == SCENE_VERSION) & (F.length("r.scene") > 0),
        {"view": finite(view["scrollX"]) & finite(view["scrollY"]) & finite(view["zoom"]) & (view["zoom"] > 0), "name": tx.strip(F.col("r.name")) != ""})
    r = F.col("r").withField("savedAt", F.coalesce("r.savedAt", F.lit(0.0))).withField("name", F.substring("r.name", 1, title) if title else F.col("r.name"))
    return good.withColumn("r", r), bad


def document_texts(pages: DataFrame, doc: str, page: str, text: str = "text", crlf: bool = False) -> DataFrame:
    """One text per document, pages joined by a blank line. One document's text is one value."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(page, F.col(text).alias("t")))), lambda p: p["t"])
    out = F.array_join(parts, "\n\n")
    return pages.groupBy(doc).agg((F.replace(out, F.lit("\n"), F.lit("\r\n")) if crlf else out).alias("text"))


def write_corpus(df: DataFrame, path: str, fmt: str, partition: str | None = None, mode: str = "errorifexists") -> None:
    """Writes texts: ``txt`` (one file line per text line, CRLF), ``json`` or ``html`` (whole pages in a column)."""
    if fmt not in ("txt", "json", "html"):
        raise ValueError(f"unknown format: {fmt}")
    if fmt == "txt":
        columns = [F.replace("text", F.lit("\n"), F.lit("\r\n")).alias("text")]
    elif fmt == "html":
        lang = F.when(F.col("text").rlike(tx.DEVANAGARI), "ne").otherwise("en")
        columns = [ht.document_html(F.col("title"), F.col("text"), lang).alias("text")]
    else:
        columns = [c for c in df.columns if c != partition]
    writer = df.select(*([partition] if partition else []), *columns).write.mode(mode)
    if partition:
        writer = writer.partitionBy(partition)
    writer.json(path) if fmt == "json" else writer.text(path, lineSep="\r\n" if fmt == "txt" else "\n")
