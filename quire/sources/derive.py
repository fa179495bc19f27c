"""Tables derived from the given ones, for operators whose own input the given tables do not hold.

Everything is an expression of the given rows, so the derived tables grow with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import html as ht
from quire.plans.folds import task_count
from quire.sources.tables import documents, spread, table

PAGE_LINES = 50
#: Parts that a piece of the documents is dealt into: its words and boxes take many times the room of its texts.
PIECES = 8


def wrapped(text: Column) -> Column:
    """Lines cut at the last space between 40 and 59 characters."""
    return F.regexp_replace(text, r"([^\n]{40,59}) ", "$1\n")


def wrapped_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, "doc_id", "text").select("doc_id", wrapped(F.col("text")).alias("text"))


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "pages", "page_id", "html"), "page_id")
    return pages.select("page_id", ht.html_text(F.col("html")).alias("text"))


def page_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages with a text layer, some in a legacy font, some part Devanagari; beside them empty and short pages."""
    n = F.col("doc_id")
    text = F.when(n % 5 == 2, F.concat(F.lit("पृष्ठ\n"), "text")).otherwise(F.col("text"))
    fonts = F.when(n % 7 == 3, F.array(F.lit("Helvetica"), F.lit("ABCDEF+Preeti"))).otherwise(F.array(F.lit("Helvetica")))
    docs = documents(spark, sf_dir, "doc_id", "source", "text")
    more = docs.filter(n % 11 < 2).select((-n - 1).alias("doc_id"), "source", F.when(n % 11 == 0, "").otherwise(F.concat(F.lit("p "), n.cast("string"))).alias("text"))
    return docs.select("doc_id", "source", text.alias("text")).unionByName(more).select("doc_id", "source", "text", (F.abs(n) % 3).cast("int").alias("images"), fonts.alias("fonts"))


def second_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second reading of the documents' pages: far off for some, slightly off for the rest; none of the added ones."""
    n = F.col("doc_id")
    text = F.when(n % 13 == 5, F.regexp_replace("text", "[aeiou]", "x")).otherwise(F.regexp_replace("text", "the", "tbe"))
    docs = documents(spark, sf_dir, "doc_id", "text")
    return docs.select("doc_id", text.alias("ocr_text"), ((n % 50 + 50) / 100).alias("confidence"))


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrapped documents set on pages of 50 lines: 6 wide, 20 apart, 14 more after every eighth line.

    Documents are dealt out by their id and their pages put in order while they are texts, so that what is made of them
    (lines, words, characters) lies together by page, in order, and needs no shuffle of its own.
    """
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    docs = docs.repartition(max(task_count(docs), PIECES * docs.rdd.getNumPartitions()), "doc_id")
    lines = docs.select("doc_id", F.split(wrapped(F.col("text")), "\n").alias("ls"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("ls") - 1, F.lit(0)), F.lit(PAGE_LINES))
    pages = lines.select("doc_id", F.explode_outer(F.transform(starts, lambda s: F.struct(s.alias("first"), F.slice(F.col("ls"), s + 1, PAGE_LINES).alias("ls")))).alias("p"))
    pages = pages.select("doc_id", (F.floor(F.col("p.first") / PAGE_LINES) + 1).cast("int").alias("page_no"), F.col("p.first").alias("first"), F.col("p.ls").alias("ls")).sortWithinPartitions("doc_id", "page_no")
    lines = pages.select("doc_id", "page_no", "first", F.posexplode_outer("ls").alias("line_no", "text"))
    l, i = F.col("line_no"), F.col("first") + F.col("line_no")
    h = F.when(l == 0, 22.0).when(l % 16 == 8, 16.0).otherwise(12.0)
    return lines.filter("text <> ''").select(
        "doc_id", "page_no", "line_no", F.floor(l / 8).cast("int").alias("block"),
        F.when(i % 5 == 4, 50.0).otherwise(30.0).alias("x"), (20.0 * l + 14.0 * F.floor(l / 8)).alias("y"), (6.0 * F.length("text")).alias("w"), h.alias("h"), "text")


def page_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of those lines with boxes and a confidence; some sit high enough to touch the line above."""
    from quire.operators.layout import word_boxes

    words = word_boxes(page_lines(spark, sf_dir), ["doc_id", "page_no", "line_no", "block"])
    n = F.col("doc_id") * 31 + F.col("line_no") * 17 + F.col("word_no") * 7
    high = F.when(n % 37 == 0, 11.0).otherwise(0.0)
    return words.select(
        "doc_id", "page_no", "block", F.lit(0).alias("par"), F.col("line_no").alias("line"), "word_no",
        "x", (F.col("y") - high).alias("y"), "w", "h", ((n % 97) / 97).alias("conf"), "text")


def page_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions over the blocks of those pages: one per block, a second and competing one over every other block."""
    labels = F.array(*[F.lit(v) for v in ("text", "paragraph_title", "table", "doc_title", "figure_title", "image", "header", "number")])
    blocks = page_lines(spark, sf_dir).select("doc_id", "page_no", "block").distinct()
    n = F.col("doc_id") * 7 + F.col("page_no") * 3 + F.col("block") * 5
    twice = F.explode(F.when(F.col("block") % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = blocks.withColumn("copy", twice)
    return rows.select(
        "doc_id", "page_no", (F.col("block") * 2 + F.col("copy")).alias("region_no"),
        F.element_at(labels, ((n + F.col("copy") * 3) % 8 + 1).cast("int")).alias("label"), ((n * 3 + F.col("copy")) % 10 / 10).alias("score"),
        (20.0 + 5.0 * F.col("copy")).alias("x"), (174.0 * F.col("block") - 4.0).alias("y"), (400.0 - 20.0 * F.col("copy")).alias("w"), F.lit(168.0).alias("h"))


def pdf_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words as a PDF gives them: edges and a type size."""
    w = page_words(spark, sf_dir)
    return w.select(
        "doc_id", "page_no", (F.col("line") * 10000 + F.col("word_no")).cast("int").alias("word_no"), "text", F.col("x").alias("x0"), (F.col("x") + F.col("w")).alias("x1"),
        F.col("y").alias("top"), (F.col("y") + F.col("h")).alias("bottom"), F.col("h").alias("size"))


def page_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of the lines in PDF coordinates (upwards), bold in stretches of 15, a line feed after each line."""
    lines = page_lines(spark, sf_dir).select("doc_id", "page_no", "line_no", "x", "y", "h", F.posexplode_outer(F.split(F.concat("text", F.lit("\n")), "")).alias("p", "ch"))
    return lines.filter("ch <> ''").select(
        "doc_id", "page_no", (F.col("line_no") * 1000000 + F.col("p")).alias("char_no"), "ch", (F.col("x") + 6.0 * F.col("p")).alias("l"), (F.col("x") + 6.0 * F.col("p") + 6.0).alias("r"),
        (1200.0 - F.col("y") - F.col("h")).alias("b"), (1200.0 - F.col("y")).alias("t"), F.col("h").alias("size"),
        ((F.col("line_no") + F.floor(F.col("p") / 15)) % 3 == 0).alias("bold"), F.lit(False).alias("italic"), F.lit("#000000").alias("colour"))


def line_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The characters of ``page_chars``, those of a line in one row: what differs between them as arrays."""
    lines = page_lines(spark, sf_dir).select("doc_id", "page_no", "line_no", "x", "y", "h", F.split(F.concat("text", F.lit("\n")), "").alias("ch"))
    places = F.sequence(F.lit(0), F.size("ch") - 1)
    each = lambda value: F.transform(places, value)
    return lines.select(
        "doc_id", "page_no", (F.col("line_no") * 1000000).alias("char_no"), "ch", each(lambda p: F.col("x") + 6.0 * p).alias("l"), each(lambda p: F.col("x") + 6.0 * p + 6.0).alias("r"),
        (1200.0 - F.col("y") - F.col("h")).alias("b"), (1200.0 - F.col("y")).alias("t"), F.col("h").alias("size"),
        each(lambda p: (F.col("line_no") + F.floor(p / 15)) % 3 == 0).alias("bold"), F.lit(False).alias("italic"), F.lit("#000000").alias("colour"))


def rule_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under every line pieces of a rule: eight with gaps under every sixth line, else two that touch."""
    n = F.col("line_no") % 6 == 0
    rows = page_lines(spark, sf_dir).select("doc_id", "page_no", "line_no", "x", "y", "h", F.explode(F.sequence(F.lit(0), F.when(n, 7).otherwise(1))).alias("i"))
    step, size = F.when(n, 6.0).otherwise(40.0), F.when(n, 4.0).otherwise(40.0)
    return rows.select(
        "doc_id", "page_no", F.lit("h").alias("dir"), (F.col("y") + F.col("h") + 1).alias("pos"), (F.col("x") + step * F.col("i")).alias("a"), (F.col("x") + step * F.col("i") + size).alias("b"),
        (0.5 + F.col("i") % 3).alias("thick"), F.lit("000000").alias("colour"))


def frame_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames around blocks: every third lacks its left side, every fourth holds a smaller frame."""
    blocks = page_lines(spark, sf_dir).select("doc_id", "page_no", "block").distinct()
    inner = F.explode(F.when(F.col("block") % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("inner")
    b = blocks.select("*", inner)
    x0, x1 = 20.0 + 10 * F.col("inner"), 420.0 - 30 * F.col("inner")
    y0, y1 = 174.0 * F.col("block") - 5 + 10 * F.col("inner"), 174.0 * F.col("block") + 160 - 30 * F.col("inner")
    row = lambda n, d, pos, a, e: F.struct(F.lit(n).alias("n"), F.lit(d).alias("dir"), pos.alias("pos"), a.alias("a"), e.alias("b"))
    sides = F.array(row(0, "h", y0, x0, x1), row(1, "h", y1, x0 + 1, x1 + 1), row(2, "v", x1, y0, y1), row(3, "v", x0, y0, y1))
    rows = b.select("doc_id", "page_no", "block", "inner", F.explode(sides).alias("s")).filter(~((F.col("block") % 3 == 1) & (F.col("s.n") == 3)))
    return rows.select(
        "doc_id", "page_no", (F.col("block") * 8 + F.col("inner") * 4 + F.col("s.n")).alias("ordinal"), "s.dir", "s.pos", "s.a", "s.b",
        (0.5 + F.col("block") % 3).alias("thick"), F.lit("333333").alias("colour"))
