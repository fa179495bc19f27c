"""Text profiles and shares over a document table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as tx

MEASURES = ("characters", "characters_no_spaces", "words", "sentences", "paragraphs", "lines")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document with its counts: a projection, no shuffle."""
    t = F.col(text)
    return docs.select(
        "*",
        tx.characters(t).alias("characters"),
        tx.characters_no_spaces(t).alias("characters_no_spaces"),
        tx.words(t).alias("words"),
        tx.devanagari_words(t).alias("devanagari_words"),
        tx.sentences(t).alias("sentences"),
        tx.paragraphs(t).alias("paragraphs"),
        tx.filled_lines(t).alias("lines"),
    )


def text_profile(docs: DataFrame, by: list[str], text: str = "text", rollup: bool = True) -> DataFrame:
    """Counts per group, with subtotals and the corpus total when ``rollup`` (group columns null there)."""
    rows = measured(docs.select(*by, text), text)
    grouped = rows.rollup(*by) if rollup else rows.groupBy(*by)
    sums = [F.sum(m).alias(m) for m in MEASURES]
    out = grouped.agg(F.count(F.lit(1)).alias("documents"), *sums, F.sum("devanagari_words").alias("_dev"))
    minutes = (F.col("words") - F.col("_dev")) / tx.WPM_LATIN + F.col("_dev") / tx.WPM_DEVANAGARI
    return out.select(*by, "documents", *MEASURES, F.round(minutes, 4).alias("reading_minutes"))


def detect_language(df: DataFrame, by: list[str], text: str = "text", variant: str = "service") -> DataFrame:
    """Script letter counts per group and the language they imply.

    ``service``: under 5 % Devanagari is English, under 15 % Latin is Nepali, else mixed.
    ``engine``: any Devanagari counts; over 15 % Latin beside it is mixed.
    """
    if variant not in ("service", "engine"):
        raise ValueError(f"unknown variant: {variant}")
    counts = df.select(*by, tx.count(F.col(text), tx.DEVANAGARI).alias("d"), tx.count(F.col(text), "[A-Za-z]").alias("l"))
    sums = counts.groupBy(*by).agg(F.sum("d").cast("long").alias("devanagari"), F.sum("l").cast("long").alias("latin"))
    letters = F.col("devanagari") + F.col("latin")
    if variant == "service":
        language = (
            F.when(letters == 0, "unknown").when(F.col("devanagari") / letters < 0.05, "en").when(F.col("latin") / letters < 0.15, "ne").otherwise("mixed")
        )
    else:
        language = (
            F.when(letters == 0, "unknown").when((F.col("devanagari") > 0) & (F.col("latin") / letters > 0.15), "mixed")
            .when(F.col("devanagari") > 0, "ne").otherwise("en")
        )
    return sums.withColumn("language", language)


def block_language(text: Column) -> Column:
    devanagari, latin = text.rlike(tx.DEVANAGARI), text.rlike("[A-Za-z]")
    return F.when(devanagari & latin, "mixed").when(devanagari, "ne").otherwise("en")


def share_where(df: DataFrame, by: list[str], condition: Column, eligible: Column) -> DataFrame:
    """Share of the eligible rows that meet a condition (null where none is eligible)."""
    return df.groupBy(*by).agg(
        F.count_if(eligible).alias("eligible"),
        F.count_if(eligible & condition).alias("matching"),
    ).withColumn("share", F.round(F.col("matching") / F.nullif(F.col("eligible"), F.lit(0)), 6))


def detached_share(text: Column) -> Column:
    """Share of Devanagari words that begin with a sign cut off its letter."""
    found = F.transform(F.array(F.filter(tx.reading_words(text), lambda w: w.rlike(tx.DEVANAGARI))), lambda ws: F.when(
        F.size(ws) == 0, F.lit(0.0)).otherwise(F.size(F.filter(ws, lambda w: w.rlike(tx.DETACHED_SIGN))) / F.size(ws)))
    return F.when(text.rlike(tx.DEVANAGARI), F.element_at(found, 1)).otherwise(F.lit(0.0))


def dominant_value(df: DataFrame, by: list[str], value: str, ordinal: str) -> DataFrame:
    """The most common value per group; ties go to the value seen first.

    Counts are combined map-side and the winner is an aggregate, so a hot group costs one row per value.
    """
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), F.min(ordinal).alias("first_seen"))
    best = F.max(F.struct(F.col("n"), (-F.col("first_seen")).alias("o"), F.col(value).alias("v")))
    return counts.groupBy(*by).agg(best.alias("b"), F.sum("n").alias("total")).select(*by, F.col("b.v").alias(value), F.col("b.n").alias("n"), "total")


def few_values(df: DataFrame, by: list[str], column: str, cap: int = 400) -> DataFrame:
    """Whether a group holds at most ``cap`` distinct values, counted exactly up to ``cap + 1``.

    A sketch answers the clear cases; only groups near or below the cap are counted exactly, on
    distinct (group, value) pairs that were combined before the shuffle.
    """
    sketch = df.groupBy(*by).agg(F.approx_count_distinct(column, 0.02).alias("estimate"))
    near = sketch.filter(F.col("estimate") <= 2 * cap + 16)
    exact = df.select(*by, column).join(near.select(*by), by, "left_semi").groupBy(*by, column).agg(F.lit(1).alias("one")).groupBy(*by).agg(F.count(column).alias("exact"))
    joined = sketch.join(exact, by, "left")
    values = F.when(F.col("exact").isNotNull(), F.least(F.col("exact"), F.lit(cap + 1))).otherwise(F.lit(cap + 1)).cast("long")
    return joined.select(*by, values.alias("distinct_capped"), (values <= cap).alias("few"))
