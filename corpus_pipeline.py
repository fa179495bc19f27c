"""A corpus made ready for training, stage by stage.

Every stage takes (spark, docs, sf_dir) and returns a table that is written before the next one reads it. All but the
last return the columns of ``docs``; the last adds the token ids. Each handles null ids and texts, repeated rows,
empty tables and further columns as its operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import mixing, pieces, quality_rules, queries, simhash, substring_dedup
from quire.llm.common import save
from quire.session import ship


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or that the list learned from the labels rejects go."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near copies (five-word shingles, a similarity of 0.8) link, one stays: the smallest id."""
    return simhash.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has are cut out of later ones."""
    cut = substring_dedup.drop_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else cut.select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document taken several times is as many rows."""
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with ``n_tokens`` and ``same`` (decoding gives the text back)."""
    return pieces.round_trip(docs, pieces.load(queries.MODEL))


STAGES = [
    ("quality rules", good_documents),
    ("simhash near-dedup", one_of_near_copies),
    ("substring dedup", without_repeats),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]

#: SQL cannot express the stages; tests compare them with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
