"""The given parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def utc(column: str):
    """A zone-less time of the files as the instant it is in UTC, whatever the session's zone."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(column)).cast("timestamp")


def events(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Events with ``ts`` as a timestamp: the files hold it without a zone, which a watermark refuses."""
    df = table(spark, sf_dir, "events")
    df = df.withColumn("ts", utc("ts"))
    return df.select(*columns) if columns else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartitions an input that arrives in fewer pieces than there are cores.

    A file with one row group is one task however many cores wait. Inputs of the size this library is
    meant for arrive in many more pieces than cores, and are left exactly as they are.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted, *keys) if df.rdd.getNumPartitions() < wanted else df


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents", *columns), *(["doc_id"] if "doc_id" in columns or not columns else []))
