"""What the operators of this folder share: written intermediates, row order of ids, Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.session import work_folder

#: A null id stands after every other id.
LAST = 2**63 - 1
#: Settings of the Arrow batches while a table is written.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "2m"}
#: Bytes of a batch that a rule sees at a time.
PART = 2 << 20


def save(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Writes a table once to the shared folder and reads it from there, whatever executors are lost.

    Rows go to Python rules in small Arrow batches meanwhile, since what both sides hold of a batch lies outside the heap.
    What was shuffled for it can go: the driver's garbage is collected, so that Spark drops those files.
    The folder goes when the session ends.
    """
    spark = df.sparkSession
    folder = work_folder(spark, name)
    writer = df.write.option("compression", "zstd")
    before = {name: spark.conf.get(name) for name in BATCHES}
    try:
        for name, value in BATCHES.items():
            spark.conf.set(name, value)
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(folder)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    schema = df.schema
    del df, writer
    gc.collect()
    jvm.System.gc()
    return spark.read.schema(schema).parquet(folder)


def discard(*saved: DataFrame) -> None:
    """Deletes what ``save`` has written, once nothing will read it again."""
    for table in saved:
        jvm, conf = table.sparkSession.sparkContext._jvm, table.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {name.rpartition("/")[0] for name in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def order_id(column: str) -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(LAST))


def _trim() -> None:
    """Gives back the memory that the C library keeps of freed arrays, where it can be told to."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        gc.collect()
        trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after each of whose batches the worker gives back the memory that Arrow keeps for later ones, and at the end what C keeps.

    A worker lives on beside the heap while other tasks run.
    """
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = pa.default_memory_pool()
        for out in run(batches):
            yield out
            del out
            pool.release_unused()
        pool.release_unused()
        _trim()

    return walk


def map_batches(df: DataFrame, rule: Callable[[pa.RecordBatch], dict | None], schema: str | T.StructType) -> DataFrame:
    """``rule`` turns an Arrow batch into the columns of the result (None: no rows).

    A large batch is handed over in parts, so that what a rule holds at a time is bounded by ``PART`` bytes or one row.
    """
    shape = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, whole.num_rows * PART // max(PART, whole.nbytes))
            for batch in (whole.slice(at, step) for at in range(0, max(1, whole.num_rows), step)):
                columns = rule(batch)
                if columns is not None:
                    arrays = [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip((columns[f.name] for f in arrow), arrow)]
                    yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(released(run), shape)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list<long> column as (row number of each value, value); null lists are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    parents = np.asarray(pc.list_parent_indices(column))
    values = pc.list_flatten(column).to_numpy(zero_copy_only=False)
    return parents.astype(np.int64), values.astype(np.int64, copy=False)
