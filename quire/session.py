"""Session settings the library relies on, and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "quire", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs expect; a cluster's own settings win where given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.files.maxPartitionBytes": "134217728",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def checkpoint_base(spark: SparkSession) -> str | None:
    """The shared folder the cluster names, from the session or its context."""
    return spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes a table once to the checkpoint folder and goes on from there, whatever executors are lost.

    The folder is the one in ``spark.checkpoint.dir``; only in local mode, where that is absent, is one of
    our own used.
    """
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(checkpoint_base(spark) or _local_folder(spark, "checkpoints"))
    return df.checkpoint(eager=True)


def _local_folder(spark: SparkSession, name: str) -> str:
    """A temporary folder, for local mode alone: on a cluster other machines would not see it."""
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix=f"spark-quire-{name}-", dir=os.environ.get("TMPDIR", "/tmp"))


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints: shared storage on a cluster, a temporary one in local mode where none is set."""
    import uuid

    base = checkpoint_base(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}" if base else _local_folder(spark, name) + "/data"


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the session's Python workers this package, once per application.

    Rules that run in Python are imported on the workers; started from elsewhere they would not find them.
    """
    import zipfile
    from pathlib import Path

    # Tables of pages are dealt out by document once; joins on more keys than that go on from there.
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-quire-package-")) / "quire_package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
