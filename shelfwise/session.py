"""Session settings used by the bench, the tests and batch jobs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession

# Joins on (customer, article) may reuse a shuffle on customer alone, so the
# wide per-customer frames are exchanged once and not once per joined table.
CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"
#: Spark 4.1 and later; an older one passes over it.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Of saved tables: a quarter smaller than by default.
COMPRESSION = "zstd"
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    CO_PARTITION: "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


def build_session(master: str | None = None, app: str = "shelfwise", **extra: str) -> SparkSession:
    """Create a session with :data:`SETTINGS`; ``extra`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; make one only for a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="shelfwise-checkpoint-")
    sc.setCheckpointDir(folder)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: one computation, read by all later branches, safe on executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def conf_set(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings of the session while a query runs inside; keys use ``__`` for dots."""
    names = {key.replace("__", "."): value for key, value in values.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


@contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """A query planned and run inside exchanges rows dealt by customer once, whatever session it is given, and leaves
    no shuffle files behind; else they stay until the driver collects its garbage."""
    with conf_set(spark, **{CO_PARTITION: "false", CLEANUP: "true"}):
        yield


def _new_folder(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """One computation, read by all later branches, as a Parquet table in the checkpoint folder: far smaller than a
    checkpoint, whose rows are neither compressed nor read by column."""
    path = _new_folder(df.sparkSession)
    with lean(df.sparkSession):
        df.write.parquet(path, compression=COMPRESSION)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_by(df: DataFrame, key: str, **derived: Column) -> DataFrame:
    """The same, dealt into buckets by ``key``: later grouping and windows by it, alone or with other columns,
    exchange no rows. A bucket is one file, sorted by the key. ``derived`` columns are computed of the dealt rows, so they do not travel."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = _new_folder(spark)
    name = f"by_{key}_{path[-32:]}"
    dealt = df.repartition(n, key).withColumns(derived)
    with lean(spark):
        dealt.write.format("parquet").bucketBy(n, key).sortBy(key).options(path=path, compression=COMPRESSION).saveAsTable(name)
    return spark.table(name)
