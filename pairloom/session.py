"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "pairloom", cores: str | int = "*", shuffle_partitions: int = 8,
                  memory: str = "12g") -> SparkSession:
    """A session for tests and benches.  On a cluster the submitter's session is used as it is."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def scratch_folder(spark: SparkSession) -> str:
    """A new folder name in the shared checkpoint folder, or (local runs only) in the machine's temporary folder."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        folder = tempfile.mkdtemp(prefix="pairloom-")
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}"


def spread(df: DataFrame, key: str) -> DataFrame:
    """Costly per-row work on an input with fewer splits than cores: hash it over the cores first.

    Large inputs have enough splits and are left as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder the cluster names in spark.checkpoint.dir.

    Only a local run (tests, bench) may fall back to a folder of its own.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a shared folder")
            folder = tempfile.mkdtemp(prefix="pairloom-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """The rows written once as Parquet in the shared folder and read back: for large tables of few columns that are read several times."""
    spark = df.sparkSession
    folder = scratch_folder(spark)
    df.write.partitionBy(*partition_by).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def bucketed(df: DataFrame, buckets: int, key: str, *partition_by: str) -> DataFrame:
    """The rows written once in the shared folder in hash buckets of a key: joins and groups by it read them without a shuffle.

    Rows that are dealt by the key into as many parts make one file a bucket.
    """
    spark = df.sparkSession
    name = f"pairloom_{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).bucketBy(buckets, key).option("path", scratch_folder(spark)).saveAsTable(name)
    return spark.table(name)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """While an action runs inside, batches for Python hold at most so many rows: bounds the memory of wide rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
