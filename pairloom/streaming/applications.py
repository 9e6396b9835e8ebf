"""Application state and activity counts as streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pairloom.operators.applications import application_state
from pairloom.sources.keyed import KeyedTable


def read_events(spark: SparkSession, table: str, schema, files_per_batch: int = 1) -> DataFrame:
    """The files of a table as they arrive, whether it is one file or a folder of many."""
    # A stream takes a plain path for a folder; a pattern may match either.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{table[:-1]}[{table[-1]}]")


def application_state_stream(events: DataFrame, key: str = "application_id", at: str = "ts", tie: str = "event_id",
                             stage: str = "stage") -> DataFrame:
    """The batch fold, kept up to date in update mode: state per application is one row, whatever the order of arrival."""
    return application_state(events, key, at, tie, stage)


def activity_counts(events: DataFrame, at: str = "ts", kind: str = "event_type", window: str = "1 day") -> DataFrame:
    """(day, type, n, total value); also usable on a batch table."""
    return events.groupBy(F.window(at, window).alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(
        F.col("w.start").alias("day"), kind, "n", "value")


def activity_counts_stream(events: DataFrame, at: str = "ts", kind: str = "event_type", window: str = "1 day",
                           late: str = "1 hour") -> DataFrame:
    """Append mode: a day is emitted once the watermark has passed it; rows later than that are dropped."""
    timed = events.withColumn(at, F.col(at).cast("timestamp"))  # a watermark needs a time-zoned timestamp
    return activity_counts(timed.withWatermark(at, late), at, kind, window)


def write_state(stream: DataFrame, table_path: str, checkpoint: str, keys: Sequence[str] = ("application_id",), buckets: int = 32) -> StreamingQuery:
    """Each micro-batch's changed rows replace those of their keys in one table with a row per key.

    Rows carry their batch number, and a batch that is run again after a failure puts the same rows in place, so nothing is counted twice
    and an older batch never wins.  Only the buckets of changed keys are rewritten.
    """
    def store(batch: DataFrame, number: int) -> None:
        table = KeyedTable(batch.sparkSession, table_path, keys, buckets)
        if not table.exists():
            table.create(batch.limit(0).withColumn("batch", F.lit(0).cast("long")))
        table.upsert(batch.withColumn("batch", F.lit(number).cast("long")), ["batch"])

    return stream.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()


def read_state(spark: SparkSession, table_path: str, keys: Sequence[str], buckets: int = 32) -> DataFrame:
    """One row per key, as the last batch left it."""
    return KeyedTable(spark, table_path, keys, buckets).read().drop("batch")
