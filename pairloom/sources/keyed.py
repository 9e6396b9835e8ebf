"""A table with one row per key, kept in hash buckets, so that a change rewrites only the buckets of its keys.

A bucket is a partition folder.  Changes are merged with the rows of their buckets and written with dynamic partition overwrite: other
buckets are neither read nor written.  A bucket always holds one row that is no entry, so that it can also become empty.

One writer at a time.  Every change can be repeated: after a failure the same change gives the same table.  A DataFrame from ``read`` is
good until the next change of its buckets; read again after it.  Keys may be null (null equals null).  The number of buckets is fixed when
the table is made and belongs to its path; only the numbers of touched buckets reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.session import cut_lineage
from pairloom.sources import store

BUCKET, ENTRY = "_bucket", "_entry"


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 64):
        if buckets < 1:
            raise ValueError("a table needs at least one bucket")
        self.spark, self.keys, self.buckets = spark, list(keys), buckets
        self.path = f"{path.rstrip('/')}/{buckets}_buckets"

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def exists(self) -> bool:
        try:
            self.spark.read.parquet(self.path)
        except AnalysisException as exc:
            if "PATH_NOT_FOUND" not in str(exc):
                raise
            return False
        return True

    def create(self, rows: DataFrame) -> KeyedTable:
        """Write the first rows, one per key; all buckets are made, also for an empty table."""
        self._write(rows, list(range(self.buckets)))
        return self

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """The rows, of some buckets only if they are named (others are pruned)."""
        rows = self.spark.read.parquet(self.path)
        if buckets is not None:
            rows = rows.where(F.col(BUCKET).isin(list(buckets)))
        return rows.where(ENTRY).drop(BUCKET, ENTRY)

    def upsert(self, changes: DataFrame, version: Sequence[str]) -> KeyedTable:
        """The latest row of every key by the version columns; a change wins over a row of the same version."""
        changes = cut_lineage(changes)  # read for its buckets and for its rows
        touched = self._buckets(changes)
        if touched:
            order = F.struct(*version) if version else F.lit(0)
            self._write(store.upsert(self.read(touched), changes, self.keys, order), touched)
        return self

    def delete(self, gone: DataFrame) -> KeyedTable:
        """Remove the rows of these keys; keys that aren't there are no fault.  Nothing is remembered of them."""
        gone = cut_lineage(gone.select(*self.keys).distinct())
        touched = self._buckets(gone)
        if touched:
            rows, gone = self.read(touched).alias("r"), gone.alias("g")
            same = [F.col(f"r.`{k}`").eqNullSafe(F.col(f"g.`{k}`")) for k in self.keys]
            self._write(rows.join(gone, same, "left_anti"), touched)
        return self

    def _buckets(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())  # at most self.buckets numbers

    def _write(self, rows: DataFrame, touched: list[int]) -> None:
        marks = self.spark.range(self.buckets).select(F.col("id").cast("int").alias(BUCKET)).where(F.col(BUCKET).isin(touched))
        placed = rows.withColumn(BUCKET, self.bucket()).withColumn(ENTRY, F.lit(True))
        both = placed.unionByName(marks.withColumn(ENTRY, F.lit(False)), allowMissingColumns=True)
        both.repartition(len(touched), BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
