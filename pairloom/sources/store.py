"""Keyed tables: append, upsert, cascading delete, encode-once cache."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators.prepare import keep_first
from pairloom.operators.semantic import Encoder, encode_texts


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def append_with_activity(entity: DataFrame, activity: DataFrame, entity_path: str, activity_path: str) -> None:
    append(entity, entity_path)
    append(activity, activity_path)


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], version: Column) -> DataFrame:
    """Latest row per key of both tables; a change wins over a current row of the same version."""
    both = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    ordered = both.withColumn("_version", version)
    latest = ordered.groupBy(*keys).agg(F.max_by(
        F.struct(*[c for c in current.columns if c not in keys]), F.struct("_version", "_new")).alias("_row"))
    return latest.select(*keys, "_row.*").select(*current.columns)


def delete_keys(table: DataFrame, deleted: DataFrame, column: str) -> DataFrame:
    """Rows of the table whose column is not among the deleted keys (one column of any name)."""
    keys = deleted.select(F.col(deleted.columns[0]).alias("_gone")).distinct()
    return table.join(keys, F.col(column) == F.col("_gone"), "left_anti")


def clear_references(table: DataFrame, deleted: DataFrame, column: str) -> DataFrame:
    """References to deleted keys become NULL."""
    keys = deleted.select(F.col(deleted.columns[0]).alias("_gone")).distinct()
    joined = table.join(keys, F.col(column) == F.col("_gone"), "left")
    return joined.withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).select(*table.columns)


def cascade_delete(tables: dict[str, DataFrame], deleted: DataFrame, entity: str, key: str,
                   cascades: dict[str, str], set_null: dict[str, str]) -> dict[str, DataFrame]:
    """Delete entities by key; dependants in cascades go too, references in set_null are cleared (name -> column)."""
    out = dict(tables)
    out[entity] = delete_keys(tables[entity], deleted, key)
    for name, column in cascades.items():
        out[name] = delete_keys(tables[name], deleted, column)
    for name, column in set_null.items():
        out[name] = clear_references(tables[name], deleted, column)
    return out


def broken_references(child: DataFrame, parent: DataFrame, column: str, key: str) -> DataFrame:
    """Child rows that point to no parent."""
    keys = parent.select(F.col(key).alias("_key"))
    return child.where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_key"), "left_anti")


def extend_embedding_cache(spark: SparkSession, path: str, requests: DataFrame, encoder: Encoder, max_tokens: int = 510,
                           strategy: str = "chunk_mean", text: str = "text", encoder_name: str = "default") -> DataFrame:
    """Encode only the texts the stored table (text_id, vec) lacks, append them, return the whole table.

    Vectors of another encoder, length or strategy are kept apart: each combination has its own folder.
    """
    settings = hashlib.sha1(f"{encoder_name}|{max_tokens}|{strategy}".encode()).hexdigest()[:16]
    path = f"{path.rstrip('/')}/{settings}"
    try:
        known = spark.read.parquet(path)
    except Exception as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        known = None
    encode_texts(requests, encoder, max_tokens, strategy, text, known).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return keep_first(df, keys, order)
