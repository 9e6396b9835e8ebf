"""Reading and writing tables and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}


def read_parts(spark: SparkSession, folder: str, tag: str = "original_split") -> DataFrame:
    """All Parquet parts of a folder as one table, each row tagged with the stem of its file."""
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.parquet)?$", 1)
    return spark.read.parquet(folder).select("*", stem.alias(tag))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a known schema in which an empty string is an empty string, never NULL."""
    strings = [f.name for f in spark.createDataFrame([], schema).schema if f.dataType.simpleString() == "string"]
    return spark.read.schema(schema).csv(path, emptyValue="", **CSV).fillna("", subset=strings)


def read_csv_as_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, inferSchema=False, emptyValue="", **CSV).fillna("")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded half to even."""
    return df.select(*[F.bround(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str, digits: int = 6) -> None:
    rounded(df, digits).write.mode("overwrite").csv(path, emptyValue="", **{k: v for k, v in CSV.items() if k != "multiLine"})


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path, multiLine=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_text_files(spark: SparkSession, folder: str, glob: str = "*.{csv,json}") -> DataFrame:
    """(path, name, text): every matching file below a folder as one text."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))


def decode_json(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """JSON text columns become nested columns of the given types."""
    return df.withColumns({c: F.from_json(c, schema) for c, schema in columns.items()})


def encode_json(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.to_json(c) for c in columns})


def fingerprint(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Row count and order-free sum of the rows' MD5 (60 bits of it), per group: equal tables have equal fingerprints."""
    columns = sorted(c for c in df.columns if c not in by)
    row = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns]))
    bits = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"), F.sum(bits).cast("string").alias("sum_hash"))


def select_where(df: DataFrame, predicate: Column, at: str, tie: str) -> DataFrame:
    """Rows that fulfil an equality predicate (pushed to the scan), newest first."""
    return df.where(predicate).orderBy(F.desc(at), F.desc(tie))
