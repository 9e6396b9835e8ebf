"""Plain-text ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.text import printable_ascii, tidy_extract


def decode_content(files: DataFrame) -> DataFrame:
    """(path, content) to (path, name, text, reason): UTF-8, else Latin-1; blank or wrong-typed files get a reason."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    raw = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1"))
    text = tidy_extract(F.when(suffix == "doc", printable_ascii(raw)).otherwise(raw))
    reason = F.when(~suffix.isin("txt", "doc"), "unsupported_type").when(text == "", "no_text")
    return files.select("path", name.alias("name"), text.alias("text"), reason.alias("reason"))


def read_documents(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(documents, quarantine) of the text files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "content")
    decoded = decode_content(files)
    return decoded.where("reason is null").drop("reason"), decoded.where("reason is not null").select("path", "name", "reason")
