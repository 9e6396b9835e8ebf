"""Privacy scan of texts and tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom import fixed_values as fv


def text_findings(text: Column, allow_url: Column | None = None) -> Column:
    url = text.rlike(fv.SCAN_URL) if allow_url is None else text.rlike(fv.SCAN_URL) & ~allow_url
    return F.array_compact(F.array(F.when(text.rlike("(?U)" + fv.SCAN_EMAIL), "e-mail address"),
                                   F.when(text.rlike("(?U)" + fv.SCAN_PHONE), "phone-number pattern"), F.when(url, "URL")))


def scan_texts(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, finding) rows."""
    return df.select(id, F.explode(text_findings(F.col(text))).alias("finding"))


def scan_columns(df: DataFrame, name: str, limit: int = fv.MAX_CELL_CHARS) -> DataFrame:
    """(source, finding): forbidden column names and the longest cell if it is too long."""
    spark = df.sparkSession
    bad = [(name, f"forbidden column '{c}'") for c in df.columns if c.lower() in fv.FORBIDDEN_COLUMNS]
    names = spark.createDataFrame(bad, "source string, finding string")
    longest = df.agg(F.greatest(F.lit(0), *[F.max(F.length(F.col(c).cast("string"))) for c in df.columns]).alias("n"))
    cells = longest.where(F.col("n") > limit).select(F.lit(name).alias("source"), F.concat(
        F.lit("text cell of "), F.col("n").cast("string"), F.lit(" characters")).alias("finding"))
    return names.unionByName(cells)


def scan_report(findings: DataFrame, sources: DataFrame, id: str) -> DataFrame:
    """Files scanned, findings, verdict."""
    n = sources.agg(F.count_distinct(id).alias("n")).scalar()
    return findings.agg(F.count("*").alias("findings")).select(
        F.coalesce(n, F.lit(0)).alias("sources_scanned"), "findings", (F.col("findings") == 0).alias("passed"))
