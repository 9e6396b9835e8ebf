"""Views of the given tables in the roles the operators need.  Each has the same definition in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators.prepare import settle_pairs, without_conflicts


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def order_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled pair rows with duplicates: posting = supplier, candidate = order line, label from the return flag."""
    label = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("posting_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("candidate_id"), label.alias("label_id"),
        F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"),
        (F.col("l_discount") * 100 + F.col("l_tax")).alias("offer"), F.col("l_partkey").alias("part_id"))


def ranked_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The same, one row per pair, conflicting pairs dropped; three scores to compare."""
    order = [F.col("price"), F.col("quantity"), F.col("offer"), F.col("part_id")]
    return without_conflicts(settle_pairs(order_lines(spark, folder), ["posting_id", "candidate_id"], "label_id", order))


SQL = {
    "order_lines": """
        select l_suppkey as posting_id, l_orderkey * 10 + l_linenumber as candidate_id,
               case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as label_id,
               l_extendedprice as price, l_quantity as quantity, l_discount * 100 + l_tax as offer, l_partkey as part_id
        from lineitem""",
    "ranked_pairs": """
        select posting_id, candidate_id, label_id, price, quantity, offer, part_id from (
            select *, min(label_id) over (partition by posting_id, candidate_id) as lo,
                      max(label_id) over (partition by posting_id, candidate_id) as hi,
                      row_number() over (partition by posting_id, candidate_id order by price, quantity, offer, part_id) as rn
            from order_lines) where lo = hi and rn = 1""",
}


def with_views(names: list[str], body: str) -> str:
    """SQL with the named views in front; a body that starts with a comma goes on listing views."""
    return "with " + ",\n".join(f"{n} as ({SQL[n]})" for n in names) + "\n" + body
