"""Registered round trips: tables written to the shared scratch folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.catalog.inputs import table
from pairloom.operators import lexical as lx
from pairloom.operators import semantic as se
from pairloom.session import scratch_folder
from pairloom.sources import store, tables, text_files
from pairloom.sources.keyed import KeyedTable

LINE = "l_orderkey long, l_linenumber int, l_comment string, price double"


def _lines(spark, folder):
    """Order lines with a comment that CSV must quote, and empty ones."""
    comment = F.when(F.col("l_linenumber") == 1, "").otherwise(F.concat(F.lit('say "'), F.col("l_returnflag"), F.lit('",\nthen '), F.col("l_linestatus")))
    return table(spark, folder, "lineitem").select(F.col("l_orderkey").cast("long").alias("l_orderkey"), F.col("l_linenumber").cast("int").alias("l_linenumber"),
                                                   comment.alias("l_comment"), (F.col("l_extendedprice") / 7).alias("price"))


def csv_round_trip(spark, folder):
    """Written with six digits, read with its schema: empty strings stay empty."""
    place = scratch_folder(spark)
    tables.write_csv(_lines(spark, folder), place)
    back = tables.read_csv(spark, place, LINE)
    return back.groupBy("l_comment").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("total"))


def csv_as_text(spark, folder):
    """Every column as text."""
    place = scratch_folder(spark)
    tables.write_csv(_lines(spark, folder).drop("price"), place)
    return tables.read_csv_as_text(spark, place)


def csv_pruned(spark, folder):
    """Two columns of the file; the others are not parsed."""
    place = scratch_folder(spark)
    tables.write_csv(_lines(spark, folder), place)
    return tables.read_csv(spark, place, LINE).groupBy("l_linenumber").agg(F.sum("l_orderkey").alias("keys"))


def parts_round_trip(spark, folder):
    """Parquet parts tagged with the stem of their file: one tag per part written."""
    place = scratch_folder(spark)
    tables.write_table(table(spark, folder, "labels").repartition(3, "doc_id"), place)
    back = tables.read_parts(spark, place)
    return back.agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"), F.count_if(~F.col("original_split").startswith("part-")).alias("odd_tags"))


def json_round_trip(spark, folder):
    place = scratch_folder(spark)
    tables.write_json(table(spark, folder, "documents").select("doc_id", "lang", F.struct("source", "n_chars").alias("origin")), place)
    back = spark.read.schema("doc_id long, lang string, origin struct<source:string,n_chars:long>").json(place)
    return back.select("doc_id", "lang", "origin.source", "origin.n_chars")


def _benchmark_files(spark, folder):
    place = scratch_folder(spark)
    table(spark, folder, "benchmark").select("item_id", "text").write.partitionBy("item_id").option("lineSep", "\n").text(place)
    return place


def scanned_files(spark, folder):
    """One file an item: every file below the folder as one text."""
    files = tables.read_text_files(spark, _benchmark_files(spark, folder), "*.txt")
    item = F.regexp_extract("path", r"item_id=(\d+)", 1).cast("long")
    return files.groupBy(item.alias("item_id")).agg(F.md5(F.regexp_replace(F.array_join(F.sort_array(F.collect_list("text")), ""), r"\n+$", "")).alias("text_md5"))


def ingested_files(spark, folder):
    """The same files through text ingest."""
    read, refused = text_files.read_documents(spark, _benchmark_files(spark, folder))
    item = F.regexp_extract("path", r"item_id=(\d+)", 1).cast("long")
    return read.select(item.alias("item_id"), F.lit("read").alias("state")).unionByName(refused.select(item.alias("item_id"), F.col("reason").alias("state")))


def appended_activity(spark, folder):
    """Orders and their activity appended in two batches."""
    place = scratch_folder(spark)
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    for part in (F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 2 == 1):
        batch = orders.where(part)
        store.append_with_activity(batch, batch.select("o_custkey", F.lit("created").alias("type")), f"{place}/orders", f"{place}/activity")
    both = spark.read.parquet(f"{place}/activity").groupBy("o_custkey").agg(F.count("*").alias("n_activities"))
    return spark.read.parquet(f"{place}/orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders")).join(both, "o_custkey")


def changed_orders(spark, folder):
    """Even orders as a keyed table; every third order changes, orders of customers in debt go, then older changes of every fifth order arrive."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("price"), F.lit(1).alias("version"))
    nth = lambda n: orders.where(F.col("o_orderkey") % n == 0)
    debtors = table(spark, folder, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    kept = KeyedTable(spark, scratch_folder(spark), ["o_orderkey"], 16).create(nth(2))
    kept.upsert(nth(3).withColumns({"price": F.col("price") * 2, "version": F.lit(2)}), ["version"])
    kept.delete(orders.join(debtors, "o_custkey", "left_semi"))
    return kept.upsert(nth(5).withColumn("price", F.col("price") * 3), ["version"]).read()


def cached_embeddings(spark, folder):
    """Benchmark first, then documents: only new texts are encoded, and each setting has its own vectors."""
    place, encoder = scratch_folder(spark), se.hashed_bag_encoder(16)
    store.extend_embedding_cache(spark, place, table(spark, folder, "benchmark").select("text"), encoder, 128)
    other = store.extend_embedding_cache(spark, place, table(spark, folder, "benchmark").select("text"), encoder, 128, "truncate")
    whole = store.extend_embedding_cache(spark, place, table(spark, folder, "documents").select("text"), encoder, 128)
    return whole.agg(F.count("*").alias("n_vectors"), F.count_distinct("text_id").alias("n_texts")).crossJoin(other.agg(F.count("*").alias("n_truncated")))


def stored_vocabulary(spark, folder):
    """A fitted vocabulary, saved and loaded."""
    place = scratch_folder(spark)
    fitted = lx.fit_vocabulary(table(spark, folder, "documents").select("doc_id", "text"))
    tables.write_table(fitted, place)
    return lx.load_vocabulary(spark, place).agg(F.count("*").alias("n_terms")).crossJoin(fitted.agg(F.count("*").alias("n_fitted")))


QUERIES = {f.__name__: f for f in [csv_round_trip, csv_as_text, csv_pruned, parts_round_trip, json_round_trip, scanned_files, ingested_files,
                                   appended_activity, changed_orders, cached_embeddings, stored_vocabulary]}

LINES = """lines as (select l_orderkey::bigint as l_orderkey, l_linenumber::int as l_linenumber,
    case when l_linenumber = 1 then '' else 'say "' || l_returnflag || '",' || chr(10) || 'then ' || l_linestatus end as l_comment,
    round_even(l_extendedprice / 7, 6) as price from lineitem)"""
ORACLES = {
    "csv_round_trip": f"with {LINES} select l_comment, count(*) as n, round(sum(price), 2) as total from lines group by all",
    "csv_as_text": f"with {LINES} select l_orderkey::varchar as l_orderkey, l_linenumber::varchar as l_linenumber, l_comment from lines",
    "csv_pruned": f"with {LINES} select l_linenumber, sum(l_orderkey)::bigint as keys from lines group by all",
    "parts_round_trip": "select count(*) as n, sum(doc_id)::bigint as ids, 0::bigint as odd_tags from labels",
    "json_round_trip": "select doc_id, lang, source, n_chars from documents",
    "scanned_files": r"select item_id, md5(regexp_replace(text, '\n+$', '')) as text_md5 from benchmark",
    "ingested_files": "select item_id, 'read' as state from benchmark where trim(text) <> ''",
    "changed_orders": """with o as (select o_orderkey, o_custkey, o_totalprice::double as price,
            (o_orderkey % 2 = 0 or o_orderkey % 3 = 0) and o_custkey not in (select c_custkey from customer where c_acctbal < 0) as stays from orders)
        select o_orderkey, o_custkey, price * case when stays and o_orderkey % 3 = 0 then 2 when o_orderkey % 5 = 0 then 3 else 1 end as price,
            case when stays and o_orderkey % 3 = 0 then 2 else 1 end::int as version
        from o where stays or o_orderkey % 5 = 0""",
    "appended_activity": "select o_custkey, count(*) as n_orders, count(*) as n_activities from orders group by all",
}
