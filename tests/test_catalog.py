"""Registered queries agree with their SQL on the smallest tables (tools/compare.py does it for all of them)."""

import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
SOME = ["posting_metrics", "settled_pairs", "key_overlaps", "lexical_pair_scores", "near_duplicate_groups", "weighted_scores", "error_summary",
        "segments", "quality_checks", "match_scores", "application_state", "letters"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 90


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_query_agrees_with_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from tools.compare import TABLES, canonical
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    got, want = entry.queries()[name](spark, FOLDER).toPandas(), duck.execute(entry.oracle_sql()[name]).fetchdf()
    a, b = canonical(got), canonical(want)
    assert list(a.columns) == list(b.columns) and a.equals(b)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
