"""Shared steps that keep pairs slim: the same rows by every way they can be joined, dealt, bounded and drawn."""

import random
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom import fixed_values as fv
from pairloom.functions import ordering
from pairloom.operators import errors as er
from pairloom.operators import pair_features as pf
from pairloom.operators import ranking as rk
from pairloom.plans import experiment as ex


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_blocks_of_candidates_give_the_rows_of_one_broadcast(spark):
    pairs = spark.createDataFrame([(p, c) for p in (1, 2, None) for c in (*range(9), None)], "posting_id long, candidate_id long")
    postings = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "posting_id long, p string")
    candidates = spark.createDataFrame([(c, str(c)) for c in (0, 1, 1, 2, 3, 5, 8, None)], "candidate_id long, c string")
    whole, dealt = pf.with_both_sides(pairs, postings, candidates)
    blocks, still = pf.with_both_sides(pairs, postings, candidates, rows=3)
    assert dealt and not still and rows_of(whole) == rows_of(blocks) and whole.count() == 21
    assert whole.columns == blocks.columns


def test_blocks_of_dealt_pairs_shuffle_neither_pairs_nor_postings(spark):
    pairs = spark.createDataFrame([(p, c) for p in (1, 2, None) for c in (*range(9), None)], "posting_id long, candidate_id long")
    postings = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "posting_id long, p string")
    candidates = spark.createDataFrame([(c, str(c)) for c in (0, 1, 1, 2, 3, 5, 8, None)], "candidate_id long, c string")
    whole, _ = pf.with_both_sides(pairs, postings, candidates)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        blocks, still = pf.with_both_sides(ex.by_posting(pairs, 10), postings, candidates, rows=3, parts=ex.posting_parts(pairs, 10))
        assert "hashpartitioning" not in plan_of(blocks) and not still
        assert rows_of(whole) == rows_of(blocks) and whole.columns == blocks.columns
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_models_of_dealt_pairs_are_ranked_without_another_shuffle(spark):
    rows = [(p, c, (p + c) % 3, float(c), float(-c)) for p in range(20) for c in range(8)]
    pairs = spark.createDataFrame(rows, "posting_id long, candidate_id long, label_id int, x double, y double")
    models = {"x": "x", "y": "y"}
    dealt = ex.scorers_long(ex.by_posting(pairs, 8), models)
    per = rk.posting_metrics(dealt, "score", ["model"], at_most=8)
    assert plan_of(per).count("Exchange") == 1
    assert rows_of(per) == rows_of(rk.posting_metrics(ex.scorers_long(pairs, models), "score", ["model"]))


def test_configurations_of_pairs_leave_no_filter_of_their_formulas(spark):
    names = [*fv.COMPONENTS, *fv.COUNT_OF_COVERAGE.values()]
    rows = [(p, c, (p + c) % 3, *[None if (p * c + i) % 4 == 0 else (p + c + i) / 20 for i in range(len(fv.COMPONENTS))], p % 2, c % 2) for p in range(4) for c in range(5)]
    pairs = spark.createDataFrame(rows, "posting_id long, candidate_id long, label_id int, " + ", ".join(
        f"{n} {'double' if n in fv.COMPONENTS else 'int'}" for n in names))
    bounds = {"semantic_similarity": (0.1, 0.4)}
    scored = pf.configuration_rows(ex.by_posting(pf.configuration_values(pairs, fv.WEIGHTINGS, bounds, ex.PAIR), 10), fv.WEIGHTINGS, ex.PAIR)
    assert "size(" not in plan_of(scored)
    apart = [pairs.select(*ex.PAIR, F.lit(i).alias("config_index"), F.lit(name).alias("configuration"), pf.combine(
        pf.component_values(bounds), dict(zip(fv.COMPONENTS, weights))).alias("score")) for i, (name, weights) in enumerate(fv.WEIGHTINGS.items())]
    assert rows_of(scored) == rows_of(reduce(DataFrame.unionByName, apart)) and scored.count() == 20 * len(fv.WEIGHTINGS)


def test_only_the_splits_asked_for_are_made(spark):
    pairs = spark.createDataFrame([(p, c, c % 3, c) for p in range(3) for c in range(60)], "posting_id long, candidate_id long, label_id int, candidate_group long")
    every, held = ex.repeated_splits(pairs), ex.repeated_splits(pairs, splits=("validation", "test"))
    assert every.columns == held.columns and every.count() == 5 * 180
    assert rows_of(every.where("split <> 'train'")) == rows_of(held)


def test_large_groups_quantiles_are_read_between_bounds(spark):
    rng = random.Random(5)
    values = {k: [rng.choice([0.0, 0.0, rng.gauss(0, 1), 7.0]) for _ in range(n)] for k, n in (("a", 60_000), ("b", 300))}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v double")
    qs = [0.0, 0.01, 0.37, 0.5, 0.99, 1.0]
    hits = ordering._values_between_bounds(df, ["k"], "v", qs)
    assert hits is not None
    got = {(r["k"], r["q_index"]): r["quantile"] for r in ordering._interpolated(hits, ["k"], "v", ["k"]).collect()}
    for k, vs in values.items():
        assert np.allclose([got[k, i + 1] for i in range(len(qs))], np.quantile(vs, qs), atol=1e-12)


def test_error_table_of_dealt_postings(spark):
    rng = random.Random(9)
    score = lambda: float(rng.randint(0, 4))
    rows = [(p, c, rng.choice([0, 0, 1, 2]), score(), score(), score(), score() if rng.random() < 0.8 else None, rng.randint(0, 2), score(), rng.randint(0, 2),
             score() if rng.random() < 0.5 else None, score(), score(), True) for p in range(40) for c in range(9)]
    preds = spark.createDataFrame(rows, """posting_id long, candidate_id long, label_id int, tfidf_score double, semantic_score double, hybrid_score double,
        semantic_similarity double, required_skill_count int, required_skill_coverage double, missing_required_skill_count int,
        experience_match double, experience_gap double, responsibility_similarity double, responsibilities_from_section boolean""")
    rounded = lambda df: df.withColumns({c: F.round(c, 9) for c, t in df.dtypes if t == "double"})
    apart, together = rounded(er.error_table(preds)), rounded(er.error_table(preds, 9))
    assert rows_of(apart) == rows_of(together) and apart.count() > 0
