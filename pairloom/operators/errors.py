"""Error analysis: which models put a relevant candidate first, and what marks the postings where they do not."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom import fixed_values as fv
from pairloom.functions.ordering import exact_quantiles, hot_rows
from pairloom.operators.ranking import first_per_group, mean_rank

SCORES = {"tfidf": "tfidf_score", "semantic": "semantic_score", "hybrid": "hybrid_score"}
FEATURES = ["semantic_similarity", "required_skill_count", "required_skill_coverage", "missing_required_skill_count",
            "experience_match", "experience_gap", "responsibility_similarity", "responsibilities_from_section"]


def join_predictions(first: DataFrame, others: Sequence[DataFrame], keys: Sequence[str] = ("candidate_id", "posting_id")) -> DataFrame:
    """One-to-one join of prediction tables; raises where a key repeats."""
    for df in [first, *others]:
        repeated = df.groupBy(*keys).count().where("count > 1").limit(1).count()
        if repeated:
            raise ValueError("predictions are not one row per pair")
    out = first
    for df in others:
        out = out.join(df, list(keys), "inner")
    return out


def posting_flags(preds: DataFrame, at_most: int | None = None) -> DataFrame:
    """One row per posting that can fail: each model's first candidate, its success, and the inputs of the tags.

    All per-posting facts come from partial aggregates, except the two rankings and the median, which are exact and spread
    large postings over tasks.  Where at_most says that no posting is large, rankings, median and facts are taken together, in one pass
    over preds that are dealt by posting.
    """
    together = at_most is not None and at_most <= hot_rows(preds)
    if together:
        place = lambda score: F.rank().over(Window.partitionBy("posting_id").orderBy(F.col(score).desc_nulls_last())) + (
            F.count("*").over(Window.partitionBy("posting_id", score)) - 1) / 2
        preds = preds.withColumn("_lex", place("tfidf_score")).withColumn("_sem", place("semantic_score"))
    label, rel = F.col("label_id"), F.col("label_id") > 0
    tops = []
    for model, score in SCORES.items():
        tops.append(F.min_by(F.struct("candidate_id", "label_id", *FEATURES), F.struct((-F.col(score)).alias("s"), "candidate_id")).alias(f"top_{model}"))
    facts = preds.groupBy("posting_id").agg(
        F.count("*").alias("n_candidates"), F.sum(rel.cast("int")).alias("n_relevant"), *tops,
        F.avg(F.when(rel, F.col("responsibility_similarity"))).alias("relevant_responsibility"),
        F.avg(F.when(rel, F.col("required_skill_coverage"))).alias("relevant_mean_required_coverage"),
        F.avg(F.when(rel, F.col("semantic_similarity"))).alias("relevant_mean_semantic"),
        F.coalesce(F.bool_or(rel & (F.col("experience_gap") > 0)), F.lit(False)).alias("relevant_gap"),
        F.coalesce(F.bool_and(F.when(rel, F.col("experience_match").isNull())), F.lit(True)).alias("no_experience"),
        F.min_by("responsibilities_from_section", "candidate_id").alias("from_section"),
        F.min_by("required_skill_count", "candidate_id").alias("n_required"),
        *([F.max(F.when(rel, F.abs(F.col("_sem") - F.col("_lex")))).alias("rank_gap"), F.percentile("semantic_similarity", 0.5).alias("median_semantic")]
          if together else []))
    facts = facts.where((F.col("n_relevant") > 0) & (F.col("n_relevant") < F.col("n_candidates")))
    if together:
        return facts
    median = exact_quantiles(preds, ["posting_id"], "semantic_similarity", [0.5]).select("posting_id", F.col("quantile").alias("median_semantic"))
    slim = preds.select("posting_id", "candidate_id", "label_id", "tfidf_score", "semantic_score")
    lexical = mean_rank(slim, "tfidf_score", "_lex").select("posting_id", "candidate_id", "_lex")
    meaning = mean_rank(slim, "semantic_score", "_sem").select("posting_id", "candidate_id", "label_id", "_sem")
    apart = lexical.join(meaning, ["posting_id", "candidate_id"]).groupBy("posting_id").agg(
        F.max(F.when(rel, F.abs(F.col("_sem") - F.col("_lex")))).alias("rank_gap"))
    return facts.join(median, "posting_id", "left").join(apart, "posting_id")


def error_table(preds: DataFrame, at_most: int | None = None) -> DataFrame:
    """One row per (category, posting): tops, the failing model's wrong candidate and the seven tags; at_most as in posting_flags."""
    flags = posting_flags(preds, at_most)
    ok = {m: F.col(f"top_{m}.label_id") > 0 for m in SCORES}
    rules = [(fv.ERROR_CATEGORIES[0], ok["tfidf"] & ~ok["semantic"], "semantic"), (fv.ERROR_CATEGORIES[1], ok["semantic"] & ~ok["tfidf"], "tfidf"),
             (fv.ERROR_CATEGORIES[2], ok["hybrid"] & ~ok["semantic"], "semantic"), (fv.ERROR_CATEGORIES[3], ok["semantic"] & ~ok["hybrid"], "hybrid"),
             (fv.ERROR_CATEGORIES[4], ~(ok["tfidf"] | ok["semantic"] | ok["hybrid"]), "hybrid")]
    hits = F.array_compact(F.array(*[F.when(rule, F.struct(
        F.lit(name).alias("category"), F.lit(model).alias("failing_model"), F.col(f"top_{model}").alias("wrong"))) for name, rule, model in rules]))
    rows = flags.withColumn("_h", F.explode(hits)).select("*", "_h.*").drop("_h")
    w, no = (lambda c: F.col(f"wrong.{c}")), (lambda c: F.coalesce(c, F.lit(False)))
    lacks = no(w("missing_required_skill_count") > 0)
    tags = dict(zip(fv.ERROR_TAGS, [
        lacks, lacks & no(w("semantic_similarity") >= F.col("median_semantic")),
        no(F.col("relevant_responsibility") < w("responsibility_similarity")),
        no(F.col("rank_gap") >= F.col("n_candidates") / 2), F.col("relevant_gap"), ~F.col("from_section"),
        (F.col("n_required") == 0) | F.col("no_experience")]))
    return rows.select(
        "category", "posting_id", "n_candidates", "n_relevant", *[F.col(f"top_{m}.candidate_id").alias(f"{m}_top_candidate_id") for m in SCORES],
        *[F.col(f"top_{m}.label_id").alias(f"{m}_top_label_id") for m in SCORES], "failing_model",
        *[w(f).alias(f"wrong_top_{f}") for f in FEATURES], "relevant_mean_required_coverage", "relevant_mean_semantic",
        *[t.alias(f"tag_{n}") for n, t in tags.items()])


def with_examples(errors: DataFrame, n: int = 3) -> DataFrame:
    """Flag the first n postings of each category: the few are found by a bounded top-n and joined back."""
    chosen = first_per_group(errors.select("category", "posting_id"), ["category"], [F.asc("posting_id")], n).select(
        "category", "posting_id", F.lit(True).alias("example"))
    return errors.join(F.broadcast(chosen), ["category", "posting_id"], "left").withColumn("example", F.coalesce("example", F.lit(False)))


def error_summary(errors: DataFrame, preds: DataFrame) -> DataFrame:
    """(category, jobs, share of the postings that can fail, tag totals)."""
    per = preds.groupBy("posting_id").agg(F.count("*").alias("n"), F.sum((F.col("label_id") > 0).cast("int")).alias("r"))
    n_jobs = per.agg(F.count_if((F.col("r") > 0) & (F.col("r") < F.col("n"))).alias("n")).scalar()
    tags = [c for c in errors.columns if c.startswith("tag_")]
    return errors.groupBy("category").agg(
        F.count("*").alias("jobs"), F.bround(F.count("*") / n_jobs, 4).alias("share_of_binary_eligible_jobs"),
        *[F.sum(F.col(t).cast("long")).alias(t) for t in tags])
