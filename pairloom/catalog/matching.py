"""Registered pair-feature, scoring, selection and report queries.

Postings are customers, candidates are suppliers, skills are part brands: a customer asks for the brands it buys (by
quantity required, preferred or uncertain), a supplier has the brands it ships in quantity.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom import fixed_values as fv
from pairloom.catalog.inputs import table
from pairloom.catalog.ranking import R6, SUMMARY_COLUMNS, _round, confusion_sql, metrics_sql, random_sql, thresholds_sql
from pairloom.functions.ordering import largest_group
from pairloom.operators import classify as cl
from pairloom.operators import errors as er
from pairloom.operators import pair_features as pf
from pairloom.operators import ranking as rk
from pairloom.operators import resampling as rs
from pairloom.operators import semantic as se
from pairloom.operators.split import seeded_draw
from pairloom.plans import experiment as ex
from pairloom.plans import report as rp
from pairloom.session import cut_lineage, written

WEIGHTS = dict(zip(fv.COMPONENTS, fv.WEIGHTINGS["B_semantic_heavy"]))
BOUNDS = {"semantic_similarity": (-0.25, 0.25), "responsibility_similarity": (-0.25, 0.25)}
MODELS = {"tfidf": "tfidf_score", "semantic": "semantic_score", "hybrid": "hybrid_score"}
PAIR_COLUMNS = """posting_id candidate_id label_id quantity semantic_similarity required_skill_count preferred_skill_count uncertain_skill_count
    required_skill_coverage missing_required_skill_count preferred_skill_coverage missing_preferred_skill_count weighted_skill_coverage
    job_skill_coverage candidate_experience_years required_experience_years responsibilities_from_section responsibility_similarity
    experience_match experience_gap education_match""".split()
COMPONENT_COLUMNS = list(dict.fromkeys([*fv.COMPONENTS, *fv.COUNT_OF_COVERAGE.values()]))


def trade_lines(spark, folder):
    label = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", F.col("l_suppkey").alias("candidate_id"),
                                                    "l_quantity", label.alias("label_id"))
    orders = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("posting_id"))
    parts = table(spark, folder, "part").select("p_partkey", F.col("p_brand").alias("skill"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        "posting_id", "candidate_id", "skill", "l_quantity", "label_id")


def trade_pairs(spark, folder, lines=None):
    return (lines or trade_lines(spark, folder)).groupBy("posting_id", "candidate_id").agg(
        F.max("label_id").alias("label_id"), F.sum("l_quantity").alias("quantity"))


def demanded_skills(spark, folder, lines=None):
    bought = (lines or trade_lines(spark, folder)).groupBy("posting_id", "skill").agg(F.sum("l_quantity").alias("q"))
    status = F.when(F.col("q") >= 60, "required").when(F.col("q") >= 30, "preferred").otherwise("uncertain")
    return bought.select("posting_id", "skill", status.alias("status"))


def offered_skills(spark, folder, lines=None):
    shipped = (lines or trade_lines(spark, folder)).groupBy("candidate_id", "skill").agg(F.sum("l_quantity").alias("q"))
    return shipped.where("q >= 600").select("candidate_id", "skill")


def trade_rows(spark, folder):
    """(lines that are joined and written once, a bound on a posting's pairs)."""
    lines = written(trade_lines(spark, folder))
    return lines, largest_group(lines, ["posting_id"])


def trade(spark, folder, rows=None):
    """Pairs, dealt by posting where no posting is too large for a task, and demanded and offered skills."""
    lines, at_most = rows or trade_rows(spark, folder)
    dealt = ex.by_posting(lines.select("posting_id", "candidate_id", "label_id", "l_quantity"), at_most)
    return trade_pairs(spark, folder, dealt), demanded_skills(spark, folder, lines), offered_skills(spark, folder, lines)


def vectors(spark, folder, id):
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias(id), F.col("embedding").alias("vec"))


def semantic_pairs(spark, folder):
    """Cosine of the pairs both sides of which have a vector."""
    pairs = trade_pairs(spark, folder).select("posting_id", "candidate_id")
    return _round(se.vector_pair_scores(pairs, vectors(spark, folder, "candidate_id"), vectors(spark, folder, "posting_id")))


def skill_coverage(spark, folder):
    pairs, demanded, offered = trade(spark, folder)
    covered = _round(pf.coverage(pairs.select("posting_id", "candidate_id"), demanded, offered))
    lists = [c for c, t in covered.dtypes if t.startswith("array")]
    return covered.select(*[F.array_join(c, ",").alias(c) if c in lists else F.col(c) for c in covered.columns])


def match_features(spark, folder, lists=False, skills=False, ranked=True):
    """(every component of every pair, unknown is NULL; a bound on a posting's pairs).

    What is known of a posting or a candidate is put into one row of it first; pairs meet these two rows and nothing else.  skills adds the
    sorted skills of both sides.  Only where the pairs will be ranked are they dealt by posting again if the joins undid that.
    """
    lines, at_most = trade_rows(spark, folder)
    pairs, demanded, offered = trade(spark, folder, (lines, at_most))
    held, asked = pf.skill_sides(demanded, offered)
    if skills:
        asked = asked.withColumns({"required_skills": F.array_distinct(F.array_compact("_required")),
                                   "preferred_skills": F.array_distinct(F.array_compact("_preferred"))})
        held = held.withColumn("candidate_skills", F.col("_held"))
    years = lambda c: F.when(F.col(c) > 0, F.col(c) / 1000)
    vector = lambda id, name: vectors(spark, folder, id).withColumnRenamed("vec", name)
    suppliers = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("candidate_id"), years("s_acctbal").alias("candidate_experience_years"),
        F.nullif(F.col("s_nationkey") % 6, F.lit(0)).alias("_level"), F.col("s_nationkey").cast("long").alias("_duty"))
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("posting_id"), years("c_acctbal").alias("required_experience_years"),
        F.nullif(F.col("c_nationkey") % 6, F.lit(0)).alias("_asked"), (F.col("c_mktsegment") != "BUILDING").alias("responsibilities_from_section"))
    candidates = suppliers.join(held, "candidate_id", "left").join(vector("candidate_id", "_c_vec"), "candidate_id", "left").join(
        vector("_duty", "_d_vec"), "_duty", "left").drop("_duty")
    postings = customers.join(asked, "posting_id", "left").join(vector("posting_id", "_p_vec"), "posting_id", "left").join(
        vector("posting_id", "_q_vec"), "posting_id", "left")
    out, dealt = pf.with_both_sides(pairs, postings, candidates, parts=ex.posting_parts(lines, at_most))
    out = se.vector_scores(se.vector_scores(out, "_c_vec", "_p_vec", "semantic_similarity"), "_d_vec", "_q_vec", "responsibility_similarity")
    out = pf.covered(out, lists=lists)
    c, r = F.col("candidate_experience_years"), F.col("required_experience_years")
    out = out.withColumns({"experience_match": pf.experience_match(c, r), "experience_gap": pf.experience_gap(c, r),
                           "education_match": pf.education_match(F.col("_level"), F.col("_asked"))}).drop("_level", "_asked")
    return out if dealt or not ranked else ex.by_posting(out, at_most, lines.count()), at_most


def pair_features(spark, folder):
    features = _round(match_features(spark, folder, ranked=False)[0])
    return features.select(*PAIR_COLUMNS)


def scaler_bounds(spark, folder):
    return _round(pf.scaler_bounds(match_features(spark, folder, ranked=False)[0]))


def weighted_scores(spark, folder):
    features, _ = match_features(spark, folder, ranked=False)
    score = pf.combine(pf.component_values(BOUNDS), WEIGHTS)
    return features.select("posting_id", "candidate_id", F.round(score, 6).alias("score"))


def predictions(spark, folder):
    """(three models' scores of the same pairs with the features the error analysis reads, a bound on a posting's pairs)."""
    features, at_most = match_features(spark, folder)
    return features.withColumns({
        "tfidf_score": F.col("quantity"), "semantic_score": F.coalesce(F.round("semantic_similarity", 6), F.lit(0.0)),
        "hybrid_score": F.round(pf.combine(pf.component_values(BOUNDS), WEIGHTS), 6)}), at_most


def with_parts(pairs):
    """Validation or test by seeded draw of the posting."""
    return pairs.withColumn("part", F.when(F.substring(seeded_draw(fv.SEED, "posting_id"), 1, 1) < "8", "validation").otherwise("test"))


def posting_metrics_of(features, at_most, configurations, by, keep=ex.PAIR):
    """Ranking metrics per posting under each configuration; features are dealt by posting, so the multiplied rows stay where they are."""
    scored = pf.configuration_scores(features, configurations, BOUNDS, keep).withColumn("score", F.round("score", 6))
    return rk.ranking_summary(rk.posting_metrics(scored, "score", by, at_most=at_most), by)


def weight_comparison(spark, folder):
    features, at_most = match_features(spark, folder)
    return _round(ex.compare_configurations(features, fv.WEIGHTINGS, BOUNDS, at_most, 6).drop("config_index"))


def selected_weights(spark, folder):
    return _round(ex.pick_best(posting_metrics_of(*match_features(spark, folder), fv.WEIGHTINGS, ["config_index", "configuration"])))


def weight_selection(spark, folder):
    """The whole selection with refitted scaler: comparison rows and ablation rows under one table."""
    features, at_most = match_features(spark, folder)
    needed = written(features.select(*ex.PAIR, *COMPONENT_COLUMNS))
    _, _, comparison, ablation = ex.select_weights(needed, at_most=at_most)
    columns = ["configuration", *fv.RANKING_METRICS, "accuracy", "macro_f1"]
    return _round(comparison.select(F.lit("comparison").alias("step"), *columns).unionByName(
        ablation.select(F.lit("ablation").alias("step"), *columns)))


def ablation(spark, folder):
    return _round(posting_metrics_of(*match_features(spark, folder), pf.ablation_configurations("B_semantic_heavy"), ["configuration"]))


def explained_pairs(spark, folder):
    explained = pf.explain(match_features(spark, folder, lists=True, ranked=False)[0], WEIGHTS, BOUNDS)
    return explained.select("posting_id", "candidate_id", F.round("overall_score", 6).alias("overall_score"),
                            F.array_join("components_used", ",").alias("used"), F.array_join("strengths", " | ").alias("strengths"),
                            F.array_join("gaps", " | ").alias("gaps"))


def explanation_audit(spark, folder):
    """The eight checks over every explained pair; the evidence texts are the brand lists themselves."""
    explained = pf.explain(match_features(spark, folder, lists=True, skills=True, ranked=False)[0], WEIGHTS, BOUNDS)
    joined = explained.withColumn("candidate_skills", F.coalesce("candidate_skills", F.array().cast("array<string>")))
    joined = joined.withColumns({
        "candidate_text": F.array_join("candidate_skills", ". "), "posting_text": F.array_join("required_skills", ". "),
        "skill_evidence": F.col("matched_required_skills"), "saved_score": F.col("overall_score"),
        "responsibility_evidence": F.transform("matched_required_skills", lambda s: F.struct(s.alias("evidence"), s.alias("duty")))})
    return pf.audit_summary(pf.audit_checks(joined, WEIGHTS))


def model_pairs(spark, folder):
    """(pairs with one score column a model, a bound on a posting's pairs)."""
    preds, at_most = predictions(spark, folder)
    return preds.select(*ex.PAIR, *MODELS.values()), at_most


def model_metrics(spark, folder):
    """Ranking metrics per posting and model, from pairs that are dealt by posting already."""
    wide, at_most = model_pairs(spark, folder)
    return rk.posting_metrics(ex.scorers_long(wide, MODELS), "score", ["model"], at_most=at_most)


def evaluation_protocol(spark, folder):
    wide, at_most = model_pairs(spark, folder)
    wide = written(with_parts(wide))
    of = lambda df: [ex.scorers_long(df.where(F.col("part") == p).drop("part"), MODELS) for p in ("validation", "test")]
    return _round(ex.protocol(*of(wide), dealt=of(ex.by_posting(wide, at_most)), at_most=at_most))


def evaluated_models(spark, folder):
    wide, at_most = model_pairs(spark, folder)
    return cut_lineage(ex.evaluate_models(written(wide), MODELS, at_most))


def chance(spark, folder):
    """Expected metrics of random order over the models' pairs."""
    return cut_lineage(rk.expected_random_metrics(trade_pairs(spark, folder)))


def model_comparison(spark, folder):
    return _round(ex.model_comparison(evaluated_models(spark, folder), "tfidf", list(MODELS), chance(spark, folder)))


def model_deltas(spark, folder):
    per = model_metrics(spark, folder)
    return _round(ex.pairwise_deltas(rk.ranking_summary(per, ["model"]), list(MODELS), chance=chance(spark, folder)))


def compared_models(spark, folder):
    """Each pair's models ordered by the share of label-2 pairs that scored lower."""
    scored = written(ex.scorers_long(model_pairs(spark, folder)[0], MODELS))
    placed = cl.score_percentile(scored, scored.where("label_id = 2").select("model", "score"), ["model"])
    judged = cl.classify(placed, cl.fit_thresholds(scored, ["model"], stored=True), ["model"]).withColumn(
        "category", cl.match_category(F.col("predicted_label_id")))
    ranked = rp.rank_models(judged)
    text = F.transform("ranking", lambda m: F.concat_ws(":", m["model"], m["category"], F.format_string("%.1f", m["percentile"])))
    return ranked.select("posting_id", "candidate_id", F.array_join(text, ",").alias("ranking"))


def error_rows(spark, folder):
    """(written predictions with what the error analysis reads, its error table)."""
    preds, at_most = predictions(spark, folder)
    preds = written(preds.select(*ex.PAIR, *er.SCORES.values(), *er.FEATURES))
    return preds, er.error_table(ex.by_posting(preds, at_most), at_most)


def error_table(spark, folder):
    return _round(er.with_examples(cut_lineage(error_rows(spark, folder)[1])))


def error_summary(spark, folder):
    preds, errors = error_rows(spark, folder)
    return er.error_summary(errors, preds)


def repeated_pairs(spark, folder, columns, splits=("validation", "test")):
    """(rows of the repetitions' splits with these columns, a bound on a posting's pairs)."""
    preds, at_most = predictions(spark, folder)
    pairs = preds.select(*ex.PAIR, *[c for c in columns if c not in ex.PAIR], F.col("candidate_id").alias("candidate_group"))
    return ex.repeated_splits(pairs, n_folds=20, splits=splits).select("repetition", "split", *ex.PAIR, *[c for c in columns if c not in ex.PAIR]), at_most


def repeated_metrics(rows, at_most):
    """Ranking metrics per repetition, posting and model of test rows that are dealt by posting."""
    long = ex.scorers_long(rows.where("split = 'test'").select("repetition", *ex.PAIR, *MODELS.values()), MODELS)
    return rk.posting_metrics(long, "score", ["repetition", "model"], at_most=at_most)


def repeated_models(spark, folder):
    rows, at_most = repeated_pairs(spark, folder, MODELS.values())
    rows = written(rows)
    test = ex.by_posting(rows.where("split = 'test'"), at_most)
    return cut_lineage(ex.repeated_evaluation(ex.scorers_long(rows, MODELS), ex.scorers_long(test, MODELS), at_most))


def repeated_evaluation(spark, folder):
    return _round(repeated_models(spark, folder).select("repetition", "model", *fv.RANKING_METRICS, "accuracy", "macro_f1", "jobs_eligible"))


def repetition_summary(spark, folder):
    return _round(rs.repetition_summary(repeated_models(spark, folder), [*fv.RANKING_METRICS, "macro_f1"]))


def repeated_selection(spark, folder):
    rows, at_most = repeated_pairs(spark, folder, COMPONENT_COLUMNS, ["validation"])
    return _round(ex.repeated_selection(written(rows), at_most=at_most))


def repetition_matrix(spark, folder):
    rows, at_most = repeated_pairs(spark, folder, [*MODELS.values(), *COMPONENT_COLUMNS])
    rows = written(rows)
    per = rk.ranking_summary(repeated_metrics(ex.by_posting(rows.where("split = 'test'"), at_most), at_most), ["repetition", "model"])
    return _round(rp.repetition_matrix(per, ex.repeated_selection(rows, at_most=at_most), list(MODELS), "ndcg_10"))


def repeated_ablation(spark, folder):
    """Mean and deviation of each ablation stage over the repetitions' test rows."""
    stages = pf.ablation_configurations("B_semantic_heavy")
    rows, at_most = repeated_pairs(spark, folder, COMPONENT_COLUMNS, ["test"])
    by = ["repetition", "config_index", "configuration"]
    per = posting_metrics_of(rows, at_most, stages, by, ["repetition", *ex.PAIR]).withColumnsRenamed({"configuration": "stage", "config_index": "stage_index"})
    return _round(rp.stage_summary(per, ["ndcg_10", "mrr"]), 5)


def headline(spark, folder):
    """Selected cells by model."""
    long = rs.repetition_summary(repeated_models(spark, folder), fv.RANKING_METRICS).select("model", "metric", F.col("mean").alias("value"))
    return _round(rp.headline(long, ["semantic", "hybrid"], ["ndcg_10", "mrr"]))


def posting_differences(spark, folder):
    per = model_metrics(spark, folder)
    return rs.paired_differences(per, "semantic", "hybrid", ["ndcg_10", "ndcg_5", "mrr", "map"])


def no_negative_zero(df):
    return df.withColumns({c: F.col(c) + F.lit(0.0) for c, kind in df.dtypes if kind == "double"})


def paired_differences(spark, folder):
    return no_negative_zero(_round(posting_differences(spark, folder)))


def paired_bootstrap(spark, folder):
    return no_negative_zero(_round(rs.paired_bootstrap(posting_differences(spark, folder))))


def difference_table(spark, folder):
    per_posting = written(repeated_metrics(*repeated_pairs(spark, folder, MODELS.values(), ["test"])))
    per_rep = rk.ranking_summary(per_posting, ["repetition", "model"])
    metrics = ["ndcg_10", "ndcg_5", "mrr", "map"]
    diffs = rs.paired_differences(per_posting, "semantic", "hybrid", metrics, by=["repetition", "posting_id"])
    return no_negative_zero(_round(rs.difference_table(per_rep, diffs, "semantic", "hybrid", metrics)))


def final_report(spark, folder):
    """Validation, test and repeated metrics per model side by side."""
    wide, at_most = model_pairs(spark, folder)
    scored = ex.scorers_long(with_parts(wide), MODELS)
    parts = cut_lineage(rk.ranking_summary(rk.posting_metrics(scored, "score", ["part", "model"], at_most=at_most), ["part", "model"]))
    part = lambda name: parts.where(F.col("part") == name).drop("part")
    repeated = rs.repetition_summary(repeated_models(spark, folder), fv.RANKING_METRICS)
    return _round(rp.final_comparison(part("validation"), part("test"), repeated, fv.RANKING_METRICS))


def best_models(spark, folder):
    long = rs.repetition_summary(repeated_models(spark, folder), [*fv.RANKING_METRICS, "macro_f1"]).select("model", "metric", F.col("mean").alias("value"))
    return _round(rp.best_per_metric(long))


def objectives(spark, folder):
    long = rs.repetition_summary(repeated_models(spark, folder), ["ndcg_10", "macro_f1"]).select("model", "metric", F.col("mean").alias("value"))
    return rp.objectives_agree(rp.best_per_metric(long), "ndcg_10", "macro_f1")


def stage_verdicts(spark, folder):
    stages = pf.ablation_configurations("B_semantic_heavy")
    features, at_most = match_features(spark, folder)
    per = posting_metrics_of(with_parts(features), at_most, stages, ["part", "configuration"], ["part", *ex.PAIR])
    wide = per.groupBy(F.col("configuration").alias("stage")).agg(*[
        F.max(F.when(F.col("part") == p, F.col("ndcg_10"))).alias(p) for p in ("validation", "test")])
    return _round(rp.stage_verdicts(cut_lineage(wide), ["validation", "test"], "A_semantic_only"))


QUERIES = {f.__name__: f for f in [
    semantic_pairs, skill_coverage, pair_features, scaler_bounds, weighted_scores, weight_comparison, selected_weights, weight_selection,
    ablation, explained_pairs, explanation_audit, evaluation_protocol, model_comparison, model_deltas, compared_models, error_table,
    error_summary, repeated_evaluation, repetition_summary, repeated_selection, repetition_matrix, paired_differences, paired_bootstrap,
    difference_table, repeated_ablation, headline, final_report, best_models, objectives, stage_verdicts]}

TRADE = """lines as (select o_custkey as posting_id, l_suppkey as candidate_id, p_brand as skill, l_quantity,
        case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as label_id
        from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey),
    pairs as (select posting_id, candidate_id, max(label_id) as label_id, sum(l_quantity) as quantity from lines group by all),
    demanded as (select posting_id, skill, case when sum(l_quantity) >= 60 then 'required' when sum(l_quantity) >= 30 then 'preferred'
        else 'uncertain' end as status from lines group by all),
    offered as (select candidate_id, skill from lines group by all having sum(l_quantity) >= 600),
    marked as (select p.posting_id, p.candidate_id, d.skill, d.status, o.skill is not null as held from pairs p join demanded d using (posting_id)
        left join offered o on o.candidate_id = p.candidate_id and o.skill = d.skill),
    counted as (select posting_id, candidate_id,
        count(*) filter (status = 'required') as required_skill_count, count(*) filter (status = 'preferred') as preferred_skill_count,
        count(*) filter (status = 'uncertain') as uncertain_skill_count, count(*) filter (status = 'required' and held) as mr,
        count(*) filter (status = 'preferred' and held) as mp, count(*) filter (status = 'uncertain' and held) as mu,
        coalesce(string_agg(skill, ',' order by skill) filter (status = 'required' and held), '') as matched_required_skills,
        coalesce(string_agg(skill, ',' order by skill) filter (status = 'preferred' and held), '') as matched_preferred_skills,
        coalesce(string_agg(skill, ',' order by skill) filter (status = 'required' and not held), '') as missing_required_skills,
        coalesce(string_agg(skill, ',' order by skill) filter (status = 'preferred' and not held), '') as missing_preferred_skills,
        coalesce(string_agg(skill, ',' order by skill) filter (status = 'uncertain'), '') as uncertain_skills
        from marked group by all),
    covered as (select *, coalesce(mr / nullif(required_skill_count, 0), 0) as required_skill_coverage,
        coalesce(mp / nullif(preferred_skill_count, 0), 0) as preferred_skill_coverage,
        coalesce((mr + 0.5::double * mp) / nullif(required_skill_count + 0.5::double * preferred_skill_count, 0), 0) as weighted_skill_coverage,
        coalesce((mr + mp + mu) / nullif(required_skill_count + preferred_skill_count + uncertain_skill_count, 0), 0) as job_skill_coverage,
        required_skill_count - mr as missing_required_skill_count, preferred_skill_count - mp as missing_preferred_skill_count from counted)"""
DOT = "list_dot_product({a}.embedding::double[], {b}.embedding::double[])"
FEATURES = f"""{TRADE}, joined as (select p.posting_id, p.candidate_id, p.label_id, p.quantity, c.* exclude (posting_id, candidate_id),
        {DOT.format(a='ev', b='pv')} as semantic_similarity, {DOT.format(a='dv', b='pv')} as responsibility_similarity,
        case when s_acctbal > 0 then s_acctbal / 1000 end as candidate_experience_years,
        case when c_acctbal > 0 then c_acctbal / 1000 end as required_experience_years,
        nullif(s_nationkey % 6, 0) as held, nullif(c_nationkey % 6, 0) as asked, c_mktsegment <> 'BUILDING' as responsibilities_from_section
        from pairs p join covered c using (posting_id, candidate_id) join supplier s on s_suppkey = p.candidate_id
        join customer cu on c_custkey = p.posting_id left join embeddings ev on ev.vec_id = p.candidate_id
        left join embeddings pv on pv.vec_id = p.posting_id left join embeddings dv on dv.vec_id = s_nationkey),
    features as (select *, least(1, candidate_experience_years / required_experience_years) + 0 *
            (candidate_experience_years + required_experience_years) as experience_match,
        case when candidate_experience_years + required_experience_years is not null then
            greatest(0, required_experience_years - candidate_experience_years) end as experience_gap,
        case when asked - held <= 0 then 1.0::double when asked - held = 1 then 0.5 when asked - held is not null then 0 end as education_match from joined)"""
FEATURE_COLUMNS = ["required_skill_coverage", "preferred_skill_coverage", "weighted_skill_coverage", "job_skill_coverage",
                   "semantic_similarity", "responsibility_similarity", "candidate_experience_years", "required_experience_years",
                   "experience_match", "experience_gap", "education_match"]
EXACT = ["required_skill_count", "preferred_skill_count", "uncertain_skill_count", "missing_required_skill_count", "missing_preferred_skill_count"]


def combine_sql(weights: dict[str, float], bounds: dict[str, tuple] | None = None) -> str:
    values = {}
    for name in weights:
        lo, hi = (bounds or BOUNDS).get(name, (0, 0))
        value = f"least(greatest(({name} - ({lo}::double)) / ({hi}::double - ({lo}::double)), 0), 1)" if name in BOUNDS else name
        if name in BOUNDS:
            value = f"case when {name} is not null then {value} end"
        if name in fv.COUNT_OF_COVERAGE:
            value = f"case when {fv.COUNT_OF_COVERAGE[name]} > 0 then {value} end"
        values[name] = f"({value})"
    top = " + ".join(f"coalesce({w}::double * {values[n]}, 0)" for n, w in weights.items())
    bottom = " + ".join(f"case when {values[n]} is not null then {w}::double else 0 end" for n, w in weights.items())
    score = f"coalesce(({top}) / nullif({bottom}, 0), 0)"
    return score if bounds else f"round({score}, 6)"


def configs_sql(configurations: dict) -> str:
    return " union all ".join(
        f"select '{name}' as configuration, {i} as config_index, posting_id, candidate_id, label_id, "
        f"{combine_sql(dict(zip(fv.COMPONENTS, w)))} as score from features" for i, (name, w) in enumerate(configurations.items()))


CONFIGS = f"{FEATURES}, configs as ({configs_sql(fv.WEIGHTINGS)})"
STAGES = f"{FEATURES}, configs as ({configs_sql(pf.ablation_configurations('B_semantic_heavy'))})"
PREDS = f"""{FEATURES}, preds as (select *, quantity as tfidf_score, coalesce(round(semantic_similarity, 6), 0) as semantic_score,
    {combine_sql(WEIGHTS)} as hybrid_score from features)"""
LONG = PREDS + ", by_model as (" + " union all ".join(
    f"select '{m}' as model, posting_id, candidate_id, label_id, {c} as score from preds" for m, c in MODELS.items()) + ")"
PART = "case when substr(md5('42:' || posting_id), 1, 1) < '8' then 'validation' else 'test' end"
JUDGED = """{name} as (select s.*, (s.score >= f.t1)::int + (s.score >= f.t2)::int as predicted from {source} s join fitted f on s.{by} = f.{by})"""
METRIC_COLUMNS = f"""jobs_total, jobs_eligible, excluded_single_candidate, excluded_single_label, jobs_binary_eligible, jobs_binary_trivial,
    mrr, map, ndcg_5, ndcg_10, p_1, p_5, n_rows, accuracy, macro_precision, macro_recall, macro_f1"""


def evaluated_sql(source: str, by: str) -> str:
    return f"""{metrics_sql(source, by + ', posting_id', 'score')}, {thresholds_sql(source, by)}, {JUDGED.format(name='judged_rows', source=source, by=by)},
    ranked_summary as (select {by}, {SUMMARY_COLUMNS} from per_posting group by {by}), judged_summary as ({confusion_sql('judged_rows', by)}),
    evaluated as (select {by}, {METRIC_COLUMNS} from ranked_summary join judged_summary using ({by}))"""


RATIOS = ", ".join(f"case when e.model <> 'tfidf' then round_even(e.{m} - b.{m}, 6) end as delta_{m}, "
                   f"case when e.model <> 'tfidf' then round_even(100 * (e.{m} - b.{m}) / b.{m}, 2) end as rel_{m}_pct"
                   for m in [*fv.RANKING_METRICS, "accuracy", "macro_f1"])


def differences_sql(source, keys):
    """long_diff(keys, metric, diff): hybrid less semantic where both have the metric."""
    each = " union all ".join(f"select {keys}, '{m}' as metric, any_value({m}) filter (model = 'hybrid') - any_value({m}) filter (model = 'semantic') as diff "
                              f"from {source} group by {keys}" for m in ("ndcg_10", "ndcg_5", "mrr", "map"))
    return f"long_diff as (select * from ({each}) where diff is not null)"


def resamples_sql(source, strata, n):
    """CTEs ending in means(metric, resample, mean): every posting's draws from the same hash."""
    key = "md5(" + " || ':' || ".join(["'42'", "posting_id::varchar", *[f"{c}::varchar" for c in strata]]) + ")"
    mixed = lambda v, factor, shift: f"xor(({v} * {factor} + 12345) % {rs.PRIME}, (({v} * {factor} + 12345) % {rs.PRIME}) >> {shift}) % {rs.PRIME}"
    lead = "".join(f"{c}, " for c in strata)
    return f"""seeded as (select {lead}metric, diff, ('0x' || substr({key}, 1, 8))::bigint % {rs.PRIME} as s1, ('0x' || substr({key}, 9, 8))::bigint % {rs.PRIME} as s2
            from {source}),
        hash0 as (select {lead}metric, diff, b, (s1 + (b + 1) * s2) % {rs.PRIME} as v from seeded, (select unnest(range({n})) as b)),
        hash1 as (select {lead}metric, diff, b, {mixed('v', 48271, 13)} as v from hash0),
        hash2 as (select {lead}metric, diff, b, {mixed('v', 69621, 15)} as v from hash1),
        hash3 as (select {lead}metric, diff, b, v * 39373 % {rs.PRIME} as v from hash2),
        drawn as (select {lead}metric, diff, b, {" + ".join(f"(v >= {c})::int" for c in rs.CUTS)} as w from hash3),
        part_means as (select {lead}metric, b, round(sum(w * diff) / nullif(sum(w), 0), 12) as mean from drawn group by {lead}metric, b),
        means as (select metric, b, avg(mean) as mean from part_means group by metric, b)"""


INTERVAL = """bounds as (select metric, quantile_cont(mean, 0.025) as low, quantile_cont(mean, 0.975) as high,
            least(avg((mean <= 0)::int), avg((mean >= 0)::int)) as tail from means group by metric)"""
FOLDED = """group_labels as (select candidate_id, label_id, count(*) as n from preds group by all),
    groups as (select candidate_id, sum(n) as size, arg_max(label_id, (n, label_id)) as main_label, md5('42:' || candidate_id) as draw
        from group_labels group by candidate_id),
    dealt as (select candidate_id, (row_number() over (order by main_label, size desc, draw, candidate_id) - 1) % 40 as turn from groups),
    folds as (select candidate_id, case when turn < 20 then turn else 39 - turn end as fold from dealt),
    reps as (select candidate_id, repetition, (((fold - 3 * repetition) % 20) + 20) % 20 as off from folds, (select unnest(range(0, 5))::int as repetition)),
    spread as (select candidate_id, repetition, case when off < 3 then 'test' when off < 6 then 'validation' else 'train' end as split from reps),
    repeated_long as (select m.model || ':' || s.repetition as rm, m.model, s.repetition, s.split, m.posting_id, m.candidate_id, m.label_id, m.score
        from by_model m join spread s using (candidate_id)),
    test_rows as (select * from repeated_long where split = 'test'), validation_rows as (select * from repeated_long where split = 'validation')"""
REPEATED = f"""{LONG}, {FOLDED}, {metrics_sql('test_rows', 'rm, model, repetition, posting_id', 'score')}, {thresholds_sql('validation_rows', 'rm')},
    {JUDGED.format(name='judged_rows', source='test_rows', by='rm')}, judged_summary as ({confusion_sql('judged_rows', 'rm')}),
    ranked_summary as (select rm, model, repetition, count(*) filter (excluded is null) as jobs_eligible,
        {", ".join(f"avg({m}) as {m}" for m in fv.RANKING_METRICS)} from per_posting group by all),
    per_rep as (select r.*, accuracy, macro_f1 from ranked_summary r left join judged_summary using (rm))"""
SPREAD = "long_metrics as (" + " union all ".join(
    f"select model, '{m}' as metric, {m} as value from per_rep" for m in [*fv.RANKING_METRICS, "macro_f1"]) + """),
    summary as (select model, metric, avg(value) as mean, stddev_samp(value) as std, min(value) as min, max(value) as max, count(value) as n_repetitions
        from long_metrics where value is not null group by all)"""

F_COLS = er.FEATURES
SUCCESS = ", ".join(f"arg_min(label_id, (-{c}, candidate_id)) as {m}_top_label_id, arg_min(candidate_id, (-{c}, candidate_id)) as {m}_top_candidate_id"
                    for m, c in MODELS.items())
ERRORS = f"""{PREDS}, eligible as (select posting_id, count(*) as n_candidates, sum((label_id > 0)::int)::bigint as n_relevant, {SUCCESS},
        avg(responsibility_similarity) filter (label_id > 0) as rel_resp, avg(required_skill_coverage) filter (label_id > 0) as rel_cov,
        avg(semantic_similarity) filter (label_id > 0) as rel_sem, coalesce(bool_or(experience_gap > 0) filter (label_id > 0), false) as rel_gap,
        count(experience_match) filter (label_id > 0) = 0 as no_exp, any_value(responsibilities_from_section) as from_section,
        any_value(required_skill_count) as n_required, median(semantic_similarity) as med
        from preds group by posting_id having sum((label_id > 0)::int) > 0 and sum((label_id > 0)::int) < count(*)),
    mean_ranks as (select posting_id, label_id,
        rank() over (partition by posting_id order by tfidf_score desc) + (count(*) over (partition by posting_id, tfidf_score) - 1) / 2 as lex,
        rank() over (partition by posting_id order by semantic_score desc) + (count(*) over (partition by posting_id, semantic_score) - 1) / 2 as sem from preds),
    gaps as (select posting_id, max(abs(sem - lex)) filter (label_id > 0) as rank_gap from mean_ranks group by posting_id),
    failing as (select *, unnest([
            case when tfidf_top_label_id > 0 and semantic_top_label_id = 0 then {{'category': 'A_tfidf_ok_bge_fails', 'm': 'semantic', 'w': semantic_top_candidate_id}} end,
            case when semantic_top_label_id > 0 and tfidf_top_label_id = 0 then {{'category': 'B_bge_ok_tfidf_fails', 'm': 'tfidf', 'w': tfidf_top_candidate_id}} end,
            case when hybrid_top_label_id > 0 and semantic_top_label_id = 0 then {{'category': 'C_hybrid_ok_bge_fails', 'm': 'semantic', 'w': semantic_top_candidate_id}} end,
            case when semantic_top_label_id > 0 and hybrid_top_label_id = 0 then {{'category': 'D_bge_ok_hybrid_fails', 'm': 'hybrid', 'w': hybrid_top_candidate_id}} end,
            case when tfidf_top_label_id + semantic_top_label_id + hybrid_top_label_id = 0 then {{'category': 'E_all_fail', 'm': 'hybrid', 'w': hybrid_top_candidate_id}} end]) as f
        from eligible),
    errors as (select f.category as category, e.posting_id, e.n_candidates, e.n_relevant,
        {", ".join(f"{m}_top_candidate_id, {m}_top_label_id" for m in MODELS)}, f.m as failing_model,
        {", ".join((f"round(w.{c}, 6)" if c in FEATURE_COLUMNS else f"w.{c}") + f" as wrong_top_{c}" for c in F_COLS)},
        round(rel_cov, 6) as relevant_mean_required_coverage, round(rel_sem, 6) as relevant_mean_semantic,
        w.missing_required_skill_count > 0 as tag_missing_required_skill,
        w.missing_required_skill_count > 0 and coalesce(w.semantic_similarity >= med, false) as tag_semantic_similarity_despite_missing_requirement,
        coalesce(rel_resp < w.responsibility_similarity, false) as tag_responsibility_mismatch, rank_gap >= e.n_candidates / 2 as tag_terminology_mismatch,
        rel_gap as tag_experience_mismatch, not from_section as tag_generic_job_boilerplate,
        n_required = 0 or no_exp as tag_insufficient_requirement_or_candidate_evidence
        from failing e join preds w on w.posting_id = e.posting_id and w.candidate_id = f.w join gaps g on g.posting_id = e.posting_id where f is not null)"""

CATEGORY = "case predicted when 0 then 'Weak match' when 1 then 'Potential match' else 'Strong match' end"
USED = "concat_ws(',', " + ", ".join(
    f"case when {fv.COUNT_OF_COVERAGE[n]} > 0 then '{n}' end" if n in fv.COUNT_OF_COVERAGE else f"case when {n} is not null then '{n}' end" for n in WEIGHTS) + ")"
SCALED_SQL = {n: f"least(greatest(({n} + 0.25::double) / 0.5::double, 0), 1)" for n in BOUNDS}
YEARS_SQL = "printf('%.1f', round_even(candidate_experience_years, 1))"
WANTED_SQL = "printf('%.0f', round_even(required_experience_years, 0))"
FOUND_SQL = "mr || ' of ' || required_skill_count || ' required skills found'"


COLUMN_BOUNDS = {"semantic_similarity": ("lo_s", "hi_s"), "responsibility_similarity": ("lo_r", "hi_r")}
REFITTED = f"""{PREDS}, {FOLDED.split('repeated_long')[0].rstrip().rstrip(',')},
    held as (select p.*, s.repetition from preds p join spread s using (candidate_id) where s.split = 'validation'),
    limits as (select repetition, quantile_cont(semantic_similarity, 0.01) as lo_s, quantile_cont(semantic_similarity, 0.99) as hi_s,
        quantile_cont(responsibility_similarity, 0.01) as lo_r, quantile_cont(responsibility_similarity, 0.99) as hi_r from held group by all),
    bounded as (select * from held join limits using (repetition)),
    rescored as ({" union all ".join(f"select repetition, '{n}' as configuration, {i} as config_index, posting_id, candidate_id, label_id, {combine_sql(dict(zip(fv.COMPONENTS, w)), COLUMN_BOUNDS)} as score from bounded" for i, (n, w) in enumerate(fv.WEIGHTINGS.items()))}),
    {metrics_sql('rescored', 'repetition, config_index, configuration, posting_id', 'score').replace('placed', 'placed3').replace('stats', 'stats3').replace('per_posting', 'per_posting3')},
    per_config as (select repetition, configuration, config_index, avg(ndcg_10) as ndcg_10 from per_posting3 group by all),
    selected as (select * from per_config qualify row_number() over (partition by repetition order by ndcg_10 desc, config_index) = 1)"""


def similar_sql(strong: bool) -> str:
    word, test = ("Strong", ">= 0.66") if strong else ("Weak", "< 0.33")
    return ", ".join(f"case when {n} is not null and {SCALED_SQL[n]} {test} then '{word} similarity between the {w} and the job' end"
                     for n, w in (("semantic_similarity", "overall profile"), ("responsibility_similarity", "past duties")))


ORACLES = {
    "explained_pairs": f"""with {FEATURES} select posting_id, candidate_id, {combine_sql(WEIGHTS)} as overall_score, {USED} as used,
        concat_ws(' | ', case when required_skill_count > 0 and required_skill_coverage >= 0.75 then {FOUND_SQL} || ': ' || replace(matched_required_skills, ',', ', ') end,
            case when matched_preferred_skills <> '' then 'Preferred skills found: ' || replace(matched_preferred_skills, ',', ', ') end,
            case when experience_match >= 1 then 'Meets the experience requirement (' || {YEARS_SQL} || ' vs ' || {WANTED_SQL} || ' years)' end, {similar_sql(True)}) as strengths,
        concat_ws(' | ', case when required_skill_count = 0 then 'No required skills were detected in the job description, so skill coverage was not scored'
                when required_skill_coverage < 0.75 then {FOUND_SQL} || '; missing: ' || replace(missing_required_skills, ',', ', ') end,
            case when experience_match < 1 then 'Estimated experience ' || {YEARS_SQL} || ' years is below the ' || {WANTED_SQL} || ' years requested' end, {similar_sql(False)}) as gaps
        from features""",
    "compared_models": f"""with {LONG}, {thresholds_sql('by_model', 'model')}, ref as (select model, score, count(*) as w from by_model where label_id = 2 group by all),
        cum as (select model, score, sum(w) over (partition by model order by score) as upto from ref), total as (select model, sum(w) as t from ref group by all),
        placed as (select b.*, round_even(100.0::double * coalesce(c.upto, 0) / t.t, 1) as pct from by_model b join total t using (model)
            asof left join cum c on b.model = c.model and b.score > c.score),
        named as (select p.*, (p.score >= f.t1)::int + (p.score >= f.t2)::int as predicted from placed p join fitted f on p.model = f.model)
        select posting_id, candidate_id, string_agg(model || ':' || {CATEGORY} || ':' || printf('%.1f', pct), ',' order by pct desc, model) as ranking
        from named group by all""",
    "repeated_selection": f"with {REFITTED} select repetition, configuration, config_index, round(ndcg_10, 6) as ndcg_10 from selected",
    "repetition_matrix": f"""with {REFITTED}, by_model as ({" union all ".join(f"select '{m}' as model, posting_id, candidate_id, label_id, {c} as score from preds" for m, c in MODELS.items())}),
        test_rows as (select m.*, s.repetition from by_model m join spread s using (candidate_id) where s.split = 'test'),
        {metrics_sql('test_rows', 'repetition, model, posting_id', 'score')},
        cells as (select repetition, model, avg(ndcg_10) as v from per_posting group by all)
        select repetition, {", ".join(f"round(any_value(v) filter (model = '{m}'), 6) as {m}" for m in MODELS)}, any_value(configuration) as configuration
        from cells left join selected using (repetition) group by repetition""",
    "headline": f"""with {REPEATED}, {SPREAD} select model, round(any_value(mean) filter (metric = 'ndcg_10'), 6) as ndcg_10,
        round(any_value(mean) filter (metric = 'mrr'), 6) as mrr from summary where model in ('semantic', 'hybrid') group by model""",
    "repeated_ablation": f"""with {PREDS}, {FOLDED.split('repeated_long')[0].rstrip().rstrip(',')}, configs as ({configs_sql(pf.ablation_configurations('B_semantic_heavy'))}),
        test_rows as (select c.*, s.repetition from configs c join spread s using (candidate_id) where s.split = 'test'),
        {metrics_sql('test_rows', 'repetition, config_index, configuration, posting_id', 'score')},
        per as (select repetition, config_index, configuration, avg(ndcg_10) as ndcg_10, avg(mrr) as mrr from per_posting group by all)
        select configuration as stage, config_index as stage_index, {", ".join(f"round(avg({m}), 5) as {m}_mean, round(stddev_samp({m}), 5) as {m}_std" for m in ('ndcg_10', 'mrr'))}
        from per group by all""",
    "semantic_pairs": f"""with {TRADE} select p.posting_id, p.candidate_id, round({DOT.format(a='ev', b='pv')}, 6) as score from pairs p
        join embeddings ev on ev.vec_id = p.candidate_id join embeddings pv on pv.vec_id = p.posting_id""",
    "skill_coverage": f"with {TRADE} select * exclude (mr, mp, mu, required_skill_coverage, preferred_skill_coverage, weighted_skill_coverage, job_skill_coverage), "
                      f"{R6(FEATURE_COLUMNS[:4])} from covered",
    "pair_features": f"""with {FEATURES} select posting_id, candidate_id, label_id, quantity, responsibilities_from_section, {", ".join(EXACT)},
        {R6(FEATURE_COLUMNS)} from features""",
    "scaler_bounds": f"""with {FEATURES}, v as (select 'semantic_similarity' as component, semantic_similarity as x from features
        union all select 'responsibility_similarity', responsibility_similarity from features)
        select component, round(quantile_cont(x, 0.01), 6) as lo, round(quantile_cont(x, 0.99), 6) as hi from v group by component""",
    "weighted_scores": f"with {FEATURES} select posting_id, candidate_id, {combine_sql(WEIGHTS)} as score from features",
    "weight_comparison": f"with {CONFIGS}, {evaluated_sql('configs', 'configuration')} select * from evaluated",
    "selected_weights": f"""with {CONFIGS}, {metrics_sql('configs', 'config_index, configuration, posting_id', 'score')},
        per as (select configuration, config_index, avg(ndcg_10) as ndcg_10 from per_posting group by all)
        select configuration, config_index, round(ndcg_10, 6) as ndcg_10 from per order by per.ndcg_10 desc, config_index limit 1""",
    "ablation": f"""with {STAGES}, {metrics_sql('configs', 'configuration, posting_id', 'score')}
        select configuration, {SUMMARY_COLUMNS} from per_posting group by configuration""",
    "explanation_audit": f"""with {TRADE} select count(*) as pairs_checked, {", ".join(f"count(*) as {c}" for c in [
        'missing_absent', 'matched_present', 'matched_plus_missing_complete', 'experience_gap', 'responsibility_evidence_in_text',
        'skill_evidence_in_text', 'score_recomposes', 'score_matches_saved'])}, true as all_pass from pairs""",
    "evaluation_protocol": f"""with {LONG}, both_parts as (select *, {PART} as part, model || ':' || ({PART}) as mp from by_model),
        validation_rows as (select * from both_parts where part = 'validation'), {metrics_sql('both_parts', 'mp, model, part, posting_id', 'score')},
        {thresholds_sql('validation_rows', 'model')}, {JUDGED.format(name='judged_rows', source='both_parts', by='model')},
        judged_summary as ({confusion_sql('judged_rows', 'mp')}),
        ranked_summary as (select mp, model, part, {SUMMARY_COLUMNS} from per_posting group by all)
        select model, part, round(t1, 6) as t1, round(t2, 6) as t2, {METRIC_COLUMNS} from ranked_summary join judged_summary using (mp) join (select model, t1, t2 from fitted) using (model)""",
    "model_comparison": f"""with {LONG}, {evaluated_sql('by_model', 'model').replace('round(', '(')
        .replace(', 6) as', ') as')}, {random_sql('preds', 'posting_id')}
        select 'random_ordering' as model, {", ".join(f"round(avg({m}), 6) as {m}" for m in fv.RANKING_METRICS)},
            {", ".join(f"null::double as {c}" for c in ["accuracy", "macro_f1", *[x for m in [*fv.RANKING_METRICS, "accuracy", "macro_f1"] for x in (f"delta_{m}", f"rel_{m}_pct")]])}
        from chance union all by name
        select e.model, {", ".join(f"round(e.{m}, 6) as {m}" for m in [*fv.RANKING_METRICS, 'accuracy', 'macro_f1'])}, {RATIOS}
        from evaluated e, (select * from evaluated where model = 'tfidf') b""",
    "model_deltas": f"""with {LONG}, {metrics_sql('by_model', 'model, posting_id', 'score')}, {random_sql('preds', 'posting_id')},
        per as (select model, case model when 'tfidf' then 1 when 'semantic' then 2 else 3 end as p,
            {", ".join(f"avg({m}) as {m}" for m in fv.RANKING_METRICS)} from per_posting group by all
            union all select 'random_ordering', 0, {", ".join(f"avg({m})" for m in fv.RANKING_METRICS)} from chance)
        select b.model || ' - ' || a.model as comparison, {", ".join(f"round_even(b.{m} - a.{m}, 6) as {m}" for m in fv.RANKING_METRICS)}
        from per a join per b on a.p < b.p""",
    "error_table": f"""with {ERRORS} select *, row_number() over (partition by category order by posting_id) <= 3 as example from errors""",
    "error_summary": f"""with {ERRORS} select category, count(*) as jobs, round_even(count(*) / (select count(*) from eligible), 4) as share_of_binary_eligible_jobs,
        {", ".join(f"count(*) filter (tag_{t}) as tag_{t}" for t in fv.ERROR_TAGS)} from errors group by category""",
    "repeated_evaluation": f"with {REPEATED} select repetition, model, jobs_eligible, {R6([*fv.RANKING_METRICS, 'accuracy', 'macro_f1'])} from per_rep",
    "repetition_summary": f"with {REPEATED}, {SPREAD} select model, metric, {R6(['mean', 'std', 'min', 'max'])}, n_repetitions from summary",
    "paired_differences": f"""with {LONG}, {metrics_sql('by_model', 'model, posting_id', 'score')},
        long_diff as ({" union all ".join(f"select posting_id, '{m}' as metric, any_value({m}) filter (model = 'hybrid') - any_value({m}) filter (model = 'semantic') as diff from per_posting group by posting_id" for m in ('ndcg_10', 'ndcg_5', 'mrr', 'map'))})
        select posting_id, metric, round(diff, 6) + 0.0::double as diff from long_diff where diff is not null""",
    "paired_bootstrap": f"""with {LONG}, {metrics_sql('by_model', 'model, posting_id', 'score')}, {differences_sql('per_posting', 'posting_id')},
        {resamples_sql('long_diff', [], 10_000)}, {INTERVAL},
        observed as (select metric, count(*) as n_jobs, avg(diff) as mean_diff from long_diff group by metric)
        select metric, n_jobs, round(mean_diff, 6) + 0.0::double as mean_diff, round(low, 6) + 0.0::double as ci95_low, round(high, 6) + 0.0::double as ci95_high,
            round(least(1, 2 * tail), 6) as p_two_sided, low > 0 or high < 0 as significant_5pct from observed join bounds using (metric)""",
    "difference_table": f"""with {REFITTED}, by_model as ({" union all ".join(f"select '{m}' as model, posting_id, candidate_id, label_id, {c} as score from preds" for m, c in MODELS.items())}),
        test_rows as (select m.*, s.repetition from by_model m join spread s using (candidate_id) where s.split = 'test'),
        {metrics_sql('test_rows', 'repetition, model, posting_id', 'score')}, {differences_sql('per_posting', 'repetition, posting_id')},
        {resamples_sql('long_diff', ['repetition'], 10_000)}, {INTERVAL},
        rep_cells as (select repetition, model, {", ".join(f"avg({m}) as {m}" for m in fv.RANKING_METRICS)} from per_posting group by all),
        rep_diffs as ({" union all ".join(f"select repetition, '{m}' as metric, any_value({m}) filter (model = 'hybrid') - any_value({m}) filter (model = 'semantic') as diff from rep_cells group by repetition" for m in ('ndcg_10', 'ndcg_5', 'mrr', 'map'))}),
        diff_stats as (select metric, avg(diff) as mean_diff, stddev_samp(diff) as std_diff, min(diff) as min_diff, max(diff) as max_diff,
            count(*) filter (diff > 0) as reps_positive, count(*) as n_repetitions from rep_diffs where diff is not null group by metric),
        units as (select metric, count(*) as n_job_units from long_diff group by metric)
        select metric, {", ".join(f"round({m}, 6) + 0.0::double as {m}" for m in ('mean_diff', 'std_diff', 'min_diff', 'max_diff'))}, reps_positive, n_repetitions,
            round(low, 6) + 0.0::double as ci95_low, round(high, 6) + 0.0::double as ci95_high, n_job_units, low > 0 or high < 0 as ci_excludes_0
        from diff_stats join bounds using (metric) join units using (metric)""",
    "final_report": f"""with {REPEATED}, {SPREAD}, parts as (select *, {PART} as part from by_model),
        {metrics_sql('parts', 'part, model, posting_id', 'score').replace('placed', 'placed2').replace('stats', 'stats2').replace('per_posting', 'per_posting2')},
        two as (select part, model, {", ".join(f"avg({m}) as {m}" for m in fv.RANKING_METRICS)} from per_posting2 group by all)
        select v.model, {", ".join(f"round(v.{m}, 6) as validation_{m}, round(t.{m}, 6) as test_{m}" for m in fv.RANKING_METRICS)},
            {", ".join(f"(select round(mean, 6) from summary s where s.model = v.model and metric = '{m}') as repeated_mean_{m}, (select round(std, 6) from summary s where s.model = v.model and metric = '{m}') as repeated_std_{m}" for m in fv.RANKING_METRICS)}
        from two v join two t on v.model = t.model where v.part = 'validation' and t.part = 'test'""",
    "best_models": f"""with {REPEATED}, {SPREAD} select metric, arg_min(model, (-mean, model)) as model, round(max(mean), 6) as value from summary group by metric""",
    "objectives": f"""with {REPEATED}, {SPREAD}, b as (select metric, arg_min(model, (-mean, model)) as model from summary group by metric)
        select r.model as ranking_model, c.model as classification_model, r.model = c.model as agree from b r, b c
        where r.metric = 'ndcg_10' and c.metric = 'macro_f1'""",
    "stage_verdicts": f"""with {STAGES}, parts as (select *, {PART} as part from configs), {metrics_sql('parts', 'part, configuration, posting_id', 'score')},
        per as (select configuration as stage, avg(ndcg_10) filter (part = 'validation') as validation, avg(ndcg_10) filter (part = 'test') as test
            from per_posting group by all),
        d as (select p.*, p.validation - b.validation as dv, p.test - b.test as dt from per p, per b where b.stage = 'A_semantic_only')
        select stage, round(validation, 6) as validation, round(test, 6) as test, round(dv, 6) as delta_validation, round(dt, 6) as delta_test,
            case when stage = 'A_semantic_only' then 'baseline' when dv < 0 and dt < 0 then 'lower in every view'
                when dv > 0 and dt > 0 then 'higher in every view' else 'mixed across views' end as verdict from d""",
}
