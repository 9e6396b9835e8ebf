"""Pair features, weighted score, weight selection inputs and explanations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom import fixed_values as fv
from pairloom.functions.joins import SMALL_ROWS
from pairloom.functions.ordering import exact_quantiles
from pairloom.session import bucketed, cut_lineage, written


def skill_sets(demanded: DataFrame, offered: DataFrame, left_id: str = "candidate_id", right_id: str = "posting_id") -> tuple[DataFrame, DataFrame]:
    """(candidate, held: its skills) and (posting, asked: its skills with their status): one row a document, bounded by the taxonomy."""
    return (offered.groupBy(left_id).agg(F.array_sort(F.collect_set("skill")).alias("held")),
            demanded.groupBy(right_id).agg(F.array_sort(F.collect_set(F.struct("skill", "status"))).alias("asked")))


def skill_sides(demanded: DataFrame, offered: DataFrame, left_id: str = "candidate_id", right_id: str = "posting_id") -> tuple[DataFrame, DataFrame]:
    """(candidate, _held) and (posting, _required, _preferred, _uncertain): sorted once a document, not once a pair."""
    left, right = skill_sets(demanded, offered, left_id, right_id)
    return left.withColumnRenamed("held", "_held"), right.select(right_id, *[v.alias(f"_{s}") for s, v in asked_lists(F.col("asked")).items()])


def asked_lists(asked: Column) -> dict[str, Column]:
    """Status -> sorted skills asked for with it; asked holds (skill, status)."""
    return {s: F.array_sort(F.transform(F.filter(asked, lambda a: a["status"] == s), lambda a: a["skill"])) for s in fv.STATUS_STRENGTH}


def skill_coverage(asked: Column, held: Column, alpha: float = fv.PREFERRED_ALPHA) -> dict[str, Column]:
    """Coverage columns from sets: asked holds (skill, status), held skills; each pair costs their lengths, in its own row."""
    return list_coverage(asked_lists(asked), held, alpha)


def list_coverage(of: dict[str, Column], held: Column, alpha: float = fv.PREFERRED_ALPHA) -> dict[str, Column]:
    """The same from the lists of each status."""
    matched = {s: F.array_intersect(of[s], held) for s in of}
    n = {s: F.size(of[s]).cast("long") for s in of}
    m = {s: F.size(matched[s]).cast("long") for s in of}
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    out = {f"{s}_skill_count": n[s] for s in of}
    for s in ("required", "preferred"):
        out |= {f"{s}_skills": of[s], f"matched_{s}_skills": matched[s], f"missing_{s}_skills": F.array_except(of[s], held),
                f"{s}_skill_coverage": share(m[s], n[s]), f"missing_{s}_skill_count": n[s] - m[s]}
    return out | {"uncertain_skills": of["uncertain"],
                  "weighted_skill_coverage": share(m["required"] + alpha * m["preferred"], n["required"] + alpha * n["preferred"]),
                  "job_skill_coverage": share(sum(m.values()), sum(n.values()))}


def coverage(pairs: DataFrame, demanded: DataFrame, offered: DataFrame, alpha: float = fv.PREFERRED_ALPHA,
             left_id: str = "candidate_id", right_id: str = "posting_id", lists: bool = True) -> DataFrame:
    """Coverage of a posting's skills (posting, skill, status) by a candidate's skills (candidate, skill).

    Skills are sets in the documents' rows; pairs get them by two joins and are never multiplied by skills.  A skill asked for twice with
    one status counts once; a posting without skills has counts and coverage 0 and empty lists.
    """
    left, right = skill_sides(demanded, offered, left_id, right_id)
    return covered(pairs.join(right, right_id, "left").join(left, left_id, "left"), alpha, lists)


def covered(joined: DataFrame, alpha: float = fv.PREFERRED_ALPHA, lists: bool = True) -> DataFrame:
    """Coverage of pairs that carry the columns of both skill_sides, which are dropped; a missing side is empty."""
    none = F.array().cast("array<string>")
    sides = joined.withColumns({c: F.coalesce(c, none) for c in ("_held", *[f"_{s}" for s in fv.STATUS_STRENGTH])})
    columns = list_coverage({s: F.col(f"_{s}") for s in fv.STATUS_STRENGTH}, F.col("_held"), alpha)
    dropped = ["required_skills", "preferred_skills"] + ([] if lists else [c for c in columns if c.endswith("_skills")])
    return sides.withColumns({c: v for c, v in columns.items() if c not in dropped}).drop("_held", *[f"_{s}" for s in fv.STATUS_STRENGTH])


def with_both_sides(pairs: DataFrame, postings: DataFrame, candidates: DataFrame, left_id: str = "candidate_id",
                    right_id: str = "posting_id", rows: int = SMALL_ROWS, parts: int | None = None) -> tuple[DataFrame, bool]:
    """Slim pairs with the wide rows of both their sides; no pair is shuffled after it has become wide.

    The postings are joined by their key, where pairs dealt by it stay; the candidates are broadcast.  More of them than ``rows`` are taken
    in blocks: pairs are written once by their candidate's block, and each block meets the postings and its own candidates.  Pairs that are dealt by
    posting into ``parts`` are written in as many buckets, and the postings too, so that no block shuffles either of them, however many blocks there
    are; without ``parts`` (a posting is too large for a task) each block's join shuffles both.  Also returned: whether pairs that were dealt by
    posting still are.
    """
    candidates = cut_lineage(candidates)
    blocks = -(-candidates.count() // rows)
    if blocks <= 1:
        return pairs.join(postings, right_id).join(F.broadcast(candidates), left_id), True
    block = F.pmod(F.xxhash64(left_id), F.lit(blocks)).cast("int").alias("_block")
    pairs, candidates = pairs.select("*", block), candidates.select("*", block)
    if parts is None:
        pairs, postings = written(pairs, "_block"), written(postings)
    else:
        pairs, postings = bucketed(pairs, parts, right_id, "_block"), bucketed(postings.repartition(parts, right_id), parts, right_id)
    of = lambda df, i: df.where(F.col("_block") == i).drop("_block")
    parts = [of(pairs, i).join(postings, right_id).join(F.broadcast(of(candidates, i)), left_id) for i in range(blocks)]
    return reduce(DataFrame.unionByName, parts), False


def experience_match(candidate: Column, required: Column) -> Column:
    """Fraction of the required years reached, at most 1; NULL where either is unknown; 1 where none are required."""
    known = candidate.isNotNull() & required.isNotNull()
    return F.when(known, F.when(required <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.try_divide(candidate, required))))


def experience_gap(candidate: Column, required: Column) -> Column:
    gap = required - candidate
    return F.when(gap.isNotNull(), F.greatest(F.lit(0.0), gap))


def education_match(candidate: Column, required: Column) -> Column:
    gap = required - candidate
    return F.when(gap <= 0, 1.0).when(gap == 1, 0.5).when(gap.isNotNull(), 0.0)


def scaler_bounds(features: DataFrame, by: Sequence[str] = (), components: Sequence[str] = ("semantic_similarity", "responsibility_similarity"),
                  low: float = 0.01, high: float = 0.99) -> DataFrame:
    """(component, lo, hi): 1st and 99th percentile of the cosine components, missing values skipped."""
    long = written(features.select(*by, *components)).select(*by, F.explode(F.array(*[
        F.struct(F.lit(c).alias("component"), F.col(c).cast("double").alias("value")) for c in components])).alias("e")).select(*by, "e.*")
    spots = exact_quantiles(long, [*by, "component"], "value", [low, high])
    return spots.groupBy(*by, "component").agg(F.max(F.when(F.col("q_index") == 1, F.col("quantile"))).alias("lo"),
                                               F.max(F.when(F.col("q_index") == 2, F.col("quantile"))).alias("hi"))


def scaled(x: Column, lo: Column, hi: Column) -> Column:
    """Min-max scaled and clipped; unknown stays unknown (least and greatest alone would skip the NULL)."""
    return F.when(x.isNotNull(), F.least(F.greatest(F.try_divide(x - lo, hi - lo), F.lit(0.0)), F.lit(1.0)))


def component_values(bounds: dict[str, tuple]) -> dict[str, Column]:
    """Component -> value in [0, 1], NULL where there is nothing to measure.  bounds holds (lo, hi) numbers or columns."""
    values = {}
    for name in fv.COMPONENTS:
        value = F.col(name).cast("double")
        if name in bounds:
            lo, hi = (b if isinstance(b, Column) else F.lit(float(b)) for b in bounds[name])
            value = scaled(value, lo, hi)
        if name in fv.COUNT_OF_COVERAGE:
            value = F.when(F.col(fv.COUNT_OF_COVERAGE[name]) > 0, value)
        values[name] = value
    return values


def combine(values: dict[str, Column], weights: dict[str, Column | float]) -> Column:
    """Weighted mean of the components that are there; a missing one takes its weight with it; 0 if none is there."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, w in weights.items():
        w = w if isinstance(w, Column) else F.lit(float(w))
        total = total + F.when(values[name].isNotNull(), w * values[name]).otherwise(0.0)
        weight = weight + F.when(values[name].isNotNull(), w).otherwise(0.0)
    return F.coalesce(F.try_divide(total, weight), F.lit(0.0))


def configuration_scores(features: DataFrame, configurations: dict[str, Sequence[float]], bounds: dict[str, tuple],
                         keep: Sequence[str]) -> DataFrame:
    """One row per pair and configuration with its score: computed in the row and exploded; nothing is joined."""
    return configuration_rows(configuration_values(features, configurations, bounds, keep), configurations, keep)


def configuration_values(features: DataFrame, configurations: dict[str, Sequence[float]], bounds: dict[str, tuple], keep: Sequence[str]) -> DataFrame:
    """One row per pair with the array of all configurations' scores."""
    values = component_values(bounds)
    valued = features.select(*keep, *[v.alias(f"_v_{n}") for n, v in values.items()])
    named = {n: F.col(f"_v_{n}") for n in values}
    return valued.select(*keep, F.array(*[combine(named, dict(zip(fv.COMPONENTS, w))) for w in configurations.values()]).alias("_scores"))


def configuration_rows(values: DataFrame, configurations: dict[str, Sequence[float]], keep: Sequence[str]) -> DataFrame:
    """(keep, config_index, configuration, score) of the arrays of scores.

    The arrays are never NULL or empty, so the outer form gives the same rows; for the plain one Spark infers a filter on the array's size, which it
    pushes below shuffles and into joins with all formulas of the scores written out.
    """
    names = F.array(*map(F.lit, configurations))
    return values.select(*keep, F.posexplode_outer("_scores").alias("config_index", "score")).select(
        *keep, "config_index", F.get(names, F.col("config_index")).alias("configuration"), "score")


def ablation_configurations(selected: str) -> dict[str, list[float]]:
    """Initial weights cut to the first components of each stage, then the selected weights."""
    initial = fv.WEIGHTINGS["A_initial"]
    stages = {name: initial[:n] for name, n in fv.ABLATION_STAGES.items()}
    return stages | {f"F_final ({selected})": fv.WEIGHTINGS[selected]}


def explain(features: DataFrame, weights: dict[str, float], bounds: dict[str, tuple]) -> DataFrame:
    """Score, component values (NULL = left out), components used, strengths and gaps per pair."""
    values = component_values(bounds)
    used = F.array_compact(F.array(*[F.when(values[n].isNotNull(), F.lit(n)) for n in weights]))
    components = F.struct(*[values[n].alias(n) for n in fv.COMPONENTS])
    out = features.withColumn("components", components).withColumn("components_used", used)
    out = out.withColumn("overall_score", combine(values, weights))
    strengths, gaps = narrative()
    return out.withColumn("strengths", strengths).withColumn("gaps", gaps)


def narrative() -> tuple[Column, Column]:
    """Template sentences from feature values only."""
    n_req, matched = F.col("required_skill_count"), F.size("matched_required_skills")
    found = F.concat(matched.cast("string"), F.lit(" of "), n_req.cast("string"), F.lit(" required skills found"))
    covered = F.col("required_skill_coverage") >= 0.75
    listed = lambda c: F.array_join(c, ", ")
    match, c = F.col("experience_match"), F.col("components")
    years, wanted = F.format_string("%.1f", F.bround("candidate_experience_years", 1)), F.format_string("%.0f", F.bround("required_experience_years", 0))
    similar = lambda field, what, strong: F.when(
        (c[field] >= 0.66) if strong else (c[field] < 0.33),
        F.lit(f"{'Strong' if strong else 'Weak'} similarity between the {what} and the job"))
    sides = [("semantic_similarity", "overall profile"), ("responsibility_similarity", "past duties")]
    strengths = [
        F.when((n_req > 0) & covered, F.concat(found, F.lit(": "), listed("matched_required_skills"))),
        F.when(F.size("matched_preferred_skills") > 0, F.concat(F.lit("Preferred skills found: "), listed("matched_preferred_skills"))),
        F.when(match >= 1, F.concat(F.lit("Meets the experience requirement ("), years, F.lit(" vs "), wanted, F.lit(" years)"))),
        *[similar(f, w, True) for f, w in sides]]
    gaps = [
        F.when(n_req == 0, F.lit("No required skills were detected in the job description, so skill coverage was not scored"))
        .when(~covered, F.concat(found, F.lit("; missing: "), listed("missing_required_skills"))),
        F.when(match < 1, F.concat(F.lit("Estimated experience "), years, F.lit(" years is below the "), wanted, F.lit(" years requested"))),
        *[similar(f, w, False) for f, w in sides]]
    return F.array_compact(F.array(*strengths)), F.array_compact(F.array(*gaps))


def audit_checks(explained: DataFrame, weights: dict[str, float], saved_score: str = "saved_score") -> DataFrame:
    """Boolean checks of explained pairs that also carry candidate_skills, required_skills and preferred_skills arrays,
    candidate_text, posting_text, skill_evidence (array of sentences) and responsibility_evidence (array of structs)."""
    c = lambda n: F.col(n)
    none = lambda a: F.size(a) == 0
    missing = F.array_union("missing_required_skills", "missing_preferred_skills")
    same = lambda a, b: none(F.array_except(a, b)) & none(F.array_except(b, a))
    expected_gap = experience_gap(c("candidate_experience_years"), c("required_experience_years"))
    close = lambda a, b, tol: F.abs(a - b) <= tol
    total, weight = F.lit(0.0), F.lit(0.0)
    for name, w in weights.items():
        here = F.array_contains("components_used", name)
        total = total + F.when(here, w * c("components")[name]).otherwise(0.0)
        weight = weight + F.when(here, F.lit(w)).otherwise(0.0)
    checks = {
        "missing_absent": ~F.arrays_overlap(missing, "candidate_skills"),
        "matched_present": none(F.array_except("matched_required_skills", "candidate_skills"))
        & none(F.array_except("matched_preferred_skills", "candidate_skills"))
        & none(F.array_except("matched_required_skills", "required_skills"))
        & none(F.array_except("matched_preferred_skills", "preferred_skills")),
        "matched_plus_missing_complete": same(F.array_union("matched_required_skills", "missing_required_skills"), c("required_skills"))
        & same(F.array_union("matched_preferred_skills", "missing_preferred_skills"), c("preferred_skills")),
        "experience_gap": F.coalesce(close(c("experience_gap"), expected_gap, 1e-9),
                                     c("experience_gap").isNull() & expected_gap.isNull()),
        "responsibility_evidence_in_text": F.forall("responsibility_evidence", lambda e: F.contains("candidate_text", e["evidence"])
                                                    & F.contains("posting_text", e["duty"])),
        "skill_evidence_in_text": F.forall("skill_evidence", lambda s: F.contains("candidate_text", s)),
        "score_recomposes": close(F.coalesce(F.try_divide(total, weight), F.lit(0.0)), c("overall_score"), 1e-9),
        "score_matches_saved": close(c("overall_score"), c(saved_score), 1e-9),
    }
    return explained.select("candidate_id", "posting_id", *[F.coalesce(v, F.lit(False)).alias(f"ok_{k}") for k, v in checks.items()])


def audit_summary(checked: DataFrame) -> DataFrame:
    flags = [x for x in checked.columns if x.startswith("ok_")]
    everything = F.lit(True)
    for f in flags:
        everything = everything & F.col(f)
    return checked.agg(F.count("*").alias("pairs_checked"), *[F.count_if(f).alias(f[3:]) for f in flags],
                       F.bool_and(everything).alias("all_pass"))
