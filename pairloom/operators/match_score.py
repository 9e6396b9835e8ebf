"""Five-part weighted match score of (candidate, posting) pairs, with strengths, gaps and ordered advice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.binding import let
from pairloom.functions.numbers import clamp, half_up
from pairloom.operators.lexical import bag_cosine

# Weights of the five parts.
PART_WEIGHTS = {"skills_score": 0.40, "experience_score": 0.25, "responsibilities_score": 0.20, "education_score": 0.10, "format_score": 0.05}


def named_skills(demanded: DataFrame, offered: DataFrame, synonyms: DataFrame | None = None, left_id: str = "candidate_id",
                 right_id: str = "posting_id") -> tuple[DataFrame, DataFrame]:
    """(candidate, _held: its skills' names) and (posting, _asked: its skills in taxonomy order, each with the names that meet it).

    demanded: (posting, skill, status, position); position is the place in the taxonomy, 0 where the table has none.  synonyms:
    (skill, synonym).  Names are compared in lower case.  One row a document, bounded by the taxonomy.
    """
    place = F.col("position") if "position" in demanded.columns else F.lit(0)
    asked = demanded.select(right_id, "skill", "status", place.alias("position"), F.lower("skill").alias("_name"))
    names = F.array("_name")
    if synonyms is not None:
        also = synonyms.groupBy(F.lower("skill").alias("_name")).agg(F.collect_set(F.lower("synonym")).alias("_also"))
        asked = asked.join(also, "_name", "left")
        names = F.concat(names, F.coalesce("_also", F.array().cast("array<string>")))
    row = F.struct("position", "skill", "status", F.array_sort(names).alias("names"))
    return (offered.groupBy(left_id).agg(F.collect_set(F.lower("skill")).alias("_held")),
            asked.groupBy(right_id).agg(F.array_sort(F.collect_set(row)).alias("_asked")))


def skills_score(required_met: Column, required: Column, preferred_met: Column, preferred: Column) -> Column:
    """75 % required and 25 % preferred, rounded, 20..100; an empty list counts as one unmet skill."""
    part = lambda met, n: met / F.greatest(n, F.lit(1)) * 100
    return clamp(half_up(part(required_met, required) * 0.75 + part(preferred_met, preferred) * 0.25), 20, 100).cast("int")


def skill_part(pairs: DataFrame, demanded: DataFrame, offered: DataFrame, synonyms: DataFrame | None = None, left_id: str = "candidate_id",
               right_id: str = "posting_id") -> DataFrame:
    """Add skills_score, n_matched and the lists of missing skills, in taxonomy order, to the pairs.

    A posting's skill is met by the skill itself or by any of its synonyms.  Both sides' skills are sets in the row: two joins, and no row is
    multiplied by skills.
    """
    left, right = named_skills(demanded, offered, synonyms, left_id, right_id)
    return skills_met(pairs.join(right, right_id, "left").join(left, left_id, "left"))


def skills_met(joined: DataFrame) -> DataFrame:
    """The same of pairs that carry _held and _asked of named_skills, which are dropped; a missing side is empty."""
    held = F.coalesce("_held", F.array().cast("array<string>"))
    # Of all names that would do only those held are looked through for each skill.
    sets = joined.withColumn("_found", F.array_intersect(F.flatten(F.transform("_asked", lambda a: a["names"])), held))
    met = lambda a: F.arrays_overlap(a["names"], F.col("_found"))
    of = lambda status, wanted: F.filter("_asked", lambda a: (a["status"] == status) & wanted(a))
    n = lambda some: F.coalesce(F.size(some), F.lit(0))
    names = lambda some: F.coalesce(F.transform(some, lambda a: a["skill"]), F.array().cast("array<string>"))
    every = lambda a: F.lit(True)
    counted = sets.withColumns({f"_{k}_{s}": F.when(F.col("_asked").isNull(), 0).otherwise(n(of(s, w)))
                                for s in ("required", "preferred") for k, w in (("n", every), ("m", met))})
    return counted.withColumns({
        "skills_score": skills_score(*[F.col(c) for c in ("_m_required", "_n_required", "_m_preferred", "_n_preferred")]),
        "n_matched": (F.col("_m_required") + F.col("_m_preferred")).cast("int"),
        "missing_required": names(of("required", lambda a: ~met(a))), "missing_preferred": names(of("preferred", lambda a: ~met(a))),
    }).drop("_n_required", "_n_preferred", "_m_required", "_m_preferred", "_asked", "_held", "_found")


def bonus_skills(offered: Column, required: Column, preferred: Column, n: int = 8) -> Column:
    """Skills of the candidate the posting does not name, first n in the order they are given in."""
    low = lambda a: F.transform(a, lambda s: F.lower(s))
    return let(F.concat(low(required), low(preferred)), lambda named: F.slice(
        F.filter(offered, lambda s: ~F.array_contains(named, F.lower(s))), 1, n))


def context_of(skill: Column, items: Column) -> Column:
    """Company and first 100 characters of the first bullet that names the skill."""
    lines = F.flatten(F.transform(items, lambda e: F.transform(e["bullets"], lambda b: F.struct(e["company"].alias("c"), b.alias("b")))))
    hit = F.get(F.filter(lines, lambda l: F.contains(F.lower(l["b"]), F.lower(skill))), 0)
    return F.concat(hit["c"], F.lit(': "'), F.substring(hit["b"], 1, 100), F.lit('..."'))


def experience_part(candidate: Column, required: Column) -> tuple[Column, Column]:
    """(score, status): two years above 100 exceeds; enough 90 meets; else the share of 85, at least 35, under."""
    status = F.when(candidate >= required + 2, "exceeds").when(candidate >= required, "meets").otherwise("under")
    under = F.greatest(half_up(F.try_divide(candidate, required) * 85), F.lit(35))
    return F.when(status == "exceeds", 100).when(status == "meets", 90).otherwise(under).cast("int"), status


def responsibilities_part(pairs: DataFrame, keys: Sequence[str], bullets: str, duties: str) -> DataFrame:
    """Term-count cosine of bullets and duties, stretched to 40..98; 75 where either is empty."""
    scored = bag_cosine(pairs, keys, bullets, duties)
    empty = (F.coalesce(bullets, F.lit("")) == "") | (F.coalesce(duties, F.lit("")) == "")
    stretched = clamp(half_up(35 + F.col("similarity") * 110), 40, 98)
    return scored.withColumn("responsibilities_score", F.when(empty, 75).otherwise(stretched).cast("int"))


def education_part(entries: Column) -> Column:
    """60 without education, 80 with any, 92 with a technical field, 100 with a master's in it."""
    text = F.lower(F.array_join(F.transform(entries, lambda e: F.concat_ws(" ", e["degree"], e["institution"])), " "))
    technical = text.rlike("computer science|software|engineering|information technology")
    master = text.rlike(r"master|m\.s\.|phd")
    return F.when(F.size(entries) == 0, 60).when(master & technical, 100).when(technical, 92).otherwise(80)


def format_part(check_score: Column) -> Column:
    return clamp(check_score, 30, 100)


def overall_score() -> Column:
    total = F.lit(0.0)
    for name, w in PART_WEIGHTS.items():
        total = total + F.col(name) * w
    return half_up(total).cast("int")


def strengths_and_gaps() -> tuple[Column, Column]:
    """Sentences from skills_score, n_matched, missing_required, experience_status, years, responsibilities_score, check_score."""
    s = lambda c: F.col(c).cast("string")
    strengths = [
        F.when(F.col("skills_score") >= 75, F.concat(F.lit("Strong technical stack alignment: Matched "), s("n_matched"), F.lit(" critical and preferred skills."))),
        F.when(F.col("experience_status") != "under", F.concat(
            F.lit("Seniority fit: Candidate meets the target experience requirements ("), s("candidate_years"), F.lit(" yrs vs "),
            s("required_years"), F.lit(" yrs required)."))),
        F.when(F.col("responsibilities_score") >= 75, F.lit("High semantic alignment between past work accomplishments and day-to-day job responsibilities.")),
        F.when(F.col("check_score") >= 80, F.lit("Clean, machine-readable ATS formatting with recognizable sections and contact fields."))]
    missing = F.size("missing_required")
    gaps = [
        F.when(missing > 0, F.concat(F.lit("Missing "), missing.cast("string"), F.lit(" high-priority required skills: "),
                                     F.array_join(F.slice("missing_required", 1, 3), ", "), F.lit("."))),
        F.when(F.col("experience_status") == "under", F.concat(
            F.lit("Candidate experience ("), s("candidate_years"), F.lit(" yrs) is under the target threshold ("), s("required_years"), F.lit(" yrs)."))),
        F.when(F.col("check_score") < 75, F.lit("Resume formatting has potential ATS parse bottlenecks (missing sections or metrics)."))]
    return F.array_compact(F.array(*strengths)), F.array_compact(F.array(*gaps))


def advice() -> Column:
    """[(priority, title)] by impact."""
    top = F.array_join(F.slice("missing_required", 1, 2), " and ")
    entry = lambda when, priority, title: F.when(when, F.struct(F.lit(priority).alias("priority"), title.alias("title")))
    return F.array_compact(F.array(
        entry(F.size("missing_required") > 0, "high", F.concat(F.lit("Incorporate Missing Core Skills: "), top)),
        entry(F.lit(True), "high", F.lit("Strengthen Bullet Points with Quantifiable Metrics")),
        entry(F.col("experience_status") == "under", "medium", F.lit("Highlight High-Ownership & Accelerated Leadership"))))


def match_records(pairs: DataFrame, profiles: DataFrame, adverts: DataFrame, requirements: DataFrame, tagged: DataFrame,
                  synonyms: DataFrame | None = None) -> DataFrame:
    """The full match table of (candidate_id, posting_id) pairs from parsed profiles and adverts."""
    bullets = F.array_join(F.flatten(F.transform("experience", lambda e: e["bullets"])), " ")
    left = profiles.select("candidate_id", F.col("years").alias("candidate_years"), F.col("checks.score").alias("check_score"),
                           education_part(F.col("education")).alias("education_score"), bullets.alias("_bullets"),
                           F.transform("skills", lambda s: s["skill"]).alias("_offered"))
    right = adverts.select("posting_id", F.col("min_years").alias("required_years"), F.array_join("duties", " ").alias("_duties"),
                           "required_skills", "preferred_skills")
    both = pairs.select("candidate_id", "posting_id").distinct().join(left, "candidate_id").join(right, "posting_id")
    both = skill_part(both, requirements, tagged, synonyms)
    both = responsibilities_part(both, ["candidate_id", "posting_id"], "_bullets", "_duties")
    score, status = experience_part(F.col("candidate_years"), F.col("required_years"))
    both = both.withColumns({"experience_score": score, "experience_status": status, "format_score": format_part(F.col("check_score")),
                             "bonus_skills": bonus_skills(F.col("_offered"), F.col("required_skills"), F.col("preferred_skills"))})
    both = both.withColumn("overall_score", overall_score())
    strengths, gaps = strengths_and_gaps()
    return both.withColumns({"strengths": strengths, "gaps": gaps, "advice": advice()}).drop(
        "_bullets", "_duties", "_offered", "similarity", "required_skills", "preferred_skills")


def score_band(score: Column) -> Column:
    return F.when(score >= 80, "Exceptional Alignment").when(score >= 65, "Moderate Match").otherwise("Significant Skill Gaps")
