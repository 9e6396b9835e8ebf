"""Line-structured posting pages: required and preferred skills, seniority, duties, education phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom import fixed_values as fv
from pairloom.functions.binding import let
from pairloom.functions.text import strip, unbulleted
from pairloom.operators.profiles import section_slice
from pairloom.operators.skills import tag_by_ngrams

# Section headers, patterns and the default phrase.
PREFERRED_HEADER = r"(?i)(?:preferred qualifications|nice to have|bonus points|preferred skills|plus if you have)\s*[:\n]"
AFTER_PREFERRED = r"(?i)\n\s*(?:benefits|about us|what we offer|responsibilities|compensation)\s*[:\n]"
DUTIES_HEADER = r"(?i)(?:responsibilities|what you will do|what you'll do|day to day|key duties|role overview)\s*[:\n]"
AFTER_DUTIES = r"(?i)\n\s*(?:requirements|qualifications|what we offer|benefits|about you)\s*[:\n]"
YEARS = (r"(?i)(\d+)\s*(?:-|–|\+)?\s*(?:to\s*\d+\s*)?years?(?:\s+of)?(?:\s+relevant|\s+professional|\s+commercial)?\s+experience")
DEGREE_PHRASE = (r"(?i)(?:bachelor'?s?|master'?s?|phd|doctorate|degree\s+in\s+computer\s+science|b\.?s\.?|m\.?s\.?)[^.\n]*")
DEFAULT_EDUCATION = "Bachelor's degree in Computer Science, related technical field, or equivalent practical experience"


def preferred_text(text: Column) -> Column:
    """The preferred section including its header; empty without one."""
    return F.coalesce(F.concat(F.regexp_extract(text, PREFERRED_HEADER, 0), section_slice(text, PREFERRED_HEADER, AFTER_PREFERRED, None)), F.lit(""))


def posting_requirements(docs: DataFrame, aliases: DataFrame, id: str = "posting_id", text: str = "text") -> DataFrame:
    """(id, skill, category, position, status): skills of the preferred section are preferred, all others required.

    Where everything would be preferred, the first 70 % (rounded up, in taxonomy order) become required.
    aliases: (alias, skill, category, position).
    """
    everywhere = tag_by_ngrams(docs, aliases, id, text)
    section = docs.select(id, preferred_text(F.col(text)).alias("_p")).where(F.col("_p") != "")
    optional = tag_by_ngrams(section, aliases, id, "_p").select(id, "skill").withColumn("_opt", F.lit(True))
    marked = everywhere.join(optional, [id, "skill"], "left")
    per = marked.groupBy(id).agg(F.sort_array(F.collect_list(F.struct(  # one posting's skills: at most the taxonomy
        "position", "skill", "category", F.col("_opt").isNotNull().alias("optional")))).alias("_s"))
    promoted = F.when(F.forall("_s", lambda s: s["optional"]), F.ceil(F.size("_s") * F.lit(0.7)))
    judged = let(promoted, lambda promoted: F.transform("_s", lambda s, i: F.struct(
        s["skill"].alias("skill"), s["category"].alias("category"), s["position"].alias("position"),
        F.when(F.coalesce(i >= promoted, s["optional"]), "preferred").otherwise("required").alias("status"))))
    return per.select(id, F.explode(judged).alias("s")).select(id, "s.*")


def seniority(text: Column, title: Column | None = None) -> Column:
    low = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")) if title is not None else F.lit(""), text))
    out = None
    for level, pattern in fv.SENIORITY_PATTERNS:
        out = F.when(low.rlike(pattern), level) if out is None else out.when(low.rlike(pattern), level)
    return out.otherwise("mid")


def min_years(text: Column, level: Column) -> Column:
    """Stated years of experience, else the level's default."""
    default = F.element_at(F.create_map(*[F.lit(x) for kv in fv.DEFAULT_YEARS.items() for x in kv]), level)
    return F.coalesce(F.regexp_extract(text, YEARS, 1).try_cast("int"), default)


def duty_lines(text: Column) -> Column:
    """Up to eight lines of the duties section, else up to five long lines of the whole text."""
    shaped = lambda t, low, high: F.filter(F.transform(F.split(t, "\n"), unbulleted), lambda l: F.length(l).between(low, high))
    section = section_slice(text, DUTIES_HEADER, AFTER_DUTIES, 1000)
    return let(section, lambda s: F.when(s.isNotNull(), F.slice(shaped(s, 16, 249), 1, 8)).otherwise(F.slice(shaped(text, 26, 199), 1, 5)))


def education_phrases(text: Column) -> Column:
    named = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(DEGREE_PHRASE), F.lit(0)), strip))
    return let(named, lambda named: F.when(F.size(named) > 0, named).otherwise(F.array(F.lit(DEFAULT_EDUCATION))))


def parse_adverts(docs: DataFrame, requirements: DataFrame, id: str = "posting_id", text: str = "text", title: str | None = "title") -> DataFrame:
    """Full posting record per document; requirements come from posting_requirements.  Skills are in taxonomy order."""
    names = lambda status: F.transform(F.array_sort(F.collect_set(F.when(F.col("status") == status, F.struct("position", "skill")))), lambda s: s["skill"])
    asked = requirements.groupBy(id).agg(names("required").alias("required_skills"), names("preferred").alias("preferred_skills"))
    empty = F.array().cast("array<string>")
    out = docs.join(asked, id, "left").withColumns({c: F.coalesce(c, empty) for c in ("required_skills", "preferred_skills")})
    t = F.col(text)
    out = out.withColumn("seniority", seniority(t, F.col(title) if title else None))
    return out.withColumns({"min_years": min_years(t, F.col("seniority")), "duties": duty_lines(t), "education_asked": education_phrases(t)})
