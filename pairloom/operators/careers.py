"""Experience, education and duties read from labelled pieces of a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom import fixed_values as fv
from pairloom.functions.binding import let
from pairloom.functions.spans import match_spans
from pairloom.operators.sections import GLUE_BEFORE, cues, nearest_cue

# Patterns of years and dates.
_NUMBER = r"(\d{1,2}(?:\.\d)?|" + "|".join(fv.NUMBER_WORDS) + ")"
REQUIRED_YEARS = (rf"(?iU)(?<![\d.]){_NUMBER}\s*(?:\(\d{{1,2}}\)\s*)?\+?\s*(?:(?:-|–|—|to)\s*{_NUMBER}\s*\+?\s*)?"
                  r"(?:or more\s+|plus\s+)?(?:years?|yrs?)\b")
_DATE = (r"(?:(?:" + "|".join(fv.MONTHS) + r")[a-z]*\.?\s*,?\s*(?:19|20)\d\d|\d{1,2}\s*/\s*(?:19|20)\d\d|(?:19|20)\d\d)")
DATE_RANGE = (rf"(?iU)(?<!\d)({_DATE})\s*(?:-|–|—|to|until|thru|through)\s*({_DATE}|present|current|now|today)")
STATED_YEARS = r"(?iU)(?<![\d.])(\d{1,2})\s*\+?\s*(?:years?|yrs?)\s+(?:of\s+)?(?:[\w-]+\s+){0,4}?experience"
INTERVAL = "array<struct<start:int,stop:int>>"


def number_value(text: Column) -> Column:
    words = F.create_map(*[F.lit(x) for kv in fv.NUMBER_WORDS.items() for x in kv])
    return F.coalesce(F.try_element_at(words, F.lower(text)).cast("double"), text.try_cast("double"))


def required_experience(pieces: Column, glued: bool = False) -> Column:
    """(min_years, max_years, preferred_years, evidence) from the pieces that mention experience.

    The strictest minimum is the requirement; years not marked preferred count as required; three evidence sentences.
    """
    def read(p):
        return let(cues(p["text"], glued), lambda found: F.transform(match_spans(p["text"], REQUIRED_YEARS), lambda m: F.struct(
            number_value(F.regexp_extract(m["text"], REQUIRED_YEARS, 1)).alias("lo"),
            number_value(F.nullif(F.regexp_extract(m["text"], REQUIRED_YEARS, 2), F.lit(""))).alias("hi"),
            (F.coalesce(nearest_cue(found, m["start"]), p["section"]) == "preferred").alias("is_preferred"), p["text"].alias("evidence"))))

    relevant = F.filter(pieces, lambda p: p["text"].rlike("(?iU)experien"))
    years = F.filter(F.flatten(F.transform(relevant, read)), lambda y: (y["lo"] > 0) & (y["lo"] <= fv.MAX_REQUIRED_YEARS))
    return let(years, _required_years)


def _required_years(years: Column) -> Column:
    required, preferred = F.filter(years, lambda y: ~y["is_preferred"]), F.filter(years, lambda y: y["is_preferred"])
    strictest = F.array_max(F.transform(required, lambda y, i: F.struct(y["lo"].alias("lo"), (-i).alias("first"), y["hi"].alias("hi"))))
    return F.struct(strictest["lo"].alias("min_years"), strictest["hi"].alias("max_years"),
                    F.array_max(F.transform(preferred, lambda y: y["lo"])).alias("preferred_years"),
                    F.slice(F.transform(years, lambda y: y["evidence"]), 1, 3).alias("evidence"))


def month_number(date: Column) -> Column:
    """Months since year 0 of "MM/YYYY", "Mon YYYY" or "YYYY" (January); NULL otherwise."""
    d = F.replace(F.lower(date), F.lit(" "), F.lit(""))
    months = F.create_map(*[F.lit(x) for i, m in enumerate(fv.MONTHS, 1) for x in (m, i)])
    year = F.regexp_extract(d, r"((?:19|20)\d\d)$", 1).try_cast("int")
    numeric = F.regexp_extract(d, r"^(\d{1,2})/(?:19|20)\d\d$", 1).try_cast("int")
    named = F.try_element_at(months, F.regexp_extract(d, r"^([a-z]{3})[a-z]*\.?,?(?:19|20)\d\d$", 1))
    month = (F.when(d.rlike(r"^\d{1,2}/(?:19|20)\d\d$"), F.when(numeric.between(1, 12), numeric))
             .when(d.rlike(r"^[a-z]{3}[a-z]*\.?,?(?:19|20)\d\d$"), named).when(d.rlike(r"^(?:19|20)\d\d$"), F.lit(1)))
    return (year * 12 + month - 1).cast("int")


def interval_union(intervals: Column) -> Column:
    """Total length of a set of (start, stop) intervals; overlapping and touching ones count once."""
    def step(acc, x):
        apart = x["start"] > acc["stop"]
        return F.struct(
            F.when(apart, acc["total"] + acc["stop"] - acc["start"]).otherwise(acc["total"]).alias("total"),
            F.when(apart, x["start"]).otherwise(acc["start"]).alias("start"),
            F.when(apart, x["stop"]).otherwise(F.greatest(acc["stop"], x["stop"])).alias("stop"))

    def joined(ordered):
        zero = F.struct(F.lit(0).alias("total"), F.get(ordered, 0)["start"].alias("start"), F.get(ordered, 0)["stop"].alias("stop"))
        return F.aggregate(ordered, zero, step, lambda acc: acc["total"] + acc["stop"] - acc["start"])

    return let(F.array_sort(intervals), lambda ordered: F.when(F.size(ordered) > 0, joined(ordered)).otherwise(F.lit(0)))


def candidate_experience(text: Column, blocks: Column) -> Column:
    """(total_years, source, date_ranges, stated_years).

    Date ranges outside education, overlaps counted once, "present" read as the latest date of the same text; where no
    range is usable, the largest stated number of years.
    """
    elsewhere = F.filter(blocks, lambda b: b["section"] != "education")
    ranges = F.flatten(F.transform(elsewhere, lambda b: F.zip_with(
        F.regexp_extract_all(b["text"], F.lit(DATE_RANGE), F.lit(1)), F.regexp_extract_all(b["text"], F.lit(DATE_RANGE), F.lit(2)),
        lambda a, z: F.struct(month_number(a).alias("start"), month_number(z).alias("stop"), z.rlike("(?U)^[a-zA-Z]+$").alias("is_open")))))
    latest = lambda ranges: F.array_max(F.flatten(F.transform(ranges, lambda r: F.array(r["start"], F.when(~r["is_open"], r["stop"])))))
    closed = lambda ranges, latest: F.transform(ranges, lambda r: F.struct(
        r["start"].alias("start"), F.when(r["is_open"], latest).otherwise(r["stop"]).alias("stop")))
    usable = lambda r: F.coalesce((r["stop"] - r["start"]).between(0, fv.MAX_CAREER_YEARS * 12), F.lit(False))
    intervals = let(ranges, latest, lambda ranges, latest: F.filter(closed(ranges, latest), usable))
    stated = F.array_max(F.filter(F.transform(F.regexp_extract_all(text, F.lit(STATED_YEARS), F.lit(1)), lambda y: y.try_cast("int")),
                                  lambda y: y <= fv.MAX_CAREER_YEARS))
    return let(intervals, lambda i: stated, _experience_record)


def _experience_record(intervals: Column, stated: Column) -> Column:
    dated = F.size(intervals) > 0
    years = F.bround(interval_union(intervals) / F.lit(12.0), 2)
    return F.struct(F.when(dated, years).otherwise(stated.cast("double")).alias("total_years"),
                    F.when(dated, "dates").when(stated.isNotNull(), "stated").alias("source"),
                    F.when(dated, F.size(intervals)).otherwise(0).alias("date_ranges"), stated.alias("stated_years"))


def degree_pattern(level: int) -> str:
    return f"(?U){GLUE_BEFORE}(?:{fv.DEGREE_PATTERNS[level]})(?![a-z])"


def degree_levels(text: Column) -> Column:
    """Degree levels named in a text, highest first."""
    return F.array_compact(F.array(*[F.when(text.rlike(degree_pattern(l)), F.lit(l)) for l in fv.DEGREE_PATTERNS]))


def degree_name(level: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in fv.DEGREE_NAMES.items() for x in kv]), level)


def education_requirement(pieces: Column, glued: bool = False) -> Column:
    """(required_level, preferred_level): lowest level asked for, highest level preferred."""
    def read(p):
        return let(cues(p["text"], glued), lambda found: F.flatten(F.array(*[of_level(level, p, found) for level in fv.DEGREE_PATTERNS])))

    def of_level(level, p, found):
        return F.transform(F.slice(match_spans(p["text"], degree_pattern(level)), 1, 1), lambda m: F.struct(
            F.lit(level).alias("level"), (F.coalesce(nearest_cue(found, m["start"]), p["section"]) == "preferred").alias("is_preferred")))

    named = F.flatten(F.transform(pieces, read))
    level = lambda named, want: F.transform(F.filter(named, lambda d: d["is_preferred"] if want else ~d["is_preferred"]), lambda d: d["level"])
    return let(named, lambda n: F.struct(F.array_min(level(n, False)).alias("required_level"),
                                         F.array_max(level(n, True)).alias("preferred_level")))


def candidate_degree(text: Column) -> Column:
    return F.array_max(degree_levels(text))


def statements(pieces: Column, keep, min_words: int = fv.MIN_DUTY_WORDS) -> Column:
    """Distinct texts of the kept pieces with enough words, in order."""
    count = lambda t: F.size(F.split(t, r"(?U)\s+"))
    chosen = F.filter(pieces, lambda p: keep(p["section"]) & (count(p["text"]) >= min_words))
    return F.array_distinct(F.transform(chosen, lambda p: p["text"]))


def _first(items: Column, limit: int | None) -> Column:
    return items if limit is None else F.slice(items, 1, limit)


def duties(pieces: Column, limit: int | None = None) -> Column:
    """(statements, from_section): sentences of the responsibilities section, else of everything but "other"; all, or the first ``limit``."""
    own = statements(pieces, lambda s: s == "responsibilities")
    rest = statements(pieces, lambda s: s != "other")
    return let(own, lambda own: F.struct(_first(F.when(F.size(own) > 0, own).otherwise(rest), limit).alias("statements"),
                                         (F.size(own) > 0).alias("from_section")))


def evidence(pieces: Column, limit: int | None = None) -> Column:
    """Sentences of the experience section, else of everything but education; all, or the first ``limit``."""
    own = statements(pieces, lambda s: s == "experience")
    rest = statements(pieces, lambda s: s != "education")
    return let(own, lambda own: _first(F.when(F.size(own) > 0, own).otherwise(rest), limit))
