"""Taxonomy mentions, candidate skills and posting skills with their status.

The taxonomy is a parameter: a table or file of canonical names with aliases (any case) and case-sensitive aliases.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairloom import fixed_values as fv
from pairloom.functions.binding import let
from pairloom.functions.joins import join_small
from pairloom.functions.spans import last_started, match_spans
from pairloom.functions.text import ngrams
from pairloom.operators.sections import cues, nearest_cue
from pairloom.session import written

# What bounds a skill name in glued text.
BEFORE = r"(?:(?<![A-Za-z0-9+#])|(?<=[a-z])(?=[A-Z]))"
AFTER = r"(?:(?![A-Za-z0-9+#])|(?<=[a-z])(?=[A-Z]))"
MAX_ALIASES = 10_000


@dataclass(frozen=True)
class Taxonomy:
    insensitive: dict[str, str]   # lower-case alias -> canonical name
    sensitive: dict[str, str]     # exact alias -> canonical name
    category: dict[str, str]      # canonical name -> category

    def pattern(self) -> str:
        """One alternation, longest alias first, so that a longer name is never read as a shorter one inside it."""
        quoted = lambda a: re.sub(r"([^A-Za-z0-9\s_])", r"\\\1", a)
        aliases = [(a, f"(?i:{quoted(a)})") for a in self.insensitive] + [(a, quoted(a)) for a in self.sensitive]
        body = "|".join(p for _, p in sorted(aliases, key=lambda x: (-len(x[0]), x[0])))
        return f"{BEFORE}(?:{body}){AFTER}"

    def canonical(self, found: Column) -> Column:
        exact = F.create_map(*[F.lit(x) for kv in self.sensitive.items() for x in kv]) if self.sensitive else None
        loose = F.create_map(*[F.lit(x) for kv in self.insensitive.items() for x in kv]) if self.insensitive else None
        options = ([F.try_element_at(exact, found)] if exact is not None else []) + (
            [F.try_element_at(loose, F.lower(found))] if loose is not None else [])
        return F.coalesce(*options)

    def category_of(self, skill: Column) -> Column:
        return F.try_element_at(F.create_map(*[F.lit(x) for kv in self.category.items() for x in kv]), skill)


def taxonomy_rows(spark: SparkSession, path: str) -> DataFrame:
    """(alias, skill, category, case_sensitive) from a JSON file {"skills": {name: {category, aliases, case_sensitive}}}."""
    schema = "skills map<string,struct<category:string,aliases:array<string>,case_sensitive:array<string>>>"
    entries = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("skills").alias("skill", "d"))
    side = lambda field, exact: entries.select(F.explode(f"d.{field}").alias("alias"), "skill", "d.category", F.lit(exact).alias("case_sensitive"))
    return side("aliases", False).unionByName(side("case_sensitive", True))


def load_taxonomy(rows: DataFrame) -> Taxonomy:
    """Brings the alias table to the driver to build one pattern; refuses a table too long for that."""
    found = rows.limit(MAX_ALIASES + 1).collect()
    if len(found) > MAX_ALIASES:
        raise ValueError(f"more than {MAX_ALIASES} aliases: tag with tag_by_ngrams instead")
    return Taxonomy({r["alias"].lower(): r["skill"] for r in found if not r["case_sensitive"]},
                    {r["alias"]: r["skill"] for r in found if r["case_sensitive"]},
                    {r["skill"]: r["category"] for r in found})


def mentions(text: Column, taxonomy: Taxonomy) -> Column:
    """[(skill, text, start, end)] in text order."""
    return F.transform(match_spans(text, taxonomy.pattern()), lambda m: F.struct(
        taxonomy.canonical(m["text"]).alias("skill"), m["text"].alias("text"), m["start"].alias("start"), m["end"].alias("end")))


def candidate_skills(found: Column, spans: Column) -> Column:
    """[(skill, evidence, start)]: each skill once, with the sentence of its first mention, in order of first mention."""
    # Sorted by (skill, start), the first mention of a skill is the one whose neighbour before has another skill.
    by_skill = F.array_sort(F.transform(found, lambda m: F.struct(m["skill"].alias("skill"), m["start"].alias("start"))))
    firsts = let(by_skill, lambda ms: F.filter(ms, lambda m, i: (i == 0) | (F.get(ms, i - 1)["skill"] != m["skill"])))
    ordered = F.array_sort(F.transform(firsts, lambda m: F.struct(m["start"].alias("start"), m["skill"].alias("skill"))))
    return let(spans, lambda spans: F.transform(ordered, lambda m: F.struct(
        m["skill"].alias("skill"), last_started(spans, m["start"])["text"].alias("evidence"), m["start"].alias("start"))))


def posting_skills(found: Column, spans: Column, pieces: Column, glued: bool = False) -> Column:
    """[(skill, status, evidence, start)]: the strongest status of a skill's mentions, the first mention at that strength.

    A mention's status is the nearest requirement word of its sentence, else its section if that is required or preferred,
    else uncertain.
    """
    return let(found, lambda f: spans, lambda f, s: pieces, lambda f, s, p: _posting_skills(f, s, p, glued))


def _posting_skills(found: Column, spans: Column, pieces: Column, glued: bool) -> Column:
    strength = F.create_map(*[F.lit(x) for kv in fv.STATUS_STRENGTH.items() for x in kv])

    def status_of(m, sentence):
        section = last_started(pieces, m["start"])["section"]
        return F.coalesce(nearest_cue(cues(sentence["text"], glued), m["start"] - sentence["start"]),
                          F.when(section.isin("required", "preferred"), section), F.lit("uncertain"))

    def judge(m):
        return let(last_started(spans, m["start"]), lambda s: status_of(m, s), lambda sentence, status: F.struct(
            m["skill"].alias("skill"), (-F.element_at(strength, status)).alias("weakness"), m["start"].alias("start"),
            status.alias("status"), sentence["text"].alias("evidence")))

    best = let(F.array_sort(F.transform(found, judge)), lambda judged: F.filter(
        judged, lambda m, i: (i == 0) | (F.get(judged, i - 1)["skill"] != m["skill"])))
    return F.transform(best, lambda m: F.struct(m["skill"].alias("skill"), m["status"].alias("status"),
                                                m["evidence"].alias("evidence"), m["start"].alias("start")))


def tag_by_ngrams(docs: DataFrame, aliases: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, skill, category, position) per document: word n-grams joined with an alias table of any size, one hit per skill.

    aliases: (alias, skill, category, position); position is the place of the skill in the taxonomy, 0 where the table has none.  The
    lengths of the n-grams are those of the aliases.  Words keep letters, digits, '#' and '+'; every other character separates, so an
    alias is broken up the same way before the join.  An alias that has other characters (a blank, "node.js") is then
    looked for literally in the few texts that hold its words.  Aliases are broadcast if they are few, so that only hits are shuffled; hits are
    written once.
    """
    split = lambda c: F.filter(F.split(F.lower(c), r"[^a-z0-9#+]+"), lambda w: w != "")
    lengths = sorted(r[0] for r in aliases.select(F.size(split(F.col("alias")))).distinct().collect() if r[0])
    words = docs.select(id, split(F.col(text)).alias("_w"))
    grams = let(F.col("_w"), lambda w: F.flatten(F.array(*[ngrams(w, n) for n in lengths or [1]])))
    terms = words.select(id, F.explode(F.array_distinct(grams)).alias("gram"))
    low = F.lower("alias")
    literal = F.concat(F.lit("(^|[^a-z0-9#+])"), F.regexp_replace(low, r"([^a-z0-9\s_])", r"\\$1"), F.lit("([^a-z0-9#+]|$)"))
    place = F.min("position" if "position" in aliases.columns else F.lit(0)).over(W.partitionBy("skill"))
    keys = aliases.select(F.array_join(split(F.col("alias")), " ").alias("gram"), "skill", "category", place.alias("position"),
                          low.rlike("[^a-z0-9#+]").alias("_check"), literal.alias("_literal")).distinct()
    found = written(join_small(terms, keys, ["gram"]).drop("gram"))
    texts = docs.select(id, F.lower(text).alias("_text"))
    checked = found.where("_check").join(texts, id).where(F.rlike("_text", F.col("_literal")))
    columns = [id, "skill", "category", "position"]
    return found.where("not _check").select(columns).unionByName(checked.select(columns)).distinct()
