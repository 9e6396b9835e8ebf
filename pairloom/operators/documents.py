"""Parsed candidate and posting tables: one row per distinct text, everything read in one map-only pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom import fixed_values as fv
from pairloom.functions import text as tx
from pairloom.operators import careers, sections, skills
from pairloom.operators.skills import Taxonomy


def label_document(docs: DataFrame, rules: dict[str, list[str]], text: str = "text") -> DataFrame:
    """Add segments, heads and pieces of the text column."""
    out = docs.withColumn("segments", sections.segments(F.col(text)))
    out = out.withColumn("heads", sections.headings(F.col(text), rules))
    return out.withColumn("pieces", sections.label_pieces(F.col("segments"), F.col("heads")))


def parse_candidates(docs: DataFrame, taxonomy: Taxonomy, id: str = "candidate_id", text: str = "text",
                     headings: dict[str, list[str]] = fv.RESUME_HEADINGS, limit: int | None = None) -> DataFrame:
    """(id, text, skills, experience, highest_level, evidence, education, projects, certifications)."""
    normal = docs.select(id, tx.normalize(F.col(text)).alias("text"))
    labelled = label_document(normal, headings).withColumn("mentions", skills.mentions(F.col("text"), taxonomy))
    labelled = labelled.withColumn("blocks", sections.section_blocks(F.col("text"), F.col("pieces")))
    held = skills.candidate_skills(F.col("mentions"), F.col("segments"))
    of_kind = lambda kind: F.transform(F.filter("pieces", lambda p: (p["section"] == kind) & (F.size(F.split(p["text"], r"(?U)\s+")) >= 3)),
                                       lambda p: p["text"])
    degrees = F.flatten(F.transform(of_kind("education"), lambda s: F.transform(careers.degree_levels(s), lambda l: F.struct(
        careers.degree_name(l).alias("level"), s.alias("evidence")))))
    certificates = F.transform(F.filter("skills", lambda s: s["category"] == "certification"), lambda s: s["skill"])
    return (labelled
            .withColumn("skills", F.array_sort(F.transform(held, lambda s: F.struct(
                s["skill"].alias("skill"), taxonomy.category_of(s["skill"]).alias("category"), s["evidence"].alias("evidence")))))
            .withColumn("experience", careers.candidate_experience(F.col("text"), F.col("blocks")))
            .withColumn("highest_level", careers.candidate_degree(F.col("text")))
            .withColumn("evidence", careers.evidence(F.col("pieces"), limit))
            .withColumn("education", degrees).withColumn("projects", of_kind("projects"))
            .withColumn("certifications", F.array_sort(F.array_union(certificates, of_kind("certifications"))))
            .select(id, "text", "skills", "experience", "highest_level", "evidence", "education", "projects", "certifications"))


def title_line(raw):
    """First non-blank line if it is short and no sentence."""
    first = F.regexp_replace(F.element_at(F.filter(F.split(raw, r"\r\n|\n|\r"), lambda l: l.rlike(r"(?U)\S")), 1), r"^[ :\-\t]+|[ :\-\t]+$", "")
    short = F.size(F.split(tx.strip(first), r"(?U)\s+")).between(1, 8) & (first != "")
    return F.when(short & ~first.rlike(r"[.!?]$"), first)


def parse_postings(docs: DataFrame, taxonomy: Taxonomy, glued: bool = True, id: str = "posting_id", text: str = "text",
                   headings: dict[str, list[str]] = fv.JOB_HEADINGS, limit: int | None = None) -> DataFrame:
    """(id, text, title, skills, experience, education, duties)."""
    normal = docs.select(id, title_line(F.when(F.col(text).rlike(r"(?U)\S"), F.col(text))).alias("title"), tx.normalize(F.col(text)).alias("text"))
    labelled = label_document(normal, headings).withColumn("mentions", skills.mentions(F.col("text"), taxonomy))
    return (labelled
            .withColumn("skills", skills.posting_skills(F.col("mentions"), F.col("segments"), F.col("pieces"), glued))
            .withColumn("experience", careers.required_experience(F.col("pieces"), glued))
            .withColumn("education", careers.education_requirement(F.col("pieces"), glued))
            .withColumn("duties", careers.duties(F.col("pieces"), limit))
            .select(id, "text", "title", "skills", "experience", "education", "duties"))
