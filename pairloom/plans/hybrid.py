"""From candidate and posting texts to explained hybrid scores.

Each distinct text is parsed and encoded once; duties and evidence sentences of both sides are encoded as one set of distinct sentences;
features are computed per pair of distinct texts, with skills as arrays in the row, and joined back to the pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom import fixed_values as fv
from pairloom.operators import documents, semantic
from pairloom.operators import pair_features as pf
from pairloom.operators.skills import Taxonomy
from pairloom.session import cut_lineage


def _sentences(parsed: DataFrame, statements: Column) -> DataFrame:
    rows = parsed.select(F.col("text_id").alias("owner"), F.posexplode(statements).alias("place", "text"))
    return rows.withColumn("text_id", semantic.text_key(F.col("text")))


def hybrid_features(pairs: DataFrame, candidates: DataFrame, postings: DataFrame, taxonomy: Taxonomy, encoder: semantic.Encoder, dim: int,
                    max_tokens: int = 510, resume_headings: dict = fv.RESUME_HEADINGS, job_headings: dict = fv.JOB_HEADINGS) -> DataFrame:
    """(candidate_id, posting_id, features, evidence) of pairs (candidate_id, posting_id) of candidates and postings (id, text)."""
    keyed = lambda df, id, name: df.select(id, semantic.text_key(F.col("text")).alias(name))
    c_key, p_key = keyed(candidates, "candidate_id", "c_text"), keyed(postings, "posting_id", "p_text")
    c_texts, p_texts = semantic.distinct_texts(candidates), semantic.distinct_texts(postings)
    resumes = cut_lineage(documents.parse_candidates(c_texts, taxonomy, id="text_id", headings=resume_headings))
    jobs = cut_lineage(documents.parse_postings(p_texts, taxonomy, id="text_id", headings=job_headings))
    evidence, duties = _sentences(resumes, F.col("evidence")), _sentences(jobs, F.col("duties.statements"))
    whole = resumes.select("text").unionByName(jobs.select("text"))
    wanted = whole.unionByName(evidence.select("text")).unionByName(duties.select("text"))
    vectors = cut_lineage(semantic.encode_texts(wanted, encoder, max_tokens))
    stack = lambda rows, id: semantic.vector_blocks(rows.join(vectors, "text_id"), "owner", "place").withColumnRenamed("owner", id)
    linked = cut_lineage(pairs.select("candidate_id", "posting_id").join(c_key, "candidate_id").join(p_key, "posting_id"))
    texts = linked.select("c_text", "p_text").distinct()
    aligned = semantic.alignment(texts, stack(duties, "p_text"), stack(evidence, "c_text"), dim, "c_text", "p_text")
    of_text = lambda name: vectors.withColumnRenamed("text_id", name)
    scored = semantic.vector_pair_scores(aligned, of_text("c_text"), of_text("p_text"), "c_text", "p_text", "semantic_similarity", "left")
    left = resumes.select(F.col("text_id").alias("c_text"), F.col("text").alias("candidate_text"), F.col("skills").alias("c_skills"),
                          F.transform("skills", lambda s: s["skill"]).alias("candidate_skills"), F.col("evidence").alias("c_evidence"),
                          F.col("experience.total_years").alias("candidate_experience_years"), F.col("experience.source").alias("experience_source"),
                          F.col("highest_level").alias("candidate_level"))
    right = jobs.select(F.col("text_id").alias("p_text"), F.col("text").alias("posting_text"), F.col("skills").alias("asked"),
                        F.col("duties.statements").alias("p_duties"), F.col("experience.min_years").cast("double").alias("required_experience_years"),
                        F.col("education.required_level").alias("required_level"))
    joined = scored.join(left, "c_text").join(right, "p_text").withColumns(pf.skill_coverage(F.col("asked"), F.col("candidate_skills")))
    years, needed = F.col("candidate_experience_years"), F.col("required_experience_years")
    found = F.concat("matched_required_skills", "matched_preferred_skills")
    features = joined.withColumns({
        "experience_match": pf.experience_match(years, needed), "experience_gap": pf.experience_gap(years, needed),
        "education_match": pf.education_match(F.col("candidate_level"), F.col("required_level")),
        "skill_evidence": F.transform(F.filter("c_skills", lambda s: F.array_contains(found, s["skill"])), lambda s: s["evidence"]),
        "requirement_evidence": F.transform(F.filter("asked", lambda a: F.array_contains(F.col("required_skills"), a["skill"])), lambda a: a["evidence"]),
        "responsibility_evidence": F.transform("best", lambda b: F.struct(
            F.get("p_duties", b["duty"]).alias("duty"), F.get("c_evidence", b["evidence"]).alias("evidence"), b["similarity"].alias("similarity"))),
    }).drop("c_skills", "asked", "c_evidence", "p_duties", "best")
    return linked.join(features, ["c_text", "p_text"]).drop("c_text", "p_text")
