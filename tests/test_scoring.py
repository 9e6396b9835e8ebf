import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom import fixed_values as fv
from pairloom.operators import adverts, match_score, profiles, resampling, skills
from pairloom.operators import applications as ap
from pairloom.operators import pair_features as pf
from pairloom.plans import experiment as ex
from pairloom.plans import report as rp

FEATURES = ("semantic_similarity double, required_skill_coverage double, preferred_skill_coverage double, required_skill_count int, "
            "preferred_skill_count int, experience_match double, responsibility_similarity double")
RESUME = """
OLUFEMI BRANDT
o.brandt@example.net | (303) 555-0188 | Leadville, CO
https://linkedin.com/in/obrandt | https://github.com/obrandt

PROFESSIONAL SUMMARY
Avalanche forecaster with 9+ years of experience in snow stations and slope models.

SKILLS
Haskell, Erlang, Redis, QGIS, Ansible

EXPERIENCE
Lead Forecaster | High Basin Patrol | Leadville, CO
03/2019 - Present
• Built a slope model in Haskell that covers 310 runs.
• Reduced false closures by 18% with hourly station checks.

EDUCATION
Bachelor of Science in Geology | Summit College | 2008 - 2012
"""
JOB = """
Senior Snow Modeller
Company: North Ridge
Requirements:
• 4+ years of experience with Haskell, Redis, and QGIS
• Solid Erlang services
Nice to Have:
• Experience with Rust and Nomad
"""
# In taxonomy order, which is not the order of names.
ALIASES = [("Rust", "languages"), ("Haskell", "languages"), ("Erlang", "languages"), ("Redis", "databases"), ("QGIS", "databases"),
           ("Nomad", "cloudDevops"), ("Ansible", "cloudDevops"), ("p5.js", "frameworks")]


@pytest.fixture(scope="module")
def aliases(spark):
    return spark.createDataFrame([(n.lower(), n, c, i) for i, (n, c) in enumerate(ALIASES)], "alias string, skill string, category string, position int")


@pytest.fixture(scope="module")
def parsed(spark, aliases):
    docs = spark.createDataFrame([("r", RESUME)], "candidate_id string, text string")
    jobs = spark.createDataFrame([("j", JOB, "Senior Backend Engineer")], "posting_id string, text string, title string")
    tagged = skills.tag_by_ngrams(docs, aliases, id="candidate_id")
    asked = adverts.posting_requirements(jobs, aliases)
    return profiles.parse_profiles(docs, tagged, 2025), adverts.parse_adverts(jobs, asked), asked, tagged


def test_profile(parsed):
    p = parsed[0].first()
    assert (p["contact"]["name"], p["contact"]["email"], p["contact"]["phone"]) == ("OLUFEMI BRANDT", "o.brandt@example.net", "(303) 555-0188")
    assert p["contact"]["linkedin"] == "https://linkedin.com/in/obrandt" and "github.com/obrandt" in p["contact"]["github"]
    assert [s["skill"] for s in p["skills"]] == ["Haskell", "Erlang", "Redis", "QGIS", "Ansible"]
    assert p["categorized_skills"]["databases"] == ["Redis", "QGIS"] and p["summary"].startswith("Avalanche forecaster with 9+")
    item = p["experience"][0]
    assert (item["title"], item["company"], len(item["bullets"]), item["is_current"]) == ("Lead Forecaster", "High Basin Patrol", 2, True)
    assert (item["start_date"], item["end_date"]) == ("03/2019", "Present")
    assert p["education"][0]["degree"].startswith("Bachelor of Science") and p["education"][0]["year"] == "2008"
    assert p["checks"]["contact_details"] and p["checks"]["headings_ok"]


def test_aliases_with_punctuation_match_literally(spark, aliases):
    docs = spark.createDataFrame([(1, "draws p5, js"), (2, "Draws in P5.JS."), (3, "xp5.js"), (4, "p5.js+ c"), (5, "rust-proof"), (6, "rusty")], "doc_id int, text string")
    assert {(r["doc_id"], r["skill"]) for r in skills.tag_by_ngrams(docs, aliases).collect()} == {(2, "p5.js"), (5, "Rust")}


def test_long_aliases_are_found(spark):
    aliases = spark.createDataFrame([("deep snow pit shear test protocol", "Shear test", "field", 0)], "alias string, skill string, category string, position int")
    docs = spark.createDataFrame([(1, "Knows the deep snow pit shear test protocol by heart")], "doc_id int, text string")
    assert [r["skill"] for r in skills.tag_by_ngrams(docs, aliases).collect()] == ["Shear test"]


def test_only_hits_of_few_aliases_are_shuffled(spark):
    docs = spark.createDataFrame([(1, "Haskell and p5.js, qgis"), (2, "rust"), (3, None)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = skills.tag_by_ngrams(docs, spark.createDataFrame([("p5.js", "P5", "c"), ("qgis", "QGIS", "d"), ("p5 js", "No", "e")], "alias string, skill string, category string"))
        assert "hashpartitioning(gram" not in out._jdf.queryExecution().executedPlan().toString()
        assert {tuple(r) for r in out.collect()} == {(1, "P5", "c", 0), (1, "QGIS", "d", 0)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_advert(parsed):
    a = parsed[1].first()
    assert a["required_skills"] == ["Haskell", "Erlang", "Redis", "QGIS"] and a["preferred_skills"] == ["Rust", "Nomad"]
    assert (a["min_years"], a["seniority"]) == (4, "senior")


def test_everything_preferred_is_promoted(spark, aliases):
    jobs = spark.createDataFrame([("j", "Nice to have:\nRust, Nomad, Redis and Ansible\n")], "posting_id string, text string")
    got = {r["skill"]: r["status"] for r in adverts.posting_requirements(jobs, aliases).collect()}
    assert sorted(got.values()).count("required") == -(-4 * 7 // 10)


def test_match_record(spark, parsed):
    pairs = spark.createDataFrame([("r", "j")], "candidate_id string, posting_id string")
    m = match_score.match_records(pairs, *parsed).first()
    assert m["missing_required"] == [] and m["missing_preferred"] == ["Rust", "Nomad"] and m["bonus_skills"] == ["Ansible"]
    assert m["experience_status"] in ("meets", "exceeds") and m["strengths"] and m["advice"]


def test_combine_leaves_out_the_unknown(spark):
    rows = [(0.5, 1.0, 0.0, 2, 0, None, None), (0.5, 0.0, 0.0, 0, 0, 0.5, None), (None, 0.0, 0.0, 0, 0, None, None)]
    df = spark.createDataFrame(rows, FEATURES)
    weights = {"semantic_similarity": 0.5, "required_skill_coverage": 0.3, "experience_match": 0.2}
    got = [r[0] for r in df.select(pf.combine(pf.component_values({}), weights)).collect()]
    assert got == pytest.approx([(0.25 + 0.3) / 0.8, (0.25 + 0.1) / 0.7, 0.0])
    bounded = pf.component_values({"semantic_similarity": (0.4, 0.8)})["semantic_similarity"]
    xs = spark.createDataFrame([(x, 0.0, 0.0, 0, 0, None, None) for x in (0.2, 0.6, 0.9, None)], FEATURES)
    assert [r[0] for r in xs.select(bounded).collect()] == [0.0, pytest.approx(0.5), 1.0, None]


def test_scaler_bounds(spark):
    df = spark.createDataFrame([(i / 100, None) for i in range(101)], "semantic_similarity double, responsibility_similarity double")
    got = pf.scaler_bounds(df).collect()
    assert [(r["component"], round(r["lo"], 9), round(r["hi"], 9)) for r in got] == [("semantic_similarity", 0.01, 0.99)]


def test_coverage(spark):
    pairs = spark.createDataFrame([("c", "p"), ("x", "p")], "candidate_id string, posting_id string")
    asked = spark.createDataFrame([("p", "Python", "required"), ("p", "SQL", "required"), ("p", "AWS", "required"), ("p", "Docker", "preferred"),
                                   ("p", "Tableau", "uncertain")], "posting_id string, skill string, status string")
    has = spark.createDataFrame([("c", s) for s in ("Python", "SQL", "Docker", "Tableau")], "candidate_id string, skill string")
    got = {r["candidate_id"]: r for r in pf.coverage(pairs, asked, has).collect()}
    c = got["c"]
    assert c["matched_required_skills"] == ["Python", "SQL"] and c["missing_required_skills"] == ["AWS"] and c["uncertain_skills"] == ["Tableau"]
    assert (c["required_skill_coverage"], c["preferred_skill_coverage"]) == (pytest.approx(2 / 3), 1.0)
    assert c["weighted_skill_coverage"] == pytest.approx(2.5 / 3.5) and c["job_skill_coverage"] == pytest.approx(0.8)
    assert got["x"]["required_skill_coverage"] == 0.0 and got["x"]["required_skill_count"] == 3


def test_skill_sets_against_loops(spark):
    rng = np.random.default_rng(12)
    skills = [f"S{i}" for i in range(12)]
    asked = {p: {s: str(rng.choice(["required", "preferred", "uncertain"])) for s in rng.choice(skills, rng.integers(1, 8), replace=False)} for p in range(15)}
    held = {c: set(map(str, rng.choice(skills, rng.integers(1, 9), replace=False))) for c in range(10)}
    synonyms = [("S1", "s2"), ("S1", "S9"), ("S4", "S5")]
    # Posting 99 asks for nothing, candidate 99 holds nothing; rows are repeated.
    pairs = spark.createDataFrame([(c, p) for c in [*held, 99] for p in [*asked, 99]], "candidate_id long, posting_id long")
    demanded = spark.createDataFrame([(p, str(s), st, int(s[1:])) for p, row in asked.items() for s, st in row.items()] * 2,
                                     "posting_id long, skill string, status string, position int")
    offered = spark.createDataFrame([(c, s) for c, row in held.items() for s in row] * 2, "candidate_id long, skill string")
    also = spark.createDataFrame(synonyms, "skill string, synonym string")
    covered = {(r["candidate_id"], r["posting_id"]): r for r in pf.coverage(pairs, demanded, offered).collect()}
    scored = {(r["candidate_id"], r["posting_id"]): r for r in match_score.skill_part(pairs, demanded, offered, also).collect()}
    assert len(covered) == len(scored) == 11 * 16
    for (c, p), r in covered.items():
        wants, has = asked.get(p, {}), held.get(c, set())
        of = lambda status, there: sorted(str(s) for s, st in wants.items() if st == status and (s in has) == there)
        assert r["matched_required_skills"] == of("required", True) and r["missing_preferred_skills"] == of("preferred", False)
        assert r["required_skill_count"] == sum(st == "required" for st in wants.values())
        assert r["job_skill_coverage"] == pytest.approx(len(set(wants) & has) / max(1, len(wants)))
        meets = lambda s: s in has or any(a == s and b.upper() in has for a, b in synonyms)
        got = scored[c, p]
        for status in ("required", "preferred"):
            missing = sorted((int(s[1:]), str(s)) for s, st in wants.items() if st == status and not meets(s))
            assert got[f"missing_{status}"] == [s for _, s in missing]
        assert got["n_matched"] == sum(meets(s) for s, st in wants.items() if st != "uncertain")


def test_experience_and_education(spark):
    df = spark.createDataFrame([(6.0, 5.0), (3.0, 5.0), (0.0, 5.0), (None, 5.0), (4.0, 0.0)], "c double, r double")
    assert [r[0] for r in df.select(pf.experience_match(F.col("c"), F.col("r"))).collect()] == [1.0, pytest.approx(0.6), 0.0, None, 1.0]
    assert [r[0] for r in df.select(pf.experience_gap(F.col("c"), F.col("r"))).collect()] == [0.0, 2.0, 5.0, None, 0.0]
    ed = spark.createDataFrame([(4, 3), (2, 3), (1, 3), (None, 3)], "c int, r int")
    assert [r[0] for r in ed.select(pf.education_match(F.col("c"), F.col("r"))).collect()] == [1.0, 0.5, 0.0, None]


def test_bootstrap(spark):
    flat = spark.createDataFrame([("m", f"p{i}", 0.1) for i in range(50)], "metric string, posting_id string, diff double")
    row = resampling.paired_bootstrap(flat, n=500).first()
    assert (row["ci95_low"], row["ci95_high"]) == (pytest.approx(0.1), pytest.approx(0.1)) and row["p_two_sided"] == 0 and row["significant_5pct"]
    rng = np.random.default_rng(1)
    noisy = spark.createDataFrame([("m", f"p{i}", float(d)) for i, d in enumerate(rng.normal(0.05, 1, 400))], "metric string, posting_id string, diff double")
    a, b = resampling.paired_bootstrap(noisy, n=2000).first(), resampling.paired_bootstrap(noisy, n=2000).first()
    assert a == b and a["ci95_low"] < a["mean_diff"] < a["ci95_high"]
    values = np.array([r["diff"] for r in noisy.collect()])
    means = values[rng.integers(0, 400, (2000, 400))].mean(axis=1)
    drawn = resampling.resample_means(noisy, ["metric"], "posting_id", 2000).agg(F.avg("mean"), F.stddev("mean"), F.count("mean")).first()
    assert drawn[0] == pytest.approx(values.mean(), abs=0.01) and drawn[1] == pytest.approx(means.std(), rel=0.1) and drawn[2] == 2000


def plain_draws(key, n):
    """Draws of one unit, in plain integers."""
    digest = hashlib.md5(key.encode()).hexdigest()
    first, step, p = int(digest[:8], 16) % resampling.PRIME, int(digest[8:16], 16) % resampling.PRIME, resampling.PRIME
    for b in range(n):
        v = (first + (b + 1) * step) % p
        for factor, shift in ((48271, 13), (69621, 15)):
            v = (v * factor + 12345) % p
            v = (v ^ (v >> shift)) % p
        v = v * 39373 % p
        yield sum(v >= c for c in resampling.CUTS)


def test_draws_are_those_of_the_hash(spark):
    rows = [("m", r, f"p{i}", float(d)) for r in (0, 1) for i, d in enumerate(np.random.default_rng(3).normal(0, 1, 9))]
    diffs = spark.createDataFrame(rows, "metric string, repetition int, posting_id string, diff double")
    got = {(r["repetition"], r["resample"]): r["mean"] for r in resampling.resample_means(
        diffs.repartition(3), ["metric"], "posting_id", 45, 42, ["repetition"]).collect()}
    assert len(got) == 90
    for rep in (0, 1):
        draws = np.array([list(plain_draws(f"42:p{i}:{rep}", 45)) for i in range(9)])
        values = np.array([d for _, r, _, d in rows if r == rep])
        for b in range(45):
            total = draws[:, b].sum()
            assert got[rep, b] == (None if total == 0 else pytest.approx((draws[:, b] * values).sum() / total, abs=1e-11))


def test_draws_are_poisson_and_independent():
    draws = np.array([list(plain_draws(f"42:u{i}", 400)) for i in range(400)])
    assert draws.mean() == pytest.approx(1, abs=0.01) and draws.var() == pytest.approx(1, abs=0.02)
    assert [np.mean(draws == k) for k in range(4)] == pytest.approx([0.3679, 0.3679, 0.1839, 0.0613], abs=0.004)
    assert abs(np.corrcoef(draws)[np.triu_indices(400, 1)]).mean() < 0.045 and abs(np.corrcoef(draws.T)[np.triu_indices(400, 1)]).mean() < 0.045
    assert draws.sum(axis=0).std() == pytest.approx(20, rel=0.15)


def test_verdicts_and_comparison(spark):
    stages = spark.createDataFrame([("base", 0.5, 0.6), ("up", 0.6, 0.7), ("down", 0.4, 0.5), ("mixed", 0.6, 0.5)], "stage string, v double, t double")
    got = {r["stage"]: r["verdict"] for r in rp.stage_verdicts(stages, ["v", "t"], "base").collect()}
    assert got == {"base": "baseline", "up": "higher in every view", "down": "lower in every view", "mixed": "mixed across views"}
    names = [*fv.RANKING_METRICS, "accuracy", "macro_f1"]
    rows = [(m, n, 4, 3, *[x] * 8) for m, n, x in (("a", 9, 0.5), ("b", 8, 0.6))]
    df = spark.createDataFrame(rows, "model string, n_rows int, jobs_eligible int, jobs_binary_eligible int, " + ", ".join(f"{n} double" for n in names))
    with pytest.raises(ValueError, match="different candidate groups"):
        ex.model_comparison(df, "a", ["a", "b"])


def test_application_life(spark):
    intake = spark.createDataFrame([(1, 7, "Acme", "Analyst", None, None, None)],
                                   "application_id int, user_id int, company string, position string, location string, status string, notes string")
    made = ap.create_applications(intake, F.lit("2024-05-01").cast("timestamp"))
    assert made.first()["status"] == "saved" and made.first()["applied_date"] is None and made.first()["location"] == "Remote"
    changes = spark.createDataFrame([(1, 5, "applied", "", "2024-05-02"), (1, 6, "screening", "call", "2024-05-03")],
                                    "application_id int, change_id int, status string, note string, at string").withColumn("at", F.col("at").cast("timestamp"))
    out = ap.change_status(made, changes).first()
    assert (out["status"], out["applied_date"], out["n_changes"], len(out["timeline"])) == ("screening", "2024-05-02", 2, 1)
    entries = ap.timeline(changes, at="at", tie="change_id", stage="status").orderBy("seq").collect()
    assert [(e["seq"], e["date"], e["stage"], e["note"]) for e in entries] == [
        (1, "2024-05-02", "applied", "Stage moved to applied"), (2, "2024-05-03", "screening", "call")]


def test_texts_to_explained_scores(spark):
    from pairloom.operators import semantic as se
    from pairloom.plans import hybrid
    taxonomy = skills.Taxonomy({"rope": "Rope work", "sonar": "Sonar", "charts": "Charts"}, {}, {"Rope work": "deck", "Sonar": "bridge", "Charts": "bridge"})
    boat = "Summary Deck hand with 6 years of experience. Experience Spliced rope for the harbour tug crew. Read paper charts on every night crossing."
    idle = "Summary Keeps a quiet allotment. Experience Grew beans and late potatoes for the market stall."
    job = ("Responsibilities Splice rope for the tug crew each week. Required Qualifications 4 years of experience. Rope and sonar required. "
           "Preferred Qualifications Charts.")
    candidates = spark.createDataFrame([(1, boat), (2, boat + "  "), (3, idle)], "candidate_id long, text string")
    postings = spark.createDataFrame([(7, job)], "posting_id long, text string")
    pairs = spark.createDataFrame([(1, 7), (2, 7), (3, 7)], "candidate_id long, posting_id long")
    weights = dict(zip(fv.COMPONENTS, fv.WEIGHTINGS["A_initial"]))
    features = hybrid.hybrid_features(pairs, candidates, postings, taxonomy, se.hashed_bag_encoder(64), 64, 64)
    explained = pf.explain(features, weights, {}).withColumn("saved_score", F.col("overall_score"))
    got = {r["candidate_id"]: r for r in explained.collect()}
    assert got[1]["matched_required_skills"] == ["Rope work"] and got[1]["missing_required_skills"] == ["Sonar"]
    assert got[1]["overall_score"] == got[2]["overall_score"] > got[3]["overall_score"]
    assert any("Spliced rope" in e for e in got[1]["skill_evidence"]) and "rope" in got[1]["responsibility_evidence"][0]["evidence"]
    assert pf.audit_summary(pf.audit_checks(explained, weights)).first()["all_pass"]
    damage = {"saved_score": F.lit(0.123), "missing_required_skills": F.array(F.lit("Rope work")), "skill_evidence": F.array(F.lit("never written")),
              "experience_gap": F.lit(40.0), "matched_required_skills": F.array(F.lit("Welding"))}
    for column, value in damage.items():
        broken = explained.withColumn(column, F.when(F.col("candidate_id") == 1, value).otherwise(F.col(column)))
        row = pf.audit_summary(pf.audit_checks(broken, weights)).first()
        assert not row["all_pass"] and min(row[c] for c in row.asDict() if c not in ("pairs_checked", "all_pass")) == 2


def test_matched_pairs_are_not_shuffled_by_candidate(spark, tmp_path):
    from pairloom.catalog import applications
    tables = {
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string",
                     [(1, 1, 5, 60.0, "A"), (1, 2, 6, 40.0, "N"), (2, 1, 6, 700.0, "R"), (2, 2, 9, 5.0, None), (3, 1, 5, 650.0, "A")]),
        "orders": ("o_orderkey long, o_custkey long", [(1, 7), (2, 8), (3, 7), (4, 8)]),
        "part": ("p_partkey long, p_brand string", [(1, "Brand#11"), (2, "Brand#22")]),
        "supplier": ("s_suppkey long, s_acctbal double, s_nationkey int", [(5, 3500.0, 4), (6, -20.0, 1)]),
        "customer": ("c_custkey long, c_acctbal double, c_nationkey int, c_mktsegment string", [(7, 2000.0, 1, "BUILDING"), (8, 9000.0, 2, "MACHINERY")])}
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = applications.match_parts(spark, str(tmp_path))
        assert "hashpartitioning(candidate_id" not in out._jdf.queryExecution().executedPlan().toString()
        got = {(r["posting_id"], r["candidate_id"]): (r["skills_score"], r["n_matched"], r["missing_preferred"]) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # Supplier 9 is unknown; 7 asks for 11 (required) and 22 (preferred), 8 for 11 (required); 5 and 6 ship 11.
    assert got == {(7, 5): (75, 1, ["Brand#22"]), (7, 6): (75, 1, ["Brand#22"]), (8, 6): (75, 1, [])}


def test_draws_are_made_in_few_small_matrices():
    import tracemalloc

    import pandas as pd
    rng = np.random.default_rng(5)
    units = pd.DataFrame({"_stratum": "s", "_first": rng.integers(0, resampling.PRIME, 300), "_step": rng.integers(0, resampling.PRIME, 300),
                          "_g": [[{"_by": "m", "_d": 0.5, "_n": 1}]] * 300})
    tracemalloc.start()
    out = pd.concat(resampling._partial_sums(5000)(iter([units])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4_000_000 and out["_n"].mean() == pytest.approx(300, rel=0.01) and len(out) == 5000
