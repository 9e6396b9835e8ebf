"""Registered application-table, match-score, letter and streaming queries.

An event's user stands for an application, its type for the stage the application moves to.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from pairloom import fixed_values as fv
from pairloom.catalog import matching as mt
from pairloom.catalog.inputs import table
from pairloom.catalog.lexical import REPLIES, STOP, WORDS, reply_pairs
from pairloom.catalog.sqltext import q
from pairloom.functions import text as tx
from pairloom.functions.numbers import clamp, half_up
from pairloom.operators import applications as ap
from pairloom.operators import letters as lt
from pairloom.operators import match_score as ms
from pairloom.operators import pair_features as pf
from pairloom.operators.prepare import intake_rules, quality_gates
from pairloom.plans import experiment as ex
from pairloom.plans.report import band_counts
from pairloom.session import scratch_folder, spread
from pairloom.sources import store
from pairloom.sources.tables import decode_json, encode_json, select_where
from pairloom.streaming import applications as sa

STAGES = {"view": "saved", "click": "applied", "signup": "screening", "purchase": "offer", "error": "rejected"}
TONES = {"AUTOMOBILE": "professional", "BUILDING": "enthusiastic", "FURNITURE": "confident", "MACHINERY": "concise", "HOUSEHOLD": "technical"}


def _map(column, names, default=None):
    out = None
    for k, v in names.items():
        out = F.when(column == k, v) if out is None else out.when(column == k, v)
    return out.otherwise(default) if default else out


def stage_events(spark, folder):
    events = decode_json(table(spark, folder, "events"), {"props": "struct<k:int>"})
    note = F.when(F.col("props.k") >= 50, F.concat(F.lit("k="), F.col("props.k").cast("string")))
    return events.select(F.col("user_id").alias("application_id"), "event_id", "ts", _map(F.col("event_type"), STAGES).alias("stage"), note.alias("note"))


def application_state(spark, folder):
    return ap.application_state(stage_events(spark, folder))


def application_timeline(spark, folder):
    return ap.timeline(stage_events(spark, folder))


def stage_counts(spark, folder):
    return ap.status_counts(application_state(spark, folder))


def latest_activities(spark, folder):
    newest = ap.latest(table(spark, folder, "events").select("user_id", "event_id", "ts", "event_type"), ["user_id"], "ts", "event_id")
    return newest.withColumn("position", F.col("position").cast("long"))


def newest_purchases(spark, folder):
    return select_where(table(spark, folder, "events"), F.col("event_type") == "purchase", "ts", "event_id").select("event_id", "user_id", "ts", "value")


def activity_counts(spark, folder):
    return mt._round(sa.activity_counts(table(spark, folder, "events")), 4)


def json_columns(spark, folder):
    """Props decoded, added up per user, and encoded again."""
    decoded = decode_json(table(spark, folder, "events"), {"props": "struct<k:int>"})
    totals = decoded.groupBy("user_id").agg(F.sum("props.k").alias("k_total"), F.max_by("props", F.struct("ts", "event_id")).alias("last_props"))
    return encode_json(totals, ["last_props"])


def intake(spark, folder):
    orders = table(spark, folder, "orders")
    customers = table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("application_id"), F.col("c_nationkey").alias("user_id"), F.col("c_name").alias("company"),
        F.col("o_orderpriority").alias("position"), F.when(F.col("o_orderstatus") == "F", "Berlin").alias("location"),
        F.when(F.col("o_orderstatus") == "O", "applied").when(F.col("o_orderstatus") == "F", "offer").alias("status"),
        F.lit(None).cast("string").alias("notes"), (F.col("o_totalprice") / 1000).alias("match_score"), "o_orderdate")


def created_applications(spark, folder):
    made = ap.create_applications(intake(spark, folder), F.col("o_orderdate"))
    return encode_json(made, ["timeline"]).select("application_id", "company", "position", "location", "status", "notes", "applied_date", "timeline")


def creation_activities(spark, folder):
    return ap.creation_activities(ap.create_applications(intake(spark, folder), F.col("o_orderdate")))


def intake_gates(spark, folder):

    gated = quality_gates(intake(spark, folder), intake_rules())
    return gated.groupBy("is_valid", F.array_join("reasons", ",").alias("reasons")).agg(F.count("*").alias("n"))


def changed_applications(spark, folder):
    """Applications created from the orders, then one batch of changes: the events, whose user is an order number."""
    made = ap.create_applications(intake(spark, folder), F.col("o_orderdate"))
    changes = stage_events(spark, folder).select("application_id", F.col("event_id").alias("change_id"), F.col("stage").alias("status"), F.col("ts").alias("at"))
    out = ap.change_status(made, changes)
    return out.select("application_id", "status", "applied_date", (F.size("timeline") + F.col("n_changes")).alias("n_entries"))


def dashboard(spark, folder):
    customers = table(spark, folder, "customer").select(F.col("c_nationkey").alias("user_id"))
    suppliers = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("user_id"))
    applications = intake(spark, folder).select("user_id", F.when(F.col("match_score") < 100, "rejected").when(
        F.col("match_score") < 200, "interviewing").otherwise(F.coalesce("status", F.lit("screening"))).alias("status"))
    matches = mt.weighted_scores(spark, folder).select((F.col("score") * 100).alias("overall_score"))
    return ap.dashboard(customers, suppliers, matches, applications)


def upserted_state(spark, folder):
    """Last event per user: events of the first half as the table, the rest as changes."""
    events = table(spark, folder, "events").select("user_id", "event_id", "ts", "event_type")
    current = events.where("ts < timestamp'2024-01-15'")
    first = current.groupBy("user_id").agg(F.max_by(F.struct("event_id", "ts", "event_type"), F.struct("ts", "event_id")).alias("r")).select("user_id", "r.*")
    return store.upsert(first, events.where("ts >= timestamp'2024-01-15'"), ["user_id"], F.struct("ts", "event_id"))


def cascade_delete(spark, folder):
    """Customers in debt go; their orders go with them; order lines of the gone orders lose their reference."""
    customers, orders = table(spark, folder, "customer"), table(spark, folder, "orders")
    deleted = customers.where("c_acctbal < 0").select("c_custkey")
    gone = orders.join(deleted, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")
    tables = store.cascade_delete({"customer": customers, "orders": orders}, deleted, "customer", "c_custkey", {"orders": "o_custkey"}, {})
    lines = store.clear_references(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber"), gone, "l_orderkey")
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
    return count(tables["customer"], "customer").unionByName(count(tables["orders"], "orders")).unionByName(
        count(lines.where("l_orderkey is null"), "cleared_lines"))


def broken_references(spark, folder):
    """Events without an embedding of their number."""
    return store.broken_references(table(spark, folder, "events"), table(spark, folder, "embeddings"), "event_id", "vec_id").groupBy(
        "event_type").agg(F.count("*").alias("n"))


def titled_matches(spark, folder):
    """Pairs with the names of both sides."""
    pairs = mt.trade_pairs(spark, folder).select("posting_id", "candidate_id", "quantity")
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("posting_id"), F.col("c_name").alias("posting"), "c_nationkey")
    nations = table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("place"))
    suppliers = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("candidate_id"), F.col("s_name").alias("candidate"))
    return pairs.join(customers, "posting_id").join(nations, "c_nationkey").join(suppliers, "candidate_id").select(
        "posting_id", "candidate_id", "posting", "place", "candidate", "quantity")


def match_parts(spark, folder):
    """Five scores and the overall score of every trading pair, with strengths, gaps and advice; pairs meet one row a side."""
    lines, at_most = mt.trade_rows(spark, folder)
    pairs, demanded, offered = mt.trade(spark, folder, (lines, at_most))
    # The taxonomy lists the brands from the last to the first.
    demanded = demanded.where("status <> 'uncertain'").withColumn(
        "position", -F.regexp_extract("skill", "[0-9]+", 0).cast("int"))
    synonyms = spark.createDataFrame([("Brand#1", "Brand#11"), ("Brand#2", "Brand#22"), ("Brand#2", "Brand#12")], "skill string, synonym string")
    held, asked = ms.named_skills(demanded, offered, synonyms)
    years = lambda c: F.floor(F.greatest(F.col(c), F.lit(0.0)) / 1000).cast("int")
    suppliers = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("candidate_id"), years("s_acctbal").alias("candidate_years"),
                                                        (F.col("s_nationkey") % 6 * 20).alias("check_score"))
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("posting_id"), years("c_acctbal").alias("required_years"))
    candidates, postings = suppliers.join(held, "candidate_id", "left"), customers.join(asked, "posting_id", "left")
    out = ms.skills_met(pf.with_both_sides(pairs, postings, candidates, parts=ex.posting_parts(lines, at_most))[0])
    score, status = ms.experience_part(F.col("candidate_years"), F.col("required_years"))
    out = out.withColumns({
        "experience_score": score, "experience_status": status, "format_score": ms.format_part(F.col("check_score")),
        "responsibilities_score": clamp(half_up(35 + F.col("quantity")), 40, 98).cast("int"),
        "education_score": F.when(F.col("check_score") >= 80, 100).when(F.col("check_score") >= 40, 92).otherwise(60)})
    out = out.withColumn("overall_score", ms.overall_score())
    strengths, gaps = ms.strengths_and_gaps()
    return out.withColumns({"strengths": strengths, "gaps": gaps, "advice": ms.advice()})


def match_scores(spark, folder):
    text = lambda c: F.array_join(c, " | ")
    return match_parts(spark, folder).select(
        "posting_id", "candidate_id", "skills_score", "experience_score", "experience_status", "format_score", "overall_score", text("strengths").alias("strengths"),
        text("gaps").alias("gaps"), text(F.transform("advice", lambda a: F.concat_ws(": ", a["priority"], a["title"]))).alias("advice"))


def score_bands(spark, folder):

    return band_counts(match_parts(spark, folder), ms.score_band(F.col("overall_score")))


def bonus_skills(spark, folder):
    """Brands a supplier ships that the customer does not ask for, the first eight of a taxonomy that runs from the last brand to the first."""
    names = lambda df, id, name: df.groupBy(id).agg(F.sort_array(F.collect_set("skill"), asc=False).alias(name))
    offered = names(mt.offered_skills(spark, folder), "candidate_id", "offered")
    demanded = mt.demanded_skills(spark, folder)
    required = names(demanded.where("status = 'required'"), "posting_id", "required")
    preferred = names(demanded.where("status = 'preferred'"), "posting_id", "preferred")
    empty = F.array().cast("array<string>")
    pairs = mt.trade_pairs(spark, folder).select("posting_id", "candidate_id").join(offered, "candidate_id").join(required, "posting_id", "left").join(
        preferred, "posting_id", "left")
    extra = ms.bonus_skills(F.col("offered"), F.coalesce("required", empty), F.coalesce("preferred", empty))
    return pairs.select("posting_id", "candidate_id", F.array_join(extra, ",").alias("bonus"))


def reply_scores(spark, folder):
    """Responsibility score of every reply against the turn it answers."""
    pairs, answered, asked = reply_pairs(spark, folder)
    texts = pairs.join(answered.withColumnRenamed("text", "bullets"), "candidate_id").join(asked.withColumnRenamed("text", "duties"), "posting_id")
    return ms.responsibilities_part(texts, ["candidate_id", "posting_id"], "bullets", "duties").select("candidate_id", "posting_id", "responsibilities_score")


def skill_context(spark, folder):
    """The first line of each document that names a term, with its source."""
    items = F.array(F.struct(F.col("source").alias("company"), tx.lines(F.col("text")).alias("bullets")))
    docs = spread(table(spark, folder, "documents"), "doc_id")
    return docs.select("doc_id", ms.context_of(F.lit("Thble"), items).alias("context")).where("context is not null")


def keyword_assignment(spark, folder):
    pool = lt.keyword_pool(F.array(F.lit("the"), F.lit("erin")), F.array(F.lit("tion")))
    docs = spread(table(spark, folder, "documents"), "doc_id").select("doc_id", F.posexplode(lt.assign_keywords(tx.lines(F.col("text")), pool)).alias("seq", "a"))
    return docs.select("doc_id", F.col("seq").cast("long").alias("seq"), F.md5("a.bullet").alias("bullet_md5"), "a.keyword", "a.has_metric", "a.has_keyword",
                       F.size("a.keywords_added").cast("long").alias("n_added"))


def letter_requests(spark, folder):
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("letter_id"), _map(F.col("c_mktsegment"), TONES, "professional").alias("tone"), F.col("c_name").alias("company"),
        F.lit(None).cast("string").alias("role"), F.when(F.col("c_acctbal") > 0, "Spark, SQL").alias("skills"), F.col("c_nationkey").alias("years"),
        F.lit("Ada Example").alias("name"), F.lit("Analyst").alias("title"), F.lit("").alias("employer"), F.lit("Reduced costs").alias("achievement"))


def letters(spark, folder):
    made = lt.letters(letter_requests(spark, folder), ["letter_id"])
    words, minutes = lt.letter_metrics(F.col("letter"))
    return made.select("letter_id", "tone", "opening", "letter", words.alias("n_words"), minutes.alias("minutes"))


def _stream_events(spark, folder):
    schema = table(spark, folder, "events").schema
    return sa.read_events(spark, f"{folder}/events.parquet", schema)


def application_state_stream(spark, folder):
    """The batch fold as a stream run to the end of its input."""
    events = _stream_events(spark, folder).select(F.col("user_id").alias("application_id"), "event_id", "ts", _map(F.col("event_type"), STAGES).alias("stage"))
    place = scratch_folder(spark)
    sa.write_state(sa.application_state_stream(events), f"{place}/state", f"{place}/checkpoint").awaitTermination()
    return sa.read_state(spark, f"{place}/state", ["application_id"])


def activity_counts_stream(spark, folder):
    """Closed days only: a day is written once the watermark has passed its end."""
    place = scratch_folder(spark)
    counts = sa.activity_counts_stream(_stream_events(spark, folder))
    counts.writeStream.outputMode("append").format("parquet").option("path", f"{place}/days").option(
        "checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return mt._round(spark.read.schema(counts.schema).parquet(f"{place}/days"), 4)


QUERIES = {f.__name__: f for f in [
    application_state, application_timeline, stage_counts, latest_activities, newest_purchases, activity_counts, json_columns, created_applications,
    creation_activities, intake_gates, changed_applications, dashboard, upserted_state, cascade_delete, broken_references, titled_matches, match_scores,
    score_bands, bonus_skills, reply_scores, skill_context, keyword_assignment, letters, application_state_stream, activity_counts_stream]}

CASE_STAGE = "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in STAGES.items()) + " end"
EVENTS = f"""stage_events as (select user_id as application_id, event_id, ts, {CASE_STAGE} as stage,
    case when (props->>'k')::int >= 50 then 'k=' || (props->>'k') end as note from events)"""
STATE = f"""{EVENTS}, state as (select application_id, arg_max(stage, (ts, event_id)) as status, min(ts) filter (stage = 'applied') as applied_at,
    count(*) as n_changes, max(ts) as updated_at from stage_events group by application_id)"""
INTAKE = """intake as (select o_orderkey as application_id, c_nationkey as user_id, c_name as company, o_orderpriority as position,
    case when o_orderstatus = 'F' then 'Berlin' end as location, case o_orderstatus when 'O' then 'applied' when 'F' then 'offer' end as status,
    o_totalprice / 1000 as match_score, o_orderdate from orders join customer on o_custkey = c_custkey)"""
COUNTS = "select date_trunc('day', ts)::timestamp as day, event_type, count(*) as n, round(sum(value), 4) as value from events group by all"
MATCH = f"""{mt.TRADE}, syn(skill, synonym) as (values ('Brand#1', 'Brand#11'), ('Brand#2', 'Brand#22'), ('Brand#2', 'Brand#12')),
    asked as (select posting_id, skill, status from demanded where status <> 'uncertain'),
    met as (select p.posting_id, p.candidate_id, a.skill, a.status, exists (select 1 from offered o where o.candidate_id = p.candidate_id and (o.skill = a.skill
        or o.skill in (select synonym from syn where syn.skill = a.skill))) as m from pairs p join asked a using (posting_id)),
    sk as (select posting_id, candidate_id, count(*) filter (status = 'required') as nr, count(*) filter (status = 'preferred') as np,
        count(*) filter (status = 'required' and m) as mr, count(*) filter (status = 'preferred' and m) as mp,
        coalesce(list(skill order by regexp_extract(skill, '[0-9]+')::int desc) filter (status = 'required' and not m), []) as missing from met group by all),
    base as (select p.posting_id, p.candidate_id, p.quantity, coalesce(nr, 0) as nr, coalesce(np, 0) as np, coalesce(mr, 0) as mr, coalesce(mp, 0) as mp,
        coalesce(missing, []) as missing, floor(greatest(s_acctbal, 0) / 1000)::int as cy, floor(greatest(c_acctbal, 0) / 1000)::int as ry, s_nationkey % 6 * 20 as checks
        from pairs p left join sk using (posting_id, candidate_id) join supplier on s_suppkey = candidate_id join customer on c_custkey = posting_id),
    scored as (select *, least(greatest(floor(mr / greatest(nr, 1) * 100 * 0.75::double + mp / greatest(np, 1) * 100 * 0.25::double + 0.5), 20), 100)::int as skills_score,
        case when cy >= ry + 2 then 'exceeds' when cy >= ry then 'meets' else 'under' end as experience_status,
        least(greatest(floor(35 + quantity + 0.5), 40), 98)::int as resp, case when checks >= 80 then 100 when checks >= 40 then 92 else 60 end as edu,
        least(greatest(checks, 30), 100)::int as format_score from base),
    parts as (select *, case experience_status when 'exceeds' then 100 when 'meets' then 90 else greatest(floor(cy / ry * 85 + 0.5), 35)::int end as experience_score from scored),
    records as (select *, floor(skills_score * 0.4::double + experience_score * 0.25::double + resp * 0.2::double + edu * 0.1::double + format_score * 0.05::double + 0.5)::int as overall_score
        from parts)"""
LINES = "list_filter([trim(l) for l in string_split(text, chr(10))], lambda x: x <> '')"
CLEAN_LINE = r"trim(regexp_replace(b, '^[•\-*]\s*', ''))"


def template_sql(template: str) -> str:
    """A letter text as a concatenation of literals and field columns."""
    parts = re.split(r"\{(\w+)\}", template)
    return " || ".join(q(p) if i % 2 == 0 else f"v_{p}" for i, p in enumerate(parts))


def tone_sql(texts: dict) -> str:
    return "case tone " + " ".join(f"when '{t}' then {template_sql(x)}" for t, x in texts.items()) + " end"


LETTER = f"""req as (select c_custkey as letter_id, case c_mktsegment {" ".join(f"when '{k}' then '{v}'" for k, v in TONES.items())} else 'professional' end as tone,
        c_name as v_company, 'Software Engineer' as v_role, case when c_acctbal > 0 then 'Spark, SQL' else {q(lt.DEFAULTS['skills'])} end as v_skills,
        c_nationkey::varchar as v_years, 'Ada Example' as v_name, 'Analyst' as v_title, {q(lt.DEFAULTS['employer'])} as v_employer, 'reduced costs' as v_achievement from customer),
    made as (select letter_id, tone, {tone_sql(lt.OPENINGS)} as opening, {tone_sql(lt.GREETINGS)} || chr(10) || chr(10) || {tone_sql(lt.OPENINGS)} || chr(10) || chr(10)
        || {template_sql(lt.BODIES[0])} || chr(10) || chr(10) || {template_sql(lt.BODIES[1])} || chr(10) || chr(10) || {tone_sql(lt.CLOSINGS)} as letter from req)"""

ORACLES = {
    "application_state": f"with {STATE} select * from state",
    "application_state_stream": f"with {STATE} select * from state",
    "application_timeline": f"""with {EVENTS} select application_id, row_number() over (partition by application_id order by ts, event_id) as seq,
        strftime(ts, '%Y-%m-%d') as date, stage, coalesce(note, 'Stage moved to ' || stage) as note from stage_events""",
    "stage_counts": f"""with {STATE}, listed(status, position) as (values {", ".join(f"('{s}', {i})" for i, s in enumerate(fv.STATUSES))})
        select l.status, l.position, (select count(*) from state s where s.status = l.status) as n from listed l""",
    "latest_activities": """select user_id, event_id, ts, event_type, row_number() over (partition by user_id order by ts desc, event_id desc) as position
        from events qualify position <= 6""",
    "newest_purchases": "select event_id, user_id, ts, value from events where event_type = 'purchase' order by ts desc, event_id desc",
    "activity_counts": COUNTS,
    "activity_counts_stream": f"""select * from ({COUNTS}) where day + interval 1 day <= (select max(ts) from events) - interval 1 hour""",
    "json_columns": """select user_id, sum((props->>'k')::int)::bigint as k_total, '{"k":' || arg_max(props->>'k', (ts, event_id)) || '}' as last_props
        from events group by user_id""",
    "created_applications": f"""with {INTAKE} select application_id, company, position, coalesce(location, 'Remote') as location, coalesce(status, 'saved') as status,
        '' as notes, case when status = 'applied' then strftime(o_orderdate, '%Y-%m-%d') end as applied_date,
        '[{{"date":"' || strftime(o_orderdate, '%Y-%m-%d') || '","stage":"' || coalesce(status, 'saved') || '","note":"{ap.CREATED_NOTE}"}}]' as timeline from intake""",
    "creation_activities": f"""with {INTAKE} select user_id, 'application_updated' as type, 'Created application for ' || position || ' at ' || company as title,
        o_orderdate as created_at from intake""",
    "intake_gates": f"""with {INTAKE}, g as (select concat_ws(',', case when length(company) < 1 then 'company_missing' end, case when length(position) < 1 then 'position_missing' end,
            case when coalesce(status, 'saved') not in ({", ".join(f"'{s}'" for s in fv.STATUSES)}) then 'unknown_status' end,
            case when match_score not between 0 and 100 then 'score_out_of_range' end) as reasons from intake)
        select reasons = '' as is_valid, reasons, count(*) as n from g group by all""",
    "changed_applications": f"""with {INTAKE}, {STATE}, firsts as (select application_id, strftime(min(ts) filter (stage = 'applied'), '%Y-%m-%d') as d, count(*) as n from stage_events group by all)
        select i.application_id, coalesce(s.status, i.status, 'saved') as status,
            coalesce(case when i.status = 'applied' then strftime(o_orderdate, '%Y-%m-%d') end, f.d) as applied_date, 1 + coalesce(f.n, 0) as n_entries
        from intake i left join state s using (application_id) left join firsts f using (application_id)""",
    "dashboard": f"""with {mt.FEATURES}, {INTAKE}, a as (select user_id, case when match_score < 100 then 'rejected' when match_score < 200 then 'interviewing'
            else coalesce(status, 'screening') end as status from intake),
        m as (select count(*) as n, avg(({mt.combine_sql(mt.WEIGHTS)}) * 100) as mean from features)
        select n_nationkey as user_id, (select count(*) from customer where c_nationkey = n_nationkey) as total_resumes,
            (select count(*) from supplier where s_nationkey = n_nationkey) as total_jobs,
            (select count(*) from a where user_id = n_nationkey and status <> 'rejected') as active_applications,
            (select count(*) from a where user_id = n_nationkey and status in ('screening', 'interviewing')) as interviews,
            (select count(*) from a where user_id = n_nationkey and status = 'offer') as offers,
            m.n as total_matches, floor(m.mean + 0.5)::bigint as average_match_score from nation, m
        where n_nationkey in (select c_nationkey from customer union select s_nationkey from supplier)""",
    "upserted_state": """select user_id, event_id, ts, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1""",
    "cascade_delete": """with gone as (select c_custkey from customer where c_acctbal < 0)
        select 'customer' as table_name, count(*) as n from customer where c_custkey not in (from gone)
        union all select 'orders', count(*) from orders where o_custkey not in (from gone)
        union all select 'cleared_lines', count(*) from lineitem where l_orderkey in (select o_orderkey from orders where o_custkey in (from gone))""",
    "broken_references": "select event_type, count(*) as n from events where event_id not in (select vec_id from embeddings) group by all",
    "titled_matches": f"""with {mt.TRADE} select posting_id, candidate_id, c_name as posting, n_name as place, s_name as candidate, quantity from pairs
        join customer on c_custkey = posting_id join nation on n_nationkey = c_nationkey join supplier on s_suppkey = candidate_id""",
    "match_scores": f"""with {MATCH} select posting_id, candidate_id, skills_score, experience_score, experience_status, format_score, overall_score,
        concat_ws(' | ', case when skills_score >= 75 then 'Strong technical stack alignment: Matched ' || (mr + mp) || ' critical and preferred skills.' end,
            case when experience_status <> 'under' then 'Seniority fit: Candidate meets the target experience requirements (' || cy || ' yrs vs ' || ry || ' yrs required).' end,
            case when resp >= 75 then 'High semantic alignment between past work accomplishments and day-to-day job responsibilities.' end,
            case when checks >= 80 then 'Clean, machine-readable ATS formatting with recognizable sections and contact fields.' end) as strengths,
        concat_ws(' | ', case when len(missing) > 0 then 'Missing ' || len(missing) || ' high-priority required skills: ' || array_to_string(missing[1:3], ', ') || '.' end,
            case when experience_status = 'under' then 'Candidate experience (' || cy || ' yrs) is under the target threshold (' || ry || ' yrs).' end,
            case when checks < 75 then 'Resume formatting has potential ATS parse bottlenecks (missing sections or metrics).' end) as gaps,
        concat_ws(' | ', case when len(missing) > 0 then 'high: Incorporate Missing Core Skills: ' || array_to_string(missing[1:2], ' and ') end,
            'high: Strengthen Bullet Points with Quantifiable Metrics',
            case when experience_status = 'under' then 'medium: Highlight High-Ownership & Accelerated Leadership' end) as advice from records""",
    "score_bands": f"""with {MATCH} select case when overall_score >= 80 then 'Exceptional Alignment' when overall_score >= 65 then 'Moderate Match'
        else 'Significant Skill Gaps' end as band, count(*) as n from records group by all""",
    "bonus_skills": f"""with {mt.TRADE}, o as (select candidate_id, list(skill order by skill desc) as o from offered group by all),
        d as (select posting_id, list(skill) filter (status <> 'uncertain') as d from demanded group by all)
        select posting_id, candidate_id, array_to_string(list_filter(o, lambda s: not list_contains(coalesce(d, []), s))[1:8], ',') as bonus
        from pairs join o using (candidate_id) join d using (posting_id)""",
    "reply_scores": f"""with {REPLIES}, bag as (select posting_id, candidate_id, unnest({WORDS.format(t='a.text', s=STOP)}) as term, 1 as a, 0 as b
            from pairs join answered a using (candidate_id)
        union all select posting_id, candidate_id, unnest({WORDS.format(t='q.text', s=STOP)}), 0, 1 from pairs join asked q using (posting_id)),
        c as (select posting_id, candidate_id, term, sum(a) as a, sum(b) as b from bag group by all),
        s as (select posting_id, candidate_id, case when sum(a) > 0 and sum(b) > 0 then least(sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))), 1) end as s from c group by all)
        select p.posting_id, p.candidate_id, case when an.text = '' or asked.text = '' then 75 else
            least(greatest(floor(35 + coalesce(s, 0.5) * 110 + 0.5), 40), 98)::int end as responsibilities_score
        from pairs p join answered an using (candidate_id) join asked using (posting_id) left join s on s.posting_id = p.posting_id and s.candidate_id = p.candidate_id""",
    "skill_context": f"""with h as (select doc_id, source, list_filter({LINES}, lambda l: contains(lower(l), 'thble'))[1] as l from documents)
        select doc_id, source || ': "' || substr(l, 1, 100) || '..."' as context from h where l is not null""",
    "keyword_assignment": f"""with k as (select doc_id, list_filter({LINES}, lambda x: length(x) >= 20) as ls from documents),
        r as (select doc_id, unnest(range(0, len(ls)))::bigint as seq, unnest(ls) as b from k),
        a as (select *, ['the', 'erin', 'tion'][seq % 3 + 1] as keyword, {CLEAN_LINE} as clean from r)
        select doc_id, seq, md5(b) as bullet_md5, keyword, regexp_matches(clean, {q(fv.BULLET_QUANTITY)}) as has_metric, contains(lower(clean), keyword) as has_keyword,
            (case when contains(lower(clean), keyword) then 0 else 1 end)::bigint as n_added from a""",
    "letters": f"""with {LETTER}, w as (select *, len(list_filter(regexp_split_to_array(letter, '\\s+'), lambda x: x <> ''))::int as n_words from made)
        select letter_id, tone, opening, letter, n_words, ceil(n_words / 200.0::double)::int as minutes from w""",
}
