"""Registered cleaning, de-duplication, validation and split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom import fixed_values as fv
from pairloom.catalog.inputs import order_lines, ranked_pairs, table, with_views
from pairloom.catalog.sqltext import clean, q, sub
from pairloom.functions import text as tx
from pairloom.functions.shape import as_rows
from pairloom.operators import prepare as pp
from pairloom.operators import privacy
from pairloom.operators import split as sp
from pairloom.sources.tables import fingerprint


def cleaned_documents(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", tx.clean_text(F.col("text")).alias("text"))
    return docs.select("doc_id", tx.content_id(F.col("text")).alias("content_id"), F.length("text").alias("n_chars"),
                       tx.word_count(F.col("text")).alias("n_words"))


def tidied_extracts(spark, folder):
    """Page sources as extracted text: line ends, blanks and empty lines tidied."""
    tidy = tx.tidy_extract(F.col("html"))
    return table(spark, folder, "pages").select("page_id", F.md5(tidy).alias("tidy_md5"), F.length(tidy).alias("n_chars"),
                                                F.length(tx.printable_ascii(tidy)).alias("n_ascii_chars"))


def canonical_labels(spark, folder):
    """Quality marks spelled in three sloppy ways become ordinal labels."""
    labels = table(spark, folder, "labels")
    dirty = F.when(F.col("quality") == 0, "No_Fit").when(F.col("toxic") == 1, "potential fit").otherwise(" Good Fit ")
    named = labels.select("doc_id", tx.canonical_label(dirty).alias("label"))
    return named.withColumn("label_id", tx.label_id(F.col("label"))).withColumn("back", tx.label_name(F.col("label_id")))


def graded_documents(spark, folder):
    """(posting = source, candidate = document, label, text): the labelled documents."""
    return table(spark, folder, "documents").join(canonical_labels(spark, folder).drop("back"), "doc_id").select(
        F.col("source").alias("posting_id"), F.col("doc_id").alias("candidate_id"), "label", "label_id", "text", "lang")


def first_order_lines(spark, folder):
    """The first line per (posting, candidate)."""
    order = [F.col("price"), F.col("quantity"), F.col("offer"), F.col("part_id")]
    return pp.keep_first(order_lines(spark, folder), ["posting_id", "candidate_id"], order)


def settled_pairs(spark, folder):
    order = [F.col("price"), F.col("quantity"), F.col("offer"), F.col("part_id")]
    settled = pp.settle_pairs(order_lines(spark, folder), ["posting_id", "candidate_id"], "label_id", order)
    return settled.where((F.col("n_rows") > 1) | (F.col("n_labels") > 1)).select(
        "posting_id", "candidate_id", F.col("n_rows").cast("long"), "n_labels")


def preparation_report(spark, folder):
    order = [F.col("price"), F.col("quantity"), F.col("offer"), F.col("part_id")]
    lines = order_lines(spark, folder).withColumn("is_empty", F.col("label_id").isNull())
    settled = pp.settle_pairs(lines, ["posting_id", "candidate_id"], "label_id", order)
    kept = ranked_pairs(spark, folder).withColumn("candidate_group", F.floor(F.col("candidate_id") / 10))
    return pp.drop_report(lines, settled).unionByName(pp.id_report(kept))


def frame_profile(spark, folder):
    return pp.frame_profile(table(spark, folder, "events")).drop("data_type")


def violations(spark, folder):
    docs = graded_documents(spark, folder).withColumns({"candidate": F.col("text"), "posting": F.col("posting_id"),
                                                        "candidate_group": F.col("lang")})
    return pp.violations(docs.drop("text"))


def quality_gates(spark, folder):
    gated = pp.quality_gates(table(spark, folder, "documents"), pp.document_rules(low=200, high=10_000))
    return gated.select("doc_id", "is_valid", F.array_join("reasons", ",").alias("reasons"))


def original_split_leakage(spark, folder):
    """Documents by content id: how many of the last ten sources' texts also occur in the others."""
    docs = table(spark, folder, "documents").select(
        tx.content_id(tx.clean_text(F.col("text"))).alias("candidate_id"),
        F.when(F.length("source") > 4, "test").otherwise("train").alias("original_split"))
    return pp.original_split_leakage(docs)


def label_counts(spark, folder):
    return graded_documents(spark, folder).groupBy("posting_id").pivot("label_id", [0, 1, 2]).agg(F.count(F.lit(1))).select(
        "posting_id", *[F.coalesce(str(i), F.lit(0)).alias(f"label_{i}") for i in range(3)])


def privacy_scan(spark, folder):
    return privacy.scan_texts(table(spark, folder, "documents"), "doc_id", "text")


def privacy_report(spark, folder):
    docs = table(spark, folder, "documents")
    return privacy.scan_report(privacy.scan_texts(docs, "doc_id", "text"), docs, "doc_id")


def column_scan(spark, folder):
    return privacy.scan_columns(table(spark, folder, "customer"), "customer").unionByName(
        privacy.scan_columns(table(spark, folder, "conversations"), "conversations"))


def order_groups(spark, folder):
    """Ranked pairs with the order as the group that must stay together."""
    return ranked_pairs(spark, folder).withColumn("candidate_group", F.floor(F.col("candidate_id") / 10))


def grouped_split(spark, folder):
    return sp.assign_groups(order_groups(spark, folder), "candidate_group")


def split_summary(spark, folder):
    pairs = sp.grouped_split(order_groups(spark, folder))
    return sp.split_summary(pairs).join(sp.ranking_groups(pairs), "split")


def key_overlaps(spark, folder):
    pairs = sp.grouped_split(order_groups(spark, folder))
    return sp.leakage_report(pairs)


def group_folds(spark, folder):
    return sp.stratified_group_folds(order_groups(spark, folder))


def fold_balance(spark, folder):
    pairs = order_groups(spark, folder)
    return sp.fold_balance(pairs, sp.stratified_group_folds(pairs))


def repetition_splits(spark, folder):
    pairs = order_groups(spark, folder)
    spread = sp.rotate_repetitions(sp.stratified_group_folds(pairs))
    return spread.groupBy("repetition", "split").agg(F.count("*").alias("n_groups"))


def table_fingerprint(spark, folder):
    """Row counts and order-free row hashes per line status."""
    return fingerprint(table(spark, folder, "lineitem").select(*FINGERPRINTED, "l_linestatus"), ["l_linestatus"])


FINGERPRINTED = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_quantity"]


QUERIES = {f.__name__: f for f in [
    cleaned_documents, tidied_extracts, canonical_labels, first_order_lines, settled_pairs, preparation_report, frame_profile, violations,
    quality_gates, original_split_leakage, label_counts, privacy_scan, privacy_report, column_scan, grouped_split, split_summary,
    key_overlaps, group_folds, fold_balance, repetition_splits, table_fingerprint]}

GRADED = """graded as (select d.source as posting_id, d.doc_id as candidate_id, d.text, d.lang,
    case when quality = 0 then 0 when toxic = 1 then 1 else 2 end as label_id from documents d join labels l using (doc_id))"""
GROUPS = "order_groups as (select *, floor(candidate_id / 10)::bigint as candidate_group from ranked_pairs)"
ASSIGNED = """drawn as (select distinct candidate_group, md5('42:' || candidate_group) as draw from order_groups),
    placed as (select candidate_group, row_number() over (order by draw, candidate_group) as place, count(*) over () as n from drawn),
    assigned as (select candidate_group, case when place <= ceil(n * 0.15) then 'test' when place <= ceil(n * 0.3) then 'validation'
        else 'train' end as split from placed)"""
FOLDS = """group_labels as (select candidate_group, label_id, count(*) as n from order_groups group by all),
    groups as (select candidate_group, sum(n) as size, arg_max(label_id, (n, label_id)) as main_label,
        md5('42:' || candidate_group) as draw from group_labels group by candidate_group),
    dealt as (select candidate_group, (row_number() over (order by main_label, size desc, draw, candidate_group) - 1) % 40 as turn from groups),
    folds as (select candidate_group, (case when turn < 20 then turn else 39 - turn end)::int as fold from dealt)"""
VIEWS = ["order_lines", "ranked_pairs"]
EMAIL_RE2, PHONE_RE2 = fv.SCAN_EMAIL.replace(r"\w", r"\p{L}\p{N}_"), r"(?:^|[^0-9])(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}(?:[^0-9]|$)"
FINDINGS = f"""findings as (select doc_id, 'e-mail address' as finding from documents where regexp_matches(text, {q(EMAIL_RE2)})
    union all select doc_id, 'phone-number pattern' from documents where regexp_matches(text, {q(PHONE_RE2)})
    union all select doc_id, 'URL' from documents where regexp_matches(text, {q(fv.SCAN_URL)}))"""
TIDY = f"trim({sub(sub(sub('html', chr(13) + chr(10) + '?', chr(10)), '[ ' + chr(9) + ']+', ' '), chr(10) + '{3,}', chr(10) * 2)}, ' ' || chr(10) || chr(9))"

ORACLES = {
    "cleaned_documents": f"""select doc_id, substr(sha1(lower(t)), 1, 12) as content_id, length(t)::int as n_chars,
        len(list_filter(string_split(t, ' '), lambda x: x <> ''))::int as n_words from (select doc_id, {clean('text')} as t from documents)""",
    "tidied_extracts": f"""select page_id, md5(t) as tidy_md5, length(t)::int as n_chars, length(t)::int as n_ascii_chars
        from (select page_id, {TIDY} as t from pages)""",
    "canonical_labels": """select doc_id, label, label_id, label as back from (select doc_id,
            case when quality = 0 then 'No Fit' when toxic = 1 then 'Potential Fit' else 'Good Fit' end as label,
            case when quality = 0 then 0 when toxic = 1 then 1 else 2 end as label_id from labels)""",
    "first_order_lines": with_views(["order_lines"], """select * from order_lines
        qualify row_number() over (partition by posting_id, candidate_id order by price, quantity, offer, part_id) = 1"""),
    "settled_pairs": with_views(["order_lines"], """select posting_id, candidate_id, count(*) as n_rows, count(distinct label_id) as n_labels
        from order_lines group by all having count(*) > 1"""),
    "preparation_report": with_views(VIEWS, f""", {GROUPS}, per as (select posting_id, candidate_id, count(*) as n, count(distinct label_id) as k
            from order_lines group by all),
        members as (select candidate_group, count(distinct candidate_id) as n from order_groups group by all),
        c as (select candidate_id, count(*) as n from ranked_pairs group by all), p as (select posting_id, count(*) as n from ranked_pairs group by all)
        select 'raw_rows' as metric, count(*)::bigint as value from order_lines
        union all select 'dropped_empty', count(*) filter (label_id is null) from order_lines
        union all select 'dropped_exact_duplicates', sum(n - k)::bigint from per
        union all select 'dropped_conflicting_pairs', sum(case when k > 1 then k else 0 end)::bigint from per
        union all select 'rows', count(*) filter (k = 1) from per
        union all select 'unique_candidates', count(*) from c union all select 'candidates_in_multiple_pairs', count(*) filter (n > 1) from c
        union all select 'unique_postings', count(*) from p union all select 'postings_in_multiple_pairs', count(*) filter (n > 1) from p
        union all select 'candidate_groups', count(*) from members
        union all select 'near_duplicates_merged', (sum(n) - count(*))::bigint from members"""),
    "frame_profile": " union all ".join(f"select '{c}' as column_name, count(*) filter ({c} is null) as nulls, count(*) as rows from events"
                                        for c in ["event_id", "ts", "user_id", "event_type", "value", "props"]),
    "violations": f"""with {GRADED} select 'null_values' as rule, count(*) filter (text is null or posting_id is null or lang is null or label_id is null
            or candidate_id is null)::bigint as violations from graded
        union all select 'empty_text', count(*) filter (length(text) = 0 or length(posting_id) = 0) from graded
        union all select 'unknown_label', count(*) filter (label_id not in (0, 1, 2)) from graded
        union all select 'label_id_mismatch', 0
        union all select 'duplicate_pair', coalesce(sum(n - 1), 0)::bigint from (select count(*) as n from graded group by posting_id, candidate_id)""",
    "quality_gates": r"""select doc_id, reasons = '' as is_valid, reasons from (select doc_id, concat_ws(',',
        case when not regexp_matches(text, '\S') then 'blank' end, case when length(text) < 200 then 'too_short' end,
        case when length(text) > 10000 then 'too_long' end) as reasons from documents)""",
    "original_split_leakage": f"""with ids as (select substr(sha1(lower({clean('text')})), 1, 12) as id, length(source) > 4 as test from documents),
        sides as (select id, bool_or(test) as t, bool_or(not test) as r from ids group by id)
        select count(*) filter (t) as original_test_candidates, count(*) filter (t and r) as also_in_original_train,
            round_even(count(*) filter (t and r) / count(*) filter (t), 4) as share from sides""",
    "label_counts": f"""with {GRADED} select posting_id, count(*) filter (label_id = 0) as label_0, count(*) filter (label_id = 1) as label_1,
        count(*) filter (label_id = 2) as label_2 from graded group by posting_id""",
    "privacy_scan": f"with {FINDINGS} select * from findings",
    "privacy_report": f"""with {FINDINGS} select (select count(distinct doc_id) from documents) as sources_scanned, count(*) as findings,
        count(*) = 0 as passed from findings""",
    "column_scan": """with n as (select 'customer' as source, max(greatest(length(c_custkey::varchar), length(c_name), length(c_nationkey::varchar),
            length(c_mktsegment), length(c_acctbal::varchar))) as n from customer
        union all select 'conversations', max(greatest(length(text), length(role))) from conversations)
        select source, 'text cell of ' || n || ' characters' as finding from n where n > 120""",
    "grouped_split": with_views(VIEWS, f", {GROUPS}, {ASSIGNED} select * from assigned"),
    "split_summary": with_views(VIEWS, f""", {GROUPS}, {ASSIGNED}, s as (select * from order_groups join assigned using (candidate_group)),
        g as (select split, posting_id, count(*) as n, count(distinct label_id) as k from s group by all)
        select split, count(*) as n_rows, count(distinct candidate_id) as unique_candidates, count(distinct candidate_group) as unique_groups,
            count(distinct posting_id) as unique_postings, count(*) filter (label_id = 0) as label_0, count(*) filter (label_id = 1) as label_1,
            count(*) filter (label_id = 2) as label_2, (select count(*) from g where g.split = s.split and n >= 2 and k >= 2) as ranking_groups
        from s group by split"""),
    "key_overlaps": with_views(VIEWS, f""", {GROUPS}, {ASSIGNED}, s as (select * from order_groups join assigned using (candidate_group)),
        v as (select distinct 'candidate_id' as key, candidate_id::varchar as value, split from s
            union all select distinct 'candidate_group', candidate_group::varchar, split from s
            union all select distinct 'posting_id', posting_id::varchar, split from s),
        sides(split_a, split_b) as (values ('train', 'validation'), ('train', 'test'), ('validation', 'test')),
        counts as (select a.key, a.split as split_a, b.split as split_b, count(*) as n from v a join v b on a.key = b.key and a.value = b.value group by all)
        select k.key, split_a, split_b, coalesce(n, 0) as overlap, k.key <> 'posting_id' and coalesce(n, 0) > 0 as leaks
        from (select distinct key from v) k cross join sides left join counts using (key, split_a, split_b)"""),
    "group_folds": with_views(VIEWS, f", {GROUPS}, {FOLDS} select * from folds"),
    "fold_balance": with_views(VIEWS, f""", {GROUPS}, {FOLDS} select fold, count(*) as n_rows, count(distinct candidate_group) as n_groups,
        count(*) filter (label_id = 0) as label_0, count(*) filter (label_id = 1) as label_1, count(*) filter (label_id = 2) as label_2
        from order_groups join folds using (candidate_group) group by fold"""),
    "repetition_splits": with_views(VIEWS, f""", {GROUPS}, {FOLDS}, r as (select (unnest(range(0, 5)))::int as repetition),
        o as (select repetition, (((fold - 3 * repetition) % 20) + 20) % 20 as off from folds, r)
        select repetition, case when off < 3 then 'test' when off < 6 then 'validation' else 'train' end as split, count(*) as n_groups
        from o group by all"""),
    "table_fingerprint": f"""select l_linestatus, count(*) as n_rows, sum(('0x' || md5(concat_ws('|', {", ".join(f"{c}::varchar" for c in sorted(FINGERPRINTED))}))[1:15])::hugeint)::varchar
        as sum_hash from lineitem group by all""",
}
