"""Registered ranking and classification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom import fixed_values as fv
from pairloom.catalog.inputs import order_lines, ranked_pairs, with_views
from pairloom.functions.shape import as_rows
from pairloom.operators import classify as cl
from pairloom.operators import ranking as rk
from pairloom.session import written

SCORES = ["price", "quantity", "offer"]


def _round(df, digits=6, skip=()):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes])


def scored_by_model(spark, folder):
    """(model, posting, candidate, label, score): three scores of the same pairs, exploded inside the row."""
    models = F.array(*[F.struct(F.lit(s).alias("model"), F.col(s).alias("score")) for s in SCORES])
    return ranked_pairs(spark, folder).select("posting_id", "candidate_id", "label_id", F.explode(models).alias("m")).select(
        "m.model", "posting_id", "candidate_id", "label_id", "m.score")


def posting_metrics(spark, folder):
    return _round(rk.posting_metrics(ranked_pairs(spark, folder), "price"))


def ranking_summary(spark, folder):
    per = rk.posting_metrics(scored_by_model(spark, folder), "score", ["model"])
    return _round(rk.ranking_summary(per, ["model"]))


def top_candidate(spark, folder):
    return rk.top_candidate(ranked_pairs(spark, folder), "price", carry=["label_id"])


def first_three(spark, folder):
    return rk.first_per_group(ranked_pairs(spark, folder).select("posting_id", "candidate_id", "price"), ["posting_id"],
                              [F.desc("price"), F.asc("candidate_id")], 3).withColumn("position", F.col("position").cast("long"))


def mean_rank(spark, folder):
    pairs = ranked_pairs(spark, folder).select("posting_id", "candidate_id", "quantity")
    return rk.mean_rank(pairs, "quantity", "mean_rank")


def random_reference(spark, folder):
    return _round(rk.random_order_metrics(ranked_pairs(spark, folder), n_shuffles=200))


def random_expectation(spark, folder):
    return _round(rk.expected_random_posting_metrics(ranked_pairs(spark, folder)))


def threshold_fit(spark, folder):
    return _round(cl.fit_thresholds(scored_by_model(spark, folder), ["model"]))


def classification(spark, folder):
    scored = scored_by_model(spark, folder)
    predicted = cl.classify(scored, cl.fit_thresholds(scored, ["model"]), ["model"])
    return _round(cl.classification_metrics(predicted, ["model"]))


def majority_reference(spark, folder):
    return _round(cl.majority_reference(ranked_pairs(spark, folder)))


def score_percentile(spark, folder):
    """Where each line's price stands among the prices of label 2."""
    pairs = written(ranked_pairs(spark, folder).select("posting_id", "candidate_id", "label_id", F.col("price").alias("score")))
    return cl.score_percentile(pairs.select("posting_id", "candidate_id", "score"), pairs.where("label_id = 2").select("score"))


def match_categories(spark, folder):
    scored = scored_by_model(spark, folder)
    predicted = cl.classify(scored, cl.fit_thresholds(scored, ["model"]), ["model"])
    named = predicted.withColumn("category", cl.match_category(F.col("predicted_label_id")))
    return named.groupBy("model", "category").agg(F.count("*").alias("n"))


QUERIES = {
    "posting_metrics": posting_metrics, "ranking_summary": ranking_summary, "top_candidate": top_candidate,
    "first_three_per_posting": first_three, "mean_rank": mean_rank, "random_reference": random_reference,
    "random_expectation": random_expectation, "threshold_fit": threshold_fit, "classification": classification,
    "majority_reference": majority_reference, "score_percentile": score_percentile, "match_categories": match_categories,
}

BY_MODEL = "by_model as (" + " union all ".join(
    f"select '{s}' as model, posting_id, candidate_id, label_id, {s} as score from ranked_pairs" for s in SCORES) + ")"


def metrics_sql(source: str, keys: str, score: str) -> str:
    """CTEs ending in per_posting, for pairs in source grouped by keys."""
    gain = lambda k, col, rank: f"sum(case when {rank} <= {k} then {col} / log2({rank} + 1) else 0 end)"
    return f"""
    placed as (select {keys}, candidate_id, label_id,
            row_number() over (partition by {keys} order by {score} desc, candidate_id) as rk,
            row_number() over (partition by {keys} order by label_id desc, candidate_id) as ideal,
            sum((label_id > 0)::int) over (partition by {keys} order by {score} desc, candidate_id rows unbounded preceding) as hits
        from {source}),
    stats as (select {keys}, count(*) as n_candidates, sum((label_id > 0)::int)::bigint as n_relevant,
            count(distinct label_id) as labels,
            {gain(5, 'label_id', 'rk')} as d5, {gain(10, 'label_id', 'rk')} as d10,
            {gain(5, 'label_id', 'ideal')} as i5, {gain(10, 'label_id', 'ideal')} as i10,
            min(case when label_id > 0 then rk end) as first_hit,
            avg(case when label_id > 0 then hits / rk end) as ap,
            avg(case when rk <= 1 then (label_id > 0)::int end) as p1,
            avg(case when rk <= 5 then (label_id > 0)::int end) as p5
        from placed group by {keys}),
    per_posting as (select {keys}, n_candidates, n_relevant,
            case when n_candidates < 2 then 'single_candidate' when labels < 2 then 'single_label' end as excluded,
            case when n_candidates >= 2 and labels >= 2 then case when i5 > 0 then d5 / i5 else 0 end end as ndcg_5,
            case when n_candidates >= 2 and labels >= 2 then case when i10 > 0 then d10 / i10 else 0 end end as ndcg_10,
            case when labels >= 2 and n_relevant > 0 and n_relevant < n_candidates then 1 / first_hit end as mrr,
            case when labels >= 2 and n_relevant > 0 and n_relevant < n_candidates then ap end as map,
            case when labels >= 2 and n_relevant > 0 and n_relevant < n_candidates then p1 end as p_1,
            case when labels >= 2 and n_relevant > 0 and n_relevant < n_candidates then p5 end as p_5
        from stats)"""


R6 = lambda cols: ", ".join(f"round({c}, 6) as {c}" for c in cols)
SUMMARY_COLUMNS = f"""count(*) as jobs_total, count(*) filter (excluded is null) as jobs_eligible,
    count(*) filter (excluded = 'single_candidate') as excluded_single_candidate,
    count(*) filter (excluded = 'single_label') as excluded_single_label,
    count(mrr) as jobs_binary_eligible, count(*) filter (excluded is null and mrr is null) as jobs_binary_trivial,
    {", ".join(f"round(avg({m}), 6) as {m}" for m in fv.RANKING_METRICS)}"""


def random_sql(source: str, keys: str) -> str:
    """CTEs ending in chance(keys, metrics): expectations over all orders as sums over the ranks at which a hit, or the first hit, may stand."""
    choose = lambda n, k: f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"
    ideal = lambda k: f"sum(case when best <= {k} then label_id / log2(best + 1) else 0 end)"
    some = lambda k: f"list_sum([1 / log2(i + 1) for i in range(1, least(n, {k}) + 1)])"
    ranks = "list_sum([{} for i in range(1, n + 1)])"
    first = ranks.format(f"case when i <= n - r + 1 then exp({choose('(n - i)', '(r - 1)')} - {choose('n', 'r')}) / i else 0 end")
    precise = ranks.format("(1 + (i - 1) * (r - 1) / (n - 1)) / (i * n)")
    return f"""
    by_label as (select *, row_number() over (partition by {keys} order by label_id desc) as best from {source}),
    label_counts as (select {keys}, count(*) as n, sum((label_id > 0)::int)::bigint as r, count(distinct label_id) as labels, avg(label_id) as gain,
            {ideal(5)} as i5, {ideal(10)} as i10 from by_label group by {keys}),
    chance as (select {keys}, n as n_candidates, r as n_relevant,
            case when labels >= 2 then gain * {some(5)} / i5 end as ndcg_5, case when labels >= 2 then gain * {some(10)} / i10 end as ndcg_10,
            case when r > 0 and r < n then {first} end as mrr, case when r > 0 and r < n then {precise} end as map,
            case when r > 0 and r < n then r / n end as p_1, case when r > 0 and r < n then r / n end as p_5 from label_counts)"""


def thresholds_sql(source: str, by: str) -> str:
    """CTEs ending in fitted(by, t1, t2, macro_f1) for scored rows in source."""
    qs = ", ".join(f"({i + 1}, {q!r}::double)" for i, q in enumerate(cl.GRID))
    return f"""
    qs(q_index, q) as (values {qs}),
    ordered as (select {by}, score, row_number() over (partition by {by} order by score) as rn,
            count(*) over (partition by {by}) as n from {source}),
    spots as (select {by}, q_index, (n - 1) * q as spot, n from (select distinct {by}, n from ordered), qs),
    grid_values as (select s.{by}, s.q_index, a.score as a, b.score as b, spot - floor(spot) as t
        from spots s join ordered a on a.{by} = s.{by} and a.rn = floor(spot) + 1
                     join ordered b on b.{by} = s.{by} and b.rn = least(floor(spot) + 2, s.n)),
    grid as (select {by}, threshold, row_number() over (partition by {by} order by threshold) as i from (
        select distinct {by}, case when t >= 0.5 then b - (b - a) * (1 - t) else a + (b - a) * t end as threshold from grid_values)),
    value_counts as (select {by}, score, count(*) filter (label_id = 0) as c0, count(*) filter (label_id = 1) as c1,
            count(*) filter (label_id = 2) as c2 from {source} group by {by}, score),
    below as (select g.{by}, g.i, g.threshold,
            coalesce(sum(c0) filter (v.score < g.threshold), 0) as b0, coalesce(sum(c1) filter (v.score < g.threshold), 0) as b1,
            coalesce(sum(c2) filter (v.score < g.threshold), 0) as b2, sum(c0) as a0, sum(c1) as a1, sum(c2) as a2
        from grid g join value_counts v on v.{by} = g.{by} group by all),
    judged as (select x.{by}, x.i, y.i as j, x.threshold as t1, y.threshold as t2,
            x.b0 as h0, y.b1 - x.b1 as h1, x.a2 - y.b2 as h2, x.a0, x.a1, x.a2,
            x.b0 + x.b1 + x.b2 as p0, y.b0 + y.b1 + y.b2 - x.b0 - x.b1 - x.b2 as p1,
            x.a0 + x.a1 + x.a2 - y.b0 - y.b1 - y.b2 as p2
        from below x join below y on x.{by} = y.{by} and x.i < y.i),
    f1 as (select {by}, i, j, t1, t2,
            (0.0::double + coalesce(2.0::double * h0 / nullif(a0 + p0, 0), 0) + coalesce(2.0::double * h1 / nullif(a1 + p1, 0), 0)
              + coalesce(2.0::double * h2 / nullif(a2 + p2, 0), 0))
            / ((a0 + p0 > 0)::int + (a1 + p1 > 0)::int + (a2 + p2 > 0)::int) as macro_f1 from judged),
    fitted as (select {by}, t1, t2, macro_f1 from f1
        qualify row_number() over (partition by {by} order by macro_f1 desc, i, j) = 1)"""


def confusion_sql(source: str, keys: str) -> str:
    cells = ", ".join(f"count(*) filter (label_id = {t} and predicted = {p}) as n_{t}{p}" for t in range(3) for p in range(3))
    true = [f"(n_{c}0 + n_{c}1 + n_{c}2)" for c in range(3)]
    called = [f"(n_0{c} + n_1{c} + n_2{c})" for c in range(3)]
    mean = lambda top, bottom: "(" + " + ".join(f"coalesce({top(c)} / nullif({bottom(c)}, 0), 0)" for c in range(3)) + ") / 3"
    group = f"group by {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"""
    select *, round((n_00 + n_11 + n_22) / n_rows, 6) as accuracy,
        round({mean(lambda c: f'n_{c}{c}', lambda c: called[c])}, 6) as macro_precision,
        round({mean(lambda c: f'n_{c}{c}', lambda c: true[c])}, 6) as macro_recall,
        round({mean(lambda c: f'2 * n_{c}{c}', lambda c: f'({true[c]} + {called[c]})')}, 6) as macro_f1
    from (select {lead}count(*) as n_rows, {cells} from {source} {group})"""


PREDICTED = """predicted_rows as (select s.*, (s.score >= f.t1)::int + (s.score >= f.t2)::int as predicted
    from by_model s join fitted f on s.model = f.model)"""
VIEWS = ["order_lines", "ranked_pairs"]

ORACLES = {
    "posting_metrics": with_views(VIEWS, f""", {metrics_sql('ranked_pairs', 'posting_id', 'price')}
        select posting_id, n_candidates, n_relevant, excluded, {R6(['ndcg_5', 'ndcg_10', 'mrr', 'map', 'p_1', 'p_5'])} from per_posting"""),
    "ranking_summary": with_views(VIEWS, f""", {BY_MODEL}, {metrics_sql('by_model', 'model, posting_id', 'score')}
        select model, {SUMMARY_COLUMNS} from per_posting group by model"""),
    "top_candidate": with_views(VIEWS, """select posting_id, candidate_id, price, label_id from ranked_pairs
        qualify row_number() over (partition by posting_id order by price desc, candidate_id) = 1"""),
    "first_three_per_posting": with_views(VIEWS, """select posting_id, candidate_id, price,
            row_number() over (partition by posting_id order by price desc, candidate_id) as position from ranked_pairs
        qualify position <= 3"""),
    "mean_rank": with_views(VIEWS, """select posting_id, candidate_id, quantity,
            rank() over (partition by posting_id order by quantity desc)
              + (count(*) over (partition by posting_id, quantity) - 1) / 2 as mean_rank from ranked_pairs"""),
    "random_reference": with_views(VIEWS, f""", shuffled as (select posting_id, candidate_id, label_id, shuffle,
            md5('42:' || shuffle || ':' || posting_id || ':' || candidate_id) as draw
            from ranked_pairs, (select unnest(range(1, 201)) as shuffle)),
        {metrics_sql('shuffled', 'shuffle, posting_id', 'draw')},
        per_shuffle as (select shuffle, {", ".join(f"avg({m}) as {m}" for m in fv.RANKING_METRICS)} from per_posting group by shuffle)
        select count(*) as n_shuffles, {", ".join(f"round(avg({m}), 6) as {m}" for m in fv.RANKING_METRICS)} from per_shuffle"""),
    "random_expectation": with_views(VIEWS, f""", {random_sql('ranked_pairs', 'posting_id')}
        select posting_id, n_candidates, n_relevant, {R6(fv.RANKING_METRICS)} from chance"""),
    "threshold_fit": with_views(VIEWS, f""", {BY_MODEL}, {thresholds_sql('by_model', 'model')}
        select model, {R6(['t1', 't2', 'macro_f1'])} from fitted"""),
    "classification": with_views(VIEWS, f""", {BY_MODEL}, {thresholds_sql('by_model', 'model')}, {PREDICTED}
        {confusion_sql('predicted_rows', 'model')}"""),
    "majority_reference": with_views(VIEWS, f""", zero as (select label_id, 0 as predicted from ranked_pairs)
        {confusion_sql('zero', '')}"""),
    "score_percentile": with_views(VIEWS, """, ref as (select price, count(*) as w from ranked_pairs where label_id = 2 group by price),
        cum as (select price, sum(w) over (order by price) as upto, w from ref)
        select p.posting_id, p.candidate_id, p.price as score,
            round_even(100.0::double * coalesce(case when c.price = p.price then c.upto - c.w else c.upto end, 0) / t.total, 1) as percentile
        from ranked_pairs p asof left join cum c on p.price >= c.price, (select sum(w) as total from ref) t"""),
    "match_categories": with_views(VIEWS, f""", {BY_MODEL}, {thresholds_sql('by_model', 'model')}, {PREDICTED}
        select model, case predicted when 0 then 'Weak match' when 1 then 'Potential match' else 'Strong match' end as category,
            count(*) as n from predicted_rows group by all"""),
}
