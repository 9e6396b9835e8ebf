"""Ranking evaluation: one posting and its candidates form a query; candidates are ordered by score, then id."""

from __future__ import annotations

from collections.abc import Sequence
from math import log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom import fixed_values as fv
from pairloom.functions.binding import let
from pairloom.functions.joins import SMALL_ROWS
from pairloom.functions.numbers import harmonic
from pairloom.functions.ordering import largest_group, rank_in_group
from pairloom.session import written

POSTING, CANDIDATE, LABEL = "posting_id", "candidate_id", "label_id"
#: Candidates of a posting that lie in one row, and draws a task makes.
ROW_CANDIDATES, TASK_DRAWS = 20_000, 1_000_000


def ranked_candidates(pairs: DataFrame, score: str = "score", by: Sequence[str] = (),
                      totals: dict[str, Column] | None = None, at_most: int | None = None) -> DataFrame:
    order = [F.col(score).desc_nulls_last(), F.col(CANDIDATE).asc()]
    return rank_in_group(pairs, [*by, POSTING], order, totals, at_most=at_most)


def discounted_gain(relevance: Column, rank: Column, k: int) -> Column:
    return F.sum(F.when(rank <= k, relevance / F.log2(rank + 1)).otherwise(0.0))


def ideal_gain(counts: dict[int, Column], k: int) -> Column:
    """Best possible gain in the first k places, from the number of candidates at each grade (no second sort)."""
    discounts = [1 / log2(i + 1) for i in range(1, k + 1)]
    heads = F.array(*[F.lit(sum(discounts[:i])) for i in range(k + 1)])
    total, used = F.lit(0.0), F.lit(0)
    for grade in sorted(counts, reverse=True):
        upto = used + counts[grade]
        place = lambda n: F.element_at(heads, (F.least(n, F.lit(k)) + 1).cast("int"))
        total = total + F.lit(float(grade)) * (place(upto) - place(used))
        used = upto
    return total


def _metrics_of(stats: DataFrame, keys: Sequence[str], grades: Sequence[int]) -> DataFrame:
    """The columns of posting_metrics from what was summed up of each ranked posting."""
    excluded = (F.when(F.col("n_candidates") < 2, "single_candidate")
                .when(F.col("low_label") == F.col("high_label"), "single_label"))
    eligible = excluded.isNull()
    binary = eligible & (F.col("n_relevant") > 0) & (F.col("n_relevant") < F.col("n_candidates"))
    counts = {g: F.col(f"grade_{g}") for g in grades}
    ndcg = {f"ndcg_{k}": F.when(eligible, F.coalesce(F.try_divide(F.col(f"dcg_{k}"), ideal_gain(counts, k)), F.lit(0.0)))
            for k in (5, 10)}
    return stats.select(
        *keys, "n_candidates", "n_relevant", excluded.alias("excluded"),
        *[c.alias(n) for n, c in ndcg.items()],
        F.when(binary, 1 / F.col("first_hit")).alias("mrr"),
        F.when(binary, F.col("average_precision")).alias("map"),
        *[F.when(binary, F.col(f"precision_{k}")).alias(f"p_{k}") for k in (1, 5)])


def posting_metrics(pairs: DataFrame, score: str = "score", by: Sequence[str] = (),
                    grades: Sequence[int] = (1, 2), at_most: int | None = None) -> DataFrame:
    """One row per posting: eligibility and ndcg_5/10, mrr, map, p_1, p_5.  at_most is a known bound on a posting's candidates.

    excluded is single_candidate, single_label or NULL.  The binary metrics are NULL where every ordering would score
    the same (all or no candidates relevant).  One ranking and one partial aggregation on the same key.
    """
    keys = [*by, POSTING]
    relevant = (F.col(LABEL) > 0).cast("int")
    ranked = ranked_candidates(pairs.select(*keys, CANDIDATE, LABEL, score), score, by, {"hits": relevant}, at_most)
    rank, label, hit = F.col("rank"), F.col(LABEL), F.col(LABEL) > 0
    stats = ranked.groupBy(*keys).agg(
        F.count("*").alias("n_candidates"),
        F.min(LABEL).alias("low_label"), F.max(LABEL).alias("high_label"),
        F.sum(hit.cast("int")).alias("n_relevant"),
        *[F.sum((label == g).cast("int")).alias(f"grade_{g}") for g in grades],
        *[discounted_gain(label, rank, k).alias(f"dcg_{k}") for k in (5, 10)],
        F.min(F.when(hit, rank)).alias("first_hit"),
        F.avg(F.when(hit, F.col("hits") / rank)).alias("average_precision"),
        *[F.avg(F.when(rank <= k, hit.cast("int"))).alias(f"precision_{k}") for k in (1, 5)])
    return _metrics_of(stats, keys, grades)


def ranking_summary(per_posting: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Macro means over postings (missing ones skipped) and counts by cause of exclusion."""
    eligible = F.col("excluded").isNull()
    return per_posting.groupBy(*by).agg(
        F.count("*").alias("jobs_total"),
        F.count_if(eligible).alias("jobs_eligible"),
        F.count_if(F.col("excluded") == "single_candidate").alias("excluded_single_candidate"),
        F.count_if(F.col("excluded") == "single_label").alias("excluded_single_label"),
        F.count_if(F.col("mrr").isNotNull()).alias("jobs_binary_eligible"),
        F.count_if(eligible & F.col("mrr").isNull()).alias("jobs_binary_trivial"),
        *[F.avg(m).alias(m) for m in fv.RANKING_METRICS])


def top_candidate(pairs: DataFrame, score: str, by: Sequence[str] = (), carry: Sequence[str] = ()) -> DataFrame:
    """The first-ranked candidate per posting with the columns to carry: a partial aggregate, no sort."""
    best = F.min_by(F.struct(CANDIDATE, score, *carry), F.struct((-F.col(score)).alias("s"), F.col(CANDIDATE)))
    return pairs.groupBy(*by, POSTING).agg(best.alias("top")).select(*by, POSTING, "top.*")


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group; Spark keeps at most n per task before the shuffle."""
    numbered = df.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.where(F.col("position") <= n)


def mean_rank(pairs: DataFrame, score: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank by descending score where tied candidates share the mean of their places."""
    ranked = ranked_candidates(pairs, score, by).withColumnRenamed("rank", "_place")
    ties = ranked.groupBy(*by, POSTING, score).agg(F.min("_place").alias("_lo"), F.max("_place").alias("_hi"))
    return (ranked.drop("_place").join(ties, [*by, POSTING, score])
            .withColumn(name, (F.col("_lo") + F.col("_hi")) / 2).drop("_lo", "_hi"))


def random_order_metrics(pairs: DataFrame, n_shuffles: int = 200, seed: int = fv.SEED, row_candidates: int = ROW_CANDIDATES) -> DataFrame:
    """Mean metrics over seeded random orderings: what a model without signal would score.

    A posting is one row: its orders are drawn, sorted and judged there, one after the other, so nothing is multiplied on disk.  Only postings
    of more candidates than a row should hold are multiplied by the orders and ranked by rank_in_group.
    """
    slim = written(pairs.select(POSTING, CANDIDATE, LABEL))
    rows, at_most = slim.count(), largest_group(slim, [POSTING])
    if at_most <= row_candidates:
        per = _metrics_of_orders(slim, rows, n_shuffles, seed)
    else:
        sizes = slim.groupBy(POSTING).agg(F.count("*").alias("_n")).where(F.col("_n") > row_candidates)
        large = F.broadcast(sizes.select(F.col(POSTING).alias("_large"))) if sizes.count() <= SMALL_ROWS else sizes.select(F.col(POSTING).alias("_large"))
        of = lambda how: slim.join(large, F.col(POSTING).eqNullSafe(F.col("_large")), how)
        draw = F.md5(F.concat_ws(":", F.lit(seed), F.col("shuffle"), F.col(POSTING), F.col(CANDIDATE)))
        shuffled = of("left_semi").withColumn("shuffle", F.explode(F.sequence(F.lit(1), F.lit(n_shuffles)))).withColumn("draw", draw)
        per = _metrics_of_orders(of("left_anti"), rows, n_shuffles, seed).unionByName(
            posting_metrics(shuffled, "draw", ["shuffle"], at_most=at_most))
    return ranking_summary(per, ["shuffle"]).agg(F.count("*").alias("n_shuffles"), *[F.avg(m).alias(m) for m in fv.RANKING_METRICS])


def _metrics_of_orders(pairs: DataFrame, rows: int, n_shuffles: int, seed: int, grades: Sequence[int] = (1, 2)) -> DataFrame:
    """posting_metrics by shuffle of the drawn orders, with each posting's candidates in one row."""
    parts = max(pairs.sparkSession.sparkContext.defaultParallelism, -(-rows * n_shuffles // TASK_DRAWS))
    label, hit = F.col(LABEL), F.col(LABEL) > 0
    # What is drawn of a candidate and what it counts for are told by one text: 32 digits of the draw, whether it is relevant, its label.
    flag = F.when(hit, "1").when(~hit, "0").otherwise("-")
    own = F.struct(F.coalesce(F.concat(F.lit(":"), F.col(CANDIDATE).cast("string")), F.lit("")).alias("key"),
                   F.concat(flag, F.coalesce(label.cast("string"), F.lit(""))).alias("worth"))
    postings = pairs.repartition(parts, POSTING).groupBy(POSTING).agg(
        F.collect_list(own).alias("_own"), F.count("*").alias("n_candidates"), F.min(LABEL).alias("low_label"), F.max(LABEL).alias("high_label"),
        F.sum(hit.cast("int")).alias("n_relevant"), *[F.sum((label == g).cast("int")).alias(f"grade_{g}") for g in grades])
    drawn = postings.withColumn("shuffle", F.explode(F.sequence(F.lit(1), F.lit(n_shuffles)))).withColumn(
        "_prefix", F.concat_ws(":", F.lit(seed), F.col("shuffle"), F.col(POSTING)))
    order = F.sort_array(F.transform("_own", lambda c: F.concat(F.md5(F.concat(F.col("_prefix"), c["key"])), c["worth"])), asc=False)
    kind = pairs.schema[LABEL].dataType
    is_hit = lambda x: F.substring(x, 33, 1) == "1"
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    gain = lambda s, k: total(F.transform(F.slice(s, 1, k), lambda x, i: F.coalesce(
        F.nullif(F.substring(x, 34, 40), F.lit("")).cast(kind) / F.log2(i + 2), F.lit(0.0))))
    share = lambda s, k: F.try_divide(F.size(F.filter(F.slice(s, 1, k), is_hit)),
                                      F.size(F.filter(F.slice(s, 1, k), lambda x: F.substring(x, 33, 1) != "-")))
    places = lambda s: F.array_compact(F.transform(s, lambda x, i: F.when(is_hit(x), i + 1)))
    judged = let(order, places, lambda s, p: F.struct(
        *[gain(s, k).alias(f"dcg_{k}") for k in (5, 10)], F.get(p, F.lit(0)).alias("first_hit"),
        F.try_divide(total(F.transform(p, lambda r, i: (i + 1) / r)), F.size(p)).alias("average_precision"),
        *[share(s, k).alias(f"precision_{k}") for k in (1, 5)]))
    stats = drawn.withColumn("_judged", judged).select("*", "_judged.*").drop("_own", "_prefix", "_judged")
    return _metrics_of(stats, ["shuffle", POSTING], grades)


def expected_random_posting_metrics(pairs: DataFrame, by: Sequence[str] = (), grades: Sequence[int] = (1, 2)) -> DataFrame:
    """What each posting scores on average over all orders of its candidates, in closed form from its label counts.

    With n candidates, R of them relevant, and H the harmonic numbers: the first hit's reciprocal rank is (H(n) - H(R-1)) R / (n-R+1); average
    precision is (H(n) + (R-1)/(n-1) (n - H(n))) / n, since a hit at rank r has (r-1)(R-1)/(n-1) others before it.  Metrics are NULL where
    posting_metrics has none.  One partial aggregation; no rows are multiplied, ranked or drawn.
    """
    keys = [*by, POSTING]
    label = F.col(LABEL)
    stats = pairs.groupBy(*keys).agg(
        F.count("*").alias("n_candidates"), F.min(label).alias("_lo"), F.max(label).alias("_hi"), F.avg(label).alias("_gain"),
        F.sum((label > 0).cast("int")).alias("n_relevant"), *[F.sum((label == g).cast("int")).alias(f"_{g}") for g in grades])
    n, r = F.col("n_candidates"), F.col("n_relevant")
    eligible = (n >= 2) & (F.col("_lo") < F.col("_hi"))
    binary = eligible & (r > 0) & (r < n)
    counts = {g: F.col(f"_{g}") for g in grades}

    def expected(k: int) -> Column:
        heads = F.array(*[F.lit(sum(1 / log2(i + 1) for i in range(1, j + 1))) for j in range(k + 1)])
        return F.col("_gain") * F.element_at(heads, (F.least(n, F.lit(k)) + 1).cast("int")) / ideal_gain(counts, k)

    reciprocal = (harmonic(n) - harmonic(r - 1)) * r / (n - r + 1)
    precision = (harmonic(n) + F.try_divide(r - 1, n - 1) * (n - harmonic(n))) / n
    return stats.select(
        *keys, "n_candidates", "n_relevant", *[F.when(eligible, expected(k)).alias(f"ndcg_{k}") for k in (5, 10)],
        F.when(binary, reciprocal).alias("mrr"), F.when(binary, precision).alias("map"), *[F.when(binary, r / n).alias(f"p_{k}") for k in (1, 5)])


def expected_random_metrics(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The reference of a model without signal: macro means of the expectations over postings."""
    return expected_random_posting_metrics(pairs, by).groupBy(*by).agg(
        F.count("ndcg_5").alias("jobs_eligible"), F.count("mrr").alias("jobs_binary_eligible"), *[F.avg(m).alias(m) for m in fv.RANKING_METRICS])
