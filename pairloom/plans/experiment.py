"""Evaluation protocol, weight selection, ablation and repeated evaluation, each as one keyed plan.

Whatever is learned is learned on validation rows: thresholds, scaler bounds and the selected weights.  Several models,
configurations or repetitions are keys of one table, not passes over it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom import fixed_values as fv
from pairloom.functions.joins import join_small
from pairloom.functions.ordering import hot_rows
from pairloom.operators import classify as cl
from pairloom.operators import lexical, pair_features, ranking, split
from pairloom.session import cut_lineage, written

RANKING = fv.RANKING_METRICS
CLASSIFICATION = ["accuracy", "macro_f1"]
PAIR = ["posting_id", "candidate_id", "label_id"]
#: The name of random order among the models.
CHANCE = "random_ordering"


#: Pairs of a task that ranks them under several models or configurations.
TASK_PAIRS = 200_000


def by_posting(pairs: DataFrame, at_most: int | None, rows: int | None = None) -> DataFrame:
    """The pairs dealt by their posting, before they are multiplied by models: ranking inside a posting then shuffles nothing.

    at_most bounds a posting's rows; postings that are too large for one task, or not counted, are left to the ranking.  Rows that cost more
    than a read are not counted again where their number, or about that, is given.
    """
    parts = posting_parts(pairs, at_most, rows)
    return pairs if parts is None else pairs.repartition(parts, "posting_id")


def posting_parts(pairs: DataFrame, at_most: int | None, rows: int | None = None) -> int | None:
    """How many parts by_posting deals the pairs into; None where it leaves them as they are."""
    if at_most is None or at_most > hot_rows(pairs):
        return None
    tasks = -(-(pairs.count() if rows is None else rows) // TASK_PAIRS)
    return max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), tasks)


def evaluate(scored: DataFrame, thresholds: DataFrame, by: Sequence[str], dealt: DataFrame | None = None, at_most: int | None = None) -> DataFrame:
    """Ranking and classification metrics per group of by, with given thresholds (by, t1, t2).

    dealt may hold the same rows dealt by posting, with the bound at_most on a posting's rows.
    """
    ranked = ranking.ranking_summary(ranking.posting_metrics(scored if dealt is None else dealt, "score", by, at_most=at_most), by)
    judged = cl.classification_metrics(cl.classify(scored, thresholds, by), by)
    return ranked.join(judged.select(*by, "n_rows", "accuracy", "macro_precision", "macro_recall", "macro_f1"), list(by), "left")


def evaluate_models(wide: DataFrame, models: dict[str, str], at_most: int | None = None) -> DataFrame:
    """The models' metrics on written pairs with one score column a model, thresholds fitted on the same rows."""
    scored = scorers_long(wide, models)
    return evaluate(scored, cl.fit_thresholds(scored, ["model"], stored=True), ["model"], scorers_long(by_posting(wide, at_most), models), at_most)


def protocol(validation: DataFrame, test: DataFrame, by: Sequence[str] = ("model",), dealt: Sequence[DataFrame] = (None, None),
             at_most: int | None = None) -> DataFrame:
    """Fit thresholds on validation scores, freeze them, report both parts: (by, part, t1, t2, metrics); dealt as in evaluate."""
    thresholds = cut_lineage(cl.fit_thresholds(validation, by, stored=at_most is not None).select(*by, "t1", "t2"))
    parts = [evaluate(df, thresholds, by, d, at_most).withColumn("part", F.lit(name))
             for name, df, d in zip(("validation", "test"), (validation, test), dealt)]
    return join_small(parts[0].unionByName(parts[1]), thresholds, by)


def scorers_long(pairs: DataFrame, scores: dict[str, str]) -> DataFrame:
    """(model, pair, score) from one score column per model."""
    entries = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("score")) for m, c in scores.items()])
    rest = [c for c in pairs.columns if c not in scores.values()]
    return pairs.select(*rest, F.explode(entries).alias("_e")).select(*rest, "_e.*")


def run_scorers(pairs: DataFrame, scorers: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Apply each scorer (pairs -> pairs with a score) and stack the results under the model's name."""
    stacked = None
    for name, scorer in scorers.items():
        scored = scorer(pairs).select(*PAIR, F.col("score").cast("double").alias("score")).withColumn("model", F.lit(name))
        stacked = scored if stacked is None else stacked.unionByName(scored)
    return stacked


def compare_configurations(features: DataFrame, configurations: dict[str, Sequence[float]], bounds: dict[str, tuple],
                           at_most: int | None = None, digits: int | None = None) -> DataFrame:
    """Metrics of every configuration on the given (validation) rows, thresholds fitted per configuration; scores rounded where digits are given."""
    by = ["config_index", "configuration"]
    wide = written(pair_features.configuration_values(features, configurations, bounds, PAIR))
    score = F.col("score") if digits is None else F.round("score", digits)
    rows = lambda df: pair_features.configuration_rows(df, configurations, PAIR).withColumn("score", score)
    return evaluate(rows(wide), cl.fit_thresholds(rows(wide), by, stored=True), by, rows(by_posting(wide, at_most)), at_most)


def scaler_dict(bounds: DataFrame) -> dict[str, tuple[float, float]]:
    """Two components' bounds, on the driver."""
    return {r["component"]: (r["lo"], r["hi"]) for r in bounds.collect()}


def pick_best(comparison: DataFrame, metric: str = "ndcg_10", by: Sequence[str] = ()) -> DataFrame:
    """The configuration with the highest metric per group; the first listed on ties."""
    best = F.min_by(F.struct("configuration", "config_index", metric), F.struct((-F.col(metric)).alias("m"), "config_index"))
    return comparison.groupBy(*by).agg(best.alias("_b")).select(*by, "_b.*")


def select_weights(features: DataFrame, metric: str = "ndcg_10", at_most: int | None = None) -> tuple[str, dict, DataFrame, DataFrame]:
    """(selected configuration, scaler bounds, comparison, ablation) from validation features and labels only; features are read three times."""
    bounds = scaler_dict(pair_features.scaler_bounds(features))
    comparison = cut_lineage(compare_configurations(features, fv.WEIGHTINGS, bounds, at_most))
    selected = pick_best(comparison, metric).first()["configuration"]
    return selected, bounds, comparison, compare_configurations(features, pair_features.ablation_configurations(selected), bounds, at_most)


def with_chance(evaluated: DataFrame, chance: DataFrame | None) -> DataFrame:
    """The models' metrics and, where given, those of random order (a row of expected_random_metrics), which has no classes."""
    if chance is None:
        return evaluated
    row = chance.select(F.lit(CHANCE).alias("model"), *RANKING)
    return row.unionByName(evaluated.select("model", *[c for c in evaluated.columns if c in RANKING + CLASSIFICATION]), allowMissingColumns=True)


def model_comparison(evaluated: DataFrame, first: str, models: Sequence[str], chance: DataFrame | None = None) -> DataFrame:
    """Metrics per model with absolute and relative (percent) differences to the first model; random order, if given, has none.

    Refuses models that were evaluated on different populations, or on another one than random order.
    """
    same = ["jobs_eligible", "jobs_binary_eligible"]
    populations = evaluated.select(*same, "n_rows").distinct().limit(2).collect()
    expected = chance.select(*same).first() if chance is not None else None
    if len(populations) > 1 or (expected and populations and tuple(expected) != tuple(populations[0])[:2]):
        raise ValueError("models evaluated on different candidate groups")
    metrics = RANKING + CLASSIFICATION
    base = evaluated.where(F.col("model") == first)
    columns = []
    for m in metrics:
        delta = F.col(m) - base.select(m).scalar()
        compared = ~F.col("model").isin(first, CHANCE)
        columns += [F.when(compared, F.bround(delta, 6)).alias(f"delta_{m}"),
                    F.when(compared, F.bround(100 * F.try_divide(delta, base.select(m).scalar()), 2)).alias(f"rel_{m}_pct")]
    return with_chance(evaluated, chance).where(F.col("model").isin(CHANCE, *models)).select("model", *metrics, *columns)


def pairwise_deltas(evaluated: DataFrame, order: Sequence[str], metrics: Sequence[str] = tuple(RANKING), chance: DataFrame | None = None) -> DataFrame:
    """(comparison, deltas): every later model minus every earlier one, random order first where given; a handful of models."""
    order = list(order) if chance is None else [CHANCE, *order]
    position = F.array_position(F.array(*map(F.lit, order)), F.col("model"))
    placed = with_chance(evaluated, chance).select("model", position.alias("p"), F.lit(1).alias("k"), *metrics).where("p > 0")
    a, b = placed.alias("a"), placed.alias("b")
    return a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.p") < F.col("b.p"))).select(
        F.concat(F.col("b.model"), F.lit(" - "), F.col("a.model")).alias("comparison"),
        *[F.bround(F.col(f"b.{m}") - F.col(f"a.{m}"), 6).alias(m) for m in metrics])


def lexical_scores_by_repetition(pairs: DataFrame, candidates: DataFrame, postings: DataFrame) -> DataFrame:
    """TF-IDF scores of validation and test pairs, the vocabulary refitted on each repetition's training texts.

    pairs: (repetition, split, candidate_id, posting_id, ...); candidates and postings: (id, text).  The repetition is part
    of every key, so the five fits are one plan; term counts are made once and shared.
    """
    left_counts = lexical.term_counts(candidates, "candidate_id")
    right_counts = lexical.term_counts(postings, "posting_id")
    train = pairs.where(F.col("split") == "train")
    corpus = train.select("repetition", "candidate_id").distinct().join(candidates, "candidate_id").select("repetition", "text").unionByName(
        train.select("repetition", "posting_id").distinct().join(postings, "posting_id").select("repetition", "text"))
    vocabulary = lexical.fit_vocabulary(corpus, by=["repetition"])
    held = pairs.where(F.col("split") != "train")

    def weights(counts, id):
        needed = held.select("repetition", id).distinct().join(counts, id)
        return lexical.transform(needed, vocabulary, id, ["repetition"])

    return lexical.pair_scores(held, weights(left_counts, "candidate_id"), weights(right_counts, "posting_id"), by=["repetition"])


def repeated_evaluation(scored: DataFrame, dealt: DataFrame | None = None, at_most: int | None = None) -> DataFrame:
    """(repetition, model, metrics) on test rows with thresholds from the same repetition's validation rows.

    scored: (repetition, split, model, posting_id, candidate_id, label_id, score); dealt as in evaluate, which needs scored to be a cheap read.
    """
    by = ["repetition", "model"]
    thresholds = cl.fit_thresholds(scored.where(F.col("split") == "validation"), by, stored=dealt is not None)
    of = lambda df: df if df is None else df.where(F.col("split") == "test")
    return evaluate(of(scored), thresholds, by, of(dealt), at_most)


def repeated_selection(features: DataFrame, metric: str = "ndcg_10", at_most: int | None = None) -> DataFrame:
    """(repetition, selected configuration, metric) chosen on each repetition's validation rows, scaler refitted too.

    features: pair features with repetition, split and label; read twice.
    """
    validation = features.where(F.col("split") == "validation")
    bounds = pair_features.scaler_bounds(validation, ["repetition"])
    wide = bounds.groupBy("repetition").agg(*[
        F.max(F.when(F.col("component") == c, F.col(side))).alias(f"{side}_{c}")
        for c in ("semantic_similarity", "responsibility_similarity") for side in ("lo", "hi")])
    scaled = join_small(validation, wide, ["repetition"])
    columns = {c: (F.col(f"lo_{c}"), F.col(f"hi_{c}")) for c in ("semantic_similarity", "responsibility_similarity")}
    wide = pair_features.configuration_values(scaled, fv.WEIGHTINGS, columns, ["repetition", *PAIR])
    scored = pair_features.configuration_rows(by_posting(wide, at_most), fv.WEIGHTINGS, ["repetition", *PAIR])
    by = ["repetition", "config_index", "configuration"]
    per = ranking.ranking_summary(ranking.posting_metrics(scored, "score", by, at_most=at_most), by)
    return pick_best(per, metric, ["repetition"])


def repeated_splits(pairs: DataFrame, group: str = "candidate_group", n_folds: int = 20, repetitions: int = 5,
                    splits: Sequence[str] = tuple(split.SPLITS)) -> DataFrame:
    """The pairs once per repetition with their split.  Only the splits asked for are made, and only groups, not pairs, are multiplied before the join."""
    folds = split.rotate_repetitions(split.stratified_group_folds(pairs, group, n_folds), repetitions, n_folds).where(F.col("split").isin(*splits))
    turns = folds.groupBy(group).agg(F.first("fold").alias("fold"), F.collect_list(F.struct("repetition", "split")).alias("_turns"))
    joined = join_small(pairs, turns, [group])
    return joined.select(*[c for c in joined.columns if c != "_turns"], F.inline("_turns"))
