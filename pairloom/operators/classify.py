"""Turning scores into ordinal classes: threshold search and classification metrics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom import fixed_values as fv
from pairloom.functions.joins import join_small
from pairloom.functions.numbers import digitize, ratio
from pairloom.functions.ordering import count_at_most, exact_quantiles, rank_in_group
from pairloom.session import cut_lineage, written

GRID = [float(q) for q in np.linspace(0.01, 0.99, 99)]
#: Percentages with one decimal.
SHARES = 1_001


def threshold_grid(scored: DataFrame, by: Sequence[str], score: str) -> DataFrame:
    """Distinct 1..99 % score quantiles per group, numbered from 1."""
    distinct = exact_quantiles(scored, by, score, GRID).select(*by, F.col("quantile").alias("threshold")).distinct()
    return distinct.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy("threshold")))


def _macro_f1(true: Sequence[Column], predicted: Sequence[Column], hit: Sequence[Column]) -> Column:
    """Mean of 2 TP / (true + predicted) over the classes that occur on either side."""
    total, classes = F.lit(0.0), F.lit(0)
    for t, p, h in zip(true, predicted, hit):
        total = total + F.coalesce(F.try_divide(2.0 * h, t + p), F.lit(0.0))
        classes = classes + ((t + p) > 0).cast("int")
    return total / classes


def fit_thresholds(scored: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "label_id",
                   stored: bool = False) -> DataFrame:
    """Two thresholds per group, from the quantile grid, with the best macro F1; the first best pair wins.  stored rows are a cheap read.

    The rows are counted once into (grid bin, label) cells; every threshold pair is then judged from prefix sums, so the
    search costs the same for a thousand rows and for a billion.  Groups with fewer than two grid points have no row.
    """
    by = list(by)
    keyed = scored.select(*by, score, label) if by else scored.select(score, label).withColumn("_all", F.lit(1))
    keyed = keyed if stored else written(keyed)  # read several times: for the grid, its size check and the bins
    keys = by or ["_all"]
    grid = threshold_grid(keyed, keys, score)
    grid = cut_lineage(grid)
    points = grid.groupBy(*keys).agg(F.sort_array(F.collect_list("threshold")).alias("points"))  # at most 99 a group
    binned = count_at_most(join_small(keyed, points, keys), "points", score, "bin", len(GRID))
    cells = binned.groupBy(*keys, "bin").agg(
        *[F.sum((F.col(label) == c).cast("long")).alias(f"c{c}") for c in range(3)])

    # Rows below grid point i are the rows of the bins 0 .. i-1.
    spine = grid.select(*keys, "i", "threshold").unionByName(
        points.select(*keys, F.lit(0).alias("i"), F.lit(None).cast("double").alias("threshold")))
    filled = spine.join(cells.withColumnRenamed("bin", "i"), [*keys, "i"], "left")
    upto = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*keys)
    sums = filled.select(
        *keys, "i", "threshold",
        *[F.coalesce(F.sum(F.coalesce(F.col(f"c{c}"), F.lit(0))).over(upto), F.lit(0)).alias(f"below{c}") for c in range(3)],
        *[F.sum(F.coalesce(F.col(f"c{c}"), F.lit(0))).over(everything).alias(f"all{c}") for c in range(3)],
    ).where(F.col("i") > 0)
    low, high = sums.alias("a"), sums.alias("b")
    pairs = low.join(high, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [F.col("a.i") < F.col("b.i")])
    a = [F.col(f"a.below{c}") for c in range(3)]
    b = [F.col(f"b.below{c}") for c in range(3)]
    all_ = [F.col(f"a.all{c}") for c in range(3)]
    count = lambda xs: xs[0] + xs[1] + xs[2]
    f1 = _macro_f1(all_, [count(a), count(b) - count(a), count(all_) - count(b)], [a[0], b[1] - a[1], all_[2] - b[2]])
    judged = pairs.select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col("a.i").alias("i"), F.col("b.i").alias("j"),
                          F.col("a.threshold").alias("t1"), F.col("b.threshold").alias("t2"), f1.alias("macro_f1"))
    best = F.min_by(F.struct("t1", "t2", "macro_f1"), F.struct((-F.col("macro_f1")).alias("f"), "i", "j"))
    return judged.groupBy(*keys).agg(best.alias("best")).select(*by, "best.*")


def classify(scored: DataFrame, thresholds: DataFrame, by: Sequence[str] = (), score: str = "score") -> DataFrame:
    """Predicted label id from the group's two thresholds (one row per group)."""
    keys = list(by) or ["_all"]
    limits = thresholds.select(*by, "t1", "t2")
    if not by:
        scored, limits = scored.withColumn("_all", F.lit(1)), limits.withColumn("_all", F.lit(1))
    joined = join_small(scored, limits, keys)
    return joined.withColumn("predicted_label_id", digitize(F.col(score), F.col("t1"), F.col("t2"))).drop(
        "t1", "t2", "_all")


def confusion(predicted: DataFrame, by: Sequence[str] = (), label: str = "label_id",
              prediction: str = "predicted_label_id") -> DataFrame:
    cells = [(t, p) for t in range(3) for p in range(3)]
    return predicted.groupBy(*by).agg(F.count("*").alias("n_rows"), *[
        F.count_if((F.col(label) == t) & (F.col(prediction) == p)).alias(f"n_{t}{p}") for t, p in cells])


def classification_metrics(predicted: DataFrame, by: Sequence[str] = (), label: str = "label_id",
                           prediction: str = "predicted_label_id") -> DataFrame:
    """Accuracy and macro precision, recall and F1 over the fixed labels 0..2 (0 where nothing is there to divide)."""
    m = confusion(predicted, by, label, prediction)
    n = lambda t, p: F.col(f"n_{t}{p}")
    true = [n(c, 0) + n(c, 1) + n(c, 2) for c in range(3)]
    called = [n(0, c) + n(1, c) + n(2, c) for c in range(3)]
    mean = lambda parts: (parts[0] + parts[1] + parts[2]) / 3
    return m.withColumns({
        "accuracy": (n(0, 0) + n(1, 1) + n(2, 2)) / F.col("n_rows"),
        "macro_precision": mean([ratio(n(c, c), called[c]) for c in range(3)]),
        "macro_recall": mean([ratio(n(c, c), true[c]) for c in range(3)]),
        "macro_f1": mean([ratio(2 * n(c, c), true[c] + called[c]) for c in range(3)]),
    })


def macro_f1(predicted: DataFrame, by: Sequence[str] = (), label: str = "label_id",
             prediction: str = "predicted_label_id") -> DataFrame:
    """Macro F1 over the labels that occur among labels or predictions."""
    m = confusion(predicted, by, label, prediction)
    n = lambda t, p: F.col(f"n_{t}{p}")
    f1 = _macro_f1([n(c, 0) + n(c, 1) + n(c, 2) for c in range(3)], [n(0, c) + n(1, c) + n(2, c) for c in range(3)],
                   [n(c, c) for c in range(3)])
    return m.select(*by, f1.alias("macro_f1"))


def majority_reference(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """What always answering label 0 would score."""
    return classification_metrics(pairs.withColumn("predicted_label_id", F.lit(0)), by)


def score_percentile(scored: DataFrame, reference: DataFrame, by: Sequence[str] = (), score: str = "score") -> DataFrame:
    """Share of reference scores strictly below each score, in percent with one decimal.  Both sides are read once, scored once more.

    Distinct scores of both sides are ranked together.  The share grows with the score and has at most 1,001 values, so the lowest score of each
    value answers every row where it lies: rows are neither shuffled nor compared with the reference.
    """
    keys = list(by) or ["_all"]
    if not by:
        scored, reference = scored.withColumn("_all", F.lit(1)), reference.withColumn("_all", F.lit(1))
    one = lambda df, weight: df.select(*keys, score, F.lit(weight).cast("long").alias("weight"))
    points = written(one(reference, 1).unionByName(one(scored, 0)).groupBy(*keys, score).agg(F.sum("weight").alias("weight")))
    running = rank_in_group(points, keys, [F.col(score).asc()], {"upto": F.col("weight")})
    totals = points.groupBy(*keys).agg(F.sum("weight").alias("total")).where("total > 0")
    below = join_small(running, totals, keys).select(
        *keys, score, F.bround(100.0 * (F.col("upto") - F.col("weight")) / F.col("total"), 1).alias("percentile"))
    steps = below.where(F.col(score).isNotNull()).groupBy(*keys, "percentile").agg(F.min(score).alias("_from"))
    steps = steps.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_from", "percentile"))).alias("_s")).select(
        *keys, F.transform("_s", lambda x: x["_from"]).alias("_points"), F.transform("_s", lambda x: x["percentile"]).alias("_shares"))
    placed = count_at_most(join_small(scored, steps, keys, "left"), "_points", score, "_at", SHARES)
    return placed.withColumn("percentile", F.get("_shares", F.col("_at") - 1)).drop("_points", "_shares", "_at", "_all")


def match_category(predicted: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, fv.CATEGORIES)), predicted.cast("int") + 1)
