"""Leakage-safe splits: whole groups go to one side; folds are label-balanced; overlap is checked."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom import fixed_values as fv
from pairloom.functions.ordering import rank_in_group
from pairloom.functions.text import collapse_spaces

SPLITS = ["train", "validation", "test"]


def seeded_draw(seed: int, *columns: str):
    """A reproducible pseudo-random string per key."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in columns]))


def assign_groups(groups: DataFrame, group: str, seed: int = fv.SEED,
                  ratios: dict[str, float] = fv.SPLIT_RATIOS) -> DataFrame:
    """(group, split): groups in seeded order, cut so that test and validation hold their share, rounded up, of the groups."""
    drawn = groups.select(group).distinct().withColumn("_draw", seeded_draw(seed, group)).withColumn("_all", F.lit(1))
    placed = rank_in_group(drawn, ["_all"], [F.col("_draw"), F.col(group)], rank="_place")
    n = drawn.agg(F.count("*").alias("n")).scalar()
    test = F.ceil(n * F.lit(ratios["test"]))
    held = F.ceil(n * F.lit(ratios["test"] + ratios["validation"]))
    return placed.select(group, F.when(F.col("_place") <= test, "test").when(F.col("_place") <= held, "validation")
                         .otherwise("train").alias("split"))


def grouped_split(pairs: DataFrame, group: str = "candidate_group", seed: int = fv.SEED) -> DataFrame:
    return pairs.join(assign_groups(pairs, group, seed), group)


def split_summary(pairs: DataFrame, candidate: str = "candidate_id", group: str = "candidate_group",
                  posting: str = "posting_id", split: str = "split") -> DataFrame:
    """Rows, distinct ids and label counts per split."""
    return pairs.groupBy(split).agg(
        F.count("*").alias("n_rows"), F.count_distinct(candidate).alias("unique_candidates"),
        F.count_distinct(group).alias("unique_groups"), F.count_distinct(posting).alias("unique_postings"),
        *[F.sum((F.col("label_id") == i).cast("long")).alias(f"label_{i}") for i in range(3)])


def ranking_groups(pairs: DataFrame, posting: str = "posting_id", split: str = "split") -> DataFrame:
    """Postings per split that can be ranked: two or more candidates and two or more labels."""
    per = pairs.groupBy(split, posting).agg(F.count("*").alias("n"), F.min("label_id").alias("lo"), F.max("label_id").alias("hi"))
    return per.groupBy(split).agg(F.count_if((F.col("n") >= 2) & (F.col("lo") < F.col("hi"))).alias("ranking_groups"))


def key_overlaps(pairs: DataFrame, keys: Sequence[str], split: str = "split", names: Sequence[str] = SPLITS) -> DataFrame:
    """(key, split_a, split_b, overlap): distinct key values two splits share.

    One pass: every (key, value) gets one flag per split; no set is built and splits are not joined to each other.
    """
    values = pairs.select(split, F.explode(F.array(*[
        F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])).alias("e"))
    seen = values.groupBy("e.key", "e.value").agg(*[F.max((F.col(split) == s).cast("int")).alias(s) for s in names])
    sides = list(combinations(names, 2))
    counts = seen.groupBy("key").agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}/{b}") for a, b in sides])
    entries = F.array(*[F.struct(F.lit(a).alias("split_a"), F.lit(b).alias("split_b"),
                                 F.col(f"{a}/{b}").cast("long").alias("overlap")) for a, b in sides])
    return counts.select("key", F.explode(entries).alias("e")).select("key", "e.*")


def leakage_report(pairs: DataFrame, candidate_keys: Sequence[str] = ("candidate_id", "candidate_group"),
                   posting: str = "posting_id", split: str = "split") -> DataFrame:
    """Overlaps with a verdict per key: sharing a candidate is leakage, sharing a posting is allowed."""
    found = key_overlaps(pairs, [*candidate_keys, posting], split)
    return found.withColumn("leaks", (F.col("key") != posting) & (F.col("overlap") > 0))


def require_no_leakage(report: DataFrame) -> None:
    leaks = report.where("leaks").select("key", "split_a", "split_b").collect()  # a handful of key/split pairs
    if leaks:
        raise ValueError(f"candidates shared between splits: {[tuple(r) for r in leaks]}")


def normalised_text_key(text: str):
    return F.sha2(collapse_spaces(F.lower(F.col(text))), 256)


def stratified_group_folds(pairs: DataFrame, group: str = "candidate_group", n_folds: int = 20, seed: int = fv.SEED) -> DataFrame:
    """(group, fold): whole groups dealt over the folds so that labels and sizes balance.

    Groups are ordered by their commonest label, size and a seeded draw, and dealt back and forth, so that each run of
    2 * n_folds neighbours gives every fold two groups of near-equal weight.
    """
    labels = pairs.groupBy(group, "label_id").agg(F.count("*").alias("n"))
    groups = labels.groupBy(group).agg(
        F.sum("n").alias("size"), F.max_by("label_id", F.struct("n", "label_id")).alias("main_label"))
    groups = groups.withColumn("_draw", seeded_draw(seed, group)).withColumn("_all", F.lit(1))
    order = [F.col("main_label"), F.col("size").desc(), F.col("_draw"), F.col(group)]
    placed = rank_in_group(groups, ["_all"], order, rank="_place")
    turn = F.pmod(F.col("_place") - 1, F.lit(2 * n_folds))
    return placed.select(group, F.when(turn < n_folds, turn).otherwise(2 * n_folds - 1 - turn).cast("int").alias("fold"))


def rotate_repetitions(folds: DataFrame, repetitions: int = 5, n_folds: int = 20, test_folds: int = 3,
                       validation_folds: int = 3) -> DataFrame:
    """Each row once per repetition with its split: test folds move on, validation is the next block, the rest trains."""
    spread = folds.withColumn("repetition", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))))
    offset = F.pmod(F.col("fold") - test_folds * F.col("repetition"), F.lit(n_folds))
    return spread.withColumn("split", F.when(offset < test_folds, "test")
                             .when(offset < test_folds + validation_folds, "validation").otherwise("train"))


def fold_balance(pairs: DataFrame, folds: DataFrame, group: str = "candidate_group") -> DataFrame:
    """Rows and label counts per fold."""
    return pairs.join(folds, group).groupBy("fold").agg(
        F.count("*").alias("n_rows"), F.count_distinct(group).alias("n_groups"),
        *[F.sum((F.col("label_id") == i).cast("long")).alias(f"label_{i}") for i in range(3)])
