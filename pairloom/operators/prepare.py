"""Cleaning, labelling, identifying, de-duplicating and validating labelled pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom import fixed_values as fv
from pairloom.functions import text as tx
from pairloom.functions.shape import as_rows

REQUIRED_COLUMNS = ["candidate", "posting", "label", "label_id", "candidate_id", "posting_id", "candidate_group"]
RAW_NAMES = {"resume_text": "candidate", "job_description_text": "posting", "label": "label"}


def select_renamed(raw: DataFrame, names: dict[str, str] = RAW_NAMES, keep: Sequence[str] = ("original_split",)) -> DataFrame:
    kept = [c for c in keep if c in raw.columns]
    return raw.select(*[F.col(old).alias(new) for old, new in names.items()], *kept)


def clean_pairs(raw: DataFrame) -> DataFrame:
    """Clean text and label, content ids, ordinal label; empty texts are only flagged."""
    clean = raw.withColumns({"candidate": tx.clean_text(F.col("candidate")), "posting": tx.clean_text(F.col("posting")),
                             "label": tx.canonical_label(F.col("label"))})
    return clean.withColumns({
        "is_empty": (F.col("candidate") == "") | (F.col("posting") == ""),
        "candidate_id": tx.content_id(F.col("candidate")), "posting_id": tx.content_id(F.col("posting")),
        "label_id": tx.label_id(F.col("label"))})


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in the given order: a partial aggregate, so copies of one row never pile up in a task."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("_first")).select(*keys, "_first.*").select(*df.columns)


def settle_pairs(df: DataFrame, keys: Sequence[str], label: str, order: Sequence[Column]) -> DataFrame:
    """One row per (keys): n_rows, n_labels, and the first row's other columns.

    n_labels > 1 marks a pair with conflicting labels; n_rows above n_labels are exact duplicates.  One shuffle, after a partial aggregate.
    """
    rest = [c for c in df.columns if c not in keys]
    labels = F.size(F.collect_set(label)) + F.max(F.col(label).isNull().cast("int"))  # a handful of a pair
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), labels.cast("long").alias("n_labels"), F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    ).select(*keys, "n_rows", "n_labels", "_first.*").select(*df.columns, "n_rows", "n_labels")


def without_conflicts(settled: DataFrame) -> DataFrame:
    return settled.where(F.col("n_labels") == 1).drop("n_rows", "n_labels")


def drop_report(flagged: DataFrame, settled: DataFrame) -> DataFrame:
    """(metric, value): raw rows, rows dropped by cause, rows kept; from the cleaned rows and the settled pairs."""
    raw = flagged.agg(F.count("*").alias("raw_rows"), F.count_if("is_empty").alias("dropped_empty"))
    pairs = settled.agg(
        F.sum(F.col("n_rows") - F.col("n_labels")).alias("dropped_exact_duplicates"),
        F.sum(F.when(F.col("n_labels") > 1, F.col("n_labels")).otherwise(0)).alias("dropped_conflicting_pairs"),
        F.count_if(F.col("n_labels") == 1).alias("rows"))
    return as_rows(raw).unionByName(as_rows(pairs))


def id_report(pairs: DataFrame, candidate: str = "candidate_id", posting: str = "posting_id",
              group: str = "candidate_group") -> DataFrame:
    """(metric, value): distinct ids, ids used more than once, groups and merged near-duplicates."""
    def uses(column, name):
        per = pairs.groupBy(column).count()
        return as_rows(per.agg(F.count("*").alias(f"unique_{name}"),
                               F.count_if(F.col("count") > 1).alias(f"{name}_in_multiple_pairs")))
    members = pairs.groupBy(group).agg(F.count_distinct(candidate).alias("n"))
    groups = as_rows(members.agg(F.count("*").alias("candidate_groups"),
                                 (F.sum("n") - F.count("*")).alias("near_duplicates_merged")))
    return uses(candidate, "candidates").unionByName(uses(posting, "postings")).unionByName(groups)


def label_counts(pairs: DataFrame, label: str = "label") -> DataFrame:
    return pairs.groupBy(label).agg(F.count("*").alias("n"))


def frame_profile(df: DataFrame) -> DataFrame:
    """One row per column: name, type, NULL count, rows."""
    types = dict(df.dtypes)
    counts = df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    entries = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(types[c]).alias("data_type"),
                                 F.col(c).alias("nulls")) for c in df.columns])
    return counts.select("rows", F.explode(entries).alias("e")).select("e.*", "rows")


def violations(pairs: DataFrame, labels: Sequence[str] = fv.LABELS) -> DataFrame:
    """rule -> number of violating rows (for the key rule: surplus rows)."""
    missing = sorted(set(REQUIRED_COLUMNS) - set(pairs.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    nulls = F.lit(False)
    for c in REQUIRED_COLUMNS:
        nulls = nulls | F.col(c).isNull()
    rules = pairs.agg(
        F.count_if(nulls).alias("null_values"),
        F.count_if((F.length("candidate") == 0) | (F.length("posting") == 0)).alias("empty_text"),
        F.count_if(~F.col("label").isin(*labels)).alias("unknown_label"),
        F.count_if(F.array_position(F.array(*map(F.lit, labels)), F.col("label")) - 1 != F.col("label_id")).alias("label_id_mismatch"))
    keys = pairs.groupBy("candidate_id", "posting_id").count().agg(
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_pair"))
    return as_rows(rules, "rule", "violations").unionByName(as_rows(keys, "rule", "violations"))


def validate(pairs: DataFrame) -> DataFrame:
    """The pairs themselves; raises if any invariant is broken."""
    broken = violations(pairs).where(F.col("violations") > 0).collect()  # at most five rows
    if broken:
        raise ValueError("invalid pairs: " + ", ".join(f"{r['rule']}={r['violations']}" for r in broken))
    return pairs


def quality_gates(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Mark every row with the reasons it is rejected for; an empty list means valid.

    rules maps a reason to the condition under which a row is bad.
    """
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules.items()]))
    return df.withColumn("reasons", reasons).withColumn("is_valid", F.size("reasons") == 0)


def document_rules(text: str = "text", low: int = 30, high: int = 60_000) -> dict[str, Column]:
    return {"blank": ~F.col(text).rlike(r"(?U)\S"), "too_short": F.length(text) < low, "too_long": F.length(text) > high}


def intake_rules() -> dict[str, Column]:
    """Gates of an application intake table."""
    return {"company_missing": F.length(F.coalesce("company", F.lit(""))) < 1,
            "position_missing": F.length(F.coalesce("position", F.lit(""))) < 1,
            "unknown_status": ~F.coalesce("status", F.lit("saved")).isin(*fv.STATUSES),
            "score_out_of_range": F.coalesce(~F.col("match_score").between(0, 100), F.lit(False))}


def original_split_leakage(pairs: DataFrame, split: str = "original_split") -> DataFrame:
    """How many test candidates of the original split also occur in its train part."""
    sides = pairs.groupBy("candidate_id").agg(F.bool_or(F.col(split) == "test").alias("in_test"),
                                              F.bool_or(F.col(split) == "train").alias("in_train"))
    both = F.count_if(F.col("in_test") & F.col("in_train"))
    test = F.count_if("in_test")
    return sides.agg(test.alias("original_test_candidates"), both.alias("also_in_original_train"),
                     F.coalesce(F.bround(F.try_divide(both, test), 4), F.lit(0.0)).alias("share"))
