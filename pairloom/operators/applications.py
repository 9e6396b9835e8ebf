"""Application tables as folds of an event log, and the dashboard over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom import fixed_values as fv
from pairloom.functions.numbers import half_up
from pairloom.functions.ordering import rank_in_group

CREATED_NOTE = "Application record created"


def create_applications(intake: DataFrame, now: Column, note: str = CREATED_NOTE) -> DataFrame:
    """Intake rows with their defaults, first timeline entry and applied date."""
    status = F.coalesce("status", F.lit("saved"))
    today = F.date_format(now, "yyyy-MM-dd")
    return intake.withColumns({
        "location": F.coalesce(F.nullif(F.col("location"), F.lit("")), F.lit("Remote")), "status": status, "notes": F.coalesce("notes", F.lit("")),
        "applied_date": F.when(status == "applied", today),
        "timeline": F.array(F.struct(today.alias("date"), status.alias("stage"), F.lit(note).alias("note"))),
        "created_at": now, "updated_at": now})


def creation_activities(applications: DataFrame) -> DataFrame:
    title = F.concat(F.lit("Created application for "), F.col("position"), F.lit(" at "), F.col("company"))
    return applications.select("user_id", F.lit("application_updated").alias("type"), title.alias("title"), F.col("created_at"))


def application_state(events: DataFrame, key: str = "application_id", at: str = "ts", tie: str = "event_id", stage: str = "stage") -> DataFrame:
    """(key, status, applied_at, n_changes, updated_at): the latest stage and the first application.

    Partial aggregates only: late and unordered events need no sort, and a busy application is combined before it moves.
    """
    return events.groupBy(key).agg(
        F.max_by(stage, F.struct(at, tie)).alias("status"), F.min(F.when(F.col(stage) == "applied", F.col(at))).alias("applied_at"),
        F.count("*").alias("n_changes"), F.max(at).alias("updated_at"))


def timeline(events: DataFrame, key: str = "application_id", at: str = "ts", tie: str = "event_id", stage: str = "stage",
             note: str = "note") -> DataFrame:
    """(key, seq, date, stage, note) in event order: one row per entry, so no application's history is gathered in a row."""
    numbered = rank_in_group(events, [key], [F.col(at), F.col(tie)], rank="seq")
    default = F.concat(F.lit("Stage moved to "), F.col(stage))
    return numbered.select(key, "seq", F.date_format(at, "yyyy-MM-dd").alias("date"), F.col(stage).alias("stage"),
                           F.coalesce(F.nullif(F.col(note), F.lit("")), default).alias("note"))


def change_status(applications: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply a batch of changes (application_id, change_id, status, at): the latest wins the status, the first application
    sets the applied date once.

    Only aggregates of the changes meet the applications, however many there are of one application; the timeline is a
    table of its own, to which timeline() of the changes is appended.
    """
    state = application_state(changes, at="at", tie="change_id", stage="status")
    return _with_state(applications, state)


def _with_state(applications: DataFrame, state: DataFrame) -> DataFrame:
    new = state.select("application_id", F.col("status").alias("_status"), F.date_format("applied_at", "yyyy-MM-dd").alias("_applied"),
                       F.col("updated_at").alias("_at"), "n_changes")
    return applications.join(new, "application_id", "left").withColumns({
        "applied_date": F.coalesce("applied_date", "_applied"), "status": F.coalesce("_status", "status"),
        "updated_at": F.coalesce("_at", "updated_at"), "n_changes": F.coalesce("n_changes", F.lit(0)).cast("long")}).drop("_status", "_applied", "_at")


def status_counts(applications: DataFrame, status: str = "status", stages: Sequence[str] = fv.STATUSES) -> DataFrame:
    """(status, n) for every stage in order, empty ones included."""
    spark = applications.sparkSession
    listed = spark.createDataFrame([(s, i) for i, s in enumerate(stages)], "status string, position int")
    counts = applications.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))
    return listed.join(counts, "status", "left").select("status", "position", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def dashboard(resumes: DataFrame, jobs: DataFrame, matches: DataFrame, applications: DataFrame, user: str = "user_id",
              score: str = "overall_score") -> DataFrame:
    """Per user: resumes, jobs, active applications, interviews, offers; over all users: matches and their mean score."""
    count = lambda df, name: df.groupBy(user).agg(F.count("*").alias(name))
    status = F.col("status")
    apps = applications.groupBy(user).agg(
        F.count_if(status != "rejected").alias("active_applications"),
        F.count_if(status.isin("screening", "interviewing")).alias("interviews"), F.count_if(status == "offer").alias("offers"))
    overall = matches.agg(F.count("*").alias("n"), F.avg(score).alias("mean"))
    joined = count(resumes, "total_resumes").join(count(jobs, "total_jobs"), user, "full").join(apps, user, "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return joined.select(user, *[zero(c) for c in ("total_resumes", "total_jobs", "active_applications", "interviews", "offers")],
                         overall.select("n").scalar().alias("total_matches"),
                         F.coalesce(half_up(overall.select("mean").scalar()), F.lit(82)).cast("long").alias("average_match_score"))


def latest(df: DataFrame, keys: Sequence[str], at: str, tie: str, n: int = 6) -> DataFrame:
    """The n newest rows per key; at most n per task are shuffled."""
    window = Window.partitionBy(*keys).orderBy(F.desc(at), F.desc(tie))
    return df.withColumn("position", F.row_number().over(window)).where(F.col("position") <= n)


def newest_first(df: DataFrame, predicate: Column, at: str, tie: str) -> DataFrame:
    return df.where(predicate).orderBy(F.desc(at), F.desc(tie))
