"""Run log in batch: status, stale runs, queue, active jobs, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import stable_id
from ..functions.vocab import ACTIVE_STATUSES
from .ranking import first_per_key, ordinal


def with_event_id(events: DataFrame) -> DataFrame:
    """Id of (run, type, message, second); a repeat within the second is the same event."""
    second = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss")
    return events.withColumn("event_id", stable_id("RE", "run_id", "event_type", "message", second))


def distinct_events(events: DataFrame) -> DataFrame:
    return first_per_key(with_event_id(events), ["event_id"], [F.asc("created_at"), F.asc("seq")])


def run_status(events: DataFrame) -> DataFrame:
    """Status after the last update of every run."""
    return events.groupBy("run_id").agg(
        F.max_by("status", F.struct("updated_at", "seq")).alias("status"),
        F.max("updated_at").alias("updated_at"),
        F.count(F.lit(1)).alias("n_updates"),
    )


def stale_runs(status: DataFrame, now: Column, stale_seconds: int) -> DataFrame:
    """Running runs without an update for too long become ``partial_error``; their records are kept."""
    old = F.unix_micros("updated_at") < F.unix_micros(now) - stale_seconds * 1_000_000
    stale = (F.col("status") == "running") & old
    return status.withColumn("recovered", stale).withColumn("status", F.when(stale, "partial_error").otherwise(F.col("status")))


def queue_positions(jobs: DataFrame) -> DataFrame:
    """Place of every still-queued job in order of arrival."""
    return ordinal(jobs.filter("status = 'queued'"), [], ["seq", "run_id"], "queue_position")


def active_jobs(requests: DataFrame) -> DataFrame:
    """One active job per (work, project): every request is answered by the first active one."""
    active = requests.filter(F.col("status").isin(ACTIVE_STATUSES))
    first = active.groupBy("work_id", "project_id").agg(F.min_by("run_id", F.struct("seq", "run_id")).alias("active_run_id"))
    return active.join(first, ["work_id", "project_id"]).withColumn("accepted", F.col("run_id") == F.col("active_run_id"))


def after_cancel(events: DataFrame) -> DataFrame:
    """Add ``rejected``: results that arrive after their run was cancelled."""
    cancelled = events.filter("status = 'cancelled'").groupBy("run_id").agg(F.min("seq").alias("_cancelled"))
    joined = events.join(cancelled, "run_id", "left")
    late = F.coalesce(F.col("seq") > F.col("_cancelled"), F.lit(False)) & (F.col("status") != "cancelled")
    return joined.withColumn("rejected", late).drop("_cancelled")


def progress(events: DataFrame) -> DataFrame:
    """Latest found / target per run and stage."""
    return events.groupBy("run_id", "stage").agg(
        F.max_by("found", "seq").alias("found"), F.max_by("target", "seq").alias("target")
    )


def complete_runs(runs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Set status, result and error of finished extraction runs; the last outcome wins."""
    last = first_per_key(outcomes, ["run_id"], [F.desc("seq")])
    new = last.select(
        "run_id", F.when(F.coalesce("error", F.lit("")) != "", "error").otherwise("complete").alias("_s"),
        F.col("result").alias("_r"), F.coalesce("error", F.lit("")).alias("_e"),
    )
    joined = runs.join(new, "run_id", "left")
    return (
        joined.withColumn("status", F.coalesce("_s", "status"))
        .withColumn("result", F.coalesce("_r", "result"))
        .withColumn("error", F.coalesce("_e", "error"))
        .drop("_s", "_r", "_e")
    )


def extraction_run_id() -> Column:
    """Cache key of one extraction: version, provider, model, prompt, schema and task."""
    return stable_id("XRUN", "version_id", "provider", "model", "prompt_version", "schema_version", "task_type")
