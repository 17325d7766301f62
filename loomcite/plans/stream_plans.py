"""The run log read as a stream in pieces that overlap in time, checked against the batch result."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from ..streaming.run_log import ROCKSDB, accepted_jobs, append_events, flag_late_results, job_runs, latest_status, recover_stale, running_progress, split_late
from ..streaming.sinks import drain, work_folder
from . import duck
from .project_plans import LAST, STALE_SECONDS, STATUS, TS, stamp
from .registry import query, table


#: Events land in pieces of six days; every seventh event comes with the piece after its own.
PIECES, PIECE_DAYS, FILES = 6, 6, 4
DELAY = 2 * 86400


def _arrivals(spark, sf_dir):
    """The events as a stream that takes one piece per micro-batch, in the order of arrival."""
    events = table(spark, sf_dir, "events")
    own = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) / PIECE_DAYS
    events = events.withColumn("_piece", F.floor(own) + F.when(F.col("event_id") % 7 == 0, 1).otherwise(0))
    folder = work_folder(spark, "arrivals")
    for k in range(PIECES):
        last = F.col("_piece") >= k if k == PIECES - 1 else F.col("_piece") == k
        events.filter(last).drop("_piece").repartition(FILES).write.mode("append").parquet(folder)
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).option("maxFilesPerTrigger", FILES).parquet(folder)


def _updates(spark, sf_dir):
    status = (
        F.when(F.col("event_type") == "signup", "queued")
        .when(F.col("event_type") == "purchase", "complete")
        .when(F.col("event_type") == "error", "error")
        .otherwise("running")
    )
    rows = _arrivals(spark, sf_dir)
    return rows.select(F.col("user_id").alias("run_id"), status.alias("status"), F.col("ts").cast("timestamp").alias("updated_at"), F.col("event_id").alias("seq"), "event_type", "value")


@contextmanager
def _stateful(spark):
    """The state store that timers need, for one stream; the session's own setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@query("stream_run_status", f"WITH {LAST} SELECT run_id, status, {TS.format('updated_at')} AS updated_at, n_updates FROM last")
def stream_run_status(spark, sf_dir):
    out = drain(latest_status(_updates(spark, sf_dir)), "update", ["run_id"])
    return out.withColumn("updated_at", stamp("updated_at"))


@query(
    "stream_run_progress",
    "SELECT user_id AS run_id, event_type AS stage, CAST(arg_max(value, event_id) AS BIGINT) AS found, arg_max(event_id % 200, event_id) AS target FROM events GROUP BY 1, 2",
)
def stream_run_progress(spark, sf_dir):
    rows = _updates(spark, sf_dir).select("run_id", F.col("event_type").alias("stage"), F.bround("value").cast("bigint").alias("found"), (F.col("seq") % 200).alias("target"), "seq")
    return drain(running_progress(rows), "update", ["run_id", "stage"])


@query(
    "stream_active_jobs",
    f"""WITH l AS (SELECT user_id // 4 AS work_id, user_id % 2 AS project_id, user_id * 8 + event_id % 8 AS run_id, arg_max({STATUS}, event_id) AS s, min(event_id) AS f, count(*) AS n FROM events GROUP BY 1, 2, 3)
SELECT work_id, project_id, arg_min(run_id, f) FILTER (s IN ('queued', 'running')) AS active_run_id, CAST(coalesce(sum(n) FILTER (s IN ('queued', 'running')), 0) AS BIGINT) AS n_requests FROM l GROUP BY 1, 2""",
)
def stream_active_jobs(spark, sf_dir):
    user = F.col("run_id")
    rows = _updates(spark, sf_dir).select((user * 8 + F.col("seq") % 8).alias("run_id"), F.expr("run_id div 4").alias("work_id"), (user % 2).alias("project_id"), "status", "seq")
    return accepted_jobs(drain(job_runs(rows), "update", ["work_id", "project_id", "run_id"]))


@query(
    "stream_run_events",
    f"SELECT {duck.stable_id('RE', 'user_id', 'event_type', chr(39) * 2, 'strftime(ts, ' + chr(39) + '%Y-%m-%dT%H:%M:%S' + chr(39) + ')')} AS event_id, count(DISTINCT 1) AS n FROM events GROUP BY 1",
)
def stream_run_events(spark, sf_dir):
    rows = _updates(spark, sf_dir).select("run_id", "event_type", F.lit("").alias("message"), F.col("updated_at").alias("created_at"), "seq")
    out = drain(append_events(rows, f"{PIECE_DAYS + 1} days").select("event_id"), "append")
    return out.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_cancelled_results",
    """WITH c AS (SELECT user_id, min(event_id) AS stopped FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT event_id, coalesce(event_id > stopped, false) AND event_type <> 'error' AS rejected FROM events LEFT JOIN c USING (user_id)""",
)
def stream_cancelled_results(spark, sf_dir):
    rows = _updates(spark, sf_dir).withColumn("status", F.when(F.col("status") == "error", "cancelled").otherwise(F.col("status")))
    return flag_late_results(rows).select(F.col("seq").alias("event_id"), "rejected")


@query(
    "stream_stale_runs",
    f"""WITH {LAST}, n AS (SELECT epoch_ms(max(ts)) - {DELAY}000 AS seen FROM events),
g AS (SELECT run_id, status, status = 'running' AND epoch_ms(updated_at) + {STALE_SECONDS}000 <= seen AS recovered FROM last, n)
SELECT run_id, CASE WHEN recovered THEN 'partial_error' ELSE status END AS status, recovered FROM g""",
)
def stream_stale_runs(spark, sf_dir):
    with _stateful(spark):
        out = drain(recover_stale(_updates(spark, sf_dir), STALE_SECONDS, f"{DELAY} seconds"), "update", ["run_id"], "recovered")
    return out.select("run_id", "status", "recovered")


@query(
    "stream_late_updates",
    f"""WITH p AS (SELECT *, least(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // {PIECE_DAYS} + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END, {PIECES - 1}) AS piece FROM events),
m AS (SELECT piece, max(max(ts)) OVER (ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM p GROUP BY piece)
SELECT event_id, piece AS batch, coalesce(ts < newest - INTERVAL {DELAY} SECONDS, false) AS late FROM p JOIN m USING (piece)""",
)
def stream_late_updates(spark, sf_dir):
    in_time, late = split_late(_updates(spark, sf_dir), DELAY)
    flagged = in_time.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True)))
    return flagged.select(F.col("seq").alias("event_id"), "batch", "late")
