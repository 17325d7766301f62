"""The run log as a stream: append, status, stale recovery, cancellation, one active job."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.runs import with_event_id
from .sinks import run_to_end, work_folder

# the state function below travels to the workers with the job
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def append_events(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Run events with their id; a repeat of (run, type, message, second) inside the delay is dropped.

    Rows more than the delay behind are dropped too: take them out with ``split_late`` first where they count."""
    return with_event_id(events.withWatermark("created_at", delay)).dropDuplicatesWithinWatermark(["event_id"])


def latest_status(updates: DataFrame) -> DataFrame:
    """Current status per run as a streaming aggregate: one small state row per run, update mode."""
    return updates.groupBy("run_id").agg(
        F.max_by("status", F.struct("updated_at", "seq")).alias("status"), F.max("updated_at").alias("updated_at"), F.count(F.lit(1)).alias("n_updates")
    )


def running_progress(updates: DataFrame) -> DataFrame:
    """Latest found / target per run and stage, update mode."""
    return updates.groupBy("run_id", "stage").agg(F.max_by("found", "seq").alias("found"), F.max_by("target", "seq").alias("target"))


def job_runs(requests: DataFrame) -> DataFrame:
    """Latest status, first request and number of requests per (work, project, run). Update mode."""
    return requests.groupBy("work_id", "project_id", "run_id").agg(
        F.max_by("status", "seq").alias("status"), F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("n")
    )


def accepted_jobs(runs: DataFrame) -> DataFrame:
    """The run that answers requests of each (work, project), from the rows of ``job_runs``: the first one that is
    active now. A finished run holds nothing up; without an active run the answer is null."""
    active = F.col("status").isin("queued", "running")
    return runs.groupBy("work_id", "project_id").agg(
        F.min_by(F.when(active, F.col("run_id")), F.when(active, F.struct("first_seq", "run_id"))).alias("active_run_id"),
        F.coalesce(F.sum(F.when(active, F.col("n"))), F.lit(0).cast("bigint")).alias("n_requests"),
    )


#: Groups of runs that share a call and a state row.
GROUPS = 2048
GROUP_STATE = "runs array<bigint>, status array<string>, updated_ms array<bigint>, seq array<bigint>, recovered array<boolean>"
RUN_COLUMNS = ["run_id", "status", "updated_ms", "seq", "recovered"]


def stale_runs(patience_ms: int):
    """Keeps the last update of every run; a running run without one for too long becomes ``partial_error``.

    Runs are dealt into ``GROUPS`` groups by their hash, as a call and a state row per run cost milliseconds each. A
    group times out when the watermark reaches the first of last update + patience among its running
    runs. A run with very many updates streams through it batch by batch.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = {run: (status, at, seq, gone) for run, status, at, seq, gone in zip(*state.get)} if state.exists else {}
        told = set()
        for frame in () if state.hasTimedOut else frames:
            for run, status, at, seq in zip(*(frame[c].tolist() for c in RUN_COLUMNS[:4])):
                run = None if run is None or run != run else int(run)
                told.add(run)
                # an older row that comes late changes nothing, a recovery included
                if run not in last or (at, seq) > last[run][1:3]:
                    last[run] = (status, at, seq, False)
        due = {run: at + patience_ms for run, (status, at, _, _) in last.items() if status == "running"}
        for run, at in due.items():
            if at <= state.getCurrentWatermarkMs():
                last[run] = ("partial_error", *last[run][1:3], True)
                told.add(run)
        state.update(tuple(map(list, zip(*((run, *of) for run, of in last.items())))))
        waits = [at for run, at in due.items() if last[run][0] == "running"]
        if waits:
            # a timeout fires once the watermark is beyond it, a run is stale once the watermark is there
            state.setTimeoutTimestamp(min(waits) - 1)
        yield pd.DataFrame([(run, *last[run]) for run in told], columns=RUN_COLUMNS)

    return fold


def recover_stale(updates: DataFrame, patience_seconds: int, delay: str = "1 minute") -> DataFrame:
    """Status rows of runs, with ``recovered`` rows for those that went stale. Update mode.

    Rows more than the delay behind are dropped: take them out with ``split_late`` first where they count."""

    def last_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.sort_values(["updated_ms", "seq"]).drop_duplicates("run_id", keep="last")

    rows = updates.select("run_id", "updated_at", "status", F.unix_millis("updated_at").alias("updated_ms"), "seq")
    # only the last update of a run in each Arrow batch travels, so a hot run is thinned before the shuffle
    last = rows.mapInPandas(last_of, rows.schema).withWatermark("updated_at", delay)
    return last.withColumn("_group", F.pmod(F.xxhash64("run_id"), F.lit(GROUPS))).groupBy("_group").applyInPandasWithState(
        stale_runs(patience_seconds * 1000), "run_id bigint, status string, updated_ms bigint, seq bigint, recovered boolean",
        GROUP_STATE, "update", GroupStateTimeout.EventTimeTimeout)


def flag_late_results(updates: DataFrame) -> DataFrame:
    """Every update with ``rejected``: a result whose run was cancelled before it (smaller ``seq``).

    The stream only lands updates and, per batch, the first cancellation of each run, one folder
    per batch; a repeated batch overwrites its own folders. The verdict is made when the rows are read,
    by a plain join with the first cancellation over all batches, so a cancellation that arrives
    after a result still rejects it, nothing is read again for each batch, and a run with very many
    results is split like any skewed join.
    """
    folder = work_folder(updates.sparkSession, "cancel")

    def write(batch: DataFrame, number: int) -> None:
        stops = batch.filter("status = 'cancelled'").groupBy("run_id").agg(F.min("seq").alias("stopped"))
        stops.write.mode("overwrite").parquet(f"{folder}/stops/batch={number}")
        batch.select("run_id", "seq", "status").write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    run_to_end(updates, "append", f"{folder}/state", write)
    read = updates.sparkSession.read
    rows = read.schema(updates.select("run_id", "seq", "status").schema).parquet(f"{folder}/out")
    stops = read.schema(updates.select("run_id", F.col("seq").alias("stopped")).schema).parquet(f"{folder}/stops")
    first = stops.groupBy("run_id").agg(F.min("stopped").alias("stopped"))
    late = F.coalesce(F.col("seq") > F.col("stopped"), F.lit(False)) & (F.col("status") != "cancelled")
    return rows.join(first, "run_id", "left").select("run_id", "seq", "status", late.alias("rejected"))


def split_late(updates: DataFrame, delay_seconds: int, at: str = "updated_at") -> tuple[DataFrame, DataFrame]:
    """(rows in time, rejects) of a stream, as written tables with the ``batch`` that brought each row.

    A row is late if it is more than the delay behind the newest time of all earlier batches, which is
    what a watermark would drop without a trace; here it stays readable. A row without a time is in time.
    A batch keeps its newest time in a folder of its own, so a repeated batch finds the same limit.
    """
    folder = work_folder(updates.sparkSession, "late")
    mark = updates.select(F.col(at).alias("newest")).schema.add("batch", "long")

    def write(batch: DataFrame, number: int) -> None:
        read = batch.sparkSession.read.schema(mark)
        newest = read.parquet(f"{folder}/marks").filter(F.col("batch") < number).agg(F.max("newest")).first()[0] if number else None
        batch.agg(F.max(at).alias("newest")).write.mode("overwrite").parquet(f"{folder}/marks/batch={number}")
        late = F.lit(False) if newest is None else F.coalesce(F.col(at) < F.lit(newest) - F.make_dt_interval(secs=F.lit(delay_seconds)), F.lit(False))
        split = batch.withColumn("_late", late)
        split.filter("NOT _late").drop("_late").write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        split.filter("_late").drop("_late").write.mode("overwrite").parquet(f"{folder}/rejects/batch={number}")

    run_to_end(updates, "append", f"{folder}/state", write)
    load = updates.sparkSession.read.schema(updates.schema.add("batch", "long"))
    return load.parquet(f"{folder}/rows"), load.parquet(f"{folder}/rejects")
