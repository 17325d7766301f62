"""Run a stream to the end of its input and read back what it wrote."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import first_per_key

from ..session import checkpoint_folder


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def run_to_end(stream: DataFrame, mode: str, state: str, write: Callable[[DataFrame, int], None]) -> None:
    """Run all available input through ``write``, one call per micro-batch."""
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True)
    writer.option("checkpointLocation", state).foreachBatch(write).start().awaitTermination()


def drain(stream: DataFrame, mode: str, keys: list[str] | None = None, newest: str | None = None) -> DataFrame:
    """Process all available input into parquet files; in update mode each batch is its own folder.

    Files are written by the tasks, so nothing passes through the driver. A batch that
    is retried overwrites its own folder. For update mode the newest row per key is
    returned.
    """
    spark = stream.sparkSession
    folder = work_folder(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    run_to_end(stream, mode, f"{folder}/state", write)
    rows = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{folder}/out")
    if keys:
        rows = first_per_key(rows, keys, [F.desc("batch"), F.desc(newest)] if newest else [F.desc("batch")])
    return rows.drop("batch")
