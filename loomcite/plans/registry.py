"""Named queries over the given tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


SPREAD_BYTES = 4 << 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=256)
def _bytes(path: str) -> int:
    files = SparkSession.getActiveSession().read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.agg(F.sum("length")).first()[0] or 0


def pieces(spark: SparkSession, sf_dir: str, name: str, piece_bytes: int = 4 << 20) -> int:
    """Number of partitions for a table's rows, so that each holds about so many of its written bytes whatever its size."""
    return max(spark.sparkContext.defaultParallelism, -(-_bytes(f"{sf_dir}/{name}.parquet") // piece_bytes))


def spread_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table for text-heavy work; a small one, often a single row group, is spread over the cores.

    Above the size bound the file splits already give more tasks than cores and
    nothing is shuffled.
    """
    df = table(spark, sf_dir, name)
    df = df.select(*columns) if columns else df
    if _bytes(f"{sf_dir}/{name}.parquet") <= SPREAD_BYTES:
        return df.repartition(spark.sparkContext.defaultParallelism)
    return df
