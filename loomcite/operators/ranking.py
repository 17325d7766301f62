"""Top rows per group, exact positions and pages, safe for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import durable


# Spark turns a rank filter into a group limit only up to this rank (its default threshold)
GROUP_LIMIT = 1000


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rn") -> DataFrame:
    """First ``k`` rows of every group.

    The rank filter becomes a group limit that runs before the shuffle, so a hot
    group sends at most ``k`` rows per map task. Deeper ranks, where Spark would sort
    whole groups, are taken from exact positions instead.
    """
    if k > GROUP_LIMIT:
        return ordinal(df, keys, order, rank).filter(F.col(rank) <= k).withColumn(rank, F.col(rank).cast("int"))
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_per_group(df, keys, order, 1, "_first").drop("_first")


def ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "rn") -> DataFrame:
    """Exact 1-based position of every row in its group, without a per-group task.

    Rows are range-partitioned by (keys, order), so a hot group spreads over many
    partitions. Each (group, partition) piece is counted, and a piece's start is the
    sum of the pieces before it; one group has at most one piece per partition.
    ``order`` should order rows totally within a group.
    """
    sort = [F.asc(k) for k in keys] + [F.asc(c) if isinstance(c, str) else c for c in order]
    placed = durable(
        df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_at", F.monotonically_increasing_id())
    )
    placed = placed.withColumn("_piece", F.shiftright("_at", 33))
    pieces = placed.groupBy(*keys, "_piece").agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    right = starts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_piece").alias("_p"), "_low", "_start")
    same = F.col("_piece") == F.col("_p")
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_k_{key}"))
    joined = placed.join(right, same)
    rank = (F.col("_at") - F.col("_low") + F.col("_start") + 1).cast("bigint")
    return joined.select(*df.columns, rank.alias(name))


def page(df: DataFrame, keys: Sequence[str], order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """One page per group with the group's total and whether more rows follow."""
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    shown = top_per_group(df, keys, order, offset + limit).filter(F.col("rn") > offset)
    return shown.join(totals, list(keys)).withColumn("has_more", F.col("total") > F.lit(offset + limit))


def multi_get(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows for a list of ids in request order; ``ids`` holds (pos, key)."""
    return ids.join(df, key).orderBy("pos")


def recent_per_bucket(records: DataFrame, limit: int | None) -> DataFrame:
    """Newest ``limit`` records of every bucket, presented oldest first."""
    kept = records
    if limit is not None:
        kept = top_per_group(records, ["bucket"], [F.desc("updated_at"), F.desc("id")], limit).drop("rn")
    return kept.orderBy("bucket", "updated_at", "id")
