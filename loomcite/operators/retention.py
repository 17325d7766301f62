"""Keep-N retention, removal of sources and cascades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import RETENTION
from .ranking import top_per_group


def retained(items: DataFrame, caps: dict[str, int] = RETENTION) -> DataFrame:
    """Rows to keep: highlighted, then used, then recent, up to each bucket's cap.

    Buckets without a cap keep everything. Keeping is a top-k per bucket, so a large
    bucket never sorts in one task; what is dropped is the anti join with this.
    """
    kept = None
    order = [F.desc("highlighted"), F.desc("usage_count"), F.desc("recency"), F.asc("id")]
    for bucket, cap in caps.items():
        rows = top_per_group(items.filter(F.col("bucket") == bucket), ["bucket"], order, cap).drop("rn")
        kept = rows if kept is None else kept.unionByName(rows)
    return kept.unionByName(items.filter(~F.col("bucket").isin(list(caps))))


def pruned(items: DataFrame, caps: dict[str, int] = RETENTION) -> DataFrame:
    capped = items.filter(F.col("bucket").isin(list(caps)))
    return capped.join(retained(capped, caps).select("bucket", "id"), ["bucket", "id"], "left_anti")


def touch_usage(items: DataFrame, calls: DataFrame) -> DataFrame:
    """+1 use per distinct id and call; last use is the latest call."""
    used = calls.groupBy("bucket", "id").agg(
        F.count_distinct("call_id").alias("_uses"), F.max("called_at").alias("_last")
    )
    joined = items.join(used, ["bucket", "id"], "left")
    return (
        joined.withColumn("usage_count", F.coalesce("usage_count", F.lit(0)) + F.coalesce("_uses", F.lit(0)))
        .withColumn("last_used_at", F.greatest("last_used_at", "_last"))
        .drop("_uses", "_last")
    )


def unlink_works(source_rows: DataFrame, removed_works: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(remaining (principle_id, work_id) rows, principles that lose their last source)."""
    remaining = source_rows.join(removed_works.select("work_id").distinct(), "work_id", "left_anti")
    touched = source_rows.join(removed_works.select("work_id").distinct(), "work_id", "left_semi").select("principle_id").distinct()
    emptied = touched.join(remaining.select("principle_id").distinct(), "principle_id", "left_anti")
    return remaining, emptied


def drop_relations(relations: DataFrame, removed: DataFrame) -> DataFrame:
    """Relations with neither end among the removed principles."""
    gone = removed.select("principle_id")
    left = relations.join(gone, relations["source_principle_id"] == gone["principle_id"], "left_anti")
    return left.join(gone, left["target_principle_id"] == gone["principle_id"], "left_anti")


def clear_records(items: DataFrame, keep_buckets: tuple[str, ...] = ("field_profiles",)) -> DataFrame:
    """Clear local records but keep project shells."""
    return items.filter(F.col("bucket").isin(list(keep_buckets)))
