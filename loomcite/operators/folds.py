"""Order-aware folds written as aggregates that combine on the map side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import first_per_key


def first_value(value: str, seq: str = "seq") -> Column:
    return F.min_by(value, seq).alias(value)


def last_value(value: str, seq: str = "seq") -> Column:
    return F.max_by(value, seq).alias(value)


def first_filled(value: str, seq: str = "seq") -> Column:
    """Earliest non-empty value."""
    filled = F.when(F.coalesce(F.col(value).cast("string"), F.lit("")) != "", F.col(seq))
    return F.min_by(value, filled).alias(value)


def last_filled(value: str, seq: str = "seq") -> Column:
    """Latest non-empty value."""
    filled = F.when(F.coalesce(F.col(value).cast("string"), F.lit("")) != "", F.col(seq))
    return F.max_by(value, filled).alias(value)


def longest(value: str, size: Column, seq: str = "seq") -> Column:
    """Longest non-empty value; the earliest of equals."""
    filled = F.coalesce(F.col(value), F.lit("")) != ""
    return F.max_by(value, F.when(filled, F.struct(size, -F.col(seq)))).alias(value)


def list_rows(df: DataFrame, keys: Sequence[str], columns: Sequence[str], seq: str = "seq") -> DataFrame:
    """List columns as child rows (keys, field, value, seq, pos): one per distinct value, at its first place.

    A group of any size stays spread: repeats are folded on the map side and no
    list is collected.
    """
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("items")) for c in columns])
    rows = df.select(*keys, seq, F.inline(fields)).select(*keys, seq, "field", F.posexplode("items").alias("pos", "value"))
    return rows.groupBy(*keys, "field", "value").agg(F.min(F.struct(seq, "pos")).alias("_at")).select(
        *keys, "field", "value", F.col(f"_at.{seq}").alias(seq), F.col("_at.pos").alias("pos")
    )


def upsert_rows(current: DataFrame, incoming: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """Latest row per key; ``created_at`` stays with the first row."""
    rows = current.unionByName(incoming, allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in keys]
    folded = rows.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), seq).alias("_last"), F.min_by("created_at", seq).alias("_created")
    )
    columns = [F.col("_created").alias(c) if c == "created_at" else F.col(f"_last.{c}").alias(c) for c in rest]
    return folded.select(*keys, *columns)


def insert_if_absent(current: DataFrame, incoming: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """Rows to add: unseen keys, the first row of each."""
    unique = first_per_key(incoming, keys, [F.asc(seq)])
    return unique.join(current.select(*keys), list(keys), "left_anti")


def update_flags(items: DataFrame, changes: DataFrame, key: str, ideas: bool = False) -> DataFrame:
    """Set highlighted / validated where a change names them; ideas also get a feedback status."""
    new = changes.select(key, F.col("highlighted").alias("_h"), F.col("validated").alias("_v"), F.col("at").alias("_at"))
    joined = items.join(new, key, "left")
    out = joined.withColumn("highlighted", F.coalesce("_h", "highlighted")).withColumn("validated", F.coalesce("_v", "validated"))
    if ideas:
        status = F.when(F.col("_v"), "validated").when(~F.col("_v"), "unvalidated")
        out = out.withColumn("feedback_status", F.coalesce(status, F.col("feedback_status")))
    return out.withColumn("updated_at", F.coalesce("_at", "updated_at")).drop("_h", "_v", "_at")
