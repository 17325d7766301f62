"""Registration of embedding vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import stable_id
from .ranking import first_per_key


def register(rows: DataFrame) -> DataFrame:
    """Latest vector per (owner type, owner, view, model) and whether its size is the model's usual one."""
    keyed = rows.withColumn("embedding_id", stable_id("EMB", "owner_type", "owner_id", "view_name", "model"))
    latest = first_per_key(keyed, ["embedding_id"], [F.desc("seq")]).withColumn("dims", F.size("vector"))
    usual = latest.groupBy("model", "dims").agg(F.count(F.lit(1)).alias("_n")).groupBy("model").agg(
        F.max_by("dims", F.struct("_n", "dims")).alias("_usual")
    )
    return latest.join(usual, "model").withColumn("consistent", F.col("dims") == F.col("_usual")).drop("_usual")
