"""Labelled rows for the models: a bounded, deterministic sample with its bound as a parameter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_label(labels: DataFrame, target: str) -> DataFrame:
    """One label per id: of repeated rows the larger; rows without id or label say nothing."""
    rows = labels.select(F.col("doc_id").alias("doc_id"), F.col(target).cast("int").alias("label"))
    return rows.filter("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, per_class: int, usable=None) -> DataFrame:
    """At most ``per_class`` documents of each label, those whose hashed id is smallest, as (doc_id, text, label).

    ``usable`` is a condition on ``doc_id``. The ids are chosen from the labels before any
    text is read; ids whose document is missing fall out.
    """
    rows = one_label(labels, target)
    if usable is not None:
        rows = rows.filter(usable)
    parts = [rows.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(per_class) for k in (0, 1)]
    texts = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    return texts.join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id")


def class_sizes(labels: DataFrame, target: str, usable=None) -> dict[int, int]:
    rows = one_label(labels, target)
    if usable is not None:
        rows = rows.filter(usable)
    return {r["label"]: r["count"] for r in rows.filter("label in (0, 1)").groupBy("label").count().collect()}
