"""Evidence links and the nested concept view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import stable_id
from .folds import insert_if_absent
from .ranking import first_per_key, ordinal


def repair_links(links: DataFrame, works: DataFrame, versions: DataFrame) -> DataFrame:
    """Unknown work: work and version become NULL. Unknown version: version becomes NULL."""
    known_work = works.select("work_id").distinct().withColumn("_w", F.lit(True))
    known_version = versions.select("work_version_id").distinct().withColumn("_v", F.lit(True))
    joined = links.join(known_work, "work_id", "left").join(known_version, "work_version_id", "left")
    work = F.when(F.col("_w"), F.col("work_id"))
    version = F.when(F.col("_w") & F.col("_v"), F.col("work_version_id"))
    # a link without a work keeps its version when that is known
    version = F.when(F.coalesce("work_id", F.lit("")) == "", F.when(F.col("_v"), F.col("work_version_id"))).otherwise(version)
    return joined.withColumn("work_version_id", version).withColumn("work_id", work).drop("_w", "_v")


def with_evidence_id(links: DataFrame) -> DataFrame:
    return links.withColumn("evidence_id", stable_id("EV", "concept_id", "concept_version_id", "work_id", "evidence_span"))


def insert_links(current: DataFrame, links: DataFrame) -> DataFrame:
    return insert_if_absent(current, with_evidence_id(links), ["evidence_id"])


def evidence_counts(links: DataFrame) -> DataFrame:
    return links.groupBy("concept_id").agg(F.count(F.lit(1)).alias("evidence_count"))


def concept_links(links: DataFrame) -> DataFrame:
    """Every evidence link of every concept as a row of its own: concept_id, pos (from 1, by evidence id), evidence_id.

    A concept may have any number of links; positions come from ranges, not from a task per concept.
    """
    return ordinal(links.select("concept_id", "evidence_id"), ["concept_id"], ["evidence_id"], "pos")


def concept_detail(concepts: DataFrame, versions: DataFrame, links: DataFrame, symbols: DataFrame) -> DataFrame:
    """Concept with active version (newest when none is active), newest active symbol and number of links.

    The links themselves are the rows of ``concept_links``. Versions may come without their summary.
    """
    active = concepts.select("concept_id", F.col("active_version_id").alias("_active"))
    ranked = versions.join(active, "concept_id").withColumn("_is", F.col("version_id") == F.col("_active"))
    picked = first_per_key(ranked, ["concept_id"], [F.desc("_is"), F.desc("seq")]).select(
        "concept_id", F.col("version_id").alias("shown_version_id"), *[c for c in ("summary",) if c in versions.columns]
    )
    counts = versions.groupBy("concept_id").agg(F.count(F.lit(1)).alias("version_count"))
    symbol = first_per_key(
        symbols.filter("status = 'active'"), ["concept_id"], [F.desc("seq"), F.desc("symbol_id")]
    ).select("concept_id", "short_code")
    out = concepts
    for part in (picked, counts, symbol, evidence_counts(links)):
        out = out.join(part, "concept_id", "left")
    return out.withColumn("evidence_count", F.coalesce("evidence_count", F.lit(0).cast("bigint")))


def resolve_refs(refs: DataFrame, tables: DataFrame) -> DataFrame:
    """Selected (owner, pos, bucket, id) references resolved against a union of keyed tables."""
    return refs.join(tables, ["bucket", "id"])


def note_fact(notes: DataFrame) -> DataFrame:
    """A user's free note as a fact row."""
    kept = notes.filter(F.trim("note") != "")
    return kept.select("owner", stable_id("UN", "owner", "note").alias("fact_id"), F.lit("user_note").alias("fact_type"), F.col("note").alias("text"))


def trace_refs(refs: DataFrame) -> DataFrame:
    """Resolved references nested on their owner, in request order; a request is a list that someone selected."""
    items = F.array_sort(F.collect_list(F.struct("pos", "bucket", "id")))
    return refs.groupBy("owner").agg(items.alias("refs"))
