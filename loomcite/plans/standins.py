"""The given tables read as works, concepts, evidence, memberships and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import json_string
from ..functions.payload import canonical_key, label, quality, resolved_confidence, summary
from ..functions.text import compact_text, sentences, squeeze
from ..operators.concepts import concept_events, fold_concepts
from ..operators.evidence import with_evidence_id
from ..operators.ranking import first_per_key
from ..operators.sides import small_side
from ..session import durable
from .registry import spread_table, table

TITLE = 320
TYPES = ["existed_idea", "principle", "takeaway_message", "benchmark", "baseline"]


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a work: the first line is the title; all that the title doesn't carry is the abstract."""
    docs = spread_table(spark, sf_dir, "documents")
    first = F.substring_index("text", "\n", 1)
    said = squeeze(first)
    rest = F.substr("text", F.length(first) + F.lit(2))
    # a long title ends after TITLE - 3 characters with dots; the abstract goes on from there
    beyond = F.concat_ws("\n", F.substr(said, F.lit(TITLE - 2)), rest)
    return docs.select(
        "doc_id", "source", "lang", "n_chars", "text",
        compact_text(first, TITLE).alias("title"),
        F.when(F.length(said) > TITLE, beyond).otherwise(rest).alias("abstract"),
    )


CONCEPT = ["concept_type", "canonical_key", "scope"]


def sentence_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of a document is an extracted concept event."""
    return concept_events(_told(_keyed(_sentences(spark, sf_dir))))


def searched_events(spark: SparkSession, sf_dir: str, terms: list[str]) -> DataFrame:
    """All events of the concepts that a search for ``terms`` can find: one of their events has a term in its label or payload.

    A card's label and payload are those of two of its events. Ids, which cost most, are made for these events only.
    """
    rows = _sentences(spark, sf_dir)
    said = F.lower(F.concat_ws(" ", "label", _payload()))
    hit = said.rlike("|".join(f"\\Q{t}\\E" for t in terms))
    # two concepts of one hash only bring each other along
    marked = durable(_keyed(rows).select(*rows.columns, F.xxhash64(*CONCEPT).alias("_key"), hit.alias("_hit")))
    met = marked.filter("_hit").select("_key").distinct()
    return concept_events(_told(_keyed(marked.join(small_side(met), "_key"))))


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_table(spark, sf_dir, "documents", "doc_id", "text", "lang", "n_chars")
    labels = table(spark, sf_dir, "labels")
    rows = docs.select("doc_id", "lang", "n_chars", F.posexplode(sentences("text")).alias("_p", "sentence")).join(labels, "doc_id", "left")
    kinds = F.array(*map(F.lit, TYPES))
    return rows.withColumn("concept_type", F.element_at(kinds, (F.col("doc_id") % 5 + 1).cast("int")))


def _keyed(rows: DataFrame) -> DataFrame:
    payload = {"title": F.col("sentence")}
    rows = rows.withColumn("said", summary(payload))
    said = F.col("said")
    rows = rows.withColumn("label", label(F.col("concept_type"), payload, said=said))
    return rows.withColumns({"canonical_key": canonical_key(F.col("label"), said), "scope": F.lit("project_private")})


def _payload() -> Column:
    return F.concat(F.lit('{"title": '), json_string("sentence"), F.lit("}"))


def _told(rows: DataFrame) -> DataFrame:
    n_evidence = F.when(F.col("quality").isNull(), 0).otherwise(1)
    return rows.select(
        "doc_id", "lang", "quality", "toxic", "sentence", "concept_type", "label",
        (F.col("doc_id") * 1000000 + F.col("_p") + 1).alias("seq"),
        "canonical_key", "scope", _payload().alias("payload_json"),
        F.when(F.col("quality").isNull(), "extracted_unverified").otherwise(F.concat(F.lit("L"), F.col("quality"))).alias("validation_level"),
        resolved_confidence(F.col("n_chars") % 10 / 10, quality(F.col("said"), n_evidence, [])).alias("confidence"),
        F.lit("").alias("run_id"), F.col("lang").alias("model_mode"), F.lit("").alias("model"), F.lit(False).alias("is_manual"),
    )


def concepts(events: DataFrame) -> DataFrame:
    return fold_concepts(events)


def cited(events: DataFrame) -> DataFrame:
    """Events with their evidence: a labelled sentence is a link; toxic documents stand for unknown works."""
    labelled = F.col("quality").isNotNull()
    told = events.withColumns({
        "concept_version_id": F.col("version_id"), "work_id": F.when(F.col("toxic") == 0, F.concat(F.lit("D"), "doc_id")),
        "evidence_span": F.when(labelled, F.col("sentence")),
    })
    return with_evidence_id(told).withColumn("evidence_id", F.when(labelled, F.col("evidence_id")))


def links(events: DataFrame) -> DataFrame:
    """The evidence of events, one row per link."""
    rows = cited(events.filter("quality is not null")).select("concept_id", "concept_version_id", "work_id", "evidence_span", "seq", "evidence_id")
    return first_per_key(rows, ["evidence_id"], [F.asc("seq")])


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as memberships: the user is the project, the event type the record type."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("project_id"), F.col("event_type").alias("record_type"), F.col("event_id").alias("record_id"),
        (F.col("value") < 5).alias("hidden"), F.lit(0).alias("display_order"), F.col("ts").alias("created_at"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as run updates: the user is the run, the event type gives the status."""
    status = (
        F.when(F.col("event_type") == "signup", "queued")
        .when(F.col("event_type") == "purchase", "complete")
        .when(F.col("event_type") == "error", "error")
        .otherwise("running")
    )
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), status.alias("status"), F.col("ts").alias("updated_at"), F.col("event_id").alias("seq"),
        "event_type", "value",
    )


def derivation_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as derivation nodes; turn 0 is the source."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select(F.col("conv_id").alias("derivation_id"), F.col("turn").alias("node_id"), "role", "text")


def derivation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each later turn rests on the turn before it and on the turn at half its number."""
    turns = table(spark, sf_dir, "conversations").filter("turn > 0").select(F.col("conv_id").alias("derivation_id"), F.col("turn").alias("target"))
    sources = F.array_distinct(F.array(F.col("target") - 1, F.floor(F.col("target") / 2).cast("bigint")))
    return turns.select("derivation_id", F.explode(sources).alias("source"), "target")
