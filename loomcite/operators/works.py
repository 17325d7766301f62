"""Works: cross-feed merge, upsert, versions, refresh."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import content_signature, stable_id
from ..functions.text import canonical_text, squeeze, venue_rank
from ..session import durable
from .folds import first_filled, first_value, insert_if_absent, last_filled, last_value
from .ranking import first_per_key


def merge_feeds(works: DataFrame) -> DataFrame:
    """One work per title key, folded in arrival order (``seq``).

    The first row is the base; abstract, URL and year fill in when empty, the venue
    comes from the highest rank (earliest wins a tie) and citations are the maximum.
    """
    keyed = with_title_key(works).withColumn("_rank", venue_rank("venue"))
    merged = keyed.groupBy("title_key").agg(
        F.min("seq").alias("first_seq"),
        first_value("title"),
        first_filled("abstract"),
        first_filled("url"),
        F.min_by("year", F.when(F.coalesce("year", F.lit(0)) != 0, F.col("seq"))).alias("year"),
        F.max_by("venue", F.struct("_rank", -F.col("seq"))).alias("venue"),
        F.max("citation_count").alias("citation_count"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    return merged.withColumn("work_id", stable_id("W", "title_key"))


def merge_feed_urls(works: DataFrame) -> DataFrame:
    """Source links of merged works as child rows in first-seen order.

    The base row adds its own list; every later row adds its list and its main link.
    """
    keyed = with_title_key(works)
    base = keyed.groupBy("title_key").agg(F.min("seq").alias("_base"))
    empty = F.array().cast("array<string>")
    links = F.concat(
        F.coalesce("source_urls", empty), F.when(F.col("seq") > F.col("_base"), F.array("url")).otherwise(empty)
    )
    rows = keyed.join(base, "title_key").select("title_key", "seq", F.posexplode(links).alias("pos", "url"))
    rows = rows.withColumn("url", F.trim("url")).filter("url <> ''")
    return rows.groupBy("title_key", "url").agg(F.min(F.struct("seq", "pos")).alias("_at")).select(
        stable_id("W", F.col("title_key")).alias("work_id"), "url", F.col("_at.seq").alias("seq"), F.col("_at.pos").alias("pos")
    )


def with_title_key(works: DataFrame) -> DataFrame:
    return works.withColumn("title_key", canonical_text(squeeze("title"))).filter(squeeze("title") != "")


def upsert_works(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Fold resolved works by id: non-empty ids and venue win, year coalesces, the rest is last-wins."""
    rows = current.unionByName(incoming, allowMissingColumns=True)
    last = ["title", "title_norm", "title_hash", "source_urls", "metadata", "identity_confidence", "identity_status"]
    keep = ["doi", "arxiv_id", "openalex_id", "crossref_id", "semantic_scholar_id", "venue", "source_type"]
    return rows.groupBy("work_id").agg(
        *[last_value(c) for c in last if c in rows.columns],
        *[last_filled(c) for c in keep if c in rows.columns],
        F.max_by("year", F.when(F.col("year").isNotNull(), F.col("seq"))).alias("year"),
        F.min("seq").alias("created_seq"),
        F.max("seq").alias("seq"),
    )


def versions_of(works: DataFrame) -> DataFrame:
    """Version rows of incoming works; needs work_id, title, abstract, source_updated_at, seq."""
    signature = content_signature("title", "abstract", "source_updated_at")
    rows = works.select("work_id", "seq", "source_updated_at", *[c.alias(n) for n, c in signature.items()])
    return rows.withColumn("version_id", stable_id("WV", "work_id", "title_hash", "abstract_hash", "content_hash"))


def append_versions(current: DataFrame, works: DataFrame) -> DataFrame:
    """Version rows whose signature is new."""
    return insert_if_absent(current, versions_of(works), ["version_id"])


def latest_versions(versions: DataFrame) -> DataFrame:
    return first_per_key(versions, ["work_id"], [F.desc("seq"), F.asc("version_id")])


def version_decisions(incoming: DataFrame, latest: DataFrame) -> DataFrame:
    """new_version / metadata_update / unchanged for every incoming version row."""
    old = latest.select(
        "work_id",
        F.col("title_hash").alias("_t"),
        F.col("abstract_hash").alias("_a"),
        F.col("source_updated_at").alias("_u"),
    )
    joined = incoming.join(old, "work_id", "left")
    both = (F.coalesce("source_updated_at", F.lit("")) != "") & (F.coalesce("_u", F.lit("")) != "")
    decision = (
        F.when(F.col("_t").isNull(), "new_version")
        .when((F.col("title_hash") != F.col("_t")) | (F.col("abstract_hash") != F.col("_a")), "new_version")
        .when(both & (F.col("source_updated_at") != F.col("_u")), "metadata_update")
        .otherwise("unchanged")
    )
    return joined.withColumn("decision", decision).drop("_t", "_a", "_u")


def refresh_plan(incoming: DataFrame, extracted: DataFrame) -> DataFrame:
    """Incoming versions still to extract; the others are unchanged and already extracted."""
    done = extracted.select("work_id", "title_hash", "abstract_hash").distinct()
    return incoming.join(done, ["work_id", "title_hash", "abstract_hash"], "left_anti")


def replace_stale(decisions: DataFrame, concept_sources: DataFrame) -> DataFrame:
    """Concept links to drop: those of works that got a new version."""
    changed = decisions.filter("decision = 'new_version'").select("work_id").distinct()
    return concept_sources.join(changed, "work_id", "left_semi")


class Replacement(NamedTuple):
    """Tables after stale works were replaced, and the concepts that went with them."""

    works: DataFrame
    sources: DataFrame
    concepts: DataFrame
    symbols: DataFrame
    relations: DataFrame
    emptied: DataFrame


def replaced(
    decisions: DataFrame, incoming: DataFrame, works: DataFrame, sources: DataFrame, fresh: DataFrame,
    concepts: DataFrame, new_concepts: DataFrame, symbols: DataFrame, relations: DataFrame,
) -> Replacement:
    """Replace works that have a new version, with all that rests on the old one.

    ``decisions`` (work_id, decision) names the works, ``incoming`` has their new rows (the last of ``seq``
    counts), ``sources`` (concept_id, work_id) what concepts rest on, ``fresh`` what is extracted from the
    new versions, with ``new_concepts`` for it. A concept loses the replaced works; one that had sources and
    has none left goes, with its symbols and with relations (source_id, target_id) from and to it.
    """
    changed = decisions.filter("decision = 'new_version'").select("work_id").distinct()
    newest = first_per_key(incoming.join(changed, "work_id", "left_semi"), ["work_id"], [F.desc("seq")])
    after = durable(sources.join(changed, "work_id", "left_anti").unionByName(fresh.select(*sources.columns)).distinct())
    emptied = durable(replace_stale(decisions, sources).select("concept_id").distinct().join(after, "concept_id", "left_anti"))
    kept = concepts.join(emptied, "concept_id", "left_anti")
    added = new_concepts.join(after, "concept_id", "left_semi").join(concepts, "concept_id", "left_anti")
    end = lambda c: emptied.select(F.col("concept_id").alias(c))
    return Replacement(
        works.join(newest, "work_id", "left_anti").unionByName(newest, allowMissingColumns=True), after, kept.unionByName(added, allowMissingColumns=True),
        symbols.join(emptied, "concept_id", "left_anti"), relations.join(end("source_id"), "source_id", "left_anti").join(end("target_id"), "target_id", "left_anti"), emptied,
    )
