"""Concept cards: typed families, upsert fold, principle merge, duplicates, variants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import concept_id, stable_id
from ..functions.text import canonical_text, repair_hyphens, squeeze, text_hash, text_of
from ..functions.vocab import RICH_LISTS, RICH_SCALARS
from .folds import first_value, last_value, list_rows, longest
from .ranking import first_per_key, top_per_group

# fixed values: extraction array -> concept type
FAMILIES = [
    ("existed_ideas", "existed_idea"),
    ("principles", "principle"),
    ("takeaway_messages", "takeaway_message"),
    ("benchmarks", "benchmark"),
    ("baselines", "baseline"),
    ("result_facts", "result_fact"),
]


def typed_families(extractions: DataFrame) -> DataFrame:
    """One row per extracted object.

    ``extractions`` holds work_id, title and one array of payload maps per family;
    NULL items (non-objects) are dropped and a principle keeps sources of its own.
    """
    out = None
    for column, concept_type in FAMILIES:
        if column not in extractions.columns:
            continue
        rows = extractions.select(
            "work_id", F.col("title").alias("source_title"), F.lit(concept_type).alias("concept_type"),
            F.explode(column).alias("payload"),
        ).filter("payload is not null")
        own = F.split(F.element_at("payload", F.lit("source_works")), r"\s*,\s*")
        sources = F.coalesce(own, F.array("work_id")) if concept_type == "principle" else F.array("work_id")
        rows = rows.withColumn("source_work_ids", sources)
        out = rows if out is None else out.unionByName(rows)
    return out


def concept_events(rows: DataFrame) -> DataFrame:
    """Add ids to concept events.

    Needs concept_type, canonical_key, scope, payload_json, run_id, model_mode,
    model, is_manual. Key, id and version do not depend on arrival order.
    """
    mode = F.when(F.col("is_manual"), "manual").otherwise(F.col("model_mode"))
    model = F.when(F.col("is_manual"), "manual").otherwise(F.col("model"))
    keyed = rows.withColumn("concept_id", concept_id("concept_type", "canonical_key", "scope"))
    return keyed.withColumn(
        "version_id", stable_id("CV", "concept_id", "run_id", mode, model, text_hash("payload_json"))
    )


def fold_concepts(events: DataFrame, keys: Sequence[str] = ("concept_type", "canonical_key", "scope")) -> DataFrame:
    """Concept cards from events: label and levels last-wins, confidence is the running maximum.

    The active version is the latest among those that reached the maximum. Ids and
    creation come from the first event. A stored card joins in as an event with a
    lower ``seq``. Events that carry ids only are folded by concept_id.
    """
    return events.groupBy(*keys).agg(
        *[first_value(c) for c in ("concept_id",) if c not in keys],
        *[last_value(c) for c in ("label", "origin", "validation_level", "verification_status") if c in events.columns],
        F.max("confidence").alias("confidence"),
        F.max_by("version_id", F.struct("confidence", "seq")).alias("active_version_id"),
        F.min("seq").alias("created_seq"),
        F.max("seq").alias("updated_seq"),
    )


def fold_versions(events: DataFrame, concepts: DataFrame) -> DataFrame:
    """Version rows, the last write of each id, with exactly one active per concept."""
    last = first_per_key(events, ["version_id"], [F.desc("seq")])
    active = concepts.select("concept_id", "active_version_id")
    return last.join(active, "concept_id").withColumn("is_active", F.col("version_id") == F.col("active_version_id"))


def principle_signature(name: Column | str, mechanism: Column | str, mode: Column | str, model: Column | str) -> Column:
    joined = F.concat_ws(
        " ", text_of(mode), text_of(model), F.trim(F.lower(text_of(name))), F.trim(F.lower(text_of(mechanism)))
    )
    return F.substring(squeeze(joined), 1, 260)


def merge_principles(principles: DataFrame) -> DataFrame:
    """Scalars of principles that share a signature: the longest text wins, the rest keep the first value."""
    keyed = with_signature(principles)
    rich = [longest(c, F.length(c)) for c in RICH_SCALARS if c in keyed.columns]
    first = [first_value(c) for c in ("principle_id", "name", "model_mode", "model_name") if c in keyed.columns]
    return keyed.groupBy("signature").agg(
        *first, *rich, F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n_merged")
    )


def merge_principle_lists(principles: DataFrame) -> DataFrame:
    """Ordered unions of list fields and source works as child rows of a signature."""
    keyed = with_signature(principles)
    columns = [c for c in [*RICH_LISTS, "source_works"] if c in keyed.columns]
    return list_rows(keyed, ["signature"], columns)


def merge_evidence_spans(principles: DataFrame, keep: int = 12) -> DataFrame:
    """First twelve distinct evidence spans of each merged principle."""
    rows = list_rows(with_signature(principles), ["signature"], ["evidence_spans"])
    return top_per_group(rows, ["signature"], [F.asc("seq"), F.asc("pos")], keep)


def with_signature(principles: DataFrame) -> DataFrame:
    if "signature" in principles.columns:
        return principles
    return principles.withColumn("signature", principle_signature("name", "mechanism", "model_mode", "model_name"))


def merge_near_duplicates(records: DataFrame, text: str) -> DataFrame:
    """One record per core text once hyphenation noise is repaired; best confidence kept."""
    keyed = near_duplicate_key(records, text)
    rest = [c for c in records.columns if c != "confidence"]
    best = keyed.groupBy("core_key").agg(
        F.max_by(F.struct(*rest), F.struct("confidence", -F.col("seq"))).alias("_r"),
        F.max("confidence").alias("confidence"),
        F.count(F.lit(1)).alias("n_merged"),
    )
    return best.select("core_key", "_r.*", "confidence", "n_merged")


def near_duplicate_key(records: DataFrame, text: str) -> DataFrame:
    return records.withColumn("core_key", canonical_text(repair_hyphens(text)))


def canonical_method_name(name: Column | str) -> Column:
    """``X: long subtitle`` and ``X (Proposed)`` are X; wrapper words before an acronym are dropped."""
    value = F.regexp_replace(squeeze(name), r"(?i)\s*\((?:proposed|ours|our method)\)\s*$", "")
    value = F.regexp_replace(value, r"\s*:\s.*$", "")
    wrapper = r"(?i)^(?:the\s+)?(?:state-of-the-art|aligning with experiments from|experiments from|compared with)\b.*?\b([A-Z][A-Za-z0-9\-]*[A-Z0-9][A-Za-z0-9\-]*)$"
    inner = F.regexp_extract(value, wrapper, 1)
    return F.trim(F.when(inner != "", inner).otherwise(value))


def merge_aliases(baselines: DataFrame) -> DataFrame:
    """Baseline records of one canonical name become one."""
    named = baselines.withColumn("baseline_name", canonical_method_name("baseline_name"))
    named = named.withColumn("name_key", canonical_text("baseline_name")).filter("name_key <> ''")
    return named.groupBy("name_key").agg(
        first_value("baseline_name"), F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n_merged")
    )


def presented_variant(variants: DataFrame, key: str = "record_id") -> DataFrame:
    """The variant shown for each record: a manual edit always, else the latest model variant."""
    latest = first_per_key(variants, [key, "model"], [F.desc("is_manual"), F.desc("seq")])
    return first_per_key(latest, [key], [F.desc("is_manual"), F.desc("seq")])
