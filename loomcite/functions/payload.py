"""Summary, label, key and quality of a concept payload given as columns."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import canonical_text, strip, text_of
from .vocab import LABEL_FIELDS, SUMMARY_FIELDS, SUMMARY_LISTS

Payload = Mapping[str, Column]


def summary(payload: Payload) -> Column:
    """Twelve scalar fields in order, then the first four items of five list fields."""
    scalars = [F.nullif(strip(payload[f]), F.lit("")) for f in SUMMARY_FIELDS if f in payload]
    lists = [F.array_join(F.filter(F.slice(payload[f], 1, 4), lambda v: v != ""), " ") for f in SUMMARY_LISTS if f in payload]
    return F.trim(F.concat_ws(" ", *scalars, *[F.nullif(v, F.lit("")) for v in lists]))


def label(concept_type: Column, payload: Payload, key_text: Column | None = None, said: Column | None = None) -> Column:
    """First non-empty of six fields, then fallbacks by type; 180 characters.

    ``said`` is the payload's summary when it is already a column.
    """
    key = F.nullif(text_of(key_text if key_text is not None else F.lit("")), F.lit(""))
    field = lambda name: F.nullif(strip(payload[name]), F.lit("")) if name in payload else F.lit(None).cast("string")
    named = [field(f) for f in LABEL_FIELDS]
    by_type = (
        F.when(concept_type == "takeaway_message", F.coalesce(field("message_text"), key, F.lit("Takeaway message")))
        .when(concept_type == "existed_idea", F.coalesce(field("idea_text"), key, F.lit("Existed idea")))
        .otherwise(
            F.coalesce(key, F.nullif(said if said is not None else summary(payload), F.lit("")), F.initcap(F.replace(concept_type, F.lit("_"), F.lit(" "))))
        )
    )
    return F.substring(F.coalesce(*named, by_type), 1, 180)


def canonical_key(label_: Column, summary_: Column, source_ids: Column | None = None) -> Column:
    hint = F.array_join(source_ids, ",") if source_ids is not None else F.lit("")
    return F.substring(canonical_text(F.concat_ws(" ", label_, F.substring(summary_, 1, 260), hint)), 1, 300)


def quality(summary_: Column, evidence_count: Column, list_fields: list[Column], manual: Column | None = None) -> Column:
    filled = reduce(lambda a, b: a + b, [F.when(F.size(c) > 0, 1).otherwise(0) for c in list_fields], F.lit(0))
    score = (
        0.3 * F.least(evidence_count / 2, F.lit(1.0))
        + 0.2 * F.least(F.length(summary_) / 900, F.lit(1.0))
        + 0.2 * F.least(filled / 5, F.lit(1.0))
        + 0.2
    )
    if manual is not None:
        score = score + F.when(manual, 0.1).otherwise(0.0)
    return F.bround(F.greatest(F.lit(0.05), F.least(score, F.lit(1.0))), 4)


def resolved_confidence(value: Column, quality_: Column) -> Column:
    """The payload's confidence, or the quality when it is missing or zero."""
    return F.coalesce(F.nullif(value.cast("double"), F.lit(0.0)), quality_)
