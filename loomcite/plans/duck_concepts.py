"""Oracle CTEs for concepts, evidence and memberships."""

from __future__ import annotations

from ..functions.vocab import CONCEPT_PREFIX, SYMBOL_PREFIX
from . import duck

PREFIX_CASE = "(CASE concept_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CONCEPT_PREFIX.items()) + " ELSE 'C' END)"
SYMBOL_CASE = "CASE concept_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SYMBOL_PREFIX.items()) + " ELSE 'C' END"
TYPE_CASE = "CASE doc_id % 5 WHEN 0 THEN 'existed_idea' WHEN 1 THEN 'principle' WHEN 2 THEN 'takeaway_message' WHEN 3 THEN 'benchmark' ELSE 'baseline' END"

# every sentence of a document is an extracted concept event
EVENTS = f"""
sents AS (
  SELECT d.doc_id, d.lang, d.n_chars, l.quality, l.toxic, CAST(pos AS BIGINT) AS pos, s AS sentence
  FROM (SELECT doc_id, lang, n_chars, unnest({duck.sentences("text")}) AS s, generate_subscripts({duck.sentences("text")}, 1) AS pos FROM documents) d
  LEFT JOIN labels l USING (doc_id)),
raw_events AS (
  SELECT doc_id, lang, n_chars, quality, toxic, sentence, doc_id * 1000000 + pos AS seq, {TYPE_CASE} AS concept_type, substr(sentence, 1, 180) AS label,
         substr({duck.canonical("substr(sentence, 1, 180) || ' ' || substr(sentence, 1, 260) || ' '")}, 1, 300) AS canonical_key,
         '{{"title": "' || replace(replace(sentence, '\\', '\\\\'), '"', '\\"') || '"}}' AS payload_json,
         CASE WHEN quality IS NULL THEN 'extracted_unverified' ELSE 'L' || quality END AS validation_level,
         CASE WHEN quality IS NULL THEN 0 ELSE 1 END AS n_evidence
  FROM sents),
events_q AS (
  SELECT *, round_even(greatest(0.05::DOUBLE, least(0.3::DOUBLE * least(n_evidence / 2, 1.0::DOUBLE) + 0.2::DOUBLE * least(length(sentence) / 900, 1.0::DOUBLE) + 0.2::DOUBLE, 1.0::DOUBLE)), 4) AS quality_score
  FROM raw_events),
concept_events AS (
  SELECT *, coalesce(nullif((n_chars % 10) / 10, 0), quality_score) AS confidence,
         {duck.stable_id(PREFIX_CASE, "concept_type", "canonical_key", "'project_private'")} AS concept_id
  FROM events_q),
concept_versions AS (
  SELECT *, {duck.stable_id("CV", "concept_id", "lang", duck.text_hash("payload_json"))} AS version_id FROM concept_events)
"""

CONCEPTS = f"""{EVENTS},
concepts AS (
  SELECT concept_id, any_value(concept_type) AS concept_type, any_value(canonical_key) AS canonical_key, arg_max(label, seq) AS label,
         arg_max(validation_level, seq) AS validation_level, max(confidence) AS confidence,
         arg_max(version_id, (confidence, seq)) AS active_version_id, min(seq) AS created_seq, max(seq) AS updated_seq
  FROM concept_versions GROUP BY concept_id)
"""

# a labelled sentence is a link; toxic documents stand for works that are not known
LINKS = f"""
links AS (
  SELECT DISTINCT ON (evidence_id) * FROM (
    SELECT {duck.stable_id("EV", "concept_id", "version_id", "CASE WHEN toxic = 0 THEN 'D' || doc_id END", "sentence")} AS evidence_id,
           concept_id, version_id, CASE WHEN toxic = 0 THEN 'D' || doc_id END AS work_id, sentence AS span, seq
    FROM concept_versions WHERE quality IS NOT NULL) ORDER BY evidence_id, seq)
"""
