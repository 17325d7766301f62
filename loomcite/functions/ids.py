"""Deterministic row ids: prefix and twelve upper-case hex digits of a SHA-1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_of, compact_text, text_hash, text_of
from .vocab import CONCEPT_PREFIX, DEFAULT_CONCEPT_PREFIX, SYMBOL_PREFIX


def stable_id(prefix: Column | str, *parts: Column | str, length: int = 12) -> Column:
    """Empty and NULL parts are skipped, the rest joined by newlines."""
    label = F.lit(prefix) if isinstance(prefix, str) else prefix
    kept = [F.nullif(col_of(p).cast("string"), F.lit("")) for p in parts]
    digest = F.upper(F.substring(F.sha1(F.encode(F.concat_ws("\n", *kept), "utf-8")), 1, length))
    return F.concat(label, F.lit("-"), digest)


def lookup(value: Column, table: dict[str, str], default: str) -> Column:
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), F.lit(default))


def concept_id(concept_type: Column | str, key: Column | str, scope: Column | str) -> Column:
    prefix = lookup(col_of(concept_type), CONCEPT_PREFIX, DEFAULT_CONCEPT_PREFIX)
    return stable_id(prefix, concept_type, key, scope)


def symbol_prefix(concept_type: Column | str) -> Column:
    return lookup(col_of(concept_type), SYMBOL_PREFIX, DEFAULT_CONCEPT_PREFIX)


def json_string(value: Column | str) -> Column:
    """A JSON string literal for text without control characters."""
    escaped = F.replace(F.replace(text_of(value), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def content_signature(title: Column | str, abstract: Column | str, updated: Column | str) -> dict[str, Column]:
    """The three hashes that tell whether a work has changed."""
    short_title = compact_text(F.coalesce(F.nullif(text_of(title), F.lit("")), F.lit("Untitled work")), 320)
    body = compact_text(abstract, 6000)
    payload = F.concat(
        F.lit('{"abstract": '), json_string(body),
        F.lit(', "source_updated_at": '), json_string(updated),
        F.lit(', "title": '), json_string(short_title), F.lit("}"),
    )
    return {
        "title_hash": text_hash(short_title),
        "abstract_hash": text_hash(body),
        "content_hash": F.substring(F.sha2(payload, 256), 1, 16),
    }
