"""Query terms and the lexical score."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text_of
from .vocab import QUERY_EXPANSIONS, STOPWORDS, TOKEN_PATTERN, WHOLE_WORD_TRIGGERS


def _word(trigger: str) -> str:
    return rf"(?<![a-z0-9]){re.escape(trigger)}(?![a-z0-9])"


def expansions(value: Column | str) -> Column:
    """Phrases added to a text, in dictionary order without repeats."""
    lower = F.lower(text_of(value))
    groups = []
    for triggers, phrases in QUERY_EXPANSIONS:
        tests = [lower.rlike(_word(t)) if t in WHOLE_WORD_TRIGGERS else lower.contains(t) for t in triggers]
        hit = reduce(lambda a, b: a | b, tests)
        groups.append(F.when(hit, F.array(*map(F.lit, phrases))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(*groups))


def enriched(value: Column | str) -> Column:
    return F.trim(F.concat_ws(" ", text_of(value), F.array_join(expansions(value), " ")))


def query_terms(query: str, passes: int = 1) -> list[str]:
    """Distinct terms of one request string, sorted; the request itself is driver-side text."""
    text = query
    for _ in range(passes):
        lower, added = text.lower(), []
        for triggers, phrases in QUERY_EXPANSIONS:
            if any(re.search(_word(t), lower) if t in WHOLE_WORD_TRIGGERS else t in lower for t in triggers):
                added += [p for p in phrases if p not in added]
        text = " ".join([text, *added])
    return sorted(set(re.findall(TOKEN_PATTERN, text.lower())) - set(STOPWORDS))


def hit_count(hits: Column, term: str) -> Column:
    return F.size(F.filter(hits, lambda t: t == F.lit(term)))


def score_from_counts(n: Column, counts: list[Column]) -> Column:
    """Damped term counts over the square root of query and text size; 0 when either is empty."""
    if not counts:
        return F.lit(0.0)
    gains = [F.when(c > 0, 1 + F.log(1 + c)).otherwise(F.lit(0.0)) for c in counts]
    total = reduce(lambda a, b: a + b, gains)
    return F.when(n > 0, total / F.sqrt(F.lit(len(counts)) + n)).otherwise(F.lit(0.0))
