"""SQL fragments for the oracle side, the same definitions written for DuckDB."""

from __future__ import annotations

from ..functions.vocab import SPACE_CLASS, STOPWORDS, TOKEN_PATTERN

STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE_CLASS}+', ' ', 'g'))"


def compact(x: str, limit: int) -> str:
    s = squeeze(x)
    return f"(CASE WHEN length({s}) <= {limit} THEN {s} ELSE rtrim(substr({s}, 1, {limit - 3})) || '...' END)"


def canonical(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '{TOKEN_PATTERN}'), lambda t: t NOT IN ({STOP}))"


def sentences(x: str) -> str:
    marked = f"regexp_replace({squeeze(x)}, '([.!?])\\s+', '\\1' || chr(1), 'g')"
    return f"list_filter(string_split({marked}, chr(1)), lambda s: s <> '')"


def text_hash(x: str) -> str:
    return f"substr(sha256(lower({squeeze(x)})), 1, 16)"


def stable_id(prefix: str, *parts: str) -> str:
    kept = ", ".join(f"nullif(CAST({p} AS VARCHAR), '')" for p in parts)
    label = prefix if prefix.startswith("(") else f"'{prefix}'"
    return f"{label} || '-' || upper(substr(sha1(concat_ws(chr(10), {kept})), 1, 12))"


def level(x: str) -> str:
    return f"coalesce(TRY_CAST(nullif(regexp_extract({x}, '\\d'), '') AS INTEGER), 0)"


def values(words) -> str:
    return ", ".join(f"('{w}')" for w in words)


# works as the stand-in mapping defines them
WORKS = f"""
works AS (
  SELECT doc_id, source, lang, n_chars, text, {compact("split_part(text, chr(10), 1)", 320)} AS title,
         CASE WHEN length({squeeze("split_part(text, chr(10), 1)")}) > 320
              THEN substr({squeeze("split_part(text, chr(10), 1)")}, 318) || chr(10) || array_to_string(string_split(text, chr(10))[2:], chr(10))
              ELSE array_to_string(string_split(text, chr(10))[2:], chr(10)) END AS abstract
  FROM documents)
"""


def lexical(items: str, key: str, body: str, terms: list[str], where: str = "") -> str:
    """CTE body (key, lexical) for positive scores of ``terms`` over ``items.body``."""
    words = ", ".join(f"('{t}')" for t in terms)
    return f"""
  SELECT d.{key}, sum(1 + ln(1 + d.tf)) / sqrt({len(terms)} + any_value(d.n)) AS lexical
  FROM (SELECT {key}, tok, any_value(n) AS n, count(*) AS tf
        FROM (SELECT {key}, unnest(ts) AS tok, len(ts) AS n
              FROM (SELECT {key}, {tokens(body)} AS ts FROM {items} {where}))
        GROUP BY {key}, tok) d
  JOIN (VALUES {words}) q(tok) ON q.tok = d.tok
  GROUP BY d.{key}"""
