"""The subpackage's registered queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontam, divergence, interaction, jaccard, licences, lm, neardup, order, packing, quality, rules, tokencount, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_best_fit_packing")
def op1(spark, sf_dir):
    """Pieces of all documents packed into sequences of 2048 tokens."""
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op2_training_order")
def op2(spark, sf_dir):
    """Where each sequence of all documents lies in the written shards."""
    return order.materialised(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op3_quality_rules")
def op3(spark, sf_dir):
    """Base statistics and verdict of every document."""
    return rules.judged(table(spark, sf_dir, "documents"))


@query("op4_quality_classifier")
def op4(spark, sf_dir):
    """Quality score of every document."""
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_license_scan")
def op5(spark, sf_dir):
    """Licence family of every paragraph that has words of a licence."""
    return licences.scanned(table(spark, sf_dir, "documents"))


@query("op6_token_counts")
def op6(spark, sf_dir):
    """Bytes and tokens of every document."""
    return tokencount.counted(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op7_language_model")
def op7(spark, sf_dir):
    """Language-model score of every document."""
    return lm.scored(table(spark, sf_dir, "documents"))


@query("op8_toxicity")
def op8(spark, sf_dir):
    """Expected severity of every document."""
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_minhash_near_dedup")
def op9(spark, sf_dir):
    """Near-duplicate class of every document."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).drop("key")


CONTAMINATION_SQL = """
WITH words AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), 13) AS n FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
sizes AS (SELECT DISTINCT n FROM sized),
runs AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes)),
met AS (SELECT DISTINCT doc_id, item_id, n, i FROM runs JOIN windows USING (n, s)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM met GROUP BY doc_id)
SELECT doc_id, CAST(len(coalesce(w, [])) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(coalesce(w, [])) AS contaminated
FROM words LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query("op10_benchmark_decontamination", CONTAMINATION_SQL)
def op10(spark, sf_dir):
    """Words of every document that a benchmark item's windows hit."""
    from pyspark.sql import functions as F

    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


INTERACTION_SQL = """
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM texts),
marks AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
least AS (SELECT t, min(doc_id) AS least FROM texts GROUP BY t),
judged AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT) + 4 * CAST(100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) AS INT)
  + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > least, false) AS INT) AS fails
  FROM words JOIN least USING (t) LEFT JOIN marks USING (doc_id)),
cells AS (SELECT part, good, toxic, fails, count(*) AS n FROM judged GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (SELECT filter_order, k AS step, bits[k] AS own, coalesce(list_sum(bits[1:k - 1]), 0) AS before FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS k FROM orders)),
report AS (SELECT part, filter_order, step, own,
  sum(CASE WHEN fails & own = 0 AND fails & CAST(before AS INT) = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN fails & own <> 0 AND fails & CAST(before AS INT) = 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN fails & own <> 0 AND fails & CAST(before AS INT) <> 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN good AND fails & own <> 0 AND fails & CAST(before AS INT) = 0 THEN n ELSE 0 END) AS good_lost,
  sum(CASE WHEN toxic AND fails & own <> 0 AND fails & CAST(before AS INT) = 0 THEN n ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM report
"""


@query("op11_filter_interaction", INTERACTION_SQL)
def op11(spark, sf_dir):
    """What each of five filters removes in each order, per language."""
    return interaction.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


DIVERGENCE_SQL = """
WITH texts AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS d,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
groups AS (SELECT DISTINCT lang, source FROM texts),
words AS (SELECT lang, source, d, unnest(w) AS term FROM texts),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 10),
counts AS (SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
totals AS (SELECT lang, source, coalesce(n, 0) AS n, coalesce(v, 0) AS v FROM groups LEFT JOIN (SELECT lang, source, sum(c) AS n FROM counts GROUP BY ALL) USING (lang, source) LEFT JOIN sizes USING (lang)),
prices AS (SELECT lang, source, term, coalesce(c, 0) AS c, CAST(1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c, 0) + 2)) // (n + 2 * v) AS HUGEINT) AS p
  FROM totals JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
whole AS (SELECT lang, term, CAST(1 + (CAST(1000000000 AS HUGEINT) * (c + 2)) // (n + 2 * v) AS HUGEINT) AS q
  FROM (SELECT lang, term, sum(c) AS c FROM counts GROUP BY ALL) JOIN (SELECT lang, sum(c) AS n FROM counts GROUP BY lang) USING (lang) JOIN sizes USING (lang)),
pairs AS (SELECT g.lang, g.source, h.source AS item, coalesce(value, 0) AS value FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
    FROM prices a JOIN prices b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM prices JOIN whole USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM terms)
SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS INT) AS rank FROM pairs
UNION ALL SELECT lang, source, 'term', item, CAST(value AS BIGINT), CAST(rank AS INT) FROM ranked WHERE rank <= 10
"""


@query("op12_source_divergence", DIVERGENCE_SQL)
def op12(spark, sf_dir):
    """How far the sources of a language lie apart, and the terms that mark each source."""
    return divergence.divergence(table(spark, sf_dir, "documents"))


JACCARD_SQL = """
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b USING (x) WHERE a.doc_id < b.doc_id AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS c FROM sets UNION SELECT r.a, l.b FROM reach r JOIN edges l ON r.c = l.a)
SELECT s.doc_id, CAST(len(any_value(s.s)) AS BIGINT) AS n_shingles, min(c) AS component_id FROM sets s JOIN reach ON a = s.doc_id GROUP BY s.doc_id
"""


@query("op13_ngram_jaccard_join", JACCARD_SQL)
def op13(spark, sf_dir):
    """Component of every document under links of Jaccard similarity 0.9 over runs of three words."""
    return jaccard.joined(table(spark, sf_dir, "documents"))
