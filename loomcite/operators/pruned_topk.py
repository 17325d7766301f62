"""Exact top-k per query from postings, where frequent words only complete candidates.

The score of a document is the sum of its gains over the query's words by the root of both
lengths. Each word has a bound: its greatest gain with its shortest document. A first pass
scores some documents in full, those that do well in each word's best postings; the k-th of
them is a score that the k-th best of all reaches too. Words whose bounds add up to less than
that, the most frequent ones first, can't lift a document to it on their own. So only the other
words' postings make candidates, a candidate is dropped if its gains and the bounds of the rest stay
below, and what is left is completed word by word. A word that is in every document costs a posting per
candidate, not per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from .ranking import top_per_group

#: Best postings of a word, and documents per query, that the first pass looks at, for each row asked for.
CHAMPIONS, SEEDS = 4, 8
#: Scores are compared after rounding to nine places.
NOISE = 1e-8


def gain(tf: Column | str) -> Column:
    return 1 + F.log(1 + (F.col(tf) if isinstance(tf, str) else tf))


def score_of(sum_of_gains: Column, n_terms: Column | str = "n_terms", doc_len: Column | str = "doc_len") -> Column:
    column = lambda c: F.col(c) if isinstance(c, str) else c
    return sum_of_gains / F.sqrt(column(n_terms) + column(doc_len))


def word_bounds(index: DataFrame) -> DataFrame:
    """(token, df, most, shortest): postings, greatest gain and shortest document of every word."""
    return index.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.max(gain("tf")).alias("most"), F.min("doc_len").alias("shortest"))


def completed(pairs: DataFrame, terms: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """(query_id, key, gains) of the pairs over the given words (query_id, token)."""
    asked = pairs.select("query_id", key).join(terms.select("query_id", "token"), "query_id")
    return asked.join(index.select("token", key, "tf"), ["token", key]).groupBy("query_id", key).agg(F.sum(gain("tf")).alias("gains"))


def threshold(terms: DataFrame, index: DataFrame, key: str, k: int, other_than_query: bool) -> DataFrame:
    """(query_id, floor): a score that the ``k``-th best document has at least; queries of fewer documents are missing."""
    best = top_per_group(index.select("token", key, "tf", "doc_len"), ["token"], [F.desc(gain("tf") / F.sqrt("doc_len")), F.asc(key)], max(CHAMPIONS * k, 16), "_at")
    seeds = terms.select("query_id", "token", "n_terms").join(best, "token")
    if other_than_query:
        seeds = seeds.filter(F.col("query_id") != F.col(key))
    rated = seeds.groupBy("query_id", key).agg(F.sum(gain("tf")).alias("gains"), F.first("doc_len").alias("doc_len"), F.first("n_terms").alias("n_terms"))
    likely = durable(top_per_group(rated.withColumn("part", score_of(F.col("gains"))), ["query_id"], [F.desc("part"), F.asc(key)], SEEDS * k, "_at").select("query_id", key, "doc_len", "n_terms"))
    full = likely.join(completed(likely, terms, index, key), ["query_id", key]).withColumn("score", score_of(F.col("gains")))
    at = top_per_group(full.select("query_id", key, "score"), ["query_id"], [F.desc("score"), F.asc(key)], k, "_at")
    return at.filter(F.col("_at") == k).select("query_id", F.col("score").alias("floor"))


def essential(terms: DataFrame, bounds: DataFrame, floors: DataFrame, least: float) -> DataFrame:
    """(query_id, token, n_terms, floor, essential, rest) of the words that any document has.

    ``rest`` is what the words that aren't essential can add to a score at most.
    """
    known = terms.join(bounds, "token").join(floors, "query_id", "left")
    known = known.withColumns({"floor": F.greatest(F.coalesce("floor", F.lit(0.0)), F.lit(float(least))) - NOISE, "bound": score_of(F.col("most"), doc_len="shortest")})
    common_first = Window.partitionBy("query_id").orderBy(F.desc("df"), "token").rowsBetween(Window.unboundedPreceding, 0)
    rows = known.withColumn("essential", F.sum("bound").over(common_first) >= F.col("floor"))
    rest = F.sum(F.when(F.col("essential"), 0.0).otherwise(F.col("bound"))).over(Window.partitionBy("query_id"))
    return rows.withColumn("rest", rest).select("query_id", "token", "n_terms", "floor", "essential", "rest")


def top_by_postings(index: DataFrame, terms: DataFrame, key: str, k: int, least: float = 0.0, other_than_query: bool = False) -> DataFrame:
    """(query_id, key, score, rn): the ``k`` documents of the best score for each query, none below ``least``.

    ``index`` holds (token, key, tf, doc_len), ``terms`` the distinct words of each query as
    (query_id, token, n_terms). With ``other_than_query`` a document isn't its own answer.
    """
    index, terms = durable(index), durable(terms)
    words = durable(essential(terms, word_bounds(index), threshold(terms, index, key, k, other_than_query), least))
    met = index.join(words.filter("essential"), "token")
    if other_than_query:
        met = met.filter(F.col("query_id") != F.col(key))
    part = met.groupBy("query_id", key).agg(
        F.sum(gain("tf")).alias("gains"), *[F.first(c).alias(c) for c in ("doc_len", "n_terms", "floor", "rest")])
    likely = durable(part.filter(score_of(F.col("gains")) + F.col("rest") >= F.col("floor")))
    more = completed(likely, words.filter("not essential"), index, key).withColumnRenamed("gains", "more")
    full = likely.join(more, ["query_id", key], "left")
    scored = full.withColumn("score", score_of(F.col("gains") + F.coalesce("more", F.lit(0.0)))).filter(F.col("score") >= least)
    return top_per_group(scored.select("query_id", key, "score"), ["query_id"], [F.desc(F.round("score", 9)), F.asc(key)], k)
