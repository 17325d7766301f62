"""Short unique codes for concepts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import stable_id, symbol_prefix
from ..functions.text import text_of
from ..session import durable
from .ranking import first_per_key, ordinal


def abbreviation(label: Column | str, size: int = 5) -> Column:
    """Initials of a label's words, or its first word when there is only one; ``X`` for none."""
    words = F.regexp_extract_all(text_of(label), F.lit("[A-Za-z0-9]+"), F.lit(0))
    initials = F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")
    code = F.when(F.size(words) >= 2, initials).otherwise(F.coalesce(F.try_element_at(words, F.lit(1)), F.lit("X")))
    return F.upper(F.substring(code, 1, size))


def base_code(concept_type: Column | str, label: Column | str) -> Column:
    return F.concat(symbol_prefix(concept_type), F.lit("."), abbreviation(label))


def allocate(concepts: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """One code per (namespace, concept): the base, then suffix 2, 3, ... in ``seq`` order.

    Numbers come from exact positions, so a base shared by a third of all concepts is
    not numbered in one task. A suffixed code can equal another base; the earlier
    concept keeps it and the others draw the next numbers of their base. Concepts
    that already have a code in ``current`` keep it and its codes stay taken.
    """
    wanted = concepts.withColumn("base", base_code("concept_type", "label"))
    taken, start = None, None
    if current is not None:
        wanted = wanted.join(current.select("namespace", "concept_id"), ["namespace", "concept_id"], "left_anti")
        taken = current.select("namespace", "short_code")
    open_rows, done = wanted, None
    while True:
        ranked = ordinal(open_rows, ["namespace", "base"], ["seq", "concept_id"], "n")
        if start is not None:
            ranked = ranked.join(start, ["namespace", "base"], "left")
            ranked = ranked.withColumn("n", F.col("n") + F.coalesce("_used", F.lit(0))).drop("_used")
        proposed = ranked.withColumn(
            "short_code", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat("base", F.col("n").cast("string")))
        )
        free = proposed if taken is None else proposed.join(taken, ["namespace", "short_code"], "left_anti")
        winners = durable(first_per_key(free, ["namespace", "short_code"], [F.asc("seq"), F.asc("concept_id")]))
        done = winners if done is None else done.unionByName(winners)
        losers = proposed.join(winners.select("namespace", "concept_id"), ["namespace", "concept_id"], "left_anti")
        losers = durable(losers)
        if losers.isEmpty():
            return finish(done)
        start = proposed.groupBy("namespace", "base").agg(F.max("n").alias("_used"))
        new = winners.select("namespace", "short_code")
        taken = new if taken is None else taken.unionByName(new)
        open_rows = losers.drop("n", "short_code")


def finish(rows: DataFrame) -> DataFrame:
    return rows.drop("n").withColumn("symbol_id", stable_id("SYM", "namespace", "short_code", "concept_id"))


def expand(codes: DataFrame, symbols: DataFrame, concepts: DataFrame) -> DataFrame:
    """(namespace, short_code) to the concept it stands for, newest registration first."""
    newest = first_per_key(symbols, ["namespace", "short_code"], [F.desc("seq"), F.desc("symbol_id")])
    return codes.join(newest, ["namespace", "short_code"]).join(concepts, "concept_id")


def symbol_table(concepts: DataFrame, symbols: DataFrame, evidence: DataFrame) -> DataFrame:
    """Symbol rows of a set of concepts, each with the number of its evidence links."""
    links = evidence.join(concepts.select("concept_id"), "concept_id", "left_semi")
    counts = links.groupBy("concept_id").agg(F.count(F.lit(1)).alias("n_evidence"))
    rows = concepts.join(symbols.select("concept_id", "namespace", "short_code"), "concept_id")
    return rows.join(counts, "concept_id", "left").fillna(0, ["n_evidence"])
