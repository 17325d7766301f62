"""Derivation patches as tables: normalise nodes and edges, then check them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import compact_text, summary_key, text_of
from ..functions.vocab import DERIVED_NODE_TYPES, EDGE_TYPES, NODE_TYPES, OPERATORS
from .ranking import first_per_key

# patch tables: nodes(derivation_id, position, symbol, node_type, expression, summary, supports, risks)
#               edges(derivation_id, position, source, target, relation)
#               ideas(derivation_id, symbol, derived_from); known(derivation_id, symbol)

OPERATOR_CALL = r"([A-Za-z_]+)\("


def unsupported_operators(expression: Column | str) -> Column:
    calls = F.regexp_extract_all(text_of(expression), F.lit(OPERATOR_CALL), F.lit(1))
    return F.filter(calls, lambda c: ~c.isin(OPERATORS))


def node_symbols(nodes: DataFrame, known: DataFrame) -> DataFrame:
    """A usable symbol for every node: blanks replaced, ``D<i>`` when empty, known or used before."""
    given = F.substring(F.regexp_replace(F.trim(text_of("symbol")), r"\s+", "_"), 1, 32)
    numbered = F.concat(F.lit("D"), F.col("position").cast("string"))
    rows = nodes.withColumn("symbol", F.when(given == "", numbered).otherwise(given))
    taken = known.select("derivation_id", "symbol").distinct().withColumn("_known", F.lit(True))
    first = rows.groupBy("derivation_id", "symbol").agg(F.min("position").alias("_first"))
    rows = rows.join(taken, ["derivation_id", "symbol"], "left").join(first, ["derivation_id", "symbol"])
    clash = F.coalesce("_known", F.lit(False)) | (F.col("position") > F.col("_first"))
    return rows.withColumn("symbol", F.when(clash, numbered).otherwise(F.col("symbol"))).drop("_known", "_first")


def node_supports(nodes: DataFrame, known: DataFrame) -> DataFrame:
    """(derivation_id, position, support, at): supports that are known or come earlier."""
    wanted = nodes.select("derivation_id", "position", F.posexplode("supports").alias("at", "support")).distinct()
    wanted = wanted.groupBy("derivation_id", "position", "support").agg(F.min("at").alias("at"))
    earlier = nodes.groupBy("derivation_id", F.col("symbol").alias("support")).agg(F.min("position").alias("_made"))
    base = known.select("derivation_id", F.col("symbol").alias("support")).distinct().withColumn("_known", F.lit(True))
    joined = wanted.join(earlier, ["derivation_id", "support"], "left").join(base, ["derivation_id", "support"], "left")
    kept = joined.filter(F.coalesce("_known", F.lit(False)) | (F.col("_made") < F.col("position")))
    return kept.drop("_made", "_known")


def normalize_nodes(nodes: DataFrame, known: DataFrame, defaults: DataFrame) -> DataFrame:
    """Nodes with allowed types and operators and usable supports; repeated summaries dropped.

    ``defaults`` (derivation_id, default_supports) fills in where a node names no
    usable support. A node's own support list is short, so it is nested again.
    """
    rows = node_symbols(nodes, known)
    rows = rows.withColumn(
        "node_type", F.when(F.col("node_type").isin(DERIVED_NODE_TYPES), F.col("node_type")).otherwise("derived_concept")
    )
    kept = node_supports(rows, known).groupBy("derivation_id", "position").agg(
        F.array_sort(F.collect_list(F.struct("at", "support"))).alias("_s")
    )
    rows = rows.drop("supports").join(kept, ["derivation_id", "position"], "left").join(defaults, "derivation_id", "left")
    names = F.transform("_s", lambda s: s["support"])
    empty = F.array().cast("array<string>")
    rows = rows.withColumn("supports", F.coalesce(names, "default_supports", empty)).drop("_s", "default_supports")
    expression = F.trim(text_of("expression"))
    composed = F.concat(F.lit("compose("), F.array_join("supports", ", "), F.lit(")"))
    bad = (expression == "") | (F.size(unsupported_operators(expression)) > 0)
    rows = rows.withColumn("expression", F.when(bad, composed).otherwise(expression))
    rows = rows.withColumn("summary", compact_text("summary", 520))
    return drop_repeated_summaries(rows)


def drop_repeated_summaries(nodes: DataFrame) -> DataFrame:
    """A repeated summary is rewritten once from the expression; a second repeat is dropped."""
    keyed = nodes.withColumn("_sig", summary_key("summary", 28))
    first = keyed.groupBy("derivation_id", "_sig").agg(F.min("position").alias("_first"))
    rows = keyed.join(first, ["derivation_id", "_sig"])
    again = F.col("position") > F.col("_first")
    rewritten = compact_text(F.concat_ws(": ", "expression", "summary"), 520)
    rows = rows.withColumn("summary", F.when(again, rewritten).otherwise(F.col("summary"))).drop("_sig", "_first")
    rows = rows.withColumn("_sig", summary_key("summary", 28))
    return first_per_key(rows, ["derivation_id", "_sig"], [F.asc("position")]).drop("_sig")


def normalize_edges(edges: DataFrame, symbols: DataFrame, supports: DataFrame) -> DataFrame:
    """Edges between existing symbols, one per (source, target), plus missing support edges.

    ``symbols`` holds (derivation_id, symbol) of known and new symbols, ``supports``
    holds (derivation_id, position, at, support, symbol).
    """
    ends = symbols.select("derivation_id", "symbol").distinct()
    kept = edges.filter("source <> target")
    for side in ("source", "target"):
        kept = kept.join(ends.withColumnRenamed("symbol", side), ["derivation_id", side], "left_semi")
    kept = first_per_key(kept, ["derivation_id", "source", "target"], [F.asc("position")])
    relation = F.coalesce(F.nullif("relation", F.lit("")), F.lit("supports"))
    kept = kept.select("derivation_id", "source", "target", relation.alias("relation"))
    extra = supports.select("derivation_id", F.col("support").alias("source"), F.col("symbol").alias("target")).distinct()
    extra = extra.join(kept, ["derivation_id", "source", "target"], "left_anti").withColumn("relation", F.lit("composes"))
    return kept.unionByName(extra)


def violations(nodes: DataFrame, edges: DataFrame, ideas: DataFrame, known: DataFrame) -> DataFrame:
    """Errors and warnings of all patches as rows (derivation_id, severity, rule, subject, detail)."""

    def rows(df: DataFrame, severity: str, rule: str, subject: Column, detail: Column) -> DataFrame:
        return df.select(
            "derivation_id", F.lit(severity).alias("severity"), F.lit(rule).alias("rule"),
            text_of(subject).alias("subject"), text_of(detail).alias("detail"),
        )

    none = F.lit("")
    named = nodes.withColumn("symbol", F.trim(text_of("symbol")))
    out = [rows(named.filter("symbol = ''"), "error", "missing_symbol", none, F.col("position"))]
    named = named.filter("symbol <> ''")
    base = known.select("derivation_id", "symbol").distinct()
    made = named.groupBy("derivation_id", "symbol").agg(F.min("position").alias("_made"))

    first = named.join(made, ["derivation_id", "symbol"])
    known_again = named.join(base, ["derivation_id", "symbol"], "left_semi")
    repeated = first.filter("position > _made").join(base, ["derivation_id", "symbol"], "left_anti")
    for again in (known_again, repeated):
        out.append(rows(again, "error", "duplicate_symbol", F.col("symbol"), F.col("position")))
    bad_type = named.filter(~F.coalesce(F.col("node_type").isin(NODE_TYPES), F.lit(False)))
    out.append(rows(bad_type, "error", "node_type", F.col("symbol"), F.col("node_type")))

    def unknown_refs(column: str) -> DataFrame:
        refs = named.select("derivation_id", "position", "symbol", F.explode(column).alias("ref"))
        refs = refs.join(base.withColumnRenamed("symbol", "ref"), ["derivation_id", "ref"], "left_anti")
        refs = refs.join(made.withColumnRenamed("symbol", "ref"), ["derivation_id", "ref"], "left")
        return refs.filter(F.col("_made").isNull() | (F.col("_made") > F.col("position")))

    out.append(rows(unknown_refs("supports"), "error", "unknown_support", F.col("symbol"), F.col("ref")))
    out.append(rows(unknown_refs("risks"), "warning", "unknown_risk", F.col("symbol"), F.col("ref")))
    calls = named.select("derivation_id", "symbol", F.explode(unsupported_operators("expression")).alias("call"))
    out.append(rows(calls, "error", "operator", F.col("symbol"), F.col("call")))

    everything = base.unionByName(made.select("derivation_id", "symbol")).distinct()
    for side in ("source", "target"):
        lost = edges.join(everything.withColumnRenamed("symbol", side), ["derivation_id", side], "left_anti")
        out.append(rows(lost, "error", f"unknown_{side}", F.col(side), F.col("position")))
    odd = edges.filter(~F.coalesce(F.col("relation").isin(EDGE_TYPES), F.lit(False)))
    out.append(rows(odd, "warning", "relation", F.col("relation"), F.col("position")))

    bare = ideas.filter(F.coalesce(F.size("derived_from"), F.lit(0)) <= 0)
    out.append(rows(bare, "error", "no_derived_from", F.col("symbol"), none))
    origins = ideas.select("derivation_id", "symbol", F.explode("derived_from").alias("ref"))
    lost = origins.join(everything.withColumnRenamed("symbol", "ref"), ["derivation_id", "ref"], "left_anti")
    out.append(rows(lost, "error", "unknown_origin", F.col("symbol"), F.col("ref")))

    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result


def verdicts(derivations: DataFrame, found: DataFrame) -> DataFrame:
    """ok / number of errors and warnings per derivation."""
    counts = found.groupBy("derivation_id").agg(
        F.count_if(F.col("severity") == "error").alias("n_errors"),
        F.count_if(F.col("severity") == "warning").alias("n_warnings"),
    )
    joined = derivations.select("derivation_id").distinct().join(counts, "derivation_id", "left").fillna(0)
    return joined.withColumn("ok", F.col("n_errors") == 0)


def expand_symbols(items: DataFrame, symbols: DataFrame) -> DataFrame:
    """List items that are little more than a symbol become ``code: gloss``.

    ``items`` holds (owner, pos, item), ``symbols`` holds (short_code, gloss).
    """
    pattern = r"^([A-Z][A-Z0-9_.\-]{1,31})(?:\s*[:：-]\s*)?(.*)$"
    rows = items.withColumn("item", F.trim("item"))
    rows = rows.withColumn("_code", F.regexp_extract("item", pattern, 1)).withColumn(
        "_rest", F.length(F.trim(F.regexp_extract("item", pattern, 2)))
    )
    joined = rows.join(symbols.select(F.col("short_code").alias("_code"), "gloss"), "_code", "left")
    short = F.col("gloss").isNotNull() & (F.col("_rest") < 32)
    text = F.when(short, F.concat_ws(": ", "_code", "gloss")).otherwise(F.col("item"))
    out = joined.filter("item <> ''").withColumn("item", compact_text(text, 900)).drop("_code", "_rest", "gloss")
    return first_per_key(out, ["owner", "item"], [F.asc("pos")])


def substantial(candidates: DataFrame, least: int = 80) -> DataFrame:
    """Candidates whose title, thesis, novelty and design together say enough."""
    fields = ["title", "thesis", "novelty", "design"]
    return candidates.filter(F.length(F.concat_ws(" ", *[F.nullif(F.trim(text_of(c)), F.lit("")) for c in fields])) >= least)
