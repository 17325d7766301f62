"""Derivations, lineage and principle relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vocab import EDGE_TYPES, NODE_TYPES, OPERATORS
from ..operators.derivation import node_supports, normalize_edges, normalize_nodes, substantial, verdicts, violations
from ..operators.lineage import (
    closure,
    depths,
    final_idea_depth,
    idea_lineage,
    layers,
    project_graph,
    repair_duplicate_summaries,
    visible_graph,
)
from ..operators.principles import principle_map, relations, value_hubs
from ..operators.views import type_counts
from . import duck
from .registry import query, table
from .standins import derivation_edges, derivation_nodes, works

# conversations read as patches: turn 0 is the known symbol T0, later turns are new nodes
PATCH = """
t AS (SELECT conv_id AS derivation_id, turn AS position, role, text, length(text) AS n FROM conversations),
known AS (SELECT derivation_id, 'T0' AS symbol FROM t WHERE position = 0),
nodes AS (SELECT derivation_id, position, 'T' || CASE WHEN n % 13 = 0 THEN 1 ELSE position END AS symbol,
  CASE WHEN n % 5 = 0 THEN role WHEN role = 'user' THEN 'derived_concept' ELSE 'argument' END AS node_type,
  CASE WHEN n % 7 = 0 THEN 'guess(T0)' WHEN n % 7 = 1 THEN '' ELSE 'compose(T0, T1)' END AS expression, text AS summary,
  ['T' || (position // 2), 'T' || (position + n % 3)] AS supports, ['T' || (n % 11)] AS risks FROM t WHERE position > 0),
edges AS (SELECT derivation_id, position, 'T' || (position - 1) AS source, 'T' || (position + CASE WHEN n % 4 = 0 THEN 1 ELSE 0 END) AS target,
  CASE n % 3 WHEN 0 THEN 'supports' WHEN 1 THEN 'composes' ELSE 'resembles' END AS relation FROM t WHERE position > 0),
ideas AS (SELECT derivation_id, 'I1' AS symbol, CASE WHEN n % 6 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['T' || (n % 9)] END AS derived_from FROM t WHERE position = 0),
made AS (SELECT derivation_id, symbol, min(position) AS made_at FROM nodes GROUP BY ALL),
everything AS (SELECT derivation_id, symbol FROM known UNION SELECT derivation_id, symbol FROM made)
"""


def _patch(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("derivation_id"), F.col("turn").alias("position"), "role", "text", F.length("text").alias("n")
    )
    name = lambda c: F.concat(F.lit("T"), c.cast("bigint").cast("string"))
    position = F.col("position")
    later = t.filter("position > 0")
    kind = F.when(F.col("n") % 5 == 0, F.col("role")).when(F.col("role") == "user", "derived_concept").otherwise("argument")
    expression = F.when(F.col("n") % 7 == 0, "guess(T0)").when(F.col("n") % 7 == 1, "").otherwise("compose(T0, T1)")
    nodes = later.select(
        "derivation_id", "position", name(F.when(F.col("n") % 13 == 0, 1).otherwise(position)).alias("symbol"), kind.alias("node_type"),
        expression.alias("expression"), F.col("text").alias("summary"),
        F.array(name(F.floor(position / 2)), name(position + F.col("n") % 3)).alias("supports"), F.array(name(F.col("n") % 11)).alias("risks"),
    )
    relation = F.when(F.col("n") % 3 == 0, "supports").when(F.col("n") % 3 == 1, "composes").otherwise("resembles")
    edges = later.select(
        "derivation_id", "position", name(position - 1).alias("source"),
        name(position + F.when(F.col("n") % 4 == 0, 1).otherwise(0)).alias("target"), relation.alias("relation"),
    )
    first = t.filter("position = 0")
    none = F.array().cast("array<string>")
    ideas = first.select(
        "derivation_id", F.lit("I1").alias("symbol"), F.when(F.col("n") % 6 == 0, none).otherwise(F.array(name(F.col("n") % 9))).alias("derived_from")
    )
    return nodes, edges, ideas, first.select("derivation_id", F.lit("T0").alias("symbol"))


def _in(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


VIOLATIONS = f"""{PATCH},
refs AS (SELECT derivation_id, position, symbol, unnest(supports) AS ref, 'error' AS severity, 'unknown_support' AS rule FROM nodes
         UNION ALL SELECT derivation_id, position, symbol, unnest(risks), 'warning', 'unknown_risk' FROM nodes),
calls AS (SELECT derivation_id, symbol, unnest(regexp_extract_all(expression, '([A-Za-z_]+)\\(', 1)) AS call FROM nodes),
origins AS (SELECT derivation_id, symbol, unnest(derived_from) AS ref FROM ideas),
found AS (
  SELECT derivation_id, 'error' AS severity, 'duplicate_symbol' AS rule, symbol AS subject, CAST(position AS VARCHAR) AS detail FROM nodes n JOIN made m USING (derivation_id, symbol)
   WHERE position > made_at OR EXISTS (SELECT 1 FROM known k WHERE k.derivation_id = n.derivation_id AND k.symbol = n.symbol)
  UNION ALL SELECT derivation_id, 'error', 'node_type', symbol, node_type FROM nodes WHERE node_type NOT IN ({_in(NODE_TYPES)})
  UNION ALL SELECT r.derivation_id, severity, rule, r.symbol, ref FROM refs r LEFT JOIN made m ON m.derivation_id = r.derivation_id AND m.symbol = r.ref
   WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.derivation_id = r.derivation_id AND k.symbol = r.ref) AND (m.made_at IS NULL OR m.made_at > r.position)
  UNION ALL SELECT derivation_id, 'error', 'operator', symbol, call FROM calls WHERE call NOT IN ({_in(OPERATORS)})
  UNION ALL SELECT derivation_id, 'error', 'unknown_source', source, CAST(position AS VARCHAR) FROM edges e WHERE NOT EXISTS (SELECT 1 FROM everything x WHERE x.derivation_id = e.derivation_id AND x.symbol = e.source)
  UNION ALL SELECT derivation_id, 'error', 'unknown_target', target, CAST(position AS VARCHAR) FROM edges e WHERE NOT EXISTS (SELECT 1 FROM everything x WHERE x.derivation_id = e.derivation_id AND x.symbol = e.target)
  UNION ALL SELECT derivation_id, 'warning', 'relation', relation, CAST(position AS VARCHAR) FROM edges WHERE relation NOT IN ({_in(EDGE_TYPES)})
  UNION ALL SELECT derivation_id, 'error', 'no_derived_from', symbol, '' FROM ideas WHERE len(derived_from) = 0
  UNION ALL SELECT derivation_id, 'error', 'unknown_origin', symbol, ref FROM origins o WHERE NOT EXISTS (SELECT 1 FROM everything x WHERE x.derivation_id = o.derivation_id AND x.symbol = o.ref))
"""


@query("derivation_violations", f"WITH {VIOLATIONS} SELECT * FROM found")
def derivation_violations(spark, sf_dir):
    return violations(*_patch(spark, sf_dir))


@query(
    "derivation_verdicts",
    f"""WITH {VIOLATIONS} SELECT derivation_id, count(*) FILTER (severity = 'error') AS n_errors, count(*) FILTER (severity = 'warning') AS n_warnings,
       count(*) FILTER (severity = 'error') = 0 AS ok FROM (SELECT DISTINCT derivation_id FROM t) LEFT JOIN found USING (derivation_id) GROUP BY derivation_id""",
)
def derivation_verdicts(spark, sf_dir):
    nodes, edges, ideas, known = _patch(spark, sf_dir)
    return verdicts(known, violations(nodes, edges, ideas, known))


SUPPORTS = f"""{PATCH}, w AS (SELECT derivation_id, position, symbol, unnest(supports) AS support, generate_subscripts(supports, 1) - 1 AS sup_at FROM nodes),
kept AS (SELECT w.derivation_id, position, w.support, min(w.sup_at) AS sup_at FROM w LEFT JOIN made m ON m.derivation_id = w.derivation_id AND m.symbol = w.support
         WHERE m.made_at < position OR EXISTS (SELECT 1 FROM known k WHERE k.derivation_id = w.derivation_id AND k.symbol = w.support) GROUP BY ALL)
"""


@query("patch_supports", f"WITH {SUPPORTS} SELECT derivation_id, position, support, CAST(sup_at AS INTEGER) AS place FROM kept")
def patch_supports(spark, sf_dir):
    nodes, _, _, known = _patch(spark, sf_dir)
    return node_supports(nodes, known).select("derivation_id", "position", "support", F.col("at").alias("place"))


@query(
    "patch_edges",
    f"""WITH {SUPPORTS}, ne AS (SELECT derivation_id, source, target, arg_min(relation, position) AS relation FROM edges e WHERE source <> target
  AND EXISTS (SELECT 1 FROM everything x WHERE x.derivation_id = e.derivation_id AND x.symbol = e.source)
  AND EXISTS (SELECT 1 FROM everything x WHERE x.derivation_id = e.derivation_id AND x.symbol = e.target) GROUP BY derivation_id, source, target),
extra AS (SELECT DISTINCT k.derivation_id, support AS source, symbol AS target FROM kept k JOIN nodes USING (derivation_id, position))
SELECT * FROM ne UNION ALL SELECT derivation_id, source, target, 'composes' FROM extra ANTI JOIN ne USING (derivation_id, source, target)""",
)
def patch_edges(spark, sf_dir):
    nodes, edges, _, known = _patch(spark, sf_dir)
    supports = node_supports(nodes, known).join(nodes.select("derivation_id", "position", "symbol"), ["derivation_id", "position"])
    symbols = known.unionByName(nodes.select("derivation_id", "symbol"))
    return normalize_edges(edges, symbols, supports)


@query("patch_nodes")
def patch_nodes(spark, sf_dir):
    nodes, _, _, known = _patch(spark, sf_dir)
    defaults = known.select("derivation_id", F.array("symbol").alias("default_supports"))
    out = normalize_nodes(nodes, known, defaults)
    return out.select("derivation_id", "position", "symbol", "node_type", "expression", F.array_join("supports", ",").alias("supports"), "summary")


@query(
    "candidate_substance",
    f"""WITH {duck.WORKS} SELECT doc_id FROM works WHERE length(concat_ws(' ', nullif(trim(title), ''), nullif(trim(lang), ''), nullif(trim(source), ''))) >= 80""",
)
def candidate_substance(spark, sf_dir):
    rows = works(spark, sf_dir).select("doc_id", "title", F.col("lang").alias("thesis"), F.col("source").alias("novelty"), F.lit("").alias("design"))
    return substantial(rows).select("doc_id")


# ---------------------------------------------------------------- lineage

EDGES = """e AS (SELECT DISTINCT conv_id AS derivation_id, turn AS target, s AS source, length(text) AS n FROM conversations, (VALUES (0), (1)) v(i), LATERAL (SELECT CASE WHEN i = 0 THEN turn - 1 ELSE turn // 2 END AS s) WHERE turn > 0)"""


@query(
    "lineage_depth",
    f"""WITH RECURSIVE {EDGES},
walk AS (SELECT conv_id AS derivation_id, turn AS node_id, CAST(CASE WHEN turn = 0 THEN 0 ELSE 1 END AS INTEGER) AS depth FROM conversations
         UNION SELECT w.derivation_id, e.target, w.depth + 1 FROM walk w JOIN e ON e.derivation_id = w.derivation_id AND e.source = w.node_id)
SELECT derivation_id, node_id, max(depth) AS depth FROM walk GROUP BY ALL""",
)
def lineage_depth(spark, sf_dir):
    nodes = derivation_nodes(spark, sf_dir).select(
        "derivation_id", "node_id", (F.col("node_id") == 0).alias("is_source"), F.lit(0).alias("declared_depth")
    )
    return depths(nodes, derivation_edges(spark, sf_dir))


def _shown(spark, sf_dir):
    turns = derivation_nodes(spark, sf_dir)
    nodes = turns.withColumn("node_type", F.when(F.length("text") % 11 == 0, "final_idea").otherwise("argument"))
    odd = turns.filter(F.length("text") % 3 == 1).select("derivation_id", F.col("node_id").alias("target"))
    return nodes, derivation_edges(spark, sf_dir).join(odd, ["derivation_id", "target"])


SHOWN = f"""{EDGES}, ed AS (SELECT derivation_id, source, target FROM e WHERE n % 3 = 1),
nd AS (SELECT conv_id AS derivation_id, turn AS node_id, length(text) % 11 = 0 AS final FROM conversations),
vis AS (SELECT derivation_id, node_id FROM nd n WHERE final OR EXISTS (SELECT 1 FROM ed WHERE ed.derivation_id = n.derivation_id AND n.node_id IN (ed.source, ed.target)))
"""


@query("lineage_visible", f"WITH {SHOWN} SELECT * FROM vis")
def lineage_visible(spark, sf_dir):
    return visible_graph(*_shown(spark, sf_dir))[0].select("derivation_id", "node_id")


@query(
    "idea_lineage",
    f"""WITH {SHOWN}, c AS (SELECT role AS concept_id, conv_id AS derivation_id FROM conversations WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY role ORDER BY conv_id DESC, turn DESC) = 1)
SELECT derivation_id, source, target FROM ed WHERE derivation_id IN (SELECT derivation_id FROM c)""",
)
def idea_lineage_query(spark, sf_dir):
    nodes, edges = _shown(spark, sf_dir)
    nodes = nodes.withColumn("concept_id", F.col("role")).withColumn("seq", F.col("derivation_id"))
    ideas = nodes.filter("role = 'assistant'").select(F.col("role").alias("idea_id")).distinct()
    return idea_lineage(ideas, nodes, edges)[1].select("derivation_id", "source", "target")


@query(
    "lineage_layers",
    """WITH d AS (SELECT conv_id AS derivation_id, turn AS node_order, length(text) % 4 AS depth FROM conversations)
SELECT derivation_id, node_order, depth, dense_rank() OVER (PARTITION BY derivation_id ORDER BY depth) AS layer, row_number() OVER (PARTITION BY derivation_id, depth ORDER BY node_order) AS place FROM d""",
)
def lineage_layers(spark, sf_dir):
    nodes = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("derivation_id"), F.col("turn").alias("node_order"), (F.length("text") % 4).cast("bigint").alias("depth")
    )
    return layers(nodes).select("derivation_id", "node_order", "depth", "layer", "place")


@query(
    "final_idea_depth",
    """WITH p AS (SELECT conv_id AS idea_id, conv_id AS derivation_id, CASE WHEN turn > 0 THEN turn END AS node_id FROM conversations)
SELECT idea_id, CAST(1 + coalesce(max(node_id), 1) AS BIGINT) AS depth FROM p GROUP BY idea_id""",
)
def final_idea_depth_query(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    parents = turns.select(F.col("conv_id").alias("idea_id"), F.col("conv_id").alias("derivation_id"), F.when(F.col("turn") > 0, F.col("turn")).alias("node_id"))
    known = turns.select(F.col("conv_id").alias("derivation_id"), F.col("turn").alias("node_id"), F.col("turn").alias("depth"))
    return final_idea_depth(parents, known)


@query(
    "duplicate_summaries",
    """WITH n AS (SELECT conv_id, turn, role, 'T' || turn AS sym, length(text) % 2 = 0 AS derived FROM conversations),
c AS (SELECT conv_id, role, count(*) FILTER (derived) AS k FROM n GROUP BY ALL),
g AS (SELECT n.*, k, (SELECT x.role FROM n x WHERE x.conv_id = n.conv_id AND x.turn = 0) AS g0, (SELECT x.role FROM n x WHERE x.conv_id = n.conv_id AND x.turn = 1) AS g1 FROM n JOIN c USING (conv_id, role))
SELECT conv_id AS derivation_id, turn AS node_id, CASE WHEN k > 1 THEN sym || ' applies mechanism composition to T0, T1: ' || coalesce(g0, 'T0') || '; ' || coalesce(g1, 'T1') || '.' ELSE role END AS summary FROM g""",
)
def duplicate_summaries(spark, sf_dir):
    nodes = derivation_nodes(spark, sf_dir).select(
        "derivation_id", "node_id", F.concat(F.lit("T"), "node_id").alias("symbol"), F.col("role").alias("summary"),
        F.when(F.length("text") % 2 == 0, "argument").otherwise("principle").alias("node_type"), F.lit('mechanism_composition(T0, "T1")').alias("expression"),
    )
    return repair_duplicate_summaries(nodes).select("derivation_id", "node_id", "summary")


@query(
    "idea_to_work_closure",
    """WITH p AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem), s AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem),
r AS (SELECT o_orderkey AS origin, 'O' || o_orderkey AS node, 0 AS hops FROM orders
  UNION ALL SELECT o, 'P' || p, 1 FROM p JOIN orders ON o_orderkey = o UNION ALL SELECT DISTINCT o, 'S' || s, 2 FROM p JOIN orders ON o_orderkey = o JOIN s USING (p))
SELECT * FROM r""",
)
def idea_to_work_closure(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    # nodes are numbers until the end: four times the key and the kind
    number = lambda kind, c: F.col(c).cast("bigint") * 4 + kind
    starts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("origin"), number(0, "o_orderkey").alias("node"))
    uses = lines.select(number(0, "l_orderkey").alias("node"), number(1, "l_partkey").alias("next"))
    source = lines.select(number(1, "l_partkey").alias("node"), number(2, "l_suppkey").alias("next"))
    name = F.concat(F.element_at(F.array(*map(F.lit, "OPS")), (F.pmod("node", F.lit(4)) + 1).cast("int")), F.shiftright("node", 2).cast("string"))
    return closure(starts, uses.unionByName(source)).select("origin", name.alias("node"), "hops")


GRAPH_NODES = """SELECT 'field' AS type, CAST(n_nationkey AS VARCHAR) AS id, n_name AS label FROM nation UNION ALL SELECT 'work', CAST(s_suppkey AS VARCHAR), s_name FROM supplier
UNION ALL SELECT 'principle', CAST(p_partkey AS VARCHAR), p_name FROM part UNION ALL SELECT 'idea', CAST(o_orderkey AS VARCHAR), o_orderpriority FROM orders"""


def _graph(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem")
    parts = [
        ("field", t("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label"))),
        ("work", t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("label"))),
        ("principle", t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"))),
        ("idea", t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("label"))),
    ]
    edges = [
        ("contains", t("supplier").select(F.col("s_nationkey").alias("source"), F.col("s_suppkey").alias("target"))),
        ("grounds", lines.select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"))),
        ("inspires", lines.select(F.col("l_partkey").alias("source"), F.col("l_orderkey").alias("target"))),
    ]
    return project_graph(parts, edges)


@query("project_graph_nodes", GRAPH_NODES)
def project_graph_nodes(spark, sf_dir):
    return _graph(spark, sf_dir)[0]


@query(
    "project_graph_edges",
    """SELECT 'contains' AS type, CAST(s_nationkey AS VARCHAR) AS source, CAST(s_suppkey AS VARCHAR) AS target FROM supplier
UNION ALL SELECT DISTINCT 'grounds', CAST(l_suppkey AS VARCHAR), CAST(l_partkey AS VARCHAR) FROM lineitem UNION ALL SELECT DISTINCT 'inspires', CAST(l_partkey AS VARCHAR), CAST(l_orderkey AS VARCHAR) FROM lineitem""",
)
def project_graph_edges(spark, sf_dir):
    return _graph(spark, sf_dir)[1]


@query("graph_type_counts", f"SELECT type, count(*) AS n FROM ({GRAPH_NODES}) GROUP BY type")
def graph_type_counts(spark, sf_dir):
    return type_counts(_graph(spark, sf_dir)[0])


# ---------------------------------------------------------------- principles


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("principle_id"), "p_size", F.array("p_brand").alias("relation_hints"), F.array("p_type").alias("domain_tags"), F.array("p_name").alias("tradeoffs")
    )


VALUES = """v AS (SELECT p_partkey AS principle_id, 'relation_hints' AS field, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'domain_tags', p_type FROM part UNION ALL SELECT p_partkey, 'tradeoffs', p_name FROM part)"""


@query(
    "principle_relation_hubs",
    f"""WITH {VALUES}, s AS (SELECT field, value, count(*) AS n_holders, min(principle_id) AS first_holder FROM v GROUP BY ALL)
SELECT principle_id, field, value, n_holders, first_holder FROM v JOIN s USING (field, value) WHERE n_holders > 1""",
)
def principle_relation_hubs(spark, sf_dir):
    return value_hubs(_parts(spark, sf_dir))


@query(
    "principle_relations",
    f"""WITH {VALUES}, b AS (SELECT p_partkey AS id FROM part WHERE p_size = (SELECT max(p_size) FROM part)),
pairs AS (SELECT DISTINCT least(x.principle_id, y.principle_id) AS source_id, greatest(x.principle_id, y.principle_id) AS target_id, x.field, x.value
          FROM v x JOIN b ON b.id = x.principle_id JOIN v y ON y.field = x.field AND y.value = x.value AND y.principle_id <> x.principle_id)
SELECT source_id, target_id, coalesce(min(value) FILTER (field = 'relation_hints'), 'shares_structure') AS relation_type, count(*) AS n_shared FROM pairs GROUP BY 1, 2""",
)
def principle_relations(spark, sf_dir):
    parts = _parts(spark, sf_dir)
    largest = parts.agg(F.max("p_size").alias("p_size"))
    return relations(parts, parts.join(largest, "p_size", "left_semi"))


@query(
    "principle_map",
    f"""WITH {duck.WORKS}, a AS (SELECT doc_id, unnest(list_distinct({duck.tokens("title || ' ' || abstract")})) AS tok FROM works),
b AS (SELECT item_id, list_distinct({duck.tokens("text")}) AS ts FROM benchmark), bt AS (SELECT item_id, len(ts) AS n, unnest(ts) AS tok FROM b)
SELECT 'D' || doc_id AS prior_id, 'B' || item_id AS new_id, count(*) AS n_shared, count(*) / any_value(n) AS share FROM a JOIN bt USING (tok) GROUP BY doc_id, item_id HAVING count(*) / any_value(n) >= 0.2::DOUBLE""",
)
def principle_map_query(spark, sf_dir):
    prior = works(spark, sf_dir).select(F.concat(F.lit("D"), "doc_id").alias("id"), F.concat_ws(" ", "title", "abstract").alias("body"))
    new = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("B"), "item_id").alias("id"), F.col("text").alias("body"))
    return principle_map(prior, new)[1].select("prior_id", "new_id", "n_shared", "share")
