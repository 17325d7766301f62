import random

from pyspark.sql import functions as F

from loomcite.operators.budget import first_breach, guard, guard_long
from loomcite.operators.derivation import expand_symbols, normalize_nodes, verdicts, violations
from loomcite.operators import lineage
from loomcite.operators.lineage import closure, depths, visible_graph
from loomcite.operators.membership import delete_deep, deleted_counts, sort_key
from loomcite.operators.principles import principle_map, relations
from loomcite.operators.retention import retained
from loomcite.operators.runs import stale_runs
from loomcite.session import durable

NODES = "derivation_id int, position int, symbol string, node_type string, expression string, summary string, supports array<string>, risks array<string>"
EDGES = "derivation_id int, position int, source string, target string, relation string"
IDEAS = "derivation_id int, symbol string, derived_from array<string>"


def patch(spark, nodes, edges=(), ideas=()):
    known = spark.createDataFrame([(1, "P.A")], "derivation_id int, symbol string")
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(list(edges), EDGES), spark.createDataFrame(list(ideas), IDEAS), known


def test_verifier_rules(spark):
    nodes = [
        (1, 1, "D1", "argument", "compose(P.A)", "s", ["P.A", "D1"], ["R9"]),
        (1, 2, "D1", "argument", "conjure(P.A)", "s", ["D7"], []),
        (1, 3, "", "argument", "", "s", [], []),
        (1, 4, "P.A", "nonsense", "", "s", ["D5"], []),
        (1, 5, "D5", "argument", "", "s", [], []),
    ]
    edges = [(1, 1, "P.A", "D1", "supports"), (1, 2, "zz", "D1", "resembles")]
    ideas = [(1, "I1", []), (1, "I2", ["D1", "none"])]
    found = {(r.severity, r.rule, r.subject, r.detail) for r in violations(*patch(spark, nodes, edges, ideas)).collect()}
    assert found == {
        ("error", "missing_symbol", "", "3"), ("error", "duplicate_symbol", "D1", "2"), ("error", "duplicate_symbol", "P.A", "4"),
        ("error", "node_type", "P.A", "nonsense"), ("error", "unknown_support", "D1", "D7"), ("error", "unknown_support", "P.A", "D5"),
        ("warning", "unknown_risk", "D1", "R9"), ("error", "operator", "D1", "conjure"), ("error", "unknown_source", "zz", "2"),
        ("warning", "relation", "resembles", "2"), ("error", "no_derived_from", "I1", ""), ("error", "unknown_origin", "I2", "none"),
    }
    clean = patch(spark, [(1, 1, "D1", "argument", "compose(P.A)", "s", ["P.A"], [])], [], [(1, "I", ["D1"])])
    assert verdicts(clean[3], violations(*clean)).first().ok


def test_normalize_nodes(spark):
    nodes = [
        (1, 1, "D 1", "spell", "conjure(x)", "one two", ["P.A", "D9"], []),
        (1, 2, "D_1", "argument", "compose(P.A)", "other text", [], []),
        (1, 3, "D3", "argument", "compose(D_1)", "one two", ["D_1", "D3"], []),
    ]
    rows, _, _, known = patch(spark, nodes)
    defaults = known.select("derivation_id", F.array("symbol").alias("default_supports"))
    got = {r.position: r for r in normalize_nodes(rows, known, defaults).collect()}
    assert (got[1].symbol, got[1].node_type, got[1].expression, got[1].supports) == ("D_1", "derived_concept", "compose(P.A)", ["P.A"])
    assert got[2].symbol == "D2" and got[2].supports == ["P.A"]
    assert got[3].supports == ["D_1"] and got[3].summary == "compose(D_1): one two"


def test_expand_symbols(spark):
    items = spark.createDataFrame([(1, 0, "P.A"), (1, 1, "P.A: a long explanation that goes on and on"), (1, 2, "free text")], "owner int, pos int, item string")
    symbols = spark.createDataFrame([("P.A", "gloss")], "short_code string, gloss string")
    got = [r.item for r in expand_symbols(items, symbols).orderBy("pos").collect()]
    assert got == ["P.A: gloss", "P.A: a long explanation that goes on and on", "free text"]


def test_depths_and_visible_graph(spark):
    nodes = spark.createDataFrame([(1, "s", True, 0), (1, "a", False, 0), (1, "b", False, 5), (1, "c", False, 0), (1, "x", False, 0)], "derivation_id int, node_id string, is_source boolean, declared_depth int")
    edges = spark.createDataFrame([(1, "s", "a"), (1, "a", "b"), (1, "b", "c"), (1, "s", "c"), (1, "a", "a")], "derivation_id int, source string, target string")
    assert {r.node_id: r.depth for r in depths(nodes, edges).collect()} == {"s": 0, "a": 1, "b": 5, "c": 6, "x": 1}
    typed = nodes.withColumn("node_type", F.when(F.col("node_id") == "x", "final_idea").otherwise("argument"))
    shown, kept = visible_graph(typed, edges.filter("target = 'a'"))
    assert sorted(r.node_id for r in shown.collect()) == ["a", "s", "x"] and kept.count() == 2


def test_closure(spark):
    starts = spark.createDataFrame([("o", "a")], "origin string, node string")
    steps = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "a")], "node string, next string")
    assert {r.node: r.hops for r in closure(starts, steps).collect()} == {"a": 0, "b": 1, "c": 1}


def test_principle_relations_and_map(spark):
    rows = [("l", ["shares_pressure"], ["sparse"], ["t"]), ("r", ["shares_pressure"], ["sparse"], ["t"]), ("z", [], ["sparse"], [])]
    df = spark.createDataFrame(rows, "principle_id string, relation_hints array<string>, domain_tags array<string>, tradeoffs array<string>")
    got = {(r.source_id, r.target_id): (r.relation_type, r.n_shared) for r in relations(df, df).collect()}
    assert got == {("l", "r"): ("shares_pressure", 3), ("l", "z"): ("shares_structure", 1), ("r", "z"): ("shares_structure", 1)}
    prior = spark.createDataFrame([("P", "Camera pose recovery with depth priors")], "id string, body string")
    new = spark.createDataFrame([("N", "Alpha beta transfer gate")], "id string, body string")
    nodes, edges = principle_map(prior, new)
    assert [r.type for r in nodes.collect()] == ["new_principle"] and edges.count() == 0


def greedy(rows, limit):
    spent, out = {}, {}
    for run, seq, cost in sorted(rows):
        ok = spent.get(run, 0) + cost <= limit
        spent[run] = spent.get(run, 0) + (cost if ok else 0)
        out[(run, seq)] = ok
    return out


def test_budget_guard_long_runs_equal_the_fold(spark):
    rng = random.Random(5)
    for limit, top in ((100, 120), (37, 9)):
        rows = [(run, seq, rng.randint(1, top)) for run in range(5) for seq in range(rng.randint(1, 60))]
        df = spark.createDataFrame(rows, "run_id int, seq int, cost int").repartition(3)
        expected = greedy(rows, limit)
        assert {(r.run_id, r.seq): r.accepted for r in guard(df, limit).collect()} == expected
        assert {(r.run_id, r.seq): r.accepted for r in guard_long(df, limit).collect()} == expected
    breach = first_breach(spark.createDataFrame([(1, 1, 5), (1, 2, 6), (1, 3, 1)], "run_id int, seq int, cost int"), 10).collect()
    assert [(r.run_id, r.seq, r.spent) for r in breach] == [(1, 2, 11)]


def test_deep_delete(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    member = make([("a", "concept", "c1"), ("a", "concept", "c2"), ("b", "concept", "c2"), ("a", "work", "w1"), ("a", "work", "w2")], "project_id string, record_type string, record_id string")
    tables = {
        "membership": member, "concept": make([("c1",), ("c2",)], "concept_id string"), "symbol": make([("c1",)], "concept_id string"),
        "evidence": make([("c1", "w1"), ("c2", "w2")], "concept_id string, work_id string"), "concept_version": make([("c1",), ("c1",)], "concept_id string"),
        "work": make([("w1",), ("w2",)], "work_id string"),
    }
    got = {r.table_name: r.n_deleted for r in deleted_counts(delete_deep(tables, make([("a",)], "project_id string"))).collect()}
    # w2 stays: evidence of a concept that stays still cites it
    assert got == {"membership": 4, "concept": 1, "symbol": 1, "evidence": 1, "concept_version": 2, "work": 1}


def test_retention_keeps_highlighted_and_used(spark):
    rows = [("ideas", f"i{n}", n == 0, 5 if n == 1 else 0, f"2024-01-{n + 1:02d}") for n in range(6)] + [("goals", "g", False, 0, "")]
    df = spark.createDataFrame(rows, "bucket string, id string, highlighted boolean, usage_count int, recency string")
    assert sorted(r.id for r in retained(df, {"ideas": 3}).collect()) == ["g", "i0", "i1", "i5"]


def test_tab_sort_modes(spark):
    rows = [("OLD", "2024", 0.9, 2022, "arXiv"), ("NEW", "2026", 0.1, 2026, "arXiv"), ("VENUE", "2025", 0.2, 2023, "NeurIPS")]
    df = spark.createDataFrame(rows, "record_id string, modified string, relevance double, work_year int, venue string")
    first = {m: df.orderBy(*sort_key(m)).first().record_id for m in ("modified", "relevance", "work_year", "composite")}
    assert first == {"modified": "NEW", "relevance": "OLD", "work_year": "NEW", "composite": "VENUE"}


def test_stale_runs(spark):
    df = spark.createDataFrame([(1, "running", "2024-01-01 00:00:00"), (2, "running", "2024-01-01 09:59:00"), (3, "complete", "2024-01-01 00:00:00")], "run_id int, status string, t string")
    status = df.withColumn("updated_at", F.to_timestamp("t"))
    got = {r.run_id: r.status for r in stale_runs(status, F.to_timestamp(F.lit("2024-01-01 10:00:00")), 3600).collect()}
    assert got == {1: "partial_error", 2: "running", 3: "complete"}


def test_fractions_of_costs_reach_the_guard(spark):
    calls = spark.createDataFrame([("r", k, 0.9) for k in range(3)] + [("s", k, 0.1) for k in range(12)], "run_id string, seq bigint, cost double")
    found = {(r.run_id, r.seq): (r.cost, r.accepted) for r in guard(calls, 1).collect()}
    assert [found["r", k] for k in range(3)] == [(0.9, True), (0.9, False), (0.9, False)]
    assert [found["s", k][1] for k in range(12)] == [True] * 10 + [False] * 2


def test_finished_job_makes_way_for_the_next(spark):
    from loomcite.streaming.run_log import accepted_jobs, job_runs

    schema = "work_id string, project_id string, run_id string, status string, seq bigint"
    rows = [("w", "p", "1", "running", 1), ("w", "p", "1", "complete", 2), ("w", "p", "2", "queued", 3), ("w", "p", "3", "queued", 4), ("v", "p", "4", "error", 5)]
    found = {r.work_id: (r.active_run_id, r.n_requests) for r in accepted_jobs(job_runs(spark.createDataFrame(rows, schema))).collect()}
    assert found == {"w": ("2", 2), "v": (None, 0)}


def test_principle_map_has_every_pair_that_shares_enough(spark):
    rng = random.Random(5)
    words = [f"w{chr(97 + k % 26)}{k}" for k in range(60)]
    say = lambda: " ".join(["every", "other", *rng.choices(words, [1 / (k + 1) for k in range(60)], k=rng.randint(0, 20))])
    prior = [(f"p{k}", say()) for k in range(60)] + [("same", "every other"), ("none", "")]
    new = [(f"n{k}", say()) for k in range(25)] + [("short", "every"), ("empty", "")]
    frame = lambda rows: spark.createDataFrame(rows, "id string, body string").repartition(3)
    for least in (0.2, 0.5, 1.0):
        expected = {}
        for n, b in new:
            mine = set(b.split())
            for p, c in prior:
                shared = len(mine & set(c.split()))
                if mine and shared / len(mine) >= least:
                    expected[p, n] = shared
        found = {(r.prior_id, r.new_id): r.n_shared for r in principle_map(frame(prior), frame(new), least)[1].collect()}
        assert found == expected


def test_closure_writes_no_row_for_a_last_node(spark, monkeypatch):
    written = []
    monkeypatch.setattr(lineage, "durable", lambda df: written.append(durable(df)) or written[-1])
    starts = spark.range(20).select(F.col("id").alias("origin"), (F.col("id") * 4).alias("node"))
    uses = spark.range(20).select((F.col("id") * 4).alias("node"), (F.col("id") % 5 * 4 + 1).alias("next"))
    source = spark.range(5).select((F.col("id") * 4 + 1).alias("node"), F.explode(F.sequence(F.lit(0), F.lit(2999))).alias("s")).select("node", (F.col("s") * 4 + 2).cast("bigint").alias("next"))
    # a start that leads nowhere, and a last node that is reached by two ways
    starts = starts.unionByName(spark.createDataFrame([(99, 3)], starts.schema))
    steps = uses.unionByName(source).unionByName(spark.createDataFrame([(0, 2)], uses.schema))
    rows = {(r.origin, r.node): r.hops for r in closure(starts, steps).collect()}
    assert len(rows) == 20 * 3002 + 1 and rows[99, 3] == 0 and rows[0, 2] == 1 and rows[1, 2] == rows[0, 6] == 2 and rows[7, 9] == 1
    assert max(df.count() for df in written if "origin" in df.columns) <= 41


def test_relations_shuffle_no_pair(spark):
    rows = [(i, ["h1", "h2"] if i % 2 else [], ["d"], [f"t{i % 3}", "d"]) for i in range(30)]
    df = spark.createDataFrame(rows, "principle_id int, relation_hints array<string>, domain_tags array<string>, tradeoffs array<string>")
    out = relations(df, df.filter("principle_id % 7 = 0"))
    expected = {}
    for a in range(30):
        for b in range(a + 1, 30):
            if a % 7 == 0 or b % 7 == 0:
                hints = a % 2 and b % 2
                expected[a, b] = ("h1" if hints else "shares_structure", 2 * hints + 2 + (a % 3 == b % 3))
    got = [(r.source_id, r.target_id, r.relation_type, r.n_shared) for r in out.collect()]
    assert len(got) == len(expected) and {(a, b): (t, n) for a, b, t, n in got} == expected
    assert "source_id" not in "".join(x for x in out._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x)
