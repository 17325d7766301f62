import math
import random

from pyspark.sql import functions as F

from loomcite.functions.text import tokenize
from loomcite.plans import concept_plans
from loomcite.plans.standins import cited, sentence_events
from loomcite.operators.concepts import canonical_method_name, fold_concepts, merge_aliases, merge_evidence_spans, merge_near_duplicates, merge_principle_lists, merge_principles, presented_variant, typed_families
from loomcite.operators.evidence import repair_links
from loomcite.operators.evidence import concept_links
from loomcite.operators.feedback import STEPS, failure_modes, folded_steps, idea_status, principle_state, step
from loomcite.operators.folds import insert_if_absent
from loomcite.operators.ranking import ordinal, page, top_per_group
from loomcite.operators.symbols import abbreviation, allocate


def test_fold_concepts_equals_sequential_fold(spark):
    rng = random.Random(3)
    rows = [(f"k{rng.randrange(4)}", i, f"L{i}", round(rng.random(), 1), f"v{i}") for i in range(60)]
    state = {}
    for key, seq, label, conf, version in rows:
        old = state.get(key)
        if old is None:
            state[key] = [label, conf, version]
        else:
            state[key] = [label, max(old[1], conf), version if conf >= old[1] else old[2]]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "canonical_key string, seq int, label string, confidence double, version_id string")
    df = df.withColumn("concept_type", F.lit("principle")).withColumn("scope", F.lit("s")).withColumn("concept_id", F.col("canonical_key")).repartition(4)
    got = {r.canonical_key: [r.label, r.confidence, r.active_version_id] for r in fold_concepts(df).collect()}
    assert got == state


def test_merge_principles(spark):
    schema = "seq int, principle_id string, name string, mechanism string, model_mode string, model_name string, objective string, domain_tags array<string>, evidence_spans array<string>, confidence double"
    rows = [
        (1, "P1", "Gate", "route", "auto", "m", "ab", ["x"], [f"s{i}" for i in range(8)], 0.3),
        (2, "P2", " gate ", "Route", "auto", "m", "cd", ["y", "x"], [f"s{i}" for i in range(6, 16)], 0.7),
        (3, "P3", "gate", "route", "auto", "m", "longer", [], [], 0.5),
    ]
    df = spark.createDataFrame(rows, schema)
    merged = merge_principles(df).collect()
    assert len(merged) == 1
    row = merged[0]
    assert (row.principle_id, row.name, row.objective, row.confidence, row.n_merged) == ("P1", "Gate", "longer", 0.7, 3)
    assert row.mechanism == "route"
    lists = merge_principle_lists(df).orderBy("seq", "pos").collect()
    assert [r.value for r in lists if r.field == "domain_tags"] == ["x", "y"]
    assert merge_evidence_spans(df).count() == 12


def test_near_duplicates_and_aliases(spark):
    rows = [(1, "W1", "ARCANE routes multi-step reasoning", 0.7), (2, "W2", "ARCANE routes multi-step reason- ing", 0.6), (3, "W3", "else", 0.1)]
    df = spark.createDataFrame(rows, "seq int, work_id string, core_idea string, confidence double")
    got = sorted((r.n_merged, r.work_id, r.confidence) for r in merge_near_duplicates(df, "core_idea").collect())
    assert got == [(1, "W3", 0.1), (2, "W1", 0.7)]
    names = ["Logic-LM: Empowering Large Models", "Logic-LM (Proposed)", "state-of-the-art test-time prompt tuning method TPT"]
    df = spark.createDataFrame([(i, n, 0.5) for i, n in enumerate(names)], "seq int, baseline_name string, confidence double")
    assert [r.v for r in df.select(canonical_method_name("baseline_name").alias("v")).collect()] == ["Logic-LM", "Logic-LM", "TPT"]
    assert sorted(r.baseline_name for r in merge_aliases(df).collect()) == ["Logic-LM", "TPT"]


def test_typed_families_keep_own_sources_of_principles(spark):
    schema = "work_id string, title string, principles array<map<string,string>>, baselines array<map<string,string>>"
    df = spark.createDataFrame([("W1", "T", [{"name": "a", "source_works": "W8, W9"}, None, {"name": "b"}], [{"baseline_name": "x"}])], schema)
    got = sorted((r.concept_type, r.source_work_ids) for r in typed_families(df).collect())
    assert got == [("baseline", ["W1"]), ("principle", ["W1"]), ("principle", ["W8", "W9"])]


def test_manual_edit_stays_presented(spark):
    rows = [("r", "m1", 1, False), ("r", "m1", 2, True), ("r", "m2", 3, False), ("q", "m1", 1, False), ("q", "m2", 2, False)]
    df = spark.createDataFrame(rows, "record_id string, model string, seq int, is_manual boolean")
    assert {r.record_id: r.seq for r in presented_variant(df).collect()} == {"r": 2, "q": 2}


def test_evidence_repair(spark):
    rows = [(1, "W1", "V1"), (2, "W1", "V9"), (3, "W9", "V1"), (4, None, "V1"), (5, "W1", None)]
    links = spark.createDataFrame(rows, "id int, work_id string, work_version_id string")
    works = spark.createDataFrame([("W1",)], "work_id string")
    versions = spark.createDataFrame([("V1",)], "work_version_id string")
    got = {r.id: (r.work_id, r.work_version_id) for r in repair_links(links, works, versions).collect()}
    assert got == {1: ("W1", "V1"), 2: ("W1", None), 3: (None, None), 4: (None, "V1"), 5: ("W1", None)}


def test_insert_if_absent(spark):
    current = spark.createDataFrame([("a",)], "k string")
    rows = spark.createDataFrame([("a", 1), ("b", 3), ("b", 2)], "k string, seq int")
    assert [tuple(r) for r in insert_if_absent(current, rows, ["k"]).collect()] == [("b", 2)]


def test_ordinal_matches_row_number_on_a_skewed_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), (F.col("id") * 7919 % 5003).alias("v"))
    df = df.repartition(7)
    expected = {}
    for k, v in sorted((r.k, r.v) for r in df.collect()):
        expected[(k, v)] = expected.get(k, 0) + 1
        expected[k] = expected[(k, v)]
    got = {(r.k, r.v): r.rn for r in ordinal(df, ["k"], ["v"]).collect()}
    assert all(expected[key] == rn for key, rn in got.items()) and len(got) == 5000


def test_deep_ranks_equal_shallow_ones(spark):
    df = spark.range(4000).select((F.col("id") % 2).alias("k"), (F.col("id") * 31 % 4001).alias("v")).repartition(5)
    deep = top_per_group(df, ["k"], [F.desc("v")], 1500)
    assert deep.count() == 3000 and deep.schema["rn"].dataType.simpleString() == "int"
    shallow = {(r.k, r.v, r.rn) for r in top_per_group(df, ["k"], [F.desc("v")], 40).collect()}
    assert shallow == {(r.k, r.v, r.rn) for r in deep.filter("rn <= 40").collect()}


def test_page(spark):
    df = spark.createDataFrame([("p", i) for i in range(7)] + [("q", 1)], "p string, v int")
    rows = page(df, ["p"], [F.asc("v")], 2, 3).collect()
    assert sorted((r.v, r.total, r.has_more) for r in rows) == [(2, 7, True), (3, 7, True), (4, 7, True)]


def test_abbreviation_and_symbols(spark, one):
    assert one(abbreviation(F.lit("Alpha beta gamma"))) == "ABG"
    assert one(abbreviation(F.lit("prompting"))) == "PROMP"
    assert one(abbreviation(F.lit("--"))) == "X"
    rows = [("n", "c1", "principle", "Alpha Two", 1), ("n", "c2", "principle", "Apple tree", 2), ("n", "c3", "principle", "A T 2", 3), ("n", "c4", "principle", "a t", 4), ("m", "c5", "baseline", "a t", 5)]
    df = spark.createDataFrame(rows, "namespace string, concept_id string, concept_type string, label string, seq int")
    got = {r.concept_id: r.short_code for r in allocate(df).collect()}
    assert got["c1"] == "P.AT" and got["c2"] == "P.AT2" and got["c5"] == "BL.AT"
    assert len({got[c] for c in ("c1", "c2", "c3", "c4")}) == 4
    more = spark.createDataFrame([("n", "c9", "principle", "Any thing", 9), ("n", "c1", "principle", "Alpha Two", 1)], df.schema)
    again = {r.concept_id: r.short_code for r in allocate(more, allocate(df)).collect()}
    assert list(again) == ["c9"] and again["c9"] not in got.values()


def test_feedback(spark):
    rows = [("I", 1, "supported", []), ("I", 2, "contradicted", ["baseline stronger"]), ("I", 3, "implementation_failed", [])]
    fb = spark.createDataFrame(rows, "idea_id string, seq int, outcome_label string, failure_modes array<string>")
    links = spark.createDataFrame([("I", "P")], "idea_id string, principle_id string")
    cards = spark.createDataFrame([("P", 0.4, "L1"), ("Q", 0.4, "L1")], "principle_id string, confidence double, validation_level string")
    assert idea_status(fb).first().feedback_status == "implementation_failed"
    first = {r.principle_id: r for r in principle_state(cards, fb.filter("seq = 1"), links).collect()}
    after = {r.principle_id: r for r in principle_state(cards, fb, links).collect()}
    assert first["P"].validation_level == "L4" and first["P"].confidence > 0.4
    assert after["P"].confidence < first["P"].confidence and after["Q"].confidence == 0.4
    assert [r.value for r in failure_modes(fb, links).collect()] == ["baseline stronger"]


def test_feedback_is_clamped_in_its_turn(spark):
    rng = random.Random(3)
    kinds = list(STEPS) + ["unknown"]
    told = {f"P{k}": [rng.choice(kinds) for _ in range(n)] for k, n in enumerate([0, 1, 2, 3, 4, 30, 100])}
    told["P7"] = ["supported"] * 6 + ["contradicted"]
    rows = [(p, seq, o) for p, outcomes in told.items() for seq, o in enumerate(outcomes)]
    rng.shuffle(rows)
    fb = spark.createDataFrame(rows, "idea_id string, seq int, outcome_label string").repartition(5)
    links = spark.createDataFrame([(p, p) for p in told] + [("P7", "P7")], "idea_id string, principle_id string")
    cards = spark.createDataFrame([(p, 0.5, "L1") for p in told], "principle_id string, confidence double, validation_level string")
    expected = {}
    for p, outcomes in told.items():
        value = 0.5
        for o in outcomes:
            value = min(0.99, max(0.05, value + STEPS.get(o, 0.0)))
        expected[p] = round(value, 9)
    assert round(expected["P7"], 2) == 0.81
    assert {r.principle_id: round(r.confidence, 9) for r in principle_state(cards, fb, links).collect()} == expected
    steps = fb.select(F.col("idea_id").alias("k"), "seq", step().alias("shift"), F.lit(0.05).alias("low"), F.lit(0.99).alias("high"))
    for piece in (2, 7):
        folded = folded_steps(steps, "k", piece).collect()
        assert {r.k: round(min(r.high, max(r.low, 0.5 + r.shift)), 9) for r in folded} == {p: v for p, v in expected.items() if told[p]}


def test_every_evidence_link_is_listed(spark):
    rows = [("c1", f"e{k:03}") for k in range(40)] + [("c2", "e1")]
    links = spark.createDataFrame(rows, "concept_id string, evidence_id string").repartition(3)
    found = concept_links(links).collect()
    assert sorted((r.concept_id, r.pos, r.evidence_id) for r in found) == [("c1", k + 1, f"e{k:03}") for k in range(40)] + [("c2", 1, "e1")]


def test_concept_detail_returns_every_link(spark, tmp_path):
    docs = [(5 * i, "One sentence.", "en", "s", 13) for i in range(40)] + [(1, "Another one.", "en", "s", 12)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5 * i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = concept_plans.concept_detail_query(spark, str(tmp_path)).collect()
    assert sorted(r.evidence_count for r in rows) == [0] + [40] * 40 and len({r.evidence_id for r in rows}) == 41
    assert [r.evidence_id for r in rows if not r.evidence_count] == [""]


def test_a_search_makes_events_of_the_concepts_it_can_find_only(spark, tmp_path):
    from pyspark.sql import functions as F

    from loomcite.plans.standins import CONCEPT, searched_events, sentence_events

    texts = [(0, "One here. The THAND is said. Other words."), (5, "the thand, is said! Nothing of it."), (10, "A \"quoted\" ention."), (15, None), (1, "The thand is said.")]
    spark.createDataFrame([(k, t, "en", 40) for k, t in texts], "doc_id long, text string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    every = sentence_events(spark, str(tmp_path))
    met = every.filter(F.lower("sentence").rlike("thand|ention")).select(*CONCEPT).distinct()
    some = searched_events(spark, str(tmp_path), ["thand", "ention"])
    columns = every.columns
    assert sorted(map(str, some.select(*columns).collect())) == sorted(map(str, every.join(met, CONCEPT, "left_semi").select(*columns).collect()))
    assert 3 <= some.count() < every.count()


def told_documents(spark, folder):
    docs = [(k, f"The thand is said {k % 3}. One ention here! thand thand {'word ' * (k % 4)}.", "en", "s", 10 + k) for k in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, k % 2, int(k % 7 == 0)) for k in range(0, 40, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def exchanged(df):
    """Names of the columns that the shuffles of a plan carry, those of the text tables' rows apart."""
    plan = df._jdf.queryExecution().executedPlan()
    out, todo = set(), [plan.executedPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan]
    while todo:
        node = todo.pop()
        if node.nodeName() == "Exchange" and "RoundRobin" not in node.toString().split("\n")[0]:
            out |= {node.output().apply(k).name() for k in range(node.output().size())}
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return out


def test_hybrid_retrieval_shuffles_no_text(spark, tmp_path):
    told_documents(spark, tmp_path)
    top = concept_plans.hybrid_topk_by_type(spark, str(tmp_path))
    assert not exchanged(top) & {"text", "sentence", "label", "payload_json", "evidence_span", "canonical_key", "body"}
    assert "concept_id" in exchanged(top)
    assert top.count() == top.select("concept_id").distinct().count() > 0


def scored_one_by_one(spark, folder):
    """(links, level, lexical, score) of every concept, by the rules of the operator from the events one by one."""
    rows = cited(sentence_events(spark, folder)).withColumns({"_l": tokenize(F.concat_ws(" ", "label", "concept_type")), "_p": tokenize("payload_json"), "_s": tokenize("evidence_span")})
    terms, found, out = concept_plans.HYBRID_TERMS, {}, {}
    for r in rows.collect():
        found.setdefault(r.concept_id, []).append(r)
    for key, events in found.items():
        links = {r.evidence_id: r for r in events if r.evidence_id}
        last, active = max(events, key=lambda r: r.seq), max(events, key=lambda r: (r.confidence, r.seq))
        words = [*last._l, *active._p, *[w for r in links.values() for w in r._s]]
        lexical = sum(1 + math.log(1 + words.count(t)) for t in terms if t in words) / math.sqrt(len(terms) + len(words))
        level = int(last.validation_level[1]) if last.validation_level[0] == "L" else 0
        out[key] = (len(links), last.validation_level, round(lexical, 9), round(4 * lexical + 0.08 * level + 0.08 * min(len(links), 4) + 0.2 * active.confidence, 9))
    return out


def test_reasons_and_scores_are_those_of_all_texts_of_a_concept(spark, tmp_path):
    told_documents(spark, tmp_path)
    expected = scored_one_by_one(spark, str(tmp_path))
    scored = concept_plans._hybrid(spark, str(tmp_path))
    assert {r.concept_id: (r.evidence_count, r.validation_level, round(r.lexical, 9), round(r.score, 9)) for r in scored.collect()} == expected
    assert max(n for n, *_ in expected.values()) > 2
    reasons = concept_plans.retrieval_reasons_query(spark, str(tmp_path))
    assert "evidence_span" not in exchanged(reasons) and all(("evidence link" in r.reasons) == (expected[r.concept_id][0] > 0) for r in reasons.collect())


def test_default_evidence_is_the_best_of_each_type(spark, tmp_path):
    told_documents(spark, tmp_path)
    expected = scored_one_by_one(spark, str(tmp_path))
    shown = concept_plans.default_evidence_query(spark, str(tmp_path))
    assert "evidence_span" not in exchanged(shown)
    kind = {r.concept_id: r.concept_type for r in sentence_events(spark, str(tmp_path)).select("concept_id", "concept_type").collect()}
    best = {t: sorted((k for k in expected if kind[k] == t), key=lambda k: (-expected[k][3], k))[:3] for t in ("principle", "existed_idea", "takeaway_message", "benchmark")}
    assert [r.concept_id for r in shown.collect()] == [k for t in best for k in best[t]]


def test_concept_detail_writes_no_text(spark, tmp_path, monkeypatch):
    written, plain = [], concept_plans.durable
    monkeypatch.setattr(concept_plans, "durable", lambda df: written.append(set(df.columns)) or plain(df))
    told_documents(spark, tmp_path)
    rows = concept_plans.concept_detail_query(spark, str(tmp_path))
    carried = exchanged(rows).union(*written)
    assert "version_id" in carried and not carried & {"text", "sentence", "summary", "label", "payload_json", "evidence_span", "canonical_key"}
    expected = scored_one_by_one(spark, str(tmp_path))
    assert {r.concept_id: r.evidence_count for r in rows.collect()} == {k: n for k, (n, *_) in expected.items()}
