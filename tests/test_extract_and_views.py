from pyspark.sql import functions as F

from loomcite.functions.text import canonical_text
from loomcite.operators.extract import baseline_records, benchmark_records, candidate_urls, catalogue_matches, choose_full_text, gap_cards, result_records, work_facts
from loomcite.operators.quality import domain_compatible, failed_rules, grounding, objective_voice, passes_contract, repaired_title, scrub_numbers, supported_baselines
from loomcite.operators.views import baseline_view, benchmark_view, coverage, extraction_counts

L = F.lit


def catalogue(spark, names):
    df = spark.createDataFrame([(n, f"https://{n}.org".lower(), f"https://code/{n}") for n in names], "official_name string, official_url string, code_url string")
    return df.withColumn("name_key", canonical_text("official_name"))


ABSTRACT = (
    "We evaluate on ImageNet [3], ImageNet-R, and EuroSAT under a base-to-novel split. We compare against zero-shot CLIP, CoOp and Tip-Adapter. "
    "CoOp reports top-1 accuracy 74.2%. Tip-Adapter reports top-1 accuracy 76.4%."
)


def works(spark):
    return spark.createDataFrame(
        [("W1", "RouterPrompt for CLIP", ABSTRACT, "https://github.com/x/y"), ("W2", "Other", "This text names nothing.", "")],
        "work_id string, title string, abstract string, url string",
    )


def test_benchmarks_baselines_results(spark):
    datasets = catalogue(spark, ["ImageNet", "ImageNet-R", "EuroSAT", "COCO"])
    methods = catalogue(spark, ["zero-shot CLIP", "CoOp", "Tip-Adapter", "RouterPrompt", "ablation"])
    found = benchmark_records(works(spark), "abstract", datasets)
    rows = found.collect()
    assert {(r.work_id, r.dataset) for r in rows} == {("W1", "ImageNet"), ("W1", "ImageNet-R"), ("W1", "EuroSAT")}
    assert all(r.metric == "top-1 accuracy" and r.source_hash for r in rows) and {r.split for r in rows} == {"base-to-novel", "zero-shot"}
    assert "abstract" not in found.columns
    base = baseline_records(works(spark), "abstract", methods, found).collect()
    assert {r.baseline_name for r in base} == {"zero-shot CLIP", "CoOp", "Tip-Adapter"} and len(base) == 18
    results = {r.method_name: (r.metric, r.value, r.unit, r.has_code) for r in result_records(works(spark), "abstract").collect()}
    assert results == {"CoOp": ("top-1 accuracy", 74.2, "%", True), "Tip-Adapter": ("top-1 accuracy", 76.4, "%", True)}


def test_long_names_are_compared_whole(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = spark.createDataFrame([(1, f"X {passage}!"), (2, passage.replace("thirteen", "fourteen")), (3, "three four")], "id int, body string")
    names = spark.createDataFrame([(passage,), ("three four",)], "name_key string")
    got = sorted((r.id, len(r.name_key.split())) for r in catalogue_matches(docs, "id", "body", names).collect())
    assert got == [(1, 2), (1, 13), (2, 2), (3, 2)]


def test_work_facts_are_typed_and_repeatable(spark):
    text = "We propose an evidence-gated adapter. Ablation shows that updating all layers hurts accuracy. The main novelty lies in a router."
    df = spark.createDataFrame([("W", text, ["Turn literature into cards."])], "work_id string, abstract string, work_principles array<string>")
    got = {(r.fact_type, r.text.split()[0]) for r in work_facts(df).collect()}
    assert got == {("core_idea", "We"), ("insight", "Ablation"), ("failure_mode", "Ablation"), ("novelty", "The"), ("principle", "Turn")}
    assert sorted(r.fact_id for r in work_facts(df).collect()) == sorted(r.fact_id for r in work_facts(df.repartition(3)).collect())


def test_full_text_choice(spark):
    df = spark.createDataFrame([("W", "https://arxiv.org/abs/2305.1v1", None, ["u2", "https://arxiv.org/abs/2305.1v1"])], "work_id string, url string, paper_link string, source_urls array<string>")
    assert [r.url for r in candidate_urls(df).orderBy("rank").collect()] == ["https://arxiv.org/pdf/2305.1v1", "https://arxiv.org/abs/2305.1v1", "u2"]
    landed = spark.createDataFrame([("W", 1, "short"), ("W", 2, "x" * 600), ("W", 3, "y" * 900)], "work_id string, rank int, text string")
    assert choose_full_text(landed).first().text[0] == "x"


def test_quality_rules(one):
    bad = [
        "Materials prior to 2016 here are licensed under the Creative Commons License.",
        "(iii) To examine how different models vary.",
        "Thus, alignment becomes a system-level objective.",
        "Figure 1 summarizes this pipeline.",
        "open, hardware-agnostic benchmark that jointly measures accuracy",
        "This paper introduces a novel framework.",
        "Rewards can mis-generalize (Son et al.",
        "Use the source result as a reusable lesson.",
    ]
    assert all(one(failed_rules(L(text))) for text in bad)
    assert one(failed_rules(L("Transfer should be gated by benchmark compatibility."))) == []


def test_contract_drops_repeated_mechanism(spark):
    schema = "argument string, mechanism string, discussion string, evidence string"
    df = spark.createDataFrame([("A b.", "a  B", "d", "e"), ("Cut (Son et al.", "m", "d", "e"), ("A", "m", "", "e")], schema)
    got = passes_contract(df, "principle").collect()
    assert [(r.argument, r.mechanism) for r in got] == [("A b.", "")]


def test_grounding_numbers_voice_titles(spark, one):
    works_ = spark.createDataFrame([("W", "preference alignment under shifting stakeholder goals")], "work_id string, abstract string")
    said = spark.createDataFrame([(1, "W", "If disjunction then neither"), (2, "W", "shifting stakeholder goals break alignment")], "id int, work_id string, text string")
    assert {r.id: r.grounded for r in grounding(said, works_, "text", "abstract").collect()} == {1: False, 2: True}
    text = one(scrub_numbers(L("reduces tokens by 55-87% and cost 12% of 30"), L("we saw 12% here")))
    assert "55-87" not in text and "12%" in text and "30" not in text and "measured validation protocol" in text
    voice = one(objective_voice(L("We do not claim that a probe is always proof that it holds.")))
    assert "is not always proof" in voice and "We do not claim" not in voice
    title, message = repaired_title(L("Use the source result as"), L("Use the source result as a reusable lesson"), L("We show that base-to-novel transfer reveals overfitting."))
    assert "Use the source" not in one(title) and one(message).startswith("base-to-novel")


def test_supported_baselines_and_domains(spark):
    schema = "baseline_name string, baseline_type string, n_performance int, discussion string"
    rows = [("ablation", "", 1, "d"), ("PatternGate", "proposed_method", 1, "d"), ("Chain-of-Thought", "compared_method", 1, "d"), ("A Comparison of LLMs", "", 1, "d"), ("X", "", 0, "d")]
    assert [r.baseline_name for r in supported_baselines(spark.createDataFrame(rows, schema)).collect()] == ["Chain-of-Thought"]
    terms = {"agents": ["multi-agent"], "series": ["timesfm", "forecasting"]}
    df = spark.createDataFrame([(1, "TimesFM forecasting"), (2, "multi-agent debate"), (3, "neutral")], "id int, text string")
    assert sorted(r.id for r in domain_compatible(df, ["agents"], terms, "text").collect()) == [2, 3]


def test_views(spark):
    bench = spark.createDataFrame([(f"B{i}", "few-shot", "ImageNet", "novel", "accuracy", f"W{i}") for i in range(2)], "benchmark_id string, task string, dataset string, split string, metric string, work_id string")
    results = spark.createDataFrame([("B0", "CoOp", 82.0), ("B1", "CoOp", 83.0)], "benchmark_id string, method_name string, value double")
    row = benchmark_view(bench, results).collect()
    assert len(row) == 1 and row[0].n_records == 2 and row[0].baseline_count == 1 and row[0].performance[0].value == 83.0
    base = spark.createDataFrame([("B0", "CoOp", "W0"), ("B1", "CoOp", "W1")], "benchmark_id string, baseline_name string, work_id string")
    assert [(r.benchmark, r.n_works) for r in baseline_view(base, bench).collect()] == [("ImageNet · accuracy", 2)]
    facts = spark.createDataFrame([("W0", "core_idea"), ("W0", "core_idea")], "work_id string, fact_type string")
    shares = {r.fact_type: r.share for r in coverage(bench.select("work_id"), facts, ["core_idea", "insight"]).collect()}
    assert shares == {"core_idea": 0.5, "insight": 0.0, "overall": 0.25}
    gaps = gap_cards(bench.select("work_id"), bench.filter("work_id = 'W0'"), bench, {"missing_benchmark": 1.0, "missing_baseline": 1.0}).collect()
    assert [(g.work_id, g.gap_type) for g in gaps] == [("W1", "missing_benchmark")]
    kinds = ["existed_idea", "principle", "takeaway_message", "benchmark", "baseline"]
    rec = spark.createDataFrame([("W0", k) for k in kinds[:4]] + [("W1", "principle")], "work_id string, record_type string")
    assert {r.work_id: r.has_core_coverage for r in extraction_counts(rec, kinds).collect()} == {"W0": True, "W1": False}


def test_lower_is_better_puts_small_values_first(spark):
    bench = spark.createDataFrame([("b", "t", "d", "test", "latency", "lower_is_better")], "benchmark_id string, task string, dataset string, split string, metric string, metric_direction string")
    results = spark.createDataFrame([("b", "slow", 99.0), ("b", "fast", 10.0), ("b", "fast", 12.0)] + [("b", f"m{k}", 50.0 + k) for k in range(8)], "benchmark_id string, method_name string, value double")
    row = benchmark_view(bench, results).first()
    assert [(p.method_name, p.value) for p in row.performance][0] == ("fast", 10.0) and row.performance[-1].method_name == "slow" and len(row.performance) == 10
    assert len(benchmark_view(bench, results, shown=3).first().performance) == 3


def test_supported_number_around_an_unsupported_one_stays(one):
    from pyspark.sql import functions as F

    from loomcite.operators.quality import NUMBER_STANDIN, scrub_numbers

    assert one(scrub_numbers(F.lit("It cuts 5 steps and 15% cost"), F.lit("down 15%"))) == f"It cuts {NUMBER_STANDIN} steps and 15% cost"


def test_sentences_are_grounded_as_one_by_one(spark):
    from pyspark.sql import functions as F

    from loomcite.operators.quality import grounded_sentences, grounding

    said = [(1, ["tree search helps", "", "the of", "search search tree"]), (2, []), (3, ["nothing known here"]), (4, ["alone without work"])]
    works_ = spark.createDataFrame([(1, "Tree search again"), (3, None), (2, "x")], "work_id int, body string")
    texts = spark.createDataFrame(said, "work_id int, said array<string>")
    one = grounding(texts.select("work_id", F.posexplode("said").alias("pos", "text")), works_, "text", "body")
    rows = grounded_sentences(texts, works_, "said", "body")
    assert sorted(map(tuple, rows.select(*rows.columns).collect())) == sorted(map(tuple, one.select(*rows.columns).collect()))
    assert rows.count() == 6 and rows.filter("grounded").count() == 2


def test_bundle_counts_are_dealt_by_the_size_of_the_input(spark, tmp_path):
    from loomcite.operators.views import bundle_counts
    from loomcite.plans.registry import pieces

    rows = spark.range(4000).selectExpr("id % 700 as idea_id", "concat('s', id % 3) as section", "'p' as payload")
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    n = pieces(spark, str(tmp_path), "lineitem", 1 << 10)
    assert n > spark.sparkContext.defaultParallelism == pieces(spark, str(tmp_path), "lineitem")
    dealt = bundle_counts(rows, 37)
    assert dealt.rdd.getNumPartitions() == 37
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, bundle_counts(rows).collect()))
