"""Extraction jobs, quality gates and views."""

from __future__ import annotations

from pyspark.sql import functions as F


from ..functions.text import canonical_text, sentences
from ..operators.embeddings import register
from ..operators.extract import FACT_CUES, METRIC, SPLIT, TASK, baseline_records, benchmark_records, catalogue_matches, gap_cards, result_records, work_facts
from ..operators.mentions import mentions
from ..operators.quality import (
    GENERIC_BASELINES,
    REJECT_RULES,
    gate,
    grounded_sentences,
    official_only,
    related_ideas,
    scrub_numbers,
    supported_baselines,
    with_model,
)
from ..operators.retrieval import latest_idea_per_title, with_lexical
from ..operators.views import (
    baseline_view,
    benchmark_view,
    bundle_counts,
    coverage,
    dashboard,
    export_bundle,
    extraction_counts,
    fact_view,
    families,
    group_records,
    report_sections,
    table_counts,
    timeline,
    top_principles,
    with_defaults,
    work_badges,
)
from ..session import durable
from ..sources.importer import import_buckets, import_counts
from . import duck
from .duck_concepts import EVENTS, TYPE_CASE
from .registry import pieces, query, spread_table, table
from .standins import TYPES, sentence_events, works
from .text_plans import TERMS

# ---------------------------------------------------------------- extraction

CUE_SQL = ", ".join(f"CASE WHEN regexp_matches(s, '{p}') THEN '{t}' END" for t, p in FACT_CUES)


@query(
    "work_facts",
    f"""WITH {duck.WORKS}, s AS (SELECT 'D' || doc_id AS work_id, unnest({duck.sentences("abstract")}) AS s FROM works),
f AS (SELECT work_id, unnest(list_filter([{CUE_SQL}], lambda x: x IS NOT NULL)) AS fact_type, s AS text FROM s UNION ALL SELECT 'D' || doc_id, 'principle', title FROM works WHERE title <> '')
SELECT DISTINCT {duck.stable_id("WF", "work_id", "fact_type", duck.text_hash("text"))} AS fact_id, work_id, fact_type FROM f""",
)
def work_facts_query(spark, sf_dir):
    rows = works(spark, sf_dir).select(F.concat(F.lit("D"), "doc_id").alias("work_id"), "abstract", F.array("title").alias("work_principles"))
    return work_facts(rows).select("fact_id", "work_id", "fact_type")


NAMES = f"""names AS (SELECT DISTINCT name_key FROM (SELECT {duck.canonical("text")} AS name_key FROM benchmark
  UNION ALL SELECT array_to_string(list_slice(string_split({duck.canonical("text")}, ' '), 1, 3), ' ') FROM benchmark) WHERE name_key <> '')"""


def _catalogue(spark, sf_dir):
    keys = table(spark, sf_dir, "benchmark").select(canonical_text("text").alias("k"))
    names = keys.select("k").unionByName(keys.select(F.array_join(F.slice(F.split("k", " "), 1, 3), " ").alias("k")))
    return names.select(F.col("k").alias("name_key"), F.col("k").alias("official_name")).distinct()


@query(
    "catalogue_matches",
    f"WITH {NAMES}, d AS (SELECT doc_id, ' ' || {duck.canonical('text')} || ' ' AS t FROM documents) SELECT doc_id, name_key FROM d JOIN names ON contains(t, ' ' || name_key || ' ')",
)
def catalogue_matches_query(spark, sf_dir):
    docs = spread_table(spark, sf_dir, "documents", "doc_id", "text")
    return catalogue_matches(docs, "doc_id", "text", _catalogue(spark, sf_dir))


def found_sql(names: str, out: str) -> str:
    """CTEs that give ``out`` (work_id, name_key): leftmost, longest names of texts d (work_id, w) by words."""
    return f"""{out}_n AS (SELECT name_key, len(string_split(name_key, ' ')) AS n, string_split(name_key, ' ')[1] AS head FROM {names}),
{out}_s AS (SELECT work_id, i, max(n) AS n FROM (SELECT work_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) t JOIN {out}_n ON head = w[i]
  WHERE array_to_string(w[i:i + n - 1], ' ') = name_key AND i + n - 1 <= len(w) GROUP BY work_id, i),
{out}_j AS (SELECT a.work_id, a.i, a.n, min(b.i) AS j FROM {out}_s a LEFT JOIN {out}_s b ON a.work_id = b.work_id AND b.i >= a.i + a.n GROUP BY ALL),
{out}_t AS (SELECT work_id, min(i) AS i FROM {out}_s GROUP BY work_id UNION SELECT t.work_id, j FROM {out}_t t JOIN {out}_j USING (work_id, i) WHERE j IS NOT NULL),
{out} AS (SELECT DISTINCT work_id, array_to_string(w[i:i + n - 1], ' ') AS name_key FROM {out}_t JOIN {out}_s USING (work_id, i) JOIN d USING (work_id))"""


def _all_sql(pattern: str) -> str:
    hits = f"list_distinct(list_transform(regexp_extract_all(text, '(?i){pattern}', 1), lambda x: lower(x)))"
    return f"CASE WHEN len({hits}) > 0 THEN {hits} ELSE [''] END"


MENTIONED = f"d AS (SELECT 'D' || doc_id AS work_id, text, string_split({duck.canonical('text')}, ' ') AS w FROM documents)"
BENCHMARKS = f"""{NAMES}, {MENTIONED}, {found_sql("names", "m")},
facts AS (SELECT work_id, unnest(ms) AS metric, splits, tasks, source_hash FROM (SELECT work_id, {_all_sql(f"({METRIC})")} AS ms, {_all_sql(SPLIT)} AS splits, {_all_sql(TASK)} AS tasks, {duck.text_hash("text")} AS source_hash FROM d)),
f2 AS (SELECT work_id, metric, unnest(splits) AS split, tasks, source_hash FROM facts), f3 AS (SELECT work_id, metric, split, unnest(tasks) AS task, source_hash FROM f2),
b AS (SELECT {duck.stable_id("B", "work_id", "dataset", "split", "metric", "task")} AS benchmark_id, * FROM (SELECT work_id, name_key AS dataset, metric, split, task, source_hash FROM m JOIN f3 USING (work_id)))"""


def _texts(spark, sf_dir):
    docs = spread_table(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select(F.concat(F.lit("D"), "doc_id").alias("work_id"), "text", F.substring_index("text", "\n", 1).alias("title"))


@query("benchmark_extraction", f"WITH RECURSIVE {BENCHMARKS} SELECT benchmark_id, work_id, metric, split, task, source_hash FROM b")
def benchmark_extraction(spark, sf_dir):
    out = benchmark_records(_texts(spark, sf_dir), "text", _catalogue(spark, sf_dir))
    return out.select("benchmark_id", "work_id", "metric", "split", "task", "source_hash")


@query("name_mentions", f"WITH RECURSIVE {NAMES}, {MENTIONED}, {found_sql('names', 'm')} SELECT m_t.work_id, CAST(i - 1 AS BIGINT) AS start, CAST(n AS BIGINT) AS size FROM m_t JOIN m_s USING (work_id, i)")
def name_mentions(spark, sf_dir):
    """Where the catalogue's names lie in the texts, none inside another."""
    return mentions(_texts(spark, sf_dir), "work_id", "text", _catalogue(spark, sf_dir)).select("work_id", "start", "size")


METHODS = f"""methods AS (SELECT name_key, min(item_id) AS first FROM (SELECT item_id, array_to_string(list_slice(string_split({duck.canonical("text")}, ' '), 4, 5), ' ') AS name_key FROM benchmark) WHERE name_key <> '' GROUP BY name_key)"""


@query(
    "baseline_extraction",
    f"""WITH RECURSIVE {BENCHMARKS}, {METHODS}, {found_sql("methods", "q")},
own AS (SELECT 'D' || doc_id AS work_id, {duck.canonical("regexp_extract(string_split(text, chr(10))[1], '^([^:]+?)(?::| for )', 1)")} AS own FROM documents)
SELECT work_id, name_key AS baseline_name, 'code/' || first AS code_url, dataset, benchmark_id, {duck.stable_id("BL", "work_id", "benchmark_id", "name_key")} AS baseline_id
FROM q JOIN own USING (work_id) JOIN methods USING (name_key) JOIN b USING (work_id) WHERE name_key <> own AND name_key NOT IN ({", ".join(f"'{x}'" for x in GENERIC_BASELINES)})""",
)
def baseline_extraction(spark, sf_dir):
    """Methods that a text compares with, per benchmark record of the text."""
    works_rows = _texts(spark, sf_dir)
    words = F.split(canonical_text("text"), " ")
    methods = table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.slice(words, 4, 2), " ").alias("name_key")).filter("name_key <> ''")
    methods = methods.groupBy("name_key").agg(F.concat(F.lit("code/"), F.min("item_id")).alias("code_url")).withColumn("official_name", F.col("name_key"))
    found = benchmark_records(works_rows, "text", _catalogue(spark, sf_dir))
    out = baseline_records(works_rows, "text", methods, found)
    return out.select("work_id", "baseline_name", "code_url", "dataset", "benchmark_id", "baseline_id")


@query(
    "result_extraction",
    f"""WITH r AS (SELECT DISTINCT l_orderkey AS work_id, replace(p_brand, '#', '-') AS method_name, CASE WHEN l_linenumber % 2 = 0 THEN 'exact match' ELSE 'accuracy' END AS metric, l_quantity AS value FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT work_id, method_name, metric, CAST(value AS DOUBLE) AS value, '%' AS unit FROM r""",
)
def result_extraction(spark, sf_dir):
    lines = spread_table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    rows = lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    metric = F.when(F.col("l_linenumber") % 2 == 0, "exact match").otherwise("accuracy")
    said = F.concat(F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit(" reports "), metric, F.lit(" "), F.col("l_quantity").cast("string"), F.lit("%. It ends."))
    texts = rows.select(F.col("l_orderkey").alias("work_id"), F.lit("").alias("url"), said.alias("text"))
    return result_records(texts, "text").select("work_id", "method_name", "metric", "value", "unit")


# ---------------------------------------------------------------- gates

RULE_SQL = ", ".join(f"CASE WHEN regexp_matches(s, '{p}') THEN '{r}' END" for r, p in REJECT_RULES)


@query(
    "quality_gate_rejects",
    f"""WITH s AS (SELECT doc_id, unnest({duck.sentences("text")}) AS s, generate_subscripts({duck.sentences("text")}, 1) AS pos FROM documents),
f AS (SELECT doc_id, pos, concat_ws(',', {RULE_SQL}) AS failed FROM s)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, failed FROM f WHERE failed <> ''""",
)
def quality_gate_rejects(spark, sf_dir):
    docs = spread_table(spark, sf_dir, "documents", "doc_id", "text")
    rows = docs.select("doc_id", F.posexplode(sentences("text")).alias("pos", "sentence"))
    failed = gate(rows, "sentence").select("doc_id", (F.col("pos") + 1).alias("pos"), F.array_join("failed", ",").alias("failed"))
    return failed.filter("failed <> ''")


@query(
    "grounding_gate",
    f"""WITH {duck.WORKS}, s AS (SELECT doc_id, unnest({duck.sentences("abstract")}) AS s, generate_subscripts({duck.sentences("abstract")}, 1) AS pos FROM works),
c AS (SELECT s.doc_id, pos, list_distinct({duck.tokens("s")}) AS ct, coalesce(wt, []) AS wt FROM s LEFT JOIN (SELECT doc_id - 1 AS doc_id, list_distinct({duck.tokens("title || ' ' || abstract")}) AS wt FROM works) w ON w.doc_id = s.doc_id),
n AS (SELECT doc_id, pos, len(list_intersect(ct, wt)) AS n_shared, len(ct) AS k FROM c)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(n_shared AS INTEGER) AS n_shared, k > 0 AND n_shared / k >= 0.2::DOUBLE AND n_shared >= 2 AS grounded FROM n""",
)
def grounding_gate(spark, sf_dir):
    rows = works(spark, sf_dir)
    said = rows.select(F.col("doc_id").alias("work_id"), sentences("abstract").alias("said"))
    # a sentence is held against the whole text of the next document
    texts = rows.select((F.col("doc_id") - 1).alias("work_id"), F.concat_ws(" ", "title", "abstract").alias("body"))
    out = grounded_sentences(said, texts, "said", "body")
    return out.select(F.col("work_id").alias("doc_id"), (F.col("pos") + 1).alias("pos"), "n_shared", "grounded")


@query(
    "number_scrub",
    "SELECT l_orderkey, l_linenumber, 'Cuts cost by ' || CASE WHEN l_quantity = l_suppkey THEN CAST(l_suppkey AS VARCHAR) || '%' ELSE 'an amount to be set by a measured validation protocol' END || ' in all.' AS text FROM lineitem",
)
def number_scrub(spark, sf_dir):
    lines = spread_table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    rows = lines.withColumn("q", F.col("l_quantity").cast("bigint"))
    said = F.concat(F.lit("Cuts cost by "), F.col("l_suppkey").cast("string"), F.lit("% in all."))
    known = F.concat(F.lit("We saw "), F.col("q").cast("string"), F.lit("% less."))
    return rows.select("l_orderkey", "l_linenumber", scrub_numbers(said, known).alias("text"))


@query(
    "number_scrub_inside",
    """SELECT l_orderkey, l_linenumber, 'It cuts an amount to be set by a measured validation protocol steps and ' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '5% cost' AS text FROM lineitem""",
)
def number_scrub_inside(spark, sf_dir):
    lines = spread_table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    q = F.col("l_quantity").cast("bigint").cast("string")
    said = F.concat(F.lit("It cuts "), q, F.lit(" steps and "), q, F.lit("5% cost"))
    return lines.select("l_orderkey", "l_linenumber", scrub_numbers(said, F.concat(F.lit("down "), q, F.lit("5%"))).alias("text"))


@query(
    "official_benchmarks",
    """SELECT l_orderkey, l_linenumber, p_type AS dataset, 'url/' || p_type AS official_url FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_type IN ('PROMO', 'SMALL', 'LARGE')""",
)
def official_benchmarks(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("dataset"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    names = parts.select("dataset").distinct().filter("dataset in ('PROMO', 'SMALL', 'LARGE')")
    catalogue = names.select(canonical_text("dataset").alias("name_key"), F.concat(F.lit("url/"), "dataset").alias("official_url"))
    return official_only(rows, catalogue, "dataset").select("l_orderkey", "l_linenumber", "dataset", "official_url")


@query(
    "supported_baselines",
    f"""SELECT l_orderkey, l_linenumber FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE CASE WHEN l_linenumber = 1 THEN 'ablation' ELSE lower(p_name) END NOT IN ({", ".join(f"'{w}'" for w in GENERIC_BASELINES)}) AND l_returnflag <> 'R' AND l_quantity > 5 AND l_linestatus = 'F'""",
)
def supported_baselines_query(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity", "l_linestatus")
    rows = lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 1, "ablation").otherwise(F.col("p_name")).alias("baseline_name"),
        F.when(F.col("l_returnflag") == "R", "proposed_method").otherwise("compared_method").alias("baseline_type"),
        F.when(F.col("l_quantity") > 5, 1).otherwise(0).alias("n_performance"), F.when(F.col("l_linestatus") == "F", "said").otherwise("").alias("discussion"),
    )
    return supported_baselines(rows).select("l_orderkey", "l_linenumber")


@query("model_scope", "SELECT doc_id FROM documents WHERE lang = 'de'")
def model_scope(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("model_mode"))
    return with_model(rows, "de").select("doc_id")


IDEAS = f"""{duck.WORKS}, hits AS ({duck.lexical("works", "doc_id", "title || ' ' || abstract", TERMS)}),
ideas AS (SELECT w.doc_id, w.lang AS model_mode, w.source AS goal_id, {duck.canonical("w.title")} AS title_key, coalesce(h.lexical, 0) AS lexical FROM works w LEFT JOIN hits h USING (doc_id)),
rel AS (SELECT * FROM ideas WHERE lexical >= 0.18::DOUBLE OR goal_id IN ('src1', 'src2'))
"""


@query(
    "related_idea_filter",
    f"WITH {IDEAS} SELECT model_mode, goal_id, title_key, max(doc_id) AS doc_id FROM rel GROUP BY ALL",
)
def related_idea_filter(spark, sf_dir):
    rows = works(spark, sf_dir).select(
        "doc_id", F.col("doc_id").alias("idea_id"), F.col("lang").alias("model_mode"), F.col("source").alias("goal_id"), canonical_text("title").alias("title_key"),
        F.col("doc_id").alias("seq"), F.concat_ws(" ", "title", "abstract").alias("body"),
    )
    scored = with_lexical(rows, "body", TERMS).drop("body")
    goals = rows.select("goal_id").distinct().filter("goal_id in ('src1', 'src2')")
    links = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("idea_id"), F.col("quality").alias("principle_id"))
    kept = related_ideas(scored, goals, links.select("principle_id"), links)
    return latest_idea_per_title(kept).select("model_mode", "goal_id", "title_key", "doc_id")


# ---------------------------------------------------------------- views


@query(
    "table_counts",
    "SELECT 'src' || i AS bucket, coalesce(n, 0) AS n FROM range(0, 30) r(i) LEFT JOIN (SELECT source, count(*) AS n FROM documents GROUP BY 1) ON source = 'src' || i",
)
def table_counts_query(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("bucket"))
    return table_counts(rows, [f"src{i}" for i in range(30)])


@query(
    "extraction_counts",
    f"""WITH r AS (SELECT user_id AS work_id, {TYPE_CASE.replace("doc_id", "event_id")} AS t FROM events),
c AS (SELECT work_id, {", ".join(f"count(*) FILTER (t = '{t}') AS {t}" for t in TYPES)} FROM r GROUP BY 1)
SELECT *, existed_idea > 0 AND principle > 0 AND takeaway_message > 0 AND (benchmark > 0 OR baseline > 0) AS has_core_coverage FROM c""",
)
def extraction_counts_query(spark, sf_dir):
    kinds = F.array(*map(F.lit, TYPES))
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("work_id"), F.element_at(kinds, (F.col("event_id") % 5 + 1).cast("int")).alias("record_type")
    )
    return extraction_counts(rows, TYPES)


def _results(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_returnflag", "l_linestatus")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    rows = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        F.col("l_orderkey").alias("work_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus").alias("benchmark_id"), F.lit("sales").alias("task"),
        F.col("p_type").alias("dataset"), F.col("l_returnflag").alias("split"), F.col("l_linestatus").alias("metric"), F.col("p_brand").alias("method_name"), F.col("l_discount").alias("value"),
    )


RESULTS = """r AS (SELECT l_orderkey AS work_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_returnflag, l_linestatus) AS benchmark_id, p_type AS dataset, l_returnflag AS split, l_linestatus AS metric, p_brand AS method_name, l_discount AS value FROM lineitem JOIN part ON p_partkey = l_partkey)"""


@query(
    "benchmark_view",
    f"""WITH {RESULTS}, g AS (SELECT dataset, split, metric, count(DISTINCT benchmark_id) AS n_records, count(DISTINCT method_name) AS baseline_count FROM r GROUP BY ALL),
b AS (SELECT dataset, split, metric, method_name, max(value) AS v FROM r GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY dataset, split, metric ORDER BY v DESC, method_name) AS rn FROM b)
SELECT g.*, (SELECT string_agg(method_name, ',' ORDER BY rn) FROM k WHERE k.dataset = g.dataset AND k.split = g.split AND k.metric = g.metric) AS best FROM g""",
)
def benchmark_view_query(spark, sf_dir):
    rows = _results(spark, sf_dir)
    benchmarks = rows.select("benchmark_id", "task", "dataset", "split", "metric").distinct()
    out = benchmark_view(benchmarks, rows.select("benchmark_id", "method_name", "value"))
    return out.select("dataset", "split", "metric", "n_records", "baseline_count", F.array_join("performance.method_name", ",").alias("best"))


@query(
    "benchmark_view_lower",
    f"""WITH {RESULTS}, b AS (SELECT dataset, split, metric, method_name, CASE WHEN metric = 'O' THEN min(value) ELSE max(value) END AS v FROM r GROUP BY dataset, split, metric, method_name)
SELECT dataset, split, metric, string_agg(method_name || '=' || CAST(CAST(round(v * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY CASE WHEN metric = 'O' THEN v ELSE -v END, method_name) AS best FROM b GROUP BY dataset, split, metric""",
)
def benchmark_view_lower(spark, sf_dir):
    rows = _results(spark, sf_dir)
    direction = F.when(F.col("metric") == "O", "lower_is_better").otherwise("higher_is_better")
    benchmarks = rows.select("benchmark_id", "task", "dataset", "split", "metric", direction.alias("metric_direction")).distinct()
    out = benchmark_view(benchmarks, rows.select("benchmark_id", "method_name", "value"))
    shown = F.transform("performance", lambda x: F.concat_ws("=", x["method_name"], F.round(x["value"] * 100).cast("bigint")))
    return out.select("dataset", "split", "metric", F.array_join(shown, ",").alias("best"))


@query("benchmark_group_records", f"WITH {RESULTS} SELECT DISTINCT dataset, split, metric, benchmark_id FROM r")
def benchmark_group_records(spark, sf_dir):
    return group_records(_results(spark, sf_dir)).select("dataset", "split", "metric", "benchmark_id")


@query("baseline_view", f"WITH {RESULTS} SELECT method_name AS baseline_name, dataset || ' · ' || metric AS benchmark, count(DISTINCT work_id) AS n_works FROM r GROUP BY ALL")
def baseline_view_query(spark, sf_dir):
    rows = _results(spark, sf_dir)
    return baseline_view(rows.select("work_id", "benchmark_id", F.col("method_name").alias("baseline_name")), rows.select("benchmark_id", "dataset", "metric").distinct())


FACTS = f"""fx AS (SELECT doc_id AS work_id, {TYPE_CASE.replace("doc_id % 5", "(doc_id * 3 + quality * 2 + toxic) % 5")} AS fact_type, quality FROM labels)"""


def _facts(spark, sf_dir):
    kinds = F.array(*map(F.lit, TYPES))
    place = (F.col("doc_id") * 3 + F.col("quality") * 2 + F.col("toxic")) % 5 + 1
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("work_id"), F.element_at(kinds, place.cast("int")).alias("fact_type"), "quality")


@query(
    "coverage",
    f"""WITH {FACTS}, t AS (SELECT count(*) AS total FROM documents), s AS (SELECT v.t AS fact_type, count(DISTINCT work_id) / any_value(total) AS share FROM (VALUES {duck.values(TYPES)}) v(t) LEFT JOIN fx ON fact_type = v.t, t GROUP BY v.t),
u AS (SELECT * FROM s UNION ALL SELECT 'overall', avg(share) FROM s)
SELECT fact_type, round_even(share, 6) AS share FROM u""",
)
def coverage_query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("work_id"))
    return coverage(docs, _facts(spark, sf_dir), TYPES).withColumn("share", F.bround("share", 6))


@query(
    "dashboard_counts",
    """SELECT 'works' AS name, count(*) AS n FROM documents UNION ALL SELECT 'facts', count(*) FROM labels UNION ALL SELECT 'principles', count(*) FROM part UNION ALL SELECT 'benchmarks', count(*) FROM benchmark
UNION ALL SELECT 'results', count(*) FROM lineitem UNION ALL SELECT 'ideas', count(*) FROM orders UNION ALL SELECT 'validated_ideas', count(*) FROM orders WHERE o_orderstatus = 'F'""",
)
def dashboard_counts(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    counts = {"works": t("documents"), "facts": t("labels"), "principles": t("part"), "benchmarks": t("benchmark"), "results": t("lineitem"), "ideas": t("orders")}
    return dashboard(counts, validated_ideas=(t("orders"), F.col("o_orderstatus") == "F"))


def _principle_tables(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("principle_id"), F.col("p_type").alias("family"), (F.col("p_size") / 50).alias("confidence"))
    sources = lines.select(F.col("l_partkey").alias("principle_id"), F.col("l_suppkey").alias("work_id"))
    return parts, sources, lines.select(F.col("l_partkey").alias("principle_id"), F.col("l_orderkey").alias("idea_id"))


@query(
    "families",
    """SELECT p_type AS family, count(DISTINCT p_partkey) AS n_principles, any_value(m) AS mean_confidence, count(DISTINCT l_suppkey) AS n_works, count(DISTINCT l_orderkey) AS n_ideas
FROM part LEFT JOIN lineitem ON l_partkey = p_partkey JOIN (SELECT p_type, round_even(avg(p_size / 50), 6) AS m FROM part GROUP BY 1) USING (p_type) GROUP BY 1""",
)
def families_query(spark, sf_dir):
    return families(*_principle_tables(spark, sf_dir)).withColumn("mean_confidence", F.bround("mean_confidence", 6))


@query(
    "top_principles",
    """SELECT p_partkey AS principle_id, count(DISTINCT l_suppkey) AS source_work_count, count(DISTINCT l_orderkey) AS idea_count FROM part LEFT JOIN lineitem ON l_partkey = p_partkey
GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 25""",
)
def top_principles_query(spark, sf_dir):
    return top_principles(*_principle_tables(spark, sf_dir), 25).select("principle_id", "source_work_count", "idea_count")


@query("fact_view", f"WITH {FACTS}, {duck.WORKS} SELECT work_id, quality, title AS work_title FROM fx JOIN works ON doc_id = work_id WHERE fact_type = 'principle'")
def fact_view_query(spark, sf_dir):
    titles = works(spark, sf_dir).select(F.col("doc_id").alias("work_id"), "title")
    return fact_view(_facts(spark, sf_dir), titles, "principle").select("work_id", "quality", "work_title")


@query(
    "timeline",
    """SELECT strftime(o_orderdate, '%Y-%m-%d') AS at_day, 'idea' AS type, o_orderpriority AS label, CAST(o_orderkey AS VARCHAR) AS id FROM orders
UNION ALL SELECT strftime(ts, '%Y-%m-%d'), 'gap', event_type, CAST(event_id AS VARCHAR) FROM events WHERE event_type = 'error'""",
)
def timeline_query(spark, sf_dir):
    ideas = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("at"), F.col("o_orderpriority").alias("label"), F.col("o_orderkey").alias("id"))
    gaps = table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.date_format("ts", "yyyy-MM-dd").alias("at"), F.col("event_type").alias("label"), F.col("event_id").alias("id"))
    return timeline({"idea": ideas, "gap": gaps}).withColumnRenamed("at", "at_day")


@query(
    "work_badges",
    f"""WITH {FACTS}, f AS (SELECT work_id, bool_or(fact_type = 'existed_idea') AS c, bool_or(fact_type = 'takeaway_message') AS i FROM fx GROUP BY 1)
SELECT doc_id AS work_id, n_chars > 2000 AS highlighted, coalesce(c, false) AS has_core_idea, coalesce(i, false) AS has_insight, CASE WHEN page_id IS NULL THEN 0 ELSE 1 END::BIGINT AS n_benchmarks
FROM documents LEFT JOIN f ON work_id = doc_id LEFT JOIN pages ON page_id = doc_id""",
)
def work_badges_query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("work_id"), (F.col("n_chars") > 2000).alias("highlighted"))
    kind = F.when(F.col("fact_type") == "existed_idea", "core_idea").when(F.col("fact_type") == "takeaway_message", "insight").otherwise(F.col("fact_type"))
    facts = _facts(spark, sf_dir).withColumn("fact_type", kind)
    return work_badges(docs, facts, table(spark, sf_dir, "pages").select(F.col("page_id").alias("work_id")))


@query(
    "gaps",
    f"""WITH w AS (SELECT doc_id AS work_id FROM documents), g AS (SELECT work_id, 'missing_benchmark' AS gap_type, 0.6::DOUBLE AS severity FROM w WHERE work_id NOT IN (SELECT page_id FROM pages)
UNION ALL SELECT work_id, 'missing_baseline', 0.5::DOUBLE FROM w WHERE work_id NOT IN (SELECT doc_id FROM labels))
SELECT work_id, gap_type, severity, {duck.stable_id("GAP", "gap_type", "work_id")} AS gap_id FROM g""",
)
def gaps(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("work_id"))
    benchmarks = table(spark, sf_dir, "pages").select(F.col("page_id").alias("work_id"))
    baselines = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("work_id"))
    return gap_cards(docs, benchmarks, baselines, {"missing_benchmark": 0.6, "missing_baseline": 0.5})


@query(
    "export_bundle",
    """WITH l AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem)
SELECT o_orderkey AS idea_id, 'idea' AS section, 1::BIGINT AS n FROM orders UNION ALL SELECT l_orderkey, 'principles', count(DISTINCT l_partkey) FROM l GROUP BY 1 UNION ALL SELECT l_orderkey, 'works', count(DISTINCT l_suppkey) FROM l GROUP BY 1
UNION ALL SELECT l_orderkey, 'benchmark_evidence', count(DISTINCT l_suppkey) FROM l JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey < 5 GROUP BY 1
UNION ALL SELECT o_orderkey, 'estimate', 1 FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'plan', 1 FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey, 'feedback_schema', 1 FROM orders""",
)
def export_bundle_query(spark, sf_dir):
    n = pieces(spark, sf_dir, "lineitem")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").repartition(n, "l_orderkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idea_id"), F.col("o_orderstatus").alias("status"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("work_id"), F.col("s_name").alias("title"), "s_nationkey")
    out = export_bundle(
        orders,
        lines.select(F.col("l_orderkey").alias("idea_id"), F.col("l_partkey").alias("principle_id")).distinct(),
        table(spark, sf_dir, "part").select(F.col("p_partkey").alias("principle_id"), F.col("p_name").alias("name")),
        lines.select(F.col("l_orderkey").alias("idea_id"), F.col("l_suppkey").alias("work_id")).distinct(),
        suppliers.select("work_id", "title"),
        suppliers.filter("s_nationkey < 5").select("work_id", F.col("s_nationkey").alias("score")),
        orders.filter("status = 'F'"), orders.filter("status = 'P'"),
    )
    return bundle_counts(out, n)


@query(
    "report_sections",
    f"""WITH {duck.WORKS}, s AS (SELECT source AS project_id, doc_id AS idea_id, 1 AS pos, 'title' AS heading, title AS body FROM works UNION ALL SELECT source, doc_id, 2, 'lang', lang FROM works UNION ALL SELECT source, doc_id, 3, 'abstract', abstract FROM works)
SELECT * FROM s WHERE body <> ''""",
)
def report_sections_query(spark, sf_dir):
    rows = works(spark, sf_dir).select(F.col("source").alias("project_id"), F.col("doc_id").alias("idea_id"), "title", "lang", "abstract")
    return report_sections(rows, ["title", "lang", "abstract"])


@query(
    "idea_defaults",
    """SELECT o_orderkey AS idea_id, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE 'unknown' END AS effort, CASE WHEN o_orderstatus = 'F' THEN 'low' ELSE 'unknown' END AS risk, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS n_steps FROM orders""",
)
def idea_defaults(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idea_id"), "o_orderstatus", "o_orderpriority")
    estimates = orders.filter("o_orderstatus = 'F'").select("idea_id", F.col("o_orderpriority").alias("effort"), F.lit("low").alias("risk"))
    plans = orders.filter("o_orderstatus = 'P'").select("idea_id", F.array(F.lit("run it")).alias("steps"))
    return with_defaults(orders, estimates, plans).select("idea_id", "effort", "risk", F.size("steps").alias("n_steps"))


@query(
    "embedding_register",
    f"""SELECT {duck.stable_id("EMB", "'document'", "vec_id", "'main'", "'m'")} AS embedding_id, vec_id AS owner_id, CAST(len(embedding) AS INTEGER) AS dims FROM embeddings""",
)
def embedding_register(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(
        F.lit("document").alias("owner_type"), F.col("vec_id").alias("owner_id"), F.lit("main").alias("view_name"), F.lit("m").alias("model"),
        F.col("embedding").alias("vector"), F.col("vec_id").alias("seq"),
    )
    return register(rows).filter("consistent").select("embedding_id", "owner_id", "dims")


BUCKET_OF = {"existed_idea": "existed_ideas", "principle": "principles", "takeaway_message": "takeaway_messages", "benchmark": "benchmark_records", "baseline": "baseline_records"}


@query(
    "bucket_import",
    f"""WITH {EVENTS}, {duck.WORKS}, k AS (SELECT concept_type, substr({duck.canonical("label || ' ' || substr(sentence, 1, 260) || ' D' || doc_id")}, 1, 300) AS key FROM raw_events),
m AS (SELECT DISTINCT 'work' AS t, {duck.canonical("CASE WHEN title = '' THEN 'Untitled work' ELSE title END")} AS k FROM works UNION SELECT DISTINCT concept_type, key FROM k)
SELECT 'works' AS kind, count(*) AS n FROM works UNION ALL SELECT 'concepts', count(*) FROM k UNION ALL SELECT 'evidence_links', count(*) FROM k UNION ALL SELECT 'memberships', count(*) FROM m""",
)
def bucket_import(spark, sf_dir):
    docs = works(spark, sf_dir)
    old = F.concat(F.lit("D"), "doc_id")
    records = docs.select(
        F.lit("source_works").alias("bucket"), old.alias("id"), F.to_json(F.struct(old.alias("work_id"), "title", "abstract")).alias("payload"), F.col("doc_id").alias("seq")
    )
    events = sentence_events(spark, sf_dir)
    names = F.create_map(*[F.lit(x) for pair in BUCKET_OF.items() for x in pair])
    cards = events.select(
        F.element_at(names, F.col("concept_type")).alias("bucket"), F.col("seq").cast("string").alias("id"),
        F.to_json(F.struct(F.col("sentence").alias("title"), F.array(old).alias("source_work_ids"))).alias("payload"), "seq",
    )
    return import_counts(import_buckets(durable(records.unionByName(cards))))
