"""Views over the extracted tables: dashboards, coverage, benchmarks, baselines, timeline, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import BUCKETS
from .concepts import canonical_method_name

from .ranking import top_per_group


def table_counts(rows: DataFrame, names: list[str] = BUCKETS) -> DataFrame:
    """Rows per bucket, zero for buckets without any."""
    known = rows.sparkSession.createDataFrame([(n,) for n in names], "bucket string")
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    return known.join(counts, "bucket", "full_outer").select("bucket", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def extraction_counts(records: DataFrame, types: list[str]) -> DataFrame:
    """Records per work and type, with the core-coverage predicate."""
    counts = records.groupBy("work_id").agg(*[F.count_if(F.col("record_type") == t).alias(t) for t in types])
    core = (F.col("existed_idea") > 0) & (F.col("principle") > 0) & (F.col("takeaway_message") > 0)
    return counts.withColumn("has_core_coverage", core & ((F.col("benchmark") > 0) | (F.col("baseline") > 0)))


def benchmark_view(benchmarks: DataFrame, results: DataFrame, catalogue: DataFrame | None = None, shown: int | None = None) -> DataFrame:
    """Groups of (task, dataset, split, metric): records, distinct methods, best results.

    ``metric_direction`` of the benchmarks, where there is one, says which results are best:
    "lower..." puts small values first, all else large ones. ``shown`` gives the compact view
    with the best few; without it every method has its result.

    Record ids of a group stay rows of the benchmark table (``group_records``); the
    view counts them and nests only the best few results.
    """
    keys = ["task", "dataset", "split", "metric"]
    if "metric_direction" not in benchmarks.columns:
        benchmarks = benchmarks.withColumn("metric_direction", F.lit(""))
    sign = F.when(F.lower("metric_direction").startswith("lower"), -1.0).otherwise(1.0)
    counts = benchmarks.groupBy(*keys).agg(F.count_distinct("benchmark_id").alias("n_records"))
    rated = results.join(benchmarks.select("benchmark_id", *keys, sign.alias("sign")), "benchmark_id")
    methods = rated.groupBy(*keys).agg(F.count_distinct("method_name").alias("baseline_count"))
    best = rated.groupBy(*keys, "method_name").agg(F.max(F.col("value") * F.col("sign")).alias("score"), F.max_by("value", F.col("value") * F.col("sign")).alias("value"))
    if shown is not None:
        best = top_per_group(best, keys, [F.desc("score"), F.asc("method_name")], shown)
    nested = best.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "method_name", "value"))).alias("performance"))
    out = counts.join(methods, keys, "left").join(nested, keys, "left").fillna(0, ["baseline_count"])
    if catalogue is not None:
        out = out.join(catalogue.select(F.col("official_name").alias("dataset"), "official_url", "scale"), "dataset", "left")
    return out


def group_records(benchmarks: DataFrame) -> DataFrame:
    return benchmarks.select("task", "dataset", "split", "metric", "benchmark_id").distinct()


def baseline_view(baselines: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Baselines by canonical name and the ``dataset · metric`` pairs they appear in, as rows."""
    named = baselines.withColumn("baseline_name", canonical_method_name("baseline_name"))
    rows = named.join(benchmarks.select("benchmark_id", "dataset", "metric"), "benchmark_id")
    return rows.groupBy("baseline_name", F.concat_ws(" · ", "dataset", "metric").alias("benchmark")).agg(
        F.count_distinct("work_id").alias("n_works")
    )


def dashboard(counts: dict[str, DataFrame], **flags: tuple[DataFrame, Column]) -> DataFrame:
    """Named counts, each one aggregate over its table; flags count the rows that meet a condition."""
    out = None
    for name, rows in counts.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    for name, (rows, condition) in flags.items():
        out = out.unionByName(rows.agg(F.count_if(condition).alias("n")).select(F.lit(name).alias("name"), "n"))
    return out


def coverage(works: DataFrame, facts: DataFrame, types: list[str]) -> DataFrame:
    """Share of works with at least one fact of each type, and the mean share as ``overall``."""
    total = works.agg(F.count_distinct("work_id")).scalar()
    have = facts.groupBy("fact_type").agg(F.count_distinct("work_id").alias("n_works"))
    names = facts.sparkSession.createDataFrame([(t,) for t in types], "fact_type string")
    rows = names.join(have, "fact_type", "left").withColumn("total", total)
    share = F.when(F.col("total") > 0, F.coalesce("n_works", F.lit(0)) / F.col("total")).otherwise(F.lit(0.0))
    shares = rows.select("fact_type", share.alias("share"))
    return shares.unionByName(shares.agg(F.avg("share").alias("share")).select(F.lit("overall").alias("fact_type"), "share"))


def families(principles: DataFrame, sources: DataFrame, ideas: DataFrame) -> DataFrame:
    """Works, ideas and mean confidence per principle family."""
    base = principles.groupBy("family").agg(F.count(F.lit(1)).alias("n_principles"), F.avg("confidence").alias("mean_confidence"))
    member = principles.select("principle_id", "family")
    works = sources.join(member, "principle_id").groupBy("family").agg(F.count_distinct("work_id").alias("n_works"))
    used = ideas.join(member, "principle_id").groupBy("family").agg(F.count_distinct("idea_id").alias("n_ideas"))
    return base.join(works, "family", "left").join(used, "family", "left").fillna(0, ["n_works", "n_ideas"])


def top_principles(principles: DataFrame, sources: DataFrame, ideas: DataFrame, k: int) -> DataFrame:
    works = sources.groupBy("principle_id").agg(F.count_distinct("work_id").alias("source_work_count"))
    used = ideas.groupBy("principle_id").agg(F.count_distinct("idea_id").alias("idea_count"))
    joined = principles.join(works, "principle_id", "left").join(used, "principle_id", "left")
    joined = joined.fillna(0, ["source_work_count", "idea_count"])
    return joined.orderBy(F.desc("source_work_count"), F.desc("idea_count"), F.asc("principle_id")).limit(k)


def fact_view(facts: DataFrame, works: DataFrame, fact_type: str) -> DataFrame:
    return facts.filter(F.col("fact_type") == fact_type).join(works.select("work_id", F.col("title").alias("work_title")), "work_id")


def type_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def timeline(parts: dict[str, DataFrame]) -> DataFrame:
    """(at, type, label, id) rows of several tables, newest first."""
    out = None
    for kind, df in parts.items():
        rows = df.select("at", F.lit(kind).alias("type"), "label", F.col("id").cast("string").alias("id"))
        out = rows if out is None else out.unionByName(rows)
    return out.orderBy(F.desc("at"), "type", "id")


def work_badges(works: DataFrame, facts: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Per work: has a core idea, has an insight, number of benchmarks, highlighted."""
    flags = facts.groupBy("work_id").agg(
        F.bool_or(F.col("fact_type") == "core_idea").alias("has_core_idea"),
        F.bool_or(F.col("fact_type") == "insight").alias("has_insight"),
    )
    counts = benchmarks.groupBy("work_id").agg(F.count(F.lit(1)).alias("n_benchmarks"))
    joined = works.select("work_id", "highlighted").join(flags, "work_id", "left").join(counts, "work_id", "left")
    return joined.fillna(False, ["has_core_idea", "has_insight"]).fillna(0, ["n_benchmarks"])


FEEDBACK_SCHEMA = (
    '{"outcome_label":["supported","contradicted","implementation_failed"],'
    '"metric_delta_observed":"string","notes":"string","failure_modes":["string"]}'
)


def export_bundle(
    ideas: DataFrame, idea_principles: DataFrame, principles: DataFrame, idea_works: DataFrame, works: DataFrame,
    evidence: DataFrame, estimates: DataFrame, plans: DataFrame,
) -> DataFrame:
    """Export rows (idea_id, section, payload): idea, principles, works, evidence, estimate, plan, feedback schema.

    A bundle is the rows of one idea, so an idea with very many sources stays many
    rows; ``df.write.partitionBy("section").json`` is the sink.
    """
    sources = idea_works.select("idea_id", "work_id")
    parts = {
        "idea": ideas,
        "principles": idea_principles.select("idea_id", "principle_id").join(principles, "principle_id"),
        "works": sources.join(works, "work_id"),
        "benchmark_evidence": sources.join(evidence, "work_id"),
        "estimate": estimates,
        "plan": plans,
    }
    out = ideas.select("idea_id", F.lit("feedback_schema").alias("section"), F.lit(FEEDBACK_SCHEMA).alias("payload"))
    for section, df in parts.items():
        payload = F.to_json(F.struct(*[c for c in df.columns if c != "idea_id"]))
        out = out.unionByName(df.select("idea_id", F.lit(section).alias("section"), payload.alias("payload")))
    return out


def bundle_counts(bundle: DataFrame, pieces: int | None = None) -> DataFrame:
    """Rows per idea and section; dealt by idea into ``pieces``, as small rows are otherwise put together to large tasks."""
    if pieces is not None:
        bundle = bundle.select("idea_id", "section").repartition(pieces, "idea_id")
    return bundle.groupBy("idea_id", "section").agg(F.count(F.lit(1)).alias("n"))


def report_sections(ideas: DataFrame, sections: list[str]) -> DataFrame:
    """Ordered report sections of every idea as (project_id, idea_id, pos, heading, body) rows."""
    items = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(s).alias("heading"), F.col(s).cast("string").alias("body")) for i, s in enumerate(sections, 1)])
    return ideas.select("project_id", "idea_id", F.inline(items)).filter("body is not null and body <> ''")


def with_defaults(ideas: DataFrame, estimates: DataFrame, plans: DataFrame) -> DataFrame:
    """Idea with its estimate and plan, defaults where a field is missing."""
    joined = ideas.join(estimates, "idea_id", "left").join(plans, "idea_id", "left")
    return joined.fillna({"effort": "unknown", "risk": "unknown"}).withColumn("steps", F.coalesce("steps", F.array().cast("array<string>")))


