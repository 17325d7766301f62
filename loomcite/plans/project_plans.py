"""Projects, retention, budgets, feedback and run logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ids import stable_id
from ..functions.text import estimate_tokens
from ..operators.budget import first_breach, guard, spend_totals
from ..operators.evidence import note_fact, resolve_refs
from ..operators.feedback import failure_modes, idea_status, principle_state
from ..operators.folds import update_flags
from ..operators.membership import (
    counts_by_type,
    delete_deep,
    delete_shallow,
    deleted_counts,
    project_concepts,
    project_list,
    reorder,
    sort_key,
    tab_page,
    upsert_memberships,
)
from ..operators.ranking import top_per_group
from ..operators.retention import drop_relations, pruned, retained, touch_usage, unlink_works
from ..operators.runs import active_jobs, after_cancel, distinct_events, progress, queue_positions, run_status, stale_runs
from . import duck
from .registry import query, table
from .standins import memberships, runs, works

TS = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"


def stamp(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


@query("membership_counts", "SELECT user_id AS project_id, event_type AS record_type, count(*) AS n FROM events WHERE value >= 5 GROUP BY ALL")
def membership_counts(spark, sf_dir):
    return counts_by_type(memberships(spark, sf_dir))


@query(
    "membership_upsert",
    f"""SELECT {duck.stable_id("PM", "user_id", "event_type", "event_id % 50")} AS membership_id, arg_max(value < 5, event_id) AS hidden, max(event_id) AS updated_at, min(event_id) AS created_at
FROM events GROUP BY user_id, event_type, event_id % 50""",
)
def membership_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("project_id"), F.col("event_type").alias("record_type"), (F.col("event_id") % 50).alias("record_id"),
        (F.col("value") < 5).alias("hidden"), F.col("event_id").alias("seq"), F.col("event_id").alias("created_at"),
    )
    keyed = rows.withColumn("membership_id", stable_id("PM", "project_id", "record_type", "record_id"))
    out = upsert_memberships(keyed.filter("seq % 4 > 0"), rows.filter("seq % 4 = 0"))
    return out.select("membership_id", "hidden", F.col("seq").alias("updated_at"), "created_at")


@query(
    "project_tab_page",
    f"""WITH v AS (SELECT user_id AS project_id, event_type AS record_type, event_id AS record_id, {TS.format("ts")} AS created_at FROM events WHERE value >= 5),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY project_id, record_type ORDER BY created_at, record_id) AS INTEGER) AS rn, count(*) OVER (PARTITION BY project_id, record_type) AS total FROM v)
SELECT *, total > 10 AS has_more FROM r WHERE rn > 5 AND rn <= 10""",
)
def project_tab_page(spark, sf_dir):
    out = tab_page(memberships(spark, sf_dir), 5, 5)
    return out.select("project_id", "record_type", "record_id", stamp("created_at").alias("created_at"), "rn", "total", "has_more")


COMPOSITE = "10.0::DOUBLE * (CASE WHEN doc_id % 3 = 1 THEN 4 WHEN doc_id % 3 = 0 THEN 1 ELSE 3 END) + 1.0::DOUBLE * relevance + 0.001::DOUBLE * work_year"


@query(
    "tab_sort_modes",
    f"""WITH r AS (SELECT doc_id, source, doc_id AS modified, (n_chars % 100) / 100 AS relevance, 1990 + n_chars % 36 AS work_year FROM documents),
k AS (SELECT doc_id, source, m AS mode, CASE m WHEN 'modified' THEN modified WHEN 'relevance' THEN relevance WHEN 'work_year' THEN work_year ELSE {COMPOSITE} END AS key FROM r, (VALUES ('modified'), ('relevance'), ('work_year'), ('composite')) t(m))
SELECT mode, source, doc_id AS record_id, CAST(row_number() OVER (PARTITION BY mode, source ORDER BY round(key, 9) DESC, doc_id) AS INTEGER) AS rn FROM k QUALIFY rn <= 10""",
)
def tab_sort_modes(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        "source", F.col("doc_id").alias("record_id"), F.col("doc_id").alias("modified"), (F.col("n_chars") % 100 / 100).alias("relevance"),
        (F.lit(1990) + F.col("n_chars") % 36).alias("work_year"),
        F.when(F.col("doc_id") % 3 == 1, "ICML").when(F.col("doc_id") % 3 == 0, "arXiv").otherwise("a journal").alias("venue"),
    )
    out = None
    for mode in ("modified", "relevance", "work_year", "composite"):
        top = top_per_group(rows, ["source"], sort_key(mode), 10).select(F.lit(mode).alias("mode"), "source", "record_id", "rn")
        out = top if out is None else out.unionByName(top)
    return out


@query(
    "project_concepts",
    """WITH c AS (SELECT p_partkey AS concept_id, p_type AS concept_type FROM part),
m AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'concept' ELSE 'SMALL' END AS record_type, event_id % 2000 AS record_id FROM events WHERE user_id = 7 AND value >= 5)
SELECT * FROM c WHERE EXISTS (SELECT 1 FROM m WHERE m.record_id = c.concept_id AND m.record_type IN ('concept', c.concept_type))""",
)
def project_concepts_query(spark, sf_dir):
    cards = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("concept_id"), F.col("p_type").alias("concept_type"))
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("project_id"), F.when(F.col("event_id") % 2 == 0, "concept").otherwise("SMALL").alias("record_type"),
        (F.col("event_id") % 2000).alias("record_id"), (F.col("value") < 5).alias("hidden"),
    )
    return project_concepts(cards, rows, 7)


def _delete_tables(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    member = events.select(
        F.col("user_id").alias("project_id"), F.when(F.col("event_type") == "view", "work").otherwise("concept").alias("record_type"),
        F.when(F.col("event_type") == "view", F.col("event_id") % 1000).otherwise(F.col("event_id") % 2000).alias("record_id"),
    )
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("work_id"))
    turns = table(spark, sf_dir, "conversations")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("concept_id"))
    deriv = turns.select(F.col("conv_id").alias("derivation_id"), "turn")
    return {
        "membership": member, "concept": parts, "symbol": parts,
        "evidence": table(spark, sf_dir, "labels").select((F.col("doc_id") * 7 % 2000).alias("concept_id"), F.col("doc_id").alias("work_id")),
        "concept_version": table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("concept_id")),
        "derivation_run": deriv.filter("turn = 0").select("derivation_id", F.col("derivation_id").alias("project_id")),
        "derivation_edge": deriv.filter("turn > 0"),
        "derivation_node": deriv.select("derivation_id", (F.col("derivation_id") * 8 + F.col("turn")).alias("concept_id")),
        "work": docs, "work_version": docs,
        "extraction_run": table(spark, sf_dir, "labels").select(F.col("doc_id").alias("work_id")),
    }


@query(
    "project_delete_deep",
    """WITH m AS (SELECT user_id AS p, event_type = 'view' AS w, CASE WHEN event_type = 'view' THEN event_id % 1000 ELSE event_id % 2000 END AS id FROM events),
mine AS (SELECT * FROM m WHERE p < 100), kept AS (SELECT * FROM m WHERE p >= 100),
c AS (SELECT p_partkey AS id FROM part WHERE p_partkey IN (SELECT id FROM mine WHERE NOT w) AND p_partkey NOT IN (SELECT id FROM kept WHERE NOT w)),
ev AS (SELECT doc_id * 7 % 2000 AS cid, doc_id AS wid FROM labels),
wk AS (SELECT doc_id AS id FROM documents WHERE doc_id IN (SELECT id FROM mine WHERE w) AND doc_id NOT IN (SELECT id FROM kept WHERE w)
       AND doc_id NOT IN (SELECT wid FROM ev WHERE cid NOT IN (SELECT id FROM c)))
SELECT 'membership' AS table_name, (SELECT count(*) FROM mine) AS n_deleted UNION ALL SELECT 'concept', count(*) FROM c UNION ALL SELECT 'symbol', count(*) FROM c
UNION ALL SELECT 'evidence', count(*) FROM ev WHERE cid IN (SELECT id FROM c) UNION ALL SELECT 'concept_version', count(*) FROM lineitem WHERE l_partkey IN (SELECT id FROM c)
UNION ALL SELECT 'derivation_run', count(*) FROM conversations WHERE turn = 0 AND conv_id < 100 UNION ALL SELECT 'derivation_edge', count(*) FROM conversations WHERE turn > 0 AND conv_id < 100
UNION ALL SELECT 'derivation_node', count(*) FROM conversations WHERE conv_id < 100 UNION ALL SELECT 'derivation_node_unlinked', count(*) FROM conversations WHERE conv_id >= 100 AND conv_id * 8 + turn IN (SELECT id FROM c)
UNION ALL SELECT 'work', count(*) FROM wk UNION ALL SELECT 'work_version', count(*) FROM wk UNION ALL SELECT 'extraction_run', count(*) FROM labels WHERE doc_id IN (SELECT id FROM wk)""",
)
def project_delete_deep(spark, sf_dir):
    projects = table(spark, sf_dir, "events").select(F.col("user_id").alias("project_id"))
    projects = projects.unionByName(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("project_id")))
    gone = projects.filter("project_id < 100").distinct()
    return deleted_counts(delete_deep(_delete_tables(spark, sf_dir), gone))


@query("project_delete_shallow", "SELECT user_id AS project_id, count(*) AS n FROM events WHERE user_id >= 100 GROUP BY 1")
def project_delete_shallow(spark, sf_dir):
    rows = memberships(spark, sf_dir)
    gone = rows.select("project_id").distinct().filter("project_id < 100")
    return delete_shallow(rows, gone).groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))


CAPS = {"view": 500, "click": 1000, "signup": 100}
RETAINED = """r AS (SELECT event_type AS bucket, event_id AS id, row_number() OVER (PARTITION BY event_type ORDER BY value > 200 DESC, user_id % 5 DESC, event_id DESC) AS rn FROM events)"""
CAP_CASE = "CASE bucket WHEN 'view' THEN 500 WHEN 'click' THEN 1000 WHEN 'signup' THEN 100 END"


def _records(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("bucket"), F.col("event_id").alias("id"), (F.col("value") > 200).alias("highlighted"),
        (F.col("user_id") % 5).alias("usage_count"), F.col("event_id").alias("recency"),
    )


@query("retention_keep_n", f"WITH {RETAINED} SELECT bucket, id FROM r WHERE rn <= coalesce({CAP_CASE}, rn)")
def retention_keep_n(spark, sf_dir):
    return retained(_records(spark, sf_dir), CAPS).select("bucket", "id")


@query("retention_pruned", f"WITH {RETAINED} SELECT bucket, id FROM r WHERE rn > {CAP_CASE}")
def retention_pruned(spark, sf_dir):
    return pruned(_records(spark, sf_dir), CAPS).select("bucket", "id")


@query(
    "usage_touch",
    f"""WITH u AS (SELECT user_id AS id, count(DISTINCT event_id // 10) AS n, max({TS.format("ts")}) AS last FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT c_custkey AS id, c_custkey % 4 + coalesce(n, 0) AS usage_count, coalesce(last, '') AS last_used_at FROM customer LEFT JOIN u ON id = c_custkey""",
)
def usage_touch(spark, sf_dir):
    items = table(spark, sf_dir, "customer").select(
        F.lit("ideas").alias("bucket"), F.col("c_custkey").alias("id"), (F.col("c_custkey") % 4).alias("usage_count"), F.lit("").alias("last_used_at")
    )
    calls = table(spark, sf_dir, "events").filter("event_type = 'view'").select(
        F.lit("ideas").alias("bucket"), F.col("user_id").alias("id"), F.floor(F.col("event_id") / 10).alias("call_id"), stamp("ts").alias("called_at")
    )
    return touch_usage(items, calls).select("id", "usage_count", "last_used_at")


@query(
    "source_removal",
    """WITH g AS (SELECT s_suppkey FROM supplier WHERE s_nationkey < 20), l AS (SELECT DISTINCT l_partkey AS principle_id, l_suppkey AS work_id FROM lineitem),
k AS (SELECT principle_id, count(*) AS n FROM l WHERE work_id NOT IN (SELECT s_suppkey FROM g) GROUP BY 1)
SELECT principle_id, coalesce(k.n, 0) AS n_left FROM (SELECT DISTINCT principle_id FROM l) LEFT JOIN k USING (principle_id)""",
)
def source_removal(spark, sf_dir):
    sources = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("principle_id"), F.col("l_suppkey").alias("work_id")).distinct()
    removed = table(spark, sf_dir, "supplier").filter("s_nationkey < 20").select(F.col("s_suppkey").alias("work_id"))
    remaining, emptied = unlink_works(sources, removed)
    left = remaining.groupBy("principle_id").agg(F.count(F.lit(1)).alias("n_left"))
    return left.unionByName(emptied.withColumn("n_left", F.lit(0).cast("bigint")))


@query(
    "relation_cascade",
    """WITH r AS (SELECT l_partkey AS a, l_suppkey AS b, l_orderkey, l_linenumber FROM lineitem), g AS (SELECT p_partkey AS id FROM part WHERE p_size < 10)
SELECT l_orderkey, l_linenumber FROM r WHERE a NOT IN (SELECT id FROM g) AND b NOT IN (SELECT id FROM g)""",
)
def relation_cascade(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("source_principle_id"), F.col("l_suppkey").alias("target_principle_id"), "l_orderkey", "l_linenumber"
    )
    removed = table(spark, sf_dir, "part").filter("p_size < 10").select(F.col("p_partkey").alias("principle_id"))
    return drop_relations(edges, removed).select("l_orderkey", "l_linenumber")


@query(
    "flag_update",
    """SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN true ELSE c_custkey % 2 = 0 END AS highlighted, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 6 = 0 ELSE false END AS validated,
       CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 6 = 0 THEN 'validated' ELSE 'unvalidated' END ELSE 'new' END AS feedback_status FROM customer""",
)
def flag_update(spark, sf_dir):
    key = F.col("c_custkey")
    people = table(spark, sf_dir, "customer")
    items = people.select(key.alias("id"), (key % 2 == 0).alias("highlighted"), F.lit(False).alias("validated"), F.lit("new").alias("feedback_status"), F.lit(0).alias("updated_at"))
    changes = people.filter("c_custkey % 3 = 0").select(key.alias("id"), F.lit(True).alias("highlighted"), (key % 6 == 0).alias("validated"), F.lit(1).alias("at"))
    return update_flags(items, changes, "id", ideas=True).drop("updated_at")


@query(
    "project_list",
    """WITH c AS (SELECT user_id AS p, count(*) FILTER (event_type = 'view' AND value >= 5) AS n_view, count(*) FILTER (event_type = 'click' AND value >= 5) AS n_click FROM events GROUP BY 1),
l AS (SELECT user_id AS p, arg_max(event_type, (ts, event_id)) AS last_status FROM events GROUP BY 1)
SELECT 'U' || p AS project_id, n_view, n_click, last_status FROM c JOIN l USING (p)""",
)
def project_list_query(spark, sf_dir):
    rows = memberships(spark, sf_dir).withColumn("project_id", F.concat(F.lit("U"), "project_id"))
    log = table(spark, sf_dir, "events").select(
        F.concat(F.lit("U"), "user_id").alias("project_id"), F.col("event_id").alias("run_id"), F.col("ts").alias("updated_at"), F.col("event_type").alias("status")
    )
    return project_list(rows.select("project_id").distinct(), rows, log, ["view", "click"])


@query(
    "project_reorder",
    "SELECT n_nationkey AS project_id, CASE WHEN n_nationkey % 2 = 0 THEN 100 - n_nationkey ELSE n_nationkey END AS display_order FROM nation",
)
def project_reorder(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("project_id"), F.col("n_nationkey").alias("display_order"))
    wanted = rows.filter("project_id % 2 = 0").select((F.lit(100) - F.col("project_id")).alias("pos"), "project_id")
    return reorder(rows, wanted)


@query(
    "refs_resolved",
    """WITH r AS (SELECT l_orderkey AS owner, l_linenumber AS pos, CASE WHEN l_linenumber % 2 = 0 THEN 'principles' ELSE 'source_works' END AS bucket, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey ELSE l_suppkey END AS id FROM lineitem),
t AS (SELECT 'principles' AS bucket, p_partkey AS id, p_name AS label FROM part UNION ALL SELECT 'source_works', s_suppkey, s_name FROM supplier)
SELECT owner, pos, bucket, id, label FROM r JOIN t USING (bucket, id)""",
)
def refs_resolved(spark, sf_dir):
    even = F.col("l_linenumber") % 2 == 0
    refs = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("owner"), F.col("l_linenumber").alias("pos"), F.when(even, "principles").otherwise("source_works").alias("bucket"),
        F.when(even, F.col("l_partkey")).otherwise(F.col("l_suppkey")).alias("id"),
    )
    tables = table(spark, sf_dir, "part").select(F.lit("principles").alias("bucket"), F.col("p_partkey").alias("id"), F.col("p_name").alias("label")).unionByName(
        table(spark, sf_dir, "supplier").select(F.lit("source_works").alias("bucket"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("label"))
    )
    return resolve_refs(refs, tables).select("owner", "pos", "bucket", "id", "label")


@query("user_notes", f"SELECT conv_id AS owner, {duck.stable_id('UN', 'conv_id', 'text')} AS fact_id FROM conversations WHERE role = 'user' AND trim(text) <> ''")
def user_notes(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").filter("role = 'user'").select(F.col("conv_id").alias("owner"), F.col("text").alias("note"))
    return note_fact(rows).select("owner", "fact_id")


# ---------------------------------------------------------------- feedback and budget

FEEDBACK = """f AS (SELECT user_id AS idea, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'supported' WHEN 'error' THEN 'contradicted' WHEN 'click' THEN 'implementation_failed' END AS o FROM events WHERE event_type IN ('purchase', 'error', 'click'))"""


def _feedback(spark, sf_dir):
    kind = F.when(F.col("event_type") == "purchase", "supported").when(F.col("event_type") == "error", "contradicted").when(F.col("event_type") == "click", "implementation_failed")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("idea_id"), F.col("event_id").alias("seq"), kind.alias("outcome_label"), F.array("props").alias("failure_modes"))
    rows = rows.filter("outcome_label is not null")
    links = rows.select("idea_id").distinct().withColumn("principle_id", F.col("idea_id") % 20)
    return rows, links


@query("feedback_fold", f"WITH {FEEDBACK} SELECT idea AS idea_id, arg_max(o, seq) AS feedback_status, count(*) AS n_feedback FROM f GROUP BY idea")
def feedback_fold(spark, sf_dir):
    return idea_status(_feedback(spark, sf_dir)[0])


@query(
    "feedback_principles",
    f"""WITH {FEEDBACK}, s AS (SELECT idea % 20 AS pid, list_reduce(list(CASE o WHEN 'supported' THEN 0.12::DOUBLE WHEN 'contradicted' THEN -0.18::DOUBLE ELSE -0.06::DOUBLE END ORDER BY seq), lambda x, y: greatest(0.05::DOUBLE, least(0.99::DOUBLE, x + y)), 0.5::DOUBLE) AS c, bool_or(o = 'supported') AS ok FROM f GROUP BY 1)
SELECT pid AS principle_id, round_even(c, 4) AS confidence, CASE WHEN ok THEN 'L4' ELSE 'L1' END AS validation_level FROM s""",
)
def feedback_principles(spark, sf_dir):
    rows, links = _feedback(spark, sf_dir)
    cards = links.select("principle_id").distinct().select("principle_id", F.lit(0.5).alias("confidence"), F.lit("L1").alias("validation_level"))
    return principle_state(cards, rows, links).withColumn("confidence", F.bround("confidence", 4))


@query(
    "feedback_failure_modes",
    "SELECT user_id % 20 AS principle_id, props AS value, min(event_id) AS seq FROM events WHERE event_type = 'error' GROUP BY 1, 2",
)
def feedback_failure_modes(spark, sf_dir):
    rows, links = _feedback(spark, sf_dir)
    return failure_modes(rows, links).select("principle_id", "value", "seq")


LIMIT = 600


@query(
    "budget_guard",
    f"""WITH RECURSIVE c AS (SELECT conv_id AS run_id, turn AS seq, greatest(1, length(text) // 4) AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
g AS (SELECT run_id, seq, cost, rn, cost <= {LIMIT} AS accepted, CASE WHEN cost <= {LIMIT} THEN cost ELSE 0 END AS spent FROM c WHERE rn = 1
  UNION ALL SELECT c.run_id, c.seq, c.cost, c.rn, g.spent + c.cost <= {LIMIT}, CASE WHEN g.spent + c.cost <= {LIMIT} THEN g.spent + c.cost ELSE g.spent END FROM g JOIN c ON c.run_id = g.run_id AND c.rn = g.rn + 1)
SELECT run_id, seq, cost, accepted FROM g""",
)
def budget_guard(spark, sf_dir):
    return guard(_calls(spark, sf_dir), LIMIT)


def _calls(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"), estimate_tokens("text").alias("cost"), F.col("role").alias("model")
    )


@query(
    "budget_guard_prices",
    """WITH RECURSIVE c AS (SELECT conv_id AS run_id, turn AS seq, greatest(1, length(text) // 4) * 3 / 1000.0 AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
g AS (SELECT run_id, seq, cost, rn, cost <= 1.5 AS accepted, CASE WHEN cost <= 1.5 THEN cost ELSE 0 END AS spent FROM c WHERE rn = 1
  UNION ALL SELECT c.run_id, c.seq, c.cost, c.rn, round(g.spent + c.cost, 6) <= 1.5, CASE WHEN round(g.spent + c.cost, 6) <= 1.5 THEN round(g.spent + c.cost, 6) ELSE g.spent END FROM g JOIN c ON c.run_id = g.run_id AND c.rn = g.rn + 1)
SELECT run_id, seq, CAST(cost AS DOUBLE) AS cost, accepted FROM g""",
)
def budget_guard_prices(spark, sf_dir):
    return guard(_calls(spark, sf_dir).withColumn("cost", F.col("cost") * 3 / 1000), 1.5)


@query(
    "budget_first_breach",
    f"""WITH c AS (SELECT conv_id AS run_id, turn AS seq, sum(greatest(1, length(text) // 4)) OVER (PARTITION BY conv_id ORDER BY turn) AS spent FROM conversations)
SELECT run_id, min(seq) AS seq, CAST(arg_min(spent, seq) AS BIGINT) AS spent FROM c WHERE spent > {LIMIT} GROUP BY run_id""",
)
def budget_first_breach(spark, sf_dir):
    return first_breach(_calls(spark, sf_dir), LIMIT)


@query("spend_totals", "SELECT conv_id AS run_id, role AS model, CAST(sum(greatest(1, length(text) // 4)) AS BIGINT) AS spent, count(*) AS n_calls FROM conversations GROUP BY ALL")
def spend_totals_query(spark, sf_dir):
    return spend_totals(_calls(spark, sf_dir))


# ---------------------------------------------------------------- runs

STATUS = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'error' ELSE 'running' END"
LAST = f"last AS (SELECT user_id AS run_id, arg_max({STATUS}, (ts, event_id)) AS status, max(ts) AS updated_at, count(*) AS n_updates FROM events GROUP BY 1)"
STALE_SECONDS = 6 * 3600


@query("run_status", f"WITH {LAST} SELECT run_id, status, {TS.format('updated_at')} AS updated_at, n_updates FROM last")
def run_status_query(spark, sf_dir):
    return run_status(runs(spark, sf_dir)).withColumn("updated_at", stamp("updated_at"))


@query(
    "stale_runs",
    f"""WITH {LAST}, n AS (SELECT max(ts) AS now FROM events)
SELECT run_id, status = 'running' AND epoch_us(updated_at) < epoch_us(now) - {STALE_SECONDS}000000 AS recovered, CASE WHEN status = 'running' AND epoch_us(updated_at) < epoch_us(now) - {STALE_SECONDS}000000 THEN 'partial_error' ELSE status END AS status FROM last, n""",
)
def stale_runs_query(spark, sf_dir):
    log = runs(spark, sf_dir).withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    now = log.agg(F.max("updated_at")).scalar()
    status = run_status(log).withColumn("now", now)
    return stale_runs(status, F.col("now"), STALE_SECONDS).select("run_id", "recovered", "status")


@query("queue_position", "SELECT event_id AS run_id, row_number() OVER (ORDER BY event_id) AS queue_position FROM events WHERE event_type = 'signup'")
def queue_position(spark, sf_dir):
    jobs = runs(spark, sf_dir).select(F.col("seq").alias("run_id"), "status", "seq")
    return queue_positions(jobs).select("run_id", "queue_position")


@query(
    "active_dedupe",
    f"""WITH a AS (SELECT event_id, user_id AS work_id, event_id % 3 AS project_id FROM events WHERE {STATUS} IN ('queued', 'running'))
SELECT event_id AS run_id, work_id, project_id, min(event_id) OVER (PARTITION BY work_id, project_id) AS active_run_id, event_id = min(event_id) OVER (PARTITION BY work_id, project_id) AS accepted FROM a""",
)
def active_dedupe(spark, sf_dir):
    rows = runs(spark, sf_dir).select(F.col("seq").alias("run_id"), F.col("run_id").alias("work_id"), (F.col("seq") % 3).alias("project_id"), "status", "seq")
    return active_jobs(rows).select("run_id", "work_id", "project_id", "active_run_id", "accepted")


@query(
    "cancelled_results",
    """WITH c AS (SELECT user_id, min(event_id) AS stopped FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT event_id, coalesce(event_id > stopped, false) AND event_type <> 'error' AS rejected FROM events LEFT JOIN c USING (user_id)""",
)
def cancelled_results(spark, sf_dir):
    log = runs(spark, sf_dir).withColumn("status", F.when(F.col("status") == "error", "cancelled").otherwise(F.col("status")))
    return after_cancel(log).select(F.col("seq").alias("event_id"), "rejected")


@query(
    "run_progress",
    "SELECT user_id AS run_id, event_type AS stage, CAST(arg_max(value, event_id) AS BIGINT) AS found, arg_max(event_id % 200, event_id) AS target FROM events GROUP BY 1, 2",
)
def run_progress(spark, sf_dir):
    rows = runs(spark, sf_dir).select("run_id", F.col("event_type").alias("stage"), F.bround("value").cast("bigint").alias("found"), (F.col("seq") % 200).alias("target"), "seq")
    return progress(rows)


@query(
    "run_event_ids",
    f"""WITH k AS (SELECT event_id, {duck.stable_id("RE", "user_id", "event_type", "''", "strftime(ts, '%Y-%m-%dT%H:%M:%S')")} AS id, ts FROM events)
SELECT id AS event_id, min(event_id) AS seq FROM k GROUP BY id""",
)
def run_event_ids(spark, sf_dir):
    rows = runs(spark, sf_dir).select("run_id", "event_type", F.lit("").alias("message"), F.col("updated_at").alias("created_at"), "seq")
    return distinct_events(rows).select("event_id", "seq")
