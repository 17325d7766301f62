"""Queries of operators on single records and small lists, and of feeds that arrive together."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import goal_kind, split_list_text
from ..operators.derivation import expand_symbols
from ..operators.membership import project_detail
from ..operators.quality import compact_record, passes_contract
from ..operators.ranking import page
from ..operators.retention import clear_records
from ..operators.works import merge_feeds, replaced
from ..session import checkpoint_folder
from ..sources.feeds import read_feeds, read_json_feed
from . import duck
from .registry import query, table
from .standins import works


@query(
    "goal_kinds",
    """WITH v AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN ' My Idea draft : ' WHEN 1 THEN 'Of my idea draft: ' ELSE '' END || text AS v FROM conversations)
SELECT conv_id, turn, CASE WHEN regexp_matches(coalesce(v, ''), '(?i)^\\s*my idea draft\\s*[:：]') THEN 'idea_draft' ELSE 'task' END AS kind FROM v""",
)
def goal_kinds(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    head = F.when(F.col("turn") % 3 == 0, " My Idea draft : ").when(F.col("turn") % 3 == 1, "Of my idea draft: ").otherwise("")
    return turns.select("conv_id", "turn", goal_kind(F.concat(head, "text")).alias("kind"))


@query(
    "text_lists",
    """SELECT p_partkey, p_name || '.|Next ' || p_type || ';|' || p_brand AS items FROM part""",
)
def text_lists(spark, sf_dir):
    said = F.concat("p_name", F.lit(". Next "), "p_type", F.lit(";\n\n "), "p_brand", F.lit("\n"), "p_name", F.lit("."))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(split_list_text(said), "|").alias("items"))


@query("records_cleared", "SELECT event_type AS bucket, event_id AS id FROM events WHERE event_type = 'signup'")
def records_cleared(spark, sf_dir):
    items = table(spark, sf_dir, "events").select(F.col("event_type").alias("bucket"), F.col("event_id").alias("id"))
    return clear_records(items, ("signup",))


DETAIL = """WITH mine AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_suppkey = 1 AND l_quantity >= 5)"""


@query(
    "project_detail",
    f"""{DETAIL} SELECT 'work' AS kind, p_partkey AS work_id, p_name AS said FROM part WHERE p_partkey IN (SELECT l_partkey FROM mine)
UNION ALL SELECT 'fact', l_partkey, CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR) FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM mine)""",
)
def project_detail_query(spark, sf_dir):
    """The works of a project and all facts about them."""
    lines = table(spark, sf_dir, "lineitem")
    members = lines.select(
        F.concat(F.lit("S"), "l_suppkey").alias("project_id"), F.lit("work").alias("record_type"), F.col("l_partkey").alias("record_id"), (F.col("l_quantity") < 5).alias("hidden"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("work_id"), F.col("p_name").alias("said"))
    facts = lines.select(
        F.col("l_partkey").alias("work_id"), F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("said"), F.col("l_orderkey").alias("seq"))
    kept, told = project_detail(parts, members, "S1", facts)
    return kept.select(F.lit("work").alias("kind"), "work_id", "said").unionByName(told.select(F.lit("fact").alias("kind"), "work_id", "said"))


@query(
    "evidence_pages",
    """WITH r AS (SELECT l_returnflag AS source_type, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) AS rn, count(*) OVER (PARTITION BY l_returnflag) AS total FROM lineitem)
SELECT source_type, l_orderkey, l_linenumber, CAST(rn AS INTEGER) AS rn, total, total > 60 AS has_more FROM r WHERE rn > 40 AND rn <= 60""",
)
def evidence_pages(spark, sf_dir):
    """The third page of evidence of every source type, newest first."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("source_type"), "l_orderkey", "l_linenumber", "l_shipdate")
    shown = page(lines, ["source_type"], [F.desc("l_shipdate"), F.asc("l_orderkey"), F.asc("l_linenumber")], 40, 20)
    return shown.select("source_type", "l_orderkey", "l_linenumber", "rn", "total", "has_more")


@query(
    "contract_rows",
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END AS mechanism FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 11 <> 0""",
)
def contract_rows(spark, sf_dir):
    """Principles with argument, discussion and evidence; a mechanism that repeats the argument is emptied."""
    key = F.col("p_partkey")
    blank = lambda n, c: F.when(key % n == 0, F.lit("  ")).otherwise(c)
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", blank(5, F.col("p_name")).alias("argument"), blank(7, F.lit("It holds.")).alias("discussion"), blank(11, F.lit("As seen.")).alias("evidence"),
        F.when(key % 3 == 0, F.upper("p_name")).otherwise(F.col("p_type")).alias("mechanism"))
    return passes_contract(parts, "principle").select("p_partkey", "mechanism")


@query(
    "compact_rows",
    """SELECT l_orderkey, count(*)::INT AS performance_total, array_to_string(list_slice(list(CAST(l_partkey AS VARCHAR) ORDER BY l_linenumber, l_partkey), 1, 2), ',') AS shown FROM lineitem GROUP BY l_orderkey""",
)
def compact_rows(spark, sf_dir):
    """Orders as heavy records: the first two results and their total."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(listed.alias("performance")).withColumn("model_variants", F.lit("x"))
    return compact_record(rows, 2).select("l_orderkey", "performance_total", F.array_join("performance", ",").alias("shown"))


@query(
    "symbol_lists",
    """SELECT p_brand AS owner, item, min(p_partkey) AS pos FROM (SELECT p_brand, p_partkey, CASE WHEN p_partkey % 2 = 0 AND length(p_name) < 32 THEN 'P' || p_partkey || ': ' || p_type
  WHEN p_partkey % 2 = 0 THEN 'P' || p_partkey || ': ' || p_name ELSE 'about ' || p_name END AS item FROM part) GROUP BY p_brand, item""",
)
def symbol_lists(spark, sf_dir):
    """List items that are little more than a symbol get its gloss."""
    parts = table(spark, sf_dir, "part")
    code = F.concat(F.lit("P"), "p_partkey")
    item = F.when(F.col("p_partkey") % 2 == 0, F.concat(code, F.lit(": "), "p_name")).otherwise(F.concat(F.lit("about "), "p_name"))
    items = parts.select(F.col("p_brand").alias("owner"), F.col("p_partkey").alias("pos"), item.alias("item"))
    return expand_symbols(items, parts.select(code.alias("short_code"), F.col("p_type").alias("gloss"))).select("owner", "item", "pos")


FEED_SCHEMA = "title string, abstract string, url string, year int, venue string, citation_count bigint, source_urls array<string>"


def landed_feeds(spark, sf_dir):
    """Three feeds as landed files: works of even documents, of all documents, and one whose lines aren't JSON."""
    folder = f"{checkpoint_folder(spark)}/feeds-{uuid.uuid4().hex}"
    rows = works(spark, sf_dir).select(
        "title", F.substring("abstract", 1, 200).alias("abstract"), F.concat(F.lit("u/"), "doc_id").alias("url"), F.lit(2020).alias("year"), F.lit("ICML").alias("venue"),
        F.col("doc_id").alias("citation_count"), F.array("lang").alias("source_urls"), "doc_id")
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.filter("doc_id % 2 = 0").drop("doc_id").write.json(f"{folder}/first")
    ordered.drop("doc_id").withColumn("venue", F.lit("arXiv")).write.json(f"{folder}/third")
    rows.select(F.col("title").alias("value")).write.text(f"{folder}/second")
    strict = spark.read.schema(FEED_SCHEMA).option("mode", "FAILFAST")
    return [
        ("first", lambda: read_json_feed(spark, f"{folder}/first", FEED_SCHEMA)),
        ("second", lambda: strict.json(f"{folder}/second")),
        ("gone", lambda: strict.json(f"{folder}/never-landed")),
        ("third", lambda: read_json_feed(spark, f"{folder}/third", FEED_SCHEMA)),
    ]


ARRIVED = f"""WITH {duck.WORKS}, a AS (SELECT doc_id, title, 0 AS f, 'ICML' AS venue FROM works WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, title, 3, 'arXiv' FROM works),
s AS (SELECT *, row_number() OVER (ORDER BY f, doc_id) AS seq, {duck.canonical("title")} AS title_key FROM a)"""


@query(
    "feed_arrival",
    f"""{ARRIVED} SELECT title_key, {duck.stable_id("W", "title_key")} AS work_id, min(seq) AS first_seq, arg_min('u/' || doc_id, seq) AS url, arg_min(venue, (CASE venue WHEN 'ICML' THEN 0 ELSE 1 END, seq)) AS venue,
  max(doc_id) AS citation_count, count(*) AS n_rows FROM s WHERE title <> '' GROUP BY title_key""",
)
def feed_arrival(spark, sf_dir):
    """Landed feeds, two of them broken, merged in the order in which they arrived."""
    rows, _ = read_feeds(landed_feeds(spark, sf_dir))
    return merge_feeds(rows).select("title_key", "work_id", "first_seq", "url", "venue", "citation_count", "n_rows")


@query(
    "feed_outcomes",
    "SELECT f AS feed, n AS n_rows FROM (SELECT 'first' AS f, count(*) FILTER (doc_id % 2 = 0) AS n FROM documents UNION ALL SELECT 'third', count(*) FROM documents UNION ALL SELECT unnest(['second', 'gone']), NULL)",
)
def feed_outcomes(spark, sf_dir):
    """Rows of each feed; null where a feed failed."""
    return read_feeds(landed_feeds(spark, sf_dir))[1].select("feed", "n_rows")


@query(
    "stale_cascade",
    """WITH s AS (SELECT DISTINCT 'O' || l_orderkey AS c, l_suppkey AS w FROM lineitem), fresh AS (SELECT DISTINCT 'N' || l_orderkey AS c, l_suppkey AS w FROM lineitem WHERE l_linenumber = 2 AND l_suppkey % 3 = 0),
after AS (SELECT * FROM s WHERE w % 3 <> 0 UNION SELECT * FROM fresh), emptied AS (SELECT DISTINCT c FROM s WHERE w % 3 = 0 AND c NOT IN (SELECT c FROM after)),
kept AS (SELECT 'O' || o_orderkey AS c FROM orders WHERE 'O' || o_orderkey NOT IN (SELECT c FROM emptied))
SELECT 'work' AS kind, CAST(s_suppkey AS VARCHAR) AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'new ' ELSE '' END || s_name AS said FROM supplier
UNION ALL SELECT 'source', c, CAST(w AS VARCHAR) FROM after UNION ALL SELECT 'concept', c, '' FROM kept UNION ALL SELECT DISTINCT 'concept', c, '' FROM fresh
UNION ALL SELECT 'symbol', c, '' FROM kept UNION ALL SELECT 'relation', k.c, 'O' || (CAST(substr(k.c, 2) AS BIGINT) + 1) FROM kept k WHERE 'O' || (CAST(substr(k.c, 2) AS BIGINT) + 1) IN (SELECT c FROM kept)""",
)
def stale_cascade(spark, sf_dir):
    """A third of the suppliers have new versions: their rows are replaced, and orders that rested on them alone go."""
    lines, suppliers, orders = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "orders"))
    work = suppliers.select(F.col("s_suppkey").alias("work_id"), F.col("s_name").alias("said"), F.lit(0).alias("seq"))
    stale = F.col("work_id") % 3 == 0
    decisions = work.select("work_id", F.when(stale, "new_version").otherwise("unchanged").alias("decision"))
    newer = lambda seq, word: work.select("work_id", F.concat(F.lit(word), "said").alias("said"), F.lit(seq).alias("seq"))
    rests = lambda p, rows: rows.select(F.concat(F.lit(p), "l_orderkey").alias("concept_id"), F.col("l_suppkey").alias("work_id")).distinct()
    fresh = rests("N", lines.filter("l_linenumber = 2 and l_suppkey % 3 = 0"))
    cards = orders.select(F.concat(F.lit("O"), "o_orderkey").alias("concept_id"))
    near = orders.select(F.concat(F.lit("O"), "o_orderkey").alias("source_id"), F.concat(F.lit("O"), F.col("o_orderkey") + 1).alias("target_id"))
    near = near.join(cards.select(F.col("concept_id").alias("target_id")), "target_id", "left_semi")
    out = replaced(decisions, newer(1, "old ").unionByName(newer(2, "new ")), work, rests("O", lines), fresh, cards, fresh.select("concept_id").distinct(), cards, near)
    rows = lambda kind, df, one, other: df.select(F.lit(kind).alias("kind"), F.col(one).cast("string").alias("id"), other.alias("said"))
    none = F.lit("")
    return (
        rows("work", out.works, "work_id", F.col("said")).unionByName(rows("source", out.sources, "concept_id", F.col("work_id").cast("string")))
        .unionByName(rows("concept", out.concepts, "concept_id", none)).unionByName(rows("symbol", out.symbols, "concept_id", none))
        .unionByName(rows("relation", out.relations, "source_id", F.col("target_id")))
    )
