import json

import pytest
from pyspark.sql import functions as F

from loomcite.plans import catalog
from loomcite.sources.feeds import CROSSREF_SCHEMA, OPENALEX_SCHEMA, atom_works, crossref_works, openalex_works, quarantine, read_atom_feed, read_feeds, read_json_feed, union_feeds
from loomcite.sources.importer import import_buckets, member_lists
from loomcite.streaming.run_log import ROCKSDB, flag_late_results, recover_stale, split_late
from loomcite.streaming.sinks import drain


def landed(tmp_path, name, rows):
    path = tmp_path / name
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    return str(path)


def test_feeds(spark, tmp_path):
    openalex = landed(tmp_path, "o.json", [
        {"id": "https://openalex.org/W1", "title": "A  Title", "publication_year": 2020, "abstract_inverted_index": {"world": [1], "hello": [0]},
         "primary_location": {"landing_page_url": "", "source": {"display_name": "ICML"}}, "authorships": [{"author": {"display_name": f"N {i}"}} for i in range(15)], "cited_by_count": 4},
        {"id": "x", "title": ""}, "{broken",
    ])
    good, bad = quarantine(read_json_feed(spark, openalex, OPENALEX_SCHEMA).cache())
    rows = openalex_works(good).collect()
    assert bad.count() == 1 and len(rows) == 1
    assert (rows[0].title, rows[0].abstract, rows[0].venue, rows[0].url, len(rows[0].authors)) == ("A Title", "hello world", "ICML", "https://openalex.org/W1", 12)
    crossref = landed(tmp_path, "c.json", [
        {"DOI": "10.1/x", "title": ["A", "title"], "issued": {"date-parts": [[2019, 1]]}, "author": [{"given": "Ann", "family": "Lee"}, {}], "abstract": "<jats:p>Text</jats:p>", "publisher": "Pub"}
    ])
    row = crossref_works(read_json_feed(spark, crossref, CROSSREF_SCHEMA)).first()
    assert (row.title, row.year, row.url, row.authors, row.abstract, row.venue) == ("A title", 2019, "https://doi.org/10.1/x", ["Ann Lee"], "Text", "Pub")
    atom = tmp_path / "a.xml"
    atom.write_text(
        "<feed xmlns:arxiv='http://arxiv.org/schemas/atom'><entry><id>http://arxiv.org/abs/1</id><title>A\n title</title><summary>S</summary><published>2021-02-03T00:00:00Z</published>"
        "<arxiv:comment>ICLR 2022</arxiv:comment><author><name>Ann</name></author></entry></feed>"
    )
    row = atom_works(read_atom_feed(spark, str(atom))).first()
    assert (row.title, row.year, row.venue, row.source_updated_at, row.authors) == ("A title", 2021, "ICLR 2022", "2021-02-03T00:00:00Z", ["Ann"])
    both = union_feeds(openalex_works(good), None, crossref_works(read_json_feed(spark, crossref, CROSSREF_SCHEMA)))
    assert both.count() == 2 and both.select("work_id").distinct().count() == 1


def test_import_buckets(spark):
    rows = [
        ("source_works", "OLD", json.dumps({"work_id": "OLD", "title": "A Title", "abstract": "x"}), 1),
        ("principles", "P1", json.dumps({"name": "Gate", "source_works": ["OLD", "GONE"], "confidence_score": 0}), 2),
        ("work_facts", "F1", json.dumps({"text": "fact", "work_id": "OLD"}), 3),
        ("ideas", "I1", json.dumps({"title": "Idea", "feedback_status": "validated"}), 4),
        ("goals", "G1", "{}", 5),
    ]
    out = import_buckets(spark.createDataFrame(rows, "bucket string, id string, payload string, seq int"))
    works = out["works"].first()
    cards = {r.label: r for r in out["concepts"].collect()}
    assert set(cards) == {"Gate", "fact", "Idea"} and cards["fact"].concept_type == "takeaway_message"
    assert cards["Idea"].origin == "user_generated" and cards["Idea"].validation_level == "validated"
    assert cards["Gate"].confidence > 0.3
    links = sorted(r.work_id for r in out["evidence_links"].collect())
    assert links == sorted(["GONE", works.work_id, works.work_id])
    assert out["memberships"].count() == 4
    old = spark.createDataFrame([("p", ["a", "b"], [])], "project_id string, works array<string>, ideas array<string>")
    assert [r.record_id for r in member_lists(old, {"works": "work", "ideas": "idea"}).collect()] == ["a", "b"]


def test_imported_works_that_share_a_short_id_are_both_members(spark):
    """The SHA-1 of these titles agrees in the twelve digits that an id keeps."""
    titles = ["title 3791947", "title 33564793", "Title 33564793!"]
    rows = [("source_works", f"O{k}", json.dumps({"title": t}), k) for k, t in enumerate(titles)]
    out = import_buckets(spark.createDataFrame(rows, "bucket string, id string, payload string, seq int"))
    assert len({r.work_id for r in out["works"].collect()}) == 1
    assert out["memberships"].count() == 2


def test_stale_runs_recover_in_the_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    schema = "run_id bigint, status string, at string, seq bigint"
    first = [(1, "running", "2024-01-01 00:00:00", 1), (2, "running", "2024-01-01 00:00:00", 2), (2, "complete", "2024-01-01 00:01:00", 3)]
    later = [(3, "running", "2024-01-01 09:00:00", 4)]
    for i, rows in enumerate((first, later)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    updates = stream.select("run_id", "status", F.to_timestamp("at").alias("updated_at"), "seq")
    out = drain(recover_stale(updates, 3600), "update", ["run_id"], "recovered")
    got = {r.run_id: (r.status, r.recovered) for r in out.collect()}
    assert got == {1: ("partial_error", True), 2: ("complete", False), 3: ("running", False)}


def _arriving(spark, folder, batches):
    """A stream of (run_id, status, updated_at, seq) that takes one of the given lists per micro-batch."""
    schema = "run_id bigint, status string, at string, seq bigint"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return stream.select("run_id", "status", F.to_timestamp("at").alias("updated_at"), "seq")


def test_a_late_older_update_does_not_undo_a_recovery(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    hour = "2024-01-01 {:02d}:00:00".format
    batches = [
        [(1, "running", hour(4), 1)], [(2, "running", hour(9), 2)], [(1, "running", hour(3), 4), (3, "running", hour(9), 3)],
        [(2, "running", hour(10), 5)], [(4, "running", hour(11), 6)], [(4, "complete", hour(11), 7)],
    ]
    out = drain(recover_stale(_arriving(spark, str(tmp_path / "in"), batches), 3600, "7 hours"), "update", ["run_id"], "recovered")
    assert {r.run_id: (r.status, r.recovered) for r in out.collect()} == {
        1: ("running", False), 2: ("running", False), 3: ("running", False), 4: ("complete", False)}
    out = drain(recover_stale(_arriving(spark, str(tmp_path / "again"), batches), 3600, "2 hours"), "update", ["run_id"], "recovered")
    found = {r.run_id: (r.status, r.recovered) for r in out.collect()}
    assert found[1] == ("partial_error", True) and found[2] == ("running", False) and found[4] == ("complete", False)


def test_results_are_rejected_by_a_cancellation_that_arrives_later(spark, tmp_path):
    at = "2024-01-01 00:00:00"
    batches = [[(1, "complete", at, 5), (1, "complete", at, 2), (2, "complete", at, 9)], [(1, "cancelled", at, 3)], [(1, "cancelled", at, 7), (1, "complete", at, 4), (None, "complete", at, 8)]]
    rows = flag_late_results(_arriving(spark, str(tmp_path / "in"), batches)).collect()
    assert sorted((r.seq, r.rejected) for r in rows) == [(2, False), (3, False), (4, True), (5, True), (7, False), (8, False), (9, False)]


def test_late_rows_are_kept_as_rejects(spark, tmp_path):
    day = "2024-01-{:02d} 00:00:00".format
    batches = [[(1, "running", day(5), 1), (1, "running", day(1), 2)], [(2, "running", day(4), 3), (2, "running", day(3), 4), (3, "running", None, 5)], [(1, "running", day(9), 6)], [(1, "running", day(7), 7)]]
    in_time, late = split_late(_arriving(spark, str(tmp_path / "in"), batches), 86400)
    assert sorted((r.batch, r.seq) for r in in_time.collect()) == [(0, 1), (0, 2), (1, 3), (1, 5), (2, 6)]
    assert sorted((r.batch, r.seq) for r in late.collect()) == [(1, 4), (3, 7)]


def test_catalog_names():
    assert set(catalog.oracles()) <= set(catalog.queries())
    assert len(catalog.queries()) > 100


@pytest.mark.parametrize("name", ["lexical_topk_by_source", "concept_upsert", "project_delete_deep", "lineage_depth"])
def test_queries_match_their_sql_on_small_tables(spark, name):
    from check import compare, duck_connection

    sf_dir = "/root/testdata/sf0.001"
    line = compare(spark, duck_connection(sf_dir), sf_dir, name, catalog.queries()[name], catalog.oracles()[name])
    assert line.startswith("ok"), line


def test_feeds_arrive_in_order_and_broken_ones_are_named(spark, tmp_path):
    schema = "title string, year int"
    for name, lines in (("a", ['{"title": "A1", "year": 1}', '{"title": "A2", "year": 2}']), ("b", ['{"title": "B1", "year": 1}', "no json"]), ("c", ['{"title": "C1", "year": 3}'])):
        (tmp_path / f"{name}.json").write_text("\n".join(lines))
    strict = spark.read.schema(schema).option("mode", "FAILFAST")
    load = lambda name: (name, lambda: strict.json(str(tmp_path / f"{name}.json")))
    rows, outcomes = read_feeds([load("c"), load("b"), load("missing"), load("a")])
    assert [(r.seq, r.feed, r.title) for r in rows.orderBy("seq").collect()] == [(1, "c", "C1"), (2, "a", "A1"), (3, "a", "A2")]
    assert [(r.feed, r.n_rows, r.error is None) for r in outcomes.collect()] == [("c", 1, True), ("b", None, False), ("missing", None, False), ("a", 2, True)]
    with pytest.raises(ZeroDivisionError):
        read_feeds([("bug", lambda: 1 // 0)])


def test_a_feed_of_several_files_keeps_their_order(spark, tmp_path):
    (tmp_path / "f").mkdir()
    for part, n in enumerate((1, 40, 3)):
        (tmp_path / "f" / f"part-{part}.json").write_text("\n".join(json.dumps({"title": f"{part} {i}"}) for i in range(n)))
    rows, _ = read_feeds([("f", lambda: spark.read.schema("title string").json(str(tmp_path / "f")))])
    assert [r.title for r in rows.orderBy("seq").collect()] == [f"{part} {i}" for part, n in enumerate((1, 40, 3)) for i in range(n)]
    assert sorted(rows.columns) == ["feed", "seq", "title"]


def test_runs_that_share_a_state_row_are_told_apart(spark, tmp_path, monkeypatch):
    from loomcite.streaming import run_log

    monkeypatch.setattr(run_log, "GROUPS", 2)
    hour = "2024-01-01 {:02d}:00:00".format
    first = [(k, "running", hour(k % 4), k) for k in range(40)]
    later = [(k, "complete", hour(5), 100 + k) for k in range(0, 40, 5)] + [(99, "running", hour(5), 200)]
    out = drain(recover_stale(_arriving(spark, str(tmp_path / "in"), [first, later]), 3 * 3600, "1 minute"), "update", ["run_id"], "recovered")
    expected = {99: ("running", False)} | {k: ("partial_error", True) if k % 4 < 2 else ("running", False) for k in range(40)} | {k: ("complete", False) for k in range(0, 40, 5)}
    assert {r.run_id: (r.status, r.recovered) for r in out.collect()} == expected
