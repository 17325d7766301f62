"""Leftmost, longest names against a scan by hand, in one part of the catalogue and in many."""

import random

import pytest
from pyspark.sql import functions as F

from loomcite.operators.extract import baseline_records, benchmark_records
from loomcite.operators.mentions import mentions

WORDS = "a b c d e".split()


def by_hand(text, names):
    words, out, at = text.split(" "), [], 0
    while at < len(words):
        sizes = [n for n in range(min(len(words) - at, 5), 0, -1) if " ".join(words[at : at + n]) in names]
        if sizes:
            out.append((at, sizes[0], " ".join(words[at : at + sizes[0]])))
        at += sizes[0] if sizes else 1
    return out


@pytest.mark.parametrize("part_bytes", [1 << 20, 24])
def test_names_are_leftmost_and_longest(spark, part_bytes):
    rng = random.Random(2)
    names = {" ".join(rng.choices(WORDS, k=rng.randint(1, 5))) for _ in range(25)} - {"a", "b"}
    texts = [(f"t{k}", " ".join(rng.choices(WORDS + ["x"], k=rng.randint(0, 40)))) for k in range(60)] + [("none", None), ("empty", ""), ("long", " ".join(rng.choices(WORDS, k=5000)))]
    docs = spark.createDataFrame([(k, t, "other", 1) for k, t in texts], "id string, body string, said string, start bigint").repartition(4)
    catalogue = spark.createDataFrame([(n,) for n in names] + [("",), (min(names),)], "name_key string")
    found = {}
    for r in mentions(docs, "id", "body", catalogue, part_bytes).collect():
        found.setdefault(r.id, []).append((r.start, r.size, r.name_key))
    assert {k: sorted(v) for k, v in found.items()} == {k: by_hand(t, names) for k, t in texts if t and by_hand(t, names)}


def test_empty_catalogue_and_no_texts(spark):
    docs = spark.createDataFrame([("a", "x")], "id string, body string")
    assert mentions(docs, "id", "body", spark.createDataFrame([], "name_key string")).count() == 0
    assert mentions(docs.limit(0), "id", "body", spark.createDataFrame([("x",)], "name_key string")).count() == 0


def test_every_metric_split_and_task_of_a_named_dataset(spark):
    names = lambda xs: spark.createDataFrame([(x.lower().replace("-", " "), x, "url") for x in xs], "name_key string, official_name string, code_url string")
    rows = [
        ("W1", "OurNet: adaptation", "We evaluate ImageNet-R and EuroSAT for classification under a base-to-novel split and a test split. CoOp reports top-1 accuracy 70% and latency 3ms. OurNet and CoOp Plus are compared."),
        ("W2", "No dataset", "We report accuracy on a test split against CoOp."),
        ("W3", "Bare", "ImageNet only."),
    ]
    works = spark.createDataFrame(rows, "work_id string, title string, abstract string")
    found = benchmark_records(works, "abstract", names(["ImageNet", "ImageNet-R", "EuroSAT"]))
    got = {(r.work_id, r.dataset, r.metric, r.split, r.task) for r in found.collect()}
    expected = {("W1", d, m, s, "classification") for d in ("ImageNet-R", "EuroSAT") for m in ("top-1 accuracy", "latency") for s in ("base-to-novel", "test")}
    assert got == expected | {("W3", "ImageNet", "", "", "")}
    lines = baseline_records(works, "abstract", names(["CoOp", "CoOp Plus", "OurNet"]), found)
    assert {(r.work_id, r.baseline_name) for r in lines.collect()} == {("W1", "CoOp"), ("W1", "CoOp Plus")}
    assert lines.groupBy("baseline_name").agg(F.count("*").alias("n")).filter("n <> 8").count() == 0


def test_a_word_of_a_pattern_ends_at_letters_beyond_ascii(spark):
    works = spark.createDataFrame([("w", "ImageNet, fürétest und Mapü, testüng, contest, tests, dev split")], "work_id string, abstract string")
    catalogue = spark.createDataFrame([("imagenet", "ImageNet")], "name_key string, official_name string")
    found = benchmark_records(works, "abstract", catalogue)
    assert sorted((r.metric, r.split) for r in found.collect()) == [("map", "dev"), ("map", "test")]


def test_texts_are_walked_in_pieces_of_bounded_bytes(spark, monkeypatch):
    import pyarrow as pa

    from loomcite.operators import mentions as module

    monkeypatch.setattr(module, "WALK_BYTES", 40)
    said = ["a b c d", "x" * 90, "", None, "b c"] * 9
    batch = pa.RecordBatch.from_arrays([pa.array(range(45)), pa.array(said)], names=["k", "said"])
    pieces = list(module._pieces([batch, batch.slice(0, 0)]))
    assert [k for p in pieces for k in p.column("k").to_pylist()] == list(range(45))
    assert all(p.num_rows == 1 or sum(len(s or "") for s in p.column("said").to_pylist()) <= 40 for p in pieces)
    trie = module.NameTrie(["b c", "a b c", "c"])
    found = [r for out in module._scan(trie, "k", True)([batch]) for r in out.to_pylist()]
    assert [(r["k"], r["start"], r["name_key"]) for r in found] == [x for k in range(0, 45, 5) for x in ((k, 0, "a b c"), (k + 4, 0, "b c"))]


def test_names_within_others_are_found_without_a_shuffle(spark):
    from loomcite.operators.mentions import names_within

    names = ["a b", "b", "a b c d e f g", "g", "c d e f g h", "zz"]
    texts = [(1, "A b, a-b"), (2, "a b c d e f g h"), (3, "ab bb"), (4, None), (5, "")]
    docs, catalogue = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(n,) for n in names], "name_key string")
    expected = {(1, "a b"), (1, "b")} | {(2, n) for n in names[:5]}
    for bytes_ in (1 << 20, 4):
        rows = names_within(docs, "id", "text", catalogue, bytes_)
        got = [tuple(r) for r in rows.collect()]
        assert len(got) == len(expected) and set(got) == expected
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
