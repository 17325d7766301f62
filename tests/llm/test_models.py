"""Trained operators against held-out labels, and near duplicates against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from loomcite.llm import licences, neardup, quality, rules, toxicity

from .conftest import prose


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(600):
        text = prose(rng, rng.randint(30, 90)) + "."
        bad, toxic = k % 5 == 0, k % 7 == 0
        if bad:
            text = " | ".join(text.upper().split()) + " !!"
        if toxic:
            words = text.split()
            for _ in range(rng.randint(1, 8)):
                words.insert(rng.randrange(len(words)), rng.choice(["nastyish", "nastyum", "vilest"]))
            text = " ".join(words)
        rows.append((k, text))
        labels.append((k, int(not bad), int(toxic)))
    labels += [labels[0], (9999, 1, 1), (None, 0, 0), (5, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_quality_of_held_out_documents(labelled):
    rows = quality.scored(*labelled).collect()
    assert len(rows) == 600 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out]
    assert held and all(r.predicted == int(r.doc_id % 5 != 0) for r in held)


def test_flat_trees_walk_like_nested_ones():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 4))
    y = ((x[:, 0] > 0.2) & (x[:, 2] < 0.5)).astype(float)
    model = quality.fit_trees(x, y, np.ones(500), trees=10)

    def walk(t, row, node=0):
        if model.low[t, node] == node:
            return model.value[t, node]
        return walk(t, row, int(model.low[t, node] if row[model.feature[t, node]] <= model.limit[t, node] else model.high[t, node]))

    raw = [model.base + sum(walk(t, row) for t in range(10)) for row in x]
    assert np.allclose(raw, model.raw(x)) and ((model.probability(x) > 0.5) == (y > 0)).mean() > 0.97


def test_toxic_documents_and_severity(labelled):
    rows = toxicity.scored(*labelled).collect()
    assert len(rows) == 600
    assert {r.doc_id for r in rows if r.toxic} == {k for k in range(600) if k % 7 == 0}
    assert all(0 <= r.severity <= 3 and 0 <= r.grade <= 3 for r in rows)
    text = dict(labelled[0].collect())
    many = [r.severity for r in rows if text[r.doc_id].count("nasty") + text[r.doc_id].count("vilest") >= 6]
    one = [r.severity for r in rows if text[r.doc_id].count("nasty") + text[r.doc_id].count("vilest") == 1]
    assert np.mean(many) > np.mean(one)


def test_ordinal_thresholds_share_weights_and_are_ordered():
    rng = np.random.default_rng(2)
    z = rng.normal(size=800)
    grade = np.searchsorted([-0.5, 0.5, 1.2], z + 0.2 * rng.normal(size=800))
    model = toxicity.fit_ordinal(np.arange(800), np.zeros(800, int), z, grade, np.ones(800), np.array([7], np.uint64))
    assert model.weight[0] > 3 and (np.diff(model.limits) > 0).all()


def jaccard_classes(rows, run=5):
    """Classes by weighted Jaccard similarity of all pairs, with the operator's weights."""
    import re

    sets, n = [], len(rows)
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append(Counter(tuple(words[i : i + run]) for i in range(max(1, len(words) - run + 1))) if words else Counter())
    df = Counter(s for each in sets for s in each)
    weigh = lambda s: {g: c * (1 + np.log((1 + n) / (1 + df[g])) / np.log(1 + n)) for g, c in s.items()}
    weights = [weigh(s) for s in sets]
    top = list(range(n))

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    for a in range(n):
        for b in range(a):
            if weights[a] and weights[b]:
                keys = weights[a].keys() | weights[b].keys()
                low = sum(min(weights[a].get(k, 0), weights[b].get(k, 0)) for k in keys)
                high = sum(max(weights[a].get(k, 0), weights[b].get(k, 0)) for k in keys)
                if low >= 0.8 * high:
                    top[find(a)] = find(b)
    return [find(a) for a in range(n)]


def test_near_duplicates_against_all_pairs(docs, odd_texts):
    found = neardup.near_duplicates(docs).collect()
    tops = jaccard_classes(odd_texts)
    groups = {}
    for (k, _), t in zip(odd_texts, tops):
        groups.setdefault(t, []).append(k)
    sizes = Counter((k, len(groups[t]), min((x for x in groups[t] if x is not None), default=None)) for (k, _), t in zip(odd_texts, tops))
    assert Counter((r.doc_id, r.class_size, r.class_id) for r in found) == sizes
    assert sum(r.kept for r in found) == len(groups)
    assert max(len(g) for g in groups.values()) > 10


def test_large_group_of_variants_is_one_class(spark):
    rng = random.Random(3)
    base = prose(rng, 150).split()
    rows = []
    for k in range(300):
        near = list(base)
        near[rng.randrange(150)] = f"x{k}"
        rows.append((k, " ".join(near)))
    rows += [(1000 + k, prose(rng, 60)) for k in range(100)]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert all((r.class_size, r.class_id) == ((300, 0) if r.doc_id < 1000 else (1, r.doc_id)) for r in found)


def test_large_buckets_are_compared_whole(spark):
    rng = random.Random(8)
    shared = prose(rng, 100).split()
    rows = []
    for k in range(60):
        own = [f"o{k}x{i}" for i in range(14)]
        rows.append((2 * k, " ".join(shared + own)))
        own[0] = "other"
        rows.append((2 * k + 1, " ".join(["first", *shared, *own])))
    tops = jaccard_classes(rows)
    signs = neardup.signed(spark.createDataFrame(rows, "doc_id bigint, text string"))
    sizes = [r["count"] for r in signs.selectExpr("explode(bands) as bucket").groupBy("bucket").count().collect()]
    assert max(sizes) > 2 * neardup.SMALL_BUCKET
    found = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    least = {}
    for (k, _), t in zip(rows, tops):
        least[t] = min(k, least.get(t, k))
    assert len(least) > 30
    assert found == {k: least[t] for (k, _), t in zip(rows, tops)}


def one_bucket(spark, groups):
    """Signed rows that share a single bucket; nodes of one group have the same samples and runs, others none in common."""
    rows, ones = [], np.ones(20, np.float32)
    for g, size in enumerate(groups):
        runs = np.arange(g * 100, g * 100 + 20, dtype=np.uint32)
        for _ in range(size):
            uid = len(rows) + 1
            bands = [0, *(-(uid * 20 + k) for k in range(1, 12))]
            rows.append((uid, uid, bands, [1000 * (g + 1) + d for d in range(36)], bytearray(neardup.pack_sorted(runs)), bytearray(neardup.planes(ones))))
    return spark.createDataFrame(rows, "uid bigint, node bigint, bands array<bigint>, signature array<int>, runs binary, weights binary")


def classes_of(spark, groups):
    _, _, classes = neardup.linked(one_bucket(spark, groups))
    return sorted(Counter(r.top for r in classes.collect()).values())


def test_isolated_nodes_do_not_end_a_large_bucket(spark):
    assert classes_of(spark, [1] * 60 + [2, 2, 3]) == [2, 2, 3]


@pytest.mark.parametrize("pairs", [25, 40])
def test_no_node_of_a_large_bucket_is_skipped(spark, pairs):
    assert classes_of(spark, [2] * pairs) == [2] * pairs


def test_contents_are_picked_without_a_shuffle(spark, monkeypatch):
    written, write = [], neardup.durable
    monkeypatch.setattr(neardup, "durable", lambda df: (written.append(df), write(df))[1])
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert classes_of(spark, [1] * 60 + [2, 2, 3]) == [2, 2, 3]
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in written if "weights" in df.columns]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert plans and not any("SortMergeJoin" in p or "ShuffledHashJoin" in p for p in plans)


def test_picked_rows_hold_all_that_are_asked_for(spark):
    rows, ids = spark.range(20_000).withColumnRenamed("id", "uid"), spark.range(0, 20_000, 7).withColumnRenamed("id", "uid")
    found = [r.uid for r in neardup.picked(rows, ids).collect()]
    assert set(range(0, 20_000, 7)) <= set(found) and len(found) == len(set(found)) < 3000


def test_samples_agree_like_weighted_jaccard():
    rng = np.random.default_rng(1)
    runs = np.sort(rng.integers(0, 2**63, 80, dtype=np.uint64))
    weight = rng.uniform(1, 6, 80).astype(np.float32)
    a, b = np.arange(0, 60), np.arange(20, 80)
    first = np.array([0, 60, 120])
    drawn = neardup.samples(first, np.r_[runs[a], runs[b]], np.r_[weight[a], weight[b] * 1.5].astype(np.float32), 3000)
    full_a, full_b = np.zeros(80), np.zeros(80)
    full_a[a], full_b[b] = weight[a], weight[b] * 1.5
    expected = np.minimum(full_a, full_b).sum() / np.maximum(full_a, full_b).sum()
    assert abs((drawn[0] == drawn[1]).mean() - expected) < 0.04


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(1, 300)] + [(1000, 1001)], "a bigint, b bigint")
    tops = dict(neardup.components(chain).collect())
    assert {tops[k] for k in range(1, 301)} == {1} and tops[1001] == 1000


def test_licences_are_found_and_prose_is_not(spark):
    rng = random.Random(6)
    rows = [(k, prose(rng, 30) + "\n" + prose(rng, 12)) for k in range(60)]
    rows += [(100, "some words\nReleased under the MIT License.\nmore"), (101, "Licensed under the Apache License, Version 2.0."), (102, "x\n\nLicensed under CC BY-NC 4.0."), (103, "All rights reserved."), (104, None), (105, ""), (105, "All rights reserved.")]
    rows += [(106, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License")]
    found = licences.scanned(spark.createDataFrame(rows, "doc_id bigint, text string")).filter("confirmed").collect()
    assert {(r.doc_id, r.paragraph, r.family) for r in found} == {
        (100, 1, "mit"), (101, 0, "apache"), (102, 2, "cc-by-nc"), (103, 0, "proprietary"), (105, 0, "proprietary"), (106, 0, "gpl")}
    assert all(0 < r.probability <= 1 for r in found)


def test_licences_inside_longer_lines_are_confirmed(spark):
    rng = random.Random(9)
    long = prose(rng, 400)
    rows = [(0, "Copyright 2021 The Example Company. All rights reserved."), (1, f"{prose(rng, 12)}. Licensed under CC BY-NC 4.0. {prose(rng, 8)}")]
    rows += [(2, f"{long}. Released under the MIT License. {long}"), (3, f"{long} {long}"), (4, f"{long}. The driver lost his license and had to renew it. {long}")]
    found = licences.scanned(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.family) for r in found if r.confirmed} == {(0, "proprietary"), (1, "cc-by-nc"), (2, "mit")}
    assert len({r.doc_id for r in found}) == len(found)


def test_copies_of_a_line_do_not_fill_the_sample(spark):
    rows = spark.createDataFrame([(k, f"line of words {k % 20}") for k in range(1000)], "doc_id bigint, text string")
    sample = licences.negatives(rows, licences.vocabulary(spark), most=5)
    assert sample.count() == 5 + len(licences.LOOKALIKES)


def _votes(texts: int, good: float, on_good: list[float], on_bad: list[float], speaks: list[float]):
    """Simulated votes of rules whose shares of good votes on good and on bad texts are known."""
    rng = np.random.default_rng(5)
    is_good = rng.random(texts) < good
    up = np.where(is_good[:, None], on_good, on_bad)
    votes = np.where(rng.random(up.shape) < up, 1, -1)
    return is_good, np.where(rng.random(up.shape) < speaks, votes, 0)


def test_rule_accuracies_are_found_again_and_good_votes_outweigh_a_weak_rule(spark):
    names = list("abcdef")
    on_good, on_bad = [0.95, 0.9, 0.9, 0.85, 0.8, 0.98], [0.2, 0.3, 0.4, 0.3, 0.8, 0.5]
    is_good, votes = _votes(20000, 0.8, on_good, on_bad, [0.9, 0.8, 1, 0.5, 0.9, 1])
    rows = spark.createDataFrame([(int(k), bool(g), *map(int, v)) for k, (g, v) in enumerate(zip(is_good, votes))], ["k", "is_good", *names])
    model = rules.fit_rules(rows, names)
    assert abs(model.good - 0.8) < 0.02
    for name, up, bad_up in zip(names, on_good, on_bad):
        found = model.accuracies()[name]
        assert abs(found[0] - up) < 0.03 and abs(found[1] - (1 - bad_up)) < 0.05
    # rule e votes bad on a fifth of all texts, good or not: alone it drops nothing that the others hold for good
    judged = rows.withColumn("p", model.posterior())
    assert judged.filter("e = -1 AND a = 1 AND b = 1 AND c = 1 AND p < 0.5").count() == 0
    assert judged.filter("(p >= 0.5) = is_good").count() > 0.9 * 20000
    # and the posterior is the one that the true rates give
    odds = np.full(len(votes), np.log(0.8 / 0.2))
    for j in range(len(names)):
        odds += np.where(votes[:, j] == 1, np.log(on_good[j] / on_bad[j]), np.where(votes[:, j] == -1, np.log((1 - on_good[j]) / (1 - on_bad[j])), 0))
    p = np.array([r.p for r in judged.orderBy("k").select("p").collect()])
    assert np.mean((p >= 0.5) == (odds >= 0)) > 0.98


def test_rules_without_any_bad_vote_keep_all(spark):
    rows = spark.createDataFrame([(1, 0), (1, 1)] * 50, "a int, b int")
    model = rules.fit_rules(rows, ["a", "b"])
    assert rows.withColumn("p", model.posterior()).filter("p < 0.5").count() == 0
