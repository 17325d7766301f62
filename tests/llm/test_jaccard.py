"""The parity-sketch join against all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from loomcite.llm import jaccard

from .conftest import COLUMNS, WORDS, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} - {()}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and 100 * common >= 90 * (len(sets[i]) + len(sets[j]) - common):
                top[find(i)] = find(j)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        if sets[k] and doc_id is not None:
            least[find(k)] = min(doc_id, least.get(find(k), doc_id))
    return Counter((doc_id, len(s), least.get(find(k)) if s else doc_id) for k, ((doc_id, _), s) in enumerate(zip(rows, sets)))


def run(spark, rows):
    docs = spark.createDataFrame([(k, t, "en", "s", 1, 0.5, "k", "u", 1, 2) for k, t in rows], COLUMNS + ", size int, bucket bigint").repartition(3)
    return Counter(tuple(r) for r in jaccard.joined(docs).select("doc_id", "n_shingles", "component_id").collect())


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(WORDS) + str(rng.randrange(10**6))
    return " ".join(words)


def test_join_of_odd_texts(spark, odd_texts):
    assert run(spark, odd_texts) == brute(odd_texts)


@pytest.mark.parametrize("paired", [3, 64])
def test_groups_of_variants_with_and_without_their_base(spark, monkeypatch, paired):
    """Large buckets of which few nodes link: variants of an absent base, of present ones, and chains of edits."""
    monkeypatch.setattr(jaccard, "PAIRED", paired)
    rng = random.Random(paired)
    rows = []
    for group in range(4):
        base = prose(rng, rng.choice([20, 60, 98, 150])).split()
        rows += [" ".join(base)] if group % 2 else []
        rows += [edited(rng, base, rng.randint(1, 3)) for _ in range(25)]
        twice = edited(rng, base, 2).split()
        rows += [edited(rng, twice, 1) for _ in range(12)]
        for _ in range(8):
            base = edited(rng, base, 1).split()
            rows.append(" ".join(base))
    passage = prose(rng, 50)
    rows += [passage + " " + prose(rng, rng.randint(3, 40)) for _ in range(30)]
    rows = [(1000 - k, t) for k, t in enumerate(rows)]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("held", [0, 1024])
def test_large_buckets_are_held_or_go_through_their_base(spark, monkeypatch, held):
    """Groups that fit a task make no further buckets; with none that fits, the base set finds the same."""
    monkeypatch.setattr(jaccard, "HELD", held)
    calls, through = [], jaccard._through_base
    monkeypatch.setattr(jaccard, "_through_base", lambda *a: (calls.append(1), through(*a))[1])
    rng = random.Random(9)
    base = prose(rng, 120).split()
    rows = list(enumerate(edited(rng, base, rng.randint(1, 4)) for _ in range(110)))
    assert run(spark, rows) == brute(rows)
    assert bool(calls) == (held == 0)


def test_short_texts_at_the_limit(spark):
    """Sets of 9 and 10 runs, 10 and 11, 19 and 21: links at exactly nine tenths, and just below."""
    rng = random.Random(1)
    rows = []
    for n in (9, 10, 11, 18, 19, 20, 27, 36):
        words = [f"w{rng.randrange(10**9)}" for _ in range(n + 2)]
        rows += [" ".join(words), " ".join([*words, "a"]), " ".join([*words, "a", "b"]), " ".join(words[1:]), " ".join(words[:-2])]
    assert run(spark, list(enumerate(rows))) == brute(list(enumerate(rows)))


def test_sketches_differ_in_no_more_bits_than_sets():
    rng = np.random.default_rng(2)
    for _ in range(50):
        both = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64) * np.uint64(2))
        a, b = both[: rng.integers(200, 290)], both[rng.integers(1, 40) :]
        first = np.array([0, len(a), len(a) + len(b)])
        chunks = jaccard.sketch_chunks(first, np.concatenate([a, b]), np.array([20, 20]))
        assert sum(int(x).bit_count() for x in chunks[:20] ^ chunks[20:]) <= len(np.setxor1d(a, b))


def test_bands_and_differences_hold_all_linked_sizes():
    starts = jaccard.size_bands(5000)
    for a in range(1, 2000):
        k = int(np.searchsorted(starts, a, "right")) - 1
        for b in (a, a + 1, jaccard.largest_partner(a)):
            if 9 * b <= 10 * a:
                assert int(np.searchsorted(starts, b, "right")) - 1 in (k, k + 1)
                assert (a + b) // 19 <= jaccard.most_different(starts[k + 1] - 1)


def test_join_of_an_empty_table(spark, no_docs):
    assert jaccard.joined(no_docs).count() == 0


def test_compact_sketches_fold_and_never_differ_more_than_sets():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2)) for n in (1, 20, 33, 60, 70, 500, 520)]
    sets += [np.sort(np.concatenate([s[: -len(s) // 5 or None], np.unique(rng.integers(0, 2**63, 9).astype(np.uint64))])) for s in sets] + [np.zeros(0, np.uint64)]
    first = np.r_[0, np.cumsum([len(s) for s in sets])]
    sketches = jaccard.compact_sketches(first, np.concatenate(sets))
    i, j = np.triu_indices(len(sets), 1)
    differ = jaccard.differing_bits(sketches, i, j)
    assert all(d <= len(np.setxor1d(sets[a], sets[b])) for a, b, d in zip(i.tolist(), j.tolist(), differ.tolist()))
    assert (jaccard.differing_bits(sketches, i, i) == 0).all() and differ.max() > 100
