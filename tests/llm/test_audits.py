"""Filter interaction and source divergence against brute force, and their odd rows."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from loomcite.llm import divergence, interaction
from loomcite.llm.transducer import Spans, first_equal

from .conftest import COLUMNS, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def test_one_pass_counts_what_the_patterns_count(odd_texts):
    texts = [t for _, t in odd_texts] + ["", "A#b $\x00 c\x00", "é　É x", "  A", "B  ", "\n"]
    found = interaction.statistics(pa.array(texts))
    for k, t in enumerate(texts):
        words = WORD.findall(t or "")
        expected = (len(words), len(set(words)), len(re.findall("[A-Z]", t or "")), len(t or ""), len(re.findall(r"[#$%&*|]", t or "")))
        assert tuple(int(x[k]) for x in found) == expected, t


@pytest.mark.parametrize("table", [1 << 16, 7])
def test_words_are_told_apart_whatever_their_hashes(monkeypatch, table):
    monkeypatch.setattr("loomcite.llm.transducer.TABLE", table)
    rng = random.Random(3)
    words = [bytes(rng.choice(b"ab") for _ in range(rng.choice([1, 7, 8, 9, 16, 700]))) for _ in range(150)]
    words += words[::2] + [b"x" * 600, b"x" * 601, b"x" * 600]
    data, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    spans = Spans(data, ends - [len(w) for w in words], ends)
    owner = np.array([rng.randrange(2) for _ in words])
    seen = {}
    expected = [seen.setdefault((o, w), k) for k, (o, w) in enumerate(zip(owner.tolist(), words))]
    for hashes in (None, np.zeros(len(words), np.uint64)):
        assert first_equal(spans, owner, hashes).tolist() == expected


def brute_audit(rows, labels):
    """The report from the contract's text."""
    mark = defaultdict(lambda: (0, 0))
    for k, good, toxic in labels:
        if k is not None:
            mark[k] = (max(mark[k][0], good or 0), max(mark[k][1], toxic or 0))
    parts = defaultdict(list)
    for k, text, lang in rows:
        t = text or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
                 "E": k is not None and any(o is not None and o < k and (x or "") == t for o, x, _ in rows)}
        parts[lang or ""].append((fails, mark[k][0] == 1 if k is not None else False, mark[k][1] == 1 if k is not None else False))
    out, total = {}, Counter()
    for part, documents in parts.items():
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                before = order[: step - 1]
                gone = [d for d in documents if any(d[0][b] for b in before)]
                left = [d for d in documents if not any(d[0][b] for b in before)]
                removed = [d for d in left if d[0][f]]
                total[part, f] += len(removed)
                out[part, order, step] = [len(left) - len(removed), len(removed), sum(d[0][f] for d in gone), sum(d[0][f] and sum(d[0].values()) == 1 for d in documents), sum(d[1] for d in removed), sum(d[2] for d in removed)]
    return {(p, o, s): (*v, total[p, o[s - 1]]) for (p, o, s), v in out.items()}


def test_filter_audit_against_brute_force(spark, odd_texts):
    rng = random.Random(8)
    rows = [(k, t, rng.choice(["en", "de", None, ""])) for k, t in odd_texts]
    rows += [(200 + k, rng.choice(["A LOUD TEXT", "a # text", prose(rng, 300), None, rows[3][1]]), "en") for k in range(40)]
    rows += [(None, "a # text", "en"), (200, "a # text", "en"), (200, "a # text", "en"), (1000, "unique words " * 150, None)]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 240, 2)] + [(3, 0, 1), (3, 1, 0), (None, 1, 1)]
    docs = spark.createDataFrame([(k, t, lang, "s", 1, 0.5, "k", "u", 1, 2) for k, t, lang in rows], COLUMNS + ", fails int, n int").repartition(3)
    report = interaction.audit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in report}
    assert len(report) == len(found) and found == brute_audit(rows, labels)


def brute_divergence(rows, least):
    docs = [(lang or "", source or "", LETTERS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        held = Counter(w for d in mine for w in set(d[2]))
        kept = [w for w, n in held.items() if n >= least]
        sources = sorted({d[1] for d in mine})
        count = {s: Counter(w for d in mine if d[1] == s for w in d[2] if held[w] >= least) for s in sources}
        whole = sum(count.values(), Counter())
        price = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}
        far = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: price(count[s]) for s in sources}, price(whole)
        for s in sources:
            pairs = sorted([(-sum(far(p[s][w], p[o][w]) for w in kept), o.encode(), o) for o in sources if o != s])
            out += [(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(pairs, 1)]
            terms = sorted([(-far(p[s][w], q[w]), w.encode(), w) for w in kept if count[s][w] and p[s][w] > q[w]])[:10]
            out += [(lang, s, "term", w, -v, k) for k, (v, _, w) in enumerate(terms, 1)]
    return Counter(out)


@pytest.mark.parametrize("places,shared", [(1 << 18, 32), (40, 2), (40, 10**6)])
def test_divergence_against_brute_force(spark, odd_texts, monkeypatch, places, shared):
    monkeypatch.setattr(divergence, "PLACES", places)
    monkeypatch.setattr(divergence, "SHARED", shared)
    rng = random.Random(6)
    rows = [(t, rng.choice(["en", "de"]), rng.choice(["a", "b", "c", None, "é"])) for _, t in odd_texts]
    rows += [("lone words", "fr", "x"), ("other ones", "fr", "y"), (None, None, None), (None, "de", "nothing"), ("a A á Á", "en", "b")]
    docs = spark.createDataFrame([(k, t, lang, s, 1, 0.5, "k", "u", 1, "t") for k, (t, lang, s) in enumerate(rows)], COLUMNS + ", n int, term string").repartition(3)
    found = Counter(tuple(r) for r in divergence.divergence(docs, least=4).collect())
    assert found == brute_divergence(rows, 4)
    assert any(r[2] == "pair" and r[4] == 0 and r[0] == "fr" for r in found)


def test_prices_are_exact_beyond_64_bits_of_product():
    counts, total, terms = np.array([0, 10**14, 8 * 10**15]), 8 * 10**15 + 10**14, 10**9
    assert divergence.prices(counts, total, terms).tolist() == [1 + 10**9 * (c + 2) // (total + 2 * terms) for c in counts.tolist()]


def test_audits_of_empty_tables(spark, no_docs):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert interaction.audit(no_docs, labels).count() == 0
    assert divergence.divergence(no_docs).count() == 0
