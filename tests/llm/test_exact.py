"""Operators whose results have one right answer, against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from loomcite.llm import arrays, decontam, lm, order, packing, rules, tokencount
from loomcite.llm.wordbpe import word_encoder

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BLANK = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def key(row):
    return tuple((v is None, v) for v in row)


@pytest.mark.parametrize("kind,pattern", [(arrays.BLANK_SEPARATED, BLANK), (arrays.LETTERS_DIGITS, ALNUM)])
def test_words_are_those_of_the_pattern(odd_texts, kind, pattern):
    texts = [t for _, t in odd_texts]
    words = arrays.words_of(pa.array(texts), kind)
    expected = [w for t in texts for w in pattern.findall(lower(t))]
    assert words.counts.tolist() == [len(pattern.findall(lower(t))) for t in texts]
    names = {}
    for w, h in zip(expected, words.hash.tolist()):
        assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


def test_word_encoder_gives_the_library_ids(odd_texts):
    texts = [t or "" for _, t in odd_texts] + ["DON'T stop; a's B'LL ﬁ ǅ İ Σας x́y \x1c\x85 <|startoftext|>a", "K Å ªº µ ÷ × 1a2 ,.!?"]
    encoder = word_encoder(VOCABULARY)
    ids, counts = encoder.encode(pa.array(texts))
    expected = [e.ids for e in encoder.whole.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(e) for e in expected]
    assert ids.tolist() == [i for e in expected for i in e]


def test_packing_places_every_piece_without_gaps(docs, odd_texts):
    rows = packing.packed(docs, VOCABULARY).collect()
    encoder = word_encoder(VOCABULARY)
    expected = Counter()
    for doc_id, text in odd_texts:
        ids = [*encoder.whole.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            expected[doc_id, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= math.ceil(sum(r.length for r in rows) / 2048) + 1


def test_sum_of_squares_chooses_the_least_sum():
    rng = np.random.default_rng(1)
    lengths, capacity = rng.integers(1, 12, 200), 12
    gaps, count = [], Counter()
    for k, (item, bin_) in enumerate(zip(lengths.tolist(), packing.sum_of_squares(lengths, capacity).tolist())):
        shortest = lengths[k:].min()

        def total(gap):
            c = Counter(count)
            if gap < capacity:
                c[gap] -= 1
            c[gap - item] += 1
            return sum(v * v for g, v in c.items() if g >= shortest)
        options = {g: total(g) for g in [*{g for g in count if count[g] and g >= item}, capacity]}
        gap = gaps[bin_] if bin_ < len(gaps) else capacity
        assert total(gap) == min(options.values())
        if bin_ == len(gaps):
            gaps.append(capacity)
        else:
            count[gap] -= 1
        gaps[bin_] = gap - item
        count[gap - item] += gap > item


@pytest.mark.parametrize("sizes,needed", [([1400, 600], 3000), ([1000], 1500), ([2048, 1], 3002)])
def test_pieces_that_close_no_bin_open_none(spark, sizes, needed):
    rows = spark.createDataFrame([(i, sizes[i % len(sizes)]) for i in range(3000 * len(sizes))], "uid bigint, length bigint")
    assert packing.place(rows).select("sequence_id").distinct().count() == needed


def test_best_fit_takes_the_smallest_gap():
    assert packing.best_fit(np.array([6, 5, 4, 3, 2, 10, 1]), 10).tolist() == [0, 1, 0, 1, 1, 2, 3]


def test_small_lots_stay_near_the_bound(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, int(n)) for i, n in enumerate(rng.integers(10, 1500, 3000))], "uid bigint, length bigint")
    placed = packing.place(rows, lot=256).join(rows, "uid").collect()
    assert len({r.uid for r in placed}) == 3000
    assert len({r.sequence_id for r in placed}) <= 1.02 * math.ceil(sum(r.length for r in placed) / 2048)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 256, 1000, 4097])
def test_feistel_is_a_permutation(n):
    slots = order.feistel(np.arange(n), n)
    assert sorted(slots.tolist()) == list(range(n))
    if n > 500:
        assert (order.feistel(np.arange(n), n, key=1) != slots).mean() > 0.9


def test_shards_hold_each_sequence_at_its_slot(docs, odd_texts, tmp_path):
    rows = order.materialised(docs, VOCABULARY, str(tmp_path), stride=64, per_shard=50).orderBy("slot").collect()
    assert [r.slot for r in rows] == list(range(len(rows)))
    assert all(r.shard == r.slot // 50 and r.byte_offset == r.slot % 50 * 128 for r in rows)
    back = order.read_slots(str(tmp_path), 0, len(rows), len(rows), 64, 50)
    assert [x.tolist() for x in order.read_slots(str(tmp_path), 45, 10, len(rows), 64, 50)] == [x.tolist() for x in back[45:55]]
    encoder = word_encoder(VOCABULARY)
    expected = Counter()
    for doc_id, text in odd_texts:
        ids = [*encoder.whole.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 64)):
            expected[doc_id, piece, tuple(ids[start : start + 64])] += 1
    assert Counter((r.doc_id, r.piece, tuple(ids.tolist())) for r, ids in zip(rows, back)) == expected


def test_packed_ids_come_back_and_take_less_than_their_planes():
    press, expand = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
    rng = np.random.default_rng(4)
    drawn = rng.zipf(1.3, 40_000)
    ids = (drawn[drawn < 49_152] * 7 % 49_152).astype(np.uint16)
    for n in (0, 1, 300, len(ids)):
        assert order.unpacked_ids(order.packed_ids(ids[:n], press), n, expand).tolist() == ids[:n].tolist()
    assert len(order.packed_ids(ids, press)) < 0.95 * len(press.compress(arrays.planes(ids)))


def test_token_counts_are_the_library_ones(docs, odd_texts):
    model = tokencount.piece_counter(PIECES).model
    rows = tokencount.counted(docs, PIECES).collect()
    expected = [(k, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for k, t in odd_texts]
    assert sorted(map(tuple, rows), key=key) == sorted(expected, key=key)


@pytest.mark.parametrize("chunk,overlap", [(64, 8), (200, 16), (1000, 4)])
def test_spliced_chunks_count_like_the_whole(odd_texts, chunk, overlap):
    counter = tokencount.piece_counter(PIECES)
    assert counter.plain and counter.pairs
    texts = [t for _, t in odd_texts if t] + ["no_blank" * 300, "a   b    c" * 60, "▁x ▁▁ y" * 60, "日本語 " * 200, " " * 500, "\n \n" * 300]
    for text in texts:
        if len(text) < 12000:
            assert counter.spliced(text, chunk, overlap) == len(counter.model.encode(text))


@pytest.mark.parametrize("text", ["数据获取一个" * 9000, "".join(chr(0x4E00 + k * k % 9973) for k in range(50000)), "a" * 50000, "abcabd" * 9000, " " * 50000])
def test_texts_without_blanks_cost_a_few_times_their_length(text, monkeypatch):
    counter = tokencount.PieceCounter(PIECES)
    encoded, starts = [], counter.starts
    monkeypatch.setattr(counter, "starts", lambda part: encoded.append(len(part)) or starts(part))
    assert counter.spliced(text, 1000, 16) == len(counter.model.encode(text))
    assert sum(encoded) < 20 * len(text)


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("ab \n数据中é\u0301ﬁ<s>▁　1"), max_size=150), st.integers(5, 40), st.integers(1, 8))
def test_spliced_chunks_of_any_text(text, chunk, overlap):
    counter = tokencount.piece_counter(PIECES)
    assert counter.spliced(text, chunk, overlap) == len(counter.model.encode(text))


def base_of(text):
    words = BLANK.findall(text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    covered = {p for i, w in enumerate(windows) if count[w] > 1 for p in range(i, i + 8)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if BLANK.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_rule_statistics(spark, docs, odd_texts):
    extra = [(200, "a b c d e f g h " * 5), (201, "# a\n# a\n\n \n# a\nb"), (202, " ".join(map(str, range(30))) + " " + " ".join(map(str, range(12))))]
    rows = [*odd_texts, *extra]
    found = rules.judged(spark.createDataFrame(rows, "doc_id bigint, text string")).drop("kept", "p_good").collect()
    assert sorted(map(tuple, found), key=key) == sorted(((k, *base_of(t)) for k, t in rows), key=key)


def test_rules_drop_junk_and_keep_prose(spark):
    import random

    rng = random.Random(2)
    prose = [(k, "The " + " ".join(rng.choice("aeiou") + rng.choice(["river", "taker", "water", "hills", "lakes"]) + rng.choice("xyzuv") for _ in range(80)) + ".") for k in range(300)]
    junk = [(1000 + k, " ".join(f"wo{rng.randint(0, 999)}rd | #" for _ in range(60))) for k in range(40)]
    kept = {r.doc_id for r in rules.judged(spark.createDataFrame(prose + junk, "doc_id bigint, text string")).filter("kept").collect()}
    assert kept == {k for k, _ in prose}


def test_contamination_against_brute_force(spark, docs, odd_texts):
    long = lower(odd_texts[0][1])
    items = [(1, odd_texts[60][1]), (2, " ".join(odd_texts[86][1].split()[100:113])), (3, "one two"), (4, ""), (5, None), (6, "a"), (7, " ".join(long.split()[:12])), (8, "text of the same id"), (9, "one two"), (10, "lo a lo a lo a lo a lo a lo a lo a")]
    rows = decontam.contamination(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    windows = []
    for item, text in items:
        words = ALNUM.findall(lower(text))
        n = min(13, len(words))
        windows.append((item, n, {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()))
    expected = []
    for doc_id, text in odd_texts:
        words, hit, met = ALNUM.findall(lower(text)), set(), set()
        for item, n, runs in windows:
            for i in range(len(words) - n + 1 if n else 0):
                if tuple(words[i : i + n]) in runs:
                    hit.update(range(i, i + n))
                    met.add(str(item))
        expected.append((doc_id, len(words), len(hit), sorted(met), bool(hit) and 20 * len(hit) >= len(words)))
    found = [(r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in rows]
    assert sorted(found, key=lambda r: (str(r), )) == sorted(expected, key=lambda r: (str(r), ))
    assert any(r[2] for r in expected) and hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_every_shared_window_is_found(spark):
    rng = np.random.default_rng(4)
    word = lambda: f"w{rng.integers(0, 6)}"
    items = [(i, " ".join(word() for _ in range(rng.integers(13, 40)))) for i in range(15)]
    docs = []
    for k in range(60):
        item = items[k % 15][1].split()
        at, n = rng.integers(0, len(item) - 12), 13 if k % 2 else 12
        docs.append((k, " ".join([*(word() + "x" for _ in range(rng.integers(0, 30))), *item[at : at + n], *(word() + "y" for _ in range(20))])))
    rows = decontam.contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {r.doc_id: r.n_hit for r in rows} == {k: 13 if k % 2 else 0 for k, _ in docs}


def test_language_model_against_brute_force(docs, odd_texts):
    rows = lm.scored(docs).collect()
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2
    tokens = [(k, [*BLANK.findall(lower(t)), None]) for k, t in odd_texts]
    count = Counter(w for k, ws in tokens if not held(k) for w in ws)
    n, v = sum(count.values()), len(count)
    expected = [(k, held(k), len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 1) / (n + 1 * (v + 1))) for w in ws), 6)) for k, ws in tokens]
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows), key=key) == sorted(expected, key=key)
    assert all(r.score < 0 for r in rows)


def test_interpolated_scores_against_brute_force(docs, odd_texts, monkeypatch):
    """The mixture with weights that depend on the bucket alone, token by token."""
    weights = np.array([[0.0, 0.8, 0.2], *([0.1 + 0.015 * b, 0.7 - 0.015 * b, 0.2] for b in range(1, lm.BUCKETS))])
    monkeypatch.setattr(lm, "fit_weights", lambda *_: weights)
    found = Counter((r.doc_id, round(r.score, 6)) for r in lm.scored(docs).collect())
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2
    tokens = [(k, [*BLANK.findall(lower(t)), None]) for k, t in odd_texts]
    trained = [ws for k, ws in tokens if not held(k)]
    count, pairs = Counter(w for ws in trained for w in ws), Counter(p for ws in trained for p in zip(["start", *ws], ws))
    n, v, starts = sum(count.values()), len(count), len(trained)
    expected = Counter()
    for k, ws in tokens:
        score = 0.0
        for place, (before, w) in enumerate(zip(["start", *ws], ws)):
            context = starts if place == 0 else count[before]
            mix = weights[min(1 + int(math.log2(context)), lm.BUCKETS - 1) if context else 0]
            score += math.log10(mix[0] * (pairs[before, w] / context if context else 0) + mix[1] * count[w] / n + mix[2] / (v + 1))
        expected[k, round(score, 6)] += 1
    assert found == expected


def test_contexts_of_any_frequency_have_a_bucket():
    assert lm.bucket(np.array([0, 1, 2**39, 2**62])).tolist() == [0, 1, lm.BUCKETS - 1, lm.BUCKETS - 1]


def test_scores_of_a_language_model_beat_the_base(docs):
    rows = lm.scored(docs).collect()
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


def test_interpolation_weights_are_chances_and_prefer_what_predicts():
    weights = lm.fit_weights(np.array([3, 3, 5]), np.array([90.0, 10.0, 50.0]), np.array([0.5, 0.0, 0.0]), np.array([0.01, 0.01, 0.02]), 1e-3)
    assert np.allclose(weights.sum(axis=1), 1) and (weights >= 0).all() and weights[0, 0] == 0
    assert weights[3, 0] > 0.8 and weights[5, 0] < 0.05
