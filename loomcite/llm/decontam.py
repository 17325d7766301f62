"""Benchmark decontamination by winnowing.

Every text is turned into hashes of ``GRAM`` consecutive words; in each window of
``WINDOW - GRAM + 1`` consecutive hashes the smallest (the rightmost of equal ones) is a
fingerprint. Two texts that share ``WINDOW`` consecutive words share such a window whole,
so they share a fingerprint: no shared span of that length is missed. Fingerprints of the
documents pass a filter of fixed size made from the benchmark's fingerprints, the rest
are joined with them, and each meeting is extended word by word to both sides. Spans of at
least ``WINDOW`` words are hits. Items of fewer words are one window; all runs of their
length are fingerprints and equality of the run is the hit.

Rules for odd rows: null text has no words; an item without words or without an id is
never found; a document row is reported once for each time it is in the table; items of
the same text are all found; ids may repeat.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .arrays import LETTERS_DIGITS, U, Words, grams, mix, slices, text_bytes
from .blocks import unused_name

WINDOW = 13
GRAM = 5
FILTER_BITS = 24
HIT_TYPE = "array<struct<fp:bigint,at:bigint,n:int,around:binary>>"


def _winnow(hashes: np.ndarray, doc: np.ndarray, window: int, gram: int) -> np.ndarray:
    """First words of the fingerprints of all texts (``hashes``: of words, ``doc``: text of each word)."""
    runs = grams(hashes, gram)
    width = window - gram + 1
    if len(runs) < width:
        return np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(runs, width)
    chosen = np.arange(len(views)) + width - 1 - views[:, ::-1].argmin(axis=1)
    return np.unique(chosen[doc[: len(views)] == doc[window - 1 :]])


def _around(hashes: np.ndarray, first: np.ndarray, last: np.ndarray, at: np.ndarray, reach: int, gram: int, blank: int) -> np.ndarray:
    """The word hashes from ``reach`` before to ``reach`` behind each run; ``blank`` beyond the text."""
    place = at[:, None] + np.arange(-reach, gram + reach)
    out = hashes[np.clip(place, 0, len(hashes) - 1)]
    out[(place < first[:, None]) | (place >= last[:, None])] = blank
    return out


def _spans(words: Words, lengths: list[int], window: int, gram: int, blank: int, keep=None):
    """Fingerprints of texts as arrays (fingerprint, index of the first word, run length, surroundings)."""
    reach = window - gram
    for n in [0, *lengths]:
        if n:
            runs = grams(words.hash, n)
            at = np.flatnonzero(words.doc[: len(runs)] == words.doc[n - 1 :]) if len(runs) else np.zeros(0, np.int64)
        else:
            at = _winnow(words.hash, words.doc, window, gram)
            runs = grams(words.hash, gram)
        fp = mix(runs[at] + U(n))
        if keep is not None:
            met = keep(fp)
            fp, at = fp[met], at[met]
        if n or not len(at):
            around = [b""] * len(at)
        else:
            rows = _around(words.hash, words.first[words.doc[at]], words.first[words.doc[at] + 1], at, reach, gram, blank)
            around = [r.tobytes() for r in rows]
        yield n, fp, at, around


def benchmark_fingerprints(benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, item: str = "item_id", text: str = "text") -> tuple[DataFrame, list[int]]:
    """Rows (fp, n, item, around) of all items, and the lengths below ``window`` that occur (at most 12)."""

    def make(batches):
        for part in slices(batches, "text"):
            words = Words(*text_bytes(part.column("text")), LETTERS_DIGITS)
            counts, ids = words.counts, part.column("item")
            short = sorted({int(n) for n in counts if 0 < n < window})
            for n, fp, at, around in _spans(words, short, window, gram, 1):
                mine = counts[words.doc[at]] == n if n else np.ones(len(at), bool)
                around = [r for r, m in zip(around, mine) if m]
                fp, at = fp[mine], at[mine]
                yield pa.RecordBatch.from_pydict({
                    "fp": pa.array(fp.view(np.int64)), "n": pa.array(np.full(len(fp), n, np.int32)),
                    "item": ids.take(pa.array(words.doc[at])),
                    "around": pa.array(around, pa.binary()),
                })

    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).filter("item is not null")
    rows = durable(rows.mapInArrow(make, "fp bigint, n int, item string, around binary").distinct())
    lengths = sorted(r["n"] for r in rows.filter("n > 0").select("n").distinct().collect())
    return rows, lengths


def fingerprint_filter(rows: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit for each value that the top ``bits`` bits of some fingerprint have: 2 MB at 24, however many there are."""
    slot = F.shiftrightunsigned("fp", 64 - bits)
    cells = rows.select(F.shiftright(slot, 6).alias("cell"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (slot % 64).cast("int")).alias("bit"))
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    for r in cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).collect():
        out[r["cell"]] = r["bits"] & 0xFFFFFFFFFFFFFFFF
    return out


def document_hits(docs: DataFrame, cells: np.ndarray, lengths: list[int], window: int = WINDOW, gram: int = GRAM, bits: int = FILTER_BITS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: doc_id, key (of id and text), n_words, hits (its fingerprints that pass the filter)."""
    shared = docs.sparkSession.sparkContext.broadcast(base64.b64encode(cells.tobytes()))
    struct = pa.struct([("fp", pa.int64()), ("at", pa.int64()), ("n", pa.int32()), ("around", pa.binary())])

    def make(batches):
        table = np.frombuffer(base64.b64decode(shared.value), dtype=np.uint64)

        def keep(fp):
            slot = fp >> U(64 - bits)
            return (table[slot >> U(6)] >> (slot & U(63)) & U(1)).astype(bool)

        for part in slices(batches, "text"):
            words = Words(*text_bytes(part.column("text")), LETTERS_DIGITS)
            found = [(np.full(len(fp), n, np.int32), fp, at, around) for n, fp, at, around in _spans(words, lengths, window, gram, 0, keep)]
            n, fp, at = (np.concatenate([x[k] for x in found]) for k in range(3))
            around = [r for x in found for r in x[3]]
            order = np.argsort(words.doc[at], kind="stable")
            ends = np.searchsorted(words.doc[at][order], np.arange(part.num_rows + 1))
            hits = pa.StructArray.from_arrays([
                pa.array(fp[order].view(np.int64)), pa.array(at[order] - words.first[words.doc[at[order]]]), pa.array(n[order]),
                pa.array([around[i] for i in order], pa.binary()),
            ], fields=list(struct))
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), part.column("key"), pa.array(words.counts.astype(np.int64)),
                pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), hits),
            ], names=["doc_id", "key", "n_words", "hits"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(doc_id), F.col(text)).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(make, f"doc_id bigint, key bigint, n_words bigint, hits {HIT_TYPE}")


def _extend(window: int, gram: int):
    """Grow each meeting to both sides while the words are equal."""
    reach = window - gram

    def make(batches):
        for batch in batches:
            n = batch.column("n").to_numpy(zero_copy_only=False)
            at = batch.column("at").to_numpy(zero_copy_only=False)
            lo, hi, good = at.copy(), at + n, n > 0
            long = np.flatnonzero(n == 0)
            if len(long):
                ours, theirs = (np.frombuffer(b"".join(batch.column(c).take(pa.array(long)).to_pylist()), np.uint64).reshape(len(long), -1) for c in ("around", "theirs"))
                same = ours == theirs
                left = np.cumprod(same[:, :reach][:, ::-1], axis=1).sum(axis=1)
                right = np.cumprod(same[:, reach + gram :], axis=1).sum(axis=1)
                lo[long], hi[long] = at[long] - left, at[long] + gram + right
                good[long] = same[:, reach : reach + gram].all(axis=1) & (hi[long] - lo[long] >= window)
            kept = pa.array(np.flatnonzero(good))
            yield pa.RecordBatch.from_arrays([
                batch.column("key").take(kept), batch.column("item").take(kept), pa.array(lo).take(kept), pa.array(hi).take(kept),
            ], names=["key", "item", "lo", "hi"])

    return make


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """Words of each document that lie in a window of a benchmark item.

    Columns: doc_id, key, n_words, n_hit, n_items, items (ids as strings, sorted), spans
    (word positions from, to), contaminated (a twentieth of the words or more is hit).
    """
    fingerprints, lengths = benchmark_fingerprints(benchmark, window, gram, item)
    rows = durable(document_hits(docs, fingerprint_filter(fingerprints), lengths, window, gram, FILTER_BITS, doc_id, text))
    met = rows.filter(F.size("hits") > 0).dropDuplicates(["key"]).select("key", F.explode("hits").alias("h")).select("key", "h.*")
    met = met.join(fingerprints.withColumnRenamed("around", "theirs"), ["fp", "n"])
    spans = met.select("key", "item", "at", "n", "around", "theirs").mapInArrow(_extend(window, gram), "key bigint, item string, lo bigint, hi bigint")
    found = spans.groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"), F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("spans"))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("to"))
    covered = F.aggregate("spans", start, lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0), s["hi"] - F.greatest(s["lo"], a["to"]))).alias("n"), F.greatest(a["to"], s["hi"]).alias("to")))
    found = found.select("key", "items", "spans", covered["n"].alias("n_hit"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return rows.drop("hits").join(found, "key", "left").select(
        "doc_id", "key", "n_words", n_hit.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"), items.alias("items"), "spans",
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, unchanged, whose text is not contaminated."""
    name = unused_name(docs.columns, "key")
    bad = contamination(docs, benchmark).filter("contaminated").select(F.col("key").alias(name)).distinct()
    return docs.withColumn(name, F.xxhash64("doc_id", "text")).join(bad, name, "left_anti").select(*docs.columns)
