"""Quality classifier: histogram gradient-boosted trees over document statistics.

``document_statistics`` describes a whole text by numbers; ``fit_trees`` grows boosted
trees on binned statistics of a bounded sample of labelled documents; the trees are kept
as flat arrays, one row of nodes per tree, and documents walk them level by level with
numpy. Labels, language, source and id never enter a score.

Rules for odd rows: null and empty texts are scored like a text without words; a table
without labels of both kinds gives the share of label 1 (1 if there is no label at all)
to every document; repeated rows are scored alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import BLANK_SEPARATED, U, Words, slices, text_bytes
from .textmodel import class_sizes, labelled_sample

#: Bound of the labelled documents that are learned from, for each label.
PER_CLASS = 6000
KEEP_FROM = 0.7

STATISTICS = """
log_bytes log_words word_length upper digit punctuation symbol exclaim bar newline high blank
distinct_words repeated_next top_word duplicate_lines log_line short_words long_words upper_words symbol_words bare_words
""".split()


def _classes() -> list[np.ndarray]:
    has = lambda s: np.isin(np.arange(256), list(s.encode()))
    b = np.arange(256)
    return [
        (b >= 65) & (b <= 90), (b >= 48) & (b <= 57), has(".,;:?'\"()-"), has("#*$%&|<>"), has("!"), has("|"), b == 10, b >= 128, ~BLANK_SEPARATED,
    ]


CLASSES = _classes()


def document_statistics(column: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` per text."""
    data, offsets = text_bytes(column)
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    out = np.zeros((n, len(STATISTICS)))
    words = Words(data, offsets, lower=True)
    count = words.counts.astype(float)
    some, per = np.maximum(size, 1), np.maximum(count, 1)

    def within(flags, bounds):
        total = np.r_[0, np.cumsum(flags, dtype=np.int64)]
        return total[bounds[1:]] - total[bounds[:-1]]

    out[:, 0], out[:, 1] = np.log1p(size), np.log1p(count)
    lengths = words.end - words.start
    out[:, 2] = np.bincount(words.doc, lengths, n) / per if len(words) else 0
    inside = {}
    for k, members in enumerate(CLASSES):
        flags = members[data]
        out[:, 3 + k] = within(flags, offsets) / some
        inside[k] = flags
    if len(words):
        total = {k: np.r_[0, np.cumsum(inside[k], dtype=np.int64)] for k in (0, 3, 4)}
        of = lambda k: total[k][words.end] - total[k][words.start]
        key = np.sort((words.doc.astype(np.uint64) << U(40)) | (words.hash >> U(24)))
        fresh = np.r_[True, key[1:] != key[:-1]]
        at = np.flatnonzero(fresh)
        runs, owner = np.diff(np.r_[at, len(key)]), (key[at] >> U(40)).astype(np.int64)
        out[:, 12] = np.bincount(owner, minlength=n) / per
        same = np.r_[False, (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])]
        out[:, 13] = np.bincount(words.doc[same], minlength=n) / per
        top = np.zeros(n)
        np.maximum.at(top, owner, runs)
        out[:, 14] = top / per
        tally = lambda flags: np.bincount(words.doc[flags], minlength=n) / per
        out[:, 17], out[:, 18] = tally(lengths <= 3), tally(lengths >= 16)
        out[:, 19] = tally(of(0) * 2 > lengths)
        out[:, 20] = tally((of(3) > 0) | (of(4) > 0))
        out[:, 21] = tally(of(3) == lengths)
    lines = Words(data, offsets, np.arange(256) != 10, lower=False)
    if len(lines):
        per_line = np.maximum(lines.counts, 1)
        key = np.sort((lines.doc.astype(np.uint64) << U(40)) | (lines.hash >> U(24)))
        again = np.r_[False, key[1:] == key[:-1]]
        out[:, 15] = np.bincount((key[again] >> U(40)).astype(np.int64), minlength=n) / per_line
        out[:, 16] = np.log1p(np.bincount(lines.doc, lines.end - lines.start, n) / per_line)
    return out


@dataclass
class Trees:
    """Boosted trees as flat arrays of shape (trees, nodes); a leaf is its own child."""

    base: float
    feature: np.ndarray
    limit: np.ndarray
    low: np.ndarray
    high: np.ndarray
    value: np.ndarray
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                left = x[rows, self.feature[t][node]] <= self.limit[t][node]
                node = np.where(left, self.low[t][node], self.high[t][node])
            total += self.value[t][node]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, smooth: float = 1.0, least: float = 10.0) -> Trees:
    """Newton boosting of the logistic loss; every split is chosen from sums per bin."""
    nodes = 2 ** (depth + 1) - 1
    share = np.clip((weight * y).sum() / max(weight.sum(), 1e-12), 1e-6, 1 - 1e-6) if len(y) else 1 - 1e-6
    base = float(np.log(share / (1 - share)))
    if len(y) == 0 or len(np.unique(y)) < 2:
        trees = 0
    shape = (trees, nodes)
    out = Trees(base, np.zeros(shape, np.int64), np.full(shape, np.inf), np.tile(np.arange(nodes), (trees, 1)), np.tile(np.arange(nodes), (trees, 1)), np.zeros(shape), depth)
    if not trees:
        return out
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    columns = np.arange(x.shape[1]) * bins
    raw = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = weight * (p - y), weight * p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            live = node >= first
            cell = ((node[live] - first)[:, None] * (x.shape[1] * bins) + columns + binned[live]).ravel()
            sums = [np.bincount(cell, np.repeat(v[live], x.shape[1]), wide * x.shape[1] * bins).reshape(wide, x.shape[1], bins) for v in (grad, hess, np.ones(len(y)))]
            left_g, left_h, left_n = (np.cumsum(s, axis=2) for s in sums)
            all_g, all_h, all_n = left_g[:, :1, -1:], left_h[:, :1, -1:], left_n[:, :1, -1:]
            score = lambda g, h: g * g / (h + smooth)
            gain = score(left_g, left_h) + score(all_g - left_g, all_h - left_h) - score(all_g, all_h)
            gain[(left_n < least) | (all_n - left_n < least)] = -1
            for f, e in enumerate(edges):
                gain[:, f, len(e) :] = -1
            best = gain.reshape(wide, -1).argmax(axis=1)
            for k in np.flatnonzero(gain.reshape(wide, -1)[np.arange(wide), best] > 1e-9):
                f, b = divmod(int(best[k]), bins)
                i = first + k
                out.feature[t, i], out.limit[t, i] = f, edges[f][b]
                out.low[t, i], out.high[t, i] = 2 * i + 1, 2 * i + 2
                mine = node == i
                node[mine] = np.where(binned[mine, f] <= b, 2 * i + 1, 2 * i + 2)
        g, h = np.bincount(node, grad, nodes), np.bincount(node, hess, nodes)
        out.value[t] = -rate * g / (h + smooth)
        raw += out.value[t][node]
    return out


def is_held_out(doc_id: str = "doc_id") -> Column:
    """Documents that are never learned from; a null id is not one of them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Trees:
    """Learn from at most ``per_class`` labelled documents of each label; only their statistics reach the driver."""
    usable = ~is_held_out()
    rows = labelled_sample(docs, labels, "quality", per_class, usable)

    def make(batches):
        for part in slices(batches, "text"):
            stats = document_statistics(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.FixedSizeListArray.from_arrays(pa.array(stats.ravel()), stats.shape[1]).cast(pa.list_(pa.float64()))], names=["doc_id", "label", "stats"])

    found = rows.select("doc_id", "label", "text").mapInArrow(make, "doc_id bigint, label int, stats array<double>").toArrow()
    y = found.column("label").to_numpy().astype(float)
    x = np.array(found.column("stats").to_pylist(), dtype=float).reshape(len(y), len(STATISTICS))
    order = np.lexsort((*x.T, y, found.column("doc_id").to_numpy()))
    sizes = class_sizes(labels, "quality", usable)
    seen = np.bincount(y.astype(int), minlength=2)
    weight = np.array([sizes.get(k, 0) / max(seen[k], 1) for k in (0, 1)])[y.astype(int)]
    weight = weight / weight.mean() if len(weight) else weight
    return fit_trees(x[order], y[order], weight[order])


def quality_score(model: Trees, text: str | Column = "text") -> Column:
    """Probability of label 1 for each text."""

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        parts = [model.probability(document_statistics(p.column("text"))) for p in slices([pa.RecordBatch.from_arrays([column], names=["text"])], "text")]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return score(text)


def scored(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from 0.7)."""
    model = fit_quality(docs, labels, per_class)
    rows = docs.select(F.col("doc_id").alias("doc_id"), is_held_out().alias("held_out"), quality_score(model).alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= KEEP_FROM, 1).otherwise(0))


def accepted(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The rows of ``docs``, unchanged, that the classifier predicts as good."""
    return docs.filter(quality_score(fit_quality(docs, labels, per_class)) >= KEEP_FROM)
