"""Toxicity: cumulative-link ordinal regression over words and beginnings of words.

Severity grades 0 to 3 are ordered: P(grade > k) = sigmoid(w.x - t_k), one weight vector
for all thresholds t_0 <= t_1 <= t_2. The given labels only say toxic or not, so the grade
of a toxic training document is 1 plus the third its share of telling words falls into
(words and beginnings far more frequent in toxic than in clean training documents). A score is the
expected grade; a document is rejected when P(grade > 0) is at least a half.

Rules for odd rows: null and empty texts have no words, hence the expected grade of the
thresholds alone; without labels of both kinds nothing is rejected; repeated rows are
scored alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .arrays import LETTERS_DIGITS, U, Words, slices, text_bytes
from .textmodel import class_sizes, labelled_sample

#: Bound of the labelled documents that are learned from, for each label.
PER_CLASS = 4000
VOCABULARY = 6000
BEGINNINGS = (4, 5, 6)
LEAST_DOCUMENTS = 4
GRADES = 3
REJECT_FROM = 0.5


@dataclass
class Ordinal:
    """``words``: sorted hashes of the vocabulary; ``weight``: one for each; ``limits``: thresholds in order."""

    words: np.ndarray
    weight: np.ndarray
    limits: np.ndarray

    def above(self, column: pa.Array) -> np.ndarray:
        """P(grade > k) for each text and threshold."""
        doc, word, value, n = known_features(column, self.words)
        z = np.bincount(doc, self.weight[word] * value, n) if len(doc) else np.zeros(n)
        return _sigmoid(z[:, None] - self.limits)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every word and of the beginning of every longer word, for each place where it stands."""
    doc, value = [words.doc], [words.hash]
    for size in BEGINNINGS:
        word, begin = words.beginnings(size)
        doc.append(words.doc[word])
        value.append(begin)
    return np.concatenate(doc), np.concatenate(value)


def feature_counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(text, feature, count) of all distinct features of each text, and the number of texts."""
    doc, value = features(Words(*text_bytes(column), LETTERS_DIGITS))
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), len(column)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    at = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])])
    return doc[at], value[at], np.diff(np.r_[at, len(doc)]), len(column)


def known_features(column: pa.Array, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(text, place in the vocabulary, 1 + log count) of the known features of each text."""
    doc, value = features(Words(*text_bytes(column), LETTERS_DIGITS))
    # one table look-up on 16 bits spares the search for nearly all features
    maybe = np.zeros(1 << 16, dtype=bool)
    maybe[(vocabulary >> U(48)).astype(np.int64)] = True
    hit = np.flatnonzero(maybe[(value >> U(48)).astype(np.int64)])
    doc, value = doc[hit], value[hit]
    place = np.searchsorted(vocabulary, value)
    place[place == len(vocabulary)] = 0
    known = vocabulary[place] == value if len(vocabulary) else np.zeros(0, bool)
    key, count = np.unique(doc[known] * (len(vocabulary) + 1) + place[known], return_counts=True)
    doc, at = np.divmod(key, len(vocabulary) + 1)
    return doc, at, 1 + np.log(count), len(column)


def fit_ordinal(doc: np.ndarray, word: np.ndarray, value: np.ndarray, grade: np.ndarray, weight: np.ndarray, words: np.ndarray, rounds: int = 400, rate: float = 0.1, penalty: float = 1e-4) -> Ordinal:
    """Maximum likelihood of the cumulative-link model with a ridge penalty, by Adam on the full sample."""
    n, levels = len(grade), np.arange(GRADES)
    target = (grade[:, None] > levels).astype(float)
    share = np.clip((weight[:, None] * target).sum(axis=0) / weight.sum(), 1e-6, 1 - 1e-6)
    limits = np.log((1 - share) / share)
    steps = np.r_[limits[0], np.log(np.maximum(np.diff(limits), 1e-3))]
    theta = np.r_[np.zeros(len(words)), steps]
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    scale = weight / weight.sum()

    def unfold(s):
        return np.cumsum(np.r_[s[0], np.exp(s[1:])])

    for i in range(1, rounds + 1):
        w, t = theta[: len(words)], unfold(theta[len(words) :])
        z = np.bincount(doc, w[word] * value, n)
        above = _sigmoid(z[:, None] - t)
        # the grade's probability is the difference of neighbouring cumulative ones
        upper, lower = np.c_[np.ones(n), above], np.c_[above, np.zeros(n)]
        rows = np.arange(n)
        hi, lo = upper[rows, grade], lower[rows, grade]
        p = np.maximum(hi - lo, 1e-12)
        dz = -scale * (hi * (1 - hi) - lo * (1 - lo)) / p
        dt = np.zeros(GRADES)
        np.add.at(dt, grade[grade > 0] - 1, (scale * hi * (1 - hi) / p)[grade > 0])
        np.add.at(dt, grade[grade < GRADES], -(scale * lo * (1 - lo) / p)[grade < GRADES])
        tail = np.cumsum(dt[::-1])[::-1]
        ds = np.r_[tail[0], tail[1:] * np.exp(theta[len(words) + 1 :])]
        g = np.r_[np.bincount(word, dz[doc] * value, len(words)) + penalty * w, ds]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        theta = theta - rate * (first / (1 - 0.9**i)) / (np.sqrt(second / (1 - 0.999**i)) + 1e-8)
    return Ordinal(words, theta[: len(words)], unfold(theta[len(words) :]))


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Ordinal:
    """Learn from at most ``per_class`` labelled documents of each label; their word counts reach the driver, no text."""
    rows = labelled_sample(docs, labels, "toxic", per_class)

    def make(batches):
        for part in slices(batches, "text"):
            doc, word, count, n = feature_counts(part.column("text"))
            ends = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), part.column("label"), pa.ListArray.from_arrays(pa.array(ends), pa.array(word.view(np.int64))),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(count.astype(np.int32))),
            ], names=["doc_id", "label", "words", "counts"])

    rows = durable(rows.select("doc_id", "label", "text").mapInArrow(make, "doc_id bigint, label int, words array<bigint>, counts array<int>"))
    n_toxic, n_clean = (rows.filter(F.col("label") == k).count() for k in (1, 0))
    if not n_toxic or not n_clean:
        return Ordinal(np.zeros(0, np.uint64), np.zeros(0), np.full(GRADES, 30.0))
    # features of fewer documents than LEAST_DOCUMENTS can't be told from chance; of the others those stay
    # whose share of toxic documents differs most from their share of clean ones, in standard errors
    seen = rows.select("label", F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("t"))
    p = F.col("n") / (n_toxic + n_clean)
    gap = F.abs(F.col("t") / n_toxic - (F.col("n") - F.col("t")) / n_clean) / F.sqrt(p * (1 - p) + 1e-9)
    usual = seen.filter(F.col("n") >= LEAST_DOCUMENTS).orderBy(gap.desc(), "word").limit(VOCABULARY).select("word").toArrow()
    words = np.sort(usual.column("word").to_numpy().astype(np.int64).view(np.uint64))
    pairs = F.transform(F.arrays_zip("words", "counts"), lambda p: F.struct(p["words"].alias("word"), p["counts"].alias("n")))
    kept = F.broadcast(rows.sparkSession.createDataFrame([(w,) for w in words.view(np.int64).tolist()], "word bigint"))
    long = rows.withColumn("total", F.aggregate("counts", F.lit(0), lambda a, c: a + c))
    heads = long.select("doc_id", "label", "total").toArrow()
    body = long.select("doc_id", F.explode(pairs).alias("p")).select("doc_id", "p.*").join(kept, "word").toArrow()
    ids = heads.column("doc_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    ids, label, total = ids[order], heads.column("label").to_numpy()[order], np.maximum(heads.column("total").to_numpy()[order], 1)
    ids, at = np.unique(ids, return_index=True)
    label, total = label[at].astype(int), total[at]
    doc = np.searchsorted(ids, body.column("doc_id").to_numpy())
    word = np.searchsorted(words, body.column("word").to_numpy().astype(np.int64).view(np.uint64))
    count = body.column("n").to_numpy().astype(float)
    order = np.lexsort((word, doc))
    doc, word, count = doc[order], word[order], count[order]
    seen = np.bincount(label, minlength=2)
    toxic_df, clean_df = (np.bincount(word[label[doc] == k], minlength=len(words)) / max(seen[k], 1) for k in (1, 0))
    telling = (toxic_df > 8 * clean_df + 0.004)
    density = np.bincount(doc, count * telling[word], len(ids)) / total
    grade = label.copy()
    cuts = np.quantile(density[label == 1], [1 / 3, 2 / 3])
    grade[label == 1] = 1 + np.searchsorted(cuts, density[label == 1], "left")
    sizes = class_sizes(labels, "toxic")
    weight = np.array([sizes.get(k, 0) / max(seen[k], 1) for k in (0, 1)])[label]
    return fit_ordinal(doc, word, 1 + np.log(count), grade, weight, words)


def toxicity(model: Ordinal, text: str | Column = "text") -> Column:
    """Array of P(grade > 0), P(grade > 1), P(grade > 2) for each text."""

    @F.arrow_udf("array<double>")
    def above(column: pa.Array) -> pa.Array:
        parts = [model.above(p.column("text")) for p in slices([pa.RecordBatch.from_arrays([column], names=["text"])], "text")]
        flat = np.concatenate(parts).ravel() if parts else np.zeros(0)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, GRADES, dtype=np.int32)), pa.array(flat))

    return above(text)


def scored(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, severity (expected grade, 0 to 3), grade (the likeliest), p_toxic, toxic (p_toxic from a half)."""
    model = fit_toxicity(docs, labels, per_class)
    rows = docs.select(F.col("doc_id").alias("doc_id"), toxicity(model).alias("p"))
    p = [F.lit(1.0), *[F.col("p")[k] for k in range(GRADES)], F.lit(0.0)]
    each = [p[k] - p[k + 1] for k in range(GRADES + 1)]
    most = F.greatest(*each)
    grade = F.coalesce(*[F.when(each[k] == most, k) for k in range(GRADES + 1)])
    return rows.select(
        "doc_id", (p[1] + p[2] + p[3]).alias("severity"), grade.alias("grade"), p[1].alias("p_toxic"), (p[1] >= REJECT_FROM).alias("toxic"),
    )


def accepted(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The rows of ``docs``, unchanged, that aren't predicted as toxic."""
    return docs.filter(toxicity(fit_toxicity(docs, labels, per_class))[0] < REJECT_FROM)
