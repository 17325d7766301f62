"""Language-model scores by deleted interpolation.

Tokens are the lower-cased, blank-separated words of a text and one end of text. The chance of
a token is a mixture of its maximum-likelihood estimates after its preceding token, alone, and
of a uniform chance over the vocabulary and one unknown token. The weights of the mixture
depend on a bucket of the context's frequency (powers of two) and are learned by expectation
and maximisation on deleted counts: each training token is predicted from the counts without
itself. Counts cover all training documents; a grid of (bucket, estimates) with a fixed number
of cells sums up what the weights are learned from.

Rules for odd rows: null and empty texts are the end of text alone; a null id is a training
document; repeated rows count and are scored each; without training documents every token has
the uniform chance.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .arrays import ODD, U, Words, mix, planes, unplanes
from .blocks import answered, block_text, corpus_counts, fingerprint_bits, rows_of, summed, text_blocks

#: Tokens have even names without the highest bit; pairs, the start of text as a context and the sum of all have odd ones with it.
TOKEN, OTHER = U((1 << 63) - 2), U(1 << 63 | 1)
END = mix(np.array([101], dtype=np.uint64))[0] & TOKEN
START, ALL = (mix(np.array([k], dtype=np.uint64))[0] | OTHER for k in (102, 103))
#: Spare bits of a pair's name: the chance that it meets another pair's is 2 to minus this. Tokens have 62 bits.
PAIR_SPARE = 20
BUCKETS, STEPS = 40, 64
BITS = 64


def is_held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 7 == 2, F.lit(False))


def tokens(data: np.ndarray, offsets: np.ndarray, pair_bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place of each text's tokens, tokens, pairs): a token with its end of text, and its hash with the token before it."""
    words = Words(data, offsets)
    first = np.r_[0, np.cumsum(words.counts + 1)]
    out = np.full(first[-1], END, dtype=np.uint64)
    body = np.ones(len(out), dtype=bool)
    body[first[1:] - 1] = False
    out[body] = words.hash & TOKEN
    before = np.r_[START, out[:-1]]
    before[first[:-1]] = START
    pair = mix(mix(before + ODD[1]) ^ out) >> U(64 - pair_bits) << U(64 - pair_bits)
    return first, out, pair | OTHER


def _asked(row, pair_bits: int = 64):
    """A block's keys: its tokens, pairs, the start and the sum; only training texts add to the counts."""
    first, token, pair = tokens(*block_text(row["sizes"], row["body"]), pair_bits)
    trained = np.array(row["flags"], dtype=bool)
    own = np.repeat(trained, np.diff(first)).astype(np.int64)
    keys = np.concatenate([token, pair, [START, ALL]])
    return summed(keys, np.concatenate([own, own, [trained.sum(), own.sum()]]))


COUNTED = "block bigint, ids array<bigint>, flags array<boolean>, sizes binary, token binary, pair binary, start bigint, total bigint, fresh bigint"


def narrow(counts: np.ndarray) -> bytes:
    """Counts in 32 bits where they fit, else in 64."""
    return zstandard.ZstdCompressor(level=3).compress(planes(counts.astype(np.uint32) if not len(counts) or counts.max() < 2**32 else counts))


def widen(data: bytes, n: int) -> np.ndarray:
    data = zstandard.ZstdDecompressor().decompress(data)
    return unplanes(data, np.uint32 if len(data) == 4 * n else np.int64).astype(np.int64)


def _counted(row, counts, fresh, pair_bits: int = 64):
    """The counts of every token and pair of a block, in the order of the text."""
    first, token, pair = tokens(*block_text(row["sizes"], row["body"]), pair_bits)
    keys = np.unique(np.concatenate([token, pair, [START, ALL]]))
    of = lambda k: counts[np.searchsorted(keys, k)]
    start, total = of(np.array([START, ALL]))
    return pa.table({
        "block": [row["block"]], "ids": pa.array([row["ids"]], pa.list_(pa.int64())), "flags": pa.array([row["flags"]], pa.list_(pa.bool_())),
        "sizes": pa.array([planes(np.diff(first))], pa.binary()), "token": pa.array([narrow(of(token))], pa.binary()), "pair": pa.array([narrow(of(pair))], pa.binary()),
        "start": pa.array([int(start)]), "total": pa.array([int(total)]), "fresh": pa.array([fresh]),
    })


def _estimates(row):
    """(first places, count, pair count, context count) of a block's tokens."""
    first = np.r_[0, np.cumsum(unplanes(row["sizes"], np.int64))]
    token, pair = widen(row["token"], first[-1]), widen(row["pair"], first[-1])
    context = np.r_[row["start"], token[:-1]]
    context[first[:-1]] = row["start"]
    return first, token, pair, context


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + log2 of its frequency, cut to whole numbers; the last bucket has no upper end."""
    return np.where(context > 0, np.minimum(1 + np.log2(np.maximum(context, 1)).astype(np.int64), BUCKETS - 1), 0)


def _cell(pair_share: np.ndarray, share: np.ndarray, group: np.ndarray) -> np.ndarray:
    step = lambda x: np.where(x > 0, np.minimum(1 - np.floor(2 * np.log2(np.maximum(x, 1e-30))).astype(np.int64), STEPS - 1), 0)
    return (group * STEPS + step(pair_share)) * STEPS + step(share)


def deleted_grid(counted: DataFrame) -> DataFrame:
    """(cell, n, pair_share, share): training tokens by bucket and by their estimates without themselves."""

    def make(batches):
        for batch in batches:
            for row in rows_of(batch):
                first, token, pair, context = _estimates(row)
                own = np.repeat(np.array(row["flags"], dtype=bool), np.diff(first))
                token, pair, context = token[own] - 1, pair[own] - 1, context[own] - 1
                pair_share = pair / np.maximum(context, 1)
                share = token / max(row["total"] - 1, 1)
                cell, at, n = np.unique(_cell(pair_share, share, bucket(context)), return_inverse=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n), pa.array(np.bincount(at, pair_share, len(cell))), pa.array(np.bincount(at, share, len(cell)))], names=["cell", "n", "pair_share", "share"])

    rows = counted.mapInArrow(make, "cell bigint, n bigint, pair_share double, share double")
    return rows.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("pair_share").alias("pair_share"), F.sum("share").alias("share"))


def fit_weights(group: np.ndarray, n: np.ndarray, pair_share: np.ndarray, share: np.ndarray, uniform: float, rounds: int = 200) -> np.ndarray:
    """Weights (pair, token, uniform) of each bucket by expectation and maximisation; a bucket without events takes the one below it."""
    parts = np.stack([pair_share, share, np.full(len(n), uniform)], axis=1)
    weights = np.tile([0.4, 0.5, 0.1], (BUCKETS, 1))
    weights[0] = [0.0, 0.9, 0.1]
    seen = np.bincount(group, n, BUCKETS)
    for _ in range(rounds):
        each = weights[group] * parts
        each *= (n / np.maximum(each.sum(axis=1), 1e-300))[:, None]
        for k in range(3):
            weights[:, k] = np.where(seen > 0, (np.bincount(group, each[:, k], BUCKETS) + 1e-3 * (k > 0)) / (seen + 2e-3), weights[:, k])
    for b in range(1, BUCKETS):
        if not seen[b]:
            weights[b] = weights[b - 1] if seen[:b].any() and b > 1 else weights[b]
    weights[0, 1:] += weights[0, 0] / 2
    weights[0, 0] = 0
    return weights / weights.sum(axis=1, keepdims=True)


def _score(weights: np.ndarray, distinct: int):
    def make(batches):
        for batch in batches:
            for row in rows_of(batch):
                first, token, pair, context = _estimates(row)
                total = row["total"]
                base = np.log10((token + 1) / (total + 1 * (distinct + 1)))
                mixture = weights[bucket(context)]
                chance = mixture[:, 0] * pair / np.maximum(context, 1) + mixture[:, 1] * token / max(total, 1) + mixture[:, 2] / (distinct + 1)
                if not total:
                    chance = np.full(len(token), 1 / (distinct + 1))
                add = lambda x: np.add.reduceat(x, first[:-1])
                n = len(first) - 1
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["ids"], pa.int64()), pa.array(~np.array(row["flags"], dtype=bool)), pa.array(np.diff(first)), pa.array(add((token > 0).astype(np.int64))),
                    pa.array(np.full(n, total)), pa.array(add(base)), pa.array(add(np.log10(chance))),
                ], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return make


def scored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    blocks = text_blocks(docs, ~is_held_out(doc_id), doc_id, text)
    # one bit stands for "pair"; names end on whole bytes, so that what is cut off costs nothing
    bits = min(64, -(-(fingerprint_bits(blocks, spare=PAIR_SPARE) + 1) // 8) * 8)
    answers = corpus_counts(blocks, ["sizes", "body", "flags"], partial(_asked, pair_bits=bits), BITS, per_word=2)
    counted = durable(answered(blocks.drop("keys", "words"), answers, partial(_counted, pair_bits=bits), COUNTED))
    distinct = counted.agg(F.sum("fresh")).first()[0] or 0
    grid = deleted_grid(counted).toArrow()
    cell = grid.column("cell").to_numpy()
    n = grid.column("n").to_numpy().astype(float)
    weights = fit_weights(cell // (STEPS * STEPS), n, grid.column("pair_share").to_numpy() / np.maximum(n, 1), grid.column("share").to_numpy() / np.maximum(n, 1), 1 / (distinct + 1))
    return counted.mapInArrow(_score(weights, distinct), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
