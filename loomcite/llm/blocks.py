"""Blocks of texts, and counts of hashed keys over the whole corpus.

A block is some megabytes of consecutive texts in one row of a written table, so every later
step sees the same blocks however often it runs. A key that a block asks about is sent once
per block, as part of a compressed run of sorted keys: ``corpus_counts`` deals the runs by
ranges of the key, adds up each range in one group of bounded size and answers every run in
the order it was asked. Nothing about the corpus reaches the driver but a sum.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .arrays import U, pack_sorted, planes, slices, text_bytes, unpack_sorted, unplanes

BLOCK_BYTES = 6 << 20
BLOCK_ROWS = 1 << 16
#: Keys of one group at most, on average; groups are ranges of a hash.
GROUP_KEYS = 1 << 20
#: Spare bits of a fingerprint: the chance that a key meets another one's is 2 to minus this.
SPARE_BITS = 14


def text_blocks(docs: DataFrame, flag: Column | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents as written blocks: block, ids, keys (hash of id and text), flags, sizes, words (bound), body."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(doc_id), F.col(text)).alias("key"),
        (F.lit(True) if flag is None else flag).alias("flag"), F.col(text).alias("text"),
    )

    def make(batches):
        part_id, press = TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=7)
        for k, part in enumerate(slices(batches, "text", BLOCK_BYTES, BLOCK_ROWS)):
            data, offsets = text_bytes(part.column("text"))
            one = lambda c: pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(c))
            yield pa.RecordBatch.from_arrays([
                pa.array([(part_id << 16) + k]), one("doc_id"), one("key"), one("flag"), pa.array([planes(np.diff(offsets))], pa.binary()),
                pa.array([len(data) // 2 + part.num_rows]), pa.array([press.compress(data.tobytes())], pa.binary()),
            ], names=["block", "ids", "keys", "flags", "sizes", "words", "body"])

    return durable(rows.mapInArrow(make, "block bigint, ids array<bigint>, keys array<bigint>, flags array<boolean>, sizes binary, words bigint, body binary"))


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows one by one, so that only one block at a time is unpacked."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def block_text(sizes: bytes, body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets that ``Words`` takes."""
    offsets = np.r_[0, np.cumsum(unplanes(sizes, np.int64))]
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(body, max_output_size=max(int(offsets[-1]), 1)), np.uint8), offsets


def fingerprint_bits(blocks: DataFrame, per_word: int = 1, spare: int = SPARE_BITS) -> int:
    """Bits that keep keys apart, from a bound on their number."""
    total = (blocks.agg(F.sum("words")).first()[0] or 0) * per_word
    return min(64, math.ceil(math.log2(total + 2)) + spare)


def summed(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order and the sum of each one's weights."""
    if weights is None:
        keys = np.sort(keys)
        at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        return keys[at], np.diff(np.r_[at, len(keys)])
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(weights, at) if len(at) else weights


def corpus_counts(blocks: DataFrame, columns: list[str], asked: Callable, bits: int, per_word: int = 1) -> DataFrame:
    """Answers (block, p, counts, wide, fresh) to what each block asks.

    ``asked(row)`` gives a block's distinct keys of ``bits`` bits in order, and what the
    block adds to each (0 or more). ``answer`` puts a block's answers together again.
    ``fresh`` counts the even keys with a positive sum, each at one of the blocks that ask.
    """
    total = (blocks.agg(F.sum("words")).first()[0] or 0) * per_word
    groups = max(4 * int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // GROUP_KEYS)
    limits = np.array([(g << bits) // groups for g in range(1, groups)], dtype=np.uint64)

    def ask(batches):
        for batch in batches:
            for row in rows_of(batch):
                keys, add = asked(row)
                cut = np.r_[0, np.searchsorted(keys, limits, "left"), len(keys)]
                some = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays([
                    pa.array(some.astype(np.int32)), pa.array(np.full(len(some), row["block"], np.int64)),
                    pa.array([pack_sorted(keys[cut[g] : cut[g + 1]]) for g in some], pa.binary()),
                    pa.array([planes(add[cut[g] : cut[g + 1]].astype(np.uint32)) for g in some], pa.binary()),
                ], names=["p", "block", "keys", "add"])

    def count(table: pa.Table) -> pa.Table:
        press = zstandard.ZstdCompressor(level=3)
        keys = [unpack_sorted(x) for x in table.column("keys").to_pylist()]
        add = np.concatenate([unplanes(x, np.uint32) for x in table.column("add").to_pylist()]).astype(np.int64)
        flat = np.concatenate(keys)
        order = np.argsort(flat, kind="stable")
        near = flat[order]
        fresh = np.r_[True, near[1:] != near[:-1]]
        sums = np.add.reduceat(add[order], np.flatnonzero(fresh))
        out = np.empty(len(flat), np.int64)
        out[order] = sums[np.cumsum(fresh) - 1]
        row = np.repeat(np.arange(len(keys)), [len(k) for k in keys])[order[fresh]]
        new = np.bincount(row[(sums > 0) & (near[fresh] & U(1) == 0)], minlength=len(keys))
        kind = np.uint32 if sums.max() < 2**32 else np.uint64
        parts = np.split(out.astype(kind), np.cumsum([len(k) for k in keys])[:-1])
        return pa.table({"block": table.column("block"), "p": table.column("p"), "counts": pa.array([press.compress(planes(x)) for x in parts], pa.binary()), "wide": pa.array([kind is np.uint64] * len(parts)), "fresh": pa.array(new.astype(np.int64))})

    sent = blocks.select("block", *columns).mapInArrow(ask, "p int, block bigint, keys binary, add binary")
    return sent.groupBy("p").applyInArrow(count, "block bigint, p int, counts binary, wide boolean, fresh bigint")


def answer(table: pa.Table) -> np.ndarray:
    """All counts that a block asked for, in the order of its keys."""
    rows = sorted(table.select(["p", "counts", "wide"]).to_pylist(), key=lambda r: r["p"])
    expand = zstandard.ZstdDecompressor()
    parts = [unplanes(expand.decompress(r["counts"]), np.uint64 if r["wide"] else np.uint32).astype(np.int64) for r in rows]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def answered(blocks: DataFrame, answers: DataFrame, make: Callable, schema: str) -> DataFrame:
    """``make(row, counts, fresh)`` gives a table for each block, the counts that it asked for and the sum of ``fresh``."""

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        counts = answer(right)
        fresh = int(np.sum(right.column("fresh").to_numpy(), dtype=np.int64))
        parts = [make(row, counts, fresh) for row in left.to_pylist()]
        return pa.concat_tables(parts)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(both, schema)


def unused_name(columns: list[str], name: str) -> str:
    """``name``, made longer until no column is called so in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def top_bits(hashes: np.ndarray, bits: int) -> np.ndarray:
    return hashes >> U(64 - bits) if bits < 64 else hashes
