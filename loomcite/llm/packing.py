"""Sum-of-squares packing of documents into token sequences of a fixed capacity.

A document is its token ids and an end id. Only documents longer than the capacity are cut.
Pieces are dealt at random into lots of bounded size. In a lot the pieces are placed longest
first: the open bin (or a new one) is chosen for which the sum, over all gaps, of the squared
number of bins with that gap becomes smallest; gaps that no further piece of the lot fits in don't
count. Where plain best fit needs fewer bins for a lot, its bins are taken. Bins that stay less full than ``FULL`` are
dissolved and dealt again with those of other lots, until one lot is left, so the loss at the
edges of lots stays that of one lot.

Rules for odd rows: null and empty texts are the end id alone; repeated rows and ids are
packed as often as they are there; a null id stays null; an empty table gives no row.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .arrays import slices
from .wordbpe import word_encoder

CAPACITY = 2048
END_ID = 0
LOT = 8192
FULL = 0.995
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of each document: doc_id, piece, start, length, ids_crc32 and, if wanted, ids (little-endian 32-bit)."""

    def make(batches):
        encoder = word_encoder(vocabulary)
        for part in slices(batches, "text"):
            ids, counts = encoder.encode(part.column("text"))
            counts = counts + 1
            ends = np.cumsum(counts)
            stream = np.full(int(ends[-1]), END_ID, dtype="<u4")
            body = np.ones(len(stream), dtype=bool)
            body[ends - 1] = False
            stream[body] = ids
            each = (counts + capacity - 1) // capacity
            doc = np.repeat(np.arange(len(counts)), each)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
            start = piece * capacity
            length = np.minimum(counts[doc] - start, capacity)
            at = (ends - counts)[doc] + start
            raw = [stream[a : a + n].tobytes() for a, n in zip(at.tolist(), length.tolist())]
            columns = [part.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array([zlib.crc32(r) for r in raw], pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(raw, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(make, PIECES + (", ids binary" if with_ids else ""))


def sum_of_squares(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item, for items in the order given."""
    count = np.zeros(capacity + 1, dtype=np.int64)  # open bins by gap; a bin that takes no further piece isn't counted
    least = np.minimum.accumulate(lengths[::-1])[::-1].tolist()  # shortest piece from here on
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    out = np.empty(len(lengths), dtype=np.int64)
    bins = 0
    for k, s in enumerate(lengths.tolist()):
        here, after = count[s:], count[: capacity - s + 1]
        change = np.where(here > 0, 2 * (after - here) + 2, np.iinfo(np.int64).max)
        dead = min(least[k], capacity - s + 1)
        change[:dead] = np.where(here[:dead] > 0, 1 - 2 * here[:dead], np.iinfo(np.int64).max)
        g = int(change.argmin())
        new = 2 * int(count[capacity - s]) + 1 if capacity - s >= least[k] else 0
        if here[g] and change[g] <= new:
            gap = g + s
            b = stacks[gap].pop()
            count[gap] -= 1
        else:
            gap, b, bins = capacity, bins, bins + 1
        left = gap - s
        if left >= least[k]:
            stacks[left].append(b)
            count[left] += 1
        out[k] = b
    return out


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item, for items in the order given: the open bin with the smallest gap that holds it."""
    gaps: list[int] = []  # gaps of open bins, sorted
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    out = np.empty(len(lengths), dtype=np.int64)
    bins = 0
    for k, s in enumerate(lengths.tolist()):
        at = bisect.bisect_left(gaps, s)
        if at < len(gaps):
            gap = gaps[at]
            b = stacks[gap].pop()
            if not stacks[gap]:
                gaps.pop(at)
        else:
            gap, b, bins = capacity, bins, bins + 1
        left = gap - s
        if left:
            if not stacks[left]:
                bisect.insort(gaps, left)
            stacks[left].append(b)
        out[k] = b
    return out


def _pack_lot(capacity: int):
    def pack(table: pa.Table) -> pa.Table:
        length = table.column("length").to_numpy()
        uid = table.column("uid").to_numpy()
        order = np.lexsort((uid, -length))
        length, uid = length[order], uid[order]
        bins, other = sum_of_squares(length, capacity), best_fit(length, capacity)
        if len(length) and other.max() < bins.max():
            bins = other
        by_bin = np.argsort(bins, kind="stable")
        length, uid, bins = length[by_bin], uid[by_bin], bins[by_bin]
        first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]]) if len(bins) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[first, len(bins)])
        end = np.cumsum(length)
        offset = end - length
        offset = offset - np.repeat(offset[first], sizes)
        used = np.add.reduceat(length, first) if len(first) else length
        return pa.table({"uid": uid, "length": length, "sequence_id": np.repeat(uid[first], sizes), "offset": offset, "used": np.repeat(used, sizes)})

    return pack


def place(rows: DataFrame, capacity: int = CAPACITY, lot: int = LOT) -> DataFrame:
    """Where each piece goes: (uid, sequence_id, offset), for rows (uid, length) with lengths up to ``capacity``."""
    whole = rows.filter(F.col("length") == capacity).select("uid", F.col("uid").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    left, placed, turn = rows.filter(F.col("length") < capacity).select("uid", "length"), [whole], 0
    while True:
        n = left.count()
        lots = max(1, -(-n // lot))
        dealt = left.select(F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(lots)).alias("lot"), "uid", "length")
        packed = durable(dealt.groupBy("lot").applyInArrow(_pack_lot(capacity), "uid bigint, length bigint, sequence_id bigint, offset bigint, used bigint"))
        if lots == 1:
            placed.append(packed.select("uid", "sequence_id", "offset"))
            break
        # what is left gets less every turn, or else every bin is nearly full or holds pieces that fit nowhere
        loose = packed.filter(F.col("used") < FULL * capacity)
        again = loose.count()
        if again > 0.9 * n:
            placed.append(packed.select("uid", "sequence_id", "offset"))
            break
        placed.append(packed.filter(F.col("used") >= FULL * capacity).select("uid", "sequence_id", "offset"))
        left, turn = loose.select("uid", "length"), turn + 1
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    return out


def packed(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, lot: int = LOT) -> DataFrame:
    """Every piece of ``docs`` with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = durable(pieces(docs, vocabulary, capacity).withColumn("uid", F.monotonically_increasing_id()))
    return rows.join(place(rows, capacity, lot), "uid").drop("uid")
