"""Training-order materialisation: sequences in a keyed random order, in shards of fixed stride.

Every document becomes token ids and an end id, cut into sequences of at most ``STRIDE`` ids.
The sequences are numbered without gaps; a keyed Feistel permutation over the next even power
of two, walked along its cycle until it lands below the number of sequences, gives each its
slot in the training order, a bijection that needs no sort and no table. Slot s lies in shard
s div ``PER_SHARD`` at byte (s mod ``PER_SHARD``) x stride x 2, so a reader can go on from any
slot with one seek. A shard is written whole under a temporary name and then renamed; a task
that is run again writes the same bytes.

Rules for odd rows: null and empty texts are the end id alone; repeated rows and ids are
sequences of their own; a null id stays null; an empty table writes no shard. Unused ids of
a slot hold ``PAD``, which is no token.
"""

from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_folder, durable
from .arrays import ODD, U, mix, slices
from .wordbpe import word_encoder

STRIDE = 512
PER_SHARD = 1 << 14
END_ID = 0
PAD = 0xFFFF
KEY = 20240229
ROUNDS = 6


def feistel(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """A permutation of 0 .. n - 1, by a balanced Feistel network with cycle-walking."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = U((1 << half) - 1), U(half)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * ODD[0] + U(key & 0xFFFFFFFFFFFFFFFF))
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & mask)
        out[todo] = left << shift | right
        todo = todo[out[todo] >= U(n)]
    return out.astype(np.int64)


def packed_ids(ids: np.ndarray, press: zstandard.ZstdCompressor) -> bytes:
    """High bytes, then the low bytes in order of their high byte, as these say much about each other."""
    high = (ids >> 8).astype(np.uint8)
    parts = [press.compress(high.tobytes()), press.compress(ids.astype(np.uint8)[np.argsort(high, kind="stable")].tobytes())]
    return len(parts[0]).to_bytes(4, "little") + b"".join(parts)


def unpacked_ids(data: bytes, n: int, expand: zstandard.ZstdDecompressor) -> np.ndarray:
    cut = 4 + int.from_bytes(data[:4], "little")
    high, low = (np.frombuffer(expand.decompress(x, max_output_size=max(n, 1)), np.uint8) for x in (data[4:cut], data[cut:]))
    out = high.astype(np.uint16) << 8
    out[np.argsort(high, kind="stable")] |= low
    return out


def sequences(docs: DataFrame, vocabulary: str, stride: int = STRIDE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Written bundles of sequences: part (of the writing task), turn (of the bundle in it), n, doc_ids, pieces, lengths, ids (compressed)."""

    def make(batches):
        encoder, part_id, press = word_encoder(vocabulary), TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=3)
        ahead = 0  # sequences of the task before this bundle
        for turn, part in enumerate(slices(batches, "text")):
            ids, counts = encoder.encode(part.column("text"))
            counts = counts + 1
            ends = np.cumsum(counts)
            stream = np.full(int(ends[-1]), END_ID, dtype=np.uint16)
            body = np.ones(len(stream), dtype=bool)
            body[ends - 1] = False
            stream[body] = ids
            each = (counts + stride - 1) // stride
            doc = np.repeat(np.arange(len(counts)), each)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
            length = np.minimum(counts[doc] - piece * stride, stride)
            listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(doc)], pa.int32()), x)
            yield pa.RecordBatch.from_arrays([
                pa.array([part_id]), pa.array([turn]), pa.array([len(doc)]), pa.array([ahead]), listed(part.column("doc_id").take(pa.array(doc))),
                listed(pa.array(piece.astype(np.int32))), listed(pa.array(length.astype(np.int32))), pa.array([packed_ids(stream, press)], pa.binary()),
            ], names=["part", "turn", "n", "ahead", "doc_ids", "pieces", "lengths", "ids"])
            ahead += len(doc)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return durable(rows.mapInArrow(make, "part bigint, turn bigint, n bigint, ahead bigint, doc_ids array<bigint>, pieces array<int>, lengths array<int>, ids binary"))


def numbered(bundles: DataFrame) -> tuple[DataFrame, int]:
    """Bundles with the number of their first sequence, and the number of all. One row per writing task reaches the driver and comes back."""
    sizes = bundles.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    ends = np.cumsum([r["n"] for r in sizes]) if sizes else np.zeros(0, np.int64)
    total = int(ends[-1]) if len(ends) else 0
    starts = [(r["part"], int(e) - r["n"]) for r, e in zip(sizes, ends.tolist())]
    before = bundles.sparkSession.createDataFrame(starts, "part bigint, start bigint")
    # as many rows as the bundles have writing tasks, so bundles needn't move
    return bundles.join(F.broadcast(before), "part").withColumn("first", F.col("start") + F.col("ahead")).drop("start", "ahead"), total


def _dealt(total: int, per_shard: int, key: int):
    """Each bundle cut by shard, so that a shard's rows are few and compressed."""

    def make(batches):
        press, expand = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        for batch in batches:
            for row in batch.to_pylist():
                length = np.array(row["lengths"], dtype=np.int64)
                ids = unpacked_ids(row["ids"], int(length.sum()), expand)
                slot = feistel(row["first"] + np.arange(len(length)), total, key)
                order = np.argsort(slot, kind="stable")
                begin = np.cumsum(length) - length
                size = length[order]
                flat = ids[np.repeat(begin[order] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
                shard = slot[order] // per_shard
                cut = np.r_[np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]), len(shard)]
                ends = np.r_[0, np.cumsum(size)]
                about = [pa.array(np.asarray(row["doc_ids"], dtype=object)[order].tolist(), pa.int64()), pa.array(np.array(row["pieces"], np.int32)[order]), pa.array(size.astype(np.int32)), pa.array(slot[order])]
                listed = lambda x: pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), x)
                blobs = [packed_ids(flat[ends[a] : ends[b]], press) for a, b in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(shard[cut[:-1]]), *map(listed, about), pa.array(blobs, pa.binary())], names=["shard", "doc_ids", "pieces", "lengths", "slots", "ids"])

    return make


def _writer(folder: str, total: int, stride: int, per_shard: int):
    def write(table: pa.Table) -> pa.Table:
        expand = zstandard.ZstdDecompressor()
        shard = table.column("shard")[0].as_py()
        length = np.concatenate([np.array(x, np.int64) for x in table.column("lengths").to_pylist()])
        slot = np.concatenate([np.array(x, np.int64) for x in table.column("slots").to_pylist()])
        sizes = [sum(x) for x in table.column("lengths").to_pylist()]
        flat = np.concatenate([unpacked_ids(b, n, expand) for b, n in zip(table.column("ids").to_pylist(), sizes)])
        rows = min(per_shard, total - shard * per_shard)
        out = np.full((rows, stride), PAD, dtype="<u2")
        place = np.repeat((slot - shard * per_shard) * stride - (np.cumsum(length) - length), length) + np.arange(len(flat))
        out.reshape(-1)[place] = flat
        name = f"{folder}/shard-{shard:08d}.bin"
        put(name, out.tobytes())
        order = np.argsort(slot)
        doc_id = pa.chunked_array([table.column("doc_ids").combine_chunks().flatten()]).take(pa.array(order))
        piece = pa.chunked_array([table.column("pieces").combine_chunks().flatten()]).take(pa.array(order))
        slot, length = slot[order], length[order]
        return pa.table({
            "slot": pa.array(slot), "shard": pa.array(np.full(len(slot), shard)), "byte_offset": pa.array((slot - shard * per_shard) * stride * 2), "doc_id": doc_id, "piece": piece,
            "length": pa.array(length), "crc32": pa.array([zlib.crc32(out[s - shard * per_shard].tobytes()) for s in slot.tolist()], pa.int64()),
        })

    return write


def put(name: str, data: bytes) -> None:
    """Write a file whole or not at all, on a shared folder or any store that Arrow knows by its address."""
    if name.startswith("file:") or "://" not in name:
        path = name.removeprefix("file://").removeprefix("file:")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(name)
    store.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, path)


def read_slots(folder: str, first: int, count: int, total: int, stride: int = STRIDE, per_shard: int = PER_SHARD) -> list[np.ndarray]:
    """The ids of ``count`` slots from ``first`` on, read in order: how a trainer resumes. For shared folders."""
    out = []
    while count > 0 and first < total:
        shard, at = divmod(first, per_shard)
        n = min(count, per_shard - at, total - first)
        with open(f"{folder.removeprefix('file://').removeprefix('file:')}/shard-{shard:08d}.bin", "rb") as f:
            f.seek(at * stride * 2)
            rows = np.frombuffer(f.read(n * stride * 2), dtype="<u2").reshape(n, stride)
        out += [r[r != PAD] for r in rows]
        first, count = first + n, count - n
    return out


def new_folder(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark)}/shards-{uuid.uuid4().hex}"


def materialised(docs: DataFrame, vocabulary: str, folder: str | None = None, stride: int = STRIDE, per_shard: int = PER_SHARD, key: int = KEY) -> DataFrame:
    """Write the shards into ``folder`` and return where each sequence is: slot, shard, byte_offset, doc_id, piece, length, crc32 (of its whole stride)."""
    bundles, total = numbered(sequences(docs, vocabulary, stride))
    dealt = bundles.select("first", "doc_ids", "pieces", "lengths", "ids").mapInArrow(
        _dealt(total, per_shard, key), "shard bigint, doc_ids array<bigint>, pieces array<int>, lengths array<int>, slots array<bigint>, ids binary")
    write = _writer(folder or new_folder(docs.sparkSession), total, stride, per_shard)
    return durable(dealt.groupBy("shard").applyInArrow(write, "slot bigint, shard bigint, byte_offset bigint, doc_id bigint, piece int, length bigint, crc32 bigint"))
