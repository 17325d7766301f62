"""Words and hashes of Arrow text batches as numpy arrays.

Everything here works on the bytes of many texts at once: a batch is cut into slices
of bounded size, the words of a slice are found with byte classes and hashed with one
pass over the bytes. A word's hash depends on its bytes only, never on its place.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
#: Letters that are hashed at once, or one word.
LETTERS = 1 << 18
U = np.uint64
ODD = (U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB))

#: Words by the two definitions of the contracts, as classes of UTF-8 bytes.
BLANK_SEPARATED = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
LETTERS_DIGITS = np.array([b >= 0x80 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix finaliser)."""
    x = (x ^ (x >> U(30))) * ODD[1]
    x = (x ^ (x >> U(27))) * ODD[2]
    return x ^ (x >> U(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * ODD[0]) | U(1)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.r_[U(1), np.full(max(n - 1, 0), ODD[0], dtype=np.uint64)])


POWERS = _powers(1024)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the offsets (one more than texts); null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batches: Iterable[pa.RecordBatch], text: str, most: int = SLICE_BYTES, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice has one row, or at most ``most`` bytes of text in ``rows`` rows; no row is left out."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, min(start + rows, int(np.searchsorted(ends, before + most, "right"))))
            yield batch.slice(start, stop - start)
            start = stop


class Words:
    """The words of consecutive texts.

    ``hash``: 64 bits per word; ``doc``: index of its text; ``first``: index of the first
    word of each text (one more than texts); ``start`` and ``end``: byte positions.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = BLANK_SEPARATED, lower: bool = True):
        inside = np.zeros(len(data) + 1, dtype=bool)
        inside[:-1] = kind[data]
        before = np.zeros(len(data) + 1, dtype=bool)
        before[1:] = inside[:-1]
        edges = offsets[1:-1]
        edges = edges[edges < len(data)]
        before[edges] = False
        self.start = np.flatnonzero(inside & ~before)
        after = inside[1:].copy()
        after[edges[edges > 0] - 1] = False
        self.end = np.flatnonzero(inside[:-1] & ~after) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.first = np.searchsorted(self.start, offsets)
        letters, table = data[inside[:-1]], BYTE_VALUES[LOWER] if lower else BYTE_VALUES
        sizes = self.end - self.start
        ends = np.cumsum(sizes)
        longest = int(sizes.max()) if len(sizes) else 0
        powers = POWERS if longest <= len(POWERS) else _powers(longest)
        self.data, self.lower = data, lower
        sums = np.zeros(len(sizes), np.uint64)
        k = 0
        while k < len(sizes):  # 8 bytes a letter in each array, so not for all words at once
            a = ends[k] - sizes[k]
            stop = max(k + 1, int(np.searchsorted(ends, a + LETTERS, "right")))
            at = ends[k:stop] - sizes[k:stop] - a
            place = np.arange(ends[stop - 1] - a) - np.repeat(at, sizes[k:stop])
            sums[k:stop] = np.add.reduceat(table[letters[a : ends[stop - 1]]] * powers[place], at)
            k = stop
        self.hash = mix(sums + sizes.astype(np.uint64))

    def __len__(self) -> int:
        return len(self.hash)

    def beginnings(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, hash of its first ``size`` bytes) for the words of at least as many bytes."""
        long = np.flatnonzero(self.end - self.start >= size)
        letters = self.data[self.start[long][:, None] + np.arange(size)]
        values = (BYTE_VALUES[LOWER] if self.lower else BYTE_VALUES)[letters] * POWERS[:size]
        return long, mix(mix(values.sum(axis=1, dtype=np.uint64)) + U(size))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(column: pa.Array, kind: np.ndarray = BLANK_SEPARATED, lower: bool = True) -> Words:
    return Words(*text_bytes(column), kind, lower)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive items; the caller drops runs that cross texts."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(hashes) - n + 1, n, dtype=np.uint64) * ODD[2]
    for k in range(n):
        out = (out ^ hashes[k : len(hashes) - n + 1 + k]) * ODD[0]
        out ^= out >> U(29)
    return mix(out)


def whole_grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs that lie within one text, and the index of each run's first word."""
    out = grams(words.hash, n)
    at = np.flatnonzero(words.doc[: len(out)] == words.doc[n - 1 :]) if len(out) else np.zeros(0, np.int64)
    return out[at], at


def planes(values: np.ndarray) -> bytes:
    """Bytes of little-endian integers, all lowest bytes first, so that small values compress."""
    values = np.ascontiguousarray(values)
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes() if len(values) else b""


def unplanes(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted integers as the planes of their differences."""
    return planes(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(data: bytes, kind=np.uint64) -> np.ndarray:
    return np.cumsum(unplanes(data, kind), dtype=kind)


def binary_column(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, type=pa.binary())
