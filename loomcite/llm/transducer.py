"""A table-driven transducer over UTF-8 bytes, and a verified hash table of the spans that it finds.

The machine has two states, between words and inside one, and reads a byte at a time; a table
of (state, byte) says what each step emits: a word's start or end, a code point, a capital, a
symbol. The state after a byte depends on that byte alone, so a whole batch of texts runs in one
pass of two array look-ups, with the state set back at the start of each text.

Spans go into an open-addressing table. A span is taken as seen before only after its bytes have
been compared with those of the span that holds the slot, so two words are never taken for one.
"""

from __future__ import annotations

import numpy as np

from .arrays import ODD, U, mix

BETWEEN, INSIDE = 0, 1
START, END, POINT, CAPITAL, SYMBOL = 1, 2, 4, 8, 16
SYMBOLS = b"#$%&*|"
#: Spans longer than this are compared whole, not eight bytes at a time.
LONG = 512
#: Spans to a table.
TABLE = 1 << 16


def blank(byte: int) -> bool:
    return byte == 32 or 9 <= byte <= 13


def _emissions() -> np.ndarray:
    """What a step emits, by state x 256 + byte."""
    table = np.zeros((2, 256), dtype=np.uint8)
    for b in range(256):
        always = POINT * (not 0x80 <= b < 0xC0) | CAPITAL * (65 <= b <= 90) | SYMBOL * (b in SYMBOLS)
        table[BETWEEN, b] = always | START * (not blank(b))
        table[INSIDE, b] = always | END * blank(b)
    return table.ravel()


NEXT = np.array([BETWEEN if blank(b) else INSIDE for b in range(256)], dtype=np.uint16) << 8
EMIT = _emissions()


class Pass:
    """One pass over the texts ``data[offsets[k]:offsets[k + 1]]``.

    ``start`` and ``end`` of every word and the text it lies in (``doc``); per text the number
    of ``words``, ``points`` (code points), ``capitals`` and ``symbols``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        state = np.empty(len(data), dtype=np.uint16)
        state[1:] = NEXT[data[:-1]]
        starts = offsets[:-1]
        state[starts[starts < len(data)]] = BETWEEN << 8
        emitted = EMIT[state | data]
        self.start = np.flatnonzero(emitted & START)
        ends = np.flatnonzero(emitted & END)
        stops = offsets[1:][np.diff(offsets) > 0]
        stops = stops[NEXT[data[stops - 1]] != BETWEEN] if len(stops) else stops
        self.end = np.sort(np.concatenate([ends, stops]), kind="stable")
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.words = np.bincount(self.doc, minlength=len(offsets) - 1)
        self.points, self.capitals, self.symbols = (self._per_text(emitted & flag, offsets) for flag in (POINT, CAPITAL, SYMBOL))

    @staticmethod
    def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return np.diff(np.r_[0, np.cumsum(flags != 0, dtype=np.int64)][offsets])


class Spans:
    """Spans of bytes, read eight at a time; the rest of the last eight is zero."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.data = np.concatenate([data, np.zeros(8, np.uint8)])
        self.eights = np.lib.stride_tricks.as_strided(self.data[:8].view("<u8"), shape=(len(data) + 1,), strides=(1,), writeable=False)
        self.start, self.size = start, end - start

    def chunk(self, which: np.ndarray, k: int) -> np.ndarray:
        """Bytes 8 k to 8 k + 8 of the spans ``which``, all longer than 8 k."""
        left = np.minimum(self.size[which] - 8 * k, 8)
        return self.eights[self.start[which] + 8 * k] & KEEP[left]

    def hashes(self) -> np.ndarray:
        out = self.size.astype(np.uint64) * ODD[0]
        some, k = np.flatnonzero(self.size > 0), 0
        while len(some):
            if len(some) < 64 and 8 * k >= LONG:
                for s in some.tolist():
                    rest = np.frombuffer(self._bytes(s)[8 * k :], np.uint8)
                    rest = np.r_[rest, np.zeros(-len(rest) % 8, np.uint8)].view("<u8")
                    out[s] ^= np.bitwise_xor.reduce(mix(rest + np.arange(1, len(rest) + 1, dtype=np.uint64) * ODD[2]))
                break
            out[some] = mix(out[some] ^ self.chunk(some, k)) * ODD[1]
            k += 1
            some = some[self.size[some] > 8 * k]
        return mix(out)

    def _bytes(self, k: int) -> bytes:
        return self.data[self.start[k] : self.start[k] + self.size[k]].tobytes()

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the spans a[i] and b[i] have the same bytes."""
        same = self.size[a] == self.size[b]
        left, k = np.flatnonzero(same & (self.size[a] > 0)), 0
        while len(left):
            if 8 * k >= LONG:
                same[left] = [self._bytes(i) == self._bytes(j) for i, j in zip(a[left].tolist(), b[left].tolist())]
                break
            hit = self.chunk(a[left], k) == self.chunk(b[left], k)
            same[left[~hit]] = False
            left, k = left[hit], k + 1
            left = left[self.size[a[left]] > 8 * k]
        return same


KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def _inserted(spans: Spans, which: np.ndarray, owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each of the spans ``which``, in order, the first of them with the same bytes and owner."""
    out = np.empty(len(which), dtype=np.int64)
    bits = max(4, int(2 * len(which) + 1).bit_length())
    table = np.full(1 << bits, -1, dtype=np.int64)
    slot = (hashes[which] >> U(64 - bits)).astype(np.int64)
    left = np.arange(len(which))
    while len(left):
        at = slot[left]
        free = left[table[at] < 0]
        table[slot[free[::-1]]] = free[::-1]  # the first of several stays
        held = table[at]
        mine, theirs = which[left], which[held]
        found = owner[theirs] == owner[mine]
        found[found] = spans.equal(mine[found], theirs[found])
        out[left[found]] = theirs[found]
        left = left[~found]
        slot[left] = (slot[left] + 1) & ((1 << bits) - 1)
    return out


def first_equal(spans: Spans, owner: np.ndarray, hashes: np.ndarray | None = None) -> np.ndarray:
    """For each span the first one with the same bytes and the same owner.

    Spans go into tables of ``TABLE`` at most, which stay in a core's cache, and the first ones
    of all tables into one. ``hashes`` may be given (tests give bad ones): they decide the speed, not the result.
    """
    if hashes is None:
        hashes = spans.hashes()
    hashes = mix(hashes + owner.astype(np.uint64) * ODD[2])
    every = np.arange(len(owner))
    out = [_inserted(spans, every[k : k + TABLE], owner, hashes) for k in range(0, len(owner), TABLE)]
    if len(out) < 2:
        return out[0] if out else every
    some, at = np.unique(np.concatenate(out), return_inverse=True)
    return _inserted(spans, some, owner, hashes)[at]
