"""Catalogue names in texts: leftmost, then longest, none inside another.

A catalogue is a trie of words held as flat arrays: sorted (node, word) keys with the node that
each leads to. A batch of texts is walked at once: every word that starts a name opens a walk, all walks
take their next word together, and each keeps the last end it has seen. A text is scanned
once, in its own task, and never shuffled. A catalogue larger than one part is walked part by part, each
part having all names with the same first word, and the parts' names are put in order per text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_text
from ..session import durable

#: Bytes of names that one task holds, and of texts that it walks at once.
PART_BYTES, WALK_BYTES = 32 << 20, 2 << 20

FOUND = "start bigint, size bigint, name_key string"


class NameTrie:
    """The names of a part, and the walks through them."""

    def __init__(self, names: list[str]):
        split = [n.split(" ") for n in names]
        self.names = pa.array(names, pa.large_string())
        self.words = pa.array(sorted({w for s in split for w in s}), pa.large_string())
        number = {w: k for k, w in enumerate(self.words.to_pylist())}
        edges: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for k, s in enumerate(split):
            node = 0
            for w in s:
                node = edges.setdefault((node, number[w]), len(edges) + 1)
            ends[node] = k
        keys = np.array([a * len(number) + w for a, w in edges], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.array(list(edges.values()), dtype=np.int64)[order]
        self.name = np.full(len(edges) + 1, -1, dtype=np.int64)
        self.name[list(ends)] = list(ends.values())

    def step(self, node: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The node after each word, -1 where no name goes on."""
        key = node * len(self.words) + word
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((word >= 0) & (self.keys[at] == key), self.to[at], -1)

    def every(self, words: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, name) of all names, also those inside others; ``last`` is the end of each word's text."""
        ended = [(start, self.name[node]) for start, node, _ in self.ends(words, last)]
        return tuple(np.concatenate([np.zeros(0, dtype=np.int64), *of]) for of in zip(*ended)) if ended else (np.zeros(0, dtype=np.int64),) * 2

    def walk(self, words: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, size, name) of the longest name from each word on."""
        size, name = np.zeros(len(words), dtype=np.int64), np.full(len(words), -1, dtype=np.int64)
        for start, node, taken in self.ends(words, last):
            size[start], name[start] = taken, self.name[node]
        found = np.flatnonzero(name >= 0)
        return found, size[found], name[found]

    def ends(self, words: np.ndarray, last: np.ndarray):
        """(starts, nodes, size) of the names of each size, shorter ones first."""
        start, taken = np.flatnonzero(words >= 0), 0
        node = np.zeros(len(start), dtype=np.int64)
        while len(start):
            inside = start + taken < last[start]
            start, node = start[inside], node[inside]
            node = self.step(node, words[start + taken])
            start, node, taken = start[node >= 0], node[node >= 0], taken + 1
            ended = self.name[node] >= 0
            yield start[ended], node[ended], taken


def leftmost(start: list[int], size: list[int]) -> list[int]:
    """Of names in the order of their starts, those that begin after the last one taken ends."""
    out, free = [], 0
    for k, (s, n) in enumerate(zip(start, size)):
        if s >= free:
            out.append(k)
            free = s + n
    return out


def _pieces(batches, body: str = "said"):
    """Batches cut so that their texts have ``WALK_BYTES`` or are a single one, as a walk holds many times its texts."""
    for batch in batches:
        length = pc.fill_null(pc.binary_length(batch.column(body)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, first = np.cumsum(length), 0
        while first < len(length):
            before = ends[first] - length[first]
            after = max(first + 1, int(np.searchsorted(ends, before + WALK_BYTES, "right")))
            yield batch.slice(first, after - first)
            first = after


def _words(trie: NameTrie, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of all texts of a batch, number of words and end of each text."""
    lists = pc.split_pattern(pc.fill_null(batch.column("said").cast(pa.large_string()), ""), " ")
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    words = pc.fill_null(pc.index_in(lists.flatten(), trie.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    return words, counts, np.cumsum(counts)


def _scan(trie: NameTrie, key: str, whole: bool):
    """Names of a part in each text; of a whole catalogue those that are left after the ones before them."""

    def make(batches):
        for batch in _pieces(batches):
            words, counts, ends = _words(trie, batch)
            start, size, name = trie.walk(words, np.repeat(ends, counts))
            text = np.searchsorted(ends, start, "right")
            if whole:
                taken = np.array(leftmost(start.tolist(), size.tolist()), dtype=np.int64)
                start, size, name, text = start[taken], size[taken], name[taken], text[taken]
            yield pa.RecordBatch.from_arrays([
                batch.column(key).take(pa.array(text)), pa.array(start - (ends - counts)[text]), pa.array(size), trie.names.take(pa.array(name)).cast(pa.string()),
            ], names=[key, "start", "size", "name_key"])

    return make


def _scan_every(trie: NameTrie, key: str):
    """The distinct names of a part anywhere in each text, also inside other names."""

    def make(batches):
        for batch in _pieces(batches):
            words, counts, ends = _words(trie, batch)
            start, name = trie.every(words, np.repeat(ends, counts))
            pair = np.unique(np.searchsorted(ends, start, "right") * len(trie.names) + name)
            text, name = np.divmod(pair, len(trie.names))
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(text)), trie.names.take(pa.array(name)).cast(pa.string())], names=[key, "name_key"])

    return make


def _ordered(key: str):
    def put(table: pa.Table) -> pa.Table:
        table = table.sort_by([("start", "ascending"), ("size", "descending")])
        return table.take(pa.array(leftmost(table.column("start").to_pylist(), table.column("size").to_pylist()), pa.int64()))

    return put


def _parts(catalogue: DataFrame, part_bytes: int) -> tuple[DataFrame, int, Column]:
    """The distinct names, the number of parts, and the part of each name: all with one first word are together."""
    names = durable(catalogue.select("name_key").filter("name_key <> ''").distinct())
    total = names.agg(F.sum(F.octet_length("name_key"))).first()[0] or 0
    parts = max(1, -(-total // part_bytes))
    return names, parts, F.pmod(F.xxhash64(F.substring_index("name_key", " ", 1)), F.lit(parts))


def names_within(docs: DataFrame, key: str, body: str, catalogue: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """(key, name_key): every catalogue name of each text, also names inside others, once per text.

    No text is shuffled. A catalogue of several parts is walked part by part over the written texts.
    """
    names, parts, part = _parts(catalogue, part_bytes)
    rows = docs.select(key, canonical_text(body).alias("said"))
    rows = durable(rows) if parts > 1 else rows
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, name_key string"
    found = docs.sparkSession.createDataFrame([], schema)
    for k in range(parts):
        trie = NameTrie([r[0] for r in names.filter(part == k).toLocalIterator()])
        if len(trie.keys):
            one = rows.mapInArrow(_scan_every(trie, key), schema)
            found = one if parts == 1 else found.unionByName(durable(one))
    return found


def mentions(docs: DataFrame, key: str, body: str, catalogue: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """(key, start, size, name_key): the catalogue's names in each text, word positions from 0.

    Names and texts are compared as words of the canonical text. ``key`` names a text; texts
    of one key are scanned one by one.
    """
    names, parts, part = _parts(catalogue, part_bytes)
    rows = docs.select(key, canonical_text(body).alias("said"))
    rows = durable(rows) if parts > 1 else rows
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, {FOUND}"
    found = docs.sparkSession.createDataFrame([], schema)
    for k in range(parts):
        trie = NameTrie([r[0] for r in names.filter(part == k).toLocalIterator()])
        if len(trie.keys):
            # a text's names from different parts may overlap
            one = rows.mapInArrow(_scan(trie, key, parts == 1), schema)
            found = one if parts == 1 else found.unionByName(durable(one))
    return found if parts == 1 else found.groupBy(key).applyInArrow(_ordered(key), schema)
