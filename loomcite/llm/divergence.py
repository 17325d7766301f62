"""Divergence between the sources of a language, by one-hot level products.

A term's count in a group (language, source) is its level there. The joint table of two groups,
how many terms have level c in one and d in the other, says all that their distance needs: each
cell is priced once, times the terms in it. The joint tables of all groups are the cells of X'X,
where X has a row per term and an indicator column per (group, level). X is worked on in blocks
of terms: levels that several terms of a block share are columns of a 0/1 matrix whose product
with its transpose gives their cells at once, exactly, as counts stay far below 2 to the 53;
rows with a level that few terms have are multiplied entry by entry. Blocks add up.

Terms are found per slice of text with a verified table of spans (``transducer``), so equal names
are equal bytes; counts are summed by Spark. The result has a row per pair of sources, so the
number of sources of a language is bounded by what can be returned, and so is a block, which has
all sources of some terms.

Arithmetic is exact: prices are whole numbers by long division in 64 bits, for up to 9e15 words.

Rules for odd rows: null texts, languages and sources are empty strings; every row is a document,
also a repeated one; groups without a kept term are priced like others, and all pairs of a
language without kept terms have value 0; ties in value are ordered by the item's UTF-8 bytes;
an empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from .arrays import LOWER, slices, text_bytes
from .transducer import Spans, first_equal

LEAST_DOCUMENTS = 10
TOP = 10
SCALE = 1_000_000_000
#: Bytes of text whose counts are summed up before they leave the task.
SUMMED_BYTES = 8 << 20
#: (term, group) places of a block, and the terms that make a level a column of the 0/1 matrix.
PLACES, SHARED = 1 << 18, 32
LETTERS = np.array([b >= 0x80 or 65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])


def letter_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of the maximal runs of letters; a run ends with its text."""
    inside = LETTERS[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    edges = offsets[1:-1]
    before[edges[edges < len(data)]] = False
    after[edges[edges > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def _strings(spans: Spans, which: np.ndarray) -> pa.Array:
    size = spans.size[which]
    ends = np.cumsum(size)
    at = np.repeat(spans.start[which] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
    return pa.Array.from_buffers(pa.large_string(), len(which), [None, pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(spans.data[at])])


def _pairs(a: np.ndarray, b: np.ndarray, n_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs and how often each is there."""
    keys, n = np.unique(a * n_b + b, return_counts=True)
    return keys // n_b, keys % n_b, n


def slice_counts(groups: np.ndarray, column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct terms, group, term, count, documents) of texts whose groups are numbered."""
    data, offsets = text_bytes(column)
    start, end, doc = letter_spans(data, offsets)
    spans = Spans(LOWER[data], start, end)
    firsts, term = np.unique(first_equal(spans, np.zeros(len(start), np.int64)), return_inverse=True)
    n = max(len(firsts), 1)
    group, name, count = _pairs(groups[doc], term, n)
    in_doc, in_doc_name, _ = _pairs(doc, term, n)
    _, _, documents = _pairs(groups[in_doc], in_doc_name, n)
    return _strings(spans, firsts), group, name, count, documents


COUNTED = "lang string, source string, term string, n bigint, documents bigint"


def _count(batches):
    for part in slices(batches, "text", SUMMED_BYTES):
        named = pa.Table.from_arrays([part.column("lang"), part.column("source")], names=["lang", "source"])
        lang, source = (named.column(k).combine_chunks().dictionary_encode() for k in range(2))
        code = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
        known, groups = np.unique(code, return_inverse=True)
        terms, group, name, count, documents = slice_counts(groups, part.column("text"))
        own = known[group]
        yield pa.RecordBatch.from_arrays([
            lang.dictionary.take(pa.array(own // len(source.dictionary))), source.dictionary.take(pa.array(own % len(source.dictionary))),
            terms.take(pa.array(name)).cast(pa.string()), pa.array(count), pa.array(documents),
        ], names=["lang", "source", "term", "n", "documents"])


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """The counts (lang, source, term, n) of the kept terms, and the groups (lang, source), both written."""
    no = lambda c, name: F.coalesce(F.col(c), F.lit("")).alias(name)
    rows = docs.select(no(lang, "lang"), no(source, "source"), no(text, "text"))
    groups = durable(rows.select("lang", "source").distinct())
    counts = rows.mapInArrow(_count, COUNTED).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    all_of = Window.partitionBy(F.xxhash64("lang", "term"), "lang", "term")
    kept = counts.withColumn("all", F.sum("documents").over(all_of)).filter(F.col("all") >= least)
    return durable(kept.select("lang", "source", "term", "n")), groups


def prices(counts: np.ndarray, total: np.ndarray | int, terms: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)), three digits at a time."""
    below = np.asarray(total, dtype=np.int64) + 2 * terms
    value, rest = np.divmod(counts.astype(np.int64) + 2, below)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, below)
        value = value * 1000 + digit
    return value + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def level_products(matrix: np.ndarray, price: list[np.ndarray], levels: list[np.ndarray]) -> np.ndarray:
    """Sum of the distances of every two groups over the block's terms, from the cells of X'X.

    ``matrix`` holds the level of each term (row) in each group (column) as an index into
    ``levels``; ``price`` holds each level's price.
    """
    n_terms, n_groups = matrix.shape
    out = np.zeros((n_groups, n_groups), dtype=np.int64)
    shared, place = [], []  # columns of the 0/1 matrix
    rare = np.zeros((n_terms, n_groups), dtype=bool)
    for g in range(n_groups):
        held = np.bincount(matrix[:, g], minlength=len(levels[g]))
        often = np.flatnonzero(held >= SHARED)
        shared.append(often)
        rare[:, g] = held[matrix[:, g]] < SHARED
        place.append((matrix[:, g][:, None] == often[None, :]).astype(np.float32))
    ends = np.r_[0, np.cumsum([len(x) for x in shared])]
    x = np.concatenate(place, axis=1)
    priced = [price[g][matrix[:, g]] for g in range(n_groups)]
    for g in range(n_groups):
        cells = np.rint(x[:, ends[g] : ends[g + 1]].T @ x[:, ends[g] :]).astype(np.int64)
        for h in range(g + 1, n_groups):
            table = cells[:, ends[h] - ends[g] : ends[h + 1] - ends[g]]
            out[g, h] = (table * distance(price[g][shared[g]][:, None], price[h][shared[h]][None, :])).sum()
            entries = rare[:, g] | rare[:, h]
            out[g, h] += distance(priced[g][entries], priced[h][entries]).sum()
    return out + out.T


PRICED = "lang string, source string, part string, item string, value bigint"


def _price(top: int):
    def price_block(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        lang = key[0].as_py()
        sources = right.column("source").to_pylist()
        order = np.argsort(np.array([s.encode() for s in sources], dtype=object), kind="stable")
        sources = [sources[k] for k in order.tolist()]
        totals = right.column("total").to_numpy()[order]
        n_terms, n_all = int(right.column("terms")[0].as_py()), int(right.column("all")[0].as_py())
        rank = {s: k for k, s in enumerate(sources)}
        names, row = np.unique(np.array(left.column("term").to_pylist(), dtype=object), return_inverse=True) if left.num_rows else (np.zeros(0, object), np.zeros(0, np.int64))
        coded = left.column("source").combine_chunks().dictionary_encode()
        column = np.array([rank[s] for s in coded.dictionary.to_pylist()], dtype=np.int64)[coded.indices.to_numpy()] if left.num_rows else np.zeros(0, np.int64)
        counts = np.zeros((len(names), len(sources)), dtype=np.int64)
        counts[row, column] = left.column("n").to_numpy()
        found: list[tuple] = []
        if not len(names):  # the first block of a language without kept terms
            found = [(lang, a, "pair", b, 0) for a in sources for b in sources if a != b]
        else:
            levels, codes, price = [], np.empty(counts.shape, np.int64), []
            for g in range(len(sources)):
                values, codes[:, g] = np.unique(counts[:, g], return_inverse=True)
                levels.append(values)
                price.append(prices(values, totals[g], n_terms))
            sums = level_products(codes, price, levels)
            g, h = np.nonzero(~np.eye(len(sources), dtype=bool))
            found += [(lang, sources[a], "pair", sources[b], v) for a, b, v in zip(g.tolist(), h.tolist(), sums[g, h].tolist())]
            whole = prices(counts.sum(axis=1), n_all, n_terms)
            for k in range(len(sources)):
                p = price[k][codes[:, k]]
                some = np.flatnonzero((counts[:, k] > 0) & (p > whole))
                value = distance(p[some], whole[some])
                # names are in the order of code points, which is that of their UTF-8 bytes
                best = np.argsort(-value, kind="stable")[:top]
                found += [(lang, sources[k], "term", names[t], v) for t, v in zip(some[best].tolist(), value[best].tolist())]
        columns = list(zip(*found)) or [()] * 5
        kinds = [pa.string()] * 4 + [pa.int64()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "source", "part", "item", "value"])

    return price_block


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: see the module."""
    counts, groups = term_counts(docs, least=least)
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = counts.groupBy("lang").agg(F.count_distinct("term").alias("terms"), F.sum("n").alias("all"))
    width = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("groups"))
    blocks = F.greatest(F.ceil(F.coalesce("terms", F.lit(0)) * F.col("groups") / PLACES), F.lit(1)).cast("int")
    sizes = durable(width.join(sizes, "lang", "left").select("lang", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("all", F.lit(0)).alias("all"), blocks.alias("blocks")))
    known = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang")
    sides = known.select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", F.coalesce("total", F.lit(0)).alias("total"), "terms", "all")
    dealt = counts.join(sizes.select("lang", "blocks"), "lang").withColumn("block", F.pmod(F.xxhash64("term"), "blocks").cast("int")).select("lang", "block", "source", "term", "n")
    priced = durable(dealt.groupBy("lang", "block").cogroup(sides.groupBy("lang", "block")).applyInArrow(_price(top), PRICED))
    pairs = priced.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = priced.filter("part = 'term'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms)
