"""Audit of how quality filters act together.

Five filters look at every document: A too few words, B too few distinct words, C too many
capitals, D a symbol, E a text that a smaller document id has too. A to D come from one pass of
the byte transducer (``transducer``), distinct words from its verified hash table, E from the
texts' SHA-256 over the whole table. A document is then five bits, and all that the audit needs
is the number of documents per part, bits and labels: a table of 32 x 4 cells per part at most.
What each filter removes in each of the 120 orders depends on the set of filters before it, so
80 (filter, set) pairs per part are summed and given to the orders that they stand for.

Rules for odd rows: a null text is empty; a null language is the empty part; a document without
id is no copy and no original of one; rows of one id and text are no copies of each other; of
repeated labels the larger counts; an empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .arrays import slices, text_bytes
from .transducer import Pass, Spans, first_equal

LEAST_WORDS = 200
LEAST_DISTINCT = 50
MOST_CAPITALS = 3
FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
#: Bytes of text to a pass.
PASS_BYTES = 1 << 19


def failures(words: np.ndarray, distinct: np.ndarray, capitals: np.ndarray, points: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Bits of the filters A to D that each text fails."""
    tests = (words < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * words, 100 * capitals > MOST_CAPITALS * points, symbols > 0)
    return sum(t.astype(np.int32) << k for k, t in enumerate(tests))


def statistics(column: pa.Array) -> tuple[np.ndarray, ...]:
    """words, distinct words, capitals, code points and symbols of every text."""
    data, offsets = text_bytes(column)
    one = Pass(data, offsets)
    first = first_equal(Spans(data, one.start, one.end), one.doc)
    distinct = np.bincount(one.doc[first == np.arange(len(first))], minlength=len(offsets) - 1)
    return one.words, distinct, one.capitals, one.points, one.symbols


def _judge(batches):
    for part in slices(batches, "text", PASS_BYTES):
        fails = pa.array(failures(*statistics(part.column("text"))).astype(np.int32))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("part"), part.column("digest"), fails], names=["doc_id", "part", "digest", "fails"])


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """doc_id, part, digest of the text, and the bits of the filters A to D that it fails, per document row."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.unhex(F.sha2(t.cast("binary"), 256)).alias("digest"), t.alias("text"))
    return rows.mapInArrow(_judge, "doc_id bigint, part string, digest binary, fails int")


def cells(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, good, toxic, n): how many documents fail which filters, E included.

    The rows of a text are summed up before they meet on the text's digest, so a text that a
    third of all rows share is one row per part and labels there.
    """
    rows = documents.groupBy("doc_id", "digest", "part", "fails").agg(F.count(F.lit(1)).alias("n"))
    flag = lambda c: F.coalesce(F.max(F.col(c).cast("int")) == 1, F.lit(False))
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("doc_id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic")).filter("good or toxic")
    known = rows.filter("doc_id is not null").join(marks, "doc_id", "left")
    nameless = rows.filter("doc_id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    no = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    both = known.unionByName(nameless).select("doc_id", "digest", "part", "fails", "n", no("good"), no("toxic"))
    alike = both.groupBy("digest", "part", "fails", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("best"),
    )
    least = alike.groupBy("digest").agg(F.min("best.doc_id").alias("least"))
    first = F.when(F.col("best.doc_id") == F.col("least"), F.col("best.n")).otherwise(0)
    alike = alike.join(least, "digest").withColumn("originals", F.col("nameless") + first)
    kinds = F.array(F.struct(F.col("fails"), F.col("originals").alias("n")), F.struct(F.col("fails").bitwiseOR(COPY).alias("fails"), (F.col("n") - F.col("originals")).alias("n")))
    split = alike.select("part", "good", "toxic", F.explode(kinds).alias("kind"))
    return split.groupBy("part", "kind.fails", "good", "toxic").agg(F.sum("kind.n").alias("n"))


def _before(order: str, step: int) -> int:
    return sum(1 << FILTERS.index(f) for f in order[: step - 1])


def audited(table: DataFrame) -> DataFrame:
    """The report from ``cells``: one row per part, order of the filters and step."""
    n = len(FILTERS)
    sets = [(f, before) for f in range(n) for before in range(1 << n) if not before >> f & 1]
    pairs = F.array(*[F.struct(F.lit(1 << f).alias("own"), F.lit(before).alias("before")) for f, before in sets])
    each = table.select("part", "fails", "good", "toxic", "n", F.explode(pairs).alias("pair")).select("part", "fails", "good", "toxic", "n", "pair.own", "pair.before")
    fails_own, fails_before = F.col("fails").bitwiseAND(F.col("own")) != 0, F.col("fails").bitwiseAND(F.col("before")) != 0
    count = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    removed = fails_own & ~fails_before
    sums = each.groupBy("part", "own", "before").agg(
        count(~fails_own & ~fails_before).alias("kept"), count(removed).alias("removed"), count(fails_own & fails_before).alias("redundant"),
        count(F.col("fails") == F.col("own")).alias("unique_fails"), count(removed & F.col("good")).alias("good_lost"), count(removed & F.col("toxic")).alias("toxic_lost"),
    )
    # the orders in which a filter comes right after the filters of a set
    times = F.element_at(F.array(*[F.lit(math.factorial(k) * math.factorial(n - 1 - k)) for k in range(n)]), (F.bit_count("before") + 1).cast("int"))
    shares = sums.groupBy("part", "own").agg(F.sum(F.col("removed") * times).cast("bigint").alias("shapley"))
    orders = ["".join(p) for p in itertools.permutations(FILTERS)]
    steps = [(o, k, 1 << FILTERS.index(o[k - 1]), _before(o, k)) for o in orders for k in range(1, n + 1)]
    steps = table.sparkSession.createDataFrame(steps, "filter_order string, step int, own int, before int")
    out = sums.join(F.broadcast(steps), ["own", "before"]).join(shares, ["part", "own"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audited(durable(cells(durable(judged(docs)), labels)))
