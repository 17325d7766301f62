"""Near-duplicate classes by improved consistent weighted sampling.

A document is the weighted set of its runs of five words: weight = times in the document x
inverse document frequency, 1 + log((1 + N) / (1 + df)) / log(1 + N), between 1 and 2, with
df counted over all documents. Improved consistent weighted sampling (Ioffe 2010) draws
``BANDS x ROWS`` samples of each set; two sets agree in a sample with the chance of their
weighted Jaccard similarity. Documents whose samples agree in a whole band are candidates,
and a candidate is a link if its weighted Jaccard similarity, computed from both sets, is at
least ``SIMILARITY``. Classes are the connected components of the links.

Equal sets are put together first and stand as one node, so groups of copies of any size
cost one node. Every node is compared with the greatest of its buckets' centres, the nodes that
share their buckets with most others. A node that this leaves outside the class of a bucket's centre
meets that centre, and all nodes of other classes in that bucket if the bucket is small. In a large
bucket the signature of every node that is still outside the centre's class is then held against those
of all nodes of other classes, tile by tile, and the pairs that agree in enough samples are computed. So
any two nodes of one bucket end in one class or have been compared; no bucket is dropped or cut.

Rules for odd rows: words are blank-separated and compared in lower case (A-Z); a document
of one to four words is one run; null, empty and blank texts have no run and are classes of
their own; repeated rows are copies; the class id is the least document id in the class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .arrays import ODD, U, Words, grams, mix, pack_sorted, planes, unpack_sorted, unplanes
from .blocks import answered, block_text, corpus_counts, fingerprint_bits, summed, text_blocks, top_bits, unused_name

RUN = 5
BANDS, ROWS = 12, 3
SIMILARITY = 0.8
#: 36 samples of two sets at the threshold agree in 28.8 on average, in fewer than this with a chance of 6e-5.
LEAST_AGREEING = 19
SMALL_BUCKET = 32
#: A large bucket is compared in tiles of about so many nodes, or in so many tiles.
TILE, TILES = 512, 64
CHUNK = 1 << 15
#: Slots, as a power of two, of the marks that say which rows are wanted: 2 MB of bits whatever the input.
MARK_BITS = 24


def _gamma_table(n: int = 1 << 16) -> np.ndarray:
    """Quantiles of the gamma distribution with shape 2, by inverting 1 - (1 + x) exp(-x)."""
    x = np.geomspace(1e-4, 40, 400_000)
    return np.interp((np.arange(n) + 0.5) / n, 1 - (1 + x) * np.exp(-x), x)


GAMMA = _gamma_table().astype(np.float32)
LOG_GAMMA = np.log(GAMMA)
BETA = ((np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.float32)


def word_runs(words: Words, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place of each text's runs, distinct run hashes in order per text, times)."""
    counts = words.counts
    each = np.where(counts >= run, counts - run + 1, np.minimum(counts, 1))
    first = np.r_[0, np.cumsum(each)]
    out = np.zeros(first[-1], dtype=np.uint64)
    full = grams(words.hash, run)
    if len(full):
        at = np.flatnonzero(words.doc[: len(full)] == words.doc[run - 1 :])
        doc = words.doc[at]
        out[first[doc] + at - words.first[doc]] = full[at]
    for n in range(1, run):
        short = np.flatnonzero(counts == n)
        if len(short):
            out[first[short]] = grams(words.hash, n)[words.first[short]]
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        out[a:b].sort()
    fresh = np.r_[True, out[1:] != out[:-1]] if len(out) else np.zeros(0, bool)
    fresh[first[:-1][each > 0]] = True
    at = np.flatnonzero(fresh)
    return np.searchsorted(at, first), out[at], np.diff(np.r_[at, len(out)])


def samples(first: np.ndarray, runs: np.ndarray, weight: np.ndarray, draws: int) -> np.ndarray:
    """One row of ``draws`` samples per text: 32 bits that stand for the sampled run and its level."""
    n = len(first) - 1
    out = np.zeros((n, draws), dtype=np.uint32)
    some = np.flatnonzero(np.diff(first))
    log_weight = np.log(weight).astype(np.float32)
    seeds = mix(np.arange(1, draws + 1, dtype=np.uint64) * ODD[2])
    k = 0
    while k < len(some):
        stop = max(k + 1, int(np.searchsorted(first[some], first[some[k]] + CHUNK, "right")) - 1)
        docs = some[k:stop]
        a, b = first[docs[0]], first[docs[-1] + 1]
        u, w, starts = runs[a:b], log_weight[a:b], first[docs] - a
        for d in range(draws):
            x = mix(u ^ seeds[d])
            r = GAMMA[(x & U(0xFFFF)).astype(np.int64)]
            beta = BETA[(x >> U(16) & U(0xFFFF)).astype(np.int64)]
            level = np.floor(w / r + beta)
            log_a = LOG_GAMMA[(x >> U(32) & U(0xFFFF)).astype(np.int64)] - r * (level - beta + 1)
            code = log_a.view(np.int32)
            code = (code ^ ((code >> 31) & 0x7FFFFFFF)).astype(np.int64) + (1 << 31)
            name = (x >> U(20)) + level.astype(np.int64).view(np.uint64) * ODD[1]
            key = code.view(np.uint64) << U(32) | (name & U(0xFFFFFFFF))
            out[docs, d] = np.minimum.reduceat(key, starts).astype(np.uint32)
        k = stop
    return out


def _per_text(first: np.ndarray, pack) -> list[bytes]:
    return [pack(a, b) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


SIGNED = "uid bigint, doc_id bigint, key bigint, node bigint, bands array<bigint>, signature array<int>, runs binary, weights binary"


def signed(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, run: int = RUN) -> DataFrame:
    """A written row per document row: uid, doc_id, key, node (hash of the weighted set; null without runs), bands, signature, runs, weights."""
    blocks = text_blocks(docs)
    n_docs = blocks.agg(F.sum(F.size("ids"))).first()[0] or 0
    bits = fingerprint_bits(blocks)
    scale = np.log1p(max(n_docs, 1))

    def asked(row):
        _, runs, _ = word_runs(Words(*block_text(row["sizes"], row["body"])), run)
        return summed(top_bits(runs, bits))

    def sign(row, counts, _):
        first, runs, times = word_runs(Words(*block_text(row["sizes"], row["body"])), run)
        short = top_bits(runs, bits)
        known = np.unique(short)
        df = counts[np.searchsorted(known, short)] if len(short) else counts
        weight = (times * (1 + np.log((1 + n_docs) / (1 + df)) / scale)).astype(np.float32)
        drawn = samples(first, runs, weight, bands * rows)
        n, size = len(first) - 1, np.diff(first)
        some = size > 0
        node = np.zeros(n, dtype=np.uint64)
        if len(runs):
            node[some] = np.add.reduceat(mix(runs ^ (times.astype(np.uint64) * ODD[2])), first[:-1][some])
        node = mix(node + size.astype(np.uint64))
        band = np.zeros((n, bands), dtype=np.uint64)
        for k in range(rows):
            band = mix((band ^ drawn[:, k::rows]) * ODD[0])
        band = mix(band + np.arange(bands, dtype=np.uint64) * ODD[1])
        # in a candidate pair runs are told apart by 32 bits
        slim = (runs >> U(32)).astype(np.uint32)
        lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel().view(kind)))
        return pa.table({
            "uid": pa.array((row["block"] << 16) + np.arange(n)), "doc_id": pa.array(row["ids"], pa.int64()), "key": pa.array(row["keys"], pa.int64()),
            "node": pa.array(node.view(np.int64), mask=~some), "bands": lists(band, np.int64), "signature": lists(drawn, np.int32),
            "runs": pa.array(_per_text(first, lambda a, b: pack_sorted(slim[a:b])), pa.binary()),
            "weights": pa.array(_per_text(first, lambda a, b: planes(weight[a:b])), pa.binary()),
        })

    answers = corpus_counts(blocks, ["sizes", "body"], asked, bits)
    return durable(answered(blocks.drop("flags", "words"), answers, sign, SIGNED))


def weighted_jaccard(runs_a, weights_a, runs_b, weights_b) -> float:
    """Sum of minima by sum of maxima, for sorted runs (a run that is there twice counts with both weights)."""
    runs, at = np.unique(np.concatenate([runs_a, runs_b]), return_inverse=True)
    a = np.bincount(at[: len(runs_a)], weights_a, len(runs))
    b = np.bincount(at[len(runs_a) :], weights_b, len(runs))
    return float(np.minimum(a, b).sum() / np.maximum(a, b).sum())


def _verify(similarity: float):
    def make(batches):
        for batch in batches:
            rows = batch.to_pylist()
            last, mine, keep = None, None, []
            for r in rows:
                if r["a"] != last:
                    last, mine = r["a"], (unpack_sorted(r["runs_a"], np.uint32), unplanes(r["weights_a"], np.float32))
                other = unpack_sorted(r["runs_b"], np.uint32), unplanes(r["weights_b"], np.float32)
                keep.append(weighted_jaccard(*mine, *other) >= similarity - 1e-6)
            kept = pa.array(np.flatnonzero(np.array(keep, bool)))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(kept) for c in ("a", "b")], names=["a", "b"])

    return make


def picked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose ``uid`` is among ``ids``, and a few others whose hash meets theirs.

    At most 2 ** (MARK_BITS - 6) words of marks are sent to the rows, which stay where they are; callers join by ``uid`` later.
    """
    slot = f"pmod(xxhash64(uid), {1 << MARK_BITS}L)"
    word, bit = F.expr(f"shiftright({slot}, 6)").alias("word"), F.expr(f"shiftleft(1L, cast({slot} & 63 AS int))")
    marks = ids.select(word, bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("marks"))
    return rows.select("*", word).join(F.broadcast(marks), "word").filter(F.col("marks").bitwiseAND(bit) != 0).select(*rows.columns)


def links(pairs: DataFrame, signs: DataFrame, similarity: float = SIMILARITY, least: int = LEAST_AGREEING) -> DataFrame:
    """The pairs (a, b) of uids that are similar enough, written."""
    side = lambda s: signs.select(F.col("uid").alias(s), F.col("signature").alias(f"signature_{s}"))
    agreeing = F.aggregate(F.zip_with("signature_a", "signature_b", lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
    likely = durable(pairs.join(side("a"), "a").join(side("b"), "b").filter(agreeing >= least).select("a", "b"))
    wanted = picked(signs, likely.select(F.col("a").alias("uid")).unionByName(likely.select(F.col("b").alias("uid"))))
    full = lambda s: wanted.select(F.col("uid").alias(s), F.col("runs").alias(f"runs_{s}"), F.col("weights").alias(f"weights_{s}"))
    return durable(likely.join(full("b"), "b").join(full("a"), "a").mapInArrow(_verify(similarity), "a bigint, b bigint"))


def components(edges: DataFrame) -> DataFrame:
    """(uid, top): for each end of an edge the least uid that it is connected with; labels spread and jump until none changes."""
    both = durable(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = durable(both.groupBy("a").agg(F.least("a", F.min("b")).alias("top")).select(F.col("a").alias("uid"), "top"))
    while True:
        near = both.join(labels.select(F.col("uid").alias("b"), "top"), "b").groupBy(F.col("a").alias("uid")).agg(F.min("top").alias("near"))
        step = labels.join(near, "uid").select("uid", F.col("top").alias("was"), F.least("top", "near").alias("to"))
        jump = labels.select(F.col("uid").alias("to"), F.col("top").alias("far"))
        after = durable(step.join(jump, "to").select("uid", "was", F.least("to", "far").alias("top")))
        labels = after.select("uid", "top")
        if not after.filter("was <> top").limit(1).count():
            return labels


def _seated(bands: DataFrame) -> DataFrame:
    """(bucket, band, uid, size, centre, rank) for the nodes of every bucket with two or more, written.

    The centre is the node that shares its buckets with most others (``rank`` says with how
    many), so in a group of variants of one text it is the variant that is nearest to all.
    """
    members = durable(bands.select("uid", F.posexplode("bands").alias("band", "bucket")))
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    seats = durable(members.join(sizes, "bucket"))
    company = seats.groupBy("uid").agg(F.sum("size").alias("company"))
    best = F.max(F.struct("company", (-F.col("uid")).alias("uid")))
    centres = seats.join(company, "uid").groupBy("bucket").agg(best.alias("best"))
    return durable(seats.join(centres.select("bucket", (-F.col("best.uid")).alias("centre"), F.col("best.company").alias("rank")), "bucket"))


def _pair(one: str, other: str) -> list[Column]:
    return [F.least(one, other).alias("a"), F.greatest(one, other).alias("b")]


def _unsettled(seated: DataFrame, classes: DataFrame) -> DataFrame:
    """(bucket, uid, top, size, centre) of the nodes that aren't in the class of their bucket's centre, written."""
    known = seated.join(classes, "uid", "left").select("bucket", "uid", "size", "centre", F.coalesce("top", "uid").alias("top"))
    theirs = classes.select(F.col("uid").alias("centre"), F.col("top").alias("top_centre"))
    known = known.join(theirs, "centre", "left").filter(F.col("top") != F.coalesce("top_centre", "centre"))
    return durable(known.select("bucket", "uid", "top", "size", "centre"))


def _meetings(seated: DataFrame, classes: DataFrame, open_nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of different classes: every unsettled node with its bucket's centre, and with all of its bucket if that is small."""
    few = open_nodes.filter(F.col("size") <= SMALL_BUCKET).select("bucket", "uid", "top")
    others = seated.select("bucket", F.col("uid").alias("other")).join(few, "bucket")
    others = others.join(classes.select(F.col("uid").alias("other"), F.col("top").alias("top_other")), "other", "left")
    met = others.filter(F.col("top") != F.coalesce("top_other", "other")).select(*_pair("uid", "other"))
    return met.unionByName(open_nodes.select(*_pair("uid", "centre"))).distinct()


def _links_in(similarity: float, least: int):
    """Links (a, b) between nodes of different classes in a group of tiles: open nodes with all, two open ones once.

    A pair is computed in the first of its buckets only, the likeliest first, and not at all once
    links of the group have brought both into one class.
    """

    def compare(table: pa.Table) -> pa.Table:
        column = lambda name: table.column(name).to_numpy()
        uid, is_open, asks, band = column("uid"), column("is_open"), column("asks"), column("band")
        _, top = np.unique(column("top"), return_inverse=True)
        drawn = np.array(table.column("signature").to_pylist(), dtype=np.int32).reshape(len(uid), -1)
        runs, weights = table.column("runs"), table.column("weights")
        unpacked, over, out = {}, list(range(len(uid))), []

        def content(k):
            if k not in unpacked:
                unpacked[k] = unpack_sorted(runs[k].as_py(), np.uint32), unplanes(weights[k].as_py(), np.float32)
            return unpacked[k]

        def find(k):
            while over[k] != k:
                over[k] = k = over[over[k]]
            return k

        mine, theirs = np.flatnonzero(asks), np.flatnonzero(~asks)
        other = np.ascontiguousarray(drawn[theirs].T)
        for k in range(0, len(mine), TILE):
            part = mine[k : k + TILE]
            same = np.zeros((len(part), len(theirs)), dtype=np.uint16)
            for d in range(drawn.shape[1]):
                same += drawn[part, d][:, None] == other[d][None, :]
            i, j = np.nonzero((same >= least) & (top[part][:, None] != top[theirs][None, :]))
            agree, i, j = same[i, j], part[i], theirs[j]
            # pairs that share an earlier band have been compared there
            keep = ~is_open[j] | (uid[i] < uid[j])
            for d in range(int(band[0])):
                keep &= (drawn[i, d * ROWS : (d + 1) * ROWS] != drawn[j, d * ROWS : (d + 1) * ROWS]).any(axis=1)
            order = np.flatnonzero(keep)
            order = order[np.argsort(-agree[order].astype(np.int32), kind="stable")]
            for x, y in zip(i[order].tolist(), j[order].tolist()):
                one, two = find(int(top[x])), find(int(top[y]))
                if one != two and weighted_jaccard(*content(x), *content(y)) >= similarity - 1e-6:
                    over[one] = two
                    out.append((min(uid[x], uid[y]), max(uid[x], uid[y])))
        ends = np.array(out, dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(ends[:, 0]), "b": pa.array(ends[:, 1])})

    return compare


def _remaining(seated: DataFrame, classes: DataFrame, signs: DataFrame, similarity: float, least: int = LEAST_AGREEING) -> DataFrame:
    """Links (a, b) that bring the nodes of large buckets into their classes, written.

    Every unsettled node is held against every node of its bucket, tile by tile, so that a task
    has a bounded share of a bucket and a node is sent at most ``TILES`` times for each role;
    pairs that are no link never become rows.
    """
    large = seated.filter(F.col("size") > SMALL_BUCKET)
    open_nodes = _unsettled(large, classes).select("bucket", "uid", F.lit(True).alias("is_open"))
    n_open = open_nodes.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_open"))
    seats = large.select("bucket", "band", "uid", "size").join(n_open, "bucket").join(open_nodes, ["bucket", "uid"], "left").join(classes, "uid", "left")
    seats = durable(seats.select("bucket", "band", "uid", "size", "n_open", F.coalesce("top", "uid").alias("top"), F.coalesce("is_open", F.lit(False)).alias("is_open")))
    seats = seats.join(picked(signs.select("uid", "signature", "runs", "weights"), seats.select("uid")), "uid")
    tiles = lambda n: F.least(F.ceil(F.col(n) / TILE), F.lit(TILES)).cast("int")
    place = lambda n: F.pmod(F.xxhash64("uid", "bucket"), tiles(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), tiles(n) - 1)
    body = ["bucket", "band", "uid", "top", "is_open", "signature", "runs", "weights"]
    asking = seats.filter("is_open").select(*body, F.lit(True).alias("asks"), place("n_open").alias("i"), F.explode(every("size")).alias("j"))
    asked = seats.select(*body, F.lit(False).alias("asks"), place("size").alias("j"), F.explode(every("n_open")).alias("i"))
    return durable(asking.unionByName(asked).groupBy("bucket", "i", "j").applyInArrow(_links_in(similarity, least), "a bigint, b bigint").distinct())


def linked(signs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (uid, node), links (a, b) between them, and classes (uid, top) of the linked ones."""
    nodes = durable(signs.filter("node is not null").groupBy("node").agg(F.min("uid").alias("uid")))
    seated = _seated(signs.join(nodes.select("uid"), "uid", "left_semi").select("uid", "bands"))
    # only nodes that share a bucket are ever compared
    signs = durable(picked(signs.select("uid", "signature", "runs", "weights"), seated.select("uid")))
    main = seated.groupBy("uid").agg(F.max(F.struct("rank", (-F.col("centre")).alias("centre"))).alias("best")).select("uid", (-F.col("best.centre")).alias("centre"))
    tried = durable(main.filter("uid <> centre").select(*_pair("uid", "centre")).distinct())
    found = links(tried, signs, similarity)
    classes = components(found)
    fresh = durable(_meetings(seated, classes, _unsettled(seated, classes)).join(tried, ["a", "b"], "left_anti"))
    found = durable(found.unionByName(links(fresh, signs, similarity)))
    found = durable(found.unionByName(_remaining(seated, components(found), signs, similarity)))
    return nodes, found, components(found)


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document row: doc_id, key, class_id, class_size, n_links (those found on the way to the classes, not all), kept (one of each class)."""
    signs = signed(docs)
    nodes, found, classes = linked(signs, similarity)
    ends = found.select(F.col("a").alias("uid")).unionByName(found.select(F.col("b").alias("uid"))).groupBy("uid").agg(F.count(F.lit(1)).alias("n_links"))
    named = nodes.join(classes, "uid", "left").join(ends, "uid", "left").select("node", F.coalesce("top", "uid").alias("top"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))
    slim = signs.select("uid", "doc_id", "key", "node")
    best = F.min(F.struct("doc_id", "uid"))
    own = slim.filter("node is not null").groupBy("node").agg(best.alias("best"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    own = durable(own.join(named, "node"))
    tops = own.groupBy("top").agg(F.min("best").alias("best"), F.min("least").alias("class_id"), F.sum("n").alias("class_size"))
    about = own.select("node", "top", "n_links").join(tops, "top").select("node", "n_links", "class_id", "class_size", F.col("best.uid").alias("kept_uid"))
    return slim.join(about, "node", "left").select(
        "doc_id", "key", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1).cast("bigint")).alias("class_size"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
        (F.col("node").isNull() | (F.col("uid") == F.col("kept_uid"))).alias("kept"),
    )


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, unchanged, with one document of each class; of a row that is repeated whole one stays."""
    name = unused_name(docs.columns, "key")
    kept = near_duplicates(docs, similarity).filter("kept").select(F.col("key").alias(name)).distinct()
    rows = docs.withColumn(name, F.xxhash64("doc_id", "text")).join(kept, name, "left_semi")
    return rows.dropDuplicates([name]).select(*docs.columns)
