"""Exact set-similarity join of documents by parity sketches.

A document is the set of its runs of three words. Each run flips one bit of the document's
sketch; the sketches of two sets differ in at most as many bits as the sets differ in runs. Two
sets of a and b runs link when 100 |A & B| >= 90 |A | B|, that is, when they differ in at most
(a + b) / 19 runs. Sizes are cut into bands so that linked sets lie in the same or in neighbouring
bands; for each such class of sizes the sketch is cut into one chunk more than linked sets of the class can
differ in, so two linked sets have an equal chunk (pigeonhole). Sets with an equal chunk share a
bucket and are verified by their runs. Nothing but equal chunks brings two sets together, and no
bucket is dropped or cut.

Equal sets are one node. The nodes of a bucket meet in pairs if it has at most ``PAIRED``; a pair whose
compact sketches differ in more bits than linked sets can is dropped where it is met. Up to ``HELD`` nodes are compared
whole in the task that has their bucket, and only links that join two classes leave it. The nodes of a still larger bucket are
compared through a base set V, the runs that most of some of its nodes have: with D(i) the runs
in which i and V differ and slack s(i) = |A(i)| - 19 |D(i)|, i and j link if and only if s(i) +
s(j) + 38 |D(i) & D(j)| >= 0. So a node without a run of D in common with another can link with
it only if it links with the node of the greatest slack, which all meet; all others share a run
of D. D(i) falls into runs that only i has and runs that only V has. With e(i) the most in which i
differs from a linked set, nodes share one of the first e(i) + 1 runs of a part that has more than that,
so these, or all of a smaller part, make the next buckets. As no run of D is in most of the nodes, buckets
shrink until pairs are left.

Rules for odd rows: words are blank-separated and compared in lower case (A-Z); one or two words
are one run; null, empty and blank texts have none and link with nothing, not even each other;
repeated rows are copies; a null id is never the least of its component, and a component without any id has
a null one; an empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from .arrays import ODD, U, Words, mix, pack_sorted, unpack_sorted
from .blocks import block_text, rows_of, text_blocks
from .neardup import components, word_runs

RUN = 3
#: Links need LEAST[0] / LEAST[1] of the union in common.
LEAST = (9, 10)
NEAR, FAR = LEAST[1] - LEAST[0], LEAST[1] + LEAST[0]
PAIRED = 64
#: A larger bucket is compared in one task, by sketches and then runs, up to so many nodes with so many runs in all.
HELD, HELD_RUNS = 1024, 1 << 22
#: A set's compact sketch has at least so many bits for each 32 of its runs, and twice as many at most.
SKETCH_BITS = 64
#: Ids that are broadcast to pick rows; of more, both sides are shuffled.
BROADCAST_IDS = 1 << 20
#: Nodes whose majority is the base set of a bucket; any set is right, a good one makes buckets smaller.
ASKED = 65


def size_bands(most: int) -> np.ndarray:
    """First size of each band; a linked set of a larger size is in the same band or in the next."""
    starts = [1]
    while starts[-1] <= most:
        starts.append(LEAST[1] * starts[-1] // LEAST[0] + 1)
    return np.array(starts, dtype=np.int64)


def largest_partner(size):
    return LEAST[1] * size // LEAST[0]


def most_different(size):
    """The most runs in which a set of at most this size and a linked one that is no smaller differ."""
    return NEAR * (size + largest_partner(size)) // FAR


def sketch_chunks(first: np.ndarray, runs: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    """The 64-bit chunks of each text's parity sketch, ``chunks`` of them per text; runs are sorted within a text."""
    base = np.cumsum(chunks) - chunks
    doc = np.repeat(np.arange(len(chunks)), np.diff(first))
    some = chunks[doc] > 0
    doc, runs = doc[some], runs[some]
    place = base[doc] + ((runs >> U(32)) * chunks[doc].astype(np.uint64) >> U(32)).astype(np.int64)
    out = np.zeros(int(chunks.sum()), dtype=np.uint64)
    if len(place):
        at = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        out[place[at]] = np.bitwise_xor.reduceat(U(1) << (runs & U(63)), at)
    return out


def bucket_keys(first: np.ndarray, runs: np.ndarray) -> list[pa.Array]:
    """Lists of bucket names per text: chunks of its own class of sizes, and of the class below."""
    size = np.diff(first)
    starts = size_bands(int(size.max(initial=1)))
    band = np.searchsorted(starts, size, "right") - 1
    out = []
    for k in (band, band - 1):
        # sets of a class differ most when the smaller one is the largest of the class's lower band
        chunks = np.where((size > 0) & (k >= 0), most_different(starts[np.clip(k + 1, 1, None)] - 1), 0)
        chunks = np.where(chunks > 0, chunks + 1, 0)  # sets that may not differ at all are one node
        value = sketch_chunks(first, runs, chunks)
        each = np.repeat(np.arange(len(chunks)), chunks)
        number = np.arange(len(each)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        name = mix(mix(k[each].astype(np.uint64) * ODD[0] + number.astype(np.uint64) * ODD[2]) ^ value)
        out.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(chunks)].astype(np.int32)), pa.array(name.view(np.int64))))
    return out


def compact_sketches(first: np.ndarray, runs: np.ndarray) -> list[bytes]:
    """The parity sketch of each text in a power of two of 64-bit words, so that a longer one folds onto a shorter."""
    size = np.diff(first)
    words = 1 << np.ceil(np.log2(np.maximum(size / 32, 1))).astype(np.int64)
    base = np.r_[0, np.cumsum(words)]
    doc = np.repeat(np.arange(len(size)), size)
    bit = (runs >> U(8)) & (words[doc] * SKETCH_BITS - 1).astype(np.uint64)
    flat = np.zeros(base[-1], dtype="<u8")
    np.bitwise_xor.at(flat, base[doc] + (bit >> U(6)).astype(np.int64), U(1) << (bit & U(63)))
    return [flat[a:b].tobytes() for a, b in zip(base[:-1].tolist(), base[1:].tolist())]


def differing_bits(sketches: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The bits in which the sketches i and j differ, the longer one folded; no more than the runs in which the sets differ."""
    words = np.array([len(x) // 8 for x in sketches], dtype=np.int64)
    rows = {w: np.flatnonzero(words == w) for w in np.unique(words).tolist()}
    held = {w: np.frombuffer(b"".join([sketches[k] for k in at.tolist()]), "<u8").reshape(-1, w) for w, at in rows.items()}
    out, common = np.zeros(len(i), dtype=np.int64), np.minimum(words[i], words[j])
    for w in np.unique(common).tolist():
        place, parts = np.zeros(len(words), dtype=np.int64), []
        for longer, at in rows.items():
            if longer >= w:
                place[at] = sum(map(len, parts)) + np.arange(len(at))
                parts.append(np.bitwise_xor.reduce(held[longer].reshape(len(at), longer // w, w), axis=1))
        folded = np.concatenate(parts)
        which = np.flatnonzero(common == w)
        step = max(1, (1 << 20) // w)
        for k in range(0, len(which), step):
            some = which[k : k + step]
            out[some] = np.bitwise_count(folded[place[i[some]]] ^ folded[place[j[some]]]).sum(axis=1, dtype=np.int64)
    return out


def may_link(size: np.ndarray, sketches: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs have sizes and sketches of linked sets."""
    out = LEAST[0] * np.maximum(size[i], size[j]) <= LEAST[1] * np.minimum(size[i], size[j])
    some = np.flatnonzero(out)
    out[some] = FAR * differing_bits(sketches, i[some], j[some]) <= NEAR * (size[i[some]] + size[j[some]])
    return out


def _runs(row) -> tuple[np.ndarray, np.ndarray]:
    first, runs, _ = word_runs(Words(*block_text(row["sizes"], row["body"])), RUN)
    return first, runs


def _sign(batches):
    for batch in batches:
        for row in rows_of(batch):
            first, runs = _runs(row)
            size = np.diff(first)
            some = size > 0
            names = []
            for seed in (1, 2):
                name = np.zeros(len(size), dtype=np.uint64)
                if len(runs):
                    name[some] = np.add.reduceat(mix(runs * ODD[seed]), first[:-1][some])
                names.append(pa.array(mix(name + size.astype(np.uint64)).view(np.int64), mask=~some))
            yield pa.RecordBatch.from_arrays(
                [pa.array((row["block"] << 16) + np.arange(len(size))), pa.array(row["ids"], pa.int64()), pa.array(size), *names, pa.array(compact_sketches(first, runs), pa.binary()), *bucket_keys(first, runs)],
                names=["uid", "doc_id", "n", "one", "two", "sketch", "keys", "below"],
            )


SIGNED = "uid bigint, doc_id bigint, n bigint, one bigint, two bigint, sketch binary, keys array<bigint>, below array<bigint>"


def _sets(left: pa.Table, right: pa.Table) -> pa.Table:
    """uid and runs (48 bits of each) of a block's wanted texts."""
    wanted = right.column("uid").to_numpy()
    uids, parts = [], []
    for row in left.to_pylist() if len(wanted) else []:
        first, runs = _runs(row)
        for uid in np.sort(wanted).tolist():
            k = uid - (row["block"] << 16)
            uids.append(uid)
            parts.append(pack_sorted(runs[first[k] : first[k + 1]] >> U(16)))
    return pa.table({"uid": pa.array(uids, pa.int64()), "runs": pa.array(parts, pa.binary())})


def linked_sets(a: np.ndarray, b: np.ndarray) -> bool:
    both = np.sort(np.concatenate([a, b]), kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return LEAST[1] * common >= LEAST[0] * (len(both) - common)


def _verify(batches):
    for batch in batches:
        last, mine, keep = None, None, []
        for a, one, two in zip(batch.column("a").to_pylist(), batch.column("runs_a"), batch.column("runs_b")):
            if a != last:
                last, mine = a, unpack_sorted(one.as_py())
            keep.append(linked_sets(mine, unpack_sorted(two.as_py())))
        kept = pa.array(np.flatnonzero(np.array(keep, bool)))
        yield pa.RecordBatch.from_arrays([batch.column(c).take(kept) for c in ("a", "b")], names=["a", "b"])


def _likely(batches):
    for batch in batches:
        n = batch.num_rows
        size = np.concatenate([batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()])
        kept = may_link(size, batch.column("sketch_a").to_pylist() + batch.column("sketch_b").to_pylist(), np.arange(n), n + np.arange(n))
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(kept)) for c in ("a", "b")], names=["a", "b"])


def _chosen(rows: DataFrame, uids: DataFrame) -> DataFrame:
    """The rows of the given uids; few of them are sent to where the rows are."""
    uids = durable(uids.distinct())
    return rows.join(F.broadcast(uids) if uids.count() <= BROADCAST_IDS else uids, "uid", "left_semi")


def links(pairs: DataFrame, sketches: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of uids whose sets link, written. Pairs go by their sketches first; only the runs of those that are left travel."""
    side = lambda s: sketches.select(F.col("uid").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}"))
    return verified(durable(pairs.join(side("b"), "b").join(side("a"), "a").mapInArrow(_likely, "a bigint, b bigint")), sets)


def verified(likely: DataFrame, sets: DataFrame) -> DataFrame:
    sets = durable(_chosen(sets, likely.select(F.col("a").alias("uid")).unionByName(likely.select(F.col("b").alias("uid")))))
    side = lambda s: sets.select(F.col("uid").alias(s), F.col("runs").alias(f"runs_{s}"))
    return durable(likely.join(side("b"), "b").join(side("a"), "a").mapInArrow(_verify, "a bigint, b bigint"))


def _majority(key: tuple, table: pa.Table) -> pa.Table:
    parts = [unpack_sorted(x.as_py()) for x in table.column("runs")]
    runs, n = np.unique(np.concatenate(parts), return_counts=True)
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "base": pa.array([pack_sorted(runs[2 * n > len(parts)])], pa.binary())})


def shared_runs(own: np.ndarray, base: np.ndarray) -> tuple[int, np.ndarray]:
    """(slack, the runs by which a node meets others of its bucket)."""
    only_own, only_base = np.setdiff1d(own, base, assume_unique=True), np.setdiff1d(base, own, assume_unique=True)
    slack = NEAR * len(own) - FAR * (len(only_own) + len(only_base))
    most = most_different(len(own))
    if len(only_own) > most:
        return slack, only_own[: most + 1]
    return slack, np.concatenate([only_own, only_base[: most + 1]])


def _against_base(batches):
    for batch in batches:
        last, base, slacks, names, ends = None, None, [], [], [0]
        for bucket, base_runs, runs in zip(batch.column("bucket").to_pylist(), batch.column("base"), batch.column("runs")):
            if bucket != last:
                last, base = bucket, unpack_sorted(base_runs.as_py())
            slack, some = shared_runs(unpack_sorted(runs.as_py()), base)
            slacks.append(slack)
            names.append(mix((some + ODD[0]) ^ mix(np.array([bucket], np.int64).view(np.uint64))))
            ends.append(ends[-1] + len(some))
        flat = np.concatenate(names).view(np.int64) if names else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
        yield pa.RecordBatch.from_arrays([batch.column("bucket"), batch.column("uid"), pa.array(slacks, pa.int64()), lists], names=["bucket", "uid", "slack", "keys"])


def seated(members: DataFrame) -> DataFrame:
    """(bucket, uid, size, centre) of the nodes that share a bucket, written; the centre is the bucket's first node."""
    all_of = Window.partitionBy("bucket")
    rows = members.withColumns({"size": F.count(F.lit(1)).over(all_of), "centre": F.min("uid").over(all_of)})
    return durable(rows.filter("size > 1"))


def _open(seats: DataFrame, classes: DataFrame) -> DataFrame:
    """(bucket, uid, size, centre, top) of the buckets whose nodes are in several classes, written."""
    known = seats.join(classes, "uid", "left").withColumn("top", F.coalesce("top", "uid"))
    all_of = Window.partitionBy("bucket")
    rows = known.withColumns({"low": F.min("top").over(all_of), "high": F.max("top").over(all_of)})
    return durable(rows.filter("low < high").select("bucket", "uid", "size", "centre", "top"))


def _pairs_of(rows: pa.Table) -> pa.RecordBatch:
    """Pairs of whole buckets, in order, that are in different classes and may link."""
    column = lambda c: rows.column(c).to_numpy()
    bucket, uid, top, size, sketches = column("bucket"), column("uid"), column("top"), column("n"), rows.column("sketch").to_pylist()
    a, b = [], []
    for apart in range(1, len(uid)):
        i = np.flatnonzero(bucket[:-apart] == bucket[apart:])
        if not len(i):
            break
        i = i[top[i] != top[i + apart]]
        i = i[may_link(size, sketches, i, i + apart)]
        a.append(uid[i])
        b.append(uid[i + apart])
    flat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))
    return pa.RecordBatch.from_arrays([flat(a), flat(b)], names=["a", "b"])


def _pairs_in_order(batches):
    """Buckets come one after the other; the last one of a batch may go on in the next."""
    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        bucket = rows.column("bucket").to_numpy()
        cut = int(np.searchsorted(bucket, bucket[-1], "left")) if len(bucket) else 0
        if cut:
            yield _pairs_of(rows.slice(0, cut).combine_chunks())
        rest = rows.slice(cut)
    if rest is not None and rest.num_rows:
        yield _pairs_of(rest.combine_chunks())


def _paired(seats: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (a, b) of different classes in the small buckets that their sketches allow; others never become rows."""
    small = seats.filter(F.col("size") <= PAIRED).join(sketches.select("uid", "n", "sketch"), "uid").select("bucket", "uid", "top", "n", "sketch")
    return small.repartition("bucket").sortWithinPartitions("bucket", "uid").mapInArrow(_pairs_in_order, "a bigint, b bigint").distinct()


def _links_within(table: pa.Table) -> pa.Table:
    """Links (a, b) that join the classes of a bucket's nodes: each pair of different classes goes by its sketches, then by its runs."""
    table = table.sort_by("uid")
    uid, size, sketches, packed = table.column("uid").to_numpy(), table.column("n").to_numpy(), table.column("sketch").to_pylist(), table.column("runs")
    tops, over = np.unique(table.column("top").to_numpy(), return_inverse=True)
    parent, runs, out = list(range(len(tops))), {}, []

    def find(k):
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    def content(k):
        if k not in runs:
            runs[k] = unpack_sorted(packed[k].as_py())
        return runs[k]

    start, step = 0, 1  # what links with the first node is one class before the rest is met
    while start < len(uid):
        label = np.array([find(k) for k in over.tolist()])
        i, j = np.nonzero(label[start : start + step, None] != label[None, :])
        i += start
        i, j = i[i < j], j[i < j]
        likely = may_link(size, sketches, i, j)
        for x, y in zip(i[likely].tolist(), j[likely].tolist()):
            one, two = find(over[x]), find(over[y])
            if one != two and linked_sets(content(x), content(y)):
                parent[one] = two
                out.append((uid[x], uid[y]))
        start, step = start + step, 64
    ends = np.array(out, dtype=np.int64).reshape(-1, 2)
    return pa.table({"a": pa.array(ends[:, 0]), "b": pa.array(ends[:, 1])})


def _held(large: DataFrame, sketches: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links of the buckets that one task holds, written; members of the others)."""
    sized = large.join(sketches.select("uid", "n", "sketch"), "uid")
    whole = durable(sized.groupBy("bucket").agg(F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("weight")))
    fits = (F.col("nodes") <= HELD) & (F.col("weight") <= HELD_RUNS)
    some = sized.join(whole.filter(fits).select("bucket"), "bucket", "left_semi")
    links_of = some.join(sets, "uid").select("bucket", "uid", "top", "n", "sketch", "runs").groupBy("bucket").applyInArrow(_links_within, "a bigint, b bigint")
    rest = large.join(whole.filter(~fits).select("bucket"), "bucket", "left_semi").select("bucket", "uid")
    return durable(links_of.distinct()), durable(rest)


def _through_base(members: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs of every node with its bucket's node of greatest slack, members of the next buckets) for large buckets."""
    by_hash = Window.partitionBy("bucket").orderBy(F.xxhash64("uid"), "uid")
    asked = members.withColumn("n", F.row_number().over(by_hash)).filter(F.col("n") <= ASKED).select("bucket", "uid")
    sets = durable(_chosen(sets, members.select("uid")))
    base = durable(asked.join(sets, "uid").select("bucket", "runs").groupBy("bucket").applyInArrow(_majority, "bucket bigint, base binary"))
    compared = members.join(sets, "uid").join(base, "bucket").select("bucket", "base", "uid", "runs")
    against = durable(compared.mapInArrow(_against_base, "bucket bigint, uid bigint, slack bigint, keys array<bigint>"))
    best = against.groupBy("bucket").agg(F.max(F.struct("slack", "uid")).alias("best")).select("bucket", F.col("best.uid").alias("centre"))
    pairs = against.select("bucket", "uid").join(best, "bucket").filter("uid <> centre")
    pairs = pairs.select(F.least("uid", "centre").alias("a"), F.greatest("uid", "centre").alias("b")).distinct()
    return pairs, against.select(F.explode("keys").alias("bucket"), "uid")


def _merged(seats: DataFrame) -> DataFrame:
    """One of the buckets that have the same nodes."""
    alike = seats.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("uid")).alias("x"), F.bit_xor(F.xxhash64("uid", F.lit(1))).alias("y"))
    return seats.join(alike.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket"), "bucket", "left_semi")


def linked(nodes: DataFrame, sets_of) -> tuple[DataFrame, DataFrame]:
    """Links that span the components of the nodes (uid, n, sketch, keys, below), and (uid, top) of their components.

    ``sets_of(uids)`` gives the runs of nodes.
    """
    seats = seated(nodes.select(F.explode(F.concat("keys", "below")).alias("bucket"), "uid"))
    uids = durable(seats.select("uid").distinct())
    sets, sketches = sets_of(uids), durable(_chosen(nodes.select("uid", "n", "sketch"), uids))
    found = sets.sparkSession.createDataFrame([], "a bigint, b bigint")
    seats = seats.withColumn("top", F.col("uid"))
    grouped = F.col("centre")  # buckets of one centre hold about the same nodes
    while True:
        pairs = durable(_paired(seats, sketches))
        large = durable(seats.filter(F.col("size") > PAIRED).select(grouped.alias("bucket"), "uid", "top").distinct())
        found = durable(found.unionByName(verified(pairs, sets)))
        if not large.isEmpty():
            within, large = _held(large, sketches, sets)
            found = durable(found.unionByName(within))
        if large.isEmpty():
            return found, components(found)
        starred, members = _through_base(large, sets)
        found = durable(found.unionByName(links(durable(starred), sketches, sets)))
        seats = _open(_merged(seated(members)), components(found))
        grouped = F.col("bucket")


def joined(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles (size of the set), component_id (least id of the component) of each document row."""
    blocks = text_blocks(docs, None, doc_id, text).select("block", "ids", "sizes", "body")
    signs = durable(blocks.mapInArrow(_sign, SIGNED))
    nodes = durable(signs.filter("one is not null").groupBy("one", "two").agg(F.min("uid").alias("uid")))
    keyed = signs.select("uid", "n", "sketch", "keys", "below").filter(F.size("keys") + F.size("below") > 0).join(nodes.select("uid"), "uid", "left_semi")

    def sets_of(uids: DataFrame) -> DataFrame:
        wanted = uids.withColumn("block", F.shiftright("uid", 16)).groupBy("block")
        return durable(blocks.select("block", "sizes", "body").groupBy("block").cogroup(wanted).applyInArrow(_sets, "uid bigint, runs binary"))

    _, classes = linked(keyed, sets_of)
    named = nodes.join(classes, "uid", "left").select("one", "two", F.coalesce("top", "uid").alias("top"))
    # copies of a set are summed up before they meet
    least = signs.filter("one is not null").groupBy("one", "two").agg(F.min("doc_id").alias("least")).join(named, ["one", "two"])
    tops = least.groupBy("top").agg(F.min("least").alias("component_id"))
    about = durable(least.select("one", "two", "top").join(tops, "top").select("one", "two", "component_id"))
    rows = signs.select("doc_id", F.col("n").alias("n_shingles"), "one", "two").join(about, ["one", "two"], "left")
    return rows.select("doc_id", "n_shingles", F.when(F.col("one").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
