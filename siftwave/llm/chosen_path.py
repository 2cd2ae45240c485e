"""N-gram Jaccard join (5): chosen-path join.

A document is the set of its word ``n``-grams.  Documents with one and the same
set are merged first, the lowest id stands for them.  Over the distinct sets,
each embedded as ``coords`` min-hash tokens, every repetition starts one tree; a
node splits its sets on ``fanout`` sampled tokens, and sets that share a sampled
token meet in a child.  A node of at most ``bucket`` sets is brute-forced; a
larger one splits again, down to ``depth`` or till a child keeps half of its
node, as splitting doesn't thin out sets that are all alike.  What is left is
brute-forced in full, in blocks of about ``block`` sets that are spread over
tasks - so nothing is capped.  A repetition misses a pair at Jaccard 0.5 with
probability 0.25 if it ends at depth one and about 0.4 at depth two;
``repeats`` lowers that to under one in a thousand.

Pairs close by their min-hashes are candidates.  Each connected component of
them is cut into blocks of about ``block_grams`` grams; a set goes once to each
pair of blocks it is in, and there the exact Jaccard of every candidate is
counted on bit vectors, for a bounded number of pairs at a time.

``join`` gives (doc_a, doc_b, jaccard) with doc_a < doc_b: each copy with the
lowest id of its set at 1.0, and each near pair of sets by their lowest ids.
``classes`` gives one row for each document that has a copy or a near pair:
its class (the lowest id of the connected component), the number of documents
with its very set, and the number of other sets it is linked with.

Defined results: null and empty texts and texts without a word, and rows with a
null id, pair with nothing; a text of fewer than ``n`` words is the one gram of
all its words; rows that repeat an id count once, with the text of fewest grams;
equal sets go by the lowest id; other columns don't matter; an empty table gives
no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwave.llm.common import Words, clean_ids, cuts, drop_ids, heads, materialise, mix, pack_lists, per_batch, raw_bytes, shingles, some, whole
from siftwave.llm.graph import components

_U = np.uint64


def _distinct(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the distinct grams, by row, rising."""
    sh, row, _ = shingles(w, n)
    order = np.lexsort((sh, row))
    sh, row = sh[order], row[order]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (row[1:] != row[:-1])
    return sh[new], row[new]


def _signatures(n: int, coords: int):
    rng = np.random.default_rng(7)
    mult = rng.integers(1, 1 << 63, coords, dtype=np.uint64) | _U(1)
    add = rng.integers(0, 1 << 63, coords, dtype=np.uint64)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        sh, row = _distinct(Words(batch.column(1)), n)
        if not len(sh):
            return None
        at = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        rows, count = row[at], np.diff(np.append(at, len(sh)))
        sig = np.empty((len(rows), coords), np.uint32)
        for k in range(coords):
            sig[:, k] = mix(np.minimum.reduceat(sh * mult[k] + add[k], at)) >> _U(32)
        one = np.add.reduceat(mix(sh ^ _U(0xA5A5A5A5)), at).view(np.int64)
        two = np.add.reduceat(mix(sh + _U(0x1234567)), at).view(np.int64)
        ids = batch.column(0).take(pa.array(rows))
        # the low byte of every token first: comparing needs no more
        planes = sig.view(np.uint8).reshape(len(rows), coords, 4)
        planes = np.concatenate([planes[:, :, 0], planes[:, :, 1:].reshape(len(rows), -1)], axis=1)
        return pa.RecordBatch.from_arrays([ids, pa.array(one), pa.array(two), pa.array(count.astype(np.int32)), _binary(planes)], ["id", "one", "two", "n", "sig"])

    return run, "id bigint, one bigint, two bigint, n int, sig binary"


def _binary(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    width = rows.shape[1] * rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def _children(path, fanout: int, coords: int):
    """The nodes under ``path`` that a set enters: ``fanout`` of its tokens, sampled by the node."""
    picks = [F.pmod(F.xxhash64(path, F.lit(k)), F.lit(coords)).cast("int") for k in range(fanout)]
    return F.array_distinct(F.array(*[F.xxhash64(path, p, F.substring("sig", p + 1, F.lit(1)), F.substring("sig", p * 3 + coords + 1, F.lit(3))) for p in picks]))


def _blocks(own, count):
    """(x, y) of the block pairs that a member of block ``own`` of ``count`` takes part in."""
    return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.struct(F.least(own, k).alias("x"), F.greatest(own, k).alias("y")))


def _compare(least: float):
    """Of the sets of leaves (path, x, y, own, id, low) the pairs that agree in a
    share ``least`` of their tokens: those of two blocks, or those of one."""

    def pairs(cols):
        path, x, y, own, ids = (np.asarray(c) for c in cols[:5])
        low = raw_bytes(cols[5], lower=False)[0].reshape(len(ids), -1)
        at = heads(path, x, y)
        left = np.repeat(np.diff(at), np.diff(at)) - (np.arange(len(ids)) - np.repeat(at[:-1], np.diff(at)))  # rows to the group's end
        one = x == y
        d, alive = 1, np.flatnonzero(left > 1)
        while len(alive):
            for s in range(0, len(alive), 1 << 16):
                i = alive[s : s + (1 << 16)]
                i = i[one[i] | (own[i] != own[i + d])]
                near = i[np.count_nonzero(low[i] == low[i + d], axis=1) >= least * low.shape[1]]
                yield np.stack([ids[near], ids[near + d]], axis=1)
            d += 1
            alive = alive[left[alive] > d]

    def run(batches):
        held, rows = [], 0
        for cols in whole(batches, 3):
            for both in pairs(cols):
                held.append(np.sort(both[both[:, 0] != both[:, 1]], axis=1))
                rows += len(held[-1])
                if rows > 1 << 20:
                    yield _unique(held)
                    held, rows = [], 0
        if rows:
            yield _unique(held)

    return run


def _unique(held: list[np.ndarray]) -> pa.RecordBatch:
    both = np.concatenate(held)
    both = both[np.lexsort((both[:, 1], both[:, 0]))]
    new = np.ones(len(both), bool)
    new[1:] = (both[1:] != both[:-1]).any(axis=1)
    return pa.RecordBatch.from_arrays([pa.array(both[new, 0]), pa.array(both[new, 1])], ["a", "b"])


def _sets(n: int, most: int = 1 << 22):
    """Of (id, text, one, [(root, x, y)]) the set of the text, for each block pair, in
    batches of about ``most`` grams however many block pairs there are."""

    def cut(batch: pa.RecordBatch):
        sh, row = _distinct(Words(batch.column(1)), n)
        off = np.searchsorted(row, np.arange(batch.num_rows + 1))
        acc = np.concatenate([np.zeros(1, _U), np.cumsum(mix(sh ^ _U(0xA5A5A5A5)))])
        # rows that repeat an id may have another text
        right = np.flatnonzero((acc[off[1:]] - acc[off[:-1]]).view(np.int64) == np.asarray(batch.column(2)))
        if not len(right):
            return
        grams = pack_lists((mix(sh) >> _U(32)).astype(np.uint32), off)
        to = batch.column(3).take(pa.array(right))
        own = np.repeat(right, np.asarray(pc.list_value_length(to)))
        root, x, y = to.flatten().flatten()
        total, s = np.cumsum(np.diff(off)[own]), 0
        while s < len(own):
            e = max(s + 1, int(np.searchsorted(total, (total[s - 1] if s else 0) + most, side="right")))
            part = pa.array(own[s:e])
            yield pa.RecordBatch.from_arrays([root[s:e], x[s:e], y[s:e], batch.column(0).take(part), pa.nulls(e - s, pa.int64()), grams.take(part)], ["root", "x", "y", "a", "b", "grams"])
            s = e

    def run(batches):
        for batch in batches:
            for a, b in cuts(batch.column(1), 1 << 20):
                yield from cut(batch.slice(a, b - a))

    return run, "root bigint, x int, y int, a bigint, b bigint, grams binary"


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, most: int = 1 << 25) -> np.ndarray:
    """Sizes of the intersections of sets ``left[k]`` and ``right[k]``, by bit
    vectors over the elements that two sets or more have, so many at a time that
    all sets have ``most`` of them."""
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable").astype(np.int32)
    values = values[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    count = np.diff(np.append(np.flatnonzero(new), len(values)))
    kind = np.cumsum(count > 1, dtype=np.int32) - 1
    shared = np.repeat(count > 1, count)
    # the elements of rising rank, each with its sets
    at = np.repeat(kind, count)[shared]
    own = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])[order[shared]]
    del values, order, new, shared
    out = np.zeros(len(left), np.int64)
    kinds = int(at[-1]) + 1 if len(at) else 0
    width = max(64, most // len(sets) // 64 * 64)
    for s in range(0, kinds, width):
        a, b = np.searchsorted(at, [s, s + width])
        words = -(-min(width, kinds - s) // 64)
        bits = np.zeros((len(sets), words * 64), bool)
        bits[own[a:b], at[a:b] - s] = True
        bits = np.packbits(bits, axis=1).view(np.uint64)
        step = max(1, (1 << 18) // words)
        for k in range(0, len(left), step):
            out[k : k + step] += np.bitwise_count(bits[left[k : k + step]] & bits[right[k : k + step]]).sum(axis=1, dtype=np.int64)
    return out


def _shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The same by sorting: for few sets of few pairs each."""
    out = np.zeros(len(left), np.int64)
    for s in range(0, len(left), 256):
        both = [sets[k] for k in np.stack([left, right], axis=1)[s : s + 256].ravel()]
        size = np.array([len(x) for x in both])
        pair = np.repeat(np.arange(len(both)) // 2, size).astype(_U)
        x = np.sort(pair << _U(32) | np.concatenate(both))
        out[s : s + 256] = np.bincount((x[1:][x[1:] == x[:-1]] >> _U(32)).astype(np.int64), minlength=len(both) // 2)
    return out


def _parts(batches, most: int):
    """Of rows (root, x, y, a, b, grams), sorted by the first three and by ``b`` with null
    first: (sets, pairs) of whole block pairs, as many as have ``most`` grams and
    pairs; of a block pair of more pairs, its sets with ``most`` pairs at a time."""
    sets, pairs, size, waiting, group, key = [], [], 0, 0, 0, None

    def taken():
        joined = [[np.concatenate(c) for c in zip(*x)] for x in ([y[:2] for y in sets], pairs)]
        return joined[0], [g for x in sets for g in x[2]], joined[1]

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [np.asarray(batch.column(k)) for k in range(3)]
        at = heads(*keys)
        is_set = np.asarray(batch.column(4).is_null())
        a, b = np.asarray(batch.column(3)), np.asarray(pc.fill_null(batch.column(4), 0))
        for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
            now = tuple(int(k[s]) for k in keys)
            if now != key:
                if size >= most:
                    if pairs and sets:
                        yield taken()
                    sets, pairs, size, waiting = [], [], 0, 0
                key, group = now, group + 1
            cut = s + int(np.count_nonzero(is_set[s:e]))  # the sets come first
            if cut > s:
                data, off = raw_bytes(batch.column(5).slice(s, cut - s), lower=False)
                data = data.view(np.uint32).copy()
                sets.append((np.full(cut - s, group), a[s:cut].copy(), np.split(data, off[1:-1] // 4)))
                size += len(data)
            if e > cut:
                pairs.append((np.full(e - cut, group), a[cut:e].copy(), b[cut:e].copy()))
                size, waiting = size + e - cut, waiting + e - cut
                if waiting >= most and sets:
                    yield taken()
                    # the block pair may go on: its sets stay
                    sets = [x for x in sets if x[0][0] == group]
                    pairs, waiting, size = [], 0, sum(len(g) for x in sets for g in x[2])
    if pairs and sets:
        yield taken()


def _settle(threshold: float, few: int = 12, most: int = 1 << 19):
    """Exact Jaccard of the pairs of every block pair; its sets are the rows with null
    ``b``.  However many pairs a block pair has, ``most`` are held at once."""

    def found(a, b, both, n_a, n_b):
        value = both / np.maximum(n_a + n_b - both, 1)
        keep = value >= threshold
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array(np.round(value[keep], 6))], ["doc_a", "doc_b", "jaccard"])

    def run(batches):
        for (of_set, ids), grams, (of_pair, left, right) in _parts(batches, most):
            small_sets, small = [], []
            for g in np.unique(of_pair).tolist():
                own = slice(*np.searchsorted(of_set, [g, g + 1]).tolist())
                pair = slice(*np.searchsorted(of_pair, [g, g + 1]).tolist())
                known, head = np.unique(ids[own], return_index=True)
                sets = [grams[own.start + k] for k in head.tolist()]
                if not sets:
                    continue
                a, b = left[pair], right[pair]
                i, j = (np.searchsorted(known, x).astype(np.int32) for x in (a, b))
                size = np.array([len(x) for x in sets])
                if len(a) > few:
                    yield from found(a, b, intersections(sets, i, j), size[i], size[j])
                else:
                    small.append((a, b, i + len(small_sets), j + len(small_sets), size[i], size[j]))
                    small_sets += sets
            if small:
                x, y, i, j, n_a, n_b = (np.concatenate(c) for c in zip(*small))
                yield from found(x, y, _shared(small_sets, i, j), n_a, n_b)

    return run, "doc_a bigint, doc_b bigint, jaccard double"


def _near(docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float, repeats: int, coords: int, fanout: int, bucket: int, depth: int, block: int, block_grams: int, max_broadcast: int):
    """(members, near pairs): every id with the lowest of its set; the near pairs of those."""
    slim = clean_ids(docs, id_col, text_col).where("id is not null")
    run, schema = _signatures(n, coords)
    sig = materialise(slim.mapInArrow(per_batch(run), schema))
    same = ["n", "one", "two"]
    best = sig.groupBy("id").agg(F.min(F.struct(*same)).alias("s")).select("id", "s.*")
    least = best.groupBy(*same).agg(F.min("id").alias("rep"))
    members = materialise(best.join(least, same).select("id", "rep"))
    reps = materialise(sig.groupBy(*same).agg(F.first("sig").alias("sig")).join(least, same).select(F.col("rep").alias("id"), "n", "one", "sig"))

    roots = [F.xxhash64(F.lit("root"), F.lit(r)) for r in range(repeats)]
    level = reps.select("id", F.explode(F.array_distinct(F.flatten(F.array(*[_children(r, fanout, coords) for r in roots])))).alias("path"), F.lit(0).cast("bigint").alias("above"))
    leaves = None
    for k in range(depth):
        met = level.groupBy("path").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
        met = materialise(level.join(met, "path"))
        done = (F.col("m") <= bucket) | (F.col("above") > 0) & (F.col("m") * 2 >= F.col("above"))
        small = (met.where(done) if k + 1 < depth else met).select("path", "id", "m")
        leaves = small if leaves is None else leaves.unionByName(small)
        large = met.where(~done)
        if k + 1 == depth or large.isEmpty():
            break
        level = large.join(reps, "id").select("id", F.explode(_children(F.col("path"), fanout, coords)).alias("path"), F.col("m").alias("above"))
    # three standard deviations of the estimate under the threshold
    close = threshold - 3 * (threshold * (1 - threshold) / coords) ** 0.5
    # a byte of each token is enough to compare: it agrees by chance once in 256
    low = reps.select("id", F.substring("sig", F.lit(1), F.lit(coords)).alias("low"))
    count = F.ceil(F.col("m") / block).cast("int")
    own = F.pmod(F.xxhash64("id", "path"), count).cast("int")
    grouped = leaves.select("path", "id", own.alias("own"), F.explode(_blocks(own, count)).alias("to")).select("path", "to.x", "to.y", "own", "id")
    grouped = grouped.join(low, "id").select("path", "x", "y", "own", "id", "low").repartition("path", "x", "y").sortWithinPartitions("path", "x", "y")
    near = materialise(grouped.mapInArrow(_compare(close), "a bigint, b bigint").distinct())

    # exact Jaccard, component by component
    root = components(near, "a", "b")
    root = root.unionByName(root.select(F.col("root").alias("id"), "root").distinct())
    sized = root.join(reps.select("id", "n", "one"), "id")
    blocks = sized.groupBy("root").agg(F.ceil(F.sum(F.col("n").cast("bigint")) / block_grams).cast("int").alias("blocks"))
    sized = materialise(sized.join(blocks, "root").select("id", "one", "root", "blocks", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int").alias("own")))
    to = F.transform(_blocks(F.col("own"), F.col("blocks")), lambda b: F.struct(F.col("root").alias("root"), b["x"].alias("x"), b["y"].alias("y")))
    cut, schema = _sets(n)
    sets = some(slim, sized.select("id", "one", to.alias("to")), max_broadcast).select("id", "text", "one", "to").mapInArrow(cut, schema)
    places = sized.select("id", "own")
    pairs = near.join(sized.select(F.col("id").alias("a"), "root", F.col("own").alias("p")), "a").join(places.select(F.col("id").alias("b"), F.col("own").alias("q")), "b")
    pairs = pairs.select("root", F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"), "a", "b", F.lit(None).cast("binary").alias("grams"))
    settle, schema = _settle(threshold)
    placed = sets.unionByName(pairs).repartition("root", "x", "y").sortWithinPartitions("root", "x", "y", "b")
    return members, placed.mapInArrow(settle, schema)


_OPTIONS = {"n": 3, "threshold": 0.5, "repeats": 10, "coords": 64, "fanout": 2, "bucket": 64, "depth": 4, "block": 2048, "block_grams": 2_000_000, "max_broadcast": 2_000_000}


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_a, doc_b, jaccard), see above; ``options`` are those of ``_OPTIONS``."""
    members, near = _near(docs, id_col, text_col, **_OPTIONS | options)
    copies = members.where("id > rep").select(F.col("rep").alias("doc_a"), F.col("id").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    return copies.unionByName(near)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, class_id, copies, links), see above."""
    members, near = _near(docs, id_col, text_col, **_OPTIONS | options)
    near = materialise(near)
    links = near.select(F.explode(F.array("doc_a", "doc_b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    root = components(near).select(F.col("id").alias("rep"), "root")
    size = members.groupBy("rep").agg(F.count(F.lit(1)).alias("copies")).join(links, "rep", "left").join(root, "rep", "left").where("copies > 1 or links > 0")
    return members.join(size, "rep").select(F.col("id").alias("doc_id"), F.coalesce("root", "rep").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with the lowest id of each class; rows in no class stay."""
    gone = classes(docs, id_col=id_col, **options).where("doc_id <> class_id").select(F.col("doc_id").alias("id"))
    return drop_ids(docs, id_col, gone, (_OPTIONS | options)["max_broadcast"])
