"""Substring dedup (4): compact windows over token min-hashes.

A token is a word ``n``-gram.  Under one hash function the Cartesian tree of a
document's token hashes has a node c for every compact window (a, c, b): all
token runs that start in [a, c] and end in [c, b] have their min-hash at c.
Only windows that hold a run of ``min_words`` words matter, and their nodes are
the minima of runs of just that length, so the tree is built of those alone.

Every window of each of ``hashes`` functions gives one record: its min-hash, its
place, and its context, the 12-bit hashes of the chunks of ``_CHUNK`` tokens
on either side of the minimum.  Records of one min-hash meet.  Those of one
context are linked with the lowest document among them; those that share
``_SURE`` chunks in a row around the minimum (an exact run) with the lowest
that has these.  Of the contexts with one run of 9 chunks (longer than any that is
asked for) the lowest stands for that run (and the next document's, where the lowest
has several contexts of that min-hash), and every two that stand for a run are
compared by the chunks they agree in, and taken as a candidate where one edit in
runs they stand for can explain what they don't: no two texts go uncompared.
Groups of any size are compared whole: beyond ``block`` contexts in blocks that
are spread over tasks, which gives the same links.  One function misses a pair
of runs at Jaccard 0.8 with probability 0.2, two with 0.04, and passages longer
than ``min_words`` have several runs; exact runs are never missed.

Candidates are as many as the pairs of near copies, so they never leave a task.  Of each
min-hash only the records that have any go on, with a forest of their documents; then every
component (in blocks of about ``block_tokens``, a task for each pair of blocks) gets these
records, its exact links and the tokens about its minima, finds the candidates again, of
``part`` documents with as many at a time, and settles them: what is stored and shuffled
grows with the documents and blocks, the comparisons alone with the pairs.

The links of all functions are joined as intervals: those of one pair and
diagonal that touch are one stretch.  Exact runs are certain; candidate stretches
that no exact run of their diagonal covers are verified on their tokens: the
starts at which Jaccard reaches the threshold are merged to passages where they
overlap (halved while the whole doesn't reach it), and every passage is reported.

``passages`` gives the links: (doc_a, doc_b, start_a, end_a, start_b, end_b,
jaccard), offsets in words, end exclusive, with near passages between the lowest
documents that have either text; the ends of exact runs (Jaccard 1) are
known to a chunk, as chunks of 12 bits are the same by chance once in 4096.  Copies of a passage are linked with their lowest document, not with
one another.  ``repeats`` gives one row for each document that has a link: its
class (the lowest id of the connected component), the number of documents it is
linked with, and the word ranges of it that are found elsewhere.

Defined results: null and empty texts, texts of fewer than ``min_words`` words
and rows with a null id match nothing; rows that repeat an id are one document;
repeats inside one document aren't reported, and of a window that a document
repeats the first counts; equal contexts go by the lowest id, then place; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwave.llm.common import Words, clean_ids, heads, mix, per_batch, powers, raw_bytes, shingles, some, stored, whole
from siftwave.llm.graph import components, contract

_U = np.uint64
#: bits of a token's place in a batch
_PLACE = 28
_LOW = _U((1 << _PLACE) - 1)
#: tokens in a chunk, chunks on either side of the minimum, and chunks in a row that make an exact run
_CHUNK, _SIDE, _SURE = 6, 8, 8
#: tokens, or candidates, that are looked at in one go
_AT_ONCE = 1 << 18
_rng = np.random.default_rng(41)
_MULT = _rng.integers(1, 1 << 63, 64, dtype=_U) | _U(1)
_ADD = _rng.integers(0, 1 << 63, 64, dtype=_U)


def token_hashes(tokens: np.ndarray, k: int, start: np.ndarray) -> np.ndarray:
    """Of each token 22 bits of its hash under function ``k``, 14 that settle ties, and
    its place.  Tokens that are the same go by the token after them, then by a hash
    of the place in the text (from ``start`` on): by place alone, every token of a long
    run of one word would be a minimum."""
    h = mix(tokens * _MULT[k] + _ADD[k]) >> _U(42) << _U(42)
    after = np.append(tokens[1:], _U(0)) * _MULT[60] >> _U(58)
    place = np.arange(len(tokens), dtype=_U)
    return h | after << _U(36) | mix(place - start + _MULT[61]) >> _U(56) << _U(_PLACE) | place


def run_minima(h: np.ndarray, size: int) -> np.ndarray:
    """Least value of every run of ``size``."""
    out, have = h, 1
    while have * 2 <= size:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (size - have)], out[size - have :]) if have < size else out


def compact_windows(h: np.ndarray, row: np.ndarray, first: np.ndarray, size: int):
    """(a, c, b) of the compact windows that are ``size`` tokens or wider.

    The neighbours that bound a node are nodes themselves (what ends a window
    of ``size`` is less than all in it, so its own is wider), hence the tree of
    these nodes gives the bounds; parents are found by pointer jumping.
    """
    least = run_minima(h, size)
    start = np.flatnonzero(row[: len(least)] == row[size - 1 : size - 1 + len(least)])
    c = (least[start] & _LOW).astype(np.int64)
    c = c[heads(c)[:-1]] if len(c) else c  # the place of the minimum never goes back
    v, r = h[c], row[c]

    def bound(step: int) -> np.ndarray:
        to = np.arange(len(c)) + step
        at = np.arange(len(c))
        while len(at):
            near = to[at]
            inside = (near >= 0) & (near < len(c))
            at, near = at[inside], near[inside]
            at = at[(r[near] == r[at]) & (v[near] > v[at])]
            to[at] = to[to[at]]
        return to

    left, right = bound(-1), bound(1)
    inside = (left >= 0) & (r[np.maximum(left, 0)] == r)
    a = np.where(inside, c[np.maximum(left, 0)] + 1, first[r])
    most = np.minimum(right, len(c) - 1)
    inside = (right < len(c)) & (r[most] == r)
    b = np.where(inside, c[most] - 1, first[r + 1] - 1)
    return a, c, b


def records(col: pa.Array, n: int, size: int, hashes: int):
    """(row, key, place, context) of every compact window: the place of its minimum
    in the row and the tokens from there on (255 at most, in 8 bits), and 16 chunk
    hashes of 12 bits in 24 bytes."""
    tokens, row, _ = shingles(Words(col), n)
    count = np.bincount(row, minlength=len(col))
    keep = count[row] >= size
    tokens, row = tokens[keep], row[keep]
    if not len(tokens):
        return None
    first = np.searchsorted(row, np.arange(len(col) + 1))
    total = len(tokens)
    power, inverse = powers(total + 1)
    acc = np.concatenate([np.zeros(1, _U), np.cumsum(mix(tokens + _U(77)) * power[:total])])
    start, out = first[row].astype(_U), []
    for k in range(hashes):
        _, c, _ = compact_windows(token_hashes(tokens, k, start), row, first, size)
        r = row[c]
        begin = c[:, None] + _CHUNK * np.arange(-_SIDE, _SIDE)[None, :]
        end = np.minimum(begin + _CHUNK, first[r + 1][:, None])
        begin = np.minimum(np.maximum(begin, first[r][:, None]), total)
        end = np.maximum(end, begin)
        chunk = mix((acc[end] - acc[begin]) * inverse[begin]) >> _U(52)
        # a chunk that the text ends in has fewer tokens, beyond it there is none
        chunk = np.where(end > begin, np.maximum(chunk, _U(1)), _U(0))
        key = mix(tokens[c] + _U(k + 1) * _MULT[51])
        context = _packed(chunk.astype(np.uint16))
        # of windows that a document repeats, the first
        words = context.view(np.uint64)
        order = np.lexsort((c, words[:, 2], words[:, 1], words[:, 0], key, r))
        order = np.sort(order[heads(r[order], key[order], *words[order].T)[:-1]])
        place = (c - first[r]) << 8 | np.minimum(first[r + 1] - c, 255)
        out.append((r[order], key[order].view(np.int64), place[order], context[order]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _packed(chunks: np.ndarray) -> np.ndarray:
    """16 values of 12 bits in 24 bytes: the low bytes, then the rest, two in a byte."""
    high = (chunks >> 8).astype(np.uint8)
    return np.concatenate([(chunks & 255).astype(np.uint8), high[:, ::2] << 4 | high[:, 1::2]], axis=1)


def _unpacked(context: np.ndarray) -> np.ndarray:
    out = context[:, : 2 * _SIDE].astype(np.uint16)
    out[:, ::2] |= (context[:, 2 * _SIDE :] >> 4).astype(np.uint16) << 8
    out[:, 1::2] |= (context[:, 2 * _SIDE :] & 15).astype(np.uint16) << 8
    return out


def _width(size: int) -> int:
    """Chunks that lie whole in a run of ``size``, give or take one."""
    return max(1, (size - _CHUNK // 2) // _CHUNK)


def _explained(size: int) -> tuple[np.ndarray, np.ndarray]:
    """For every set of chunks that two contexts agree in (bit 15 is the leftmost)
    two sets of runs of ``_width`` chunks (bit j: j of them left of the minimum):
    those that may have one edit - two chunks at most differ (the tokens replaced),
    or all on one side from the edit on (what follows has moved) - and those
    that agree whole."""
    width = _width(size)
    mask = np.arange(1 << 2 * _SIDE)
    agree = (mask[:, None] >> np.arange(2 * _SIDE - 1, -1, -1)) & 1 == 1
    edit, same = np.zeros(len(mask), np.uint16), np.zeros(len(mask), np.uint16)
    for j in range(max(0, width - _SIDE), min(width, _SIDE) + 1):
        left, right = agree[:, _SIDE - j : _SIDE][:, ::-1], agree[:, _SIDE : _SIDE + width - j]
        differ = (~left).sum(axis=1) + (~right).sum(axis=1)
        ok = (differ <= 2) & (differ < width)
        for own, other in ((left, right), (right, left)):
            prefix = np.logical_and.accumulate(own, axis=1).sum(axis=1)
            ok |= other.all(axis=1) & (own.sum(axis=1) == prefix) & (prefix + other.shape[1] >= 3)
        edit |= (ok << j).astype(np.uint16)
        same |= ((differ == 0) << j).astype(np.uint16)
    return edit, same


def _plain(chunks: np.ndarray, size: int, kinds: int = 4) -> np.ndarray:
    """Of every context the runs (as above) of ``kinds`` different chunks or more: in
    runs of fewer, as of one word repeated, the tokens of an edit are over a
    fifth of all, so they must agree whole."""
    width = _width(size)
    out = np.zeros(len(chunks), np.uint16)
    for j in range(max(0, width - _SIDE), min(width, _SIDE) + 1):
        x = np.sort(chunks[:, _SIDE - j : _SIDE + width - j], axis=1)
        out |= ((1 + (x[:, 1:] != x[:, :-1]).sum(axis=1) >= min(kinds, width)) << j).astype(np.uint16)
    return out


def _extent(agree: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks that agree in a row to the left and right of the minimum."""
    return tuple(np.logical_and.accumulate(x, axis=1).sum(axis=1) for x in (agree[:, :_SIDE][:, ::-1], agree[:, _SIDE:]))


class Linker:
    """Links (a, b, diag, lo, hi) of records that come sorted by key, context, id
    and place: runs of a that start from lo to hi, with those of b by diag after."""

    def __init__(self, size: int, block: int):
        self.size, self.block = size, block
        self.edit, self.same = _explained(size)
        self.runs = np.arange(2 * _SIDE - _SURE + 1)

    def _link(self, doc, place, i, j, left, right):
        """Of pairs of rows whose runs reach ``left`` and ``right`` tokens from the minimum."""
        flip = doc[i] > doc[j]
        i, j = np.where(flip, j, i), np.where(flip, i, j)
        c = place[i] >> 8
        return doc[i], doc[j], (place[j] >> 8) - c, c - left, c + np.maximum(right - self.size, -left)

    def _reach(self, place, left, right):
        """Tokens in so many chunks either side of the minimum."""
        return np.minimum(_CHUNK * left, place >> 8), np.minimum(_CHUNK * right, place & 255)

    def _full(self, place):
        """Which of the runs of ``_SURE`` chunks have ``size`` tokens in the text."""
        left, right = self._reach(place[:, None], _SIDE - self.runs[None, :], self.runs[None, :] + _SURE - _SIDE)
        return left + right >= self.size

    def copies(self, doc, place, rep_doc, rep_place):
        """Rows of one context with the first of it."""
        at = np.flatnonzero(doc != rep_doc)
        both, where = np.concatenate([rep_doc[at], doc[at]]), np.concatenate([rep_place[at], place[at]])
        k = np.arange(len(at))
        return self._link(both, where, k, k + len(at), *self._reach(place[at], _SIDE, _SIDE))

    def exact(self, group, doc, place, chunks):
        """Of distinct contexts, those that share a run of chunks, with the lowest of it."""
        found, full = [], self._full(place)
        for j in self.runs.tolist():
            row = np.flatnonzero(full[:, j])
            run = mix((chunks[row, j : j + _SURE].astype(_U) * _MULT[:_SURE]).sum(axis=1, dtype=_U) + _U(j))
            order = np.lexsort((place[row], doc[row], run, group[row]))
            at = heads(group[row][order], run[order])
            order = row[order]
            rep = np.repeat(order[at[:-1]], np.diff(at))
            other = doc[rep] != doc[order]
            found.append(np.stack([rep[other], order[other]], axis=1))
        i, j = np.unique(np.concatenate(found), axis=0).T
        yield self._link(doc, place, i, j, *self._reach(place[i], *_extent(chunks[i] == chunks[j])))

    def stands(self, group, doc, place, chunks):
        """Of every context the runs (bit j, as in ``_explained``), with a chunk more on
        either side, that it's the lowest of its group to have; or the next
        document's, where the lowest has several contexts in the group: it isn't compared
        with itself, so what two others have of it would go unlinked."""
        width = _width(self.size)
        order = np.lexsort((doc, group))
        at = heads(group[order], doc[order])
        several = np.zeros(len(doc), bool)
        several[order] = np.repeat(np.diff(at) > 1, np.diff(at))
        out = np.zeros(len(doc), np.uint16)
        for j in range(max(0, width - _SIDE), min(width, _SIDE) + 1):
            own = chunks[:, max(0, _SIDE - j - 1) : _SIDE + width - j + 1].astype(_U)
            run = mix((own * _MULT[: own.shape[1]]).sum(axis=1, dtype=_U) + _U(j + 1))
            order = np.lexsort((place, doc, run, group))
            at = heads(group[order], run[order])
            first = np.repeat(order[at[:-1]], np.diff(at))
            out[order[at[:-1]]] |= 1 << j
            other = np.flatnonzero((doc[order] != doc[first]) & several[first])
            out[order[other[heads(first[other])[:-1]]]] |= 1 << j
        return out

    def candidates(self, group, doc, place, chunks, stands, own=(), met: _Met | None = None, plain: np.ndarray | None = None):
        """Pairs (i, j) of one group that differ in each of ``own``, that share no exact
        run but may be one edit apart in runs that they stand for; but for those that
        ``met`` has nothing to learn of."""
        at = heads(*group)
        left = np.repeat(at[1:], np.diff(at)) - np.arange(len(doc))
        full, plain = self._full(place), (_plain(chunks, self.size) if plain is None else plain) & stands
        # every row with those after it in its group, as many rows at once as make about 1 << 17 pairs
        many = left - 1
        for s in np.split(np.arange(len(doc)), heads(np.cumsum(many) >> 17)[1:-1]) if len(doc) else []:
            i = np.repeat(s, many[s])
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(many[s]) - many[s], many[s])
            for v in (doc, *own):
                apart = v[i] != v[j]
                i, j = i[apart], j[apart]
            if met is not None:
                fresh = met.open(i, j)
                i, j = i[fresh], j[fresh]
            agree = chunks[i] == chunks[j]
            # both beyond their texts isn't agreement
            bits = np.packbits(agree & (chunks[i] != 0), axis=1).astype(np.int64)
            bits = bits[:, 0] << 8 | bits[:, 1]
            near = np.flatnonzero(self.edit[bits] & plain[i] & plain[j] | self.same[bits] & stands[i] & stands[j])
            i, j, (before, after) = i[near], j[near], _extent(agree[near])
            sure = full[i] & (self.runs >= _SIDE - before[:, None]) & (self.runs + _SURE <= _SIDE + after[:, None])
            sure = sure.any(axis=1)
            if not sure.all():
                yield i[~sure], j[~sure]

    def near(self, doc, place, i, j):
        """Links of candidates: a run may reach as far from the minimum as it is long."""
        reach = np.full(len(i), self.size - 1)
        return self._link(doc, place, i, j, reach, reach + 1)


#: what a row is: a run's tokens (id, -, start, -, -, tokens), a record that has a candidate
#: (id, key, place, stands, -, context), an exact link (a, b, diag, lo, hi), an edge of a forest (a, b)
_RUN, _ROW, _EXACT, _EDGE = range(4)
_FOUND = "kind int, p bigint, q bigint, r bigint, lo int, hi int, data binary"
_APART = "key bigint, x int, y int, own int, id bigint, place bigint, stands int, context binary"


def _found(kind: int, p, q, r=None, lo=None, hi=None, data=None) -> pa.RecordBatch:
    n = len(p)
    rest = [pa.nulls(n, t) if v is None else pa.array(v.astype(t.to_pandas_dtype())) for v, t in ((r, pa.int64()), (lo, pa.int32()), (hi, pa.int32()))]
    data = pa.nulls(n, pa.binary()) if data is None else _binary(data)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(p), pa.array(q), *rest, data], ["kind", "p", "q", "r", "lo", "hi", "data"])


def _merged(parts, size: int):
    """Exact links of one pair, diagonal and stretch as one."""
    a, b, diag, lo, hi = (np.concatenate(x) for x in zip(*parts))
    if not len(a):
        return
    stretch = lo // size
    order = np.lexsort((stretch, diag, b, a))
    at = heads(*(x[order] for x in (a, b, diag, stretch)))[:-1]
    lo, hi = np.minimum.reduceat(lo[order], at), np.maximum.reduceat(hi[order], at)
    yield _found(_EXACT, *(x[order][at] for x in (a, b, diag)), lo, hi)


def _gathered(parts, size: int, most: int = 1 << 19):
    held, rows = [], 0
    for part in parts:
        held.append(part)
        rows += len(part[0])
        if rows > most:
            yield from _merged(held, size)
            held, rows = [], 0
    if held:
        yield from _merged(held, size)


class _Met:
    """Which records have a candidate, and a forest of the documents so far; pairs of
    records that have one each, of documents that are joined, say nothing new."""

    def __init__(self, doc):
        self.used = np.zeros(len(doc), bool)
        self.ids, self.node = np.unique(doc, return_inverse=True)
        self.root = np.arange(len(self.ids))
        self.held, self.rows = [], 0

    def open(self, i, j):
        return ~(self.used[i] & self.used[j]) | (self.root[self.node[i]] != self.root[self.node[j]])

    def add(self, i, j) -> None:
        self.used[i] = self.used[j] = True
        self.held.append((self.node[i], self.node[j]))
        self.rows += len(i)
        if self.rows > len(self.ids):
            self.join()

    def join(self) -> None:
        if self.held:
            node, to = contract(*(self.root[np.concatenate(x)] for x in zip(*self.held)))
            new = np.arange(len(self.ids))
            new[node] = to
            self.root, self.held, self.rows = new[self.root], [], 0


def _met(linker: Linker, group, key, doc, place, stands, raw, own=()):
    """Of records with candidates the records, and a forest of their documents: the
    candidates are as many as the pairs within a group, so they don't leave the task."""
    met = _Met(doc)
    for i, j in linker.candidates(group, doc, place, _unpacked(raw), stands, own, met):
        met.add(i, j)
    met.join()
    tree = np.flatnonzero(met.root != np.arange(len(met.ids)))
    if len(tree):
        yield _found(_EDGE, met.ids[tree], met.ids[met.root[tree]])
    if met.used.any():
        yield _found(_ROW, doc[met.used], key[met.used], place[met.used], stands[met.used], None, raw[met.used])


def _by_key(size: int, block: int, apart: bool):
    """Of (key, id, place, context), sorted: the exact links, and what ``_met`` has of the
    candidates; or, where ``apart``, the rows of groups of more than ``block`` contexts, for
    every pair of blocks."""
    linker = Linker(size, block)

    def distinct(batches, out):
        """The rows that begin a context, and the first of the next document that has it;
        all but the first are linked at once."""
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, doc, place = (np.asarray(batch.column(k)) for k in range(3))
            words = raw_bytes(batch.column(3), lower=False)[0].reshape(len(key), -1).view(np.uint64)
            first = np.zeros(len(key), bool)
            first[heads(key, *words.T)[:-1]] = True
            if last is not None and key[0] == last[0] and (words[0] == last[1]).all():
                first[0] = False
            rep = np.cumsum(first)
            before = (doc[0], place[0]) if last is None else last[2:4]
            rep_doc = np.concatenate([[before[0]], doc[first]])[rep]
            rep_place = np.concatenate([[before[1]], place[first]])[rep]
            if not apart:
                out.append(linker.copies(doc, place, rep_doc, rep_place))
            other = np.flatnonzero(doc != rep_doc)
            second = other[heads(rep[other])[:-1]] if len(other) else other
            if last is not None and last[4] and len(second) and rep[second[0]] == 0:
                second = second[1:]  # a batch before has it
            had = bool(len(other) and rep[other[-1]] == rep[-1] or rep[-1] == 0 and last is not None and last[4])
            last = (key[-1], words[-1].copy(), rep_doc[-1], rep_place[-1], had)
            first[second] = True
            yield batch.filter(pa.array(first))

    def run(batches):
        copies: list = []
        for cols in whole(distinct(batches, copies), 1, 1 << 16):
            yield from _gathered(copies, size)
            copies.clear()
            key, doc, place = (np.asarray(c) for c in cols[:3])
            raw = raw_bytes(cols[3], lower=False)[0].reshape(len(key), -1)
            at = heads(key)
            count = np.repeat(np.diff(at), np.diff(at))
            many = np.flatnonzero(count > (block if apart else 1))
            if not len(many):
                continue
            key, doc, place, raw = key[many], doc[many], place[many], raw[many]
            chunks = _unpacked(raw)
            if not apart:
                fresh = heads(key, *raw.view(np.uint64).T)[:-1]
                yield from _gathered(linker.exact(key[fresh], doc[fresh], place[fresh], chunks[fresh]), size)
            stands = linker.stands(key, doc, place, chunks)
            # what stands for nothing has been linked; whether a group is large depends on the rest
            left = np.flatnonzero(stands)
            key, doc, place, raw, chunks, stands = (v[left] for v in (key, doc, place, raw, chunks, stands))
            at = heads(key)
            count = np.repeat(np.diff(at), np.diff(at))
            if apart:
                large = np.flatnonzero(count > block)
                for x in np.split(large, heads(key[large])[1:-1]) if len(large) else []:
                    yield from _spread(key[x], doc[x], place[x], stands[x], raw[x], block)
                continue
            small = count <= block
            key, doc, place, raw, stands = (v[small] for v in (key, doc, place, raw, stands))
            yield from _met(linker, (key,), key, doc, place, stands, raw)
        yield from _gathered(copies, size)

    return run


def _spread(key, doc, place, stands, raw, block: int):
    """Every row of one group for each pair of blocks that it is in."""
    blocks = -(-len(key) // block)
    own = (np.arange(len(key)) % blocks).astype(np.int32)
    for k in range(blocks):
        x, y = np.minimum(own, k).astype(np.int32), np.maximum(own, k).astype(np.int32)
        yield pa.RecordBatch.from_arrays([*[pa.array(v) for v in (key, x, y, own, doc, place, stands.astype(np.int32))], _binary(raw)], ["key", "x", "y", "own", "id", "place", "stands", "context"])


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1]), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def _by_blocks(size: int, block: int):
    """What ``_met`` has of pairs of blocks: (key, x, y, own, id, place, stands, context), sorted."""
    linker = Linker(size, block)

    def run(batches):
        for cols in whole(batches, 3):
            key, x, y, own, doc, place = (np.asarray(c) for c in cols[:6])
            stands = np.asarray(cols[6]).astype(np.uint16)
            raw = raw_bytes(cols[7], lower=False)[0].reshape(len(key), -1)
            # all pairs within a block, those of two blocks else
            own = np.where(x == y, np.arange(len(x)), own)
            yield from _met(linker, (key, x, y), key, doc, place, stands, raw, (own,))

    return run


def _joined(lo, hi, gap):
    """Groups of intervals that come sorted by ``lo``."""
    top = np.maximum.accumulate(hi)
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > top[:-1] + gap
    at = np.flatnonzero(new)
    return lo[at], np.maximum.reduceat(hi, at)


def _stretches(a, b, diag, lo, hi, exact, size: int, over: int):
    """Of links those of one diagonal whose runs touch as one, exact and near apart,
    without the near ones that an exact one covers but for ``over`` starts (that much
    says nothing new): (a, b, diag, lo, hi) of the exact, and of the near."""
    order = np.lexsort((lo, diag, b, a))
    a, b, diag, lo, hi, exact = (v[order] for v in (a, b, diag, lo, hi, exact))
    at = heads(a, b, diag)
    head, group = at[:-1], np.repeat(np.arange(len(at) - 1), np.diff(at))
    # places of different groups far from one another
    far = int(hi.max() - min(lo.min(), 0)) + 4 * size
    lo, hi = lo + group * far, hi + group * far
    sure, near = np.flatnonzero(exact), np.flatnonzero(~exact)
    none = np.zeros(0, np.int64)
    (x, y), (p, q) = (_joined(lo[k], hi[k], size) if len(k) else (none, none) for k in (sure, near))
    if len(x) and len(p):
        at = np.maximum(np.searchsorted(x - over, p, side="right") - 1, 0)
        fresh = (p < x[at] - over) | (q > y[at] + over)
        p, q = p[fresh], q[fresh]
    for x, y in ((x, y), (p, q)):
        g = (x + 2 * size) // far
        i = head[g]
        yield a[i], b[i], diag[i], x - g * far, y - g * far


def _runs(n: int, size: int):
    """Of (id, text, places of minima): (id, w, more, start, run) with the 32-bit hashes
    of ``size`` + ``more`` tokens from ``w`` on; from ``start`` on where the text ends
    before.  What the runs about two places have in common comes once."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        tokens, row, _ = shingles(Words(batch.column(1)), n)
        tokens = (mix(tokens) >> _U(32)).astype(np.uint32)
        first = np.searchsorted(row, np.arange(batch.num_rows + 1))
        c = np.asarray(batch.column(2).flatten()).astype(np.int64)
        r = np.repeat(np.arange(batch.num_rows), np.asarray(pc.list_value_length(batch.column(2))))
        ok = first[r + 1] - first[r] >= size
        if not ok.any():
            return None
        r, c = r[ok], c[ok]
        # places of different texts far from one another
        far = int(c.max()) + 4 * size
        last = np.sort(c + r * far)
        w, last = _joined(last - size + 1, last, size)
        r, more = last // far, last - w
        w, room = np.maximum(w - r * far, 0), first[r + 1] - first[r] - size
        start = np.clip(w, 0, room)
        count = size + np.minimum(more, room - start)
        off = np.concatenate([[0], np.cumsum(count)])
        at = np.repeat(first[r] + start - off[:-1], count) + np.arange(off[-1])
        runs = pa.Array.from_buffers(pa.binary(), len(r), [None, pa.py_buffer((4 * off).astype(np.int32).tobytes()), pa.py_buffer(tokens[at].tobytes())])
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(r)), *[pa.array(x.astype(np.int32)) for x in (w, more, start)], runs], ["id", "w", "more", "start", "run"])

    return per_batch(run), "id bigint, w int, more int, start int, run binary"


def _segments(v: np.ndarray, pair: np.ndarray, size: int):
    """(pair and token, first, last) of the starts of runs of ``size`` that hold the token, rising."""
    key = pair << _U(32) | v
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (order[1:] - order[:-1] > size)
    at = np.flatnonzero(new)
    return key[at], order[at] - size + 1, order[np.append(at[1:], len(key)) - 1]


def _jaccards(x: np.ndarray, y: np.ndarray, off: np.ndarray, size: int) -> np.ndarray:
    """Jaccard of the runs of ``size`` tokens from each start on, for many pairs of
    stretches at once: pair k is ``off[k]:off[k + 1]`` of both; 0 where no run fits."""
    pair = np.repeat(np.arange(len(off) - 1), np.diff(off))
    last = off[1:] - size

    def count(of, lo, hi):
        lo, hi = np.maximum(lo, off[of]), np.minimum(hi, last[of])
        ok = lo <= hi
        return np.cumsum(np.bincount(lo[ok], minlength=len(x) + 1) - np.bincount(hi[ok] + 1, minlength=len(x) + 1))[: len(x)]

    (kx, lx, hx), (ky, ly, hy) = (_segments(v.astype(_U), pair.astype(_U), size) for v in (x, y))
    ox, oy = (kx >> _U(32)).astype(np.int64), (ky >> _U(32)).astype(np.int64)
    # every segment of x with those of y of the same token
    first = np.searchsorted(ky, kx)
    many = np.searchsorted(ky, kx, side="right") - first
    i = np.repeat(np.arange(len(kx)), many)
    j = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + first[i]
    both = count(ox[i], np.maximum(lx[i], ly[j]), np.minimum(hx[i], hy[j]))
    return both / np.maximum(count(ox, lx, hx) + count(oy, ly, hy) - both, 1)


def _longest(x: np.ndarray, y: np.ndarray, starts: np.ndarray, size: int, threshold: float):
    """(first start, last start, Jaccard) of the passages that ``starts`` make up:
    whole where they reach the threshold, else halved."""
    p, q = (set(v[starts[0] : starts[-1] + size].tolist()) for v in (x, y))
    both = len(p & q)
    value = round(both / (len(p) + len(q) - both), 6)
    if value >= threshold or len(starts) == 1:
        yield int(starts[0]), int(starts[-1]), value
    else:
        for half in (starts[: len(starts) // 2], starts[len(starts) // 2 :]):
            yield from _longest(x, y, half, size, threshold)


def _passages(value: np.ndarray, off: np.ndarray, size: int, threshold: float):
    """(starts that reach the threshold, pair of each, where those of a passage begin, and end)."""
    good = np.flatnonzero(np.round(value, 6) >= threshold)
    pair = np.searchsorted(off, good, side="right") - 1
    cut = np.flatnonzero((np.diff(good) > size) | (np.diff(pair) > 0)) + 1
    return good, pair, np.append(0, cut)[: len(good)], np.append(cut, len(good))[: len(good)]


def _of_any(x: np.ndarray, y: np.ndarray, off: np.ndarray, size: int, threshold: float):
    """(pair, first start, last start, Jaccard) of the passages of pairs of stretches."""
    value = _jaccards(x, y, off, size)
    good, pair, begin, end = _passages(value, off, size, threshold)
    one = end - begin == 1  # a passage of one run has that run's value
    k, start = pair[begin[one]].tolist(), good[begin[one]]
    out = [(k, s, s, round(v, 6)) for k, s, v in zip(k, (start - off[k]).tolist(), value[start].tolist())]
    for k, i, j in zip(pair[begin[~one]].tolist(), begin[~one].tolist(), end[~one].tolist()):
        s, e = off[k], off[k + 1]
        out += [(k, *passage) for passage in _longest(x[s:e], y[s:e], good[i:j] - s, size, threshold)]
    return [np.array(v) for v in zip(*out)]


def _of_distinct(x: np.ndarray, y: np.ndarray, off: np.ndarray, size: int, threshold: float):
    """The same of stretches none of which has a token twice: what agrees in place is
    counted, only the rest is looked up, and all passages are halved at once."""
    pair = np.repeat(np.arange(len(off) - 1), np.diff(off))
    same = np.concatenate([[0], np.cumsum(x == y)])
    rest = np.flatnonzero(x != y)
    kx, ky = (pair[rest].astype(_U) << _U(32) | v[rest] for v in (x, y))
    ox, oy = np.argsort(kx), np.argsort(ky)
    at = np.minimum(np.searchsorted(ky[oy], kx[ox]), max(len(oy) - 1, 0))
    hit = np.flatnonzero(ky[oy][at] == kx[ox])
    # a token that both have, in other places: the lower and the higher
    i, j = rest[ox[hit]], rest[oy[at[hit]]]
    low, high = np.minimum(i, j), np.maximum(i, j)
    order = np.argsort(low)
    low, high = low[order], high[order]
    lo, hi = np.maximum(high - size + 1, off[pair[low]]), np.minimum(low, off[pair[low] + 1] - size)
    lo, hi = lo[lo <= hi], hi[lo <= hi]
    both = np.cumsum(np.bincount(lo, minlength=len(x) + 1) - np.bincount(hi + 1, minlength=len(x) + 1))[: len(x)]
    start = np.arange(len(x))
    both = both + same[np.minimum(start + size, len(x))] - same[:-1]
    good, of, begin, end = _passages(np.where(start <= off[pair + 1] - size, both / (2 * size - both), 0), off, size, threshold)
    out = []
    while len(begin):
        s, last = good[begin], good[end - 1]
        first, e = np.searchsorted(low, s), last + size
        many = np.searchsorted(low, e) - first
        k = np.repeat(np.arange(len(s)), many)
        at = np.arange(len(k)) + np.repeat(first - np.cumsum(many) + many, many)
        both = same[e] - same[s] + np.bincount(k[high[at] < e[k]], minlength=len(s))
        value = np.round(both / (2 * (e - s) - both), 6)
        done = (value >= threshold) | (end - begin == 1)
        k = of[begin[done]]
        out.append((k, s[done] - off[k], last[done] - off[k], value[done]))
        begin, end = begin[~done], end[~done]
        half = begin + (end - begin) // 2
        begin, end = np.concatenate([begin, half]), np.concatenate([half, end])
    return [np.concatenate(v) for v in zip(*out)]


def _repeated(tokens: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Of every token the place before where its run has it, or -1."""
    out = np.full(len(tokens), -1)
    for k in np.split(np.arange(len(off) - 1), heads(off[1:] // _AT_ONCE)[1:-1]):
        base, end = off[k[0]], off[k[-1] + 1]
        key = np.repeat(k.astype(_U), np.diff(off[k[0] : k[-1] + 2])) << _U(32) | tokens[base:end]
        order = np.argsort(key, kind="stable")
        again = np.flatnonzero(key[order][1:] == key[order][:-1])
        out[base + order[again + 1]] = base + order[again]
    return out


def _verified(diag, sa, sb, at_a, at_b, na, nb, tokens, before, size: int, words: int, threshold: float):
    """Of pairs of stretches, of ``na`` and ``nb`` tokens from ``at_a`` and ``at_b`` on,
    every passage: (pair, start_a, end_a, start_b, end_b, Jaccard)."""
    # on one diagonal, where the texts' ends leave a run of it
    at = np.maximum(sa, sb - diag)
    fit = np.minimum(na - (at - sa), nb - (at + diag - sb)) >= size
    da, db = np.where(fit, at - sa, 0), np.where(fit, at + diag - sb, 0)
    n = np.minimum(na - da, nb - db)
    off = np.concatenate([[0], np.cumsum(n)])
    own = np.repeat(np.arange(len(n)), n)
    i, j = (np.arange(off[-1]) + np.repeat(v - off[:-1], n) for v in (at_a + da, at_b + db))
    x, y = tokens[i], tokens[j]
    twice = np.logical_or.reduceat((before[i] >= (at_a + da)[own]) | (before[j] >= (at_b + db)[own]), off[:-1])
    p, q, out = sa + da, sb + db, []
    for kind, passages in ((~twice, _of_distinct), (twice, _of_any)):
        pairs, of = np.flatnonzero(kind), kind[own]
        if len(pairs) and (got := passages(x[of], y[of], np.concatenate([[0], np.cumsum(n[pairs])]), size, threshold)):
            k, first, last, value = got
            k = pairs[k]
            out.append((k, p[k] + first, p[k] + last + words, q[k] + first, q[k] + last + words, value))
    return [np.concatenate(v) for v in zip(*out)]


class Runs:
    """Tokens of documents by (id, start); a run that comes for several block pairs counts once."""

    def __init__(self, doc, start, runs):
        self.data, off = raw_bytes(runs, lower=False)
        self.data, off = self.data.view(np.uint32), off // 4
        self.before = _repeated(self.data, off)
        order = np.lexsort((start, doc))
        self.doc, self.start, self.at, self.n = doc[order], start[order], off[:-1][order], np.diff(off)[order]
        self.ids = np.unique(doc)
        self.key = np.searchsorted(self.ids, self.doc) << 40 | self.start

    def find(self, doc, lo, more, size):
        """(is there any, start, where it is in ``data``, tokens) of runs that start from ``lo`` on."""
        of = np.minimum(np.searchsorted(self.ids, doc), len(self.ids) - 1)
        k = np.maximum(np.searchsorted(self.key, of << 40 | np.maximum(lo, 0), side="right") - 1, 0)
        start = np.clip(lo, self.start[k], self.start[k] + self.n[k] - size)
        n = size + np.minimum(more, self.start[k] + self.n[k] - size - start)
        return self.doc[k] == doc, start, self.at[k] + start - self.start[k], n


def _settle(size: int, words: int, threshold: float, block: int, part: int, each: bool):
    """Of block pairs (root, x, y, own, and the columns of ``_FOUND``) every passage, or,
    unless ``each``, of every document the number it's linked with and the ranges, and of
    every link, as far as it joins any, the ends.  Links are made here, of ``part``
    documents with as many at a time, and go no further."""
    linker = Linker(size, block)
    over = int(size * (1 - threshold) / (1 + threshold) + 1e-9)

    def parts(group, own, doc, e_group, e_a, e_b):
        """(records, what those of a pair differ in, exact links): of small groups many at
        once, of large ones the pairs of two parts; every pair of documents comes once."""
        # documents of a group by number, and the part of each
        every = np.stack([np.concatenate(v) for v in ((group, e_group, e_group), (doc, e_a, e_b))])
        if not every.size:
            return
        order = np.lexsort(every[::-1])
        at = heads(*every[:, order])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.repeat(np.arange(len(at) - 1), np.diff(at))
        g = every[0, order][at[:-1]]
        count = np.bincount(g)
        of = ((np.arange(len(g)) - np.searchsorted(g, g)) // part)[rank]
        mine, ea, eb = np.split(of, [len(doc), len(doc) + len(e_a)])
        cost = count * (np.bincount(group, minlength=len(count)) + 1)
        lot = np.cumsum(np.where(count <= part, cost, 0)) // _AT_ONCE
        lot[count > part] = -1
        for h in np.unique(lot[lot >= 0]).tolist():
            i, k = np.flatnonzero(lot[group] == h), np.flatnonzero(lot[e_group] == h)
            yield i, (own[i],), k
        for h in np.flatnonzero(count > part).tolist():
            i, k = np.flatnonzero(group == h), np.flatnonzero(e_group == h)
            subs = -(-int(count[h]) // part)
            rows = [i[mine[i] == p] for p in range(subs)]
            code = np.minimum(ea[k], eb[k]) * subs + np.maximum(ea[k], eb[k])
            k, code = k[np.argsort(code, kind="stable")], np.sort(code)
            for p in range(subs):
                for q in range(p, subs):
                    both = np.sort(np.concatenate([rows[p], rows[q]])) if q > p else rows[p]
                    exact = k[np.searchsorted(code, p * subs + q) : np.searchsorted(code, p * subs + q, side="right")]
                    yield both, (mine[both], own[both])[p == q :], exact

    def found(cols):
        kind = np.asarray(cols[4])
        number = lambda k, at: np.asarray(pc.fill_null(cols[k].take(pa.array(at)), 0)).astype(np.int64)
        group = np.repeat(np.arange(len(at := heads(*(np.asarray(c) for c in cols[:3]))) - 1), np.diff(at))
        one = np.asarray(cols[1]) == np.asarray(cols[2])
        # all pairs within a block, those of two blocks else
        own = np.where(one, -1 - np.arange(len(one)), np.asarray(pc.fill_null(cols[3], 0)))
        run, row, sure = (np.flatnonzero(kind == k) for k in (_RUN, _ROW, _EXACT))
        doc, key, place = (number(k, row) for k in (5, 6, 7))
        # pairs of blocks of a large group have a record several times
        order = np.lexsort((place, doc, key, group[row]))
        order = order[heads(*(v[order] for v in (group[row], key, doc, place)))[:-1]] if len(row) else order
        row, doc, key, place = row[order], doc[order], key[order], place[order]
        a, b, diag, lo, hi = (number(k, sure) for k in (5, 6, 7, 8, 9))
        runs = Runs(number(5, run), number(7, run), cols[10].take(pa.array(run))) if len(run) else None
        stands = number(8, row).astype(np.uint16)
        chunks = _unpacked(raw_bytes(cols[10].take(pa.array(row)), lower=False)[0].reshape(len(row), 3 * _SIDE))
        plain = _plain(chunks, size)
        for i, apart, k in parts(group[row], own[row], doc, group[sure], a, b):
            links = [(a[k], b[k], diag[k], lo[k], hi[k])]
            links += [linker.near(doc[i], place[i], p, q) for p, q in linker.candidates((group[row][i], key[i]), doc[i], place[i], chunks[i], stands[i], apart, plain=plain[i])]
            exact = np.arange(sum(len(x[0]) for x in links)) < len(k)
            if not len(exact):
                continue
            certain, near = _stretches(*(np.concatenate(x) for x in zip(*links)), exact, size, over)
            got = [(*certain[:2], certain[3], certain[4] + words, certain[3] + certain[2], certain[4] + certain[2] + words, np.ones(len(certain[0])))]
            length = np.cumsum(near[4] - near[3] + size) // _AT_ONCE if runs else near[0][:0]
            for s in np.split(np.arange(len(length)), heads(length)[1:-1]) if len(length) else []:
                u, v, d, x, y = (c[s] for c in near)
                (ok, sa, at_a, na), (ok_b, sb, at_b, nb) = runs.find(u, x, y - x, size), runs.find(v, x + d, y - x, size)
                ok = np.flatnonzero(ok & ok_b)
                if not len(ok):
                    continue
                u, v, *rest = (c[ok] for c in (u, v, d, sa, sb, at_a, at_b, na, nb))
                if passages := _verified(*rest, runs.data, runs.before, size, words, threshold):
                    which, *places, value = passages
                    got.append((u[which], v[which], *places, value))
            yield tuple(np.concatenate(c) for c in zip(*got))

    def run(batches):
        for cols in whole(batches, 3, 1 << 14):
            for a, b, *places, value in found(cols):
                if not len(a):
                    continue
                if each:
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *[pa.array(v.astype(np.int32)) for v in places], pa.array(value)], NAMES)
                    continue
                # a pair is in one part only, so these counts add up
                pairs = np.stack([a, b], axis=1)[np.lexsort((b, a))]
                pairs = pairs[heads(*pairs.T)[:-1]]
                docs, links = np.unique(pairs, return_counts=True)
                yield _partial("links", docs, links)
                doc, lo, hi = (np.concatenate(v) for v in ((a, b), places[::2], places[1::2]))
                order = np.lexsort((hi, lo, doc))
                doc, lo, hi = doc[order], lo[order], hi[order]
                of = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]])) * (int(hi.max()) + 2)
                top = np.maximum.accumulate(hi + of)
                at = np.flatnonzero(np.concatenate([[True], (lo + of)[1:] > top[:-1]]))
                yield _partial("range", doc[at], lo[at], np.maximum.reduceat(hi + of, at) - of[at])
                yield _partial("join", *contract(pairs[:, 0], pairs[:, 1]))

    return run


def _partial(kind: str, doc, x, y=None) -> pa.RecordBatch:
    y = pa.nulls(len(doc), pa.int64()) if y is None else pa.array(y.astype(np.int64))
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(doc), pa.string()), pa.array(doc), pa.array(x.astype(np.int64)), y], ["kind", "doc_id", "x", "y"])


NAMES = ["doc_a", "doc_b", "start_a", "end_a", "start_b", "end_b", "jaccard"]
SCHEMA = "doc_a bigint, doc_b bigint, start_a int, end_a int, start_b int, end_b int, jaccard double"


def _placed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, n: int = 5, hashes: int = 2,
    threshold: float = 0.8, block: int = 2048, block_tokens: int = 4_000_000, max_broadcast: int = 2_000_000, part: int = 256, each: bool = True,
) -> DataFrame:
    size = min_words - n + 1
    if not 1 <= size <= _SURE * _CHUNK:
        raise ValueError(f"min_words must be from {n} to {_SURE * _CHUNK + n - 1}")
    slim = clean_ids(docs, id_col, text_col).where("id is not null")

    def find(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        got = records(batch.column(1), n, size, hashes)
        if got is None:
            return None
        row, key, place, context = got
        return pa.RecordBatch.from_arrays([pa.array(key), batch.column(0).take(pa.array(row)), pa.array(place), _binary(context)], ["key", "id", "place", "context"])

    found = slim.mapInArrow(per_batch(find), "key bigint, id bigint, place bigint, context binary")
    met = found.repartition("key").sortWithinPartitions("key", "context", "id", "place")
    # by number: what is few bytes may be many comparisons, so Spark mustn't merge parts by their bytes
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    apart = met.mapInArrow(_by_key(size, block, True), _APART).repartition(tasks, "key", "x", "y").sortWithinPartitions("key", "x", "y", "id", "place")
    got = stored(met.mapInArrow(_by_key(size, block, False), _FOUND).unionByName(apart.mapInArrow(_by_blocks(size, block), _FOUND)))
    rows = got.where(F.col("kind") == _ROW).withColumnRenamed("p", "id")
    exact = got.where(F.col("kind") == _EXACT)

    # only the runs that are to be compared leave the texts, as hashes of their tokens
    wanted = stored(rows.select("id", F.shiftright("r", 8).cast("int").alias("at")).groupBy("id").agg(F.collect_set("at").alias("at"), F.count(F.lit(1)).alias("records")))
    cut, schema = _runs(n, size)
    # rows that repeat an id are one document: of other texts, the one whose run is least
    runs = some(slim, wanted.drop("records"), max_broadcast, F.size("at") + 1).select("id", "text", "at").mapInArrow(cut, schema)
    runs = stored(runs.groupBy("id", "w", "more").agg(F.min(F.struct("start", "run")).alias("r")).select("id", "more", "r.start", "r.run"))

    # every component in blocks of about ``block_tokens``; runs and records go once to each pair of blocks that they are in
    root = components(got.where(F.col("kind") >= _EXACT), "p", "q")
    root = root.unionByName(root.select(F.col("root").alias("id"), "root").distinct())
    tokens = runs.groupBy("id").agg(F.sum(size + F.col("more")).alias("tokens")).join(wanted.select("id", "records"), "id")
    sized = root.join(tokens, "id", "left").withColumn("tokens", F.coalesce(F.col("tokens") + 64 * F.col("records"), F.lit(0)) + 16)
    blocks = sized.groupBy("root").agg(F.ceil(F.sum("tokens") / block_tokens).cast("int").alias("blocks"))
    sized = stored(sized.join(blocks, "root").select("id", "root", "blocks", F.pmod(F.xxhash64("id", F.lit(2)), F.col("blocks")).cast("int").alias("own")))
    to = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("own", k).alias("x"), F.greatest("own", k).alias("y")))
    none = F.lit(None)
    runs = runs.select(F.lit(_RUN).alias("kind"), "id", none.cast("bigint").alias("q"), F.col("start").cast("bigint").alias("r"), none.cast("int").alias("lo"), none.cast("int").alias("hi"), F.col("run").alias("data"))
    moved = rows.unionByName(runs).join(sized, "id").withColumn("to", F.explode(to)).select("root", "to.x", "to.y", "own", "kind", F.col("id").alias("p"), "q", "r", "lo", "hi", "data")
    pairs = exact.join(sized.select(F.col("id").alias("p"), "root", F.col("own").alias("m")), "p").join(sized.select(F.col("id").alias("q"), F.col("own").alias("n")), "q")
    pairs = pairs.select("root", F.least("m", "n").alias("x"), F.greatest("m", "n").alias("y"), none.cast("int").alias("own"), "kind", "p", "q", "r", "lo", "hi", "data")
    placed = moved.unionByName(pairs).repartition(tasks, "root", "x", "y").sortWithinPartitions("root", "x", "y")
    return placed.mapInArrow(_settle(size, min_words, threshold, block, part, each), SCHEMA if each else "kind string, doc_id bigint, x bigint, y bigint")


def passages(docs: DataFrame, **options) -> DataFrame:
    """Passages of ``min_words`` words or more that documents share, see above.

    The ids and starts of runs to be compared are broadcast up to ``max_broadcast``
    values (counted first); more are joined by a shuffle.  ``options`` are those of
    ``_placed``: id_col, text_col, min_words, n, hashes, threshold, block, block_tokens, part.
    """
    return _placed(docs, **options)


def repeats(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, class_id, links, ranges), see above; ``options`` are those of ``passages``."""
    got = stored(_placed(docs, each=False, **options))
    links = got.where("kind = 'links'").groupBy("doc_id").agg(F.sum("x").cast("int").alias("links"))
    # ranges of one document that touch, as one
    line = Window.partitionBy("doc_id").orderBy("start", "end")
    spans = got.where("kind = 'range'").select("doc_id", F.col("x").cast("int").alias("start"), F.col("y").cast("int").alias("end"))
    spans = spans.withColumn("fresh", (F.col("start") > F.coalesce(F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("int"))
    spans = spans.withColumn("part", F.sum("fresh").over(line)).groupBy("doc_id", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ranges"))
    root = components(got.where("kind = 'join'"), "doc_id", "x").withColumnsRenamed({"id": "doc_id", "root": "class_id"})
    return links.join(spans, "doc_id").join(root, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), "links", "ranges")
