"""Benchmark decontamination (9): pigeonhole edit matching.

An item of n normalised characters may occur with up to e = floor(n *
max_error_rate) edits.  Cut into e + 1 pieces, at least one piece must occur
unchanged, so an Aho-Corasick pass over each whole text finds every candidate;
Myers' bit-parallel distance then settles it exactly.  No candidate is capped.
Items shorter than ``min_chars`` (normalised) match as whole words and without
an edit, as with edits, or within a word, they'd match prose by chance.

Texts are compared lower-cased, with each run of other than letters and digits
as one blank.  Defined results: null and empty texts and items, and those without
a letter or digit, match nothing; repeated documents are reported as often as they
occur, repeated items once;
a pair is reported once per document row, at its least distance, the first
such place; an empty benchmark or table gives no rows; rows with a null id
take part and keep the null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwave.llm.common import WORD, per_batch, raw_bytes

SCHEMA = "doc_id bigint, item_id bigint, distance int, start int, end int"


def normalise(col: pa.Array) -> tuple[bytes, np.ndarray]:
    """Every row lower-cased, non-word runs as one blank, in one buffer; rows
    are framed by newlines, which no pattern holds."""
    data, off = raw_bytes(col)
    rows = len(off) - 1
    x = np.where(WORD[data], data, np.uint8(32))
    row = np.repeat(np.arange(rows), np.diff(off))
    keep = np.ones(len(x), bool)
    if len(x):
        first = np.ones(len(x), bool)
        first[1:] = row[1:] != row[:-1]
        keep[1:] = (x[1:] != 32) | (x[:-1] != 32) | first[1:]
        keep &= ~(first & (x == 32))
        last = np.ones(len(x), bool)
        last[:-1] = row[1:] != row[:-1]
        keep &= ~(last & (x == 32))
    x, row = x[keep], row[keep]
    count = np.bincount(row, minlength=rows) + 1
    at = np.concatenate([[0], np.cumsum(count)])
    out = np.full(at[-1], 10, np.uint8)
    out[np.arange(len(x)) + row] = x
    return out.tobytes(), at


def norm(text: str | None) -> str:
    body, at = normalise(pa.array([text], pa.string()))
    return body[:-1].decode("utf-8", "replace")


def pieces(text: str, errors: int) -> list[tuple[int, str]]:
    """``errors`` + 1 consecutive pieces of all but equal length, with offsets."""
    cut = [len(text) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, text[a:b]) for a, b in zip(cut, cut[1:])]


def myers(pattern: str, text: str, limit: int) -> tuple[int, int]:
    """(least distance of ``pattern`` to a substring of ``text``, its end); the
    earliest end of the least; limit + 1 and -1 where it's over ``limit``."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        peq[ch] = peq.get(ch, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, limit + 1, -1
    for j, ch in enumerate(text):
        eq = peq.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv
        if score < best:
            best, end = score, j + 1
            if not best:
                break
    return best, end


class Index:
    def __init__(self, items: list[tuple[int, str]], rate: float, min_chars: int = 0):
        import ahocorasick

        self.items, self.budget = items, [int(len(t) * rate) if len(t) >= min_chars else 0 for _, t in items]
        self.short = [len(t) < min_chars for _, t in items]
        by: dict[str, list[tuple[int, int]]] = {}
        for i, (_, t) in enumerate(items):
            for at, piece in pieces(t, self.budget[i]):
                by.setdefault(piece, []).append((i, at))
        self.auto = ahocorasick.Automaton()
        for piece, where in by.items():
            self.auto.add_word(piece, (len(piece), where))
        self.auto.make_automaton()

    def find(self, col: pa.Array) -> list[tuple[int, int, int, int, int]]:
        """(row, item, distance, start, end) - offsets in the normalised row."""
        if not self.items:
            return []
        body, at = normalise(col)
        # one byte, one character: offsets stay byte offsets on both sides
        text = body.decode("latin-1")
        diagonals: dict[tuple[int, int], list[int]] = {}
        for last, (size, where) in self.auto.iter(text):
            for i, offset in where:
                if self.short[i] and (last >= size and text[last - size] not in " \n" or text[last + 1] not in " \n"):
                    continue
                diagonals.setdefault((last - size + 1, i), []).append(offset)
        if not diagonals:
            return []
        spots: dict[tuple[int, int], set[int]] = {}
        places = np.array([p for p, _ in diagonals], np.int64)
        rows = np.searchsorted(at, places, side="right") - 1
        for (row, ((place, i), offsets)) in zip(rows.tolist(), diagonals.items()):
            spots.setdefault((row, i), set()).update(place - o for o in offsets)
        found = []
        for (row, i), begins in spots.items():
            item, e = self.items[i][1], self.budget[i]
            lo, hi = int(at[row]), int(at[row + 1]) - 1
            best, reach = None, -1
            order = sorted(begins)
            k = 0
            while k < len(order):
                a = order[k]
                while k + 1 < len(order) and order[k + 1] - order[k] <= 2 * e:  # overlapping searches run as one
                    k += 1
                b = order[k]
                k += 1
                left, right = max(lo, a - e), min(hi, b + len(item) + e)
                if right - left < len(item) - e:
                    continue
                window = text[left:right]
                exact = window.find(item)
                d, end = (0, exact + len(item)) if exact >= 0 else myers(item, window, e)
                if d <= e and (best is None or d < best[0]):
                    best = (d, left + end - lo)
                if best and not best[0]:
                    break
            if best:
                d, end = best
                back = myers(item[::-1], text[max(lo, lo + end - len(item) - d) : lo + end][::-1], d)[1] if d else len(item)
                found.append((row, i, d, end - back, end))
        return found


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        body, at = normalise(batch.column(1))
        text = [body[a : b - 1].decode("latin-1") for a, b in zip(at[:-1], at[1:])]
        keep = [i for i, t in enumerate(text) if t]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array([text[i] for i in keep], pa.string())], ["item_id", "text"]) if keep else None

    slim = benchmark.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(per_batch(run), "item_id bigint, text string").distinct()


def matches(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
    item_text: str = "text", max_error_rate: float = 0.05, min_chars: int = 40, shard_bytes: int = 8 << 20,
) -> DataFrame:
    """(doc_id, item_id, distance, start, end) of every match within budget.

    The benchmark's size is measured first: up to ``shard_bytes`` of item text
    go to the executors as one automaton; a larger benchmark is cut into that
    many hash shards, each searched in its own pass, with the same result.
    """
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for own in _shards(benchmark, item_id, item_text, shard_bytes):
        part = _search(slim, own, max_error_rate, min_chars)
        out = part if out is None else out.unionByName(part)
    return out


def _shards(benchmark: DataFrame, id_col: str, text_col: str, shard_bytes: int):
    """The items, shard by shard, those with a null id last."""
    items = _items(benchmark, id_col, text_col)
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    for s in range(shards):
        own = items.where(F.pmod(F.xxhash64("text"), F.lit(shards)) == s) if shards > 1 else items
        yield sorted(((r[0], r[1]) for r in own.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def _search(slim: DataFrame, items: list[tuple[int, str]], rate: float, min_chars: int) -> DataFrame:
    shared = slim.sparkSession.sparkContext.broadcast(items)
    built: list[Index] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        if not built:
            built.append(Index(shared.value, rate, min_chars))
        hits = built[0].find(batch.column(1))
        if not hits:
            return None
        ids = batch.column(0).take(pa.array([h[0] for h in hits], pa.int64()))
        cols = [ids, pa.array([shared.value[h[1]][0] for h in hits], pa.int64())] + [pa.array([h[k] for h in hits], pa.int32()) for k in (2, 3, 4)]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "item_id", "distance", "start", "end"])

    return slim.mapInArrow(per_batch(run), SCHEMA)


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
    item_text: str = "text", max_error_rate: float = 0.05, min_chars: int = 40, shard_bytes: int = 8 << 20,
) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item, whatever their id."""
    names, at = docs.columns, docs.columns.index(text_col)
    out = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    for own in _shards(benchmark, item_id, item_text, shard_bytes):
        out = out.mapInArrow(per_batch(_clean(out.sparkSession.sparkContext.broadcast(own), at, max_error_rate, min_chars), text=at), out.schema)
    return out.toDF(*names)


def _clean(shared, at: int, rate: float, min_chars: int):
    built: list[Index] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not built:
            built.append(Index(shared.value, rate, min_chars))
        keep = np.ones(batch.num_rows, bool)
        keep[[h[0] for h in built[0].find(batch.column(at))]] = False
        return batch.filter(pa.array(keep))

    return run
