"""Shared plumbing: lineage cutting, Arrow text kernels and small helpers.

All text kernels work on whole Arrow string buffers, so the cost per byte is a
handful of NumPy passes and never a Python call per word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwave.storage import discard, materialise, shared_dir, stored

__all__ = ["discard", "materialise", "shared_dir", "stored"]

_U = np.uint64


def reachable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it; a
    cluster without that path gets the package by --py-files."""
    home = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if home not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [home, env.get("PYTHONPATH", "")]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], max_bytes: int = 1 << 20, text: int = 1):
    """Lift ``fn`` over mapInArrow batches, re-cut so that column ``text`` holds
    about ``max_bytes`` per call (one longer text still goes through whole)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in cuts(batch.column(text), max_bytes):
                out = fn(batch.slice(a, b - a))
                if out is not None and out.num_rows:
                    yield out

    return run


def cuts(col: pa.Array, max_bytes: int) -> Iterator[tuple[int, int]]:
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)) if len(col) else np.zeros(0, np.int64)
    at = 0
    while at < len(col):
        base = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, base + max_bytes, side="right")))
        yield at, end
        at = end


def raw_bytes(col: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(all UTF-8 bytes of the column, row offsets); nulls read as empty."""
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    col = pc.fill_null(col.cast(pa.large_binary()), b"") if pa.types.is_binary(col.type) else pc.fill_null(col.cast(pa.large_string()), "")
    if lower:
        col = pc.utf8_lower(col)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    body = col.buffers()[2]
    data = np.frombuffer(body, np.uint8)[off[0] : off[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


WORD = np.zeros(256, bool)
WORD[128:] = True
for _r in (b"az", b"AZ", b"09"):
    WORD[_r[0] : _r[1] + 1] = True

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_P = _U(0x9E3779B97F4A7C15)
_PINV = _U(pow(int(_P), -1, 1 << 64))
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = 1 << int(n).bit_length()
        _pow, _inv = np.full(size, _P), np.full(size, _PINV)
        _pow[0] = _inv[0] = 1
        np.cumprod(_pow, out=_pow)
        np.cumprod(_inv, out=_inv)
    return _pow, _inv


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Words:
    """Words of a column: ``hash``, ``row``, byte ``start``/``end`` (within the
    lower-cased column buffer), and ``first`` with row i's words at
    ``first[i]:first[i+1]``."""

    def __init__(self, col: pa.Array, lower: bool = True):
        data, off = raw_bytes(col, lower)
        n, rows = len(data), len(off) - 1
        self.off, self.data = off, data
        w = WORD[data]
        begin, close = w.copy(), w.copy()
        if n:
            begin[1:] &= ~w[:-1]
            close[:-1] &= ~w[1:]
            inner = off[(off > 0) & (off < n)]
            begin[inner] = w[inner]
            close[inner - 1] = w[inner - 1]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(close) + 1
        power, inverse = powers(n + 1)
        acc = _BYTE[data]
        acc *= power[:n]
        np.cumsum(acc, out=acc)
        h = acc[self.end - 1] - np.where(self.start > 0, acc[np.maximum(self.start - 1, 0)], _U(0)) if n else np.zeros(0, np.uint64)
        h *= inverse[self.start]
        self.hash = mix(h)
        self.row = np.searchsorted(off, self.start, side="right") - 1
        self.first = np.searchsorted(self.row, np.arange(rows + 1))


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, index of first word) of every run of ``n`` words in a row.

    A row of 1..n-1 words gives the one shingle of all its words; a row without
    words gives none.
    """
    k = len(w.hash) - n + 1
    q, power = _U(0xD6E8FEB86659FD93), _U(1)
    if k > 0:
        acc = np.zeros(k, np.uint64)
        for j in range(n):
            acc += w.hash[j : j + k] * power
            power = _U(int(power) * int(q) & (2**64 - 1))
        at = np.flatnonzero(w.row[:k] == w.row[n - 1 : n - 1 + k])
        sh, row = mix(acc[at]), w.row[:k][at]
    else:
        at, sh, row = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = []
        for r in short.tolist():
            acc, power = 0, 1
            for x in w.hash[w.first[r] : w.first[r + 1]].tolist():
                acc, power = (acc + x * power) & (2**64 - 1), power * int(q) & (2**64 - 1)
            extra.append(acc)
        sh = np.concatenate([sh, mix(np.array(extra, np.uint64) ^ _U(0x5851F42D4C957F2D))])
        row, at = np.concatenate([row, short]), np.concatenate([at, w.first[short]])
        order = np.lexsort((at, row))
        sh, row, at = sh[order], row[order], at[order]
    return sh, row, at


def clean_ids(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id bigint, text string) of the rows that can take part in a search."""
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))


def _slot(bits: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(bits))


def _marked(ids: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of ``bits`` bits, so of a fixed size, with those that ``ids`` hash to."""
    slot = _slot(bits) + 1  # these functions count from one
    parts = ids.groupBy(F.bitmap_bucket_number(slot).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("b")).collect()
    out = np.zeros((-(-bits // 32768), 4096), np.uint8)
    for r in parts:
        out[r["n"] - 1] = np.frombuffer(r["b"], np.uint8)
    return out.ravel()


def _perhaps(docs: DataFrame, ids: DataFrame, bits: int, keep: bool = True) -> DataFrame:
    """The rows of ``docs`` whose id may be (or, without ``keep``, can't be) among
    ``ids``, told by a broadcast bitmap; null ids can't."""
    shared = docs.sparkSession.sparkContext.broadcast(_marked(ids, bits))
    names = [f"c{i}" for i in range(len(docs.columns))]

    def run(batches):
        for batch in batches:
            slot = np.asarray(pc.fill_null(batch.column(len(names)), -1))
            hit = (slot >= 0) & (shared.value[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 == 1)
            out = batch.select(range(len(names))).filter(pa.array(hit == keep))
            if out.num_rows:
                yield out

    slim = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)], F.when(F.col("id").isNotNull(), _slot(bits)).alias("slot"))
    return slim.mapInArrow(run, slim.drop("slot").schema).toDF(*docs.columns)


def some(docs: DataFrame, wanted: DataFrame, most: int, size: Column | None = None, bits: int = 1 << 27) -> DataFrame:
    """The rows of ``docs`` that ``wanted`` has the id of, with its columns; ``wanted``,
    one row an id, is broadcast up to ``most`` values (counted; ``size`` has those of a
    row, else it's one).  Beyond, both are shuffled, but of ``docs`` only the rows that a
    bitmap of ``bits`` bits doesn't rule out."""
    values = wanted.agg(F.sum(size if size is not None else F.lit(1))).first()[0] or 0
    if values <= most:
        return docs.join(F.broadcast(wanted), "id")
    return _perhaps(docs, wanted.select("id"), bits).join(wanted, "id")


def drop_ids(docs: DataFrame, id_col: str, gone: DataFrame, most: int = 2_000_000, bits: int = 1 << 27) -> DataFrame:
    """``docs`` without the rows whose id is in ``gone`` (id bigint), which is broadcast
    up to ``most`` rows (counted).  Beyond, it's shuffled, with only the rows of ``docs``
    that a bitmap doesn't rule out.  Null ids stay."""
    gone = stored(gone.select("id").distinct())
    names = docs.columns
    out = docs.select(F.col(id_col).cast("bigint").alias("id"), *[F.col(f"`{c}`").alias(f"own{i}") for i, c in enumerate(names)])
    if gone.count() <= most:
        out = out.join(F.broadcast(gone), "id", "left_anti")
    else:
        # each branch reads its own part of the table
        out = _perhaps(out, gone, bits, False).unionByName(_perhaps(out, gone, bits).join(gone, "id", "left_anti"))
    return out.drop("id").toDF(*names)


def whole(batches: Iterator[pa.RecordBatch], keys: int, least: int = 0) -> Iterator[list[pa.Array]]:
    """Of batches sorted by their first ``keys`` columns, all columns of complete
    groups, ``least`` rows or more at once."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(k)[batch.num_rows - 1] for k in range(keys)]
        same = np.ones(batch.num_rows, bool)
        for k in range(keys):
            same &= np.asarray(batch.column(k)) == last[k].as_py()
        cut = batch.num_rows - int(same.sum())
        if cut and rows + cut >= least:  # the last group may go on in the next batch
            yield _joined([*held, batch.slice(0, cut)])
            held, rows = [batch.slice(cut)], batch.num_rows - cut
        else:
            held.append(batch)
            rows += batch.num_rows
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> list[pa.Array]:
    return [pa.concat_arrays([b.column(k) for b in held]) for k in range(held[0].num_columns)]


def heads(*cols: np.ndarray) -> np.ndarray:
    """Where a new group begins, and the end, of sorted columns."""
    new = np.zeros(len(cols[0]) + 1, bool)
    new[0] = new[-1] = True
    for c in cols:
        new[1:-1] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def pack_lists(values: np.ndarray, off: np.ndarray) -> pa.Array:
    """Slices of ``values`` as binary."""
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer((off * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def lowest(df: DataFrame, by: str, hash_col: str, most: int) -> DataFrame:
    """Of every value of ``by`` the ``most`` rows of lowest ``hash_col``, rows that
    agree in it counted once.  Every task sends ``most`` hashes of a value at most
    (Spark limits a rank within its window before it shuffles)."""
    rank = F.dense_rank().over(Window.partitionBy(by).orderBy(hash_col))
    last = df.select(by, hash_col).withColumn("__rank", rank).where(F.col("__rank") <= most).groupBy(by).agg(F.max(hash_col).alias("__last"))
    return df.join(F.broadcast(last), by).where(F.col(hash_col) <= F.col("__last")).drop("__last").dropDuplicates([by, hash_col])
