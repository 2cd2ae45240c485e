"""Best-fit packing (10): bound-certified repacking of documents into sequences.

A document of ``size`` tokens (by default UTF-8 bytes plus one end mark) gives
full chunks of ``capacity`` tokens, each a bin of its own, and one remainder.
Remainders are hashed over partitions and packed by best-fit decreasing; dual
feasible functions give each partition a lower bound on its bins.  A partition
whose bins equal its bound is certified and left.  Those with a gap keep their
full bins and exchange the documents of all others: these are hashed anew over
fewer partitions and packed again, until nothing is gained.  The exchange is taken only where it needs fewer bins than before.

Defined results: a null or empty text has size 1 (its end mark); a null id is
packed and keeps the null; repeated rows are packed as often as they occur;
equal sizes go by id, then chunk, then row; an empty table gives no rows.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwave.llm.common import materialise

SCHEMA = "doc_id bigint, row bigint, chunk int, size int, part bigint, bin bigint, free int, bins bigint, lower_bound bigint"


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each of ``sizes``, which must be in falling order."""
    out = np.empty(len(sizes), np.int64)
    levels: list[int] = []  # distinct free amounts, rising
    open_at: dict[int, list[int]] = {}
    n = 0
    for i, s in enumerate(sizes.tolist()):
        k = bisect_left(levels, s)
        if k == len(levels):
            b, free, n = n, capacity, n + 1
        else:
            free = levels[k]
            b = open_at[free].pop()
            if not open_at[free]:
                del levels[k], open_at[free]
        out[i] = b
        left = free - s
        if left:
            if left not in open_at:
                open_at[left] = []
                insort(levels, left)
            open_at[left].append(b)
    return out


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Largest bound of two families of dual feasible functions: thresholds
    (items over C - e count as C, items under e as 0) and the roundings u(k)."""
    if not len(sizes):
        return 0
    s = np.sort(sizes.astype(np.int64))
    total = np.concatenate([[0], np.cumsum(s)])
    best = -(-int(total[-1]) // capacity)
    eps = np.unique(np.concatenate([[1], s[s <= capacity // 2], capacity - s[s > capacity // 2] + 1]))
    eps = eps[(eps >= 1) & (eps <= capacity // 2)]
    if len(eps):
        lo, hi = np.searchsorted(s, eps), np.searchsorted(s, capacity - eps, side="right")
        value = (len(s) - hi) * capacity + np.where(hi > lo, total[np.maximum(hi, lo)] - total[lo], 0)
        best = max(best, int(-(-value // capacity).max()))
    for k in range(1, 41):
        scaled = (k + 1) * s
        # in units of capacity / (k * capacity): integers only
        f = np.where(scaled % capacity == 0, s * k, (scaled // capacity) * capacity)
        best = max(best, -(-int(f.sum()) // (k * capacity)))
    return best


def _pack(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "chunk", "row"], ascending=[False, True, True, True], kind="stable")
        sizes = pdf["size"].to_numpy()
        b = best_fit_decreasing(sizes, capacity)
        used = np.bincount(b, weights=sizes).astype(np.int64)
        return pdf[["doc_id", "row", "chunk", "size", "part"]].assign(bin=b, free=(capacity - used)[b], bins=len(used), lower_bound=lower_bound(sizes, capacity))

    return run


def pack(
    docs: DataFrame, capacity: int = 8192, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = None,
    part_tokens: int = 16_000_000,
) -> DataFrame:
    """One row per piece: (doc_id, chunk, start, size, bin_id, round, part,
    bins, lower_bound); the last two certify the piece's partition.

    ``size_col`` names a column of token counts to use instead of bytes + 1.
    """
    size = F.greatest(F.col(size_col).cast("bigint"), F.lit(1)) if size_col else F.octet_length(F.col(text_col).cast("string")) + 1
    sized = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(size, F.lit(1)).cast("bigint").alias("n"))
    # numbered, so that rows that repeat an id have full chunks of their own
    sized = materialise(sized.withColumn("row", F.monotonically_increasing_id()))
    c = F.lit(capacity)
    full = sized.where(F.col("n") >= capacity).select("doc_id", "row", F.posexplode(F.array_repeat(c, (F.col("n") / c).cast("int"))).alias("chunk", "size"))
    full = full.select(
        "doc_id", "row", F.col("chunk").cast("int").alias("chunk"), F.col("size").cast("int").alias("size"), F.lit(-1).cast("bigint").alias("part"), F.xxhash64("doc_id", "chunk", "row").alias("bin"),
        F.lit(0).alias("free"), F.lit(1).cast("bigint").alias("bins"), F.lit(1).cast("bigint").alias("lower_bound"), F.lit(0).alias("round"),
    )
    rest = sized.where(F.col("n") % c > 0).select("doc_id", "row", (F.col("n") / c).cast("int").alias("chunk"), (F.col("n") % c).cast("int").alias("size"))

    def spread(df: DataFrame, tokens: int, salt: int) -> DataFrame:
        parts = max(1, math.ceil(tokens / part_tokens))
        return df.select("doc_id", "row", "chunk", "size", F.pmod(F.xxhash64("row", "chunk", F.lit(salt)), F.lit(parts)).cast("bigint").alias("part"))

    settled, moving, before = full, rest, None
    tokens = rest.agg(F.sum("size")).first()[0] or 0
    kept = None  # the packing that ``moving`` has now
    for k in count():
        packed = spread(moving, tokens >> k, k).groupBy("part").applyInPandas(_pack(capacity), SCHEMA).withColumn("round", F.lit(k))
        packed = materialise(packed)
        # bins of this round's documents: one (part, bins) row for each partition
        after = packed.select("part", "bins").distinct().agg(F.sum("bins")).first()[0] or 0
        if before is not None and after >= before:
            break
        gap = (F.col("bins") > F.col("lower_bound")) & (F.col("free") > 0)
        if kept is not None:
            settled = settled.unionByName(kept.where(~gap))
        kept = packed
        moving = packed.where(gap).select("doc_id", "row", "chunk", "size")
        stats = packed.where(gap).agg(F.sum("size"), F.countDistinct("part", "bin")).first()
        tokens, before = (stats[0] or 0) << (k + 1), stats[1]
        if not before or tokens >> (k + 1) == 0:
            break
    out = settled.unionByName(kept) if kept is not None else settled
    return out.select(
        "doc_id", "chunk", (F.col("chunk").cast("bigint") * capacity).alias("start"), "size",
        F.concat_ws("-", "round", "part", "bin").alias("bin_id"), "round", "part", "bins", "lower_bound",
    )
