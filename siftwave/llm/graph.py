"""Connected components, with the edges contracted before they're shuffled."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwave.llm.common import materialise


def contract(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of every node but the roots: the lowest of each component."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(ids))
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    out = np.flatnonzero(label != np.arange(len(ids)))
    return ids[out], ids[label[out]]


def _forest(most: int):
    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append((np.asarray(batch.column(0)), np.asarray(batch.column(1))))
            rows += batch.num_rows
            if rows > most:  # what is contracted so far goes on as a forest
                held = [contract(*(np.concatenate(x) for x in zip(*held)))]
                rows = len(held[0][0])
                if 2 * rows > most:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["u", "v"])
                    held, rows = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in contract(*(np.concatenate(x) for x in zip(*held)))], ["u", "v"])

    return run


def components(pairs: DataFrame, a: str = "doc_a", b: str = "doc_b", most: int = 1 << 20) -> DataFrame:
    """(id, root) of every id in ``pairs`` but the roots: the connected components,
    root = lowest id.  Every task first contracts its edges, ``most`` at a time, to
    a forest; alternating large-star and small-star join the forests."""
    edges = pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").mapInArrow(_forest(most), "u bigint, v bigint")
    edges, before = materialise(edges.distinct()), None
    while True:
        # greatest first: (node, neighbour) both ways, each larger neighbour to the least one
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.withColumn("m", F.least(F.col("u"), F.min("v").over(Window.partitionBy("u"))))
        down = least.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = down.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        small = low.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = materialise(small)
        after = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first()
        if after == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = after
