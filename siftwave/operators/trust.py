"""Follow graph, PageRank and the trust tiers that they give."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwave.model import DAMPING, ITERATIONS
from siftwave.storage import shared_dir, stored


def latest_lists(lists: DataFrame, author: str = "author", at: str = "created_at", tie: str = "tie") -> DataFrame:
    """The newest list of each author; of equally new ones the highest ``tie``."""
    w = Window.partitionBy(author).orderBy(F.desc(at), F.desc(tie))
    return lists.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def edges(latest: DataFrame, author: str = "author", follows: str = "follows") -> DataFrame:
    """(src, dst); a key that a list names twice counts twice."""
    return latest.select(F.col(author).alias("src"), F.explode(follows).alias("dst"))


def follower_counts(graph: DataFrame) -> DataFrame:
    return graph.groupBy("dst").agg(F.count(F.lit(1)).alias("followers"))


def follower_tier(n: Column) -> Column:
    return F.when(n < 10, 0).when(n < 100, 1).when(n < 1000, 2).when(n < 10_000, 3).otherwise(4).cast("int")


def rank_tier(share: Column) -> Column:
    """Tier of a rank by its share of the highest."""
    return F.when(share >= 0.5, 4).when(share >= 0.2, 3).when(share >= 0.05, 2).when(share >= 0.01, 1).otherwise(0).cast("int")


def _ranks(pdf: pd.DataFrame, damping: float, iterations: int) -> pd.DataFrame:
    nodes, at = np.unique(np.concatenate([pdf["src"], pdf["dst"]]), return_inverse=True)
    src, dst, n = at[: len(pdf)], at[len(pdf) :], len(nodes)
    out = np.bincount(src, minlength=n)
    rank = np.full(n, 1 / n)
    for _ in range(iterations):
        share = np.where(out > 0, rank / np.maximum(out, 1), 0)
        rank = (1 - damping) / n + damping * (np.bincount(dst, share[src], n) + rank[out == 0].sum() / n)
    return pd.DataFrame({"node": nodes, "rank": rank})


def pagerank(graph: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS, small_edges: int = 2_000_000) -> DataFrame:
    """(node, rank).  Parallel edges count; the mass of nodes without followed
    keys goes to all.  Up to ``small_edges`` edges (counted first) are ranked in
    one task; more by a join and an aggregation per round, of links to nodes that
    have links themselves, each stored so that the plan stays short.  An empty graph has no ranks."""
    kind = dict(graph.dtypes)["src"]
    graph = stored(graph)  # it's read several times
    if graph.limit(small_edges + 1).count() <= small_edges:
        return graph.withColumn("__one", F.lit(1)).groupBy("__one").applyInPandas(lambda pdf: _ranks(pdf, damping, iterations), f"node {kind}, rank double")
    shared_dir(graph.sparkSession)
    links = graph.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m")).withColumn("out", F.sum("m").over(Window.partitionBy("src")))
    links = links.select("src", "dst", (F.col("m") / F.col("out")).alias("share")).checkpoint()
    nodes = graph.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    nodes = nodes.join(links.select(F.col("src").alias("node"), F.lit(False).alias("dangling")).distinct(), "node", "left").select("node", F.coalesce("dangling", F.lit(True)).alias("dangling")).checkpoint()
    n, lone = (int(x or 0) for x in nodes.agg(F.count(F.lit(1)), F.count_if("dangling")).first())
    # All ranks are 1 together, so what nodes without links have is what those with links
    # haven't: only links to these are followed in each round, all of them in the last.
    # Ranks are ``base``, the same for all, and ``extra`` where a link leads.
    inner = links.join(nodes.where("not dangling").select(F.col("node").alias("dst")), "dst", "left_semi").checkpoint()
    some, base, lost, extra = not inner.isEmpty(), 1.0 / n, lone / n, None
    for k in range(iterations):
        fresh, total, last = (1 - damping) / n + damping * lost / n, 0.0, k == iterations - 1
        use = links if last else inner
        came = use.join(extra.withColumnRenamed("node", "src"), "src", "left") if extra is not None else use.withColumn("extra", F.lit(0.0))
        got = came.groupBy(F.col("dst").alias("node")).agg((damping * F.sum((F.coalesce("extra", F.lit(0.0)) + base) * F.col("share"))).alias("extra"))
        if last:
            return nodes.join(got, "node", "left").select("node", (F.lit(fresh) + F.coalesce("extra", F.lit(0.0))).alias("rank"))
        if some:
            extra = stored(got)
            total = extra.agg(F.sum("extra")).first()[0]
        base, lost = fresh, 1 - (n - lone) * fresh - total
    return nodes.select("node", F.lit(base).alias("rank"))


def ranked_tiers(ranks: DataFrame) -> DataFrame:
    top = ranks.agg(F.max("rank").alias("__top"))
    return ranks.crossJoin(F.broadcast(top)).select("node", "rank", rank_tier(F.col("rank") / F.col("__top")).alias("tier"))


def world(graph: DataFrame, source: str = "followers", ranks: DataFrame | None = None) -> DataFrame:
    """(pubkey, followers, wot_tier, pagerank); ``source`` pagerank lets the
    rank's tier take the place of the followers' for every ranked key."""
    graph = stored(graph) if source != "followers" else graph
    f = follower_counts(graph).select(F.col("dst").alias("pubkey"), "followers", follower_tier(F.col("followers")).alias("__f"))
    if source == "followers":
        return f.select("pubkey", "followers", F.col("__f").alias("wot_tier"), F.lit(None).cast("double").alias("pagerank"))
    r = ranked_tiers(ranks if ranks is not None else pagerank(graph)).select(F.col("node").alias("pubkey"), F.col("rank").alias("pagerank"), F.col("tier").alias("__t"))
    return r.join(f, "pubkey", "full").select("pubkey", F.coalesce("followers", F.lit(0)).cast("bigint").alias("followers"), F.coalesce("__t", "__f", F.lit(0)).alias("wot_tier"), "pagerank")


def top(ranks: DataFrame, n: int = 1000) -> DataFrame:
    return ranks.orderBy(F.desc("rank"), "node").limit(n)
