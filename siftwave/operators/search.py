"""Searches over the document table of ``documents.build``."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwave.functions.normalize import fold_hex
from siftwave.model import BM25_B, BM25_K1, BOOSTS, RECENCY_DAYS, RECENCY_WEIGHT, SKEW_S, TIER_WEIGHT
from siftwave.operators.index import Index, bucket, lengths
from siftwave.plans.filters import Node, SearchFilter, count, leaves, matches, parse_text, predicate

HIT = ["event_id", "pubkey", "kind", "created_at", "score", "raw_content", "first_title", "lang", "shard_ym"]


def recency(created_at: Column, now: Column) -> Column:
    """1 now, 0 after a year; 0 for what lies too far ahead."""
    age = (now - created_at) / 86_400.0
    return F.when(created_at > now + SKEW_S, 0.0).when(created_at >= now, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - age / RECENCY_DAYS))


def composite(bm25: Column, tier: Column, created_at: Column, now: Column) -> Column:
    return bm25 * (1 + TIER_WEIGHT * tier + RECENCY_WEIGHT * recency(created_at, now))


def _idf(df: Column, n: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def _part(field: str, tf: Column, df: Column, n: Column, total: Column, length: Column) -> Column:
    """BM25 of a term in one field, boosted."""
    mean = F.greatest(total / n, F.lit(1e-9))
    norm = BM25_K1 * (1 - BM25_B + BM25_B * length / mean)
    return F.when(tf > 0, BOOSTS[field] * _idf(df, n) * tf * (BM25_K1 + 1) / (tf + norm)).otherwise(0.0)


def bm25(docs: DataFrame, text: str, scope: str = "global", where: Column | None = None) -> DataFrame:
    """``docs`` that match the free ``text``, with ``bm25``.

    One pass gathers how many documents each term is in and the mean lengths, a
    single row (``scope`` global) or one a month (``scope`` shard); the other
    scores what matches ``where`` and the text.
    """
    tree = parse_text(text)
    hits = docs.where(where) if where is not None else docs
    if tree is not None:
        hits = hits.where(matches(tree))
    if not leaves(tree):
        return hits.withColumn("bm25", F.lit(1.0))
    by = ["shard_ym"] if scope == "shard" else []
    sizes = docs.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), *[F.sum(c).alias(f"__len_{f}") for f, c in lengths().items()])
    return _scored(docs, hits, leaves(tree), sizes, by)


def _scored(docs: DataFrame, hits: DataFrame, terms: list, sizes: DataFrame, by: list[str]) -> DataFrame:
    """``hits`` with ``bm25``; ``docs`` has all documents that hold a term."""
    fields = {(i, f): count(t, f) for i, t in enumerate(terms) for f in BOOSTS if t.field in (None, f)}
    stats = docs.groupBy(*by).agg(*[F.count_if(c > 0).alias(f"__df_{i}_{f}") for (i, f), c in fields.items()])
    stats = stats.join(sizes, by) if by else stats.crossJoin(F.broadcast(sizes))
    hits = hits.join(F.broadcast(stats.withColumnRenamed("shard_ym", "__shard")), F.col("shard_ym") == F.col("__shard")) if by else hits.crossJoin(F.broadcast(stats))
    length, score = lengths(), F.lit(0.0)
    for (i, f), tf in fields.items():
        score = score + _part(f, tf, F.col(f"__df_{i}_{f}"), F.col("__n"), F.col(f"__len_{f}"), length[f])
    return hits.withColumn("bm25", score).drop(*[c for c in stats.columns if c.startswith("__")], "__shard")


def _bound(node) -> bool:
    """Whether what matches must hold a term that isn't negated."""
    if isinstance(node, Node):
        return any(map(_bound, node.parts)) if node.op == "and" else node.op == "or" and all(map(_bound, node.parts))
    return True


def _terms(node) -> list:
    return [t for p in node.parts for t in _terms(p)] if isinstance(node, Node) else [node]


def _holds(node, held: Callable) -> Column:
    if isinstance(node, Node):
        parts = [_holds(p, held) for p in node.parts]
        if node.op == "not":
            return ~parts[0]
        return reduce(lambda a, b: a & b if node.op == "and" else a | b, parts)
    return held(node)


def indexed(index: Index, text: str, scope: str = "global", where: Column | None = None) -> DataFrame:
    """The same as ``bm25`` on an index.  Where the text is of single words, matches and
    scores come of the words' postings alone, and then the documents are fetched; else
    only documents that have the first word of a phrase are looked at."""
    tree = parse_text(text)
    docs = index.docs
    if tree is None or not leaves(tree) or not _bound(tree):
        return bm25(docs, text, scope, where)
    by = ["shard_ym"] if scope == "shard" else []
    sizes = index.sizes.withColumnsRenamed({"n": "__n", **{f"len_{f}": f"__len_{f}" for f in BOOSTS}})
    if not by:
        sizes = sizes.agg(*[F.sum(c).alias(c) for c in sizes.columns if c != "shard_ym"])
    terms = leaves(tree)
    if any(t.prefix or len(t.tokens) > 1 for t in _terms(tree)):
        first = reduce(lambda a, b: a | b, [F.col("term").startswith(t.tokens[0]) if t.prefix and len(t.tokens) == 1 else (F.col("bucket") == bucket(F.lit(t.tokens[0]))) & (F.col("term") == t.tokens[0]) for t in terms])
        docs = docs.join(index.postings.where(first).select("event_id").distinct(), "event_id", "left_semi")
        hits = docs.where(where) if where is not None else docs
        return _scored(docs, hits.where(matches(tree)), terms, sizes, by)
    words = list(dict.fromkeys(t.tokens[0] for t in _terms(tree)))
    own = index.postings.where(F.col("bucket").isin(*[bucket(F.lit(w)) for w in words]) & F.col("term").isin(*words))
    name = {(w, f): f"__tf_{i}_{f}" for i, w in enumerate(words) for f in BOOSTS}
    tf = [F.coalesce(F.max(F.when((F.col("term") == w) & (F.col("field") == f), F.col("tf"))), F.lit(0)).alias(c) for (w, f), c in name.items()]
    size = [F.coalesce(F.max(F.when(F.col("field") == f, F.col("length"))), F.lit(0)).alias(f"__size_{f}") for f in BOOSTS]
    rows = own.groupBy("event_id", "shard_ym").agg(*tf, *size)
    used = {(i, f): F.col(name[t.tokens[0], f]) for i, t in enumerate(terms) for f in BOOSTS if t.field in (None, f)}
    counted = {(t.tokens[0], f) for t in terms for f in BOOSTS if t.field in (None, f)}
    found = own.where(reduce(lambda a, b: a | b, [(F.col("term") == w) & (F.col("field") == f) for w, f in counted]))
    stats = found.groupBy(*by).agg(*[F.count_if((F.col("term") == t.tokens[0]) & (F.col("field") == f)).alias(f"__df_{i}_{f}") for i, t in enumerate(terms) for f in BOOSTS if t.field in (None, f)])
    stats = stats.join(sizes, by) if by else stats.crossJoin(F.broadcast(sizes))
    rows = rows.where(_holds(tree, lambda t: reduce(lambda a, b: a | b, [F.col(name[t.tokens[0], f]) > 0 for f in BOOSTS if t.field in (None, f)])))
    rows = rows.join(F.broadcast(stats), by) if by else rows.crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for (i, f), c in used.items():
        score = score + _part(f, c, F.col(f"__df_{i}_{f}"), F.col("__n"), F.col(f"__len_{f}"), F.col(f"__size_{f}"))
    rows = rows.select("event_id", score.alias("bm25"))
    return (docs.where(where) if where is not None else docs).join(rows, "event_id")


def search(docs: DataFrame | Index, f: SearchFilter, now: Column | None = None, scope: str = "global") -> DataFrame:
    """The best ``f.limit`` documents, of a table or an index: by composite score where
    there's a search string, else the newest.  Ties go by id."""
    where, text = predicate(f)
    now = now if now is not None else F.unix_timestamp()
    if f.search is None:
        docs = docs.docs if isinstance(docs, Index) else docs
        out = docs.where(where).withColumn("score", F.col("created_at").cast("double"))
        # rank ids first, fetch the stored text of the page only
        return out.select(*HIT).orderBy(F.desc("created_at"), "event_id").limit(f.limit)
    out = indexed(docs, text, scope, where) if isinstance(docs, Index) else bm25(docs, text, scope, where)
    out = out.withColumn("score", composite(F.col("bm25"), F.col("wot_tier"), F.col("created_at"), now))
    return out.select(*HIT).orderBy(F.desc("score"), "event_id").limit(f.limit)


def postings(docs: DataFrame, id_col: str, tokens_col: str = "content") -> DataFrame:
    """(id, term, tf) of every token."""
    t = docs.select(id_col, F.explode(tokens_col).alias("term")).where("term is not null")
    return t.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


def search_postings(post: DataFrame, lengths: DataFrame, terms: list[str], id_col: str, need_all: bool = True) -> DataFrame:
    """(id, bm25) from a postings table: only the terms' rows are read and joined
    with the lengths of the documents that have them."""
    total = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"))
    own = post.where(F.col("term").isin(*terms))
    if "bucket" in post.columns:  # as stored: partitioned by it
        own = own.where(F.col("bucket").isin(*[bucket(F.lit(t)) for t in terms]))
    if "length" in own.columns:
        own = own.drop("length")
    df = own.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    x = own.join(F.broadcast(df), "term").join(lengths, id_col).crossJoin(F.broadcast(total))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("length") / F.col("mean")))
    out = x.groupBy(id_col).agg(F.sum(part).alias("bm25"), F.count(F.lit(1)).alias("__m"))
    return (out.where(F.col("__m") == len(set(terms))) if need_all else out).drop("__m")


def by_ids(events: DataFrame, ids: list[str]) -> DataFrame:
    """(place, wanted, event columns): a row per asked id in order, nulls where it's missing."""
    want = events.sparkSession.createDataFrame([(i, x) for i, x in enumerate(ids)], "place int, wanted string").withColumn("wanted", fold_hex(F.col("wanted")))
    found = events.where(fold_hex(F.col("id")).isin(*[x.lower() for x in ids])).dropDuplicates(["id"]) if ids else events.limit(0)
    return want.join(found, F.col("wanted") == fold_hex(F.col("id")), "left").orderBy("place")


def profiles(events: DataFrame, authors: list[str] | None = None, most: int = 200) -> DataFrame:
    """Newest profile of each author (all, if none are named)."""
    e = events.where("kind = 0")
    if authors is not None:
        e = e.where(F.col("pubkey").isin(*[a.lower() for a in authors[:most]]))
    w = Window.partitionBy("pubkey").orderBy(F.desc("created_at"), "id")
    return e.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def versions(events: DataFrame, by: list[str]) -> DataFrame:
    """Each version with when the next one replaced it; ``live`` where none did."""
    nxt = F.lead("created_at").over(Window.partitionBy(*by).orderBy("created_at", "id"))
    return events.withColumn("replaced_at", nxt).withColumn("live", F.col("replaced_at").isNull())


def deletions(docs: DataFrame, event_id: str) -> DataFrame:
    return docs.where((F.col("kind") == 5) & F.array_contains("tag_e", event_id.lower()))


def shard_stats(docs: DataFrame) -> DataFrame:
    return docs.groupBy("shard_ym").agg(F.count(F.lit(1)).alias("docs"))


def unseen(events: DataFrame, seen: DataFrame) -> DataFrame:
    """``events`` whose id isn't in ``seen`` (id), each id once."""
    return events.dropDuplicates(["id"]).join(seen.select("id").distinct(), "id", "left_anti")
