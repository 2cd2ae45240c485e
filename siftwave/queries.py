"""Named queries over the driver's tables, each with the SQL that says the same
where SQL can."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwave import fixtures as X
from siftwave import storage
from siftwave.functions import bech32
from siftwave.functions import normalize as N
from siftwave.functions.language import detect_col
from siftwave.functions.text import tokens
from siftwave.operators import documents, index, reports, scrape, search, trust
from siftwave.plans.filters import SearchFilter
from siftwave.sources import archive
from siftwave.streaming import live, state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
NOW = 1_735_689_600


def query(sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = "WITH " + sql if re.match(r"\s*\w+ AS \(", sql) else sql
        return fn

    return add


def _events(spark, sf):
    return X.events(spark, sf)


def _graph(spark, sf):
    return trust.edges(trust.latest_lists(X.contacts(spark, sf)))


def _world(spark, sf):
    w = trust.world(_graph(spark, sf))
    return w.withColumn("pubkey", X.key(F.col("pubkey")))


def _articles(spark, sf):
    """Articles as documents; the tier is that of the author's followers."""
    a = X.articles(spark, sf)
    words = F.when(N.is_text_kind(F.col("kind")), tokens(F.col("content")))
    none = F.array().cast("array<string>")
    d = a.select(
        "doc_id", F.col("id").alias("event_id"), "pubkey", "kind", "created_at", N.month_shard(F.col("created_at")).alias("shard_ym"), words.alias("content"), none.alias("title"),
        none.alias("summary"), F.lit(None).cast("string").alias("first_title"), F.col("content").alias("raw_content"), F.col("truth").alias("lang"), none.alias("tag_t"),
    )
    # counted first: by a shuffle, the texts would move by their author, of whom there may be few
    w = storage.stored(_world(spark, sf).where("wot_tier > 0").select("pubkey", "wot_tier"))
    w = F.broadcast(w) if w.count() <= 2_000_000 else w
    return d.join(w, "pubkey", "left").withColumn("wot_tier", F.coalesce("wot_tier", F.lit(0)))


_INDEXES: dict[tuple[str, str], str] = {}


def _index(spark, sf) -> index.Index:
    """The index of the articles, written by the first query of an application that
    needs it and read by the others."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INDEXES:
        where = storage.new_path(spark)
        index.write(_articles(spark, sf), where)
        _INDEXES[key] = where
    return index.read(spark, _INDEXES[key])


def _r(c, n=6):
    return F.round(c, n)


# --- normalisers

_HOST_SQL = r"regexp_replace(lower(split_part(regexp_extract(split_part(url, '://', 2), '^([^/?#]*)', 1), ':', 1)), '^www\.', '')"


@query(f"SELECT page_id, {_HOST_SQL} AS host FROM pages")
def norm_host(spark, sf):
    return X.table(spark, sf, "pages").select("page_id", N.url_host(F.col("url")).alias("host"))


_RELAY_SQL = r"regexp_replace(regexp_extract(lower(regexp_replace(url, '^https?', 'wss')), '^([^?#]*)', 1), '/+$', '')"


@query(f"SELECT page_id, {_RELAY_SQL} AS relay FROM pages")
def norm_relay(spark, sf):
    return X.links(spark, sf).select("page_id", N.relay_url(F.get(F.get("tags", F.lit(0)), F.lit(1))).alias("relay"))


_CLIENT_SQL = "CASE WHEN k % 5 = 0 THEN 'N/A' ELSE 'client-' || (k % 12) END"


@query(f"{X.EVENTS_SQL} SELECT {_CLIENT_SQL} AS client, count(*) AS n FROM ev GROUP BY ALL")
def norm_client(spark, sf):
    return _events(spark, sf).groupBy(N.client_name(N.tag_value(F.col("tags"), "client")).alias("client")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT CASE WHEN k IN (0, 3) OR k BETWEEN 10000 AND 19999 THEN 'replaceable' WHEN k BETWEEN 30000 AND 39999 THEN 'addressable'
              WHEN k BETWEEN 20000 AND 29999 THEN 'ephemeral' WHEN k = 5 THEN 'deletion' ELSE 'regular' END AS class, count(*) AS n
       FROM (SELECT event_id * 7 % 65536 AS k FROM events) GROUP BY ALL"""
)
def kind_classes(spark, sf):
    k = (F.col("event_id") * 7 % 65536).cast("int")
    return X.table(spark, sf, "events").groupBy(N.kind_class(k).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{X.EVENTS_SQL} SELECT 'Tag' || (k % 20) AS tag, count(*) AS n FROM ev WHERE kind = 1 GROUP BY ALL")
def tag_values(spark, sf):
    return _events(spark, sf).select(F.explode(N.tag_values(F.col("tags"), "t")).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query(
    """h AS (SELECT lower(to_hex(event_id * 7919 + 4096)) AS g FROM events), p AS (SELECT g, unnest(generate_series(2, least(9, length(g)))) AS n FROM h)
       SELECT left(g, n) AS prefix, count(*) AS n FROM p GROUP BY ALL"""
)
def geohash_prefixes(spark, sf):
    g = F.hex(F.col("event_id") * 7919 + 4096)
    p = X.table(spark, sf, "events").select(F.explode(N.geohash_prefixes(F.concat(F.lit(" "), g))).alias("prefix"))
    return p.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, '30023:' || lpad(lower(to_hex(user_id)), 64, '0') || ':Slug:' || event_id AS coordinate FROM events")
def coordinate_fold(spark, sf):
    c = F.concat(F.lit("30023:"), F.upper(X.key(F.col("user_id"))), F.lit(":Slug:"), F.col("event_id").cast("string"))
    return X.table(spark, sf, "events").select("event_id", N.fold_coordinate(c).alias("coordinate"))


@query("SELECT event_id, lower(name || '@example.com') AS nip05, name AS domain FROM (SELECT event_id, 'host' || user_id || '.org' AS name FROM events)")
def nip05_fold(spark, sf):
    name = F.concat(F.lit("host"), F.col("user_id").cast("string"), F.lit(".org"))
    return X.table(spark, sf, "events").select("event_id", N.fold_nip05(F.concat(F.lit(" "), F.upper(name), F.lit("@Example.com "))).alias("nip05"), N.fold_nip05(F.concat(F.lit("_@"), name)).alias("domain"))


@query(f"{X.DOCS_SQL} SELECT CAST(strftime(to_timestamp(created_at) AT TIME ZONE 'UTC', '%Y%m') AS INT) AS shard_ym, count(*) AS docs FROM doc GROUP BY ALL")
def month_shards(spark, sf):
    return search.shard_stats(X.articles(spark, sf).select(N.month_shard(F.col("created_at")).alias("shard_ym")))


@query("SELECT page_id, page_id % 4 IN (0, 2) AS generated FROM pages")
def generated_paths(spark, sf):
    n = F.col("page_id") % 4
    url = F.concat(F.lit("wss://h.example/"), F.when(n == 0, "tango-vertex").when(n == 1, "echo").when(n == 2, "x_Zulu/").otherwise("nostr/v1/ws"))
    return X.table(spark, sf, "pages").select("page_id", N.generated_path(url).alias("generated"))


@query("SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 0 ELSE least(3600, 60 * CAST(pow(2, least(page_id % 9, 6)) AS INT)) END AS seconds FROM pages")
def backoff(spark, sf):
    return X.table(spark, sf, "pages").select("page_id", N.backoff_seconds((F.col("page_id") % 9).cast("int")).alias("seconds"))


@query("SELECT p_partkey, CAST(100000000 * (p_partkey % 50) AS BIGINT) * 1 AS msats FROM part WHERE p_partkey % 50 > 0")
def invoice_amounts(spark, sf):
    """Invoices of p_partkey % 50 milli-bitcoin, made in the driver and read back."""
    made = spark.createDataFrame([(n, bech32.encode(f"lnbc{n}m", [1, 2, 3] * 10)) for n in range(1, 50)], "n bigint, invoice string")
    p = X.table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 50).alias("n")).join(F.broadcast(made), "n")
    return p.select("p_partkey", bech32.invoice_msats_col(F.col("invoice")).alias("msats"))


@query()
def language_detected(spark, sf):
    d = X.table(spark, sf, "documents").select(F.col("lang").alias("truth"), detect_col(F.col("text")).alias("lang"))
    return d.groupBy("truth", "lang").agg(F.count(F.lit(1)).alias("n"))


# --- text and search


@query(f"{X.DOCS_SQL}, {X.TOKENS_SQL} SELECT * FROM post")
def postings(spark, sf):
    d = X.table(spark, sf, "documents").select("doc_id", tokens(F.coalesce("text", F.lit(""))).alias("content"))
    return search.postings(d, "doc_id")


_CJK = {"gm nostr, bitcoin!": "gm nostr bitcoin", "ビットコイン": "ビッ ット トコ コイ イン", "bitcoin ビット coin": "bitcoin ビッ ット coin", "値段は円": "値段 段は は円", "a 円 b": "a 円 b", "비트코인": "비트 트코 코인", "Café Straße": "cafe strasse"}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _CJK.items()) + ") AS t(s, tokens)")
def tokens_cjk(spark, sf):
    return spark.createDataFrame([(k,) for k in _CJK], "s string").select("s", F.array_join(tokens(F.col("s")), " ").alias("tokens"))


def _bm25_sql(terms: list[str], by: str = "", op: str = "AND") -> str:
    """CTEs up to ``hit`` (doc_id, bm25) for terms that must all occur, or any."""
    part = f"PARTITION BY {by}" if by else ""
    shard = "CAST(strftime(to_timestamp(created_at) AT TIME ZONE 'UTC', '%Y%m') AS INT)"
    need = f"HAVING count(*) = {len(terms)}" if op == "AND" else ""
    return f"""{X.DOCS_SQL}, {X.TOKENS_SQL},
      len AS (SELECT d.doc_id, {shard} AS shard_ym, coalesce(sum(tf), 0) AS l FROM doc d LEFT JOIN post p ON d.doc_id = p.doc_id GROUP BY d.doc_id, d.created_at),
      stat AS (SELECT doc_id, shard_ym, l, count(*) OVER ({part}) AS n, sum(l) OVER ({part}) / count(*) OVER ({part}) AS mean FROM len),
      one AS (SELECT s.*, p.term, p.tf FROM post p JOIN stat s ON p.doc_id = s.doc_id WHERE term IN ({", ".join(f"'{t}'" for t in terms)})),
      df AS (SELECT *, count(*) OVER (PARTITION BY term {", " + by if by else ""}) AS df FROM one),
      hit AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))) AS bm25 FROM df GROUP BY doc_id {need})"""


@query(_bm25_sql(["the", "on"]) + " SELECT doc_id, round(bm25, 6) AS bm25 FROM hit")
def bm25_global(spark, sf):
    return search.indexed(_index(spark, sf), "the on").select("doc_id", _r(F.col("bm25")).alias("bm25"))


@query(_bm25_sql(["the", "on"], "shard_ym") + " SELECT doc_id, round(bm25, 6) AS bm25 FROM hit")
def bm25_shard(spark, sf):
    return search.indexed(_index(spark, sf), "the on", scope="shard").select("doc_id", _r(F.col("bm25")).alias("bm25"))


@query(_bm25_sql(["the", "on"]) + " SELECT doc_id, round(bm25, 6) AS bm25 FROM hit")
def bm25_postings(spark, sf):
    held = _index(spark, sf)
    lengths = held.docs.select("event_id", F.size(F.filter("content", lambda t: t.isNotNull())).alias("length"))
    got = search.search_postings(held.postings, lengths, ["the", "on"], "event_id")
    return got.join(held.docs.select("event_id", "doc_id"), "event_id").select("doc_id", _r(F.col("bm25")).alias("bm25"))


@query(_bm25_sql(["the", "on"]) + " SELECT doc_id, round(bm25, 6) AS bm25 FROM hit")
def bm25_scan(spark, sf):
    """The same without an index."""
    return search.bm25(_articles(spark, sf), "the on").select("doc_id", _r(F.col("bm25")).alias("bm25"))


def _having(cond: str) -> str:
    return f"{X.DOCS_SQL}, {X.TOKENS_SQL} SELECT doc_id FROM doc WHERE {cond}"


def _has(t: str) -> str:
    return f"doc_id IN (SELECT doc_id FROM post WHERE term = '{t}')"


@query(_having(f"{_has('der')} AND {_has('und')}"))
def search_and(spark, sf):
    return search.indexed(_index(spark, sf), "der und").select("doc_id")


@query(_having(f"{_has('der')} OR {_has('las')}"))
def search_or(spark, sf):
    return search.indexed(_index(spark, sf), "der OR las").select("doc_id")


@query(_having(f"{_has('the')} AND NOT {_has('whence')} AND NOT {_has('on')}"))
def search_not(spark, sf):
    return search.indexed(_index(spark, sf), "the -whence NOT on").select("doc_id")


@query(_having("regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])of[^\\p{L}\\p{N}]+the([^\\p{L}\\p{N}]|$)')"))
def search_phrase(spark, sf):
    return search.indexed(_index(spark, sf), '"of the"').select("doc_id")


_TIER_SQL = f"{X.LATEST_SQL}, au AS (SELECT a AS author, coalesce(tier, 0) AS tier FROM (SELECT unnest(generate_series(0, 96)) AS a) LEFT JOIN tiers ON a = followed)"
_RECENCY = f"(CASE WHEN created_at > {NOW} + 300 THEN 0 WHEN created_at >= {NOW} THEN 1 ELSE greatest(0, 1 - ({NOW} - created_at) / 86400.0 / 365) END)"


@query(
    _bm25_sql(["the", "of"])
    + f""", {_TIER_SQL} SELECT lpad(lower(to_hex(doc_id)), 64, '0') AS event_id, round(score, 4) AS score FROM (
      SELECT doc_id, bm25 * (1 + 0.5 * tier + {_RECENCY}) AS score FROM hit JOIN doc USING (doc_id) JOIN au USING (author)) ORDER BY score DESC, event_id LIMIT 20"""
)
def search_composite(spark, sf):
    out = search.search(_index(spark, sf), SearchFilter(search="the of until:2100-01-01", limit=20), now=F.lit(NOW))
    return out.select("event_id", _r(F.col("score"), 4).alias("score"))


@query(f"{X.DOCS_SQL} SELECT lpad(lower(to_hex(doc_id)), 64, '0') AS event_id, created_at FROM doc ORDER BY created_at DESC, event_id LIMIT 50")
def search_recent(spark, sf):
    return search.search(_index(spark, sf), SearchFilter(until=1 << 40)).select("event_id", "created_at")


@query(_having(f"kind = 30023 AND created_at >= 1704844800 AND created_at < 1706745600 AND {_has('the')}"))
def search_filters(spark, sf):
    return _matching(_index(spark, sf).docs, SearchFilter(search="kind:30023 since:2024-01-10 until:2024-02-01 the")).select("doc_id")


@query(_having("lang = 'de' AND kind = 1"))
def search_lang(spark, sf):
    return _matching(_index(spark, sf).docs, SearchFilter(search="lang:DE kind:1 until:2100-01-01")).select("doc_id")


def _matching(docs, f):
    from siftwave.plans.filters import matches, parse_text, predicate

    where, text = predicate(f)
    tree = parse_text(text)
    return docs.where(where if tree is None else where & matches(tree))


@query(f"SELECT page_id FROM pages WHERE {_HOST_SQL} = (SELECT {_HOST_SQL} AS h FROM pages GROUP BY h ORDER BY count(*) DESC, h LIMIT 1)")
def search_site(spark, sf):
    links = X.links(spark, sf)
    d = links.select("page_id", N.month_shard(F.col("created_at")).alias("shard_ym"), "created_at", F.filter(F.transform(N.tag_values(F.col("tags"), "r"), N.url_host), lambda h: h.isNotNull()).alias("tag_host"))
    busiest = d.groupBy(F.get("tag_host", F.lit(0)).alias("h")).count().orderBy(F.desc("count"), "h").first()[0]
    return _matching(d, SearchFilter(search=f"site:https://www.{busiest.upper()}/x until:2100-01-01")).select("page_id")


@query(f"{X.DOCS_SQL} SELECT count(*) AS docs FROM doc WHERE created_at >= 1705000000 AND created_at < 1707000000")
def time_prune(spark, sf):
    return _matching(_index(spark, sf).docs.select("created_at", "shard_ym"), SearchFilter(since=1705000000, until=1707000000)).agg(F.count(F.lit(1)).alias("docs"))


@query("SELECT lpad(lower(to_hex(event_id)), 64, '0') AS id, event_type AS content FROM events WHERE event_id = 77")
def event_by_id(spark, sf):
    return _events(spark, sf).where(F.col("id") == f"{77:064x}").select("id", "content")


@query("SELECT i AS place, event_type AS content FROM (VALUES (0, 5), (1, -1), (2, 3)) t(i, e) LEFT JOIN events ON e = event_id")
def multi_get(spark, sf):
    return search.by_ids(_events(spark, sf), [f"{5:064x}", "f" * 64, f"{3:064x}"]).select("place", "content")


@query(f"{X.EVENTS_SQL} SELECT lpad(lower(to_hex(user_id)), 64, '0') AS pubkey, max(created_at) AS created_at FROM ev WHERE kind = 0 GROUP BY ALL")
def profiles_latest(spark, sf):
    return search.profiles(_events(spark, sf)).select("pubkey", "created_at")


@query(
    """SELECT o_custkey AS author, o_orderkey AS version, CAST(lead(epoch_us(o_orderdate) // 1000000) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS replaced_at FROM orders"""
)
def version_history(spark, sf):
    o = X.table(spark, sf, "orders").select(F.col("o_custkey").alias("author"), X.seconds("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("id"))
    return search.versions(o, ["author"]).select("author", F.col("id").alias("version"), "replaced_at")


@query("SELECT event_id FROM events WHERE event_type = 'error' AND event_id % 7 = 3")
def deletions(spark, sf):
    """Errors taken as deletions of event (their id mod 7); those of event 3."""
    e = X.table(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "error", 5).otherwise(1).alias("kind"), F.array(X.key(F.col("event_id") % 7)).alias("tag_e"))
    return search.deletions(e, f"{3:064X}").select("event_id")


@query("SELECT conv_id, count(*) AS replies FROM conversations GROUP BY ALL")
def thread_replies(spark, sf):
    c = X.table(spark, sf, "conversations").select("conv_id", F.array(F.array(F.lit("e"), X.key(F.col("conv_id")))).alias("tags"))
    return c.groupBy("conv_id", N.tag_value(F.col("tags"), "e").alias("e")).agg(F.count(F.lit(1)).alias("replies")).drop("e")


@query(f"{X.DOCS_SQL}, s AS (SELECT CAST(strftime(to_timestamp(created_at) AT TIME ZONE 'UTC', '%Y%m') AS INT) AS shard_ym, count(*) AS docs FROM doc GROUP BY ALL) SELECT count(*) AS shards, sum(docs)::BIGINT AS docs FROM s")
def shard_stats(spark, sf):
    return month_shards(spark, sf).agg(F.count(F.lit(1)).alias("shards"), F.sum("docs").alias("docs"))


@query("SELECT lpad(lower(to_hex(event_id)), 64, '0') AS id FROM events WHERE event_id % 3 <> 0")
def dedupe_anti(spark, sf):
    e = X.table(spark, sf, "events")
    seen = e.where("event_id % 3 = 0").select(X.key(F.col("event_id")).alias("id"))
    return search.unseen(_events(spark, sf), seen).select("id")


@query("SELECT count(*) AS good, 2::BIGINT AS bad FROM events")
def scan_corrupt(spark, sf):
    """The events as JSON lines, two broken ones among them."""
    lines = _events(spark, sf).withColumn("sig", F.lit("c" * 128)).select(F.to_json(F.struct("id", "pubkey", "created_at", "kind", "tags", "content", "sig")).alias("value"))
    broken = spark.createDataFrame([('{"id": "x', ), ('{"id":"a","pubkey":"b","created_at":1,"kind":70000,"sig":"c"}',)], "value string")
    good, bad = archive.parse_lines(lines.unionByName(broken))
    return good.agg(F.count(F.lit(1)).alias("good")).crossJoin(bad.agg(F.count(F.lit(1)).alias("bad")))


# --- trust


@query(f"{X.LATEST_SQL} SELECT author, o_orderkey AS list FROM latest")
def contact_latest(spark, sf):
    return trust.latest_lists(X.contacts(spark, sf)).select("author", F.col("tie").alias("list"))


@query(f"{X.LATEST_SQL} SELECT followed, followers FROM followers")
def follower_counts(spark, sf):
    return trust.follower_counts(_graph(spark, sf)).select(F.col("dst").alias("followed"), "followers")


@query(
    """f AS (SELECT l_suppkey AS followed, count(*) AS followers FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)
       SELECT followed, followers, CASE WHEN followers < 10 THEN 0 WHEN followers < 100 THEN 1 WHEN followers < 1000 THEN 2 WHEN followers < 10000 THEN 3 ELSE 4 END AS tier FROM f"""
)
def follower_tiers(spark, sf):
    f = trust.follower_counts(trust.edges(X.contacts(spark, sf)))
    return f.select(F.col("dst").alias("followed"), "followers", trust.follower_tier(F.col("followers")).alias("tier"))


def _rank_sql(rounds: int = 20) -> str:
    steps = [
        f"""{X.LATEST_SQL}, e AS (SELECT author AS src, 1000000 + followed AS dst FROM edges), nodes AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
      outs AS (SELECT src, count(*) AS o FROM e GROUP BY ALL), num AS (SELECT count(*) AS n FROM nodes), r0 AS MATERIALIZED (SELECT node, 1.0 / n AS rank FROM nodes, num)"""
    ]
    for k in range(rounds):
        steps.append(
            f"""r{k + 1} AS MATERIALIZED (SELECT r.node, 0.15 / n + 0.85 * (coalesce(g.got, 0) + lost.lost / n) AS rank FROM r{k} r CROSS JOIN num
      CROSS JOIN (SELECT coalesce(sum(rank), 0) AS lost FROM r{k} WHERE node NOT IN (SELECT src FROM outs)) lost
      LEFT JOIN (SELECT dst, sum(rank / o) AS got FROM e JOIN outs USING (src) JOIN r{k} x ON x.node = e.src GROUP BY dst) g ON g.dst = r.node)"""
        )
    return ", ".join(steps)


def _rank_graph(spark, sf):
    return _graph(spark, sf).select("src", (F.col("dst") + 1_000_000).alias("dst"))


@query(_rank_sql() + " SELECT node, round(rank * 1000, 6) AS rank FROM r20")
def pagerank_20(spark, sf):
    return trust.pagerank(_rank_graph(spark, sf)).select("node", _r(F.col("rank") * 1000).alias("rank"))


_TIERS_SQL = "CASE WHEN s >= 0.5 THEN 4 WHEN s >= 0.2 THEN 3 WHEN s >= 0.05 THEN 2 WHEN s >= 0.01 THEN 1 ELSE 0 END"


@query(_rank_sql() + f" SELECT {_TIERS_SQL} AS tier, count(*) AS n FROM (SELECT rank / max(rank) OVER () AS s FROM r20) GROUP BY ALL")
def rank_tiers(spark, sf):
    return trust.ranked_tiers(trust.pagerank(_rank_graph(spark, sf))).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@query(
    _rank_sql()
    + f""", w AS (SELECT node, rank / max(rank) OVER () AS s FROM r20), f AS (SELECT dst, count(*) AS followers FROM e GROUP BY ALL)
      SELECT node AS pubkey, coalesce(followers, 0) AS followers, {_TIERS_SQL} AS wot_tier FROM w LEFT JOIN f ON dst = node"""
)
def world(spark, sf):
    return trust.world(_rank_graph(spark, sf), "pagerank").select("pubkey", "followers", "wot_tier")


# --- reports

_TRUST_SQL = f"{X.EVENTS_SQL}, {X.LATEST_SQL}, t AS (SELECT ev.*, coalesce(tier, 0) >= 1 AS trusted, created_at - created_at % 86400 AS day FROM ev LEFT JOIN tiers ON user_id = followed)"
_SPLIT = "count(*) FILTER (trusted) AS trusted, count(*) FILTER (NOT trusted) AS untrusted"


@query(f"{_TRUST_SQL} SELECT day, kind, {_SPLIT} FROM t GROUP BY ALL")
def activity_kinds(spark, sf):
    return reports.activity_kinds(_events(spark, sf), _world(spark, sf))


_ZAP_SQL = f"""{_TRUST_SQL}, z AS (
  SELECT day, CAST(round(value * 100) AS BIGINT) * 1000 // 7 // 1000 AS sats, trusted AS s, coalesce(r.tier, 0) >= 1 AS r FROM t LEFT JOIN tiers r ON (user_id * 7 + 3) % 150 = r.followed WHERE kind = 9735),
zd AS (SELECT day, count(*) AS receipts, coalesce(sum(sats) FILTER (s), 0)::BIGINT AS sent_trusted, coalesce(sum(sats) FILTER (NOT s), 0)::BIGINT AS sent_untrusted,
  coalesce(sum(sats) FILTER (r), 0)::BIGINT AS received_trusted, coalesce(sum(sats) FILTER (NOT r), 0)::BIGINT AS received_untrusted FROM z GROUP BY ALL)"""


@query(f"{_ZAP_SQL} SELECT * FROM zd")
def activity_zaps(spark, sf):
    return reports.activity_zaps(_events(spark, sf), _world(spark, sf))


_TOTALS_SQL = f"{_ZAP_SQL}, d AS (SELECT day, count(*) AS events FROM t GROUP BY ALL), tot AS (SELECT d.day, events, coalesce(sent_trusted + sent_untrusted, 0) AS zaps_sats FROM d LEFT JOIN zd USING (day))"


@query(f"{_TOTALS_SQL} SELECT * FROM tot")
def activity_totals(spark, sf):
    e, w = _events(spark, sf), _world(spark, sf)
    return reports.day_totals(reports.activity_kinds(e, w), reports.activity_zaps(e, w))


@query(f"{_TOTALS_SQL} SELECT count(*) AS days, sum(events)::BIGINT AS events, sum(zaps_sats)::BIGINT AS zaps_sats, max(events) AS peak FROM (SELECT * FROM tot WHERE day BETWEEN 1577836800 AND {NOW} + 86400 ORDER BY day DESC LIMIT 90)")
def activity_summary(spark, sf):
    return reports.last_days_summary(reports.plausible(activity_totals(spark, sf), F.lit(NOW)))


@query(f"{_TRUST_SQL} SELECT kind, trusted, untrusted, trusted + untrusted AS events, round(trusted * 100.0 / (trusted + untrusted), 6) AS share FROM (SELECT kind, {_SPLIT} FROM t GROUP BY ALL) ORDER BY events DESC, kind LIMIT 14")
def kinds_all_time(spark, sf):
    return reports.trusted_share(reports.kinds_all_time(activity_kinds(spark, sf)))


def _active_sql(bucket: int) -> str:
    return f"{_TRUST_SQL} SELECT created_at - created_at % {bucket} AS bucket, count(DISTINCT user_id) AS total, count(DISTINCT user_id) FILTER (trusted) AS trusted, count(DISTINCT user_id) FILTER (NOT trusted) AS untrusted FROM t GROUP BY ALL"


@query(_active_sql(86400))
def active_daily(spark, sf):
    return reports.active_users(_events(spark, sf), _world(spark, sf))


@query(_active_sql(604800))
def active_weekly(spark, sf):
    return reports.active_users(_events(spark, sf), _world(spark, sf), N.week)


@query()
def active_daily_hll(spark, sf):
    e, w = _events(spark, sf), _world(spark, sf)
    halves = [reports.active_users_sketch(e.where(F.col("created_at") % 2 == k), w) for k in (0, 1)]
    return reports.sketch_estimates(reports.merge_sketches(*halves))


_CLIENTS_SQL = f"{X.EVENTS_SQL}, c AS (SELECT {_CLIENT_SQL} AS client, count(*) AS events, max(created_at) AS last_seen FROM ev GROUP BY ALL)"


@query(f"{_CLIENTS_SQL} SELECT * FROM c")
def client_tags(spark, sf):
    return reports.clients(reports.client_kinds(_events(spark, sf)))


@query(f"{X.EVENTS_SQL}, f AS (SELECT {_CLIENT_SQL} AS client, min(lpad(CAST(created_at AS VARCHAR), 12, '0') || lpad(CAST(event_id AS VARCHAR), 12, '0')) AS f FROM ev GROUP BY ALL), k AS (SELECT client FROM f ORDER BY f LIMIT 4) SELECT CASE WHEN k.client IS NULL THEN '(other)' ELSE k.client END AS client, count(*) AS events, max(created_at) AS last_seen FROM ev LEFT JOIN k ON k.client = {_CLIENT_SQL} GROUP BY ALL")
def client_cap(spark, sf):
    return reports.clients(reports.client_kinds(_events(spark, sf)), most=4)


@query(f"{_CLIENTS_SQL} SELECT client, events, round(events * 100.0 / (SELECT sum(events) FROM c), 6) AS share FROM c ORDER BY events DESC, client LIMIT 14")
def client_share(spark, sf):
    return reports.client_share(client_tags(spark, sf))


@query(f"{_CLIENTS_SQL} SELECT count(*) AS active FROM c WHERE last_seen >= (SELECT max(created_at) - max(created_at) % 86400 FROM ev)")
def clients_today(spark, sf):
    at = _events(spark, sf).agg(N.day(F.max("created_at")).alias("__at"))
    return client_tags(spark, sf).crossJoin(F.broadcast(at)).agg(F.count_if(F.col("last_seen") >= F.col("__at")).alias("active"))


_RELAYS_SQL = f"""l AS (SELECT {_RELAY_SQL} AS url, page_id, page_id % 40 AS author, 1704067200 + page_id * 60 AS t_at FROM pages),
r AS (SELECT url, count(DISTINCT author) AS advertisers, max(t_at) AS last_seen FROM l GROUP BY url ORDER BY min(t_at), url LIMIT 8192)"""


@query(f"{_RELAYS_SQL} SELECT * FROM r")
def relays_ranked(spark, sf):
    return reports.ranked(reports.relays(X.links(spark, sf)))


_REG_SQL = f"reg AS (SELECT {_HOST_SQL} AS url, count(DISTINCT page_id % 40) AS sources FROM pages GROUP BY ALL), num AS (SELECT *, row_number() OVER (ORDER BY url) AS i FROM reg), info AS (SELECT url, sources, CASE WHEN i % 5 = 0 THEN false WHEN i % 5 = 1 THEN true END AS nip11, i FROM num)"


def _registry(spark, sf):
    from pyspark.sql import Window

    p = X.table(spark, sf, "pages").groupBy(N.url_host(F.col("url")).alias("url")).agg(F.countDistinct(F.col("page_id") % 40).alias("sources"))
    i = F.row_number().over(Window.orderBy("url"))
    p = p.withColumn("i", i)
    n = F.col("i") % 5
    return p.withColumns(
        {
            "nip11": F.when(n == 0, False).when(n == 1, True), "negentropy": F.when(n == 2, True).when(n == 3, False), "fails": (F.col("i") % 4).cast("int"), "last_fail": F.lit(NOW - 1000),
            "dead_until": F.when(F.col("i") % 7 == 0, F.lit(NOW + 1)).otherwise(F.lit(None)).cast("bigint"), "last_ok": F.when(F.col("i") % 2 == 0, F.lit(NOW - 5000)).otherwise(F.lit(None)).cast("bigint"), "nip11_at": F.lit(NOW - 86400 * 3) - F.col("i") * 86400,
        }
    )


@query(
    f"""{_REG_SQL}, o AS (SELECT *, sum(sources) OVER w AS run, row_number() OVER w AS p, sum(sources) OVER () AS total FROM info WHERE nip11 IS DISTINCT FROM false WINDOW w AS (ORDER BY sources DESC, url ROWS UNBOUNDED PRECEDING))
       SELECT url, sources FROM o WHERE p <= 3 OR run - sources < total * 60 // 100"""
)
def usage_cut(spark, sf):
    return scrape.usage_cut(_registry(spark, sf), 60, 3).select("url", "sources")


@query(f"{_REG_SQL} SELECT count(*) AS total, count(*) FILTER (i % 5 = 2) AS negentropy, count(*) FILTER (i % 5 = 3) AS no_negentropy, count(*) FILTER (i % 5 NOT IN (2, 3)) AS unprobed, count(*) FILTER (i % 4 > 0) AS failing FROM info")
def relay_health(spark, sf):
    return scrape.health(_registry(spark, sf))


@query(f"{_REG_SQL} SELECT url, sources FROM info ORDER BY sources DESC, url LIMIT 50 OFFSET 5")
def relay_page(spark, sf):
    return scrape.page(_registry(spark, sf), 5).select("url", "sources")


@query(f"{_REG_SQL} SELECT url FROM info WHERE {NOW} - 86400 * 3 - i * 86400 + 7 * 86400 <= {NOW}")
def nip11_recheck(spark, sf):
    return scrape.nip11_stale(_registry(spark, sf), F.lit(NOW)).select("url")


def _done(spark, sf):
    e = X.table(spark, sf, "pages")
    date = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") % 20 * 86400), "yyyy-MM-dd")
    return e.groupBy(N.url_host(F.col("url")).alias("url"), date.alias("date")).agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("page_id") % 2 == 0).alias("new"), F.max("page_id").alias("at"))


_DONE_SQL = f"done AS (SELECT {_HOST_SQL} AS url, strftime(to_timestamp(1704067200 + page_id % 20 * 86400) AT TIME ZONE 'UTC', '%Y-%m-%d') AS date, count(*) AS seen, count(*) FILTER (page_id % 2 = 0) AS new, max(page_id) AS t_at FROM pages GROUP BY ALL)"


@query(f"{_DONE_SQL} SELECT count(*) AS relay_days, count(DISTINCT date) AS days, sum(seen)::BIGINT AS events_seen, sum(new)::BIGINT AS events_new, min(date) AS oldest_day, max(date) AS newest_day FROM done")
def scrape_progress(spark, sf):
    return scrape.progress(_done(spark, sf))


@query(f"{_DONE_SQL} SELECT url, count(*) AS days, sum(seen)::BIGINT AS seen, sum(new)::BIGINT AS new FROM done GROUP BY ALL")
def scrape_by_relay(spark, sf):
    return scrape.progress_by_relay(_done(spark, sf))


@query(f"{_DONE_SQL}, r AS (SELECT * FROM done ORDER BY t_at DESC, url, date LIMIT 25) SELECT date, sum(seen)::BIGINT AS seen, sum(new)::BIGINT AS new, count(DISTINCT url) AS relays FROM r GROUP BY ALL")
def scrape_recent(spark, sf):
    return scrape.recent_by_date(_done(spark, sf))


@query(f"{_DONE_SQL} SELECT url, date FROM done WHERE NOT (url = 'tionsh.example.net' AND date BETWEEN '2024-01-05' AND '2024-01-10')")
def scrape_reset(spark, sf):
    return scrape.reset(_done(spark, sf), relay="tionsh.example.net", since="2024-01-05", until="2024-01-10").select("url", "date")


@query(
    f"""{_REG_SQL}, {_DONE_SQL}, k AS (SELECT url FROM info WHERE nip11 IS DISTINCT FROM false), x AS (SELECT (SELECT count(*) FROM k) AS relays, (SELECT count(*) FROM done WHERE url IN (SELECT url FROM k)) AS d)
       SELECT relays, 30::BIGINT AS days, relays * 30 AS total, least(d, relays * 30) AS done, greatest(relays * 30 - d, 0) AS remaining, CASE WHEN relays = 0 THEN 100 ELSE CAST(floor(least(d, relays * 30) * 100 / (relays * 30)) AS INT) END AS percent FROM x"""
)
def horizon(spark, sf):
    return scrape.horizon(scrape.usage_cut(_registry(spark, sf), 100), _done(spark, sf), 30)


_OPEN_SQL = f"{_REG_SQL}, {_DONE_SQL}, op AS (SELECT url, 1704067200 + i2 * 86400 AS day FROM info, (SELECT unnest(generate_series(0, 24)) AS i2) WHERE (url, strftime(to_timestamp(1704067200 + i2 * 86400) AT TIME ZONE 'UTC', '%Y-%m-%d')) NOT IN (SELECT (url, date) FROM done))"


def _open(spark, sf):
    done = _done(spark, sf).select("url", F.unix_timestamp(F.to_timestamp("date", "yyyy-MM-dd")).alias("day"))
    return scrape.open_relay_days(_registry(spark, sf), F.lit(1704067200), F.lit(1704067200 + 24 * 86400), done)


@query(f"{_OPEN_SQL} SELECT url, CAST(day AS BIGINT) AS day FROM op")
def open_relay_days(spark, sf):
    return _open(spark, sf).select("url", F.col("day").cast("bigint").alias("day"))


@query(f"{_OPEN_SQL} SELECT DISTINCT op.url FROM op JOIN info USING (url) WHERE nip11 IS DISTINCT FROM false AND i % 7 <> 0 AND {NOW} - 1000 + CASE WHEN i % 4 = 0 THEN 0 ELSE 60 * CAST(pow(2, i % 4) AS INT) END <= {NOW}")
def draw_batch(spark, sf):
    return scrape.draw(_registry(spark, sf), _open(spark, sf), F.lit(NOW), 10**6).select("url")


@query(f"{_REG_SQL} SELECT url, sources FROM info WHERE sources >= 3")
def merge_relays(spark, sf):
    reg = _registry(spark, sf)
    return scrape.merge_known(reg.where("i % 2 = 0"), reg.select("url", "sources")).select("url", "sources")


@query(f"{_TRUST_SQL} SELECT kind, {_SPLIT} FROM t GROUP BY ALL")
def kind_breakdown(spark, sf):
    return reports.kind_breakdown(_events(spark, sf), _world(spark, sf))


@query(f"{_TRUST_SQL} SELECT kind, {_SPLIT} FROM t WHERE user_id IN (SELECT followed FROM tiers WHERE followers >= 60 AND tier >= 1) GROUP BY ALL")
def kind_breakdown_filtered(spark, sf):
    return reports.kind_breakdown(_events(spark, sf), _world(spark, sf), 60, 1)


@query(
    f"""{_TRUST_SQL}, n AS (SELECT max(created_at) AS now FROM ev) SELECT lower('Tag' || (k % 20)) AS tag, round(sum(pow(0.5, (now - created_at) / 21600.0) * (1 + 0.5 * coalesce(tier, 0))), 6) AS score, count(*) AS mentions
       FROM ev LEFT JOIN tiers ON user_id = followed, n WHERE kind = 1 GROUP BY ALL ORDER BY score DESC, tag LIMIT 100"""
)
def trending(spark, sf):
    now = _events(spark, sf).agg(F.max("created_at")).first()[0]
    return reports.trending(_events(spark, sf), F.lit(now), _world(spark, sf)).withColumn("score", _r(F.col("score")))


@query(f"{_TRUST_SQL}, k AS (SELECT kind, count(*) AS events FROM t WHERE day = (SELECT max(day) FROM t) GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY events DESC, kind) AS r FROM k) SELECT CASE WHEN r <= 3 THEN kind END AS kind, sum(events)::BIGINT AS events FROM r GROUP BY ALL")
def composition_today(spark, sf):
    return reports.composition(activity_kinds(spark, sf), 3)


@query(f"{X.DOCS_SQL}, s AS (SELECT CAST(strftime(to_timestamp(created_at) AT TIME ZONE 'UTC', '%Y%m') AS INT) AS shard_ym, count(*) AS docs FROM doc GROUP BY ALL) SELECT count(*) FILTER (shard_ym >= 202011) AS in_era, count(*) FILTER (shard_ym < 202011) AS before, arg_max(shard_ym, docs * 1000000 + shard_ym) AS busiest, sum(docs)::BIGINT AS docs FROM s")
def shard_eras(spark, sf):
    return reports.shard_eras(month_shards(spark, sf))


@query(f"{X.DOCS_SQL}, s AS (SELECT CAST(strftime(to_timestamp(created_at) AT TIME ZONE 'UTC', '%Y%m') AS INT) AS shard_ym, count(*) AS docs FROM doc GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY docs DESC, shard_ym) AS r FROM s) SELECT CASE WHEN r <= 2 THEN shard_ym END AS shard_ym, sum(docs)::BIGINT AS docs FROM r GROUP BY ALL")
def top_shards(spark, sf):
    return reports.top_shards(month_shards(spark, sf), 2)


@query(f"{X.EVENTS_SQL} SELECT kind, count(*) AS n FROM ev GROUP BY ALL")
def merge_reports(spark, sf):
    """Two halves of a report, merged as a stream's micro-batches are."""
    e, where = _events(spark, sf), storage.new_path(spark)
    fold = live.merge_into(where, lambda df: df.groupBy("kind").agg(F.sum("n").alias("n")))
    for k in (0, 1):
        fold(e.where(F.col("created_at") % 2 == k).groupBy("kind").agg(F.count(F.lit(1)).alias("n")), k)
    return live.latest(spark, where)


@query()
def document_table(spark, sf):
    """All kinds of events as documents, counted by what they hold."""
    e = _events(spark, sf).unionByName(X.articles(spark, sf).select("id", "pubkey", "created_at", "kind", "tags", "content")).unionByName(X.links(spark, sf).select("id", "pubkey", "created_at", "kind", "tags", "content"))
    d = documents.build(e, _world(spark, sf))
    return d.groupBy("kind", "shard_ym", "wot_tier", "lang").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("tag_host")).alias("hosts"), F.sum(F.coalesce(F.size("content"), F.lit(0))).alias("tokens"))


@query()
def report_stages(spark, sf):
    return spark.createDataFrame([(i, n) for i, names in enumerate(live.stages()) for n in names], "stage int, report string")


# --- reports kept by batch


def _daily(name="daily", depends=(), kinds=None):
    partial = lambda e: e.groupBy(N.day(F.col("created_at")).alias("day"), "kind").agg(F.count(F.lit(1)).alias("n"))
    return state.Report(name, ("day", "kind"), partial, lambda r: r.groupBy("day", "kind").agg(F.sum("n").alias("n")), depends, kinds)


_DAY = "created_at - created_at % 86400"


@query(f"{X.EVENTS_SQL}, dirty AS (SELECT DISTINCT {_DAY} AS day, kind FROM ev WHERE event_id % 100 = 7) SELECT {_DAY} AS day, kind, count(*) AS n FROM ev WHERE ({_DAY}, kind) IN (SELECT (day, kind) FROM dirty) GROUP BY ALL")
def report_deltas(spark, sf):
    """What a second batch changes of a report: the rows of the keys it touches."""
    e = _events(spark, sf)
    last = F.conv(F.col("id"), 16, 10).cast("bigint") % 100 == 7
    kept = state.State(spark, storage.new_path(spark), [_daily()])
    kept.fold("daily", e.where(~last), 0, NOW)
    kept.fold("daily", e.where(last), 1, NOW)
    return kept.delta("daily", 1)


@query(f"{X.EVENTS_SQL} SELECT 'all' AS name, count(*) AS observed, count(*) AS consumed, max(created_at) AS watermark FROM ev UNION ALL SELECT 'zaps', count(*), count(*) FILTER (kind = 9735), max(created_at) FROM ev")
def backfill_counters(spark, sf):
    """Reports in stages over all of the past, and what each took of it."""
    kept = state.State(spark, storage.new_path(spark), [_daily("zaps", ("all",), (9735,)), _daily("all")])
    kept.backfill(_events(spark, sf), now=NOW)
    return kept.health().select("name", "observed", "consumed", "watermark")


@query(f"{X.EVENTS_SQL}, m AS (SELECT max(created_at) AS top FROM ev WHERE event_id % 2 = 0) SELECT count(*) AS observed, count(*) FILTER (event_id % 2 = 0 OR created_at >= top - 21600) AS consumed, count(*) FILTER (event_id % 2 = 1 AND created_at < top - 21600) AS filtered FROM ev, m")
def late_gate(spark, sf):
    """Half of the events as backfill, half live: what is over six hours late is left out."""
    e = _events(spark, sf)
    odd = F.conv(F.col("id"), 16, 10).cast("bigint") % 2 == 1
    kept = state.State(spark, storage.new_path(spark), [_daily()])
    kept.backfill(e.where(~odd), now=NOW)
    kept.fold("daily", e.where(odd), 0, NOW)
    return kept.health().select("observed", "consumed", "filtered")


# --- more of the same


@query(
    """SELECT lpad(lower(to_hex(c_custkey)), 64, '0') AS pubkey, trim(c_name) AS name, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment WHEN c_custkey % 3 = 1 THEN c_name END AS display_name,
              CASE WHEN c_custkey % 2 = 0 THEN 'n' || c_nationkey END AS about FROM customer"""
)
def profile_fields(spark, sf):
    """Customers as profile events: trimmed fields, one name standing in for another."""
    c = X.table(spark, sf, "customer")
    k = F.col("c_custkey") % 3
    body = F.to_json(
        F.struct(
            F.concat(F.lit("  "), F.col("c_name"), F.lit(" ")).alias("name"), F.when(k == 0, F.col("c_mktsegment")).when(k == 2, F.lit(" ")).alias("display_name"), F.when(k < 2, F.col("c_name")).alias("displayName"),
            F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))).otherwise(F.lit("")).alias("about"),
        )
    )
    e = c.select(X.key(F.col("c_custkey")).alias("pubkey"), F.lit(0).cast("bigint").alias("created_at"), body.alias("content"))
    return documents.profile_fields(e).select("pubkey", "name", "display_name", "about")


@query(_rank_sql() + " SELECT node, round(rank * 1000, 6) AS rank FROM r20")
def pagerank_joins(spark, sf):
    """The ranks by joins, as a graph too large for one task has them."""
    return trust.pagerank(_rank_graph(spark, sf), small_edges=0).select("node", _r(F.col("rank") * 1000).alias("rank"))


@query(_rank_sql() + ", t AS (SELECT node, round(rank, 12) AS rank FROM r20) SELECT count(*) AS nodes, round(sum(rank) * 1000, 4) AS rank FROM (SELECT rank FROM t ORDER BY rank DESC LIMIT 1000)")
def top_ranks(spark, sf):
    return trust.top(trust.pagerank(_rank_graph(spark, sf)), 1000).agg(F.count(F.lit(1)).alias("nodes"), F.round(F.sum("rank") * 1000, 4).alias("rank"))


@query(f"{_REG_SQL} SELECT url, CASE WHEN nip11 IS DISTINCT FROM false THEN 0 ELSE i % 4 END AS fails, CASE WHEN nip11 IS NOT DISTINCT FROM false AND i % 7 = 0 THEN {NOW} + 1 END AS dead_until FROM info")
def relay_release(spark, sf):
    return scrape.release(_registry(spark, sf)).select("url", F.col("fails").cast("bigint").alias("fails"), F.col("dead_until").cast("bigint").alias("dead_until"))


@query(f"{_REG_SQL} SELECT url, sources, CAST(NULL AS BIGINT) AS last_ok FROM info")
def relay_reset(spark, sf):
    return scrape.reset_relays(_registry(spark, sf)).select("url", "sources", "last_ok")


@query(
    f"""{_REG_SQL} SELECT url, CASE i % 3 WHEN 0 THEN 0 WHEN 1 THEN i % 4 + 2 ELSE i % 4 END AS fails, CASE i % 3 WHEN 0 THEN greatest({NOW}, CASE WHEN i % 2 = 0 THEN {NOW} - 5000 ELSE 0 END) ELSE CASE WHEN i % 2 = 0 THEN {NOW} - 5000 END END AS last_ok,
        CASE i % 3 WHEN 1 THEN {NOW} + 60 ELSE {NOW} - 1000 END AS last_fail FROM info"""
)
def relay_outcomes(spark, sf):
    """A third of the relays answers, a third fails twice, a third isn't asked."""
    reg = _registry(spark, sf)
    ok = reg.where("i % 3 = 0").select("url", F.lit(NOW).alias("at"), F.lit(True).alias("ok"))
    bad = reg.where("i % 3 = 1").select("url", F.explode(F.array(F.lit(NOW), F.lit(NOW + 60))).alias("at"), F.lit(False).alias("ok"))
    out = scrape.outcomes(reg, ok.unionByName(bad))
    return out.select("url", F.col("fails").cast("bigint").alias("fails"), F.col("last_ok").cast("bigint").alias("last_ok"), F.col("last_fail").cast("bigint").alias("last_fail"))


@query(
    f"""{X.EVENTS_SQL}, w AS (SELECT {_DAY} AS since, count(*) AS n FROM ev GROUP BY ALL), h AS (SELECT unnest([0, 1]) AS h)
       SELECT since + h * 43200 AS since, since + h * 43200 + 43200 AS until FROM w, h WHERE n >= 500 UNION ALL SELECT since, since + 86400 FROM w WHERE n < 500"""
)
def bisected_days(spark, sf):
    """Days with more events than a relay gives at once, cut in two."""
    days = _events(spark, sf).groupBy(N.day(F.col("created_at")).alias("since")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row a day
    return spark.createDataFrame(scrape.bisect([(r["since"], r["since"] + 86_400, r["n"]) for r in days], 500), "since bigint, until bigint")


@query("SELECT k, CAST(2 + floor(78 * least(k / 1000.0, 1.0) + 0.5) AS INT) AS percent FROM (SELECT DISTINCT o_custkey AS k FROM orders)")
def adaptive_percent(spark, sf):
    k = X.table(spark, sf, "orders").select(F.col("o_custkey").alias("k")).distinct().collect()
    return spark.createDataFrame([(r["k"], scrape.adaptive_percentile(r["k"], 1000)) for r in k], "k bigint, percent int")


@query("SELECT k, greatest(1704067200 - (k + 1) * 2592000, 1640995200)::BIGINT AS since, (1704067200 - k * 2592000)::BIGINT AS until FROM (SELECT DISTINCT n_nationkey AS k FROM nation)")
def block_windows(spark, sf):
    k = X.table(spark, sf, "nation").select("n_nationkey").distinct().collect()
    return spark.createDataFrame([(r[0], *scrape.block_window(r[0], 1704067200 + 100)) for r in k], "k int, since bigint, until bigint")


@query("SELECT event_id, event_id * 7 % 65536 IN (0, 1, 20, 21, 22, 1063, 1111, 1222, 1244, 1617, 1621, 1622, 9802, 30017, 30018, 30023, 30024, 30311, 30402, 31922, 31923, 34550) AS text FROM events")
def text_kinds(spark, sf):
    return X.table(spark, sf, "events").select("event_id", N.is_text_kind((F.col("event_id") * 7 % 65536).cast("int")).alias("text"))


def _event_documents(spark, sf):
    """Events with a place each, as documents."""
    e = _events(spark, sf)
    n = F.conv(F.col("id"), 16, 10).cast("bigint")
    cell = F.array(F.lit("g"), F.concat(F.lit("u4pruy"), F.lpad((n % 50).cast("string"), 2, "0")))
    return documents.build(e.withColumn("tags", F.concat("tags", F.array(cell))), detect=False)


def _event_sql(cond: str) -> str:
    return f"{X.EVENTS_SQL} SELECT lpad(lower(to_hex(event_id)), 64, '0') AS event_id FROM ev WHERE {cond}"


@query(_event_sql("event_id % 50 BETWEEN 10 AND 19"))
def search_geo(spark, sf):
    """Everything in a cell, however fine it was given."""
    return _matching(_event_documents(spark, sf), SearchFilter(search="geo:U4PRUY1 until:2100-01-01")).select("event_id")


@query(_event_sql("kind = 1 AND k % 20 = 3"))
def search_hashtag(spark, sf):
    return _matching(_event_documents(spark, sf), SearchFilter(search="#TAG3 until:2100-01-01")).select("event_id")


@query(_event_sql("user_id IN (10, 11) AND kind IN (1, 7)"))
def search_author(spark, sf):
    """Authors by key in any case or encoded; what can't be read as one names nobody."""
    f = SearchFilter(authors=[f"{10:064X}", bech32.encode_key("npub", f"{11:064x}"), "npub1nobody"], kinds=[1, 7], until=1 << 40)
    return _matching(_event_documents(spark, sf), f).select("event_id")


@query(_event_sql("kind = 1 AND k % 20 = 10 AND created_at >= 1704412800 AND created_at < 1705708800"))
def search_lists(spark, sf):
    """Structured lists beside the operators of the text: all must hold."""
    f = SearchFilter(search="kind:1 since:2024-01-05 until:2024-01-20", kinds=[1, 1984], tags={"t": ["Tag10", "none"]}, until=1 << 40)
    return _matching(_event_documents(spark, sf), f).select("event_id")


@query(_having("regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])of[^\\p{L}\\p{N}]+the([^\\p{L}\\p{N}]|$)')"))
def search_joined(spark, sf):
    """A word that is two tokens is a phrase."""
    return search.indexed(_index(spark, sf), "of-the").select("doc_id")


@query(_having(f"{_has('the')} AND EXISTS (SELECT 1 FROM post p WHERE p.doc_id = doc.doc_id AND term LIKE 'whe%')"))
def search_prefix(spark, sf):
    return search.indexed(_index(spark, sf), "the whe*").select("doc_id")


@query(f"{X.EVENTS_SQL} SELECT kind, count(*) AS docs, sum(CASE WHEN kind IN (0, 1) THEN 1 ELSE 0 END)::BIGINT AS tokens FROM ev GROUP BY ALL")
def document_tokens(spark, sf):
    """Tokens of events as documents: one word each, of kinds that are text only."""
    d = _event_documents(spark, sf)
    return d.groupBy("kind").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.coalesce(F.size("content"), F.lit(0))).cast("bigint").alias("tokens"))


@query("SELECT count(*) AS events FROM events")
def archive_totals(spark, sf):
    """Events written to an archive in two overlapping lots: each is there once."""
    where = storage.new_path(spark)
    e = _events(spark, sf).withColumn("sig", F.lit("c" * 128))
    for k in (0, 1):
        archive.append_new(e.where(F.conv(F.col("id"), 16, 10).cast("bigint") % 3 != k), where)
    return archive.totals(spark.read.parquet(where))
