"""The driver's tables as events: integer arithmetic only, so that SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(n) -> F.Column:
    return F.lpad(F.lower(F.hex(n.cast("bigint"))), 64, "0")


def seconds(ts) -> F.Column:
    return F.expr(f"unix_micros(cast({ts} as timestamp)) div 1000000")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream: clients, hashtags and zaps as tags."""
    e = table(spark, sf_dir, "events").withColumn("k", F.regexp_extract("props", r'"k":\s*(\d+)', 1).cast("bigint"))
    kind = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 7).when(F.col("event_type") == "signup", 0).when(F.col("event_type") == "purchase", 9735).otherwise(1984)
    e = e.withColumn("kind", kind)
    none = F.lit(None).cast("array<string>")
    client = F.when(F.col("k") % 5 != 0, F.array(F.lit("client"), F.concat(F.lit("Client-"), (F.col("k") % 12).cast("string"), F.lit(" - 1."), (F.col("k") % 3).cast("string")))).otherwise(none)
    topic = F.when(F.col("kind") == 1, F.array(F.lit("t"), F.concat(F.lit("Tag"), (F.col("k") % 20).cast("string")))).otherwise(none)
    zap = F.col("kind") == 9735
    msats = F.expr("cast(round(value * 100) as bigint) * 1000 div 7").cast("string")
    request = F.concat(F.lit('{"tags":[["amount","'), msats, F.lit('"]]}'))
    tags = [client, topic, F.when(zap, F.array(F.lit("P"), key(F.col("user_id")))).otherwise(none), F.when(zap, F.array(F.lit("p"), key((F.col("user_id") * 7 + 3) % 150))).otherwise(none), F.when(zap, F.array(F.lit("description"), request)).otherwise(none)]
    return e.select(
        key(F.col("event_id")).alias("id"), key(F.col("user_id")).alias("pubkey"), seconds("ts").alias("created_at"), F.col("kind").cast("int").alias("kind"),
        F.filter(F.array(*tags), lambda t: t.isNotNull()).alias("tags"), F.col("event_type").alias("content"),
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as events; ``truth`` keeps the table's language, ``doc_id`` its id."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        key(F.col("doc_id")).alias("id"), key(F.col("doc_id") % 97).alias("pubkey"), (F.lit(1704067200) + F.col("doc_id") * 3600).alias("created_at"),
        F.when(F.regexp_extract("source", r"(\d+)$", 1).cast("int") % 2 == 0, 30023).otherwise(1).alias("kind"), F.array().cast("array<array<string>>").alias("tags"),
        F.coalesce("text", F.lit("")).alias("content"), F.col("lang").alias("truth"), "doc_id",
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as relay lists: an ``r`` tag each."""
    p = table(spark, sf_dir, "pages")
    relay = F.regexp_replace("url", "^https?", "wss")
    return p.select(
        key(F.col("page_id")).alias("id"), key(F.col("page_id") % 40).alias("pubkey"), (F.lit(1704067200) + F.col("page_id") * 60).alias("created_at"),
        F.lit(10002).alias("kind"), F.array(F.array(F.lit("r"), relay)).alias("tags"), F.lit("").alias("content"), "page_id", "url",
    )


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as follow lists: (author, created_at, tie, follows), one row per list."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    lists = li.groupBy("l_orderkey").agg(F.collect_list("l_suppkey").alias("follows"))
    return o.join(lists, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("author"), seconds("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("tie"), "follows")


# --- the same in SQL

_K = "CAST(regexp_extract(props, '\"k\":\\s*(\\d+)', 1) AS BIGINT)"
EVENTS_SQL = f"""ev AS (
  SELECT event_id, user_id, epoch_us(ts) // 1000000 AS created_at, value, {_K} AS k,
         CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 7 WHEN 'signup' THEN 0 WHEN 'purchase' THEN 9735 ELSE 1984 END AS kind
  FROM events)"""
DOCS_SQL = """doc AS (
  SELECT doc_id, coalesce(text, '') AS text, lang, 1704067200 + doc_id * 3600 AS created_at,
         CASE WHEN CAST(regexp_extract(source, '(\\d+)$', 1) AS INT) % 2 = 0 THEN 30023 ELSE 1 END AS kind, doc_id % 97 AS author
  FROM documents)"""
TOKENS_SQL = """raw AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) AS t FROM doc),
tok AS (
  SELECT doc_id, replace(strip_accents(lower(t)), 'ß', 'ss') AS term FROM raw WHERE strlen(t) < 40),
post AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL)"""
LATEST_SQL = """latest AS (
  SELECT o_custkey AS author, o_orderkey FROM orders JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON o_orderkey = l_orderkey
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
edges AS (SELECT author, l_suppkey AS followed FROM latest JOIN lineitem ON o_orderkey = l_orderkey),
followers AS (SELECT followed, count(*) AS followers FROM edges GROUP BY ALL),
tiers AS (
  SELECT followed, followers, CASE WHEN followers < 10 THEN 0 WHEN followers < 100 THEN 1 WHEN followers < 1000 THEN 2 WHEN followers < 10000 THEN 3 ELSE 4 END AS tier
  FROM followers)"""
