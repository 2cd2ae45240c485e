"""The reports: activity, zaps, audiences, clients, relays, hashtags.

Each is one aggregation whose measures merge, so the same function serves
batches and ``foreachBatch``.  ``world`` is (pubkey, followers, wot_tier, ...);
tier 1 and more is trusted, an unknown key is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwave.functions import normalize as N
from siftwave.functions.bech32 import invoice_msats_col
from siftwave.model import HALF_LIFE_S, MAX_CLIENTS, MAX_RELAYS, TIER_WEIGHT, TRENDING_KINDS


def _count(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


def foldable(events: DataFrame) -> DataFrame:
    """Events whose id and key are well formed."""
    return events.where(N.is_key(F.col("id")) & N.is_key(F.col("pubkey")))


def with_trust(df: DataFrame, world: DataFrame, key: str = "pubkey", name: str = "trusted") -> DataFrame:
    known = world.where("wot_tier >= 1").select(F.col("pubkey").alias("__w"), F.lit(True).alias("__t"))
    return df.join(known, F.col(key) == F.col("__w"), "left").withColumn(name, F.coalesce("__t", F.lit(False))).drop("__w", "__t")


def split_count(trusted: str = "trusted") -> list[Column]:
    return [F.count_if(F.col(trusted)).alias("trusted"), F.count_if(~F.col(trusted)).alias("untrusted")]


def activity_kinds(events: DataFrame, world: DataFrame) -> DataFrame:
    e = with_trust(foldable(events).select("pubkey", "kind", N.day(F.col("created_at")).alias("day")), world)
    return e.groupBy("day", "kind").agg(*split_count())


def zaps(events: DataFrame) -> DataFrame:
    """(day, sats, sender, recipient) of the receipts that have an amount: that of
    the invoice, else that asked for.  Parties come from the tags, else from the
    request."""
    e = foldable(events).where("kind = 9735")
    tags = F.col("tags")
    req = F.from_json(N.tag_value(tags, "description"), "pubkey string, tags array<array<string>>")
    own = lambda s: F.when(N.is_key(s), F.lower(s))
    asked = F.try_to_number(F.regexp_extract(N.tag_value(F.col("req.tags"), "amount"), r"^(\d{1,18})$", 1), F.lit("9" * 18)).cast("bigint")
    # invoices need Python: only rows that have one go there
    bolt = N.tag_value(tags, "bolt11")
    e = e.withColumn("req", req).withColumn("asked", asked).withColumn("bolt", bolt)
    plain, invoiced = e.where("bolt is null").withColumn("msats", F.col("asked")), e.where("bolt is not null").withColumn("msats", F.coalesce(invoice_msats_col(F.col("bolt")), F.col("asked")))
    both = plain.unionByName(invoiced).where("msats is not null")
    return both.select(
        N.day(F.col("created_at")).alias("day"), F.expr("msats div 1000").alias("sats"), F.coalesce(own(N.tag_value(tags, "P")), own(F.col("req.pubkey"))).alias("sender"),
        F.coalesce(own(N.tag_value(tags, "p")), own(N.tag_value(F.col("req.tags"), "p"))).alias("recipient"),
    )


def activity_zaps(events: DataFrame, world: DataFrame) -> DataFrame:
    z = with_trust(with_trust(zaps(events), world, "sender", "ts"), world, "recipient", "tr")
    total = lambda c, name: F.coalesce(F.sum(F.when(c, F.col("sats"))), F.lit(0)).alias(name)
    return z.groupBy("day").agg(_count("receipts"), total(F.col("ts"), "sent_trusted"), total(~F.col("ts"), "sent_untrusted"), total(F.col("tr"), "received_trusted"), total(~F.col("tr"), "received_untrusted"))


def day_totals(kinds: DataFrame, zap_days: DataFrame) -> DataFrame:
    k = kinds.groupBy("day").agg(F.sum(F.col("trusted") + F.col("untrusted")).alias("events"))
    z = zap_days.select("day", (F.col("sent_trusted") + F.col("sent_untrusted")).alias("zaps_sats"))
    return k.join(z, "day", "full").select("day", F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("zaps_sats", F.lit(0)).alias("zaps_sats"))


def active_users(events: DataFrame, world: DataFrame, bucket=N.day) -> DataFrame:
    """Distinct authors by day (or week), exact."""
    e = with_trust(foldable(events).select("pubkey", bucket(F.col("created_at")).alias("bucket")).distinct(), world)
    return e.groupBy("bucket").agg(_count("total"), F.count_if("trusted").alias("trusted"), F.count_if(~F.col("trusted")).alias("untrusted"))


def active_users_sketch(events: DataFrame, world: DataFrame, bucket=N.day) -> DataFrame:
    """The same as mergeable sketches: (bucket, all, trusted_only) binaries."""
    e = with_trust(foldable(events).select("pubkey", bucket(F.col("created_at")).alias("bucket")), world)
    return e.groupBy("bucket").agg(F.hll_sketch_agg("pubkey", F.lit(14)).alias("all"), F.hll_sketch_agg(F.when(F.col("trusted"), F.col("pubkey")), F.lit(14)).alias("trusted_only"))


def merge_sketches(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("bucket").agg(F.hll_union_agg("all").alias("all"), F.hll_union_agg("trusted_only").alias("trusted_only"))


def sketch_estimates(sketches: DataFrame) -> DataFrame:
    total, trusted = F.hll_sketch_estimate("all"), F.coalesce(F.hll_sketch_estimate("trusted_only"), F.lit(0))
    return sketches.select("bucket", total.alias("total"), trusted.alias("trusted"), F.greatest(total - trusted, F.lit(0)).alias("untrusted"))


def client_kinds(events: DataFrame) -> DataFrame:
    c = foldable(events).select(N.client_name(N.tag_value(F.col("tags"), "client")).alias("client"), "kind", "created_at", "id")
    return c.groupBy("client", "kind").agg(_count("n"), F.max("created_at").alias("last"), F.min(F.struct("created_at", "id")).alias("first"))


def clients(kinds: DataFrame, most: int = MAX_CLIENTS) -> DataFrame:
    """(client, events, last_seen); names seen after the first ``most`` are ``(other)``."""
    c = kinds.groupBy("client").agg(F.sum("n").alias("events"), F.max("last").alias("last_seen"), F.min("first").alias("first"))
    if c.limit(most + 1).count() <= most:
        return c.drop("first")
    c = c.join(c.orderBy("first").limit(most).select(F.col("client").alias("__k")), F.col("client") == F.col("__k"), "left")
    return c.groupBy(F.coalesce("__k", F.lit("(other)")).alias("client")).agg(F.sum("events").alias("events"), F.max("last_seen").alias("last_seen"))


def client_share(c: DataFrame, n: int = 14) -> DataFrame:
    total = c.agg(F.sum("events").alias("__all"))
    return c.crossJoin(F.broadcast(total)).select("client", "events", F.round(F.col("events") * 100.0 / F.col("__all"), 6).alias("share")).orderBy(F.desc("events"), "client").limit(n)


def relay_urls(events: DataFrame) -> DataFrame:
    e = foldable(events).where("kind = 10002")
    urls = F.array_distinct(F.transform(F.concat(N.tag_values(F.col("tags"), "r"), N.tag_values(F.col("tags"), "u")), N.relay_url))
    return e.select("id", "pubkey", "created_at", F.explode(urls).alias("url")).where("url is not null")


def relays(events: DataFrame, most: int = MAX_RELAYS) -> DataFrame:
    """(url, advertisers, last_seen), exact; the ``most`` first seen."""
    r = relay_urls(events).groupBy("url").agg(F.countDistinct("pubkey").alias("advertisers"), F.max("created_at").alias("last_seen"), F.min(F.struct("created_at", "id")).alias("first"))
    return r.orderBy("first", "url").limit(most).drop("first")


def ranked(r: DataFrame) -> DataFrame:
    return r.orderBy(F.desc("advertisers"), "url")


def kind_breakdown(events: DataFrame, world: DataFrame, min_followers: int = 0, min_tier: int = 0) -> DataFrame:
    """kind -> trusted, untrusted; publishers under a limit don't count."""
    e = foldable(events).select("pubkey", "kind")
    if min_followers or min_tier:
        ok = world.where((F.col("followers") >= min_followers) & (F.col("wot_tier") >= min_tier)).select("pubkey")
        e = e.join(ok, "pubkey", "left_semi")
    return with_trust(e, world).groupBy("kind").agg(*split_count())


def trending(events: DataFrame, now: Column, world: DataFrame | None = None, n: int = 100) -> DataFrame:
    """(tag, score, mentions): halved every six hours, more for trusted authors."""
    e = foldable(events).where(F.col("kind").isin(*TRENDING_KINDS)).select("pubkey", "created_at", F.explode(N.tag_values(F.col("tags"), "t")).alias("tag")).withColumn("tag", F.lower("tag"))
    if world is not None:
        e = e.join(world.where("wot_tier > 0").select("pubkey", "wot_tier"), "pubkey", "left")
    tier = F.coalesce("wot_tier", F.lit(0)) if world is not None else F.lit(0)
    weight = F.pow(F.lit(0.5), F.greatest(now - F.col("created_at"), F.lit(0)) / float(HALF_LIFE_S)) * (1 + TIER_WEIGHT * tier)
    return e.groupBy("tag").agg(F.sum(weight).alias("score"), _count("mentions")).orderBy(F.desc("score"), "tag").limit(n)


# --- what the console derives


def plausible(df: DataFrame, now: Column, day: str = "day") -> DataFrame:
    return df.where((F.col(day) >= 1_577_836_800) & (F.col(day) <= now + 86_400))


def last_days(totals: DataFrame, n: int = 90) -> DataFrame:
    return totals.orderBy(F.desc("day")).limit(n)


def last_days_summary(totals: DataFrame, n: int = 90) -> DataFrame:
    return last_days(totals, n).agg(F.count(F.lit(1)).alias("days"), F.sum("events").alias("events"), F.sum("zaps_sats").alias("zaps_sats"), F.max("events").alias("peak"))


def kinds_all_time(kinds: DataFrame, n: int = 14) -> DataFrame:
    k = kinds.groupBy("kind").agg(F.sum("trusted").alias("trusted"), F.sum("untrusted").alias("untrusted"))
    return k.withColumn("events", F.col("trusted") + F.col("untrusted")).orderBy(F.desc("events"), "kind").limit(n)


def trusted_share(df: DataFrame) -> DataFrame:
    total = F.col("trusted") + F.col("untrusted")
    return df.withColumn("share", F.when(total > 0, F.round(F.col("trusted") * 100.0 / total, 6)))


def composition(kinds: DataFrame, n: int = 7) -> DataFrame:
    """Kinds of the latest day: the ``n`` largest and the rest (kind null)."""
    last = kinds.agg(F.max("day").alias("__d"))
    k = kinds.join(F.broadcast(last), F.col("day") == F.col("__d")).select("kind", (F.col("trusted") + F.col("untrusted")).alias("events"))
    k = k.withColumn("__r", F.row_number().over(Window.orderBy(F.desc("events"), "kind")))
    return k.groupBy(F.when(F.col("__r") <= n, F.col("kind")).alias("kind")).agg(F.sum("events").alias("events"))


def clients_since(c: DataFrame, at: Column) -> DataFrame:
    return c.agg(F.count_if(F.col("last_seen") >= at).alias("active"))


def shard_eras(shards: DataFrame, first: int = 202011) -> DataFrame:
    return shards.agg(F.count_if(F.col("shard_ym") >= first).alias("in_era"), F.count_if(F.col("shard_ym") < first).alias("before"), F.max_by("shard_ym", F.struct("docs", "shard_ym")).alias("busiest"), F.sum("docs").alias("docs"))


def top_shards(shards: DataFrame, n: int = 10) -> DataFrame:
    s = shards.withColumn("__r", F.row_number().over(Window.orderBy(F.desc("docs"), "shard_ym")))
    return s.groupBy(F.when(F.col("__r") <= n, F.col("shard_ym")).alias("shard_ym")).agg(F.sum("docs").alias("docs"))
