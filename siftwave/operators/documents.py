"""From events to flat search documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwave.functions import normalize as N
from siftwave.functions.language import detect_col
from siftwave.functions.text import tokens


def _profile(parsed: Column, name: str) -> Column:
    """A string field of a profile's parsed JSON; null for any other type."""
    kind = F.schema_of_variant(F.try_variant_get(parsed, f"$.{name}", "variant"))
    return F.when(kind == "STRING", F.try_variant_get(parsed, f"$.{name}", "string"))


def profile_fields(events: DataFrame) -> DataFrame:
    """(pubkey, created_at, name, display_name, picture, about, nip05, website) of profile
    events: trimmed, null where empty or not a string; ``displayName`` stands in."""
    parsed = events.withColumn("__p", F.try_parse_json(F.coalesce("content", F.lit(""))))
    some = lambda name: F.nullif(F.trim(_profile(F.col("__p"), name)), F.lit(""))
    fields = {n: some(n) for n in ("name", "picture", "about", "nip05", "website")}
    return parsed.select("pubkey", "created_at", F.coalesce(some("display_name"), some("displayName")).alias("display_name"), *[c.alias(n) for n, c in fields.items()])


def _some(*columns: Column) -> Column:
    return F.filter(F.array(*columns), lambda x: x.isNotNull())


def build(events: DataFrame, world: DataFrame | None = None, detect: bool = True) -> DataFrame:
    """One row per event: folded ids, token columns, tag columns, language, tier.

    ``world`` (pubkey, wot_tier) stamps each document with its author's tier.
    """
    tags, content, profile = F.col("tags"), F.coalesce("content", F.lit("")), F.col("kind") == 0
    only = lambda c: F.when(profile, c)
    title = F.concat(_some(N.tag_value(tags, "title"), N.tag_value(tags, "subject")), _some(*[only(_profile(F.col("__p"), k)) for k in ("name", "display_name", "displayName", "username")]))
    summary = F.concat(_some(*[N.tag_value(tags, k) for k in ("summary", "description", "alt")]), _some(*[only(_profile(F.col("__p"), k)) for k in ("about", "bio")]))
    urls = F.concat(N.tag_values(tags, "r"), N.tag_values(tags, "u"))
    hosts = F.filter(F.concat(F.transform(urls, N.url_host), F.array(only(N.url_host(_profile(F.col("__p"), "website"))))), lambda h: h.isNotNull())
    text = N.is_text_kind(F.col("kind"))
    events = events.withColumn("__p", F.when(profile, F.try_parse_json(content)))
    out = events.withColumns({"__title": title, "__summary": summary}).select(
        N.fold_hex(F.col("id")).alias("event_id"), N.fold_hex(F.col("pubkey")).alias("pubkey"), "kind", "created_at", N.month_shard(F.col("created_at")).alias("shard_ym"),
        F.when(text, tokens(content)).alias("content"), F.flatten(F.transform("__title", tokens)).alias("title"), F.flatten(F.transform("__summary", tokens)).alias("summary"),
        F.get("__title", F.lit(0)).alias("first_title"), content.alias("raw_content"), F.transform(N.tag_values(tags, "t"), F.lower).alias("tag_t"),
        *[F.transform(N.tag_values(tags, k), N.fold_hex).alias(f"tag_{k}") for k in "ep"], F.transform(N.tag_values(tags, "a"), N.fold_coordinate).alias("tag_a"),
        _some(N.tag_value(tags, "d")).alias("tag_d"), F.flatten(F.transform(N.tag_values(tags, "g"), N.geohash_prefixes)).alias("tag_g"), N.tag_values(tags, "l").alias("tag_l"),
        urls.alias("tag_url"), hosts.alias("tag_host"), _some(only(N.fold_nip05(_profile(F.col("__p"), "nip05")))).alias("nip05"),
        (F.when(text, detect_col(content)) if detect else F.lit(None).cast("string")).alias("lang"),
    )
    if world is None:
        return out.withColumn("wot_tier", F.lit(0).cast("tinyint"))
    tier = world.where("wot_tier > 0").select(F.col("pubkey").alias("__p"), F.col("wot_tier").cast("tinyint").alias("__t"))
    return out.join(tier, F.col("pubkey") == F.col("__p"), "left").withColumn("wot_tier", F.coalesce("__t", F.lit(0).cast("tinyint"))).drop("__p", "__t")


def write(docs: DataFrame, path: str, per_file: int = 5_000_000) -> None:
    """Monthly partitions, ranged by time: a large month is of many tasks and files."""
    ranged = docs.repartitionByRange("shard_ym", "created_at", "event_id").sortWithinPartitions("shard_ym", "created_at")
    ranged.write.mode("append").option("maxRecordsPerFile", per_file).partitionBy("shard_ym").parquet(path)
