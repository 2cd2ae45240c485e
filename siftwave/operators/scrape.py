"""Planning of gap scrapes: which relays, which days, what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwave.functions.normalize import backoff_seconds
from siftwave.model import DAY

MIN_DATE, BLOCK_DAYS = 1_640_995_200, 30


def usage_cut(relays: DataFrame, percent: int, min_keep: int = 1) -> DataFrame:
    """The most advertised relays that together have ``percent`` of all
    advertisers, ``min_keep`` at least; what's known not to be a relay is out."""
    r = relays.where(F.coalesce(F.col("nip11"), F.lit(True)))
    if percent >= 100:
        return r
    total = r.agg(F.coalesce(F.sum("sources"), F.lit(0)).alias("__total"))
    line = Window.orderBy(F.desc("sources"), "url")
    before = F.coalesce(F.sum("sources").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row per relay of a registry: few enough for one ordered task
    r = r.withColumns({"__before": before, "__place": F.row_number().over(line)}).crossJoin(F.broadcast(total))
    want = F.expr(f"__total * {int(percent)} div 100")
    keep = (F.col("__total") == 0) | (F.col("__place") <= max(min_keep, 1)) | (F.col("__before") < want)
    return r.where(keep).drop("__before", "__place", "__total")


def adaptive_percentile(done: int, expected: int, low: int = 2, high: int = 80) -> int:
    share = min(max(done / expected, 0.0), 1.0) if expected else 1.0
    return low + int((high - low) * share + 0.5)


def block_window(k: int, today: int) -> tuple[int, int]:
    """The k-th window of 30 days back from the start of ``today``."""
    end = today - today % DAY - k * BLOCK_DAYS * DAY
    return max(end - BLOCK_DAYS * DAY, MIN_DATE), end


def open_relay_days(relays: DataFrame, first: Column, last: Column, done: DataFrame) -> DataFrame:
    """(url, day) of the days in [first, last] that ``done`` (url, day) lacks."""
    days = relays.select("url", F.explode(F.sequence(first, last, F.lit(DAY))).alias("day"))
    return days.join(done.select("url", "day"), ["url", "day"], "left_anti")


def draw(relays: DataFrame, open_days: DataFrame, now: Column, limit: int, seed: int = 0, busy: DataFrame | None = None) -> DataFrame:
    """At most ``limit`` (url, day): one open day of each relay that is a relay,
    isn't retired, backing off or busy; which is by a seeded hash."""
    ready = (F.coalesce(F.col("nip11"), F.lit(True))) & (F.coalesce(F.col("dead_until"), F.lit(0)) <= now) & (F.coalesce(F.col("last_fail"), F.lit(0)) + backoff_seconds(F.coalesce(F.col("fails"), F.lit(0))) <= now)
    r = relays.where(ready)
    if busy is not None:
        r = r.join(busy.select("url"), "url", "left_anti")
    mine = open_days.join(r.select("url"), "url", "left_semi")
    w = Window.partitionBy("url").orderBy(F.xxhash64(F.lit(seed), "url", "day"), "day")
    one = mine.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    return one.orderBy(F.xxhash64(F.lit(seed + 1), "url"), "url").limit(limit)


def progress(done: DataFrame) -> DataFrame:
    return done.agg(F.count(F.lit(1)).alias("relay_days"), F.countDistinct("date").alias("days"), F.coalesce(F.sum("seen"), F.lit(0)).alias("events_seen"), F.coalesce(F.sum("new"), F.lit(0)).alias("events_new"), F.min("date").alias("oldest_day"), F.max("date").alias("newest_day"))


def progress_by_relay(done: DataFrame) -> DataFrame:
    return done.groupBy("url").agg(F.count(F.lit(1)).alias("days"), F.sum("seen").alias("seen"), F.sum("new").alias("new"))


def recent(done: DataFrame, n: int = 25) -> DataFrame:
    return done.orderBy(F.desc("at"), "url", "date").limit(n)


def recent_by_date(done: DataFrame, n: int = 25) -> DataFrame:
    return recent(done, n).groupBy("date").agg(F.sum("seen").alias("seen"), F.sum("new").alias("new"), F.countDistinct("url").alias("relays"))


def horizon(kept: DataFrame, done: DataFrame, days: int) -> DataFrame:
    """Relay-days in all, done and left; only days of ``kept`` relays count."""
    n = kept.agg(F.count(F.lit(1)).alias("relays"))
    d = done.join(kept.select("url"), "url", "left_semi").agg(F.count(F.lit(1)).alias("__done"))
    total = F.col("relays") * days
    return n.crossJoin(d).select(
        "relays", F.lit(days).cast("bigint").alias("days"), total.alias("total"), F.least("__done", total).alias("done"), F.greatest(total - F.col("__done"), F.lit(0)).alias("remaining"),
        F.when(total == 0, 100).otherwise(F.least("__done", total) * 100 / F.greatest(total, F.lit(1))).cast("int").alias("percent"),
    )


def health(relays: DataFrame) -> DataFrame:
    return relays.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("negentropy")).alias("negentropy"), F.count_if(~F.col("negentropy")).alias("no_negentropy"), F.count_if(F.col("negentropy").isNull()).alias("unprobed"), F.count_if(F.col("fails") > 0).alias("failing"))


def page(relays: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    return relays.orderBy(F.desc("sources"), "url").offset(max(offset, 0)).limit(min(max(limit, 1), 500))


def merge_known(known: DataFrame, found: DataFrame, min_sources: int = 3) -> DataFrame:
    """Found relays (url, sources) with what is known of them; those of fewer
    than ``min_sources`` advertisers aren't taken up."""
    return found.where(F.col("sources") >= min_sources).join(known.drop("sources"), "url", "left")


def outcomes(relays: DataFrame, results: DataFrame, dead_for: int = 30 * DAY) -> DataFrame:
    """Registry after ``results`` (url, at, ok): a success clears the failures; a
    relay retires after five failures if it never answered, else once it has
    been silent for ``dead_for``."""
    r = results.groupBy("url").agg(F.max(F.when(F.col("ok"), F.col("at"))).alias("__ok"), F.max(F.when(~F.col("ok"), F.col("at"))).alias("__bad"), F.max(F.when(~F.col("ok"), F.struct("at"))).alias("__x"), F.collect_list(F.struct("at", "ok")).alias("__all")).drop("__x")
    since = F.size(F.filter("__all", lambda x: ~x["ok"] & (F.col("__ok").isNull() | (x["at"] > F.col("__ok")))))
    j = relays.join(r, "url", "left")
    fails = F.when(F.col("__all").isNull(), F.col("fails")).when(F.col("__ok").isNotNull(), since).otherwise(F.coalesce("fails", F.lit(0)) + since).cast("int")
    last_ok, last_fail = F.greatest("last_ok", "__ok"), F.greatest("last_fail", "__bad")
    j = j.withColumns({"fails": fails, "last_ok": last_ok, "last_fail": last_fail})
    dead = F.when(F.col("last_ok").isNull(), F.col("fails") >= 5).otherwise(F.col("last_fail") - F.col("last_ok") >= dead_for) & (F.col("fails") > 0)
    return j.withColumn("dead_until", F.when(dead & F.col("__bad").isNotNull(), F.col("last_fail") + dead_for).when(F.col("__ok").isNotNull(), F.lit(None)).otherwise(F.col("dead_until"))).drop("__ok", "__bad", "__all")


def release(relays: DataFrame) -> DataFrame:
    """Start of a pass: retired relays get another chance unless they're known not to be relays."""
    ok = F.coalesce(F.col("nip11"), F.lit(True))
    return relays.withColumns({"dead_until": F.when(ok, F.lit(None).cast("bigint")).otherwise(F.col("dead_until")), "fails": F.when(ok, 0).otherwise(F.col("fails"))})


def matching(done: DataFrame, relay: str | None = None, since: str | None = None, until: str | None = None) -> Column:
    """Completed days that a reset takes back; both dates count."""
    c = F.lit(True)
    if relay is not None:
        c = c & (F.col("url") == relay)
    if since is not None:
        c = c & (F.col("date") >= since)
    return c & (F.col("date") <= until) if until is not None else c


def reset(done: DataFrame, **which) -> DataFrame:
    return done.where(~matching(done, **which))


def reset_relays(relays: DataFrame) -> DataFrame:
    keep = {"url", "sources"}
    return relays.select(*[F.col(c) if c in keep else F.lit(None).cast(t).alias(c) for c, t in relays.dtypes])


def nip11_stale(relays: DataFrame, now: Column, days: int = 7) -> DataFrame:
    return relays.where(F.col("nip11_at").isNull() | (F.col("nip11_at") + days * DAY <= now))


def bisect(windows: list[tuple[int, int, int]], cap: int, floor: int = 600) -> list[tuple[int, int]]:
    """Windows (since, until, count) that are too full, cut in two."""
    out = []
    for since, until, n in windows:
        half = (until - since) // 2
        out += [(since, since + half), (since + half, until)] if n >= max(cap, 500) and half >= floor else [(since, until)]
    return out
