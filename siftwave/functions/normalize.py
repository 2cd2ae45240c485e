"""Normalisers (Column in, Column out).  None of them throws on any input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwave.model import DAY, MAX_CLIENT_BYTES, TEXT_KINDS, WEEK

NATO = (
    "alfa alpha bravo charlie delta echo foxtrot golf hotel india juliett juliet kilo lima mike november oscar papa quebec romeo "
    "sierra tango uniform victor whiskey xray yankee zulu"
).split()


def tag_values(tags: Column, name: str) -> Column:
    """Second item of every tag called ``name`` that has one."""
    return F.transform(F.filter(tags, lambda t: (F.size(t) >= 2) & (F.get(t, F.lit(0)) == name)), lambda t: F.get(t, F.lit(1)))


def tag_value(tags: Column, name: str) -> Column:
    return F.get(tag_values(tags, name), F.lit(0))


def kind_class(kind: Column) -> Column:
    return (
        F.when(kind.isin(0, 3) | kind.between(10_000, 19_999), "replaceable")
        .when(kind.between(30_000, 39_999), "addressable")
        .when(kind.between(20_000, 29_999), "ephemeral")
        .when(kind == 5, "deletion")
        .otherwise("regular")
    )


def is_text_kind(kind: Column) -> Column:
    return kind.isin(*TEXT_KINDS)


def is_key(s: Column) -> Column:
    """64 hex digits: what every analysis asks of an id or a key."""
    return F.coalesce(s.rlike("^[0-9a-fA-F]{64}$"), F.lit(False))


def fold_hex(s: Column) -> Column:
    return F.when(s.rlike("^[0-9A-Fa-f]*$"), F.lower(s)).otherwise(s)


def fold_coordinate(s: Column) -> Column:
    """``kind:pubkey[:d]`` with the key folded, whatever follows left as it is."""
    part = F.split(s, ":", 3)
    return F.when(F.size(part) >= 2, F.concat_ws(":", F.get(part, F.lit(0)), fold_hex(F.get(part, F.lit(1))), F.get(part, F.lit(2)))).otherwise(s)


def fold_nip05(s: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(s)), "^_@", "")


def url_host(url: Column) -> Column:
    """Host of a URL or of something like one; null where it has no inner dot."""
    s = F.trim(url)
    s = F.when(s.contains("://"), F.regexp_replace(s, "^.*?://", "")).otherwise(F.regexp_replace(s, "^/+", ""))
    s = F.regexp_extract(s, "^([^/?#]*)", 1)
    s = F.lower(F.substring_index(F.substring_index(s, "@", -1), ":", 1))
    s = F.regexp_replace(s, r"^www\.", "")
    return F.when(s.contains(".") & ~s.startswith(".") & ~s.endswith("."), s)


def geohash_prefixes(g: Column) -> Column:
    """Prefixes of 2 to 9 characters; none for what isn't ASCII letters and digits."""
    g = F.lower(F.trim(g))
    return F.when(g.rlike("^[0-9a-z]{2,}$"), F.transform(F.sequence(F.lit(2), F.least(F.lit(9), F.length(g))), lambda n: F.substring(g, F.lit(1), n))).otherwise(F.array().cast("array<string>"))


_JUNK = r"(?:[\s,;|\"'`<>()\[\]{}\\!*/+]|%20|%09|%0[aAdD])+$"
_IP = r"^(?:\d{1,3}(?:\.\d{1,3}){3}|\[.*)$"


def relay_url(raw: Column) -> Column:
    """A relay's address without junk, query or fragment; null for what can't be one."""
    s = F.lower(F.regexp_replace(F.trim(F.regexp_replace(raw, r"^\s+", "")), _JUNK, ""))
    scheme, rest = F.regexp_extract(s, "^(wss?)://", 1), F.regexp_extract(s, "^wss?://([^?#]*)", 1)
    rest = F.regexp_replace(rest, _JUNK, "")
    host = F.regexp_extract(rest, "^([^/:]*)", 1)
    bad = (scheme == "") | (host == "") | host.endswith(".onion") | host.endswith(".local") | (host == "localhost") | host.rlike(_IP)
    return F.when(~bad, F.concat(scheme, F.lit("://"), rest))


def client_name(raw: Column) -> Column:
    """Bucket of a client tag: without version and address; ``N/A`` without a name."""
    c = F.trim(raw)
    base = F.trim(F.substring_index(F.substring_index(c, " - ", 1), "@", 1))
    name = F.lower(F.when(c.startswith("31990:"), c).otherwise(base))
    cut = F.when(F.octet_length(name) <= MAX_CLIENT_BYTES, name).otherwise(F.left(name, F.size(F.filter(F.sequence(F.lit(1), F.lit(MAX_CLIENT_BYTES)), lambda n: F.octet_length(F.left(name, n)) <= MAX_CLIENT_BYTES))))
    return F.when(F.coalesce(cut, F.lit("")) == "", "N/A").otherwise(cut)


def day(ts: Column) -> Column:
    return ts - F.pmod(ts, F.lit(DAY))


def week(ts: Column) -> Column:
    """Weeks of the epoch, which start on Thursdays."""
    return ts - F.pmod(ts, F.lit(WEEK))


def month_shard(ts: Column, now: Column | None = None) -> Column:
    """Year * 100 + month in UTC; the month of ``now`` for times out of range."""
    at = lambda t: (F.year(F.timestamp_seconds(t)) * 100 + F.month(F.timestamp_seconds(t))).cast("int")
    return F.when(ts.between(0, 253_402_300_799), at(F.least(ts, F.lit(253_402_300_799)))).otherwise(at(now if now is not None else F.unix_timestamp()))


def generated_path(url: Column) -> Column:
    """Whether the path looks machine-made: two words or more, one of them radio alphabet."""
    path = F.regexp_extract(url, "^[^/]*/[^/]*/[^/]*/(.*)$", 1)
    words = F.filter(F.split(F.lower(path), "[-_/]"), lambda t: t != "")
    return F.coalesce((F.size(words) >= 2) & F.exists(words, lambda t: t.isin(*NATO)), F.lit(False))


def backoff_seconds(fails: Column) -> Column:
    """0 without failures, else a minute doubled up to six times, an hour at most."""
    return F.when(fails <= 0, F.lit(0)).otherwise(F.least(F.lit(3600), (F.lit(60) * F.pow(F.lit(2), F.least(fails, F.lit(6)))).cast("int"))).cast("int")
