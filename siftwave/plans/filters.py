"""Search filters: a structured filter and its small grammar, to predicates.

In the grammar each operator is a condition of its own, all of which must hold;
in the structured lists any entry of a field suffices.  What can't be decoded
as an author matches nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwave.functions import bech32
from siftwave.functions.text import has_phrase, literal_fold, literal_tokens, phrase_count

FIELDS = {"t": "tag_t", "e": "tag_e", "p": "tag_p", "a": "tag_a", "d": "tag_d", "g": "tag_g", "host": "tag_host", "nip05": "nip05", "l": "tag_l", "url": "tag_url"}
_HEX = re.compile(r"[0-9a-fA-F]*")


@dataclass(frozen=True)
class SearchFilter:
    search: str | None = None
    ids: tuple[str, ...] = ()
    authors: tuple[str, ...] = ()
    kinds: tuple[int, ...] = ()
    langs: tuple[str, ...] = ()
    since: int | None = None
    until: int | None = None
    tags: dict[str, tuple[str, ...]] = field(default_factory=dict)
    limit: int = 50


def csv(value: str | None) -> list[str]:
    return [x.strip() for x in (value or "").split(",") if x.strip()]


def csv_kinds(value: str | None) -> list[int]:
    return [int(x) for x in csv(value) if re.fullmatch(r"\d{1,5}", x) and int(x) < 65536]


def parse_time(s: str) -> int | None:
    if re.fullmatch(r"\d{1,18}", s):
        return int(s)
    try:
        return int(datetime.strptime(s, "%Y-%m-%d").replace(tzinfo=timezone.utc).timestamp())
    except ValueError:
        return None


def author(s: str) -> str | None:
    """64 hex digits of an npub, an nprofile or a key."""
    s = s.strip()
    if re.fullmatch("[0-9a-fA-F]{64}", s):
        return s.lower()
    got = bech32.decode_key(s) if s.startswith(("npub1", "nprofile1")) else None
    return got[1] if got else None


def host(s: str) -> str:
    """Host of a URL, or what was given, in lower case and without ``www.``."""
    x = re.split("[/?#]", s.split("://", 1)[1] if "://" in s else s.lstrip("/"))[0].rsplit("@", 1)[-1].split(":")[0].lower().removeprefix("www.")
    return x if "." in x and not x.startswith(".") and not x.endswith(".") else s.lower().removeprefix("www.")


def fold(name: str, value: str) -> str:
    """A queried value as the column ``name`` has it."""
    if name == "t":
        return value.lower()
    if name in "ep":
        got = bech32.decode_key(value) if value.startswith(("npub1", "nprofile1", "note1", "nevent1")) else None
        return got[1] if got else value.lower() if _HEX.fullmatch(value) else value
    if name == "a":
        part = value.split(":", 2)
        return ":".join([part[0], part[1].lower() if _HEX.fullmatch(part[1]) else part[1], *part[2:]]) if len(part) > 1 else value
    if name == "g":
        return value.strip().lower()
    if name == "host":
        return host(value)
    if name == "nip05":
        return value.strip().lower().removeprefix("_@")
    return value


@dataclass
class Parsed:
    conditions: list[Column]
    text: str
    since: int | None = None
    until: int | None = None


def _any(column: str, values: list[str]) -> Column:
    have = F.col(column)
    return F.coalesce(F.array_contains(have, values[0]) if len(values) == 1 else F.arrays_overlap(have, F.array(*[F.lit(v) for v in values])), F.lit(False))


def parse(search: str) -> Parsed:
    """Operators of ``search`` as conditions; what's left is free text."""
    out, rest, lang = Parsed([], ""), [], None
    for token in search.split():
        name, colon, value = token.partition(":")
        if token.startswith("#") and len(token) > 1:
            out.conditions.append(_any("tag_t", [token[1:].lower()]))
        elif not colon or not value:
            rest.append(token)
        elif name == "author":
            who = author(value)
            out.conditions.append(F.col("pubkey") == who if who else F.lit(False))
        elif name == "kind":
            if re.fullmatch(r"\d{1,5}", value) and int(value) < 65536:
                out.conditions.append(F.col("kind") == int(value))
        elif name in ("since", "until"):
            at = parse_time(value)
            if at is not None:
                setattr(out, name, at)
        elif name == "lang":
            lang = value.lower()
        elif name in ("geo", "site", "nip05", "tag"):
            f = {"geo": "g", "site": "host", "nip05": "nip05", "tag": "t"}[name]
            out.conditions.append(_any(FIELDS[f], [fold(f, value)]))
        else:
            rest.append(token)
    if lang:
        out.conditions.append(F.col("lang") == lang)
    out.text = " ".join(rest)
    return out


def predicate(f: SearchFilter) -> tuple[Column, str]:
    """(condition on the documents, free text left)."""
    p = parse(f.search or "")
    since, until = p.since if p.since is not None else f.since, p.until if p.until is not None else f.until
    all_ = list(p.conditions)
    if f.ids:
        all_.append(F.col("event_id").isin(*[fold("e", x) for x in f.ids]))
    if f.authors:
        known = [a for a in map(author, f.authors) if a]
        all_.append(F.col("pubkey").isin(*known) if known else F.lit(False))
    if f.kinds:
        all_.append(F.col("kind").isin(*f.kinds))
    if f.langs:
        all_.append(F.col("lang").isin(*[x.lower() for x in f.langs]))
    for name, values in f.tags.items():
        if values:
            all_.append(_any(FIELDS[name], [fold(name, v) for v in values]))
    all_ += time_range(since, until)
    out = F.lit(True)
    for c in all_:
        out = out & c
    return out, p.text


def time_range(since: int | None, until: int | None, now: int | None = None) -> list[Column]:
    """``since`` counts, ``until`` doesn't; the months follow, so that partitions
    are pruned; without ``until`` the present month is the last."""
    month = lambda t: int(datetime.fromtimestamp(min(max(t, 0), 253402300799), timezone.utc).strftime("%Y%m"))
    out = []
    if since is not None:
        out += [F.col("created_at") >= since, F.col("shard_ym") >= month(since)]
    if until is not None:
        out += [F.col("created_at") < until, F.col("shard_ym") <= month(max(until - 1, 0))]
    else:
        out.append(F.col("shard_ym") <= month(now if now is not None else int(datetime.now(timezone.utc).timestamp())))
    return out


# --- free text


@dataclass(frozen=True)
class Term:
    """Consecutive tokens, in one field or in any; the last a prefix if ``prefix``."""

    tokens: tuple[str, ...]
    field: str | None = None
    prefix: bool = False


@dataclass(frozen=True)
class Node:
    op: str  # and, or, not
    parts: tuple


_LEX = re.compile(r'\s*(?:(-?)(?:(title|summary|content):)?"([^"]*)"|([()])|(\S+?)(?=[\s()]|$))')


def parse_text(text: str):
    """Tree of a free text; None where it has no term.  Terms side by side must
    all occur; AND, OR, NOT, ``-``, parentheses, phrases, ``field:``, ``word*``."""
    items: list[tuple[str, object]] = []
    at = 0
    while at < len(text.rstrip()):
        m = _LEX.match(text, at)
        if not m:
            raise ValueError(f"can't read the search at {text[at:]!r}")
        at = m.end()
        if m[3] is not None:
            items += [("not", None)] * bool(m[1]) + [("term", Term(tuple(literal_tokens(m[3])), m[2]))]
        elif m[4]:
            items.append((m[4], None))
        elif m[5] in ("AND", "OR", "NOT"):
            items.append((m[5].lower(), None))
        else:
            word = m[5]
            if word.startswith("-") and len(word) > 1:
                items.append(("not", None))
                word = word[1:]
            name, colon, value = word.partition(":")
            f = name if colon and name in ("title", "summary", "content") else None
            word = value if f else word
            items.append(("term", Term(tuple(literal_tokens(word)), f, word.endswith("*"))))

    def either(i: int):
        parts, i = [], i
        node, i = both(i)
        parts.append(node)
        while i < len(items) and items[i][0] == "or":
            node, i = both(i + 1)
            parts.append(node)
        parts = [p for p in parts if p is not None]
        return (None if not parts else parts[0] if len(parts) == 1 else Node("or", tuple(parts))), i

    def both(i: int):
        parts = []
        while i < len(items) and items[i][0] not in (")", "or"):
            if items[i][0] == "and":
                i += 1
                continue
            node, i = one(i)
            if node is not None:
                parts.append(node)
        return (None if not parts else parts[0] if len(parts) == 1 else Node("and", tuple(parts))), i

    def one(i: int):
        kind, value = items[i]
        if kind == "not":
            if i + 1 >= len(items):
                raise ValueError("nothing to negate")
            node, i = one(i + 1)
            return (None if node is None else Node("not", (node,))), i
        if kind == "(":
            node, i = either(i + 1)
            if i >= len(items) or items[i][0] != ")":
                raise ValueError("parenthesis isn't closed")
            return node, i + 1
        if kind == ")":
            raise ValueError("parenthesis isn't open")
        return (value if value.tokens else None), i + 1

    node, i = either(0)
    if i < len(items):
        raise ValueError("parenthesis isn't open")
    return node


def matches(node) -> Column:
    """Predicate of a tree over the token columns."""
    if isinstance(node, Node):
        parts = [matches(p) for p in node.parts]
        if node.op == "not":
            return ~parts[0]
        out = parts[0]
        for p in parts[1:]:
            out = (out & p) if node.op == "and" else (out | p)
        return out
    fields = [node.field] if node.field else ["title", "summary", "content"]
    out = F.lit(False)
    for f in fields:
        if node.prefix and len(node.tokens) == 1:
            out = out | F.coalesce(F.exists(F.col(f), lambda t: t.startswith(node.tokens[0])), F.lit(False))
        else:
            out = out | has_phrase(F.col(f), list(node.tokens))
    return out


def leaves(node, negated: bool = False) -> list[Term]:
    """Terms that count for the score: those that aren't negated, each once."""
    if node is None:
        return []
    if isinstance(node, Term):
        return [] if negated else [node]
    out = [t for p in node.parts for t in leaves(p, negated or node.op == "not")]
    return list(dict.fromkeys(out))


def count(term: Term, column: str) -> Column:
    if term.prefix and len(term.tokens) == 1:
        return F.coalesce(F.size(F.filter(F.col(column), lambda t: t.startswith(term.tokens[0]))), F.lit(0))
    return phrase_count(F.col(column), list(term.tokens))


def with_limit(f: SearchFilter, limit: int | None, most: int = 500, default: int = 50) -> SearchFilter:
    return replace(f, limit=min(limit if limit is not None else default, most))


__all__ = ["SearchFilter", "Parsed", "Term", "Node", "author", "count", "csv", "csv_kinds", "fold", "host", "leaves", "literal_fold", "matches", "parse", "parse_text", "parse_time", "predicate", "time_range", "with_limit"]
