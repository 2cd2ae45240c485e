"""Script-aware tokens as plain expressions.

Runs of scripts written without blanks become overlapping pairs of characters
(a lone character stays), other alphanumeric runs are words.  Tokens of
``MAX_TOKEN_BYTES`` bytes or more leave a null, so that positions stay, and the
rest is lower-cased and stripped of accents.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwave.model import MAX_TOKEN_BYTES

_RANGES = [
    (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9D), (0x1100, 0x11FF),
    (0xA960, 0xA97F), (0xAC00, 0xD7FF), (0x0E00, 0x0E7F), (0x0E80, 0x0EFF), (0x1780, 0x17FF), (0x1000, 0x109F),
]
CONTINUOUS = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in _RANGES)
RUNS = f"([{CONTINUOUS}]+|[\\p{{IsAlphabetic}}\\p{{N}}&&[^{CONTINUOUS}]]+)"
WORDS = r"[\p{IsAlphabetic}\p{N}]+"
_LONG = {"ß": "ss", "æ": "ae", "œ": "oe", "ĳ": "ij", "þ": "th"}


def _fold_map() -> tuple[str, str]:
    src, dst = [], []
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        ch = chr(cp).lower()
        base = unicodedata.normalize("NFD", ch)
        plain = {"ø": "o", "đ": "d", "ł": "l", "ħ": "h", "ı": "i", "ŧ": "t", "ŋ": "n", "ð": "d"}.get(ch, base[0])
        if len(ch) == 1 and plain != ch and plain.isascii():
            src.append(ch)
            dst.append(plain)
    return "".join(src), "".join(dst)


_FROM, _TO = _fold_map()


def fold(s: Column) -> Column:
    out = F.translate(F.lower(s), _FROM, _TO)
    for a, b in _LONG.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(F.octet_length(s) == F.length(s), F.lower(s)).otherwise(out)  # nothing but case in ASCII


def raw_tokens(s: Column) -> Column:
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))
    cut = lambda r: F.when(r.rlike(f"^[{CONTINUOUS}]") & (F.length(r) > 1), pairs(r)).otherwise(F.array(r))
    mixed = F.flatten(F.transform(F.regexp_extract_all(s, F.lit(RUNS), F.lit(1)), cut))
    return F.when(s.rlike(f"[{CONTINUOUS}]"), mixed).otherwise(F.regexp_extract_all(s, F.lit(WORDS), F.lit(0)))


def tokens(s: Column) -> Column:
    """Folded tokens by position; null where one was too long to keep."""
    # one fold over all of them in a line: it's the costly part, and nothing to it where all is ASCII
    kept = F.transform(raw_tokens(s), lambda t: F.when(F.octet_length(t) < MAX_TOKEN_BYTES, t))
    split = lambda line: F.transform(F.split(fold(line), "\x02"), lambda t: F.nullif(t, F.lit("\x01")))
    # as a lambda's variable the line is made once, however often it's used
    out = F.transform(F.array(F.array_join(kept, "\x02", "\x01")), lambda line: F.when(line == "", F.array().cast("array<string>")).otherwise(split(line)))
    return F.when(s.isNotNull(), F.get(out, F.lit(0)))


def _line(have: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(have, " ", "\x01"), F.lit(" "))


def has_phrase(have: Column, phrase: list[str]) -> Column:
    """Whether ``phrase`` occurs in ``have`` as consecutive tokens."""
    if len(phrase) == 1:
        return F.coalesce(F.array_contains(have, phrase[0]), F.lit(False))
    return F.coalesce(F.contains(_line(have), F.lit(f" {' '.join(phrase)} ")), F.lit(False))


def phrase_count(have: Column, phrase: list[str]) -> Column:
    """How often ``phrase`` occurs in ``have``; occurrences may overlap."""
    if len(phrase) == 1:
        return F.coalesce(F.size(F.filter(have, lambda t: t == phrase[0])), F.lit(0))
    return F.coalesce(F.regexp_count(_line(have), F.lit(f"(?<= ){phrase[0]}(?= {' '.join(phrase[1:])} )")), F.lit(0))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns``, each computed once however often it's used after:
    the optimiser doesn't copy expressions through a generator."""
    gone = [c for c in columns if c in df.columns]
    return df.select(*[c for c in df.columns if c not in gone], F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


# --- the same on literals, in the driver


def _continuous(ch: str) -> bool:
    return any(a <= ord(ch) <= b for a, b in _RANGES)


def literal_tokens(s: str) -> list[str]:
    """What ``tokens`` gives for ``s``, without the nulls."""
    runs: list[tuple[bool, str]] = []
    last = None
    for ch in s:
        kind = True if _continuous(ch) else False if ch.isalnum() or unicodedata.category(ch)[0] == "N" else None
        if kind is not None and kind is last:
            runs[-1] = (kind, runs[-1][1] + ch)
        elif kind is not None:
            runs.append((kind, ch))
        last = kind
    out = []
    for continuous, r in runs:
        out += [r[i : i + 2] for i in range(len(r) - 1)] if continuous and len(r) > 1 else [r]
    return [literal_fold(t) for t in out if len(t.encode()) < MAX_TOKEN_BYTES]


def literal_fold(s: str) -> str:
    s = s.lower().translate(str.maketrans(_FROM, _TO))
    for a, b in _LONG.items():
        s = s.replace(a, b)
    return s
