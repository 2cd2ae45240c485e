"""PII (7): candidate spans judged by gradient-boosted trees.

High-recall generators (byte regular expressions, run around digits, '@', '=', '_'
and ':' and on long unbroken strings; what they look at ends between words, however
long these are) propose overlapping spans.  Boosted trees score each from its format
(lengths, checksums, octets, entropy, separators) and its context (keywords,
neighbouring characters).  A threshold calibrated per kind on held-out spans
selects; of overlapping spans the best-scored stays, then the longer, then the
earlier, and its characters become ``[KIND]``.

The tables hold no labelled spans, so the trees are fitted on generated ones:
``train_spans`` positives and look-alikes (versions, dates, prices, commits,
numbers that fail their checksum, ...) in invented prose.

Defined results: null texts stay null and empty ones empty; spans count
characters of the text as it came; repeated rows are treated alike; other
columns, null ids included, pass through; an empty table stays empty.
"""

from __future__ import annotations

import math
import re
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwave.llm.common import per_batch, raw_bytes

_GENERATORS: list[tuple[str, bytes]] = [
    ("EMAIL", rb"[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+"),
    ("PHONE", rb"(?<![\w.])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|\d{2,4}[ .\-])(?:\d{2,4}[ .\-]?){1,3}\d{2,4}(?!\d)"),
    ("PHONE", rb"\+\d{8,15}(?!\d)"),
    ("IP", rb"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"),
    ("IP", rb"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){2,7}:?[0-9A-Fa-f]{1,4}(?![\w:])"),
    ("CARD", rb"(?<![\w.])\d{12,19}(?!\w)"),
    ("CARD", rb"(?<![\w.])\d{4}([ \-])\d{4,6}(?:\1\d{4,5}){1,3}(?!\w)"),
    ("SSN", rb"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])"),
    ("IBAN", rb"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}(?!\w)"),
    # the value up to white space, without the marks at its end, and up to its first mark
    *[("SECRET", rb"(?i:token|secret|passw(?:or)?d|pwd|api[_\- ]?key|access[_\- ]?key|auth)\s*[=:]\s*[\"']?" + value) for value in (rb"([^\s\"']{6,})", rb"([^\s\"']{5,}[^\s\"'#$%&*,;.!?])(?=[#$%&*,;.!?]*(?:[\s\"']|$))", rb"([^\s\"'#$%&*,;]{6,})")],
    ("SECRET", rb"(?<![0-9A-Za-z])[0-9a-f]{20,64}(?![0-9A-Za-z])"),
    ("SECRET", rb"(?<![\w.\-])eyJ[\w\-]{5,}\.[\w\-]{5,}(?:\.[\w\-]*)?"),
    ("SECRET", rb"(?<!\w)(?:AKIA[0-9A-Z]{12,}|gh[pousr]_\w{20,}|sk-[\w\-]{16,}|xox[abp]-[\w\-]{10,}|[A-Za-z0-9+/_\-]{32,}={0,2})(?!\w)"),
]
KINDS = list(dict.fromkeys(k for k, _ in _GENERATORS))
_RX = [(KINDS.index(k), re.compile(p)) for k, p in _GENERATORS]
#: without the values that may hold marks
_PLAIN = [x for x in _RX if not x[1].pattern.endswith((rb"([^\s\"']{6,})", rb"(?:[\s\"']|$))"))]
_SECRET = KINDS.index("SECRET")
#: bytes of context that a generator may need on either side of an anchor
_REACH = 96
_ANCHOR = np.zeros(256, bool)
_ANCHOR[48:58] = True
_ANCHOR[[ord("@"), ord("="), ord("_"), ord(":")]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: a word of so many bytes may be a secret without any anchor
_LONG = 32
_KEYWORD = re.compile(rb"(?:token|secret|passw(?:or)?d|pwd|api[_\- ]?key|access[_\- ]?key|auth)\s*[=:]\s*[\"']?$", re.I)
#: features that only values after a keyword are judged by, the last tells those
_SPELT = 7
_MARKS = b"#$%&*,;.!?"
_GLUED = re.compile(rb"[#$%&*,;.!?]*[^\s\"'#$%&*,;.!?]")
_GOOD = [re.compile(p, re.I) for p in (rb"(?:phone|tel|call|mobile|fax|whatsapp)\W*$", rb"(?:e-?mail|contact|write to)\W*$", rb"(?:\bip|host|server|address|addr)\W*$", rb"(?:card|visa|credit|account|iban|payment)\W*$", rb"(?:token|secret|key|passw\w*|pwd|auth|bearer)\W*$", rb"(?:ssn|social security)\W*$")]
_BAD = re.compile(rb"(?:version|release|build|\bv|page|pages|pp|order|item|isbn|issn|figure|fig|section|chapter|commit|sha\d*|md5|rev|revision|hash|\bno|serial|part|model|lot|tracking|coordinates|lat|doi)[\W_]*$", re.I)


def _luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _mod97(s: str) -> bool:
    s = s[4:] + s[:4]
    return int("".join(str(int(c, 36)) for c in s)) % 97 == 1


def features(body: bytes, a: int, b: int, kind: int) -> list[float]:
    span, before, after = body[a:b], body[max(0, a - 32) : a], body[b : b + 8]
    text = span.decode("latin-1")
    digits = re.sub(r"\D", "", text)
    letters = sum(c.isalpha() for c in text)
    counts = np.bincount(np.frombuffer(span, np.uint8))
    p = counts[counts > 0] / len(span)
    octets = text.split(".")
    groups = re.findall(r"\d+", text)
    packed = re.sub(r"[^0-9A-Za-z]", "", text).upper()
    bare = span.rstrip(_MARKS)
    tail = span[len(bare) :]
    return [
        *[float(kind == k) for k in range(len(KINDS))],
        len(text), len(digits), letters, len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        float(-(p * np.log2(p)).sum()), float(len(digits) >= 12 and _luhn(digits)), float(len(packed) >= 15 and packed[:2].isalpha() and packed.isascii() and _mod97(packed)),
        float(len(octets) == 4 and all(o.isdigit() and int(o) < 256 and (o == "0" or o[0] != "0") for o in octets)),
        float(text[:1] == "+"), float("(" in text), float("@" in text), float("." in text.rpartition("@")[2]), len(text.rpartition(".")[2]), text.count("-"), text.count(" "), text.count("."), text.count(":"),
        float(bool(re.fullmatch(r"[0-9a-f]+", text))), float(any(c.isupper() for c in text) and any(c.islower() for c in text) and bool(digits)),
        float(before[-1:] in (b'"', b"'") and after[:1] in (b'"', b"'")), float(before[-1:] in (b"$", b"#", b"/", b"-", b"_", b".", b"\xac")), float(after[:1] in (b"%", b"/", b"-", b"_", b"\xc2", b"\xe2")),
        float(before[-1:] in (b"=", b":") or before[-2:-1] in (b"=", b":")), *[float(bool(rx.search(before))) for rx in _GOOD], float(bool(_BAD.search(before))),
        float(digits[:1] in ("3", "4", "5", "6") if digits else 0), float(len(set(digits)) <= 3), len(digits) / len(text), float(bool(re.fullmatch(r"(?:19|20)\d\d\D.*", text))),
        len(tail), float(len(tail) > 1 and len(set(tail)) == 1), sum(c in _MARKS for c in bare), float(bool(_GLUED.match(after))), float(before[-1:] in (b"=", b'"', b"'")), float(letters == len(text)), float(kind == _SECRET and bool(_KEYWORD.search(before))),
    ]


def candidates(data: np.ndarray, off: np.ndarray, generators: list | None = None) -> list[tuple[int, int, int, int]]:
    """(row, start, end, kind) in bytes of the row; overlaps and all."""
    blank = _BLANK[data]
    # where words end: blanks, and the ends of rows
    gap = np.unique(np.concatenate([np.flatnonzero(blank), off - 1, off[-1:]]))
    long = gap[:-1][np.diff(gap) > _LONG] + 1
    at = np.union1d(np.flatnonzero(_ANCHOR[data]), long)
    if not len(at):
        return []
    row = np.searchsorted(off, at, side="right") - 1
    lo, hi = np.maximum(at - _REACH, off[row]), np.minimum(at + _REACH, off[row + 1])
    # no word is cut
    lo = np.maximum(gap[np.searchsorted(gap, lo, side="right") - 1] + 1, off[row])
    hi = np.minimum(gap[np.minimum(np.searchsorted(gap, hi), len(gap) - 1)], off[row + 1])
    new = np.concatenate([[True], (lo[1:] > hi[:-1]) | (row[1:] != row[:-1])])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at)) - 1
    body = data.tobytes()
    out = set()
    for r, a, b in zip(row[begin].tolist(), lo[begin].tolist(), hi[end].tolist()):
        piece, base = body[a:b], a - int(off[r])
        for kind, rx in generators or _RX:
            for m in rx.finditer(piece):
                s, e = m.span(1 if kind == _SECRET and rx.groups else 0)
                while e > s + 1 and piece[e - 1 : e] in (b".", b"-", b" "):
                    e -= 1
                out.add((r, base + s, base + e, kind))
    return sorted(out)


# ---------------------------------------------------------------- the trees


def _tree(x: np.ndarray, cut: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int):
    def leaf():
        return float(g[rows].sum() / (h[rows].sum() + 1.0))

    if depth == 0 or len(rows) < 16:
        return leaf()
    total_g, total_h = g[rows].sum(), h[rows].sum()
    best = (1e-6, None, None)
    for f in range(x.shape[1]):
        bins = x[rows, f]
        gs = np.cumsum(np.bincount(bins, g[rows], len(cut[f]) + 1))[:-1]
        hs = np.cumsum(np.bincount(bins, h[rows], len(cut[f]) + 1))[:-1]
        if not len(gs):
            continue
        gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), f, k)
    if best[1] is None:
        return leaf()
    _, f, k = best
    left = x[rows, f] <= k
    if left.all() or not left.any():
        return leaf()
    return (f, float(cut[f][k]), _tree(x, cut, g, h, rows[left], depth - 1), _tree(x, cut, g, h, rows[~left], depth - 1))


def _apply(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, c, lo, hi = tree
    left = x[:, f] <= c
    out = np.empty(len(x))
    out[left], out[~left] = _apply(lo, x[left]), _apply(hi, x[~left])
    return out


class Boosted:
    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3):
        cut = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cut, x.T)], axis=1)
        self.rate, self.trees = rate, []
        self.base = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        f = np.full(len(y), self.base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            t = _tree(binned, cut, y - p, p * (1 - p), np.arange(len(y)), depth)
            self.trees.append(t)
            f += rate * _apply(t, x)

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for t in self.trees:
            f += self.rate * _apply(t, x)
        return 1 / (1 + np.exp(-f))


class Judges:
    """Trees for values after a keyword, and trees for all else."""

    def __init__(self, other: Boosted, spelt: Boosted):
        self.other, self.spelt = other, spelt

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.where(x[:, -1] > 0, self.spelt.score(x), self.other.score(x[:, :-_SPELT]))


# ------------------------------------------------------- generated training spans


def _digits(r, n):
    return "".join(map(str, r.integers(0, 10, n)))


def _card(r, ok=True):
    body = str(r.choice(["4", "51", "55", "37", "6011", "2221"])) + _digits(r, 16)
    body = body[: int(r.choice([15, 15, 14]))]
    check = next(d for d in "0123456789" if _luhn(body + d))
    if not ok:
        check = str((int(check) + int(r.integers(1, 10))) % 10)
    n = body + check
    return r.choice([n, n, " ".join(n[i : i + 4] for i in range(0, len(n), 4)), "-".join(n[i : i + 4] for i in range(0, len(n), 4))])


def _word(r):
    return "".join(r.choice(list("abcdefghilmnoprstu"), int(r.integers(2, 9))))


def _hex(r, n):
    return "".join(r.choice(list("0123456789abcdef"), n))


def _code(r, n):
    return "".join(r.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"), n))


def _iban(r, ok=True):
    body = _digits(r, int(r.integers(14, 22)))
    cc = str(r.choice(["DE", "FR", "ES", "GB", "IT", "NL"]))
    check = 98 - int("".join(str(int(c, 36)) for c in body + cc + "00")) % 97
    return f"{cc}{(check if ok else (check + 7) % 97):02d}{body}"


def _octets(r):
    return ".".join(str(int(v)) for v in r.integers(1, 255, 4))


_OF = ["EMAIL", "PHONE", "IP", "CARD", "SSN", "IBAN", "SECRET", "SECRET", "IP", "SECRET", "SECRET"]
_KEYS = ["token", "secret", "api_key", "password", "Password", "passwd", "pwd", "access_key"]


def _positive(r) -> tuple[str, str, str, str]:
    k = int(r.integers(0, 9))
    return *_span(r, k), _OF[k]


def _span(r, k: int) -> tuple[str, str, str]:
    pre = str(r.choice(["", "", "", "", " call", " email:", " at", " ip", " card", " tel.", " by"]))
    if k in (0, 3, 5) and r.integers(0, 6) == 0:  # a chance word before a span of clear format says nothing
        pre = f" {r.choice(['hash', 'order', 'no', 'page', 'key', 'part', 'model', 'item'])}{r.choice([',', '', '.'])}"
    if k == 0:
        return pre, f"{_word(r)}{r.choice(['.', '', '_', '+'])}{r.choice([_word(r), str(r.integers(1, 99))])}@{_word(r)}{r.choice(['', str(r.integers(1, 9))])}.{r.choice(['com', 'org', 'net', 'de', 'example.com', 'co.uk'])}", ""
    if k == 1:
        a, b, c = _digits(r, 3), _digits(r, 3), _digits(r, 4)
        return pre, str(r.choice([f"+{r.integers(1, 99)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"+{r.integers(1, 99)} {a} {b} {c}", f"{a}-{b}-{c}", f"+{r.integers(1, 99)}-{a}-{b}-{c}", f"+49 {_digits(r, 3)} {_digits(r, 7)}", f"+33 6 {_digits(r, 2)} {_digits(r, 2)} {_digits(r, 2)} {_digits(r, 2)}", f"+{r.integers(1, 99)}{_digits(r, 10)}"])), ""
    if k == 2:
        return pre, _octets(r), ""
    if k == 3:
        return pre, str(_card(r)), ""
    if k == 4:
        return pre, f"{r.integers(100, 899)}-{r.integers(10, 99)}-{_digits(r, 4)}", ""
    if k == 5:
        return pre, _iban(r), ""
    if k == 6:
        q = str(r.choice(['"', "'", ""]))
        return f" {r.choice(['token', 'secret', 'api_key', 'password', 'API_KEY', 'access_key'])}{r.choice([' = ', '=', ': '])}{q}", str(r.choice([_hex(r, int(r.choice([16, 24, 32, 40, 64]))), _word(r) + _digits(r, 4) + "!", "sk-" + _hex(r, 32)])), q
    if k == 7:
        return str(r.choice(["", " key ", ' "'])), str(r.choice([_hex(r, 40), "AKIA" + _hex(r, 16).upper(), "ghp_" + _hex(r, 36), _hex(r, 32), ".".join("eyJ"[: 3 * (k < 2)] + _code(r, int(r.integers(12, 60))) for k in range(3))])), ""
    if k == 9:  # marks in the value
        mark = lambda: str(r.choice(list("#$%&*,;@!")))
        q = str(r.choice(['"', "'", "", "", ""]))
        value = "".join(v for _ in range(int(r.integers(2, 4))) for v in (str(r.choice([_word(r), _word(r).title(), _digits(r, 3)])), mark() * int(r.integers(1, 3))))
        if r.integers(0, 2) == 0:
            value = "".join(r.choice(list("abcdefghiklmnoprstw0134579@$!#&"), int(r.integers(6, 11))))
        return f" {r.choice(_KEYS)}{r.choice([' = ', '=', ': '])}{q}", value + _word(r) + str(r.choice(["", _digits(r, 1), _digits(r, 3)])), q
    if k == 10:  # letters only: long ones anywhere, short ones where nothing else is meant
        sep = str(r.choice(["=", ": ", " = "]))
        value = _word(r) + _word(r)
        while len(value) < (6 if sep == "=" else 15):
            value += _word(r)
        return f" {r.choice(_KEYS)}{sep}", value, ""
    return " host", ":".join(_hex(r, 4) for _ in range(8)), ""


def _negative(r) -> tuple[str, str, str]:
    k = int(r.integers(0, 16))
    y, m, d = r.integers(1950, 2030), r.integers(1, 13), r.integers(1, 29)
    return [
        (" version", ".".join(str(v) for v in r.integers(0, 30, 4)), ""),
        (" v", f"{r.integers(1, 20)}.{r.integers(0, 20)}.{r.integers(0, 999)}.{r.integers(0, 99)}", ""),
        ("", f"{y}-{m:02d}-{d:02d}", ""),
        ("", f"{d:02d}.{m:02d}.{y}", ""),
        ("", f"{y}-{m:02d}-{d:02d} {m:02d}:{d:02d}:{d:02d}", ""),
        (" $", f"{r.integers(1, 999)},{_digits(r, 3)}.{_digits(r, 2)}", ""),
        (str(r.choice([" order #", " ISBN ", " item no. ", " tracking ", " serial "])), _digits(r, int(r.integers(7, 17))), ""),
        ("", str(_card(r, ok=False)), ""),
        ("", ".".join(str(int(v)) for v in r.integers(256, 999, 4)), ""),
        (str(r.choice([" commit ", " sha1 ", " md5 ", " rev "])), _hex(r, int(r.choice([32, 40]))), ""),
        ("", f"{r.integers(1900, 2030)}-{r.integers(1900, 2030)}", ""),
        (" pp. ", f"{r.integers(100, 500)}-{r.integers(100, 500)}", ""),
        (" ISBN ", f"978-{r.integers(0, 9)}-{_digits(r, 4)}-{_digits(r, 4)}-{r.integers(0, 9)}", ""),
        ("", f"{r.integers(10, 90)}.{_digits(r, 6)} {r.integers(10, 90)}.{_digits(r, 6)}", ""),
        ("", _iban(r, ok=False), ""),
        ("", f"{_digits(r, 3)} {_digits(r, 3)} {_digits(r, 3)}", ""),
    ][k]


def _spelt(r, truth: bool) -> tuple[str, str, str]:
    """After a keyword: values of letters or with marks in them, or just prose."""
    if truth:
        return _span(r, int(r.integers(9, 11)))
    return f" {r.choice([*_KEYS, 'auth'])}{r.choice([': ', ': ', ' = '])}", (_word(r) + _word(r) + _word(r))[: int(r.integers(6, 13))], ""


@cache
def train(train_spans: int = 3000, seed: int = 11, precision: float = 0.95) -> tuple[Judges, np.ndarray]:
    """(trees, threshold by kind).  Half the generated spans fit the trees, the
    other half calibrates the thresholds: the lowest at which held-out spans of
    the kind reach ``precision``, and never under 0.5.  Values after a keyword are
    judged by trees of their own, which learn from half as many spans more."""
    r = np.random.default_rng(seed)
    plain, spelt = [], []
    for i in range(train_spans + train_spans // 2):
        truth = i % 2 == 0
        if i < train_spans:
            pre, span, post, expected = _positive(r) if truth else (*_negative(r), "")
        else:
            pre, span, post, expected = *_spelt(r, truth), "SECRET" if truth else ""
        close = str(r.choice(["", ".", ",", "###", "!!", "%%%", "&&&", "$$$", *(["***", ";"] if i >= train_spans else [])]))
        lead = " ".join(_word(r) for _ in range(int(r.integers(1, 6))))
        glue = "" if pre[-1:] in ('"', "'", "$", "#", " ", "=") or pre == " v" else " "
        body = f"{lead}{pre}{glue}".encode() + span.encode() + f"{post}{close} {_word(r)} {_word(r)}".encode()
        a = len(f"{lead}{pre}{glue}".encode())
        b = a + len(span.encode())
        for into, generators, more in ((plain, _PLAIN, 4), (spelt, _RX, 1)):
            for _, s, e, kind in candidates(np.frombuffer(body, np.uint8), np.array([0, len(body)]), generators):
                x = features(body, s, e, kind)
                if x[-1] if into is spelt else i < train_spans:
                    into.append((x, float(KINDS[kind] == expected and s <= a + 1 and e >= b - 1 and e - s <= b - a + more), kind))
    other, limit = _fitted(plain, slice(None, -_SPELT), precision)
    own, least = _fitted(spelt, slice(None), precision)
    return Judges(other, own), np.maximum(limit, np.where(np.arange(len(KINDS)) == _SECRET, least, 0))


def _fitted(rows: list, which: slice, precision: float) -> tuple[Boosted, np.ndarray]:
    x, y, kinds = (np.array(v) for v in zip(*rows))
    x, fit = x.astype(float)[:, which], np.arange(len(y)) % 2 == 0
    model = Boosted(x[fit], y[fit])
    p, truth, kind = model.score(x[~fit]), y[~fit], kinds[~fit]
    limit = np.full(len(KINDS), 0.5)
    for k in range(len(KINDS)):
        own = np.argsort(-p[kind == k], kind="stable")
        if len(own) < 20:
            continue
        right = np.cumsum(truth[kind == k][own]) / np.arange(1, len(own) + 1)
        good = np.flatnonzero(right >= precision)
        limit[k] = min(0.9, max(0.5, p[kind == k][own[good[-1]]])) if len(good) else 0.9
    return model, limit


def find(col: pa.Array, model: Judges, limit: np.ndarray) -> dict[int, list[tuple[int, int, int, float]]]:
    """Chosen spans by row: (start, end, kind, score) in bytes, in order."""
    data, off = raw_bytes(col, lower=False)
    cand = candidates(data, off)
    if not cand:
        return {}
    body = data.tobytes()
    score = np.round(model.score(np.array([features(body[off[r] : off[r + 1]], a, b, k) for r, a, b, k in cand], float)), 6)
    order = sorted(range(len(cand)), key=lambda i: (cand[i][0], -score[i], cand[i][1] - cand[i][2], cand[i][1]))
    taken: dict[int, list[tuple[int, int, int, float]]] = {}
    for i in order:
        r, a, b, k = cand[i]
        if score[i] >= limit[k] and all(b <= s or a >= e for s, e, *_ in taken.get(r, ())):
            taken.setdefault(r, []).append((a, b, k, float(score[i])))
    return {r: sorted(v) for r, v in taken.items()}


def _redacted(text: bytes, spans: list[tuple[int, int, int, float]]) -> str:
    out, at = [], 0
    for a, b, k, _ in spans:
        out += [text[at:a], f"[{KINDS[k]}]".encode()]
        at = b
    return b"".join([*out, text[at:]]).decode("utf-8", "replace")


def redact(docs: DataFrame, text_col: str = "text", train_spans: int = 3000) -> DataFrame:
    """``docs`` with the chosen spans of ``text_col`` masked; columns as they came."""
    model, limit = train(train_spans)
    names = docs.columns
    slim = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    at = names.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        col = batch.column(at)
        found = find(col, model, limit)
        if not found:
            return batch
        mask = np.zeros(len(col), bool)
        rows = sorted(found)
        mask[rows] = True
        new = pa.array([_redacted(col[r].as_py().encode(), found[r]) for r in rows], col.type)
        return batch.set_column(at, batch.schema.field(at), pc.replace_with_mask(col, pa.array(mask), new))

    return slim.mapInArrow(per_batch(run, text=at), slim.schema).toDF(*names)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_spans: int = 3000) -> DataFrame:
    """(doc_id, text, spans) of the documents with something to mask: the masked
    text, and each span's kind, characters and score."""
    model, limit = train(train_spans)
    kind = "struct<kind:string,start:int,end:int,score:double>"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        col = batch.column(1)
        found = find(col, model, limit)
        if not found:
            return None
        rows, texts, spans = sorted(found), [], []
        for r in rows:
            body = col[r].as_py().encode()
            texts.append(_redacted(body, found[r]))
            count = lambda b, body=body: len(body[:b].decode("utf-8", "replace"))
            spans.append([{"kind": KINDS[k], "start": count(a), "end": count(b), "score": p} for a, b, k, p in found[r]])
        shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(texts, pa.string()), pa.array(spans, shape)], ["doc_id", "text", "spans"])

    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(per_batch(run), f"doc_id bigint, text string, spans array<{kind}>")
