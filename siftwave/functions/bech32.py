"""Bech32 on literals and, for invoices, on columns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_ALPHABET = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
_GENERATOR = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)
_INVOICE = re.compile(r"^ln(?:bcrt|bc|tbs|tb)(?:(\d+)([munp]?))?$")
#: pico-bitcoin in a unit
_PICO = {"": 10**12, "m": 10**9, "u": 10**6, "n": 10**3, "p": 1}


def _polymod(values: list[int]) -> int:
    chk = 1
    for v in values:
        top = chk >> 25
        chk = (chk & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate(_GENERATOR):
            if top >> i & 1:
                chk ^= g
    return chk


def split(s: str) -> tuple[str, list[int]] | None:
    """(human-readable part, 5-bit words with the checksum); None if malformed."""
    if s.lower() != s and s.upper() != s:
        return None
    s = s.lower()
    at = s.rfind("1")
    if at < 1 or at + 7 > len(s) or any(c not in _ALPHABET for c in s[at + 1 :]):
        return None
    return s[:at], [_ALPHABET.index(c) for c in s[at + 1 :]]


def checked(hrp: str, words: list[int]) -> bool:
    return _polymod([ord(c) >> 5 for c in hrp] + [0] + [ord(c) & 31 for c in hrp] + words) == 1


def encode(hrp: str, words: list[int]) -> str:
    mod = _polymod([ord(c) >> 5 for c in hrp] + [0] + [ord(c) & 31 for c in hrp] + words + [0] * 6) ^ 1
    return hrp + "1" + "".join(_ALPHABET[w] for w in words + [mod >> 5 * (5 - i) & 31 for i in range(6)])


def _bytes(words: list[int]) -> bytes:
    acc = bits = 0
    out = bytearray()
    for w in words:
        acc, bits = acc << 5 | w, bits + 5
        if bits >= 8:
            bits -= 8
            out.append(acc >> bits & 255)
            acc &= (1 << bits) - 1
    return bytes(out)


def decode_key(s: str) -> tuple[str, str] | None:
    """(prefix, 64 hex digits) of an npub, note, nprofile or nevent; the checksum isn't held against it."""
    got = split(s.strip())
    if got is None:
        return None
    hrp, words = got
    body = _bytes(words[:-6])
    if hrp in ("npub", "note"):
        return (hrp, body.hex()) if len(body) == 32 else None
    if hrp in ("nprofile", "nevent"):
        at = 0
        while at + 2 <= len(body):
            kind, size = body[at], body[at + 1]
            if kind == 0 and size == 32 and at + 34 <= len(body):
                return hrp, body[at + 2 : at + 34].hex()
            at += 2 + size
    return None


def encode_key(hrp: str, key: str) -> str:
    acc = int(key, 16) << 4
    return encode(hrp, [acc >> 5 * (51 - i) & 31 for i in range(52)])


def invoice_msats(s: str | None) -> int | None:
    """Amount of a BOLT-11 invoice; None without one, or if the checksum is wrong."""
    got = split(s.strip()) if s else None
    if got is None or not checked(*got):
        return None
    m = _INVOICE.match(got[0])
    if not m or m[1] is None:
        return None
    return int(m[1]) * _PICO[m[2]] // 10


def invoice_msats_col(invoice: Column) -> Column:
    """``invoice_msats`` over a column: checksums need bytes, so Arrow batches."""

    @F.pandas_udf("bigint")
    def run(s: pd.Series) -> pd.Series:
        return s.map(invoice_msats, na_action="ignore").astype("Int64")

    return run(invoice)
