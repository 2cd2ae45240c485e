import pytest
from pyspark.sql import functions as F

from siftwave.functions import bech32
from siftwave.functions import normalize as N
from siftwave.functions.language import detect
from siftwave.functions.text import has_phrase, literal_tokens, phrase_count, tokens
from siftwave.plans.filters import author, csv_kinds, fold, leaves, parse_text, parse_time


def one(spark, column, value, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in value], f"x {kind}").select(column(F.col("x"))).collect()]


def test_relay_urls(spark):
    spelt = [f"wss://one.test.example{x}" for x in (",", "/", "/%20,", "/,", "|", "/%20", "/?q=2", "/,%20", "/ ")] + ["\twss://one.test.example "]
    assert set(one(spark, N.relay_url, spelt)) == {"wss://one.test.example"}
    paths = ["wss://two.test.example/in/box/", "wss://three.test.example/v9"]
    assert one(spark, N.relay_url, paths) == ["wss://two.test.example/in/box", "wss://three.test.example/v9"]
    junk = ["wss://", "wss:///", "wss://,", "wss:// ", "https://x.org", "ws://localhost", "ws://10.0.0.1:80/x", "wss://a.onion", "wss://b.local", None, ""]
    assert one(spark, N.relay_url, junk) == [None] * len(junk)


def test_hosts(spark):
    raw = ["https://www.Example.com:8080/a?b#c", "//user@Sub.example.org", "example.net/x", "localhost", ".x", "x.", None, ""]
    assert one(spark, N.url_host, raw) == ["example.com", "sub.example.org", "example.net", None, None, None, None, None]


def test_clients(spark):
    raw = ["Snort", "snort", " snort - 0.2 ", "Damus@1.1", "31990:AB:C", None, "", "ü" * 40]
    assert one(spark, N.client_name, raw) == ["snort", "snort", "snort", "damus", "31990:ab:c", "N/A", "N/A", "ü" * 32]


def test_folds(spark):
    assert one(spark, N.fold_hex, ["ABC", "xyZ", "", None]) == ["abc", "xyZ", "", None]
    assert one(spark, N.fold_coordinate, ["1:AB:C", "1:AB", "AB", "1:XY:C:D"]) == ["1:ab:C", "1:ab", "AB", "1:XY:C:D"]
    assert one(spark, N.fold_nip05, [" _@X.org ", "Bob@X.org"]) == ["x.org", "bob@x.org"]
    assert one(spark, N.geohash_prefixes, ["9Q8yz", "ß7", "x", ""]) == [["9q", "9q8", "9q8y", "9q8yz"], [], [], []]
    assert one(spark, N.generated_path, ["wss://h/tango-vertex", "wss://h/echo", "wss://h", None]) == [True, False, False, False]
    assert one(spark, N.week, [1_704_067_200], "bigint") == [1_703_721_600]
    assert one(spark, N.month_shard, [1_704_067_200], "bigint") == [202401]


def test_tokens(spark):
    for text, want in {"gm nostr, bitcoin!": "gm nostr bitcoin", "ビットコイン": "ビッ ット トコ コイ イン", "値段は円": "値段 段は は円", "a 円 b": "a 円 b", "meet at the Café": "meet at the cafe"}.items():
        assert one(spark, tokens, [text])[0] == want.split() == literal_tokens(text)
    got = one(spark, tokens, ["pic " + "A" * 4096 + " end"])[0]
    assert got == ["pic", None, "end"]
    df = spark.createDataFrame([(["a", "b", "a", "b"],), (["a", None, "b"],), ([],), (None,)], "t array<string>")
    assert [tuple(r) for r in df.select(has_phrase(F.col("t"), ["a", "b"]), phrase_count(F.col("t"), ["a", "b"])).collect()] == [(True, 2), (False, 0), (False, 0), (False, 0)]


def test_bech32():
    key = "3bf0c63fcb93463407af97a5e5ee64fa883d107ef9e558472c4eb9aaaefa459d"
    npub = bech32.encode_key("npub", key)
    assert bech32.decode_key(npub) == ("npub", key) and author(npub) == key and author(key.upper()) == key
    assert author("npub1bad") is None and author("zz") is None
    assert bech32.invoice_msats(bech32.encode("lnbc2500u", [0] * 20)) == 250_000_000
    assert bech32.invoice_msats(bech32.encode("lntb20m", [0] * 20)) == 2_000_000_000
    good = bech32.encode("lnbc20m", [0] * 20)
    assert bech32.invoice_msats(bech32.encode("lnbc", [0] * 20)) is None
    assert bech32.invoice_msats(good[:-1] + ("q" if good[-1] != "q" else "p")) is None
    assert bech32.invoice_msats(None) is None


def test_language():
    assert detect("the cat is in the house and it was not there") == "en"
    assert detect("der Hund ist in dem Haus und die Katze ist nicht da") == "de"
    assert detect("short") is None and detect(None) is None and detect("zxqv " * 20) is None


def test_grammar():
    assert parse_time("2024-01-01") == 1_704_067_200 and parse_time("12") == 12 and parse_time("x") is None
    assert csv_kinds("1, 7,x,70000") == [1, 7]
    assert fold("g", " U4 ") == "u4" and fold("a", "1:AB:C") == "1:ab:C" and fold("e", "AB") == "ab"
    tree = parse_text('"of the" (a OR -b) title:c')
    assert tree.op == "and" and [t.tokens for t in leaves(tree)] == [("of", "the"), ("a",), ("c",)]
    assert parse_text("  ") is None
    for bad in ("(a", "a)", "NOT"):
        with pytest.raises(ValueError):
            parse_text(bad)
