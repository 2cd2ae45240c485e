from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwave.model import EVENT
from siftwave.operators import documents, index, reports, scrape, search, trust
from siftwave.plans.filters import SearchFilter
from siftwave.sources import archive
from siftwave.streaming import live

A, B = "a" * 64, "b" * 64
T0 = 1_700_000_000


def event(i, kind=1, content="", tags=(), pubkey=B, at=T0):
    return (f"{i:064x}", pubkey, at, kind, [list(t) for t in tags], content, "c" * 128)


def built(spark, *events):
    return documents.build(spark.createDataFrame(list(events), EVENT))


def found(docs, text, **kw):
    return sorted(int(r["event_id"], 16) for r in search.search(docs, SearchFilter(search=text, **kw), now=F.lit(T0)).collect())


def test_searchability(spark):
    docs = built(
        spark, event(1, content="今日はビットコインの会議です"), event(2, content="meet me at the café tomorrow"), event(3, content="pic " + "A" * 4096),
        event(4, kind=30023, content="", tags=[("title", "Lightning channels"), ("summary", "about routing")]), event(5, kind=0, content='{"name":"Bob","about":"likes tea","nip05":"_@Bob.org","website":"https://www.bob.org/x","username":7}'),
        event(6, tags=[("g", "u4pruydqq")]), event(7, tags=[("g", "u4pruyxxx")]), event(8, kind=30078, content="secret words"), event(9, kind=5, tags=[("e", "AB" * 32)]),
        event(10, content="bitcoin conference"), event(11, content="bitcoin only"), event(12, tags=[("p", A.upper()), ("t", "Nostr"), ("r", "https://www.example.com/a")]),
    ).cache()
    assert found(docs, "ビットコイン") == [1] and found(docs, "ラーメン") == []
    assert found(docs, "cafe") == found(docs, "café") == [2]
    assert found(docs, "pic") == [3] and found(docs, "A" * 4096) == [n for n in range(1, 13)]  # nothing searchable is left
    assert found(docs, "lightning channels") == [4] and found(docs, "routing") == [4]
    assert found(docs, "bob") == [5] and found(docs, "tea") == [5] and found(docs, "nip05:BOB.org") == [5] and found(docs, "site:bob.org") == [5]
    assert found(docs, "geo:u4pruy") == [6, 7] and found(docs, "geo:u4pruydqq") == [6] and found(docs, "geo:9q8yy") == []
    assert found(docs, "secret") == []
    assert found(docs, "bitcoin conference") == [10] and found(docs, "bitcoin OR conference") == [10, 11] and found(docs, "bitcoin -conference") == [11]
    assert found(docs, "author:nonsense") == [] and found(docs, "", authors=("junk",)) == []
    assert found(docs, "#NOSTR") == [12] and found(docs, "site:https://example.com/z") == [12] and found(docs, "", tags={"p": (A.upper(),)}) == [12]
    assert found(docs, "kind:1 kind:5") == [] and found(docs, "", kinds=(5, 0)) == [5, 9]
    assert [r["kind"] for r in search.deletions(docs, "AB" * 32).collect()] == [5]


def test_recency_and_scores(spark):
    df = spark.createDataFrame([(T0,), (T0 - 365 * 86400,), (T0 - 86400 * 73,), (T0 + 200,), (T0 + 301,)], "t bigint")
    assert [r[0] for r in df.select(search.recency(F.col("t"), F.lit(T0))).collect()] == pytest.approx([1, 0, 0.8, 1, 0])


def test_follow_graph(spark):
    lists = spark.createDataFrame([(1, 10, 1, [3, 4]), (1, 20, 2, [3]), (2, 5, 3, [3, 3]), (1, 5, 4, [7])], "author bigint, created_at bigint, tie bigint, follows array<bigint>")
    counts = {r[0]: r[1] for r in trust.follower_counts(trust.edges(trust.latest_lists(lists))).collect()}
    assert counts == {3: 3}
    empty = spark.createDataFrame([], "src bigint, dst bigint")
    assert trust.pagerank(empty).count() == 0


def test_pagerank_paths_agree(spark):
    r = np.random.default_rng(1)
    graph = spark.createDataFrame([(int(a), int(b)) for a, b in r.integers(0, 40, (120, 2))], "src bigint, dst bigint")
    small = {x["node"]: x["rank"] for x in trust.pagerank(graph).collect()}
    large = {x["node"]: x["rank"] for x in trust.pagerank(graph, iterations=20, small_edges=1).collect()}
    assert small.keys() == large.keys() and all(abs(small[k] - large[k]) < 1e-9 for k in small) and abs(sum(small.values()) - 1) < 1e-9


def test_ranks_of_a_graph_without_onward_links_take_one_join(spark, monkeypatch):
    """Followed keys that follow nobody: rounds are scalars, and the ranks the same."""
    stores, kept = [], trust.stored
    monkeypatch.setattr(trust, "stored", lambda df: stores.append(df) or kept(df))
    graph = spark.createDataFrame([(k % 30, 100 + k * k % 17) for k in range(90)], "src bigint, dst bigint")
    small = {x["node"]: x["rank"] for x in trust.pagerank(graph).collect()}
    ranks = trust.pagerank(graph, small_edges=1)
    large = {x["node"]: x["rank"] for x in ranks.collect()}
    assert small.keys() == large.keys() and all(abs(small[k] - large[k]) < 1e-12 for k in small)
    assert len(stores) == 2 and ranks._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_zaps_and_kinds(spark):
    bolt = "lnbc2500u1"
    from siftwave.functions import bech32

    bolt = bech32.encode("lnbc2500u", [0] * 20)
    e = spark.createDataFrame([event(1, 9735, tags=[("P", A), ("p", "c" * 64), ("bolt11", bolt)]), event(2, 9735, tags=[("description", '{"pubkey":"%s","tags":[["amount","5999"],["p","%s"]]}' % (B, A))]), event(3, 9735, tags=[("P", A)]), ("short", B, T0, 1, [], "", "")], EVENT)
    world = spark.createDataFrame([(A, 20, 1), (B, 1, 0)], "pubkey string, followers int, wot_tier int")
    z = reports.activity_zaps(e, world).first()
    assert (z["receipts"], z["sent_trusted"], z["sent_untrusted"], z["received_trusted"], z["received_untrusted"]) == (2, 250_000, 5, 5, 250_000)
    assert {(r["kind"], r["trusted"], r["untrusted"]) for r in reports.kind_breakdown(e, world).collect()} == {(9735, 0, 3)}


def test_usage_cut(spark):
    r = spark.createDataFrame([("a", 900, None), ("b", 80, None), *[(f"c{i:03}", 1, None) for i in range(200)], ("junk", 5000, False)], "url string, sources int, nip11 boolean")
    kept = lambda p, k=1: [x["url"] for x in scrape.usage_cut(r, p, k).orderBy(F.desc("sources"), "url").collect()]
    assert kept(50) == ["a"] and kept(80) == ["a", "b"] and len(kept(100)) == 202 and len(kept(1, 50)) == 50
    assert [scrape.adaptive_percentile(n, 1_000_000) for n in (0, 500_000, 1_000_000, 9_000_000)] == [2, 41, 80, 80]


def test_corrupt_lines(spark):
    line = '{"id":"%064x","pubkey":"%s","created_at":1,"kind":1,"tags":[],"content":"x","sig":"s"}'
    lines = spark.createDataFrame([(line % (i, B),) for i in range(20)] + [('{"id":',), ("not json",), ("",)], "value string")
    good, bad = archive.parse_lines(lines)
    assert good.count() == 20 and bad.count() == 2


@given(st.recursive(st.none() | st.integers(), lambda x: st.dictionaries(st.sampled_from("abc"), x, max_size=3), max_leaves=8), st.dictionaries(st.sampled_from("abc"), st.none() | st.integers()))
def test_merge_patch(target, patch):
    out = live.merge_patch(target, patch)
    assert all((k not in out) if v is None else out[k] == v for k, v in patch.items())
    assert live.merge_patch(out, patch) == out


def test_stages_and_resets():
    assert live.stages(["pagerank", "follow_graph", "clients"]) == [["clients", "follow_graph"], ["pagerank"]]
    assert live.resets("follow_graph") >= {"pagerank", "activity"} and live.resets("clients") == {"clients"}
    with pytest.raises(ValueError):
        live.stages(["a", "b"], {"a": ("b",), "b": ("a",)})
    assert live.stages(["a", "b"], {"a": (), "b": ("a",)}) == [["a"], ["b"]]


def test_stream(spark, tmp_path):
    """A far future time, a late event and a repeat; then what's much too late."""
    import json

    def land(name, rows):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("".join(json.dumps({"id": f"{i:064x}", "pubkey": B, "created_at": t, "kind": 1, "tags": [], "content": "", "sig": "s"}) + "\n" for i, t in rows))

    got = []

    def run():
        q = live.each_batch(live.gate(live.tail(spark, str(tmp_path / "in"))), lambda df, n: got.extend(int(r["id"], 16) for r in df.collect()), str(tmp_path / "cp")).start()
        q.awaitTermination(120)

    land("1.json", [(1, T0), (2, T0 + 10), (2, T0 + 10), (3, 1_700_000_000_000)])
    run()
    land("2.json", [(4, T0 - 3600), (1, T0)])
    run()
    assert Counter(got) >= Counter([1, 2, 3]) and got.count(2) == 1 and got.count(1) == 1


def test_gold_merge(spark, tmp_path):
    path = str(tmp_path / "gold")
    fold = live.merge_into(path, lambda df: df.groupBy("kind").agg(F.sum("n").alias("n")))
    for i, rows in enumerate([[(1, 2)], [(1, 3), (2, 1)], [(1, 3), (2, 1)]]):
        fold(spark.createDataFrame(rows, "kind int, n bigint"), min(i, 1))  # the second batch runs twice
    assert {tuple(r) for r in live.latest(spark, path).collect()} == {(1, 5), (2, 1)}


def test_index_is_written_in_parts_that_grow_with_it(spark, tmp_path):
    """Parts by size at any number of shuffle partitions, the same postings; of one time, too."""
    texts = {f"{k:03d}": [None if (k + j) % 11 == 0 else f"w{(k * j) % 17}" for j in range(k % 23)] for k in range(300)}
    rows = [(i, 202401 + k % 2, 1000 * (k % 2) + (k if k < 100 else 7), t if k % 9 else None, ["head", "head"] if k % 5 == 0 else [], None, "x" * 20) for k, (i, t) in enumerate(texts.items())]
    docs = spark.createDataFrame(rows, "event_id string, shard_ym int, created_at bigint, content array<string>, title array<string>, summary array<string>, raw_content string")
    where = str(tmp_path / "index")
    for half in (docs.where("event_id < '150'"), docs.where("event_id >= '150'")):
        index.write(half, where, part=300, tokens=20)
    held = index.read(spark, where)
    assert held.docs.count() == 300
    assert {tuple(map(str, r)) for r in held.docs.select(*docs.columns).collect()} == {tuple(map(str, r)) for r in docs.collect()}
    want = Counter((t, f, r[0], r[1], sum(x is not None for x in r[n])) for r in rows for n, f in ((3, "content"), (4, "title")) for t in r[n] or [] if t is not None)
    got = {(r["term"], r["field"], r["event_id"], r["shard_ym"], r["length"]): r["tf"] for r in held.postings.collect()}
    assert got == dict(want) and held.postings.count() == len(want)
    assert held.postings.where(F.col("bucket") != index.bucket(F.col("term"))).count() == 0
    assert len(held.docs.inputFiles()) > 2 * 4  # more than shuffle partitions
    assert sum(r["n"] for r in held.sizes.collect()) == 300
