"""Nulls in any column, empty and long texts, ties, repeated rows, empty tables
and extra columns of clashing names, for every operator."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftwave.llm import chosen_path, compact_windows, decontam, langid, packing, pii, tiff, toxicity, url_filter, warc_zst
from siftwave.llm.common import drop_ids, lowest, some

EXTRA = ["id", "row", "part", "bin", "size", "path", "sig", "a", "b", "key", "lang2", "score", "distance", "item_id", "chunk", "n", "w", "__x"]
LONG = " ".join(f"word{i % 977} der{i % 131}" for i in range(15000))


def docs(spark, empty=False):
    rows = [(1, "the cat and the dog in the house " * 5, "en"), (2, "the cat and the dog in the house " * 5, "en"), (2, "the cat and the dog in the house " * 5, "en"), (3, None, "en"), (4, "", None), (None, "der Hund und die Katze " * 12, "de"), (5, "   ", "de"), (6, LONG, "de"), (7, "!!! ???", None), (8, "you stupid idiot mail bob@example.com now", "en")]
    df = spark.createDataFrame([] if empty else rows, "doc_id bigint, text string, lang string")
    df = df.withColumns({"source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("bigint")})
    return df.withColumns({c: F.lit(None).cast("int") for c in EXTRA})


@pytest.mark.parametrize("empty", [False, True])
def test_documents(spark, empty):
    d = docs(spark, empty)
    bench = spark.createDataFrame([] if empty else [(1, "the cat and the dog in the house the cat and the dog"), (2, None), (3, ""), (None, "the cat and the dog in the house the cat and the dog")], "item_id bigint, text string")
    labels = spark.createDataFrame([] if empty else [(1, 1, 0), (8, 0, 1), (None, 1, 1), (2, None, None)], "doc_id bigint, quality int, toxic int")
    model = langid.fit(d)
    results = {
        "passages": compact_windows.passages(d), "join": chosen_path.join(d), "one": chosen_path.keep_one(d), "lang": langid.identify(d, model), "known": langid.keep_known(d, model), "pii": pii.report(d),
        "redact": pii.redact(d), "toxic": toxicity.flag(d, toxicity.fit(d, labels)), "match": decontam.matches(d, bench), "clean": decontam.drop_contaminated(d, bench), "pack": packing.pack(d),
    }
    got = {k: [r.asDict() for r in v.collect()] for k, v in results.items()}
    assert all(results[k].columns == d.columns for k in ("one", "known", "redact", "clean"))
    if empty:
        assert not any(got.values())
        return
    assert {(r["doc_a"], r["doc_b"]) for r in got["join"]} == {(1, 2)}
    assert sorted((r["doc_id"] or -1) for r in got["one"]) == [-1, 1, 3, 4, 5, 6, 7, 8]
    assert len(got["lang"]) == 10 and all(not r["accepted"] and r["lang"] is None for r in got["lang"] if r["doc_id"] in (3, 4, 5))
    assert [r["doc_id"] for r in got["pii"]] == [8] and "[EMAIL]" in got["pii"][0]["text"]
    assert {r["doc_id"]: r["text"] for r in got["redact"]}[3] is None and len(got["redact"]) == 10
    assert {r["doc_id"] for r in got["match"]} == {1, 2} and {r["doc_id"] for r in got["clean"]} == {3, 4, 5, 6, 7, 8, None}
    assert sum(r["size"] for r in got["pack"]) == sum(len((r["text"] or "").encode()) + 1 for r in got["redact"] if r["doc_id"] != 8) + len("you stupid idiot mail bob@example.com now") + 1
    assert all(r["doc_a"] < r["doc_b"] for r in got["passages"])


def test_contamination_with_null_ids(spark):
    text = "a benchmark question of some length that nobody else would ask"
    d = spark.createDataFrame([(None, f"so {text} he said"), (None, "nothing of the kind"), (1, text), (2, "nor here")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(None, text), (4, "another question of more than forty characters in all")], "item_id bigint, text string")
    assert sorted((r["doc_id"] or -1, r["item_id"]) for r in decontam.matches(d, bench).collect()) == [(-1, None), (1, None)]
    for shard in (8 << 20, 40):
        assert {tuple(r) for r in decontam.drop_contaminated(d, bench, shard_bytes=shard).collect()} == {(None, "nothing of the kind"), (2, "nor here")}


def test_full_chunks_of_repeated_ids(spark):
    d = spark.createDataFrame([(1, "a" * 20000)] * 3 + [(None, "b" * 9000)] * 2, "doc_id bigint, text string")
    rows = packing.pack(d).collect()
    held = {}
    for r in rows:
        held[r["bin_id"]] = held.get(r["bin_id"], 0) + r["size"]
    assert max(held.values()) <= 8192 and sum(held.values()) == 3 * 20001 + 2 * 9001


@pytest.mark.parametrize("empty", [False, True])
def test_pages(spark, empty):
    rows = [(1, "https://a.example/x", "<p>x"), (1, "https://a.example/x", "<p>x"), (None, "http://spam.example/" + "y" * 5000, None), (3, None, "z"), (4, "", "")]
    p = spark.createDataFrame([] if empty else rows, "page_id bigint, url string, html string").withColumns({c: F.lit(None).cast("int") for c in EXTRA})
    kept = url_filter.keep(p, url_filter.fit(p, *url_filter.seeded(p))).collect()
    assert [r["page_id"] for r in kept].count(1) == (0 if empty else 2) and all(r["url"] for r in kept)
    got = warc_zst.read(spark, warc_zst.write(p)).collect()
    assert len(got) == (0 if empty else 4) and all(r["error"] is None for r in got if r["target_uri"])
    t = spark.createDataFrame([] if empty else [(1, 2, "u", None), (1, 1, None, ""), (1, 1, None, ""), (None, 1, "u", "ü" * 100)], "conv_id bigint, turn bigint, role string, text string")
    files = tiff.rendered(t).withColumns({c: F.lit(None).cast("int") for c in EXTRA if c != "id"})
    assert sorted((r["id"] or -1, r["page"], r["error"]) for r in tiff.pages(files).collect()) == ([] if empty else [(-1, 0, None), (1, 0, None), (1, 1, None), (1, 2, None)])
    odd = spark.createDataFrame([] if empty else [(1, None), (2, bytearray()), (3, bytearray(b"II*\0"))], "id bigint, tiff binary")
    assert [(r["id"], r["page"]) for r in tiff.pages(odd).collect()] == ([] if empty else [(2, None), (3, None)])


def test_empty_pipeline(spark, tmp_path):
    docs(spark, True).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_short_items_match_as_whole_words(spark):
    d = spark.createDataFrame([(1, "so the Capital of Peru, he said"), (2, "the capital of perugia"), (3, "capital of peru"), (4, "xcapital of peru"), (5, None), (None, "what is the capital of  PERU?")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, "Capital of Peru"), (8, "?!"), (9, "capital of peru ")], "item_id bigint, text string")
    got = sorted((r["doc_id"] or -1, r["item_id"], r["distance"], r["start"], r["end"]) for r in decontam.matches(d, bench).collect())
    assert [g[:3] for g in got] == [(-1, 7, 0), (-1, 9, 0), (1, 7, 0), (1, 9, 0), (3, 7, 0), (3, 9, 0)]


def test_language_sample_is_bounded(spark):
    """Half of the table is one text: it counts once in the sample."""
    rows = [(i, "the cat and the dog in the house and the garden with them " + str(i % 3), "en") for i in range(3000)] + [(5000 + i, f"der Hund und die Katze Nummer {i} im Haus und im Garten", "de") for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    labelled = d.withColumn("h", F.xxhash64("text"))
    got = {r[0]: r[1] for r in lowest(labelled, "lang", "h", 50).groupBy("lang").count().collect()}
    assert got == {"en": 3, "de": 50}
    said = {r["doc_id"]: r["lang"] for r in langid.identify(d, langid.fit(d, sample_per_lang=50)).collect()}
    assert all(said[r[0]] == r[2] for r in rows)


def test_any_bytes_are_a_file():
    """Valid files with bytes changed, cut or added: errors, but no exception."""
    r = np.random.default_rng(1)
    x = np.arange(32 * 20 * 3, dtype="u1").reshape(32, 20, 3)
    files = [tiff.assemble([tiff.page_of(x, c, p, t)] * 2, "<", big) for c in (tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE) for p, t, big in ((1, 0, False), (2, 16, True))]
    seen = 0
    for k in range(6000):
        data = bytearray(files[k % len(files)])
        for _ in range(int(r.integers(1, 5))):
            data[int(r.integers(0, len(data)))] = int(r.integers(0, 256))
        data = bytes(data)[: int(r.integers(1, len(data) + 1))] if k % 5 == 0 else bytes(data)
        pages = list(tiff.walk(data, 1 << 20))
        seen += sum(p["error"] is not None for p in pages)
        pa.RecordBatch.from_pylist([p | {"id": 1} for p in pages], tiff._SHAPE)
    assert seen > 500


def test_long_secrets_are_masked_whole():
    model, limit = pii.train(3000)
    token = "eyJhbGciOiJIUzI1NiJ9." + "aB3_" * 60 + "." + "x9-Z" * 12
    texts = [f"bearer {token} then", f"token = {'9f8e7d6c' * 40} end", "a long path https://example.org/" + "part/" * 40 + "index.html is none"]
    got = pii.find(pa.array(texts), model, limit)
    assert [texts[0][a:b] for a, b, *_ in got[0]] == [token] and [texts[1][a:b] for a, b, *_ in got[1]] == ["9f8e7d6c" * 40] and 2 not in got


def test_repeated_rows_are_spread(spark):
    """Rows of one id, or none, are packed over all partitions, each row once."""
    d = spark.createDataFrame([(None, "x" * 99)] * 400 + [(1, "y" * 99)] * 400, "doc_id bigint, text string")
    got = packing.pack(d, capacity=1000, part_tokens=10_000).collect()
    assert len(got) == 800 and len({r["part"] for r in got}) > 4
    held = {}
    for r in got:
        held[r["bin_id"]] = held.get(r["bin_id"], 0) + r["size"]
    assert max(held.values()) <= 1000 and len(held) <= 80 + len({r["part"] for r in got})


def test_ties(spark):
    """Equal scores, sets and contexts go by the lowest id."""
    text = " ".join(f"word{i % 61} w{i % 7}" for i in range(120))
    d = spark.createDataFrame([(k, text) for k in (9, 4, 7, 4)], "doc_id bigint, text string")
    assert sorted(tuple(r) for r in chosen_path.classes(d).collect()) == [(4, 4, 3, 0), (7, 4, 3, 0), (9, 4, 3, 0)]
    assert sorted((r["doc_id"], r["class_id"]) for r in compact_windows.repeats(d).collect()) == [(4, 4), (7, 4), (9, 4)]
    assert {r["doc_a"] for r in compact_windows.passages(d).collect()} == {4}
    assert chosen_path.keep_one(d).count() == 2  # both rows of the lowest id


def test_more_than_is_broadcast(spark):
    """Ids beyond what is broadcast: by a bitmap, full or sparse, and a shuffle, with one result."""
    d = docs(spark).repartition(3)
    wanted = spark.createDataFrame([(1, "a"), (6, "b"), (77, "c")], "id bigint, other string")
    slim = d.select(F.col("doc_id").alias("id"), "text")
    for most, bits in ((10, 64), (0, 1 << 20), (0, 32768), (0, 8)):
        assert sorted((r["id"], r["other"]) for r in some(slim, wanted, most, bits=bits).collect()) == [(1, "a"), (6, "b")]
        left = drop_ids(d, "doc_id", wanted.select("id"), most, bits)
        assert left.columns == d.columns and sorted(r["doc_id"] or -1 for r in left.collect()) == [-1, 2, 2, 3, 4, 5, 7, 8]
    assert sorted(r["doc_id"] or -1 for r in chosen_path.keep_one(d, max_broadcast=0).collect()) == [-1, 1, 3, 4, 5, 6, 7, 8]


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls, repeats, extra columns of clashing names and a text of five megabytes, from end to end."""
    far = " ".join(f"the house and the {'abcdefghij'[i % 10]}{i} of the garden" for i in range(130_000))
    d = docs(spark).unionByName(spark.createDataFrame([(20, far, "en")], "doc_id bigint, text string, lang string"), allowMissingColumns=True)
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "der Hund und die Katze der Hund und die Katze"), (None, None)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept, ids = d, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == d.columns
        ids.append(sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in kept.select("doc_id").collect()))
    # no letters go; then the copies; then the row without an id that holds the item
    assert ids[0] == [-1, 1, 2, 2, 6, 8, 20] and ids[1] == [-1, 1, 6, 8, 20] and ids[2] == ids[3] == [1, 6, 8, 20]
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    size = {r["doc_id"]: 0 for r in rows}
    for r in rows:
        size[r["doc_id"]] += r["size"]
    assert sorted(size) == ids[3] and size[20] == len(far) + 1 > 5_000_000
    assert "[EMAIL]" in kept.where("doc_id = 8").first()["text"]
