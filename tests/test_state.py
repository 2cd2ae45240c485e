"""Reports that are kept between batches, and the maintenance of archives."""

import pytest
from pyspark.sql import functions as F

from siftwave.functions.normalize import day
from siftwave.model import LAG_S
from siftwave.operators.documents import profile_fields
from siftwave.sources import archive
from siftwave.streaming.state import Report, State, stamped

NOW = 1_700_000_000


def events(spark, rows):
    return spark.createDataFrame([(f"{i:064x}", "a" * 64, t, k) for i, t, k in rows], "id string, pubkey string, created_at bigint, kind int")


def counts(epoch=0, name="daily", depends=()):
    partial = lambda e: e.groupBy(day(F.col("created_at")).alias("day"), "kind").agg(F.count(F.lit(1)).alias("n"))
    return Report(name, ("day", "kind"), partial, lambda r: r.groupBy("day", "kind").agg(F.sum("n").alias("n")), depends, epoch=epoch)


def total(df):
    return {tuple(r)[:2]: r["n"] for r in df.collect()}


def test_batches_count_once(spark, tmp_path):
    state = State(spark, str(tmp_path), [counts()], compact_every=3)
    assert state.read("daily") is None and state.delta("daily", 0) is None
    for batch in range(5):
        state.fold("daily", events(spark, [(batch * 10 + i, NOW + batch, i % 2) for i in range(4)]), batch, NOW)
        state.fold("daily", events(spark, [(batch * 10 + i, NOW + batch, i % 2) for i in range(4)]), batch, NOW)  # the same batch again
    assert sum(total(state.read("daily")).values()) == 20
    assert len(total(state.delta("daily", 4))) == 2 and state.delta("daily", 0) is None  # that one is compacted
    assert len([n for n in state.files.names(f"{tmp_path}/daily/epoch=0") if n.startswith(("base", "part"))]) == 3
    p = state.progress("daily")
    assert (p.observed, p.consumed, p.filtered, p.watermark) == (20, 20, 0, NOW + 4)


def test_delta_holds_dirty_keys_only(spark, tmp_path):
    state = State(spark, str(tmp_path), [counts()])
    state.fold("daily", events(spark, [(1, NOW, 1), (2, NOW, 2)]), 0, NOW)
    state.fold("daily", events(spark, [(3, NOW, 2)]), 1, NOW)
    assert {k[1]: n for k, n in total(state.delta("daily", 1)).items()} == {2: 2}
    state.fold("daily", events(spark, []), 2, NOW)
    assert state.delta("daily", 2).isEmpty()


def test_backfill_then_gate(spark, tmp_path):
    state = State(spark, str(tmp_path), [counts(), counts(name="later", depends=("daily",))])
    old = [(i, NOW - 400 * 86_400 * (i % 2), 1) for i in range(10)]
    assert state.backfill(events(spark, old), now=NOW) == [["daily"], ["later"]]
    assert state.backfill(events(spark, old), now=NOW) == []
    state.fold("daily", events(spark, [(20, NOW - LAG_S - 1, 1), (21, NOW + 10**9, 1), (22, NOW - 5, 1)]), 0, NOW)
    p = state.progress("daily")
    assert (p.filtered, p.consumed, p.watermark) == (1, 12, NOW + 300) and sum(total(state.read("daily")).values()) == 12
    assert sum(total(state.read("later")).values()) == 10


def test_epoch_and_reset(spark, tmp_path):
    reports = lambda epoch: [counts(epoch), counts(name="b", depends=("daily",)), counts(name="c")]
    state = State(spark, str(tmp_path), reports(0))
    for name in ("daily", "b", "c"):
        state.fold(name, events(spark, [(1, NOW, 1)]), 0, NOW)
    state = State(spark, str(tmp_path), reports(1))
    assert state.read("daily") is None and total(state.read("b")) and total(state.read("c"))
    state.fold("daily", events(spark, [(1, NOW, 1)]), 0, NOW)
    assert state.reset("daily") == {"daily", "b"}
    assert state.read("daily") is None and state.read("b") is None and total(state.read("c"))
    state.reset()
    assert state.read("c") is None
    assert {r["name"]: r["batch"] for r in state.health().collect()} == {"daily": -1, "b": -1, "c": -1}


def test_refresh_keeps_what_it_has(spark, tmp_path):
    state = State(spark, str(tmp_path), [Report("ranks", ("pubkey",), lambda e: e, lambda r: r)])
    ranks = lambda tier: spark.createDataFrame([("a" * 64, tier)], "pubkey string, wot_tier tinyint")
    assert state.refresh("ranks", lambda: ranks(1), now=NOW) and not state.refresh("ranks", lambda: ranks(2), now=NOW + 10)
    e = events(spark, [(1, NOW, 1)])
    tier = lambda: stamped(e, lambda: state.read("ranks")).first()["wot_tier"]
    assert tier() == 1

    def broken():
        raise RuntimeError("no graph")

    for derive, why in ((lambda: None, "no source"), (lambda: ranks(3).limit(0), "empty"), (broken, "RuntimeError: no graph")):
        assert not state.refresh("ranks", derive, now=NOW + 20, force=True)
        assert state.progress("ranks").unhealthy == why and tier() == 1
    assert state.refresh("ranks", lambda: ranks(4), now=NOW + 90_000) and tier() == 4 and state.progress("ranks").unhealthy is None
    assert stamped(e, lambda: None).first()["wot_tier"] == 0


def test_archive_maintenance(spark, tmp_path):
    path, source = str(tmp_path / "table"), tmp_path / "in"
    rows = lambda ids: spark.createDataFrame([(f"{i:064x}", "b" * 64, NOW + i * 86_400, 1, [], "x", "c" * 128) for i in ids], archive.EVENT)
    archive.append_new(rows(range(40)), path)
    archive.append_new(rows(range(20, 60)), path)
    read = lambda: spark.read.parquet(path)
    assert read().count() == 60 and read().select("id").distinct().count() == 60
    archive.compact(spark, path, 202312)
    assert read().count() == 60
    with pytest.raises(ValueError):
        archive.wipe(spark, path, str(source))
    source.mkdir()
    with pytest.raises(ValueError):
        archive.wipe(spark, path, str(source))
    (source / "x").write_text("{}")
    (tmp_path / "table" / "notes.txt").write_text("stays")
    assert archive.wipe(spark, path, str(source)) == [f"shard_ym={m}" for m in (202311, 202312, 202401)] and (tmp_path / "table" / "notes.txt").exists()
    assert archive.load_tiers(spark, str(tmp_path / "tiers")) is None
    archive.snapshot_tiers(spark.createDataFrame([("a", 2), ("b", 0)], "pubkey string, wot_tier int"), str(tmp_path / "tiers"))
    assert [tuple(r) for r in archive.load_tiers(spark, str(tmp_path / "tiers")).collect()] == [("a", 2)]
    names = spark.createDataFrame([("events_2024.jsonl",), ("events_../x",), ("events_a/b",), ("other",), (None,)], "n string")
    assert [r[0] for r in names.select(archive.safe_name(F.col("n"))).collect()] == [True, False, False, False, False]
    assert [r[0] for r in spark.createDataFrame([(5 << 30,), (3 << 19,)], "n bigint").select(archive.human_size(F.col("n"))).collect()] == ["5.00 GiB", "1.5 MiB"]


def test_profile_fields(spark):
    rows = [("a", 1, '{"name": " Ann ", "displayName": "A.", "about": "", "nip05": 7}'), ("b", 2, "no json"), ("c", 3, None), ("d", 4, '{"display_name": "D", "displayName": "x", "website": "w"}')]
    got = {r["pubkey"]: r.asDict() for r in profile_fields(spark.createDataFrame(rows, "pubkey string, created_at bigint, content string")).collect()}
    assert (got["a"]["name"], got["a"]["display_name"], got["a"]["about"], got["a"]["nip05"]) == ("Ann", "A.", None, None)
    assert got["d"]["display_name"] == "D" and got["d"]["website"] == "w" and not any(got[k]["name"] for k in "bcd")
