"""Live events: lateness, repeats and reports by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from siftwave.model import LAG_S, SKEW_S
from siftwave.sources.archive import _RAW, accepted, split

#: which report needs which
DEPENDS = {"follow_graph": (), "pagerank": ("follow_graph",), "activity": ("follow_graph",), "active_users": ("follow_graph",), "clients": (), "relays": (), "trending": (), "kinds": ("follow_graph",)}
KINDS = {"follow_graph": (3,), "pagerank": (3,), "relays": (10002,), "trending": (1, 1111, 9802, 30023), "activity": None, "active_users": None, "clients": None, "kinds": None}


def tail(spark: SparkSession, path: str, max_files: int = 100, kinds: tuple[int, ...] | None = None) -> DataFrame:
    """Events of a folder in which JSON lines land; ephemeral kinds are left out."""
    raw = spark.readStream.schema(_RAW).option("columnNameOfCorruptRecord", "_corrupt").option("maxFilesPerTrigger", max_files).json(path)
    return accepted(split(raw)[0], kinds)


def gate(events: DataFrame, lag_s: int = LAG_S, skew_s: int = SKEW_S) -> DataFrame:
    """Each id once, what's over ``lag_s`` behind the newest dropped.  A time
    that lies ahead is taken for a little after now, so that it can't move the
    watermark past the rest."""
    ahead = F.current_timestamp() + F.make_dt_interval(secs=F.lit(skew_s))
    at = F.least(F.timestamp_seconds(F.least(F.col("created_at"), F.lit(253_402_300_799))), ahead)
    return events.withColumn("wm_ts", at).withWatermark("wm_ts", f"{lag_s} seconds").dropDuplicatesWithinWatermark(["id"])


def counts(gated: DataFrame) -> DataFrame:
    """Events by day and kind, for update mode."""
    day = (F.col("created_at") - F.pmod(F.col("created_at"), F.lit(86_400))).alias("day")
    return gated.groupBy(F.window("wm_ts", "1 day"), day, "kind").agg(F.count(F.lit(1)).alias("events")).drop("window")


def each_batch(stream: DataFrame, fold: Callable[[DataFrame, int], None], checkpoint: str, seconds: int | None = None) -> DataStreamWriter:
    """``fold`` of every micro-batch; without ``seconds`` all that's there, then stop."""
    w = stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    return w.trigger(processingTime=f"{seconds} seconds") if seconds else w.trigger(availableNow=True)


def merge_into(path: str, merge: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A fold that keeps a gold table, one folder per batch: what the last one
    had and the new partial rows are merged; a batch that is run again finds the
    folder before its own and gives the same."""

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = latest(spark, path, batch_id)
        whole = batch if before is None else before.unionByName(batch)
        merge(whole).write.mode("overwrite").parquet(f"{path}/batch={batch_id:012d}")

    return fold


def latest(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The gold table as the newest batch (before ``before``) left it."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs.exists(root):
        return None
    names = sorted(f.getPath().getName() for f in fs.listStatus(root))
    names = [n for n in names if n.startswith("batch=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    names = [n for n in names if before is None or int(n[6:]) < before]
    return spark.read.parquet(f"{path}/{names[-1]}") if names else None


def stages(wanted: list[str] | None = None, depends: dict[str, tuple[str, ...]] | None = None) -> list[list[str]]:
    """Reports by stage, each after what it needs; a loop or an unknown name is an error."""
    depends = DEPENDS if depends is None else depends
    left, out, done = set(wanted or depends), [], set()
    while left:
        for name in left:
            unknown = [d for d in depends.get(name, ()) if d not in depends]
            if name not in depends or unknown:
                raise ValueError(f"unknown report {unknown[0] if unknown else name}")
        ready = sorted(n for n in left if all(d in done or d not in left for d in depends[n]))
        if not ready:
            raise ValueError(f"reports wait for each other: {sorted(left)}")
        out.append(ready)
        done |= set(ready)
        left -= set(ready)
    return out


def resets(name: str, depends: dict[str, tuple[str, ...]] | None = None) -> set[str]:
    """``name`` and all that depend on it."""
    depends = DEPENDS if depends is None else depends
    out = {name}
    while more := {k for k, d in depends.items() if k not in out and out & set(d)}:
        out |= more
    return out


def kinds_of(names: list[str]) -> tuple[int, ...] | None:
    """Kinds that a stage reads; None for all."""
    each = [KINDS[n] for n in names]
    return None if any(k is None for k in each) else tuple(sorted({x for k in each for x in k}))


def merge_patch(target, patch):
    """RFC 7386: objects merge, null deletes, anything else replaces."""
    if not isinstance(patch, dict):
        return patch
    out = dict(target) if isinstance(target, dict) else {}
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = merge_patch(out.get(k), v)
    return out


def ewma(rates: list[float], alpha: float = 0.2) -> float:
    out = 0.0
    for i, r in enumerate(rates):
        out = r if i == 0 else alpha * r + (1 - alpha) * out
    return out
