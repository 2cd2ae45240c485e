"""What reports keep between batches.

A report's folder is ``<root>/<name>/epoch=<n>``.  A batch adds its partial rows as
``part=<batch>`` and nothing else is rewritten; every ``compact_every`` parts are
merged to ``base=<batch>``, and what that replaces is deleted.  A batch that runs
again writes the same part, or nothing where a base has it, so that rows count once:
what is claimed is what is committed.  Folders of another epoch are of no use to
the code and are deleted when the report is opened.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from siftwave.model import LAG_S, SKEW_S
from siftwave.streaming.live import resets, stages


@dataclass(frozen=True)
class Report:
    """``partial`` turns events into rows by ``keys``; ``merge`` such rows into the report."""

    name: str
    keys: tuple[str, ...]
    partial: Callable[[DataFrame], DataFrame]
    merge: Callable[[DataFrame], DataFrame]
    depends: tuple[str, ...] = ()
    kinds: tuple[int, ...] | None = None
    epoch: int = 0


@dataclass(frozen=True)
class Progress:
    name: str
    epoch: int = 0
    batch: int = -1
    watermark: int = 0
    observed: int = 0
    consumed: int = 0
    filtered: int = 0
    backfilled: bool = False
    refreshed: int = 0
    unhealthy: str | None = None


@dataclass
class Files:
    """The few operations on folders that are needed, on any Hadoop file system."""

    spark: SparkSession
    _fs: object = field(default=None)

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _at(self, path: str):
        return self._path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self, path: str) -> list[str]:
        fs = self._at(path)
        return sorted(f.getPath().getName() for f in fs.listStatus(self._path(path))) if fs.exists(self._path(path)) else []

    def has(self, path: str) -> bool:
        return self._at(path).exists(self._path(path))

    def delete(self, path: str) -> None:
        self._at(path).delete(self._path(path), True)

    def read(self, path: str) -> str | None:
        if not self.has(path):
            return None
        stream = self._at(path).open(self._path(path))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, path: str, text: str) -> None:
        """Written beside and renamed, so that a reader finds the old or the new one."""
        fs, beside = self._at(path), self._path(f"{path}.new")
        out = fs.create(beside, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        fs.delete(self._path(path), False)
        fs.rename(beside, self._path(path))


class State:
    def __init__(self, spark: SparkSession, root: str, reports: Iterable[Report], compact_every: int = 16):
        self.spark, self.root, self.compact_every = spark, root, compact_every
        self.reports = {r.name: r for r in reports}
        self.depends = {r.name: tuple(r.depends) for r in self.reports.values()}
        self.files = Files(spark)
        for r in self.reports.values():
            for old in self.files.names(f"{root}/{r.name}"):
                if old.startswith("epoch=") and old != f"epoch={r.epoch}":
                    self.files.delete(f"{root}/{r.name}/{old}")

    def _home(self, name: str) -> str:
        return f"{self.root}/{name}/epoch={self.reports[name].epoch}"

    def _written(self, name: str) -> tuple[int, list[int]]:
        """The newest whole base (-2 for none) and the parts after it."""
        home = self._home(name)
        done = [n for n in self.files.names(home) if n[:5] in ("base=", "part=") and self.files.has(f"{home}/{n}/_SUCCESS")]
        base = max((int(n[5:]) for n in done if n[:5] == "base="), default=-2)
        return base, sorted(int(n[5:]) for n in done if n[:5] == "part=" and int(n[5:]) > base)

    def progress(self, name: str) -> Progress:
        text = self.files.read(f"{self._home(name)}/progress.json")
        try:
            return Progress(**json.loads(text)) if text else Progress(name, self.reports[name].epoch)
        except (TypeError, ValueError):  # not of this code: derived anew
            return Progress(name, self.reports[name].epoch)

    def _save(self, p: Progress) -> None:
        self.files.put(f"{self._home(p.name)}/progress.json", json.dumps(asdict(p)))

    def read(self, name: str) -> DataFrame | None:
        """The report as it stands; None before its first batch."""
        home, (base, parts) = self._home(name), self._written(name)
        paths = [f"{home}/base={base:d}"] * (base > -2) + [f"{home}/part={p:d}" for p in parts]
        return self.reports[name].merge(self.spark.read.parquet(*paths)) if paths else None

    def fold(self, name: str, events: DataFrame, batch: int, now: int | None = None) -> None:
        """A batch of events into one report.  Until a report is backfilled it takes
        events of any age; then what is over ``LAG_S`` behind the newest is left out."""
        report, p = self.reports[name], self.progress(name)
        base, parts = self._written(name)
        if batch <= base or batch in parts and batch <= p.batch:
            return
        now = int(time.time()) if now is None else now
        at = F.least(F.col("created_at"), F.lit(now + SKEW_S))
        late = F.col("created_at") < p.watermark - LAG_S if p.backfilled else F.lit(False)
        own = F.col("kind").isin(*report.kinds) if report.kinds else F.lit(True)
        seen = events.agg(F.count(F.lit(1)), F.count_if(own & ~late), F.count_if(late), F.max(at)).first()
        rows = report.partial(events.where(own & ~late))
        rows.write.mode("overwrite").parquet(f"{self._home(name)}/part={batch:d}")
        self._save(replace(p, batch=batch, watermark=max(p.watermark, seen[3] or 0), observed=p.observed + seen[0], consumed=p.consumed + seen[1], filtered=p.filtered + seen[2]))
        if len(parts) + 1 >= self.compact_every:
            self.compact(name)

    def compact(self, name: str) -> None:
        """All parts into one base; what it replaces goes."""
        home, (base, parts) = self._home(name), self._written(name)
        if not parts:
            return
        self.read(name).write.mode("overwrite").parquet(f"{home}/base={parts[-1]:d}")
        for old in [f"base={base:d}"] * (base > -2) + [f"part={p:d}" for p in parts]:
            self.files.delete(f"{home}/{old}")

    def delta(self, name: str, batch: int) -> DataFrame | None:
        """The report's rows of the keys that a batch touched; None where it isn't a part any more."""
        _, parts = self._written(name)
        if batch not in parts:
            return None
        dirty = self.spark.read.parquet(f"{self._home(name)}/part={batch:d}").select(*self.reports[name].keys).distinct()
        return self.read(name).join(dirty, list(self.reports[name].keys), "left_semi")

    def backfill(self, events: DataFrame, names: list[str] | None = None, now: int | None = None) -> list[list[str]]:
        """All of the past into every report that isn't backfilled, stage by stage."""
        left = [n for n in names or self.reports if not self.progress(n).backfilled]
        order = stages(left, self.depends) if left else []
        for stage in order:
            for name in stage:
                self.files.delete(self._home(name))
                self.fold(name, events, -1, now)
                self._save(replace(self.progress(name), backfilled=True))
        return order

    def each(self, events: DataFrame, batch: int) -> None:
        """For ``foreachBatch``: a micro-batch into all reports, in order."""
        for stage in stages(None, self.depends):
            for name in stage:
                self.fold(name, events, batch)

    def reset(self, name: str | None = None) -> set[str]:
        """Deletes what ``name`` and all that depend on it hold (all, without a name)."""
        gone = resets(name, self.depends) if name else set(self.reports)
        for n in gone:
            self.files.delete(f"{self.root}/{n}")
        return gone

    # ------------------------------------------------- derived whole, now and then

    def refresh(self, name: str, derive: Callable[[], DataFrame | None], every_s: int = 86_400, now: int | None = None, force: bool = False) -> bool:
        """Replaces a report that is derived as a whole, once in ``every_s``.  What can't
        be derived, or is empty, is written down as the reason, and the old one stays."""
        p, now = self.progress(name), int(time.time()) if now is None else now
        if not force and p.refreshed and now - p.refreshed < every_s:
            return False
        why, batch = None, p.batch + 1
        try:
            rows = derive()
            if rows is None:
                why = "no source"
            else:
                rows.write.mode("overwrite").parquet(f"{self._home(name)}/base={batch:d}")
                if self.spark.read.parquet(f"{self._home(name)}/base={batch:d}").isEmpty():
                    self.files.delete(f"{self._home(name)}/base={batch:d}")
                    why = "empty"
        except Exception as e:  # noqa: BLE001 - whatever it is, the reason is kept and the old report stays
            why = f"{type(e).__name__}: {str(e)[:200]}"
            self.files.delete(f"{self._home(name)}/base={batch:d}")
        if why:
            self._save(replace(p, unhealthy=why))
            return False
        self._save(replace(p, batch=batch, refreshed=now, unhealthy=None))
        for old in self.files.names(self._home(name)):
            if old.startswith("base=") and int(old[5:]) < batch - 1:  # readers of the last one may go on
                self.files.delete(f"{self._home(name)}/{old}")
        return True

    def health(self) -> DataFrame:
        """(name, epoch, batch, watermark, observed, ..., unhealthy) of every report."""
        return self.spark.createDataFrame([tuple(asdict(self.progress(n)).values()) for n in sorted(self.reports)], "name string, epoch int, batch bigint, watermark bigint, observed bigint, consumed bigint, filtered bigint, backfilled boolean, refreshed bigint, unhealthy string")


def stamped(events: DataFrame, tiers: Callable[[], DataFrame | None]) -> DataFrame:
    """A micro-batch with its authors' tiers as they are now: ``tiers`` (pubkey, wot_tier)
    is asked for again in every batch, so a new snapshot needs no restart."""
    now = tiers()
    if now is None:
        return events.withColumn("wot_tier", F.lit(0).cast("tinyint"))
    own = now.where("wot_tier > 0").select("pubkey", F.col("wot_tier").cast("tinyint").alias("__t"))
    return events.join(own, "pubkey", "left").withColumn("wot_tier", F.coalesce("__t", F.lit(0).cast("tinyint"))).drop("__t")


class Metrics(StreamingQueryListener):
    """Passes what streams say of themselves to ``sink`` as small dicts."""

    def __init__(self, sink: Callable[[dict], None]):
        self.sink = sink

    def onQueryStarted(self, event):
        self.sink({"event": "started", "id": str(event.id)})

    def onQueryProgress(self, event):
        p = event.progress
        self.sink({"event": "tick", "id": str(p.id), "batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond, "watermark": dict(p.eventTime).get("watermark")})

    def onQueryTerminated(self, event):
        self.sink({"event": "ended", "id": str(event.id), "error": event.exception})
