"""Archives of newline-delimited events: reading, quarantine, look-ups, writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwave.model import EVENT

_RAW = T.StructType([*EVENT.fields, T.StructField("_corrupt", T.StringType())])


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, quarantine) of the JSON lines under ``path``, plain, gzip, bzip2
    or Zstandard; a bad line costs that line only."""
    raw = spark.read.schema(_RAW).option("columnNameOfCorruptRecord", "_corrupt").option("mode", "PERMISSIVE").option("recursiveFileLookup", "true").json(path)
    return split(raw)


def split(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    good = F.col("_corrupt").isNull() & F.col("id").isNotNull() & F.col("pubkey").isNotNull() & F.col("sig").isNotNull() & (F.col("created_at") >= 0) & F.col("kind").between(0, 65_535)
    good = F.coalesce(good, F.lit(False))
    events = raw.where(good).drop("_corrupt").withColumns({"tags": F.coalesce("tags", F.array().cast("array<array<string>>")), "content": F.coalesce("content", F.lit(""))})
    return events, raw.where(~good)


def parse_lines(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """The same for a table of lines."""
    raw = lines.where(F.trim(column) != "").select(F.from_json(column, _RAW, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}).alias("e")).select("e.*")
    return split(raw)


def write(events: DataFrame, path: str, compression: str = "zstd", per_file: int = 5_000_000) -> None:
    """Adds to the table of events, by month of creation and ranged by time within it."""
    from siftwave.functions.normalize import month_shard

    e = events.withColumn("shard_ym", month_shard(F.col("created_at"))).dropDuplicates(["id"])
    ranged = e.repartitionByRange("shard_ym", "created_at", "id").sortWithinPartitions("shard_ym", "created_at", "id")
    ranged.write.mode("append").option("compression", compression).option("parquet.bloom.filter.enabled#id", "true").option("maxRecordsPerFile", per_file).partitionBy("shard_ym").parquet(path)


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def append_new(events: DataFrame, path: str) -> None:
    """Adds the events that the table lacks; the table itself tells which.  An id is of
    one time, so only the months that the batch has are looked at."""
    from siftwave.functions.normalize import month_shard

    spark = events.sparkSession
    where, fs = _fs(spark, path)
    months = [r[0] for r in events.select(month_shard(F.col("created_at"))).distinct().collect()]  # as many as there are months
    if not fs.exists(where) or not any(s.getPath().getName().startswith("shard_ym=") for s in fs.listStatus(where)):
        return write(events, path)
    seen = spark.read.parquet(path).where(F.col("shard_ym").isin(*months)).select("id")
    write(events.join(seen, "id", "left_anti"), path)


def compact(spark: SparkSession, path: str, month: int, per_file: int = 5_000_000) -> None:
    """One month rewritten in few files, each id once: written beside, then swapped."""
    own, beside = f"{path}/shard_ym={month}", f"{path}/.compact-{month}"
    rows = spark.read.parquet(own).dropDuplicates(["id"])
    rows.repartitionByRange("created_at", "id").sortWithinPartitions("created_at", "id").write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", per_file).parquet(beside)
    (old, fs), (new, _) = _fs(spark, own), _fs(spark, beside)
    fs.delete(old, True)
    fs.rename(new, old)


def wipe(spark: SparkSession, path: str, source: str) -> list[str]:
    """Deletes the months of a table, and nothing else that lies there, so that it can
    be written anew from ``source``, which must be there and hold something."""
    where, fs = _fs(spark, source)
    if not fs.exists(where) or not fs.listStatus(where):
        raise ValueError(f"nothing to write {path} anew from at {source!r}")
    where, fs = _fs(spark, path)
    gone = [s.getPath() for s in fs.listStatus(where) if s.getPath().getName().startswith("shard_ym=")] if fs.exists(where) else []
    for p in gone:
        fs.delete(p, True)
    return sorted(p.getName() for p in gone)


def safe_name(name: Column) -> Column:
    """Whether a file may be asked for by this name: an archive's, without a path."""
    return F.coalesce(name.rlike(r"^events_[A-Za-z0-9_.\-]+$") & ~F.contains(name, F.lit("..")), F.lit(False))


def human_size(size: Column) -> Column:
    """Bytes in GiB or MiB."""
    return F.when(size >= 1 << 30, F.format_string("%.2f GiB", size / (1 << 30))).otherwise(F.format_string("%.1f MiB", size / (1 << 20)))


def files(spark: SparkSession, path: str) -> DataFrame:
    """(name, size, modified) of the archive's files, newest first."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("modified")).orderBy(F.desc("modified"), "name")


def totals(events: DataFrame) -> DataFrame:
    return events.agg(F.countDistinct("id").alias("events"))


def locate(spark: SparkSession, path: str, event_id: str) -> DataFrame:
    """Files that hold an event."""
    e = spark.read.schema(_RAW).option("recursiveFileLookup", "true").json(path)
    return e.where(F.lower("id") == event_id.lower()).select(F.input_file_name().alias("file")).distinct()


def accepted(events: DataFrame, kinds: tuple[int, ...] | None = None) -> DataFrame:
    """What an intake takes: no ephemeral kinds, only ``kinds`` if any are named."""
    e = events.where(~F.col("kind").between(20_000, 29_999))
    return e.where(F.col("kind").isin(*kinds)) if kinds else e


def snapshot_tiers(world: DataFrame, path: str) -> None:
    world.where("wot_tier > 0").select("pubkey", F.col("wot_tier").cast("tinyint").alias("wot_tier")).write.mode("overwrite").parquet(path)


def load_tiers(spark: SparkSession, path: str) -> DataFrame | None:
    """The snapshot of ``snapshot_tiers``; None where there is none yet."""
    where, fs = _fs(spark, f"{path}/_SUCCESS")
    return spark.read.schema("pubkey string, wot_tier tinyint").parquet(path) if fs.exists(where) else None
