"""Tables in the folder that all executors share, and where lineage is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.
    Where it names none, a new one of this machine, for local sessions only."""
    ctx = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", "")
    set_ = ctx._jsc.sc().getCheckpointDir()
    if not set_.isEmpty():
        return named or set_.get()
    if not named:
        if not ctx.master.startswith("local") or ctx.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="siftwave-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    ctx.setCheckpointDir(named)
    return named


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; deleted when Python ends."""
    where = f"{shared_dir(spark)}/siftwave-{spark.sparkContext.applicationId}"
    if where not in _made:
        _made.add(where)
        atexit.register(_delete, spark, where)
    return where


def _delete(spark: SparkSession, where: str) -> None:
    ctx = spark.sparkContext
    if ctx._jsc is None:  # the session has ended
        if where.startswith(("/", "file:")):
            shutil.rmtree(where.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
        return
    path = ctx._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(ctx._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def new_path(spark: SparkSession) -> str:
    return f"{own_dir(spark)}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table to the shared folder and read back: computed once, its
    lineage cut, and smaller than a checkpoint."""
    where = new_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def discard(df: DataFrame) -> None:
    """Deletes a table of ``stored`` that nothing to come reads."""
    for where in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        if "/siftwave-" in where:
            _delete(df.sparkSession, where)
