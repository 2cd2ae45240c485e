"""The search index: documents with their tokens, postings, and the documents' sizes,
computed once when events come in and only read by the searches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwave.model import BOOSTS

BUCKETS = 64


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def lengths() -> dict[str, Column]:
    """Tokens by field; those that were too long to keep don't count."""
    return {f: F.coalesce(F.size(F.filter(F.col(f), lambda t: t.isNotNull())), F.lit(0)) for f in BOOSTS}


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (event_id, shard_ym, a column of tokens for each field): a row for each term and
    field of a batch, with the documents that have it, how often, and the field's length."""
    for batch in batches:
        for k, field in enumerate(BOOSTS, 2):
            col = batch.column(k)
            row, tokens = pc.list_parent_indices(col), pc.list_flatten(col)
            kept = tokens.is_valid()
            row, tokens = np.asarray(row.filter(kept)).astype(np.int64), tokens.filter(kept).dictionary_encode()
            if not len(row):
                continue
            at, tf = np.unique(np.asarray(tokens.indices).astype(np.int64) * batch.num_rows + row, return_counts=True)
            term, row, length = at // batch.num_rows, at % batch.num_rows, np.bincount(row, minlength=batch.num_rows)
            first = np.flatnonzero(np.diff(term, prepend=-1))
            off, doc = pa.array(np.append(first, len(term)).astype(np.int32)), pa.array(row)
            each = (batch.column(0).take(doc), batch.column(1).take(doc), pa.array(tf.astype(np.int64)), pa.array(length[row].astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [tokens.dictionary.take(pa.array(term[first])), pa.array([field] * len(first), pa.string()), *[pa.ListArray.from_arrays(off, v) for v in each]], ["term", "field", *_EACH]
            )


_EACH = ("event_id", "shard_ym", "tf", "length")


def _listed(docs: DataFrame) -> DataFrame:
    """Postings by term, field and batch of documents, as lists: (bucket, term, field, event_id, shard_ym, tf, length)."""
    slim = docs.select("event_id", F.col("shard_ym").cast("int").alias("shard_ym"), *BOOSTS)
    lists = slim.mapInArrow(_lists, "term string, field string, event_id array<string>, shard_ym array<int>, tf array<bigint>, length array<int>")
    return lists.select(bucket(F.col("term")).alias("bucket"), *lists.columns)


def _flat(lists: DataFrame) -> DataFrame:
    return lists.select("bucket", "term", "field", F.inline(F.arrays_zip(*_EACH)))


def postings(docs: DataFrame) -> DataFrame:
    """(bucket, term, field, event_id, shard_ym, tf, length): a row for each token of
    a field, with the field's length, so that scoring needs no other table."""
    return _flat(_listed(docs))


def sizes(docs: DataFrame) -> DataFrame:
    """(shard_ym, n, len_<field>): what BM25 needs to know of all documents."""
    return docs.groupBy("shard_ym").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"len_{f}") for f, c in lengths().items()])


class Index:
    def __init__(self, docs: DataFrame, postings: DataFrame, sizes: DataFrame):
        self.docs, self.postings, self.sizes = docs, postings, sizes


def _ranged(docs: DataFrame, part: int) -> DataFrame:
    """``docs`` in parts of about ``part`` characters, by time.  The bounds come of narrow
    columns, as Spark's ranges would make every token to sample their keys; what is of one
    time is spread over as many parts as the time has bounds."""
    chars = docs.agg(F.sum(F.length("raw_content"))).first()[0] or 0
    n = -(-chars // part) or 1
    bounds = docs.agg(F.percentile_approx("created_at", [k / n for k in range(1, n)], 100 * n)).first()[0] or [] if n > 1 else []
    over = lambda test: F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), test)) if bounds else F.lit(0)
    to = over(lambda b: b < F.col("created_at")) + F.pmod(F.xxhash64("event_id"), 1 + over(lambda b: b == F.col("created_at"))).cast("int")
    return docs.repartitionById(n, to).sortWithinPartitions("shard_ym", "created_at")


def _grouped(lists: DataFrame, n: int) -> DataFrame:
    """Lists of postings in about ``n`` parts by bucket, then term; the long lists of a term
    may be in all parts of its bucket."""
    s = -(-n // BUCKETS)
    long = F.when(F.size("event_id") > 256, F.get("event_id", F.lit(0))).otherwise("")
    n, to = (n, F.floor(F.col("bucket") * n / BUCKETS)) if s == 1 else (s * BUCKETS, F.col("bucket") * s + F.pmod(F.xxhash64("term", long), F.lit(s)))
    return lists.repartitionById(n, to.cast("int")).sortWithinPartitions("bucket", "term")


def _delete(spark: SparkSession, where: str) -> None:
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(files, True)


def write(docs: DataFrame, path: str, mode: str = "append", per_file: int = 5_000_000, part: int = 1 << 25, tokens: int = 1_000_000) -> None:
    """Adds ``docs`` (of ``documents.build``).  Documents are partitioned by month and
    ranged by time, so that a large month is of many tasks and files; postings by
    bucket of the term and sorted by term, so that one term's are together.  Both are
    shuffled once, in parts of ``part`` characters or ``tokens`` tokens at any size, so
    that a part fits in memory; postings as lists."""
    spark = docs.sparkSession
    if mode == "overwrite":
        _delete(spark, path)
    batch = f"{path}/documents/batch=b{uuid.uuid4().hex}"
    _ranged(docs, part).write.partitionBy("shard_ym").option("maxRecordsPerFile", per_file).parquet(batch)
    # tokens are made once, and read from the documents
    own = spark.read.schema(docs.schema).parquet(batch)
    own_sizes = f"{path}/sizes/{batch.rsplit('/', 1)[1]}"
    sizes(own).coalesce(1).write.parquet(own_sizes)
    total = spark.read.parquet(own_sizes).agg(sum(F.coalesce(F.sum(f"len_{f}"), F.lit(0)) for f in BOOSTS)).first()[0]
    _grouped(_listed(own), -(-total // tokens) or 1).write.mode("append").partitionBy("bucket").option("maxRecordsPerFile", per_file).parquet(f"{path}/postings")


def read(spark: SparkSession, path: str) -> Index:
    total = [F.sum(c).alias(c) for c in ("n", *(f"len_{f}" for f in BOOSTS))]
    return Index(spark.read.parquet(f"{path}/documents").drop("batch"), _flat(spark.read.parquet(f"{path}/postings")), spark.read.parquet(f"{path}/sizes").groupBy("shard_ym").agg(*total))
