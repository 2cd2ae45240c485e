"""URL filters (1): character language-model ratio.

Two variable-order Markov models over the bytes of a URL, one of accepted and
one of rejected URLs: the chance of a byte after the longest context kept, by
Witten-Bell smoothing over all shorter ones down to the uniform chance.  A
URL's score is (log p_accepted - log p_rejected) / bytes; it stays if the score
reaches the limit.  The limit is calibrated on the tenth of the labelled URLs
that the models never saw: of all limits that lose at most ``max_loss`` of the
accepted ones, the one that turns away most rejected ones for the least loss.

Counts cover every labelled URL.  A gram of up to 6 bytes of context and its
byte is one exact 64-bit key, and none is left out.  Up to ``max_grams`` keys
(counted first) go to the executors as one model; more stay a table, which the
grams of the URLs are joined with part by part, with the same scores.

Defined results: case is folded and the scheme left out; a null or empty URL
has a null score and is dropped; repeated rows are scored alike and kept as
often as they occur; null ids pass through; a URL that is both accepted and
rejected counts for both; without accepted or without rejected URLs every URL
that isn't empty is kept; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from siftwave.llm.common import materialise, per_batch, raw_bytes

_U = np.uint64
#: parts of a host or path that mark a URL as unwanted, for want of labels
SEED_TERMS = "spam spam-farm casino poker viagra cheap-pills pills porn xxx escort payday loan-offer torrent warez crack replica clickbait link-farm"
_START, _END = 2, 3
_BINS = 4000
_REACH = 8.0


def normalise(col: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.utf8_lower(col.cast(pa.large_string())), r"^[a-z][a-z0-9+.\-]*://", "")


def grams(col: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """((order + 1) x places) keys of each byte with 0 to ``order`` bytes before
    it, and the row of each place.  A URL ends with an end mark and starts after
    start marks; key: order in the top byte, then the bytes, the last one lowest."""
    data, off = raw_bytes(col)
    size = np.diff(off)
    used = np.flatnonzero(size > 0)
    width = size[used] + order + 1
    at = np.concatenate([[0], np.cumsum(width)])
    x = np.full(at[-1], _START, _U)
    row = np.repeat(used, size[used])
    place = np.arange(off[-1]) - off[row] + at[np.searchsorted(used, row)] + order
    x[place] = data
    x[at[1:] - 1] = _END
    own = np.repeat(np.arange(len(used)), width)
    spot = np.flatnonzero(np.arange(len(x)) - at[own] >= order)
    out = np.empty((order + 1, len(spot)), _U)
    key = np.zeros(len(spot), _U)
    for k in range(order + 1):
        key = key | x[spot - k] << _U(8 * k)
        out[k] = key | _U(k + 1) << _U(56)
    return out, used[own[spot]]


def _context(key: np.ndarray) -> np.ndarray:
    return (key >> _U(56) << _U(56)) | (key & _U((1 << 56) - 1)) >> _U(8)


class Model:
    """Counts of grams, and of the contexts that they make up, for both models."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int, limit: float = -np.inf):
        by = np.argsort(keys)
        self.keys, self.counts, self.order, self.limit = keys[by], counts[by].astype(float), order, limit
        self.contexts, inverse = np.unique(_context(self.keys), return_inverse=True)
        self.total = np.stack([np.bincount(inverse, c, len(self.contexts)) for c in self.counts.T], axis=1)
        self.kinds = np.stack([np.bincount(inverse, c > 0, len(self.contexts)) for c in self.counts.T], axis=1)
        self.able = bool(len(self.keys)) and bool((self.counts.sum(axis=0) > 0).all())

    @classmethod
    def part(cls, got: pa.Table, order: int) -> Model:
        """Of what some grams found in the table, null where they found nothing."""
        own = cls.__new__(cls)
        own.order, own.limit, own.able = order, -np.inf, True
        value = lambda names: np.stack([np.append(got[c].fill_null(0).to_numpy(), 0) for c in names], axis=1).astype(float)
        # a last key that no gram has, so that none of the arrays is empty
        own.keys, at = np.unique(np.append(got["key"].to_numpy().view(_U), ~_U(0)), return_index=True)
        own.counts = value(["good", "bad"])[at]
        own.contexts, at = np.unique(np.append(got["context"].to_numpy().view(_U), ~_U(0)), return_index=True)
        own.total, own.kinds = value(["good_total", "bad_total"])[at], value(["good_kinds", "bad_kinds"])[at]
        return own

    def scores(self, col: pa.Array) -> np.ndarray:
        """By row; NaN for empty and null URLs."""
        col = normalise(col)
        key, row = grams(col, self.order)
        size = np.bincount(row, minlength=len(col))
        p = np.full((key.shape[1], 2), 1 / 256)
        for k in range(self.order + 1 if self.able else 0):
            context = _context(key[k])
            i = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
            j = np.minimum(np.searchsorted(self.keys, key[k]), len(self.keys) - 1)
            known = self.contexts[i] == context
            c = np.where((self.keys[j] == key[k])[:, None], self.counts[j], 0)
            n, u = np.where(known[:, None], self.total[i], 0), np.where(known[:, None], self.kinds[i], 0)
            p = np.where(n > 0, (c + u * p) / np.maximum(n + u, 1), p)
        ratio = np.log(p[:, 0]) - np.log(p[:, 1])
        out = np.bincount(row, ratio, len(col)) / np.maximum(size, 1)
        return np.where(size > 0, np.round(out, 6), np.nan)


class Stored:
    """The same counts as tables of grams and of contexts."""

    def __init__(self, table: DataFrame, order: int, limit: float = -np.inf):
        def contexts(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(_context(np.asarray(batch.column(0)).view(_U)).view(np.int64)), batch.column(1), batch.column(2)], ["context", "good", "bad"])

        self.table, self.order, self.limit = table, order, limit
        sums = [F.sum(c).alias(f"{c}_total") for c in ("good", "bad")] + [F.sum((F.col(c) > 0).cast("bigint")).alias(f"{c}_kinds") for c in ("good", "bad")]
        held = table.select("key", "good", "bad").mapInArrow(lambda batches: map(contexts, batches), "context bigint, good bigint, bad bigint")
        self.contexts = materialise(held.groupBy("context").agg(*sums))

    def scored(self, urls: DataFrame, part_bytes: int = 1 << 19) -> DataFrame:
        """``urls`` (url and others) with a score; without null and empty ones."""
        order = self.order
        urls = urls.where("url <> ''")
        parts = max(1, math.ceil((urls.agg(F.sum(F.octet_length("url"))).first()[0] or 0) / part_bytes))
        urls = urls.withColumn("part", F.pmod(F.xxhash64("url"), F.lit(parts)).cast("bigint"))

        def need(got: pa.Table) -> pa.Table:
            key = np.unique(grams(normalise(got["url"].combine_chunks()), order)[0])
            part = np.full(len(key), got["part"][0].as_py(), np.int64)
            return pa.table({"part": part, "key": key.view(np.int64), "context": _context(key).view(np.int64)})

        def score(got: pa.Table, found: pa.Table) -> pa.Table:
            return got.append_column("score", pa.array(Model.part(found, order).scores(got["url"].combine_chunks())))

        wanted = urls.select("part", "url").groupBy("part").applyInArrow(need, "part bigint, key bigint, context bigint")
        found = wanted.join(self.table, "key", "left").join(self.contexts, "context", "left")
        schema = StructType([*urls.schema.fields, StructField("score", DoubleType())])
        return urls.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(score, schema).drop("part")


def _bin(score: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((score + _REACH) * (_BINS / (2 * _REACH))), 0, _BINS - 1).astype(np.int32)


def calibrate(good: np.ndarray, bad: np.ndarray, max_loss: float, price: float = 20.0) -> float:
    """The limit, from histograms of held-out scores: at most ``max_loss`` of
    ``good`` below it, most of ``bad`` less ``price`` times the loss; the middle
    of equally good limits."""
    lost = np.concatenate([[0], np.cumsum(good)]) / max(good.sum(), 1)
    gone = np.concatenate([[0], np.cumsum(bad)]) / max(bad.sum(), 1)
    value = np.where(lost <= max_loss, gone - price * lost, -np.inf)
    best = np.flatnonzero(value >= value.max() - 1e-12)
    run = best[: np.flatnonzero(np.append(np.diff(best) != 1, True))[0] + 1]
    return float((run[0] + run[-1]) / 2 * (2 * _REACH / _BINS) - _REACH) if value.max() > 0 else -np.inf


def fit(
    urls: DataFrame, accepted: Column, rejected: Column, url_col: str = "url", order: int = 5, max_grams: int = 2_000_000, max_loss: float = 0.005
) -> Model | Stored:
    """``accepted`` and ``rejected`` mark the labelled rows of ``urls``."""
    slim = urls.select(F.col(url_col).cast("string").alias("url"), F.coalesce(accepted, F.lit(False)).alias("good"), F.coalesce(rejected, F.lit(False)).alias("bad"))
    slim = materialise(slim.where("(good or bad) and url <> ''").withColumn("held", F.pmod(F.xxhash64("url"), F.lit(10)) == 0))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        key, row = grams(normalise(batch.column(0)), order)
        if not key.size:
            return None
        marks = [np.tile(np.asarray(batch.column(k).cast(pa.int8()))[row], order + 1) for k in (1, 2)]
        keys, inverse = np.unique(key.ravel(), return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *[pa.array(np.bincount(inverse, m).astype(np.int64)) for m in marks]], ["key", "good", "bad"])

    seen = slim.where("not held").select("url", "good", "bad").mapInArrow(per_batch(count, text=0), "key bigint, good bigint, bad bigint")
    table = materialise(seen.groupBy("key").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")))
    kinds, *sums = table.agg(F.count("*"), F.sum("good"), F.sum("bad")).first()
    if kinds > max_grams and all(sums):
        model = Stored(table, order)
        held = model.scored(slim.where("held").select("url", F.col("good").cast("bigint").alias("good"), F.col("bad").cast("bigint").alias("bad")))
        at = F.floor((F.col("score") + _REACH) * (_BINS / (2 * _REACH)))
        held = held.select(F.greatest(F.lit(0), F.least(F.lit(_BINS - 1), at)).cast("int").alias("bin"), "good", "bad")
        model.limit = _limit(held, max_loss)
        return model
    # without accepted or without rejected ones no gram has a say
    got = (table.limit(0) if kinds > max_grams else table).toArrow()
    model = Model(got["key"].to_numpy().view(_U), np.stack([got["good"].to_numpy(), got["bad"].to_numpy()], axis=1), order)
    if not model.able:
        return model
    shared = slim.sparkSession.sparkContext.broadcast(model)

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        marks = [np.asarray(batch.column(k).cast(pa.int64())) for k in (1, 2)]
        bins, inverse = np.unique(_bin(shared.value.scores(batch.column(0))), return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(bins), *[pa.array(np.bincount(inverse, m, len(bins)).astype(np.int64)) for m in marks]], ["bin", "good", "bad"])

    held = slim.where("held").select("url", "good", "bad").mapInArrow(per_batch(score, text=0), "bin int, good bigint, bad bigint")
    model.limit = _limit(held, max_loss)
    return model


def _limit(held: DataFrame, max_loss: float) -> float:
    held = held.groupBy("bin").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toPandas()
    hist = np.zeros((2, _BINS))
    hist[:, held["bin"].to_numpy()] = held[["good", "bad"]].to_numpy().T
    return calibrate(*hist, max_loss)


def keep(urls: DataFrame, model: Model | Stored, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(``id_col``, url, score) of the rows that stay."""
    slim = urls.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"))
    if isinstance(model, Stored):
        return model.scored(slim).where(F.col("score") >= F.lit(float(model.limit))).withColumnRenamed("id", id_col)
    shared = urls.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        score = shared.value.scores(batch.column(1))
        at = pa.array(np.flatnonzero(score >= shared.value.limit))
        return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(score).take(at)], ["id", "url", "score"])

    return slim.mapInArrow(per_batch(run), "id bigint, url string, score double").withColumnRenamed("id", id_col)


def seeded(urls: DataFrame, terms: str = SEED_TERMS, url_col: str = "url") -> tuple[Column, Column]:
    """(accepted, rejected) for tables without labels: a URL with a seed term as
    a whole part between separators is rejected, any other accepted."""
    hit = F.lower(F.col(url_col)).rlike(rf"(^|[./_\-])({'|'.join(terms.split())})([./_\-?&=]|$)")
    return ~hit, hit
