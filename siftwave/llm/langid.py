"""Language ID (6): nearest-centroid classification of TF-IDF n-gram vectors.

A text becomes a vector of ``dims`` hashed byte-trigram weights,
``(1 + ln tf) * idf``, normalised to length one.  Document frequencies come
from every document.  Each language has several centroids (spherical k-means
over at most ``sample_per_lang`` labelled rows - the only bound, and only for
the classifier's fit).  A text takes the language of the centroid with the
highest cosine; it is rejected where its cosine distance is over the limit
calibrated for texts of its length.

Defined results: a null, empty or letterless text is rejected (lang null,
similarity 0); ties between centroids go to the alphabetically first language;
repeated rows are judged alike; a null label never trains; with no labelled
rows every text is rejected; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwave.llm.common import cuts, lowest, per_batch, raw_bytes

#: letters keep their (lower-case) byte, every other byte is a blank
_LETTER = np.full(256, 32, np.uint8)
_LETTER[128:] = np.arange(128, 256)
_LETTER[97:123] = np.arange(97, 123)


def gram_counts(col: pa.Array, dims: int) -> np.ndarray:
    """Dense (rows x dims) counts of the hashed trigrams of letters and blanks."""
    data, off = raw_bytes(col)
    rows = len(off) - 1
    x = _LETTER[data]
    row = np.repeat(np.arange(rows), np.diff(off))
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32) | (row[1:] != row[:-1])
    x, row = x[keep].astype(np.uint32), row[keep]
    if len(x) < 3:
        return np.zeros((rows, dims), np.float32)
    code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    shift = np.uint32(32 - int(dims).bit_length() + 1)
    slot = ((code * np.uint32(2654435761)) >> shift).astype(np.int64)
    ok = row[:-2] == row[2:]
    flat = np.bincount((row[:-2] * dims + slot)[ok], minlength=rows * dims)
    return flat.reshape(rows, dims).astype(np.float32)


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0).astype(np.float32) * idf
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.maximum(norm, 1e-12)


def _blocks(col: pa.Array, rows: int = 64):
    for a, b in cuts(col, 1 << 20):
        for s in range(a, b, rows):
            yield s, min(b, s + rows)


def document_frequencies(texts: DataFrame, dims: int) -> tuple[np.ndarray, int]:
    """Over every row of ``texts`` (one string column): df by slot, row count."""

    def count(batches):
        df, n = np.zeros(dims, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for a, b in _blocks(batch.column(0)):
                df += (gram_counts(batch.column(0).slice(a, b - a), dims) > 0).sum(axis=0)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], n), pa.int64())], ["slot", "n"])

    got = texts.mapInArrow(count, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(dims)
    total = int(got.loc[got.slot == -1, "n"].sum())
    got = got[got.slot >= 0]
    df[got.slot.to_numpy()] = got.n.to_numpy()
    return df, total


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    k = min(k, len(x))
    centre = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = (x @ centre.T).argmax(axis=1)
        for j in range(k):
            if (near == j).any():
                c = x[near == j].mean(axis=0)
                centre[j] = c / max(np.linalg.norm(c), 1e-12)
    return centre


def _length_bin(grams: np.ndarray) -> np.ndarray:
    return np.clip(np.log2(np.maximum(grams, 1)).astype(int), 0, 20)


class Model:
    def __init__(self, langs, centroids, owner, idf, limit):
        self.langs, self.centroids, self.owner, self.idf, self.limit = langs, centroids, owner, idf, limit

    def predict(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language index, cosine, accepted) by row."""
        who, cos, ok = np.zeros(len(col), int), np.zeros(len(col)), np.zeros(len(col), bool)
        if not len(self.langs):
            return who, cos, ok
        for a, b in _blocks(col):
            counts = gram_counts(col.slice(a, b - a), len(self.idf))
            sim = np.round((_vectors(counts, self.idf) @ self.centroids.T).astype(float), 6)
            best = sim.argmax(axis=1)
            who[a:b], cos[a:b] = self.owner[best], sim[np.arange(b - a), best]
            grams = counts.sum(axis=1)
            ok[a:b] = (grams > 0) & (cos[a:b] >= self.limit[_length_bin(grams)])
        return who, cos, ok


def fit(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dims: int = 8192, clusters: int = 4,
    sample_per_lang: int = 400, quantile: float = 0.002, slack: float = 0.75,
) -> Model:
    """``sample_per_lang`` bounds the labelled rows that the classifier is
    fitted on; ``quantile`` and ``slack`` place the rejection limit under the
    cosines that labelled rows (and their leading words, for short lengths)
    reach."""
    texts = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    df, total = document_frequencies(texts.select("text"), dims)
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)
    # of each language the rows of lowest hash; texts that are the same count once
    labelled = texts.where("lang is not null and length(trim(text)) > 0").withColumn("h", F.xxhash64("text"))
    rows = lowest(labelled, "lang", "h", sample_per_lang).select("text", "lang").toArrow().combine_chunks()
    langs, parts, owner, held = [], [], [], []
    for lang in sorted(set(rows.column("lang").to_pylist())):
        col = rows.column("text").filter(pc.equal(rows.column("lang"), lang)).combine_chunks()
        col = col.take(pc.sort_indices(col))
        v = np.concatenate([_vectors(gram_counts(col.slice(a, b - a), dims), idf) for a, b in _blocks(col)])
        centre = _kmeans(v, clusters)
        owner += [len(langs)] * len(centre)
        langs.append(lang)
        parts.append(centre)
        held += col.to_pylist()
    if not langs:
        return Model([], np.zeros((0, dims), np.float32), np.zeros(0, int), idf, np.ones(21))
    model = Model(langs, np.concatenate(parts), np.array(owner), idf, np.zeros(21))
    grams, cosines = [], []
    for take in (1, 2, 4, 8, 16, 32, 64, None):
        cut = pa.array([" ".join(t.split()[:take]) for t in held])
        for a, b in _blocks(cut):
            counts = gram_counts(cut.slice(a, b - a), dims)
            grams.append(counts.sum(axis=1))
            cosines.append((_vectors(counts, idf) @ model.centroids.T).max(axis=1))
    bins, cosines = _length_bin(np.concatenate(grams)), np.concatenate(cosines)
    for k in range(21):
        own = cosines[bins == k]
        model.limit[k] = slack * np.quantile(own, quantile) if len(own) >= 50 else np.nan
    known = np.flatnonzero(~np.isnan(model.limit))
    model.limit = np.interp(np.arange(21), known, model.limit[known]) if len(known) else np.zeros(21)
    return model


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, lang, similarity, accepted), one row for each input row."""
    langs = np.array(model.langs + [None], dtype=object)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        who, cos, ok = model.predict(batch.column(1))
        named = langs[np.where(ok, who, len(langs) - 1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(named, pa.string()), pa.array(np.round(cos, 6)), pa.array(ok)], ["id", "lang", "similarity", "accepted"])

    slim = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(per_batch(run), "id bigint, lang string, similarity double, accepted boolean").withColumnRenamed("id", id_col)


def keep_known(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is recognised; all columns as they came."""
    names = docs.columns
    slim = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    at = names.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(model.predict(batch.column(at))[2]))

    return slim.mapInArrow(per_batch(run, text=at), slim.schema).toDF(*names)
