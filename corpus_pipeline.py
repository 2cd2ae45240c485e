"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), where ``docs`` is all that the stage
before it kept, and works on all of it; all but the last return the columns of
``documents``, whatever else these are called.

Defined results: a row whose ``doc_id`` is null is judged alone: it can be
rejected by language or contamination and redacted, never merged.  Null, empty
and letterless texts have no language and go at once.  Rows that repeat an id stay
or go together as near-duplicates (with the text of fewest grams), and each by its
own text elsewhere.  A group of near-duplicates keeps its lowest id.  Texts of any
length are read whole.  An empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwave.llm import chosen_path, decontam, langid, packing, pii
from siftwave.llm.common import reachable, shared_dir, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no recognised language."""
    reachable(spark)
    return langid.keep_known(docs, langid.fit(docs))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the lowest doc_id of each group of near-duplicates."""
    reachable(spark)
    return chosen_path.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data; ``n_chars`` follows the text."""
    reachable(spark)
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences: one row per piece of a document."""
    reachable(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("redaction", redaction),
    ("best_fit_packing", best_fit_packing),
]

#: none of the stages can be said in SQL; tests/llm holds run() against plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result is written and reread."""
    docs = table(spark, sf_dir, "documents")
    where = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{k}-{name}")
        docs = spark.read.parquet(f"{where}/{k}-{name}")
    return docs
