"""The corpus pipeline: documents in, encoded training documents out.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns
a DataFrame, which run() writes as Parquet and rereads as the next stage's docs. All
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import bpe, mixing, neardup, pii, quality
from quillgraph.llm.common import small_batches, table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the factorisation machine rejects. Null and empty texts are
    scored like any other; repeated rows share their text's fate."""
    small_batches(spark)
    return quality.accepted(docs, quality.train_query(spark, docs, sf_dir))


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of exact and near copies, the least doc_id. Null
    texts are no copies of each other; rows with a null doc_id stay; of rows that repeat
    a doc_id one stays."""
    small_batches(spark)
    return neardup.keep_one(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind. Null and empty texts stay as they are; every
    row is kept."""
    small_batches(spark)
    return pii.redact_documents(docs, pii.train(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take blocks of words by source; repeated documents are repeated rows. Null and
    blank texts have no words to take and go; a null source is a source."""
    return mixing.apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every whole text, checked by decoding them. A null text is empty."""
    small_batches(spark)
    return bpe.encode_checked(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", keep_first_copies),
    ("pii", redact_pii),
    ("mix", mix_sources),
    ("bpe", encode),
]

#: Trained models, MinHash groups and token ids aren't SQL; tests/llm holds each stage
#: against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
