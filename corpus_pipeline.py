"""A corpus pipeline of five stages; each works on all documents that its predecessor kept.

In every stage texts decide: rows without doc_id, or with the same doc_id, stay or go by their own text. Null and empty
texts are judged as their operator's docstring says, and have no tokens in the end. Ties and repeated rows stay or go
together, but for near copies, of which one stays. An empty table gives an empty result of the same columns. Further
columns of any name pass through all stages but the last.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import byte_bpe, decontamination, jaccard_join, quality, toxicity
from palimpsest.llm.textops import remove, shared_folder, written


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject: null and empty texts stay unless all labelled documents are toxic."""
    return toxicity.keep_clean(docs, labels(spark, sf_dir))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model does not reject: null and empty texts count as texts of which all features are 0."""
    return quality.keep_good(docs, labels(spark, sf_dir))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 5-word shingles at a similarity of 0.8, the one of least doc_id (null: last).

    Texts without words stay; of repeated rows (doc_id and text) one stays.
    """
    return jaccard_join.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item: null and empty texts stay, repeated rows stay or go together."""
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and their byte offsets of each remaining document, by doc_id (null: kept); null and empty texts have none."""
    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("byte_bpe", encode),
]

#: SQL can't express the trained stages; tests/llm compares the pipeline with its operators run one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows are a Parquet table in the shared folder.

    A stage's table is deleted when its successor's is written; the last one, which the result reads, stays.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        docs = written(stage(spark, docs, sf_dir), path)
        if before:
            remove(spark, before)
        before = path
    return docs
