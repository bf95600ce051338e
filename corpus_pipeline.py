"""From raw documents to token digests of a training mix.

Each stage gets the documents that its predecessor kept and returns documents with the same
columns; the last returns doc_id, n_tokens and digests of ids and decoded text per document of
the mix (a document that the mix repeats has a row per copy). A stage starts on executors that
have given back the heap that its predecessor needed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.bpe import digest_documents
from graphloom.llm.common import shared_dir, table, trimmed
from graphloom.llm.mixing import mixed_documents
from graphloom.llm.near_dup import keep_one
from graphloom.llm.quality import keep_quality
from graphloom.llm.toxicity import keep_civil


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    trimmed(spark)
    return keep_quality(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    trimmed(spark)
    return keep_civil(docs, docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    trimmed(spark)
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    trimmed(spark)
    return mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    trimmed(spark)
    return digest_documents(docs)


STAGES = [
    ("quality rules", quality),
    ("toxicity", toxicity),
    ("minhash near-dedup", near_duplicates),
    ("mixing sources to target weights", mixing),
    ("bpe encoding and decoding", encoding),
]

#: Minhashing, the trained models and BPE have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
