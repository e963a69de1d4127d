"""Documents to training tokens: quality rules, near duplicates, repeated passages, source
mix, byte-level BPE.

``STAGES`` are (name, function) pairs; each function takes (spark, docs, sf_dir) and returns
a DataFrame, which is written as Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsdeck.llm import bpe, mixing, ngram_join, quality, substring_dedup
from opsdeck.session import ensure_checkpoint_dir


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.with_quality(docs, result_col="quality__").filter("quality__.kept").select(docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id."""
    return ngram_join.keep_one(docs)


def fresh_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that occur again; ``n_chars`` follows. A document that loses
    every word stays, with an empty text."""
    kept = substring_dedup.repeated_words(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weighed alike; a document appears as often as its drawn count."""
    return mixing.mix_sources(docs).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document of the mix: its id, source, token ids and the bytes they decode to."""
    return bpe.encode_and_decode(docs.select("doc_id", "lang", "source", "text"), *bpe.production_vocabulary())


STAGES = [
    ("quality rules", good),
    ("n-gram Jaccard join", distinct),
    ("substring dedup", fresh_text),
    ("mixing sources", mix),
    ("byte-level BPE", tokens),
]

#: Suffix-array rules and connected components are not SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's rows lie in the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
