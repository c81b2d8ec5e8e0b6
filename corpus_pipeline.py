"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Quality, near duplicates, shared passages, mixture, tokens. All but the last return the columns of documents. Each
stage handles nulls, empty and very long texts, repeated rows, ties, other columns and empty tables as its operator's
module says. What a stage has written is deleted once the next one is done.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from meshroute.llm import bpe, mixing, neardup, quality, substrings
from meshroute.llm.common import documents, drop, scratch_path


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier doesn't reject; it learns from the labelled rows of docs."""
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    return neardup.keep_one(docs)


def cut_shared_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words and more that an earlier document has."""
    return substrings.dedup_texts(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as the mix of their sources takes them."""
    return mixing.mixed_texts(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document's text, their number and digests."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("shared_passages", cut_shared_passages),
    ("mixture", mix_sources),
    ("tokens", encode),
]

#: No stage can be said in SQL: a trained compressor, fingerprint groups, a schedule by 64-bit hashes, a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop(spark, before)
        before = path
    return docs
