"""The registered queries of the text operators: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from meshroute.llm import bpe, fingerprints, language, mixing, neardup, quality, rules, sharding, substrings, tokenfile
from meshroute.llm.common import documents, scratch_path


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_digest(documents(spark, sf_dir))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language.identify(docs, language.fit(docs))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(documents(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.score_documents(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(documents(spark, sf_dir))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(documents(spark, sf_dir))


def op10_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    tokenfile.write_files(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"))
    return tokenfile.read_files(spark, path)


def queries() -> dict:
    return {
        "op1_substrings": op1_substrings,
        "op2_sharding": op2_sharding,
        "op3_language": op3_language,
        "op4_bpe": op4_bpe,
        "op5_mixing": op5_mixing,
        "op6_quality": op6_quality,
        "op7_neardup": op7_neardup,
        "op8_rules": op8_rules,
        "op9_fingerprints": op9_fingerprints,
        "op10_tokenfile": op10_tokenfile,
    }


_OP1 = r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
f AS (SELECT s, min(doc_id) AS least FROM win GROUP BY s),
gone AS (SELECT doc_id, list(DISTINCT k) AS ks FROM (SELECT doc_id, unnest(range(i, i + 50)) AS k FROM win JOIN f USING (s) WHERE least < doc_id) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ks), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN ks IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(ks, i)) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)"""


def oracle_sql() -> dict:
    return {"op1_substrings": _OP1}
