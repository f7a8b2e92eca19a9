"""The queries of this subpackage: each applies an operator, with production parameters, to the
whole of its table and derives the contract's columns from the operator's outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, dedup_lsm, langid, pii_crf, quality, sharding, simhash, sstable, token_count
from . import sentencepiece_lattice as lattice
from .common import ship


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = sstable.write(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))
    return sstable.read(spark, files, with_ids=False)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lsm.dedup(documents(spark, sf_dir), keep="max").select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded, decoded again from its pieces, and held against the text."""
    return lattice.encode(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"), with_ids=False)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.summary(decontam.find(documents(spark, sf_dir), benchmark))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.detect(documents(spark, sf_dir)).drop("found")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), sharding.layout(24), sharding.layout(25))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {
    "op1_sstable": op1_sstable,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_language": op3_language,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_token_counts": op5_token_counts,
    "op6_decontamination": op6_decontamination,
    "op7_personal_data": op7_personal_data,
    "op8_simhash": op8_simhash,
    "op9_hash_tree": op9_hash_tree,
    "op10_quality": op10_quality,
}

ORACLE_SQL = {
    "op2_exact_dedup": """
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        k AS (SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, sha256(t) AS text_sha256 FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k""",
}
