"""A corpus pipeline over the training-data operators.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is
written as Parquet and read again as the next one's docs.  All stages but the last return the
columns of documents; the last returns the encoded corpus.

1. language: documents without a letter, or whose language is a guess, go.
2. exact copies: of equal texts (A-Z lower-cased) the smallest identifier stays.
3. near copies: of each class of similar texts (five-word shingles, similarity of 0.8 or more, by
   SimHash fingerprints within 16 bits and sketches of the shingles) the smallest identifier stays.
4. benchmark: documents that repeat any benchmark window (13 words, or a shorter item) go.
5. pieces: SentencePiece ids, decoded again and held against the text.
"""

from __future__ import annotations

import functools
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from inkveil.llm import decontam, dedup_lsm, langid, simhash
from inkveil.llm import sentencepiece_lattice as lattice
from inkveil.llm.common import delete_path, new_path, release_staged, ship, staging_for
from inkveil.llm.queries import documents, tokenizer_path

_run: ContextVar[str] = ContextVar("run", default="")


def stage(f):
    """A stage frees what the earlier stages of its run staged, as their results have been written
    by now: of the same ``run``, or of stages called one by one for the same ``sf_dir``."""

    @functools.wraps(f)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        owner = _run.get() or f"stages of {sf_dir}"
        release_staged(owner)
        with staging_for(owner):
            return f(spark, docs, sf_dir)

    return call


@stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs)


@stage
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lsm.remove(docs)


@stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.remove(docs)


@stage
def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lattice.encode(docs, tokenizer_path("piece_bpe_32k.model"), keep=("doc_id", "lang", "source"))


STAGES = [("language", language), ("exact_copies", exact_copies), ("near_copies", near_copies), ("benchmark", benchmark), ("pieces", pieces)]

#: Hashes over shingles, a trained classifier and a tokenizer: not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.  A stage's written result goes once the next one's is written;
    the last of them stays, as the returned rows are computed from it."""
    docs, before = documents(spark, sf_dir), None
    token = _run.set(f"run {uuid.uuid4().hex}")
    try:
        for name, f in STAGES[:-1]:
            out = f(spark, docs, sf_dir)
            with staging_for("pipeline results"):
                path = new_path(spark, f"pipeline-{name}")
            out.write.parquet(path)
            docs = spark.read.schema(out.schema).parquet(path)
            if before:
                delete_path(spark, before)
            before = path
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        _run.reset(token)
