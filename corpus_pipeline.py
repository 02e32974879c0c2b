"""A training corpus from raw documents, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes every stage's
result as Parquet in the shared folder and rereads it as the next one's ``docs``.  All stages but
the last return the columns of ``docs``.

Language ID rejects documents that are null or have no letter, or whose language is ambiguous.
Near-dedup keeps the first document of each group that
shares four fifths of its five-word shingles: SimHash links fingerprints within four bits, which finds the nearly equal,
fingerprints of minima add the pairs that SimHash cannot reach at a bearable cost (README), and an exact check of shingle
sets decides on both.  Decontamination removes documents that hold a benchmark window.  Mixing samples towards its target shares.  The last stage writes
token records, and returns one row for each document, read back from the files.

Defined results: every stage takes nulls in any column, empty and very long texts, repeated rows
(judged alike), empty tables and further columns of any name, which it hands on unchanged.  Ties:
equally near languages are ambiguous and go; of a group of copies the smallest id stays, with all
rows that have it, and rows without an id stay; equal draws of the mixing are sampled alike.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ridgeline.llm import decontaminate, langid, mixing, near_copies, simhash, token_records
from ridgeline.llm.tasks import small_batches
from ridgeline.session import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; null texts and texts without letters go, at any length."""
    small_batches(spark)
    found = langid.identified(docs)
    return found.where((found.lang_pred != langid.UNDETERMINED) & ~found.ambiguous).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group; texts without words are copies of each other."""
    small_batches(spark)
    return simhash.keep_one(docs, near_copies.near_copies(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark; null and empty texts have none."""
    small_batches(spark)
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample towards the target weights; null sources and languages are values of their own."""
    return mixing.sample(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each record read back; null texts have their end id only, repeated ids a record each."""
    small_batches(spark)
    return token_records.token_ids(spark, docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language ID", language), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("mixing", mix), ("token records", tokens)]

#: No SQL expresses these stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
