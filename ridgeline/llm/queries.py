"""The thin ``opN_<name>`` queries: each applies its operator to whole tables and shapes the result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import ann, chat, collocations, decontaminate, langid, line_dedup, mixing, simhash, spelling, token_counts, token_records, toxicity, warc
from ridgeline.llm.tasks import small_batches

QUERIES: dict = {}
ORACLES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLES["op1_decontamination"] = decontaminate.ORACLE_SQL


@query
def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(spark, table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op2_warc_revisits"] = warc.ORACLE_SQL


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user', :probe), (-1L, 1L, 'assistant', :probe) AS t(conv_id, turn, role, text)", {"probe": probe})
    return chat.format_and_read_back(spark, turns.unionByName(extra), public_tokenizers.path("word_bpe_49k.json"))


@query
def op5_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_site_lines(table(spark, sf_dir, "pages"))


ORACLES["op5_site_lines"] = line_dedup.oracle_sql()


@query
def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records.token_ids(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("row.doc_id", "source", "lang", "topic", "tokens", "weight", "residual", "probability", "kept")


ORACLES["op8_mixing"] = mixing.oracle_sql()


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identified(table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", langid.held_out("row.doc_id").alias("held_out"), "lang_pred", "score", "ambiguous")


@query
def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), noise=spelling.NOISE)


ORACLES["op11_spelling_variants"] = spelling.ORACLE_SQL


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


ORACLES["op12_collocations"] = collocations.ORACLE_SQL


@query
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), token_counts.cache_folder(spark))
