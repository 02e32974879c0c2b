import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import queries, token_counts
from ridgeline.session import run_path

SF = "/root/testdata/sf0.001"
BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "\n\n", "a", " a", "a  b", "a \n b", "x\n <|endoftext|> y", "<|endoftext|>", "<|startoftext|>A a", "<|STARTOFTEXT|>", "don't  we'LL", "é̈ É", "日本語 テスト", "a　b\xa0c   d",
    "²³½ ⅷ 12 3", "\x1c \x85 \x00", "👩‍👧 x", "ab " * 5000 + "\n", "a" * 20_000,
]


def library(path):
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(model.encode(t))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)


def brute(rows, path, limit=512):
    count = library(path)
    return sorted(((i, len((t or "").encode()), n, n > limit) for i, t in rows for n in [count(t or "")]), key=str)


def got(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()), key=str)


def test_whole_table_is_as_the_library_counts(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert got(queries.op13_token_counts(spark, SF)) == brute(rows, BYTES)


@pytest.mark.parametrize("path", [BYTES, WORDS, PIECES])
def test_odd_texts_ids_and_columns(spark, path):
    rows = [*enumerate(ODD), *((None, t) for t in ODD), (3, "other text"), (3, "other text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"digest": F.lit("x"), "holder": F.lit(1), "n_tokens": F.lit(None), "n": F.lit(2)})
    assert got(token_counts.count_tokens(spark, docs, path, run_path(spark, "cache"))) == brute(rows, path)


def test_cuts_match_the_library():
    rng, count = random.Random(5), token_counts.JsonCounter(BYTES, limit=50)
    pool = [" ", "  ", "\n", " \n", "\t", "\xa0", "　", "\x1c", "\x85", "a", "Ab", "é", "1", "!", "'s", "<|endoftext|>", "日", "½", "ª", "µ", "\xad"]
    assert count.by_cut
    for _ in range(5000):
        t = "".join(rng.choices(pool, k=rng.randint(0, 9)))
        assert count.count(t) == count.whole(t), repr(t)


def entries(spark, cache, path):
    return spark.read.parquet(cache).where(F.col("tokenizer") == token_counts.tokenizer_version(path))


def test_only_distinct_misses_are_encoded_and_appended(spark, monkeypatch):
    cache = run_path(spark, "cache")
    docs = spark.createDataFrame([(1, "one text"), (2, "one text"), (3, "two"), (None, None), (5, "")], "doc_id long, text string")
    first = got(token_counts.count_tokens(spark, docs, BYTES, cache))
    assert entries(spark, cache, BYTES).count() == 3
    seen = []
    real = token_counts.encoded
    monkeypatch.setattr(token_counts, "encoded", lambda texts, path: (seen.append(sorted(r.text for r in texts.collect())), real(texts, path))[1])
    more = docs.unionByName(spark.createDataFrame([(6, "three"), (7, "three"), (7, "three")], docs.schema))
    second = got(token_counts.count_tokens(spark, more, BYTES, cache))
    # The rows of one holder meet in one task and are encoded once.
    assert set(seen[0]) == {"three"} and set(first) < set(second) and entries(spark, cache, BYTES).count() == 4
    token_counts.count_tokens(spark, more, BYTES, cache).collect()
    assert seen[1] == [] and entries(spark, cache, BYTES).count() == 4
    token_counts.count_tokens(spark, docs, WORDS, cache).collect()  # another tokenizer has counts of its own
    assert len(seen[2]) == 3 and entries(spark, cache, WORDS).count() == 3 and entries(spark, cache, BYTES).count() == 4


def test_stored_counts_are_what_is_returned(spark):
    cache = run_path(spark, "cache")
    docs = spark.createDataFrame([(1, "stored"), (2, "new")], "doc_id long, text string")
    version = token_counts.tokenizer_version(BYTES)
    stored = spark.createDataFrame([("stored", 700)], "text string, n_tokens long").select(F.unhex(F.sha2("text", 256)).alias("digest"), "n_tokens")
    token_counts.append(stored, cache, version)
    token_counts.append(stored, cache, version)  # stored twice by two runs at once
    assert got(token_counts.count_tokens(spark, docs, BYTES, cache)) == [(1, 6, 700, True), (2, 3, library(BYTES)("new"), False)]


def test_texts_of_equal_tokens_share_a_digest(spark):
    cache = run_path(spark, "cache")
    docs = spark.createDataFrame([(1, "Two  Words"), (2, "two words"), (3, "<|startoftext|>"), (4, "<|STARTOFTEXT|>")], "doc_id long, text string")
    assert got(token_counts.count_tokens(spark, docs, WORDS, cache)) == brute([tuple(r) for r in docs.collect()], WORDS)
    assert entries(spark, cache, WORDS).count() == 3


def test_cache_of_the_session_and_empty_table(spark):
    cache = run_path(spark, "cache")
    assert token_counts.cache_folder(spark) != token_counts.cache_folder(spark)
    spark.conf.set(token_counts.CACHE_SETTING, cache)
    try:
        assert token_counts.cache_folder(spark) == cache
    finally:
        spark.conf.unset(token_counts.CACHE_SETTING)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert got(token_counts.count_tokens(spark, empty, BYTES, cache)) == [] and spark.read.schema(token_counts.CACHE_SCHEMA).parquet(cache).count() == 0
