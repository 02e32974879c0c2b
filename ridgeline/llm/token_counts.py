"""Token counts through a cache of digests.

A count depends on the content and on the tokenizer alone.  The cache is a Parquet table of
``tokenizer, digest, n_tokens``, partitioned by tokenizer: ``tokenizer`` is the digest of the tokenizer's
file and its library's version, ``digest`` that of the normalised content.  Counting is joins:

1. every document's digest (no text leaves its task), and of each distinct digest one holder;
2. an anti-join with the stored counts: what is left are the distinct misses;
3. the misses' holders by a semi-join, so that of copies one text is encoded: by the digest and a hash of the id,
   in which a thousand copies of a text are no large group; where misses are few Spark broadcasts them
   and no text is shuffled at all;
4. their counts are appended to the cache in one commit, and all documents are joined with the cache, digests of
   many documents apart (``skew.join_counted``).

A run that is lost before the commit leaves the cache as it was; two runs at once may store a count
twice, which reading tolerates.

Normalised content is what the tokenizer's own normaliser makes of a text, if no added token occurs in it
before or after (those are found by their exact strings); else, and for tokenizers without
normaliser and SentencePiece models, the text itself.

Defined results: null text is empty text, of no bytes; rows that share an id are counted each; a
null id is an id like any other; a text of any length is encoded whole; an empty table gives an
empty result and appends nothing; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.skew import join_counted
from ridgeline.llm.tasks import slim
from ridgeline.session import materialize, run_path

LIMIT = 512
CACHE_SETTING = "spark.ridgeline.tokenCache"
CACHE_SCHEMA = "digest binary, n_tokens long, tokenizer string"
_COUNTS = pa.schema([("digest", pa.binary()), ("n_tokens", pa.int64())])

#: Fixed value: the "pre_tokenizer" of byte-level files whose pieces never go over a blank before a visible character.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
_GAP = re.compile(r" (?=\S)")
#: Fixed value: the pieces of that pre_tokenizer.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


class JsonCounter:
    """Counts the tokens of texts with a file of the tokenizers library.

    A byte-level tokenizer's pieces end before a blank that a visible character follows, so texts
    without added tokens are cut there, and cuts of letters up to U+00FF, on whose classes all Unicode
    versions agree, into pieces.  The library's model takes each distinct piece once while
    it is remembered (the last one or two ``limit`` are).  All other cuts and texts go through the library whole.
    """

    def __init__(self, path: str, limit: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has one task for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)")
        state = json.loads(self.tokenizer.to_str())
        model = state["model"]
        self.by_cut = not state["normalizer"] and state["pre_tokenizer"] == _BYTE_LEVEL and model["type"] == "BPE" and not model["dropout"]
        self.known, self.older, self.limit = {}, {}, limit
        self.pieces, self.older_pieces = {}, {}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        self.byte_chars = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> int:
        n = self.pieces.get(piece) or self.older_pieces.get(piece) or len(self.tokenizer.model.tokenize("".join(map(self.byte_chars.__getitem__, piece.encode()))))
        self.pieces[piece] = n
        return n

    def _cut(self, cut: str) -> int:
        return sum(map(self._piece, _PIECES.findall(cut))) if cut and max(cut) <= "ÿ" else self.whole(cut)

    def count(self, text: str) -> int:
        if not self.by_cut or self.added.search(text):
            return self.whole(text)
        first, *cuts = _GAP.split(text)
        if len(self.known) > self.limit:
            self.known, self.older = {}, self.known
        if len(self.pieces) > self.limit:
            self.pieces, self.older_pieces = {}, self.pieces
        known = self.known
        for cut in set(cuts).difference(known):
            known[cut] = self.older.get(cut) or self._cut(" " + cut)
        return self._cut(first) + sum(map(known.__getitem__, cuts))

    def normalised(self, text: str) -> bytes:
        """Equal for texts of equal tokens."""
        if self.tokenizer.normalizer is not None and not self.added.search(text):
            plain = self.tokenizer.normalizer.normalize_str(text)
            if not self.added.search(plain):
                return b"n" + plain.encode("utf-8", "surrogatepass")
        return b"t" + text.encode("utf-8", "surrogatepass")


class PieceCounter:
    """Counts the pieces of texts with a SentencePiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def count(self, text: str) -> int:
        return len(self.model.encode(text, num_threads=1))


@functools.lru_cache(maxsize=2)
def counter(path: str) -> JsonCounter | PieceCounter:
    """One for each Python worker, which Spark uses again for later tasks."""
    if path.endswith(".json"):
        return JsonCounter(path)
    if path.endswith(".model"):
        return PieceCounter(path)
    raise ValueError(f"a tokenizer is a .json or .model file, not {path}")


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file and of its library's name and version."""
    library = __import__("tokenizers" if path.endswith(".json") else "sentencepiece")
    with open(path, "rb") as f:
        digest = hashlib.file_digest(f, "sha256")
    digest.update(f"{library.__name__} {library.__version__}".encode())
    return digest.hexdigest()


def _keyed(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text, holder, digest``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    tokenizer = counter(tokenizer_path)
    if isinstance(tokenizer, JsonCounter) and tokenizer.tokenizer.normalizer is not None:

        @F.pandas_udf("binary")
        def digest(texts: pd.Series) -> pd.Series:
            normalised = counter(tokenizer_path).normalised
            return pd.Series([hashlib.sha256(normalised(t)).digest() for t in texts])

        content = digest("text")
    else:
        content = F.unhex(F.sha2("text", 256))
    return rows.select("doc_id", "text", F.xxhash64("doc_id").alias("holder"), content.alias("digest"))


def stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """``digest, n_tokens`` of one tokenizer, each digest once."""
    table = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    return table.where(F.col("tokenizer") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def append(counts: DataFrame, cache: str, version: str) -> None:
    counts.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache)


def encoded(texts: DataFrame, tokenizer_path: str) -> DataFrame:
    """``digest, n_tokens`` for ``digest, text``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, last = counter(tokenizer_path).count, None
        for batch in batches:
            digests, counts = [], []
            # A join by shuffle sorts by digest: equal ones, which share their id as well, come one after another.
            for digest, text in zip(batch.column(0), batch.column(1)):
                digest = digest.as_py()
                if digest != last:
                    digests.append(digest)
                    counts.append(count(text.as_py()))
                    last = digest
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(counts, pa.int64())], schema=_COUNTS)

    return texts.select("digest", "text").mapInArrow(slim(encode), "digest binary, n_tokens long")


def count_tokens(spark: SparkSession, docs: DataFrame, tokenizer_path: str, cache: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row; ``cache`` is a shared folder, made if it is not there."""
    version = tokenizer_version(tokenizer_path)
    keyed = _keyed(docs, tokenizer_path, id_col, text_col)
    append(spark.createDataFrame([], "digest binary, n_tokens long"), cache, version)  # the folder
    keys = materialize(keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "holder", "digest"), "content-digests")
    distinct = materialize(keys.groupBy("digest").agg(F.count("*").alias("n"), F.min("holder").alias("holder")), "distinct-digests")
    misses = materialize(distinct.join(stored(spark, cache, version), "digest", "left_anti").select("digest", "holder"), "misses")
    texts = keyed.select("digest", "holder", "text").join(misses, ["digest", "holder"], "left_semi")
    # Rows that share id and text are the only ones left to meet.
    append(encoded(texts, tokenizer_path).dropDuplicates(["digest"]), cache, version)
    found = materialize(distinct.select("digest", "n").join(stored(spark, cache, version), "digest"), "found-counts")
    counted = join_counted(keys, found, ["digest"], "n", "inner")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def cache_folder(spark: SparkSession) -> str:
    """The folder that the session names for the cache, else a fresh one of this run in the shared folder."""
    return spark.conf.get(CACHE_SETTING, None) or run_path(spark, "token-cache")
