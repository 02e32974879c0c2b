"""Spelling variants by anagram hashing.

Words of a text are runs of letters.  A letter has its code point's fifth power as value, and a
word the sum of its letters' values as integer key, which anagrams share.  Two words that differ
by one added or removed letter have keys that differ by that letter's value, and two that differ
by one exchanged letter have keys that differ by the difference of two values.  So each word gives
its key, and its key less the value of each of its letters: an addition or removal meets where a
key equals a lessened one, an exchange where two lessened keys are equal, whatever the letters.

Letter order is verified in two steps.  Rows carry a digest of the letters left over in their
order, computed for all places of a word in one pass, and keys meet only with equal digests: anagrams
never become pairs, and what meets has all letters but one in common, so a group holds at most
(letters of the alphabet) x (length + 1) words.  Then the words themselves are compared.

Counting sees every occurrence, summed on the map side, so a word that is a third of a corpus is
no large group; after it, all work is on the vocabulary.  Rows of keys carry a hash for the word, not the word, so
a very long word costs its length and not its square; equal hashes only add pairs to compare.

``noise`` deletes a letter from one occurrence in 199 or so, chosen by the CRC-32 of document and word: a
corpus of misspellings with a known origin.  Without it words are counted as they are.

Defined results: null and empty texts have no words; a null id counts as the empty string in the noise's hash;
repeated rows count again; runs of any length are words; equal counts of near words go to the word
that is first in code-point order; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.tasks import slim
from ridgeline.session import materialize

#: What a word is made of, and what is lower-cased.
LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LEAST_LETTERS = 6
LEAST_COUNT = 5
FORM_RATIO = 5  # of a form's count to that of its variant
NOISE = 199
POWER = 5
WHOLE = -1  # place of a row that has all letters
PASS_LETTERS = 1 << 20  # of words taken to keys at once
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse among 64-bit integers
_KEYS = pa.schema([("key", pa.int64()), ("rest", pa.int64()), ("place", pa.int32()), ("id", pa.int64())])


def with_noise(doc_id: Column, word: Column, every: int = NOISE) -> Column:
    """The word, or the word less one letter where the hash of document and word says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word))
    at = F.pmod(h, F.length(word).cast("long")).cast("int")
    return F.when(h % every != 0, word).otherwise(F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word))))


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, noise: int | None = None) -> DataFrame:
    """``word, n``: distinct words of enough letters and occurrences."""
    runs = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(LETTERS), F.lit(0))).alias("word"))
    lowered = runs.select("doc_id", F.when(F.col("word").rlike("[A-Z]"), F.translate("word", UPPER, LOWER)).otherwise(F.col("word")).alias("word"))
    words = lowered if noise is None else lowered.select(with_noise(F.col("doc_id"), F.col("word"), noise).alias("word"))
    counts = words.where(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= least_count)


def _mixed(codes: np.ndarray) -> np.ndarray:
    """Code points spread over 64 bits."""
    x = (codes + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x * np.uint64(0x94D049BB133111EB)


def keys_of(words: list[str], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``key, rest, place, id`` of each word whole and of each word less the letter at each place.

    All sums are modulo 2**64, which keeps differences of keys.  ``rest`` is a polynomial of the letters
    left over in their order: prefix sums before the place, and those after it moved down by one.
    """
    lengths = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
    starts = np.cumsum(lengths) - lengths
    word = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(codes)) - starts[word]
    weights = np.full(int(lengths.max()), _BASE, np.uint64)
    weights[0] = 1
    weights = np.cumprod(weights)
    values = codes ** np.uint64(POWER)
    terms = _mixed(codes) * weights[place]
    total_key, upto = np.add.reduceat(values, starts), np.cumsum(terms)
    base = upto[starts] - terms[starts]
    upto -= base[word]
    total = np.add.reduceat(terms, starts)
    inverse = np.uint64(pow(_BASE, -1, 1 << 64))
    rest = upto - terms + inverse * (total[word] - upto)
    key = np.concatenate([total_key, total_key[word] - values])
    return key.view(np.int64), np.concatenate([total, rest]).view(np.int64), np.concatenate([np.full(len(words), WHOLE), place]).astype(np.int32), np.concatenate([ids, ids[word]])


def anagram_keys(words: DataFrame) -> DataFrame:
    """``key, rest, place, id`` for a table with ``word, id``, words not empty."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            lo = 0
            while lo < len(texts):
                hi, letters = lo, 0
                while hi < len(texts) and (hi == lo or letters + len(texts[hi]) <= PASS_LETTERS):
                    letters, hi = letters + len(texts[hi]), hi + 1
                columns = keys_of(texts[lo:hi], ids[lo:hi])
                for at in range(0, len(columns[0]), PASS_LETTERS):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at : at + PASS_LETTERS]) for c in columns], schema=_KEYS)
                lo = hi

    return words.select("word", "id").mapInArrow(slim(emit), "key long, rest long, place int, id long")


def near_words(words: DataFrame) -> DataFrame:
    """``a, b``: all pairs of words one added, removed or exchanged letter apart, both ways, each once.

    ``words`` has ``word`` (distinct) and ``id``, a hash of it, and should be a written table.
    """
    keyed = materialize(anagram_keys(words), "anagram-keys")
    lessened = keyed.where(F.col("place") != WHOLE).select("key", "rest", F.col("place").alias("other_place"), F.col("id").alias("other"))
    added = F.col("place") == WHOLE
    exchanged = (F.col("place") == F.col("other_place")) & (F.col("id") < F.col("other"))
    pairs = keyed.join(lessened, ["key", "rest"]).where(added | exchanged).select("id", "other").distinct()
    texts = pairs.join(words.select("id", F.col("word").alias("a")), "id").join(words.select(F.col("id").alias("other"), F.col("word").alias("b")), "other")
    near = materialize(texts.where(F.levenshtein("a", "b", 1) == 1).select("a", "b").distinct(), "near-words")
    return near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))


def roots(formed: DataFrame) -> DataFrame:
    """``word, root`` for ``word, form``: forms followed to the last, by doubling.

    Every form has ``FORM_RATIO`` times the count of its word or more, so there is no cycle and no way of
    more than 27 steps: five doublings at most.
    """
    ways = materialize(formed.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if ways.join(onward, "root", "left_semi").isEmpty():
            return ways
        ways = materialize(ways.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")


def variants(words: DataFrame, form_ratio: int = FORM_RATIO) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for a vocabulary ``word, n`` with distinct words."""
    words = materialize(words.select("word", "n", F.xxhash64("word").alias("id")), "vocabulary")
    of_near = near_words(words).join(words.select(F.col("word").alias("b"), "n"), "b")
    # The smallest of (-n, word) has the largest n, and of equal ones the first word.
    best = of_near.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("minus_n"), F.col("b").alias("near"))).alias("best"))
    found = words.drop("id").join(best, "word", "left")
    is_form = -F.col("best.minus_n") >= F.col("n") * form_ratio
    formed = found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.minus_n")).alias("form_n"))
    formed = materialize(formed, "formed")
    last = roots(formed.where("form is not null"))
    return formed.join(last, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int | None = None, form_ratio: int = FORM_RATIO) -> DataFrame:
    """The vocabulary of all documents with each word's near words, likely form and root."""
    return variants(vocabulary(docs, id_col, text_col, noise=noise), form_ratio)


#: DuckDB SQL over ``documents``: CRC-32 by its polynomial, near words by what is left without a letter.
ORACLE_SQL = f"""
WITH RECURSIVE crc_steps AS (
  SELECT range AS byte, 0 AS k, range AS c FROM range(256)
  UNION ALL SELECT byte, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_steps WHERE k < 8),
crc_table AS MATERIALIZED (SELECT list(c ORDER BY byte) AS t FROM crc_steps WHERE k = 8),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{LETTERS}')) AS run FROM documents),
counted AS (SELECT doc, run, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(doc || ':' || run)), '..'), lambda x: CAST('0x' || x AS BIGINT))),
                                 lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM counted, crc_table),
noisy AS (SELECT CASE WHEN h % {NOISE} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM noisy WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
less AS MATERIALIZED (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM v, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
one_way AS (
  SELECT v.word AS a, less.word AS b FROM v JOIN less ON v.word = rest
  UNION SELECT x.word, y.word FROM less x JOIN less y ON x.rest = y.rest AND x.i = y.i AND x.word < y.word),
near AS (SELECT a, b FROM one_way UNION SELECT b, a FROM one_way),
ranked AS (
  SELECT a, b, n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS place
  FROM near JOIN v ON v.word = b),
formed AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN r.n >= {FORM_RATIO} * v.n THEN b END AS form, CASE WHEN r.n >= {FORM_RATIO} * v.n THEN r.n END AS form_n
  FROM v LEFT JOIN ranked r ON r.a = v.word AND place = 1),
ways AS (
  SELECT word, coalesce(form, word) AS root, form IS NULL AS ended FROM formed
  UNION ALL SELECT w.word, coalesce(f.form, w.root), f.form IS NULL FROM ways w JOIN formed f ON f.word = w.root WHERE NOT w.ended)
SELECT f.word, f.n, CAST(n_near AS BIGINT) AS n_near, form, form_n, root FROM formed f JOIN ways w ON w.word = f.word AND w.ended
"""
