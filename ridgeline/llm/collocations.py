"""Phrases by level-wise (Apriori) counting, scored at their weakest cut.

Texts are cut into pieces at punctuation and line ends, pieces into words.  Level k counts phrases
of k words within pieces.  A phrase cannot be more frequent than the phrases in it, so level k emits only
those whose first and last k - 1 words are both frequent at the level before, and keeps what is frequent.

The frequent phrases of a level reach the tasks as a broadcast table of bits at hashes of theirs.  It
has 32 bits for each phrase and at most ``MOST_BITS``, so its size is bounded whatever the corpus.  A bit
that two phrases share lets a phrase be counted in vain, never lost: what is kept is decided by the exact
counts, which are sums by the words themselves.  So results do not depend on the size of the table.

A task counts its texts' phrases with arrays, ``PASS_WORDS`` words at a time, and sends each distinct
phrase of a pass with its count; these sums are the only shuffle of a level, and a phrase that is a third of
all is no large group.  Scores come from joins of the level tables; of each language the best rows are
taken by pieces first, so that no task ranks all candidates of a language.

Defined results: null text is empty, null language is ``UNDETERMINED``; repeated rows count again;
very long texts are taken whole; ties go by count, then by the phrase's bytes; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.tasks import slim
from ridgeline.session import materialize

UNDETERMINED = "und"
LEAST_COUNT = 30
LONGEST = 4  # words
SCALE = 2_000_000
INSIDE_PERCENT = 80  # of a phrase's occurrences lie in a longer one: it is part of that
BEST = 2_000  # of a language
BITS_A_PHRASE, MOST_BITS = 32, 1 << 28
PASS_WORDS = 1 << 20
PIECES_OF_A_LANGUAGE = 64

#: Upper case, what ends a piece, what parts words.  0xFF is in no UTF-8 text.
_UPPER, _LOWER, _ENDS, _TAB = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b".,;:!?\n\x0b\x0c\r", b"\t"
_END = b"\xff"
_TABLE = bytes.maketrans(_UPPER + _ENDS + _TAB, _LOWER + _END * len(_ENDS) + b" ")
_COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words of a text, with ``_END`` where a piece ends."""
    return text.translate(_TABLE).replace(_END, b" \xff ").split()


def _rolled(hashes: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase from that of its first words and its last word's."""
    x = hashes * np.uint64(0x9E3779B97F4A7C15) + word
    return x ^ (x >> np.uint64(32))


def phrase_hash(lang: str, words: list[bytes]) -> int:
    h = np.array([xxhash.xxh3_64_intdigest(lang.encode())], np.uint64)
    for w in words:
        h = _rolled(h, np.array([xxhash.xxh3_64_intdigest(w)], np.uint64))
    return int(h[0])


class Bits:
    """Frequent phrases of a level as bits at their hashes; all phrases if there is no level before."""

    def __init__(self, packed: bytes | None, n_bits: int = 0):
        self.packed, self.n_bits = packed, n_bits

    def has(self, hashes: np.ndarray) -> np.ndarray:
        if self.packed is None:
            return np.ones(len(hashes), bool)
        at = hashes & np.uint64(self.n_bits - 1)
        table = np.frombuffer(self.packed, np.uint8)
        return (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


class _Ids(dict):
    """Numbers words in the order they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Pass:
    """Texts whose phrases of ``k`` words are counted together; distinct words are kept once, all words as numbers."""

    def __init__(self, k: int, frequent: Bits):
        self.k, self.frequent = k, frequent
        self.ids, self.lang_ids = _Ids(), _Ids()
        self.end = self.ids[_END]
        self.texts: list[np.ndarray] = []
        self.langs: list[int] = []
        self.size = 0

    def add(self, lang: str, text: bytes) -> None:
        words = words_of(text)
        words.append(_END)
        self.texts.append(np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words)))
        self.langs.append(self.lang_ids[lang])
        self.size += len(words)

    def _starts(self, word: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """Where a phrase of k words starts whose first and last k - 1 words may be frequent."""
        n = len(word) - self.k + 1
        inside, end = np.ones(max(n, 0), bool), word == self.end
        for j in range(self.k if n > 0 else 0):
            inside &= ~end[j : j + n]
        at = np.flatnonzero(inside)
        if self.k > 1:
            hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in self.ids], np.uint64)
            of_lang = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in self.lang_ids], np.uint64)
            for first in (0, 1):
                part = of_lang[lang[at]]
                for j in range(first, first + self.k - 1):
                    part = _rolled(part, hashes[word[at + j]])
                at = at[self.frequent.has(part)]
        return at

    def counts(self) -> pa.RecordBatch:
        """``lang, phrase, n`` for each distinct phrase whose parts may be frequent."""
        word, lang = np.concatenate(self.texts), np.repeat(np.array(self.langs, np.int64), [len(t) for t in self.texts])
        at, base = self._starts(word, lang), len(self.ids)
        # A phrase is a number to the base of the words, made dense where it would pass 62 bits.
        group, most, dense = lang[at], len(self.lang_ids), {}
        for j in range(self.k):
            if most * base >= 1 << 62:
                dense[j], group = np.unique(group, return_inverse=True)
                most = len(dense[j])
            group, most = group * base + word[at + j], most * base
        group, n_of = np.unique(group, return_counts=True)
        names, columns = pa.array(list(self.ids), pa.binary()), []
        for j in reversed(range(self.k)):
            columns.insert(0, names.take(pa.array(group % base)))
            group = group // base
            if j in dense:
                group = dense[j][group]
        phrases = pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.binary())).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array(list(self.lang_ids), pa.string()).take(pa.array(group)), phrases, pa.array(n_of, pa.int64())], schema=_COUNTS)


def phrase_counts(docs: DataFrame, k: int, frequent: Broadcast) -> DataFrame:
    """``lang, phrase, n``: occurrences of phrases of ``k`` words whose parts may be frequent.

    ``docs`` has ``lang, text``, without nulls.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Pass(k, frequent.value)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                now.add(lang, text.as_py())
                if now.size >= PASS_WORDS:
                    yield now.counts()
                    now = Pass(k, frequent.value)
        if now.size:
            yield now.counts()

    each = docs.select("lang", "text").mapInArrow(slim(count), "lang string, phrase string, n long")
    return each.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def frequent_bits(level: DataFrame, most_bits: int = MOST_BITS) -> Bits:
    """The phrases of a written level as bits: at most ``most_bits`` / 8 bytes reach the driver."""
    n_bits = 1 << 10
    wanted = min(most_bits, BITS_A_PHRASE * level.count())
    while n_bits < wanted:
        n_bits *= 2

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [phrase_hash(lang, phrase.encode().split(b" ")) & (n_bits - 1) for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([a >> 6 for a in at], pa.int64()), pa.array(np.left_shift(np.uint64(1), np.array([a & 63 for a in at], np.uint64)).view(np.int64))], names=["slot", "bits"])

    slots = level.select("lang", "phrase").mapInArrow(place, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(n_bits // 64, np.int64)
    table[slots["slot"].to_numpy()] = slots["bits"].to_numpy()
    return Bits(table.tobytes(), n_bits)


def _words(n: Column | str) -> Column:
    return F.split(n, " ")


def levels(docs: DataFrame, least_count: int = LEAST_COUNT, longest: int = LONGEST, most_bits: int = MOST_BITS) -> tuple[DataFrame, list[DataFrame]]:
    """All words' number by language (``lang, n``) and, for each k, the written table ``lang, phrase, n`` of frequent phrases."""
    spark = docs.sparkSession
    words = materialize(phrase_counts(docs, 1, spark.sparkContext.broadcast(Bits(None))), "words")
    found = [materialize(words.where(F.col("n") >= least_count), "phrases-1")]
    for k in range(2, longest + 1):
        bits = spark.sparkContext.broadcast(frequent_bits(found[-1], most_bits))
        found.append(materialize(phrase_counts(docs, k, bits).where(F.col("n") >= least_count), f"phrases-{k}"))
    return words.groupBy("lang").agg(F.sum("n").alias("n")), found


def exact(n: Column | str) -> Column:
    return (F.col(n) if isinstance(n, str) else n).cast("decimal(20,0)")


def scored(found: list[DataFrame]) -> DataFrame:
    """``lang, phrase, k, a, l, r, score`` of every phrase of two words or more, at its lowest-scoring cut."""
    out = None
    for k in range(2, len(found) + 1):
        words = _words("phrase")
        rows = found[k - 1].select("lang", "phrase", F.col("n").alias("a"))
        for cut in range(1, k):
            part = lambda level, name: found[level - 1].select("lang", F.col("phrase").alias(f"part_{name}"), F.col("n").alias(name))
            left, right = f"l{cut}", f"r{cut}"
            rows = rows.withColumns({f"part_{left}": F.array_join(F.slice(words, 1, cut), " "), f"part_{right}": F.array_join(F.slice(words, cut + 1, k - cut), " ")})
            rows = rows.join(part(cut, left), ["lang", f"part_{left}"]).join(part(k - cut, right), ["lang", f"part_{right}"]).drop(f"part_{left}", f"part_{right}")
        cuts = [
            F.struct(F.expr(f"CAST(CAST(a AS DECIMAL(20,0)) * {SCALE} AS DECIMAL(28,0)) DIV (CAST(l{cut} AS DECIMAL(20,0)) + CAST(r{cut} AS DECIMAL(20,0)))").alias("score"), F.lit(cut).alias("cut"), F.col(f"l{cut}").alias("l"), F.col(f"r{cut}").alias("r"))
            for cut in range(1, k)
        ]
        best = F.array_min(F.array(*cuts))
        rows = rows.select("lang", "phrase", F.lit(k).alias("k"), "a", best["l"].alias("l"), best["r"].alias("r"), best["score"].alias("score"))
        out = rows if out is None else out.unionByName(rows)
    return out


def without_parts(candidates: DataFrame, inside_percent: int = INSIDE_PERCENT) -> DataFrame:
    """Candidates but those whose occurrences lie in a longer one to ``inside_percent`` or more."""
    words = _words("phrase")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("k") - size + 1), lambda start: F.array_join(F.slice(words, start, size), " "))))
    inner = candidates.where(F.col("k") > 2).select("lang", F.explode(spans).alias("phrase"), F.col("a").alias("longer"))
    most = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    part = exact("longer") * 100 >= exact("a") * inside_percent
    return candidates.join(most, ["lang", "phrase"], "left").where(F.col("longer").isNull() | ~part).drop("longer")


def best_of_each(candidates: DataFrame, best: int = BEST) -> DataFrame:
    """``rank`` by score, count and phrase, of each language's first ``best``; ranked in pieces of a language first."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    piece = F.pmod(F.xxhash64("phrase"), F.lit(PIECES_OF_A_LANGUAGE))
    ahead = candidates.withColumn("piece", piece).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "piece").orderBy(*order))).where(F.col("rank") <= best)
    return ahead.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best).drop("piece")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least_count: int = LEAST_COUNT, best: int = BEST, inside_percent: int = INSIDE_PERCENT, most_bits: int = MOST_BITS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's best phrases."""
    docs = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNDETERMINED)).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    totals, found = levels(docs, least_count, most_bits=most_bits)
    candidates = materialize(scored(found), "candidates")
    ranked = best_of_each(without_parts(candidates, inside_percent), best)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: DuckDB SQL over ``documents``; its numbers have 128 bits.
ORACLE_SQL = rf"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, regexp_extract_all(piece, '[^ \t]+') AS w
  FROM (SELECT coalesce(lang, '{UNDETERMINED}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER.decode()}', '{_LOWER.decode()}'), '[.,;:!?\n\x0b\f\r]')) AS piece FROM documents)),
f AS MATERIALIZED (
  SELECT lang, k, w[i : i + k - 1] AS p, count(*) AS a
  FROM pieces, (SELECT unnest(range(1, {LONGEST + 1})) AS k), LATERAL (SELECT unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS i)
  GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT * FROM f WHERE k > 1 AND a >= {LEAST_COUNT}),
cuts AS (
  SELECT c.lang, c.p, c.k, c.a, cut, x.a AS l, y.a AS r, CAST({SCALE} AS HUGEINT) * c.a // (CAST(x.a AS HUGEINT) + y.a) AS score
  FROM c, LATERAL (SELECT unnest(range(1, c.k)) AS cut)
  JOIN f x ON x.lang = c.lang AND x.p = c.p[1 : cut] JOIN f y ON y.lang = c.lang AND y.p = c.p[cut + 1 : c.k]),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1),
inner_parts AS (
  SELECT lang, p[i : i + size - 1] AS p, max(a) AS longer
  FROM c, LATERAL (SELECT unnest(range(2, k)) AS size), LATERAL (SELECT unnest(range(1, k - size + 2)) AS i) GROUP BY ALL),
kept AS (SELECT s.* FROM scored s LEFT JOIN inner_parts i ON i.lang = s.lang AND i.p = s.p WHERE longer IS NULL OR 100 * CAST(longer AS HUGEINT) < {INSIDE_PERCENT} * CAST(a AS HUGEINT)),
named AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, CAST(score AS BIGINT) AS score FROM kept)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM named JOIN totals USING (lang) QUALIFY rank <= {BEST}
"""
