"""Language identification with error-correcting output codes.

Each language gets a codeword of bits; for each bit a binary classifier over byte trigrams
tells the languages with 1 from those with 0.  A classifier is the log-odds of trigrams under
the two sets of languages, each language counting alike; its margin on a text is the mean
over the text's trigrams.  Decoding weighs the logistic loss of every bit by how well the
bit's classifier separates, and takes the codeword with the smallest total; a text whose
runner-up is nearly as near is flagged as ambiguous.

Training counts trigrams over all labelled rows: each task adds up its own, Spark adds up the
tasks', and the driver gets one table of at most ``DIM`` numbers for each language.

Defined results: text that is null or has no letter is ``und`` with score 0; rows with null
language are not learned from; without any labelled row every text is ``und``; one learned
language is given to every text with letters; equally near languages resolve to the one that
sorts first, and are ambiguous; repeated rows count each time they occur, and are judged alike;
very long texts are read whole, their weights summed up a part at a time; more than
``MOST_LANGUAGES`` languages are an error, since the model's size follows their number; an empty table
gives an empty result; all columns of the input are kept, whatever their names.  A letter is a character of Unicode category L.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ridgeline.llm.tasks import slim

DIM = 1 << 15
MOST_LANGUAGES = 256
SMOOTHING = 0.5
SHARPNESS = 8.0
AMBIGUOUS = 0.05  # least difference of weighted loss between the nearest codeword and the next
UNDETERMINED = "und"
FOLDS = 5

_LETTER = regex.compile(r"\p{L}")
#: Bytes of ASCII characters that are no letters become blanks.
_BLANKS = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that nothing is learned from; a null id is in a learned fold."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(False))


def trigrams(text: str) -> np.ndarray:
    """Hashed byte trigrams of the lower-cased letters of a text, words set apart by blanks."""
    letters = b" ".join(text.lower().encode("utf-8", "replace").translate(_BLANKS).split())
    b = np.frombuffer(b" " + letters + b" ", np.uint8).astype(np.uint32)
    code = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(17)


def codewords(n: int) -> np.ndarray:
    """Rows of +1 and -1, one for each language; no column is constant.

    All distinct splits for up to five languages, else the random code, of many drawn with a
    fixed seed, whose rows are furthest apart.
    """
    if n < 2:
        return np.ones((n, 0))
    if n <= 5:
        rows = [(1, *c) for c in itertools.product((1, -1), repeat=n - 1)][1:]
        return np.array(rows, float).T
    width, rng, best = int(np.ceil(10 * np.log2(n))), np.random.default_rng(0), None
    for _ in range(200):
        code = rng.choice((-1.0, 1.0), (n, width))
        apart = ((width - code @ code.T) / 2 + width * np.eye(n)).min()
        if abs(code.sum(axis=0)).max() < n and (best is None or apart > best[0]):
            best = (apart, code)
    return best[1]


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # language x bit
    weights: np.ndarray  # trigram x bit
    trust: np.ndarray  # bit; sums to 1

    def margins(self, text: str) -> np.ndarray:
        codes, total = trigrams(text), np.zeros(self.weights.shape[1])
        for lo in range(0, len(codes), 1 << 18):
            total += self.weights.take(codes[lo : lo + (1 << 18)], axis=0).sum(axis=0)
        return total / max(1, len(codes))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether it is ambiguous."""
        if not text or not self.languages or not _LETTER.search(text):
            return UNDETERMINED, 0.0, False
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        loss = np.logaddexp(0, -SHARPNESS * self.codes * self.margins(text)) @ self.trust
        near, nearest = np.partition(loss, 1)[:2], int(loss.argmin())
        score = 1 / np.exp(loss[nearest] - loss).sum()
        return self.languages[nearest], float(score), bool(near[1] - near[0] < AMBIGUOUS)


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on all rows with a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                text = text.as_py()
                if not _LETTER.search(text):
                    continue
                if (counts := held.get(lang)) is None:
                    counts = held[lang] = np.zeros(DIM, np.int64)
                if len(text) > DIM // 2:  # adding one by one is the quicker way for short texts
                    counts += np.bincount(trigrams(text), minlength=DIM)
                else:
                    np.add.at(counts, trigrams(text), 1)
            if len(held) > MOST_LANGUAGES:
                raise ValueError(f"more than {MOST_LANGUAGES} languages")
        for lang, counts in held.items():
            code = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code.astype(np.int32)), pa.array(counts[code])], names=["lang", "code", "n"])

    rows = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna()
    total = rows.mapInArrow(slim(count), "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    lang, code, n = (total.column(c) for c in ("lang", "code", "n"))
    languages = sorted(set(lang.to_pylist()))
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts = np.zeros((len(languages), DIM))
    at = np.array([languages.index(x) for x in lang.to_pylist()], int)
    counts[at, code.to_numpy()] = n.to_numpy()
    share = (counts + SMOOTHING) / (counts + SMOOTHING).sum(axis=1, keepdims=True)
    codes = codewords(len(languages))
    ones, zeros = (np.stack([share[codes[:, j] == s].mean(axis=0) for j in range(codes.shape[1])], axis=1) if codes.shape[1] else np.zeros((DIM, 0)) for s in (1, -1))
    weights = np.log(ones) - np.log(zeros) if codes.shape[1] else ones
    apart = ((ones - zeros) * weights).sum(axis=0)
    return Model(languages, codes, weights.astype(np.float32), apart / apart.sum() if apart.sum() else np.full(len(apart), 1 / max(1, len(apart))))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Every input row as the struct ``row``, with ``lang_pred``, ``score`` and ``ambiguous``."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).field(at).cast(pa.string())
            found = [shared.value.predict(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_())))], names=["row", "lang_pred", "score", "ambiguous"])

    schema = StructType([StructField("row", docs.schema), *StructType.fromDDL("lang_pred string, score double, ambiguous boolean").fields])
    return docs.select(F.struct("*").alias("row")).mapInArrow(slim(predict), schema)


def identified(docs: DataFrame) -> DataFrame:
    """Learn from the rows of the learned folds and predict every row."""
    model = train(docs.where(~held_out()))
    return identify(docs, model)
