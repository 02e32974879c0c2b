"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are positives; every other text is unlabelled, since most toxic texts
were never reviewed.  Linear classifiers over hashed words minimise the risk

    prior * R_pos(+1) + max(0, R_unl(-1) - prior * R_pos(-1))

whose second term estimates the risk on negatives from unlabelled texts, corrected by the
class prior.  Where the estimate turns negative, the model has begun to fit the positives
inside the unlabelled texts, and the step undoes that instead.

The fit sees a bounded sample (``most_positive``, ``most_unlabelled`` rows of the learned
folds, chosen by a hash of the id); the class prior is taken over all reviewed rows there, and
every whole text is scored.  The weights have a fixed size, whatever the corpus.

Defined results: null and empty texts score as texts without words; very long texts are read
whole, as the set of their words; null ids are in a learned fold; conflicting labels of one id
count as toxic; null labels are ignored; without positives every score is 0; if every reviewed
text is toxic, the prior is 1; rows that share an id each count in the fit, and equal texts score
alike; ids whose hashes tie for a place in the sample go by the id; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.langid import held_out
from ridgeline.llm.tasks import slim

DIM = 1 << 20
MOST_POSITIVE = 4_000
MOST_UNLABELLED = 12_000
LEAST_TEXTS = 8  # of the fit sample, for a word to get a weight
LEAST_Z = 3.0  # standard errors between its shares of positive and unlabelled texts
MEMBERS = 3
STEPS = 150
RATE = 0.08
SHRINK = 2e-4

#: A-Z become a-z, other ASCII characters than letters become blanks.
_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def features(text: bytes) -> np.ndarray:
    """Sorted distinct word hashes of a text."""
    mask = DIM - 1
    return np.array(sorted({zlib.crc32(w) & mask for w in text.translate(_WORDS).split()}), np.int32)


class Rows:
    """Sparse rows of 0 and 1 over columns that were kept."""

    def __init__(self, rows: list[np.ndarray]):
        self.size = np.array([len(r) for r in rows], np.int64)
        self.index = np.concatenate(rows).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(len(rows)), self.size)

    def __len__(self) -> int:
        return len(self.size)

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.index], len(self))

    def gather(self, values: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.index, values[self.row], width)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(positive: Rows, unlabelled: Rows, prior: float, width: int, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Minimise the non-negative risk with the logistic loss by full-batch Adam steps."""
    w, b = np.zeros(width), 0.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        zp, zu = positive.times(w) + b, unlabelled.times(w) + b
        sp, su = _sigmoid(zp), _sigmoid(zu)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        if negative >= 0:  # slopes of prior * R_pos(+1) - prior * R_pos(-1) add up to a constant
            cp, cu = np.full(len(positive), -prior / len(positive)), su / len(unlabelled)
        else:
            cp, cu = prior * sp / len(positive), -su / len(unlabelled)
        g = np.append(positive.gather(cp, width) + unlabelled.gather(cu, width) + SHRINK * w, cp.sum() + cu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def telling(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> np.ndarray:
    """Word hashes whose share of positive texts clearly differs from that of unlabelled ones.

    Most words of a corpus are rare and say nothing; weights for them would only remember the
    texts of the fit sample.
    """
    n, m = len(positive), len(unlabelled)
    a, b = (np.bincount(np.concatenate(rows), minlength=DIM) for rows in (positive, unlabelled))
    share = (a + b) / (n + m)
    error = np.sqrt(share * (1 - share) * (1 / n + 1 / m)) + 1e-12
    return np.flatnonzero((np.abs(a / n - b / m) > LEAST_Z * error) & (a + b >= LEAST_TEXTS))


def train(docs: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, float]:
    """Weights by word hash and the bias, from rows of the learned folds."""
    reviewed = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic")).where(~held_out("id")).dropna().groupBy("id").agg(F.max("toxic").alias("toxic"))
    seen = reviewed.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    if not seen.toxic:
        return np.zeros(DIM, np.float32), -40.0
    prior = seen.toxic / seen.n
    turn = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where(~held_out("id"))
    chosen = reviewed.where("toxic = 1").where(turn < 1.2 * most_positive / seen.toxic).orderBy(turn, "id").limit(most_positive).select("id")
    n = texts.count()
    # At most most_positive ids, so this side is bounded.
    positive = texts.join(F.broadcast(chosen), "id").select(F.lit(1).alias("kind"), "text")
    # The positives are a few among the unlabelled, as they are in the corpus.
    unlabelled = texts.where(F.coalesce(turn, F.lit(0.0)) < 1.2 * most_unlabelled / max(1, n)).orderBy(turn, "id").limit(most_unlabelled).select(F.lit(0).alias("kind"), "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [features(t.as_py() or b"") for t in batch.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.int32()))], names=["kind", "words"])

    sample = positive.union(unlabelled).mapInArrow(slim(extract), "kind int, words array<int>").toArrow().combine_chunks()
    kind = sample.column("kind").to_numpy()
    rows = [x.values.to_numpy() for x in sample.column("words")]
    pos, unl = ([rows[i] for i in np.flatnonzero(kind == k)] for k in (1, 0))
    if not pos or not unl:
        return np.zeros(DIM, np.float32), -40.0
    kept = telling(pos, unl)
    place = np.full(DIM, -1)
    place[kept] = np.arange(len(kept))
    pos, unl = ([(p := place[r])[p >= 0] for r in rows] for rows in (pos, unl))
    weights, bias = np.zeros(DIM, np.float32), 0.0
    members = min(MEMBERS, len(unl))
    for k in range(members):  # each member has its own share of the unlabelled texts
        w, b = fit(Rows(pos), Rows(unl[k::members]), prior, len(kept))
        weights[kept] += w / members
        bias += b / members
    return weights, bias


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every whole text: the mean member's probability of being toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            z = np.array([weights[features(t.as_py() or b"")].sum(dtype=np.float64) + bias for t in batch.column(1).cast(pa.large_binary())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_sigmoid(z))], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(slim(judge), "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
