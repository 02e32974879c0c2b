import numpy as np
from pyspark.sql import functions as F

from ridgeline.llm import queries, toxicity

SF = "/root/testdata/sf0.1"


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    n = label.sum()
    return (rank[label == 1].sum() - n * (n - 1) / 2) / (n * (len(label) - n))


def test_held_out(spark):
    got = queries.op3_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    held = got[got.held_out]
    a = auc(held.score.to_numpy(), held.toxic.to_numpy())
    hit = held[held.predicted == 1]
    print("auc", a, "precision", hit.toxic.mean(), "recall", held[held.toxic == 1].predicted.mean())
    assert a > 0.8 and hit.toxic.mean() > 0.7 and held[held.toxic == 1].predicted.mean() > 0.55


def test_risk_is_corrected_for_the_prior():
    rng = np.random.default_rng(0)
    text = lambda bad: np.array(sorted({*rng.integers(10, 60, 12), *([int(rng.integers(0, 3))] if bad else [])}))
    pos, unl = [text(True) for _ in range(200)], [text(i % 5 == 0) for i in range(2000)]
    w, b = toxicity.fit(toxicity.Rows(pos), toxicity.Rows(unl), 0.2, 60)
    z = np.array([w[r].sum() + b for r in unl]) > 0
    truth = np.arange(2000) % 5 == 0
    assert (z == truth).mean() > 0.97


def test_scores_against_brute_force(spark):
    """Every score by plain sums over the words of the text, for the model that the query learns."""
    import math

    small = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    weights, bias = toxicity.train(docs, spark.read.parquet(f"{small}/labels.parquet"))
    want = {}
    for r in docs.select("doc_id", "text").collect():
        words = {w for w in "".join(c.lower() if "A" <= c <= "Z" else " " if c < "\x80" and not c.isalpha() else c for c in r.text or "").encode().split()}
        want[r.doc_id] = 1 / (1 + math.exp(-(bias + sum(float(weights[k]) for k in {int(toxicity.features(w)[0]) for w in words}))))
    got = queries.op3_toxicity(spark, small).collect()
    assert len(got) == len(want) and all(abs(r.score - want[r.doc_id]) < 1e-6 and r.predicted == (r.score >= 0.5) for r in got)


def test_fit_against_slow_gradient():
    """The first steps equal those of the risk's numeric slope."""
    rng = np.random.default_rng(3)
    pos, unl = ([np.unique(rng.integers(0, 8, 4)) for _ in range(n)] for n in (6, 15))
    prior, width = 0.3, 8

    def risk(v):
        z = lambda rows: np.array([v[r].sum() + v[-1] for r in rows])
        loss = lambda x: np.logaddexp(0, -x)
        negative = loss(-z(unl)).mean() - prior * loss(-z(pos)).mean()
        return prior * loss(z(pos)).mean() + max(0.0, negative) + toxicity.SHRINK / 2 * (v[:-1] ** 2).sum(), negative

    w, b = toxicity.fit(toxicity.Rows(pos), toxicity.Rows(unl), prior, width, steps=1)
    v = np.zeros(width + 1)
    slope = np.array([(risk(v + h)[0] - risk(v - h)[0]) / 2e-6 for h in np.eye(width + 1) * 1e-6])
    assert risk(v)[1] > 0 and np.allclose(np.append(w, b), -toxicity.RATE * np.sign(slope), atol=1e-3)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (4, "bad " * 10), (4, "bad")], "doc_id long, text string").withColumn("score", F.lit("s"))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, none).collect()
    assert len(got) == 5 and all(r.score < 1e-6 and r.predicted == 0 for r in got)
    some = spark.createDataFrame([(1, 1), (1, 0), (2, None), (4, 1), (None, 1)], "doc_id long, toxic int")
    assert all(0 <= r.score <= 1 for r in toxicity.toxicity(docs, some).collect())
    assert toxicity.toxicity(docs.limit(0), some).count() == 0
