import itertools

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import mixing, queries
from tests.duck import same

SF = "/root/testdata/sf0.01"


def test_whole_table(spark):
    same(queries.op8_mixing(spark, SF), SF, queries.ORACLES["op8_mixing"])


def test_marginals_are_the_targets(spark):
    rows = [(s, x, t, 10 + 7 * i, 1) for i, (s, x, t) in enumerate(itertools.product("abc", "pq", "uv"))]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long, docs long")
    share = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"p": 0.9, "q": 0.1}, "topic": {"u": 0.25, "v": 0.75}}
    targets = {d: spark.createDataFrame(list(v.items()), "value string, share double") for d, v in share.items()}
    raked = mixing.rake(cells, targets, rounds=20).toPandas()
    for d, v in share.items():
        assert raked.groupby(d).weight.sum().to_dict() == pytest.approx(v, abs=1e-6)
    assert raked.residual.max() < 1e-6 < mixing.rake(cells, targets, rounds=1).toPandas().residual.max()
    odds = raked.assign(r=raked.weight / raked.tokens).set_index(["source", "lang", "topic"]).r
    # Raking keeps all odds ratios within the table.
    assert odds["a", "p", "u"] * odds["b", "q", "u"] == pytest.approx(odds["a", "q", "u"] * odds["b", "p", "u"])


def test_sample_follows_the_targets(spark):
    mixed = mixing.mix(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).toPandas()
    assert mixed.probability.max() == 1.0 and 0.2 < mixed.kept.mean() < 1
    for d in ("source", "lang"):
        want = (mixed.groupby(d).tokens.sum() ** mixing.TEMPERATURE).pipe(lambda s: s / s.sum())
        got = mixed[mixed.kept].groupby(d).tokens.sum().pipe(lambda s: s / s.sum())
        assert (got - want).abs().max() < 0.03


def test_odd_rows(spark):
    rows = [(1, None, "en", "s"), (2, "", None, None), (2, "", None, None), (None, "a b", "en", "s"), (4, "x | y " * 50, "de", "s")]
    frame = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]).astype({"doc_id": "Int64"})
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    mixed = mixing.mix(docs.withColumns({"weight": F.lit("w"), "kept": F.lit(1), "topic": F.lit(None), "row": F.lit(0)}))
    same(mixed.select("row.doc_id", "source", "lang", "topic", "tokens", "weight", "residual", "probability", "kept"), SF, mixing.oracle_sql(), {"documents": frame})
    kept = mixing.sample(docs)
    assert kept.columns == docs.columns and kept.count() >= 3
    assert mixing.mix(docs.limit(0)).count() == 0


def test_many_cells_and_other_topics(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.row.doc_id: r.kept for r in mixing.mix(docs).collect()}
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 0)
    assert {r.row.doc_id: r.kept for r in mixing.mix(docs).collect()} == want
    long = mixing.mix(docs, topic_of=lambda text: F.when(F.length(text) > 500, "long").otherwise("short"))
    assert {r.topic for r in long.select("topic").distinct().collect()} == {"long", "short"}


def test_very_long_text_and_small_probabilities(spark):
    from pyspark.sql import functions as F

    rows = [(1, "word " * 200_000, "a", "en"), (2, "x", "a", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    assert {r.row.doc_id: r.tokens for r in mixing.mix(docs).collect()} == {1: 200_000, 2: 1}
    cells = spark.createDataFrame([("a", "en", "prose", 10**12, 10**9, 1e-9), ("b", "en", "prose", 10, 10, 1.0)], "source string, lang string, topic string, tokens long, docs long, weight double").withColumn("residual", F.lit(0.0))
    small = mixing.probabilities(cells).where("source = 'a'").first()
    assert small.probability == 0.0 and small.p > 0.0
