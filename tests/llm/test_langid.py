import numpy as np
from pyspark.sql import functions as F

from ridgeline.llm import langid, queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = queries.op9_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all()
    held = got[got.held_out]
    assert 100 < len(held) < 350 and (held.lang == held.lang_pred).mean() > 0.97


def test_codewords():
    for n in (2, 3, 4, 5, 6, 30):
        c = langid.codewords(n)
        assert len(c) == n and set(np.unique(c)) == {-1.0, 1.0} and (abs(c.sum(axis=0)) < n).all()
        far = (c[:, None] != c[None]).sum(axis=2) + c.shape[1] * np.eye(n)
        assert far.min() >= (2 ** (n - 2) if n <= 5 else 3)


def test_brute_force_counts(spark):
    rows = [("Ein Satz.", "de"), ("the words, the", "en"), (None, "en"), ("la la", None), ("123", "fr")]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"))
    assert model.languages == ["de", "en"]
    counts = {lang: np.bincount(langid.trigrams(t), minlength=langid.DIM) + langid.SMOOTHING for t, lang in rows[:2]}
    p = {k: v / v.sum() for k, v in counts.items()}
    want = np.log(p["de"]) - np.log(p["en"])
    assert np.allclose(model.weights[:, 0] * model.codes[0, 0], want, atol=1e-5)


def slow_predictions(rows):
    """Plain counting over all learned rows, then loss-weighted decoding text by text."""
    import math
    import unicodedata
    import zlib

    learned = [(t, lang) for d, t, lang in rows if t is not None and lang is not None and not (d is not None and zlib.crc32(str(d).encode()) % 5 == 0)]
    letter = lambda t: any(unicodedata.category(c).startswith("L") for c in t)
    names = sorted({lang for t, lang in learned if letter(t)})
    share = {}
    for name in names:
        n = [langid.SMOOTHING] * langid.DIM
        for t, lang in learned:
            if lang == name and letter(t):
                for g in langid.trigrams(t).tolist():
                    n[g] += 1
        total = sum(n)
        share[name] = [x / total for x in n]
    code = langid.codewords(len(names))
    logs, trust = [], []
    for j in range(code.shape[1]):
        side = [[s for i, s in enumerate(share.values()) if code[i, j] == v] for v in (1, -1)]
        one, zero = ([sum(x) / len(x) for x in zip(*s)] for s in side)
        logs.append([math.log(a) - math.log(b) for a, b in zip(one, zero)])
        trust.append(sum((a - b) * w for a, b, w in zip(one, zero, logs[-1])))
    out = {}
    for d, t, _ in rows:
        if t is None or not letter(t):
            out[d] = ("und", 0.0)
            continue
        grams = langid.trigrams(t).tolist()
        margins = [sum(w[g] for g in grams) / len(grams) for w in logs]
        loss = [sum(u * math.log1p(math.exp(-langid.SHARPNESS * c * m)) for u, c, m in zip(trust, row, margins)) / sum(trust) for row in code]
        best = min(range(len(names)), key=lambda i: loss[i])
        out[d] = (names[best], 1 / sum(math.exp(loss[best] - x) for x in loss))
    return out


def test_predictions_against_brute_force(spark):
    small = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang").collect()]
    want = slow_predictions(rows)
    got = queries.op9_language_id(spark, small).collect()
    assert len(got) == len(want) and all(r.lang_pred == want[r.doc_id][0] and abs(r.score - want[r.doc_id][1]) < 1e-4 for r in got)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "123 !!"), (6, "\u00bd \u00b2"), (7, "\u2460 \u0661 _"), (8, "\u216b"), (4, "Ü"), (5, "the the"), (None, "der der " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "lang_pred": F.lit("x"), "score": F.lit("y")})
    model = langid.train(spark.createDataFrame([("the of and the", "en"), ("der die und", "de")], "text string, lang string"))
    got = {r.row.doc_id: r for r in langid.identify(docs, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 6, 7, 8)] == ["und"] * 6 and got[4].lang_pred in ("de", "en")
    assert got[5].lang_pred == "en" and got[None].lang_pred == "de"
    assert langid.identify(docs, model).select("row.*").columns == docs.columns
    none = langid.train(spark.createDataFrame([], "text string, lang string"))
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}
    one = langid.train(spark.createDataFrame([("abc", "xx")], "text string, lang string"))
    assert {r.lang_pred for r in langid.identify(docs, one).collect()} == {"und", "xx"}
    assert langid.identify(docs.limit(0), model).count() == 0


def test_folds_are_kept_apart(spark):
    docs = spark.createDataFrame([(i, "the of", "en") for i in range(50)], "doc_id long, text string, lang string")
    import zlib

    want = {i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert {r.doc_id for r in docs.where(langid.held_out()).collect()} == want


def test_equally_near_languages_and_repeated_rows(spark):
    learned = spark.createDataFrame([(t, lang) for lang in ("yy", "xx") for t in ("some words here", "more of these words")] * 3, "text string, lang string")
    model = langid.train(learned)
    docs = spark.createDataFrame([(1, "some of these words")] * 3 + [(2, "words here " * 50_000)], "doc_id long, text string")
    rows = langid.identify(docs, model).collect()
    assert len(rows) == 4 and {r.lang_pred for r in rows} == {"xx"} and all(r.ambiguous for r in rows)
