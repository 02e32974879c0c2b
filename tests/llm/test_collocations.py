import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ridgeline.llm import collocations, queries
from tests.duck import same

SF = "/root/testdata/sf0.001"


def brute(rows, least=collocations.LEAST_COUNT, best=collocations.BEST):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    candidates = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in candidates.items():
        if any(
            100 * b >= 80 * a
            for (other, q), b in candidates.items()
            if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        ):
            continue
        score, cut = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((" ".join(p), a, f[lang, p[:cut]], f[lang, p[cut:]], n[lang], score))
    result = []
    for lang, found in out.items():
        found.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        result += [(lang, i + 1, *x) for i, x in enumerate(found[:best])]
    return sorted(result)


def got(frame):
    return sorted(tuple(r) for r in frame.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_whole_table(spark):
    found = queries.op12_collocations(spark, SF)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text").collect()]
    want = brute(rows)
    assert got(found) == want and len(want) > 20
    same(found, SF, collocations.ORACLE_SQL)


ODD = [
    ("en", "Red apple pie. red apple pie; a a a a a a, A\ta"), ("en", "red apple pie\x1cx"), (None, None), (None, "x y\x0bz x y"), ("", "x y"), ("und", "x y z"), ("en", ""), ("de", "Äpfel ÄPFEL äpfel Äpfel"),
    ("en", "red apple"), ("en", "one two three four five one two three four five one two three four"), ("en", "𝔞 𝔟 𝔞 𝔟! ￿ ￿"), ("fr", ".,;:!?\n"),
]


def docs(spark, rows):
    frame = spark.createDataFrame(rows, "lang string, text string")
    return frame.withColumns({"phrase": F.lit("p"), "n": F.lit("n"), "a": F.lit(1), "rank": F.lit(None), "doc_id": F.lit(3)})


def test_odd_texts_at_several_limits(spark):
    for least, best in ((1, 2000), (2, 3), (3, 2000)):
        assert got(collocations.collocations(docs(spark, ODD), least_count=least, best=best)) == brute(ODD, least, best)


def test_a_full_table_of_bits_loses_nothing(spark):
    assert got(collocations.collocations(docs(spark, ODD), least_count=2, most_bits=64)) == brute(ODD, 2)


def test_repeated_rows_and_very_long_text(spark):
    rows = [("en", "same row here")] * 40 + [("en", "long text " * 30_000 + "end")]
    found = got(collocations.collocations(docs(spark, rows)))
    assert found == brute(rows)


def test_several_passes_in_a_task(spark, monkeypatch):
    rows = ODD * 7
    texts = docs(spark, rows).fillna("und", "lang").fillna("", "text")
    whole = collocations.Pass(2, collocations.Bits(None))
    for lang, text in rows:
        whole.add("und" if lang is None else lang, (text or "").encode())
    counted = whole.counts().to_pydict()
    bits = spark.sparkContext.broadcast(collocations.Bits(None))
    monkeypatch.setattr(collocations, "PASS_WORDS", 5)
    got = {(r.lang, r.phrase): r.n for r in collocations.phrase_counts(texts, 2, bits).collect()}
    assert got == dict(zip(zip(counted["lang"], counted["phrase"]), counted["n"]))


def test_only_phrases_with_frequent_parts_are_emitted():
    n_bits = 1 << 16
    table = np.zeros(n_bits, np.uint8)
    for part in (b"a b", b"b c", b"x y"):
        table[collocations.phrase_hash("en", part.split()) & (n_bits - 1)] = 1
    bits = collocations.Bits(np.packbits(table, bitorder="little").tobytes(), n_bits)
    now = collocations.Pass(3, bits)
    now.add("en", b"a b c. a b x y z b c")
    now.add("de", b"a b c")
    assert now.counts().to_pylist() == [{"lang": "en", "phrase": "a b c", "n": 1}]


def test_scores_beyond_64_bits(spark):
    big = 3 * 10**18
    found = [
        spark.createDataFrame([("en", w, n) for w, n in (("a", big + 1), ("b", big + 2))], "lang string, phrase string, n long"),
        spark.createDataFrame([("en", "a b", big)], "lang string, phrase string, n long"),
    ]
    row = collocations.scored(found).first()
    assert row.score == 2_000_000 * big // (2 * big + 3)
    nested = spark.createDataFrame([("en", "a b", 2, big, 0, 0, 1), ("en", "a b c", 3, big // 100 * 80, 0, 0, 1), ("en", "c d", 2, 5, 0, 0, 1)], "lang string, phrase string, k int, a long, l long, r long, score long")
    assert {r.phrase for r in collocations.without_parts(nested).collect()} == {"a b c", "c d"}


def test_empty_table(spark):
    assert got(collocations.collocations(spark.createDataFrame([], "lang string, text string"))) == []
