import re
import zlib
from collections import Counter

import numpy as np

from ridgeline.llm import queries, spelling
from tests.duck import same

SF = "/root/testdata/sf0.001"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows, noise=spelling.NOISE, compare=True):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall(spelling.LETTERS, text or ""):
            w = run.translate(str.maketrans(spelling.UPPER, spelling.LOWER))
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if noise and h % noise == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= spelling.LEAST_LETTERS and k >= spelling.LEAST_COUNT}
    forms, count = {}, {}
    for a in n:
        close = [b for b in n if abs(len(a) - len(b)) < 2 and near(a, b)]
        count[a] = len(close)
        best = min(close, key=lambda b: (-n[b], b), default=None)
        if best is not None and n[best] >= spelling.FORM_RATIO * n[a]:
            forms[a] = best
    out = []
    for a in n:
        root = a
        while root in forms:
            root = forms[root]
        out.append((a, n[a], count[a], forms.get(a), n.get(forms.get(a)), root))
    return sorted(out)


def got(frame):
    return sorted(tuple(r) for r in frame.select("word", "n", "n_near", "form", "form_n", "root").collect())


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.op11_spelling_variants(spark, SF)
    want = brute(rows)
    assert got(found) == want and len(want) > 100
    same(found, SF, spelling.ORACLE_SQL)


def test_ways_ties_anagrams_and_alphabet(spark):
    counts = {
        "letter": 5, "letters": 40, "lettersx": 200, "listen": 9, "silent": 9, "enlist": 9, "aaaaaa": 50, "aaaaaaa": 7, "aaaaaab": 7, "aaaaaac": 10,
        "größe1": 0, "größer": 6, "grösser": 90, "grÖßer": 40, "abcdef": 5, "abcdeg": 25, "abcdeh": 25, "bacdeh": 300, "short": 99,
    }
    text = " ".join(w for w, k in counts.items() for _ in range(k))
    rows = [(1, text), (2, None), (3, ""), (None, "123 -- \t"), (None, "Letter"), (None, "LETTER")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F_lit("x"), "n": F_lit("y"), "id": F_lit(None), "key": F_lit(1)})
    assert got(spelling.spelling_variants(docs)) == brute(rows, None)
    assert got(spelling.spelling_variants(docs, noise=1)) == brute(rows, 1)
    named = {r.word: r for r in spelling.spelling_variants(docs).collect()}
    assert named["letter"].root == "lettersx" and named["listen"].n_near == 0
    assert named["abcdef"].form == "abcdeg" and named["aaaaaa"].n_near == 3


def F_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def test_chain_of_many_forms(spark):
    words = [("a" * (6 + i), 5 * 5**i) for i in range(12)]
    frame = spark.createDataFrame(words, "word string, n long")
    assert {r.root for r in spelling.variants(frame).collect()} == {"a" * 17}


def test_very_long_words(spark):
    long = "".join(chr(97 + i * i % 26) for i in range(20_000))
    other = long[:7000] + long[7001:]
    rows = [(i, w) for w in (long, other) for i in range(5)] + [(i, other) for i in range(40)]
    found = {r.word: r for r in spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[long].form == other and found[long].n == 5 and found[other].root == other


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "repeat")] * 5
    assert got(spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"))) == [("repeat", 5, 0, None, None, "repeat")]
    assert got(spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string"))) == []


def test_keys_differ_by_values_of_letters():
    words = ["listen", "silent", "listens", "lésten"]
    key, rest, place, word = spelling.keys_of(words, np.arange(4))
    whole = {words[w]: int(k) for k, p, w in zip(key, place, word) if p == spelling.WHOLE}
    assert whole["listen"] == whole["silent"] and whole["listens"] - whole["listen"] == ord("s") ** spelling.POWER
    assert whole["lésten"] - whole["listen"] == ord("é") ** spelling.POWER - ord("i") ** spelling.POWER
    left = {(words[w], int(p)): int(r) for r, p, w in zip(rest, place, word)}
    assert left["listens", 6] == left["listen", spelling.WHOLE] and left["listen", 1] == left["lésten", 1] and left["listen", 0] != left["silent", 2]


def test_no_pairs_within_groups_of_anagrams(spark):
    import itertools

    words = [("".join(p), 5) for p in itertools.permutations("abcdefg")][:2000]
    frame = spark.createDataFrame(words, "word string, n long")
    assert all(r.n_near == 0 for r in spelling.variants(frame).collect())
