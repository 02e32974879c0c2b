import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import decontaminate, queries
from tests.duck import same

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    grams = {}
    for name, text in items:
        w = words(text)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            grams.setdefault(tuple(w[i : i + k]), set()).add(str(name))
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, found = set(), set()
        for k in {len(g) for g in grams}:
            for i in range(len(w) - k + 1):
                if g := grams.get(tuple(w[i : i + k])):
                    hit |= set(range(i, i + k))
                    found |= g
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items, **options):
    d = docs if not isinstance(docs, list) else spark.createDataFrame(docs, "doc_id long, text string")
    b = items if not isinstance(items, list) else spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(d, b, **options).collect()
    return sorted(((r.row.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(sorted(r["items"])).encode()).hexdigest(), r.n_hit > 0) for r in found), key=str), found


def test_whole_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute(docs, items)
    assert run(spark, docs, items)[0] == want
    assert any(r[2] for r in want)
    got = queries.op1_decontamination(spark, SF)
    names = "doc_id n_words n_hit n_items items_sha256 contaminated".split()
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == want
    same(got, SF, queries.ORACLES["op1_decontamination"])


@pytest.mark.parametrize("shard", [40, 8 << 20])
def test_random_small_alphabet(spark, shard, monkeypatch):
    rng = np.random.default_rng(5)
    text = lambda n: " ".join(rng.choice(list("abcd"), n))
    docs = [(i, text(int(rng.integers(0, 60)))) for i in range(60)] + [(None, "a, B. c"), (61, None), (61, ""), (61, "a b c d é a"), (61, "a b c d é a")]
    items = [(i, text(int(rng.integers(0, 9)))) for i in range(15)] + [(3, "a b é"), (20, None), (21, "..."), (None, "d d d d d")]
    slow = brute(docs, [("" if i is None else i, t) for i, t in items], 4)
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", shard)
    assert run(spark, docs, items, window=4)[0] == slow
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 60)  # several blocks
    assert run(spark, docs, items, window=4)[0] == slow


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(1)
    for top in (2, 3, 5):
        w = np.append(rng.integers(0, top, 300), 0)
        order = decontaminate.suffix_array(w, 64)
        keys = []
        for p in order:
            run = w[p : p + 64].tolist()
            keys.append(run[: run.index(0) + 1] if 0 in run else run)
        assert sorted(order) == [i for i in range(301) if w[i]]
        assert keys == sorted(keys)


def test_longest_matches(spark):
    docs = [(1, "x a b c y"), (2, "b c d e"), (3, "q a b c d z")]
    items = [(7, "a b c d e")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in decontaminate.longest_matches(d, b).collect()}
    assert got == {("7", 0, 4, 3, 1), ("7", 1, 4, 2, 0), ("7", 2, 3, 2, 1), ("7", 3, 2, 2, 2), ("7", 4, 1, 2, 3)}
    twice = spark.createDataFrame([(1, "x a b"), (2, "a b a b"), (3, "a q")], "doc_id long, text string")
    got = {tuple(r) for r in decontaminate.longest_matches(twice, spark.createDataFrame([(7, "a b")], "item_id long, text string")).collect()}
    assert got == {("7", 0, 2, 1, 1), ("7", 0, 2, 2, 0), ("7", 0, 2, 2, 2), ("7", 1, 1, 1, 2), ("7", 1, 1, 2, 1), ("7", 1, 1, 2, 3)}


def test_removal_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", 5), (2, "z", None)], "doc_id long, text string, n_hit int").withColumns({"row": F.lit("r"), "items": F.lit(None)})
    items = spark.createDataFrame([(1, "B c")], "item_id long, text string")
    kept = decontaminate.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert [tuple(r) for r in kept.collect()] == [(2, "z", None, "r", None)]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs, none).count() == 2
    assert decontaminate.decontaminate(docs.limit(0), items).count() == 0


def test_spans_and_longest(spark):
    _, found = run(spark, [(1, "x a b c y c d e f a b")], [(1, "a b c d e f")], window=3)
    r = found[0]
    assert [(s.start, s.end) for s in r.spans] == [(1, 4), (5, 9)]
    assert tuple(r.longest) == (4, "1", 2, 5)


def slow_longest(text, items):
    best = None
    w = words(text)
    for name, t in items:
        v = words(t)
        for i in range(len(v)):
            for j in range(len(w)):
                k = 0
                while i + k < len(v) and j + k < len(w) and v[i + k] == w[j + k]:
                    k += 1
                if k and (best is None or (-k, j, name, i) < best):
                    best = (-k, j, name, i)
    return best and (-best[0], best[2], best[3], best[1])


@pytest.mark.parametrize("shard", [40, 8 << 20])
def test_every_document_gets_its_longest_match(spark, shard, monkeypatch):
    rng = np.random.default_rng(8)
    text = lambda n: " ".join(rng.choice(list("abcdxyz"), n))
    same_text = "q a b c d z z q"
    docs = [(i, text(int(rng.integers(0, 40)))) for i in range(40)] + [(100 + i, same_text) for i in range(5)] + [(200, "q"), (201, None)]
    items = [(str(i), "".join(text(int(rng.integers(1, 9))).translate(str.maketrans("xyz", "abc")))) for i in range(12)] + [("7", "a b c d")]
    want = {d: slow_longest(t, items) for d, t in docs}
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", shard)
    for block, a_pass in ((1 << 20, 8), (30, 2)):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        monkeypatch.setattr(decontaminate, "BLOCKS_A_PASS", a_pass)
        found = run(spark, docs, [(int(n), t) for n, t in items], window=3)[1]
        assert {r.row.doc_id: r.longest and tuple(r.longest) for r in found} == want


def test_many_passes_equal_one(spark, monkeypatch):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    key = lambda rows: {(r.row.doc_id, r.n_words, r.n_hit, tuple(r["items"]), tuple(map(tuple, r.spans)), r.longest and tuple(r.longest)) for r in rows}
    one = key(run(spark, docs, items)[1])
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(decontaminate, "BLOCKS_A_PASS", 2)
    assert key(run(spark, docs, items)[1]) == one


def test_very_long_text(spark):
    long = "w " * 300_000 + "a b c d e f g h i j k " + "v " * 1000
    docs, items = [(1, long), (2, "none")], [(1, "a b c d e f g h i j k")]
    assert run(spark, docs, items)[0] == brute(docs, items)
