import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ridgeline.llm import simhash

SF = "/root/testdata/sf0.001"


def slow_print(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    k = min(4, len(words))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows, radius):
    """rows: (doc_id, unsigned print)"""
    prints = sorted({p for _, p in rows})
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                parent[find(a)] = find(b)
    least = {}
    for d, p in rows:
        if d is not None:
            least[find(p)] = min(least.get(find(p), d), d)
    return {(d, p, least.get(find(p))) for d, p in rows}


@given(st.text(alphabet="ab É\n\x0b\x1c,", max_size=60))
@settings(max_examples=60, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == slow_print(text)


def frame(spark, rows):
    return spark.createDataFrame([(d, simhash._signed(p)) for d, p in rows], "doc_id long, fingerprint long")


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_components_against_all_pairs(spark, radius, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP_TARGET", 20)
    rng = np.random.default_rng(radius)
    prints = []
    for _ in range(40):  # chains and clusters, some at exactly radius + 1
        p = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
        for _ in range(int(rng.integers(1, 8))):
            prints.append(p)
            for b in rng.choice(64, int(rng.integers(0, radius + 2)), replace=False):
                p ^= 1 << int(b)
    rows = [(int(i), p) for i, p in enumerate(rng.permutation(np.array(prints, object)))] + [(None, prints[0]), (7, prints[1]), (900, 0), (901, (1 << 64) - 1)]
    got = {(r.doc_id, r.fingerprint % (1 << 64), r.component_id) for r in simhash.components(frame(spark, rows), radius).collect()}
    assert got == slow_components(rows, radius)


def test_small_steps_give_the_same(monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 30).astype(np.uint64)
    prints = np.unique(np.concatenate([base, base ^ np.uint64(5), base ^ np.uint64(15 << 20), base ^ np.uint64(1)]))
    bits, n = list(range(63, -1, -1)), len(prints)
    whole = simhash._meet(prints, np.full(n, 2), np.arange(n), bits, 2)
    monkeypatch.setattr(simhash, "VARIANTS_AT_ONCE", 3000)
    parts = simhash._meet(prints, np.full(n, 2), np.arange(n), bits, 2)
    assert (simhash._labels(n, *whole) == simhash._labels(n, *parts)).all()


def test_long_chain(spark):
    edges = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {(r.node, r.root) for r in simhash.connected(edges).collect()}
    assert got == {(i, 0) for i in range(1, 61)}


def test_whole_table_and_filter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    found = simhash.near_duplicates(docs)
    rows = [(r.doc_id, slow_print(r.text)) for r in docs.collect()]
    got = {(r.doc_id, r.fingerprint % (1 << 64), r.component_id) for r in found.collect()}
    want = slow_components(rows, 4)
    assert got == want
    kept = {r.doc_id for r in simhash.keep_one(docs, found).collect()}
    assert kept == {c for _, _, c in want}


def test_odd_tables(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n", "x"), (4, "One two", "x"), (5, "one TWO", "x"), (None, "one two", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").withColumn("component_id", F.lit(1))
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (None, 4)}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_fingerprint_of_a_very_long_text():
    import numpy as np
    import xxhash

    words = [f"w{x}" for x in np.random.default_rng(1).integers(0, 1 << 40, 70_003)]
    counts, n = [0] * 64, len(words) - 3
    for i in range(n):
        h = xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    assert simhash.fingerprint(" ".join(words).encode()) == sum(1 << b for b in range(64) if 2 * counts[b] > n)
