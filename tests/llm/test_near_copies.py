"""The near-dedup stage against brute-force Jaccard similarity."""

import re
from collections import defaultdict

import corpus_pipeline
import numpy as np

SF = "/root/testdata/sf0.01"


def slow_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    k = min(5, len(words))
    return frozenset(" ".join(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset()


def slow_kept(rows):
    """rows: (doc_id, text); the ids that stay, and the pairs of distinct sets at 0.8 or more."""
    of = {d: slow_set(t) for d, t in rows}
    sets = list(dict.fromkeys(of.values()))
    having, parent, pairs = defaultdict(list), list(range(len(sets))), 0

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        common = defaultdict(int)
        for g in s:
            for j in having[g]:
                common[j] += 1
            having[g].append(i)
        for j, n in common.items():
            if 5 * n >= 4 * (len(s) + len(sets[j]) - n):
                pairs += 1
                parent[find(i)] = find(j)
    at, least = {s: i for i, s in enumerate(sets)}, {}
    for d, s in of.items():
        least[find(at[s])] = min(least.get(find(at[s]), d), d)
    return set(least.values()), pairs


def kept(spark, docs):
    return {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).select("doc_id").collect()}


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want, pairs = slow_kept([(r.doc_id, r.text) for r in docs.collect()])
    assert pairs > 0 and kept(spark, docs) == want


def test_copies_chains_and_groups(spark):
    rng = np.random.default_rng(5)
    texts = [None, "", "one two", "One  two", "one three"]
    word = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    for _ in range(40):  # chains of edits on both sides of the limit
        words = word(int(rng.integers(5, 150)))
        for _ in range(int(rng.integers(1, 6))):
            texts.append(" ".join(words))
            for k in rng.integers(0, len(words), max(1, len(words) // 60)):
                words[k] = "x" + words[k]
    base = word(200)
    for _ in range(120):  # one large group, in parts too far from its first
        other = list(base)
        for k in rng.integers(0, 200, int(rng.integers(1, 9))):
            other[k] = word(1)[0]
        texts.append(" ".join(other))
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts)]
    want, pairs = slow_kept(rows)
    assert pairs > 300 and kept(spark, spark.createDataFrame(rows, "doc_id long, text string")) == want
    assert kept(spark, spark.createDataFrame([], "doc_id long, text string")) == set()


def counted(spark, monkeypatch, rows, broadcast=1 << 20):
    """What stays, and how many pairs of texts were compared."""
    from ridgeline.llm import near_copies

    n, real = [], near_copies._similar
    with monkeypatch.context() as m:
        m.setattr(near_copies, "_similar", lambda pairs, *a: (n.append(pairs.count()), real(pairs, *a))[1])
        m.setattr(near_copies, "BROADCAST_BYTES", broadcast)
        return kept(spark, spark.createDataFrame(rows, "doc_id long, text string")), sum(n)


def test_texts_of_shared_paragraphs(spark, monkeypatch):
    """Texts of 14 of 24 paragraphs: none is a copy, each shares most shingles with others; and some copies among them."""
    rng = np.random.default_rng(8)
    pool = [" ".join(f"p{k}w{x}" for x in rng.integers(0, 1 << 30, 30)) for k in range(24)]
    for n in (60, 240):
        texts = [" ".join(pool[k] for k in rng.permutation(24)[:14]) for _ in range(n)]
        texts += [t.replace(" p", " q", 3) for t in texts[::20]]
        rows = list(enumerate(texts))
        got, compared = counted(spark, monkeypatch, rows)
        print("pairs compared", n, compared, "of", n * (n - 1) // 2)
        assert got == slow_kept(rows)[0] and compared < 0.15 * n * (n - 1) / 2


def test_a_head_of_many_with_a_text_too_large_to_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = [f"w{x}" for x in rng.integers(0, 1 << 40, 300)]
    texts = [" ".join(base)]
    for k in range(150):
        other = list(base)
        other[2 * k % 300] = f"z{k}"
        texts.append(" ".join(other))
    got, compared = counted(spark, monkeypatch, list(enumerate(texts)), 0)
    assert got == {0} and compared <= 50 * len(texts)


def test_odd_rows_and_columns(spark):
    from pyspark.sql import functions as F

    from ridgeline.llm.near_copies import near_copies

    long = "some words of a long text " * 20_000
    rows = [(None, "a b c d e f"), (1, "A B C D E F"), (1, "other words here"), (2, "a b c d e f"), (3, None), (4, " "), (5, long), (6, long + "end"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit("x") for n in ("node", "n", "keys", "row", "a", "piece")})
    found = sorted((tuple(r) for r in near_copies(docs).collect()), key=str)
    assert found == sorted([(None, 1), (1, 1), (1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 5), (None, 3)], key=str)


def test_simhash_alone_finds_nearly_equal_texts(spark, monkeypatch):
    """Without any fingerprint of minima, what SimHash links is still found, checked exactly and removed."""
    from ridgeline.llm import near_copies, simhash

    rng = np.random.default_rng(12)
    texts = []
    for _ in range(20):
        words = [f"w{x}" for x in rng.integers(0, 1 << 40, 600)]
        texts += [" ".join(words), " ".join([*words[:-1], "end"])]
    line = " ".join(f"l{k}" for k in range(8))
    texts += [" ".join([line] * 200 + [f"{side}{k}" for k in range(60)]) for side in "xy"]  # near by fingerprint, not by set
    rows = list(enumerate(texts))
    for text in (*texts[:3], "one two", ""):
        assert near_copies.simhash_of(near_copies.shingle_hashes(text.encode())) == simhash.fingerprint(text.encode(), near_copies.SHINGLE)
    prints = [simhash.fingerprint(t.encode(), near_copies.SHINGLE) for t in texts]
    near = [(prints[k] ^ prints[k + 1]).bit_count() <= simhash.RADIUS for k in range(0, len(texts), 2)]
    assert near[-1] and sum(near) > 12
    with monkeypatch.context() as m:
        m.setattr(near_copies, "shared_keys", lambda dealt: dealt.groupBy("key").count().where("false").withColumnRenamed("count", "members"))
        alone = kept(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert alone == set(range(len(texts))) - {2 * k + 1 for k in range(20) if near[k]}
    assert kept(spark, spark.createDataFrame(rows, "doc_id long, text string")) == slow_kept(rows)[0]
