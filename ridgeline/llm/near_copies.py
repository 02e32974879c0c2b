"""Near copies: documents that share four fifths or more of their distinct five-word shingles.

Sets whose 64-bit SimHash fingerprints link at four or fewer differing bits (``simhash.links``) are candidates.  That finds
texts that are nearly equal; at a similarity of 0.8 few fingerprints are so near.  For the rest
every distinct shingle set gets ``BANDS`` short fingerprints, each of ``ROWS`` minima of its
hashes.  Sets that meet on a fingerprint are candidates, and all that decides is the exact
Jaccard similarity of the two sets.  Two sets of similarity s meet with probability
1 - (1 - s ** ROWS) ** BANDS: all but one in ten thousand at 0.8, all but one in ten million at 0.85.
A fingerprint has so many minima that texts which share but a passage seldom meet.

First all that meet on a fingerprint are compared with one of them, the one that meets most
others overall, so that a large group of copies of a text costs a star around that text.  Where
a fingerprint is left with several components, its sets are compared across those, but for pairs
that cannot be similar: two sets of similarity s have one of the rarest 1 - s of their shingles in
common, whatever the order (prefix filtering).  Pairs are counted both ways, by fingerprint and by rare shingle,
before one is chosen.  So no pair that meets is left out, and texts that
share a long passage and differ in the rest cost no comparison at all.  Texts put together of shared paragraphs have no
rare shingles; of those, pairs of similarity 0.4 meet in 3 % of all cases, and at 0.5 in 18 %.

Only fingerprints and candidates' texts move.  A key or a head that a large share of all rows have is joined apart
(``skew.join_counted``); the texts of such heads are broadcast up to ``BROADCAST_BYTES``, and above that salted.

Defined results: null text is empty; texts without words are copies of each other; a text of
fewer words is one shingle; equal sets are one node; rows that share a ``doc_id`` are one
document; very long texts are compared whole; a component's id is its smallest non-null
``doc_id``; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.simhash import LOWER, RADIUS, bits_set, in_most, links
from ridgeline.llm.skew import SHARE, join_counted
from ridgeline.llm.tasks import slim
from ridgeline.operators.fixpoint import connected
from ridgeline.session import materialize

SHINGLE = 5
SIMILARITY = (4, 5)  # a ratio of whole numbers, so that the comparison is exact
BANDS = 50
ROWS = 8
SEED = 42
HASHES_AT_ONCE = 2_048
BROADCAST_BYTES = 32 << 20  # of the texts of hot heads
SALTS = 32
MET_OFTEN = 16  # a pair shares many rare shingles, most of them too late in one of its texts to be made

_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)
_FACTOR, _SHIFT = _DRAWN[0] | np.uint64(1), _DRAWN[1]


def shingle_hashes(text: bytes) -> np.ndarray:
    """Hashes of the word shingles of a text in their order, repeats included."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width, digest = min(SHINGLE, len(words)), xxhash.xxh64_intdigest
    pairs = zip(starts.tolist(), ends[width - 1 :].tolist())
    return np.fromiter((digest(joined[s:e], SEED) for s, e in pairs), np.uint64, len(words) - width + 1)


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text."""
    return np.unique(shingle_hashes(text))


def simhash_of(hashes: np.ndarray) -> int:
    """``simhash.fingerprint`` of a text with these hashes of shingles."""
    counts = sum((bits_set(hashes[lo : lo + 65_536]) for lo in range(0, len(hashes), 65_536)), np.zeros(64, np.int64))
    return in_most(counts, len(hashes))


def short_prints(hashes: np.ndarray) -> np.ndarray:
    """One signed long for each band; none of an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for lo in range(0, len(hashes), HASHES_AT_ONCE):
        np.minimum(least, (_FACTOR * hashes[None, lo : lo + HASHES_AT_ONCE] + _SHIFT).min(axis=1), out=least)
    return np.array([xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, node, n, keys, fingerprint, text`` of every row; equal sets have one node."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, prints = [], np.zeros(len(batch), np.uint64)
            for i, t in enumerate(batch.column(1).cast(pa.large_binary())):
                hashes = shingle_hashes(t.as_py() or b"")
                prints[i] = simhash_of(hashes)
                sets.append(np.unique(hashes))
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            keys = pa.array([short_prints(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node), pa.array([len(s) for s in sets], pa.int32()), keys, pa.array(prints.view(np.int64)), batch.column(1)], names=["doc_id", "node", "n", "keys", "fingerprint", "text"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(slim(cut), "doc_id long, node long, n int, keys array<long>, fingerprint long, text string")


def simhash_pairs(table: DataFrame, first: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs ``a, b`` of sets whose SimHash fingerprints are equal or linked within ``radius`` bits, as stars around ``a``.

    Of each set the fingerprint of its first row counts.  The links are those of ``simhash.links``, which joins all
    fingerprints so near, directly or in steps.
    """
    sets = table.where("n > 0").join(first.select("row"), "row", "left_semi").select("fingerprint", "node")
    prints = materialize(sets.groupBy("fingerprint").agg(F.min("node").alias("head"), F.count("*").alias("members")), "set-fingerprints")
    equal = join_counted(sets, prints, ["fingerprint"], "members", "inner").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    near = materialize(links(prints.select("fingerprint"), radius).withColumnRenamed("b", "fingerprint"), "fingerprint-links")
    hubs = materialize(near.groupBy("fingerprint").agg(F.count("*").alias("n")).join(prints.select("fingerprint", F.col("head").alias("hub")), "fingerprint"), "fingerprint-hubs")
    hung = join_counted(near, hubs, ["fingerprint"], "n", "inner").select(F.col("a").alias("fingerprint"), F.col("hub").alias("a"))
    return equal.union(hung.join(prints, "fingerprint").select("a", F.col("head").alias("b"))).distinct()


def _with_heads(pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """``pairs`` beside the text ``x`` of their head: texts of hot heads are broadcast if they are known to be small."""
    total = heads.agg(F.sum("n")).first()[0] or 0
    size = heads.where(F.col("n") * SHARE > total).agg(F.sum(F.octet_length("x"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return join_counted(pairs, heads, ["a"], how="inner")
    salted = heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).join(salted, ["a", "salt"]).drop("salt")


def _similar(pairs: DataFrame, table: DataFrame, first: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose sets are similar; ``a`` may be in very many."""
    part, whole = SIMILARITY

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple = (None, None)
        for batch in batches:
            a, x, y = batch.column("a").to_pylist(), batch.column("x").cast(pa.large_binary()), batch.column("y").cast(pa.large_binary())
            keep = []
            for i, node in enumerate(a):
                if known[0] != node:
                    known = (node, shingle_set(x[i].as_py()))
                other = shingle_set(y[i].as_py())
                shared = len(np.intersect1d(known[1], other, assume_unique=True))
                keep.append(shared * whole >= part * (len(known[1]) + len(other) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    rows = materialize(first.join(wanted, "node", "left_semi").select("row"), "compared")
    texts = materialize(table.join(rows, "row", "left_semi").select("node", "text"), "compared-texts")
    heads = materialize(pairs.groupBy("a").agg(F.count("*").alias("n")).join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a"), "heads")
    both = _with_heads(pairs, heads).join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(slim(compare), "a long, b long")


def _met(rows: DataFrame, key: str) -> int:
    """Pairs of ``rows`` (``key, root``) that share a key and not their root."""
    of_root = rows.groupBy(key, "root").agg(F.count("*").cast("double").alias("m"))
    of_key = of_root.groupBy(key).agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("own"))
    return int(of_key.agg(F.sum(F.col("m") * F.col("m") - F.col("own"))).first()[0] or 0) // 2


def _across(met: DataFrame, stars: DataFrame, table: DataFrame, first: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of sets from different components that may be similar.

    ``met`` has ``key, node, n, root`` for the fingerprints that several components have.  The pairs are those that
    share a fingerprint, or those whose rare shingles meet; both hold all similar ones that meet.  Shingles are
    taken, whose places leave out most pairs, but where their pairs are ``MET_OFTEN`` times as many.
    """
    open_ = materialize(met.select("node", "n", "root").distinct(), "open-sets")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(3).cast(pa.large_binary())):
                grams = shingle_set(text.as_py()).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(grams), batch.column(k)[i].as_py(), t)) for k, t in enumerate((np.int64, np.int32, np.int64))), pa.array(grams)], names=["node", "n", "root", "gram"])

    rows = first.join(open_, "node").select("row", "n", "root")
    texts = table.join(rows, "row").select("node", rows["n"], "root", "text")
    grams = materialize(texts.mapInArrow(slim(cut), "node long, n int, root long, gram long"), "open-shingles")
    common = materialize(grams.groupBy("gram").agg(F.count("*").alias("holders")).where("holders > 1"), "common-shingles")
    held = join_counted(grams, common, ["gram"], "holders", "inner")
    part, whole = SIMILARITY
    # Of the prefix, those that no other set has come first; what is left of it is drawn from the common ones.
    prefix = F.col("n") - F.ceil(F.col("n") * part / whole) + 1
    by_node = Window.partitionBy("node")
    ranked = held.withColumns({"place": F.row_number().over(by_node.orderBy("holders", "gram")), "common": F.count("*").over(by_node)})
    ranked = ranked.withColumn("place", F.col("place") + F.col("n") - F.col("common"))
    rare = ranked.where(F.col("place") <= prefix).select("gram", "node", "n", "root", "place")
    mixed = rare.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("gram")
    rare = materialize(rare.join(mixed, "gram", "left_semi"), "rare-shingles")
    by_print = MET_OFTEN * _met(met, "key") < _met(rare, "gram")
    rare, key = (met.withColumn("place", F.lit(1)), "key") if by_print else (rare, "gram")
    left, right = (rare.select(key, *(F.col(c).alias(c + side) for c in ("node", "n", "root", "place"))) for side in ("_a", "_b"))
    # From the first shingle in common on, both sets must hold as many as they have to share.
    shared = F.ceil((F.col("n_a") + F.col("n_b")) * part / (part + whole))
    early = (F.col("n_a") - F.col("place_a") + 1 >= shared) & (F.col("n_b") - F.col("place_b") + 1 >= shared)
    sized = (F.col("n_a") * whole >= F.col("n_b") * part) & (F.col("n_b") * whole >= F.col("n_a") * part)
    pairs = left.join(right, key).where((F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & sized & early)
    pairs = pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    compared = stars.union(stars.select("b", "a"))
    return pairs.join(compared, ["a", "b"], "left_anti")


def shared_keys(dealt: DataFrame) -> DataFrame:
    """``key, members`` of the fingerprints of minima that several sets have."""
    return dealt.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, component_id`` of every document; ``simhash_pairs`` and those by minima are compared exactly."""
    table = materialize(sketches(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "sketches")
    first = materialize(table.groupBy("node").agg(F.min("row").alias("row"), F.min("doc_id").alias("first_id")), "distinct-sets")
    by_print = materialize(simhash_pairs(table, first), "simhash-pairs")

    dealt = table.join(first.select("row"), "row", "left_semi").select("node", "n", F.explode("keys").alias("key"))
    shared = materialize(shared_keys(dealt), "shared-prints")
    meet = materialize(join_counted(dealt, shared, ["key"], "members", "inner").select("key", "node", "n", "members"), "meetings")
    meets = meet.groupBy("node").agg(F.sum("members").alias("meets"))
    heads = meet.join(meets, "node").groupBy("key").agg(F.max(F.struct("meets", "node")).alias("head"), F.max("members").alias("members"))
    heads = materialize(heads.select("key", "members", F.col("head.node").alias("head")), "heads-of-prints")
    stars = join_counted(meet.drop("members"), heads, ["key"], "members", "inner").where("node <> head")
    # A pair that SimHash has too is compared once, from the side of the head.
    stars = materialize(stars.select(F.col("head").alias("a"), F.col("node").alias("b")).distinct(), "minima-stars")
    stars = materialize(by_print.join(stars.union(stars.select("b", "a")), ["a", "b"], "left_anti").union(stars), "stars")
    found = materialize(_similar(stars, table, first), "star-links")
    roots = materialize(connected(found), "star-roots")

    root = F.coalesce("root", "node").alias("root")
    rooted = meet.join(roots, "node", "left").select("key", "node", "n", root)
    apart = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    met = materialize(rooted.join(apart, "key", "left_semi").select("key", "node", "n", "root"), "open-meetings")
    across = materialize(_across(met, stars, table, first), "across")
    if across.limit(1).count():
        more = materialize(_similar(across, table, first), "across-links")
        if more.limit(1).count():
            roots = connected(found.union(more))

    member = first.join(roots, "node", "left").select("node", "first_id", root)
    named = member.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members"))
    classes = member.join(named.drop("members"), "root").select("node", "component_id")
    copies = table.groupBy("node").agg(F.count("*").alias("copies"))
    return join_counted(table.select("doc_id", "node"), materialize(classes.join(copies, "node"), "classes"), ["node"], "copies", "inner").select("doc_id", "component_id")
