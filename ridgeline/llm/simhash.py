"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``radius`` bits have a point in common that is within
half the radius of both.  So every distinct fingerprint emits all its variants within half
the radius, variants are shuffled, and whatever meets on a variant is verified and linked.

The variants of a fingerprint are far too many to write out (2081 for radius 4), but most of
them share a few prefixes.  What is shuffled is the fingerprint, once for each prefix that
any of its variants has; the task of a prefix makes those variants itself.  All that meet on
one variant are within the radius of the first of them, so links are stars, never all pairs,
and each task sends only a spanning star of what it linked: at most one row for each
fingerprint and prefix, however large the groups of copies.

Equal fingerprints are one node, so exact copies cost nothing.  Components come from
alternating large-star and small-star rounds over tables in the shared folder
(``ridgeline.operators.fixpoint.connected``).

Defined results: null text is empty; a text without words has fingerprint zero and is linked
like any other; rows that share a ``doc_id`` are one document; a component's id is its
smallest non-null ``doc_id``; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.tasks import slim
from ridgeline.operators.fixpoint import connected
from ridgeline.session import materialize

RADIUS = 4
SHINGLE = 4
SEED = 42
GROUP_TARGET = 600  # fingerprints for each prefix
GROUP_LIMIT = 100_000  # prefixes get longer until no group has more
MOST_PREFIX_BITS = 24
VARIANTS_AT_ONCE = 4_000_000

#: A-Z become a-z, all else stays.
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of the word shingles of a text, repeats included, unsigned."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(shingle, len(words))
    digest, counts, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(words) - width + 1
    for lo in range(0, n, 65_536):
        part = slice(lo, min(n, lo + 65_536))
        pairs = zip(starts[part].tolist(), ends[width - 1 :][part].tolist())
        counts += bits_set(np.array([digest(joined[s:e], seed) for s, e in pairs], np.uint64))
    return in_most(counts, n)


def bits_set(hashes: np.ndarray) -> np.ndarray:
    """How many of ``hashes`` have each of the 64 bits."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def in_most(counts: np.ndarray, n: int) -> int:
    """The fingerprint: bits that are set in over half of ``n`` hashes."""
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` of every row; the 64 bits are held as a signed long."""

    def hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            prints = np.array([fingerprint(t.as_py() or b"", shingle, seed) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fingerprint"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(slim(hash_texts), "doc_id long, fingerprint long")


def _flips(bits: list[int], most: int) -> list[list[int]]:
    """For each number of flips up to ``most``, the masks that flip so many of ``bits``."""
    return [[sum(1 << b for b in c) for c in itertools.combinations(bits, k)] for k in range(most + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _meet(prints: np.ndarray, left: np.ndarray, node: np.ndarray, bits: list[int], half: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, node) of fingerprints that share a variant.

    ``left``: flips that each fingerprint may still spend on ``bits``.  Where there would be
    too many variants at once, those with the next bit 0 and 1 are made one after the other.
    """
    masks = [np.array(m, np.uint64) for m in _flips(bits, half)]
    cost = np.cumsum([len(m) for m in masks])
    if cost[left].sum() > VARIANTS_AT_ONCE and bits:
        bit, parts = bits[0], []
        for value in (0, 1):
            agrees = (prints >> np.uint64(bit) & np.uint64(1)) == value
            rest = left - ~agrees
            keep = rest >= 0
            parts.append(_meet(prints[keep], rest[keep], node[keep], bits[1:], half))
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    inside = np.uint64(sum(1 << b for b in bits))
    made, owner, away = [], [], []
    for k, mask in enumerate(masks):
        pick = np.flatnonzero(left >= k)
        made.append(((prints[pick] & inside)[:, None] ^ mask[None, :]).ravel())
        owner.append(np.repeat(node[pick], len(mask)))
        away.append(np.repeat((half - left[pick] + k).astype(np.int8), len(mask)))
    made, owner, away = np.concatenate(made), np.concatenate(owner), np.concatenate(away)
    ordered = np.sort(made)
    shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    # Nearly all variants are met once: a small table of hashes leaves few to compare.
    mixed = lambda x: (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)
    table = np.zeros(1 << 20, bool)
    table[mixed(shared)] = True
    maybe = np.flatnonzero(table[mixed(made)])
    maybe = maybe[np.isin(made[maybe], shared)]
    maybe = maybe[np.lexsort((away[maybe], made[maybe]))]  # the nearest is the first on its variant
    value, who = made[maybe], owner[maybe]
    first = np.ones(len(value), bool)
    first[1:] = value[1:] != value[:-1]
    head = who[np.maximum.accumulate(np.where(first, np.arange(len(value)), 0))] if len(value) else who
    links = np.unique(np.stack([head, who])[:, head != who], axis=1)
    return links[0], links[1]


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node of each node's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        for side in (a, b):
            np.minimum.at(label, side, low)
            np.minimum.at(label, before[side], low)
        label = label[label]
        if (label == before).all():
            return label


def _local_stars(prefix_bits: list[int], radius: int):
    half = (radius + 1) // 2
    rest = [b for b in range(63, -1, -1) if b not in prefix_bits]

    def link(key: tuple, table: pa.Table) -> pa.Table:
        prints = np.unique(table.column("fingerprint").to_numpy()).view(np.uint64)
        own = sum(((prints >> np.uint64(b)) & np.uint64(1)) << np.uint64(i) for i, b in enumerate(prefix_bits)) if prefix_bits else np.zeros(len(prints), np.uint64)
        spent = np.bitwise_count(own ^ np.uint64(key[0].as_py())).astype(np.int64)
        a, b = _meet(prints, half - spent, np.arange(len(prints)), rest, half)
        near = np.bitwise_count(prints[a] ^ prints[b]) <= radius
        label = _labels(len(prints), a[near], b[near])
        tied = np.flatnonzero(label != np.arange(len(prints)))
        return pa.table({"a": prints[tied].view(np.int64), "b": prints[label[tied]].view(np.int64)})

    return link


def _bit(name: str, b: int):
    return F.shiftrightunsigned(F.col(name), b).bitwiseAND(F.lit(1))


def _prefix(name: str, bits: list[int]):
    return sum((F.shiftleft(_bit(name, b), i) for i, b in enumerate(bits)), F.lit(0).cast("long"))


def _choose_prefix(distinct: DataFrame) -> list[int]:
    """The most evenly set bits, so many that no group of equal prefixes is too large."""
    row = distinct.agg(F.count("*").alias("n"), *(F.sum(_bit("fingerprint", b)).alias(f"b{b}") for b in range(64))).first()
    if not row.n:
        return []
    even = sorted(range(64), key=lambda b: abs(2 * row[f"b{b}"] - row.n))
    k = max(2, (row.n // GROUP_TARGET).bit_length())
    while k < MOST_PREFIX_BITS:
        most = distinct.groupBy(_prefix("fingerprint", even[:k]).alias("p")).count().agg(F.max("count")).first()[0]
        if most <= GROUP_LIMIT:
            break
        k += 2
    return even[: min(k, MOST_PREFIX_BITS)]


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``a, b`` that join all distinct fingerprints within ``radius`` bits, directly or in steps.

    ``distinct`` has the column ``fingerprint`` (signed long), each value once.
    """
    bits = _choose_prefix(distinct)
    half = (radius + 1) // 2
    masks = [_signed(m) for level in _flips(bits, half) for m in level]
    sent = distinct.select("fingerprint", F.explode(F.array(*map(F.lit, masks)).cast("array<long>")).alias("mask"))
    near = sent.withColumn("near", F.col("fingerprint").bitwiseXOR(F.col("mask")))
    dealt = near.select(_prefix("near", bits).alias("prefix"), "fingerprint")
    return dealt.groupBy("prefix").applyInArrow(_local_stars(bits, radius), "a long, b long").distinct()


def components(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``prints`` (``doc_id, fingerprint``)."""
    prints = materialize(prints, "fingerprints")
    distinct = materialize(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = connected(links(distinct.select("fingerprint"), radius))
    member = distinct.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select("fingerprint", "first_id", F.coalesce("root", "fingerprint").alias("root"))
    named = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = member.join(named, "root").select("fingerprint", "component_id")
    return prints.join(classes, "fingerprint").select("doc_id", "fingerprint", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document."""
    return components(fingerprints(docs, shingle, SEED, id_col, text_col), radius)


def keep_one(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents without those that are not their component's first; null ids stay."""
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == F.col("__gone"), "left_anti")
