"""Benchmark decontamination with suffix arrays over the training text.

Each task turns its documents, a shard of bounded size at a time, into arrays of word ids and
sorts all their suffixes.  Every suffix of every benchmark item is then looked up by binary
search, which gives its longest verbatim match and where that is.  A suffix whose match is at
least a window long gets the whole range of equal windows, thus all their places.

Words are ids of the benchmark's own vocabulary; any other word ends a match, so it gets id 0
and no suffix that starts with it is kept.  Documents are never shuffled: the benchmark goes
to the tasks, in blocks of bounded size.  A pass over the documents takes at most
``BLOCKS_A_PASS`` of them, so neither the driver nor a task holds more of a large benchmark; the
passes' findings are put together by row.

Defined results: null or empty text has no words and is never contaminated; null or empty
items are ignored and a null ``item_id`` counts as the empty string; items that share an id are
one item; rows with equal ``doc_id`` are judged one by one; a very long text is one shard, read
whole; of equally long matches a document gives its first, and of items that have it the first by
id and start; all columns of the input are kept as they are, whatever their names.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ridgeline.llm.tasks import slim
from ridgeline.session import materialize

WINDOW = 10
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 1 << 20
BLOCKS_A_PASS = 8

#: A-Z become a-z; other ASCII characters than digits and letters become blanks; the rest stays.
WORD_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)

_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
FOUND = (
    "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>, "
    "longest struct<n_words:long,item:string,item_start:long,start:long>"
)
_LONGEST = pa.struct([("n_words", pa.int64()), ("item", pa.string()), ("item_start", pa.int64()), ("start", pa.int64())])


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_TABLE).split()


class Block:
    """A block of benchmark items: word ids, item bounds and the distinct windows."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.names = [name for name, _ in items]
        words = [w for _, text in items for w in text]
        self.ids = {w: i + 1 for i, w in enumerate(dict.fromkeys(words))}
        self.words = np.array([self.ids[w] for w in words], np.int64)
        size = np.array([len(text) for _, text in items], np.int64)
        last = np.cumsum(size)
        self.first = last - size
        self.item = np.repeat(np.arange(len(items)), size)
        self.end = np.repeat(last, size)
        # A window starts where a whole one fits, or at the start of an item that is shorter.
        place = np.arange(len(words))
        self.width = np.minimum(window, size)[self.item]
        self.starts = np.flatnonzero(place + self.width <= self.end)
        seen: dict[bytes, int] = {}
        self.window_items: list[set[str]] = []
        distinct, which = [], np.zeros(len(self.starts), np.int64)
        for k, s in enumerate(self.starts):
            key = self.words[s : s + self.width[s]].tobytes()
            if key not in seen:
                seen[key] = len(seen)
                distinct.append(s)
                self.window_items.append(set())
            which[k] = seen[key]
            self.window_items[which[k]].add(self.names[self.item[s]])
        self.windows = np.array(distinct, np.int64)
        self.depth = int(size.max(initial=1))
        # Suffixes in sorted order: a 0 behind each item ends its suffixes.
        bounded, spot = np.zeros(len(words) + len(items), np.int64), place + self.item
        bounded[spot] = self.words
        back = np.full(len(bounded), -1)
        back[spot] = place
        self.sorted_suffixes = back[suffix_array(bounded, self.depth)]
        self.firsts: dict[bytes, int] = {}

    def rank(self, suffix: int) -> tuple[str, int]:
        """Item id and start in it."""
        return self.names[self.item[suffix]], int(suffix - self.first[self.item[suffix]])

    def equal_range(self, suffix: int, width: int) -> tuple[int, int]:
        """The range of sorted suffixes that begin with the same ``width`` words."""
        key, bounds = self.words[suffix : suffix + width].tolist(), []
        for after in (False, True):
            lo, hi = 0, len(self.sorted_suffixes)
            while lo < hi:
                mid = (lo + hi) // 2
                s = self.sorted_suffixes[mid]
                other = self.words[s : min(s + width, self.end[s])].tolist()
                lo, hi = (mid + 1, hi) if other < key or after and other == key else (lo, mid)
            bounds.append(lo)
        return bounds[0], bounds[1]


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``words`` other than 0, sorted by their suffixes up to ``depth`` words.

    Prefix doubling: each round sorts groups of equal prefixes by the rank of what follows.
    Only groups of several suffixes whose words so far are all known are sorted again, since
    no match goes past a 0.
    """
    n = len(words)
    zero = np.where(words == 0, np.arange(n), n)
    run = np.minimum.accumulate(zero[::-1])[::-1] - np.arange(n)
    place = np.flatnonzero(words)
    small = words[place].astype(np.uint16) if words.max(initial=0) < 65_536 else words[place]
    order = place[np.argsort(small, kind="stable")]
    rank = np.zeros(n + 1, np.int64)
    if not len(order):
        return order
    new = np.ones(len(order), bool)
    new[1:] = words[order[1:]] != words[order[:-1]]
    slot = np.arange(len(order))
    rank[order] = np.maximum.accumulate(np.where(new, slot, 0)) + 1
    k = 1
    while k < depth:
        alone = new & np.append(new[1:], True)
        again = np.flatnonzero(~alone & (run[order] >= k))
        if not len(again):
            break
        p = order[again]
        key = rank[p] << 32 | rank[np.minimum(p + k, n)]
        turn = np.argsort(key, kind="stable")
        order[again], key = p[turn], key[turn]
        changed = np.ones(len(key), bool)
        changed[1:] = key[1:] != key[:-1]
        new[again] = changed
        rank[order[again]] = np.maximum.accumulate(np.where(changed, again, 0)) + 1
        k *= 2
    return order


def _compare(words: np.ndarray, at: np.ndarray, query: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length of the common prefix, and whether the text's suffix sorts before the query's."""
    common, less = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
    live = np.flatnonzero(start < end)
    while len(live):
        a = words[np.minimum(at[live] + common[live], len(words) - 1)]
        b = query[start[live] + common[live]]
        less[live] = a < b
        live = live[a == b]
        common[live] += 1
        live = live[start[live] + common[live] < end[live]]
        less[live] = False
    return common, less


def _lower_bound(words, order, lo, hi, query, start, end, after=False) -> np.ndarray:
    """Binary search of all queries at once: the first suffix that doesn't sort before the query
    (``after``: the first that sorts after all that have the query as a prefix)."""
    lo, hi = lo.copy(), hi.copy()
    while len(open_ := np.flatnonzero(lo < hi)):
        mid = (lo[open_] + hi[open_]) >> 1
        common, less = _compare(words, order[mid], query, start[open_], end[open_])
        if after:
            less |= common >= end[open_] - start[open_]
        lo[open_[less]] = mid[less] + 1
        hi[open_[~less]] = mid[~less]
    return lo


class Found:
    """What the suffixes of a block's items have in common with the text of a shard."""

    def __init__(self, block: Block, words: np.ndarray):
        """Look every suffix up in the text ``words``, whose last word must be 0."""
        self.block, self.text = block, words
        self.order = suffix_array(words, block.depth)
        first = words[self.order]
        self.lo, self.hi = np.searchsorted(first, block.words, "left"), np.searchsorted(first, block.words, "right")
        n = len(block.words)
        self.longest, self.at = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if len(self.order):
            self.at = _lower_bound(words, self.order, self.lo, self.hi, block.words, np.arange(n), block.end)
            for near in (self.at, self.at - 1):
                common, _ = _compare(words, self.order[np.clip(near, 0, len(self.order) - 1)], block.words, np.arange(n), block.end)
                self.longest = np.maximum(self.longest, common)

    def places(self, suffixes: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All places of the first ``width`` words of the suffixes: which suffix, and where in the text."""
        past = suffixes + width
        lo, hi = self.lo[suffixes], self.hi[suffixes]
        left = _lower_bound(self.text, self.order, lo, hi, self.block.words, suffixes, past)
        right = _lower_bound(self.text, self.order, lo, hi, self.block.words, suffixes, past, after=True)
        count = right - left
        slots = np.repeat(left - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return np.repeat(np.arange(len(suffixes)), count), self.order[slots]

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All places of all windows: which window, where, and its width."""
        s = self.block.windows
        hit = np.flatnonzero(self.longest[s] >= self.block.width[s])
        which, at = self.places(s[hit], self.block.width[s[hit]])
        return hit[which], at, self.block.width[s[hit]][which]

    def longest_by_document(self, document: np.ndarray, n: int) -> list[tuple[int, int, int] | None]:
        """For each of ``n`` documents its longest match: words, suffix and place in the text.

        A suffix of the text shares most with the item suffixes that sort beside it, so each
        place of the text needs two comparisons only, whatever the number of equal documents.
        """
        out: list[tuple[int, int, int] | None] = [None] * n
        if not len(self.order) or not self.longest.any():
            return out
        block, places = self.block, self.order
        suffixes = block.sorted_suffixes
        # Item suffixes among the text's: those that sort before a place of the text are counted.
        before = np.searchsorted(self.at[suffixes], np.arange(len(places)), "right")
        best, which = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        for k in (before - 1, before):
            s = suffixes[np.clip(k, 0, len(suffixes) - 1)]
            common, _ = _compare(self.text, places, block.words, s, block.end[s])
            better = common > best
            best[better], which[better] = common[better], s[better]
        owner = document[places]
        some = np.flatnonzero(best)
        some = some[np.lexsort((places[some], -best[some], owner[some]))]
        for i in some[np.unique(owner[some], return_index=True)[1]]:
            out[owner[i]] = (int(best[i]), self.first_equal(which[i], best[i]), int(places[i]))
        return out

    def first_equal(self, suffix: int, width: int) -> int:
        """Of item suffixes that begin with the same ``width`` words, the first by item and start."""
        key = self.block.words[suffix : suffix + width].tobytes()
        if key not in self.block.firsts:
            lo, hi = self.block.equal_range(suffix, width)
            self.block.firsts[key] = min((int(s) for s in self.block.sorted_suffixes[lo:hi]), key=self.block.rank)
        return self.block.firsts[key]


def _blocks(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> Iterator[list]:
    """The benchmark as lists of broadcast blocks, one list for each pass.

    Items reach the driver a partition at a time, and it holds one pass of them.
    """
    context = benchmark.sparkSession.sparkContext
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    held, size, out = [], 0, []
    for r in items.orderBy("item_id", "text").toLocalIterator():
        if words := words_of(r.text.encode()):
            held.append((r.item_id, words))
            size += len(r.text)
        if size >= BLOCK_BYTES:
            out.append(context.broadcast(Block(held, window)))
            held, size = [], 0
            if len(out) == BLOCKS_A_PASS:
                yield out
                out = []
    if held:
        out.append(context.broadcast(Block(held, window)))
    if out:
        yield out


class _Shard:
    """Texts as numbers of the shard's own distinct words; lists of words would take ten times the memory."""

    def __init__(self, texts: list[bytes]):
        number: dict[bytes, int] = {}
        lists = [np.array([number.setdefault(w, len(number)) for w in words_of(t)], np.int32) for t in texts]
        self.size = np.array([len(x) for x in lists], np.int64)
        self.first = np.cumsum(self.size + 1) - self.size - 1  # a 0 stands behind each document
        self.words, self.lists = list(number), lists

    @functools.cached_property
    def owner(self) -> np.ndarray:
        """The document of every place."""
        return self.document(np.arange(int(self.size.sum()) + len(self.lists) + 1))

    def ids(self, block: Block) -> np.ndarray:
        known = np.array([block.ids.get(w, 0) for w in self.words], np.int64)
        out = np.zeros(int(self.size.sum()) + len(self.lists) + 1, np.int64)
        for at, words in zip(self.first, self.lists):
            out[at : at + len(words)] = known[words]
        return out

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, place, "right") - 1


def _judge(shard: _Shard, blocks: list[Block]) -> dict:
    n = len(shard.lists)
    cover = np.zeros(int(shard.size.sum()) + n + 2, np.int64)
    items: list[set[str]] = [set() for _ in range(n)]
    best: list[dict | None] = [None] * n
    for block in blocks:
        found = Found(block, shard.ids(block))
        which, at, width = found.windows()
        np.add.at(cover, at, 1)
        np.add.at(cover, at + width, -1)
        for pair in np.unique(shard.document(at) * len(block.windows) + which):
            items[pair // len(block.windows)] |= block.window_items[pair % len(block.windows)]
        for d, match in enumerate(found.longest_by_document(shard.owner, n)):
            if match is not None:
                words, suffix, place = match
                item, start = block.rank(suffix)
                new = {"n_words": words, "item": item, "item_start": start, "start": int(place - shard.first[d])}
                if best[d] is None or (-words, new["start"], item, start) < (-best[d]["n_words"], best[d]["start"], best[d]["item"], best[d]["item_start"]):
                    best[d] = new
    hit = np.cumsum(cover) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    starts, ends = edge[::2], edge[1::2]
    owner = shard.document(starts)
    spans: list[list[dict]] = [[] for _ in range(n)]
    for d, s, e in zip(owner, starts, ends):
        spans[d].append({"start": int(s - shard.first[d]), "end": int(e - shard.first[d])})
    n_hit = np.bincount(owner, ends - starts, n).astype(np.int64)
    return {
        "n_words": pa.array(shard.size), "n_hit": pa.array(n_hit),
        "items": pa.array([sorted(x) for x in items], pa.list_(pa.string())), "spans": pa.array(spans, pa.list_(_SPAN)), "longest": pa.array(best, _LONGEST),
    }


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    held, size, start = [], 0, 0
    for i, t in enumerate(texts):
        held.append(t.as_py() or b"")
        size += len(held[-1])
        if size >= SHARD_BYTES:
            yield start, held
            held, size, start = [], 0, i + 1
    if held:
        yield start, held


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Every input row as the struct ``row``, with what the benchmark has in common with it.

    ``n_words``, ``n_hit`` (words inside any occurrence of a window), ``items`` (ids of items
    with a window in it, sorted), ``spans`` (hit words, as word positions), and ``longest``, the
    document's longest match with any item: its words, item, and start in the item and in the
    document (null if no word is the benchmark's).
    """
    from pyspark.sql.types import StructField, StructType

    at = docs.columns.index(text_col)
    found_fields = StructType.fromDDL(FOUND).fields

    def judged(rows: DataFrame, blocks: list, keep: StructField) -> DataFrame:
        """``rows``: what to hand on and the text."""

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [b.value for b in blocks]
            for batch in batches:
                kept = batch.column(0)
                texts = kept.field(at) if batch.num_columns == 1 else batch.column(1)
                for start, part in _slices(texts.cast(pa.large_binary())):
                    found = _judge(_Shard(part), held)
                    yield pa.RecordBatch.from_arrays([kept.slice(start, len(part)), *found.values()], names=[keep.name, *found])

        return rows.mapInArrow(slim(judge), StructType([keep, *found_fields]))

    passes = _blocks(benchmark, window, item_col, item_text_col)
    first, second = next(passes, []), next(passes, None)
    whole = docs.select(F.struct("*").alias("row"))
    if second is None:
        return judged(whole, first, StructField("row", docs.schema))
    # More than one pass: findings are written by each, and put together by the number of the row.
    numbered = materialize(whole.withColumn("__n", F.monotonically_increasing_id()), "numbered-documents")
    texts = numbered.select("__n", F.col(f"row.`{text_col}`").cast("string").alias("text"))
    parts = []
    for blocks in itertools.chain([first, second], passes):
        parts.append(materialize(judged(texts, blocks, StructField("__n", LongType())), "contamination"))
        for b in blocks:
            b.unpersist()
    return numbered.join(_together(parts), "__n").drop("__n")


def _together(parts: list[DataFrame]) -> DataFrame:
    """One row for each ``__n``, from one row of each pass."""
    each = functools.reduce(DataFrame.unionByName, parts)
    better = F.min(F.when(F.col("longest").isNotNull(), F.struct((-F.col("longest.n_words")).alias("n"), F.col("longest.start").alias("start"), F.col("longest.item").alias("item"), F.col("longest.item_start").alias("item_start"))))
    grouped = each.groupBy("__n").agg(F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"), better.alias("b"))
    # Sorted spans are joined where they touch.
    nothing = F.array().cast("array<struct<start:bigint,end:bigint>>")
    last = lambda done: F.element_at(done, -1)
    joined = lambda done, s: F.when((F.size(done) == 0) | (s["start"] > last(done)["end"]), F.concat(done, F.array(s))).otherwise(
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last(done)["start"].alias("start"), F.greatest(last(done)["end"], s["end"]).alias("end"))))
    )
    merged = grouped.withColumn("spans", F.aggregate("s", nothing, joined))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["start"])
    longest = F.when(F.col("b").isNotNull(), F.struct((-F.col("b.n")).alias("n_words"), F.col("b.item").alias("item"), F.col("b.item_start").alias("item_start"), F.col("b.start").alias("start")))
    return merged.select("__n", "n_words", n_hit.alias("n_hit"), "items", "spans", longest.alias("longest"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no window of any benchmark item, with their own columns only."""
    return contamination(docs, benchmark, **options).where("n_hit = 0").select("row.*")


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """For every suffix of every item, its longest verbatim match over all shards and all its places.

    Returns ``item_id, item_start, n_words, doc_id, doc_start``: one row for each place where the
    match is that long; suffixes that match nowhere are absent.  Each shard sends the places of
    its own longest matches, those of the longest of all are kept.
    """
    names = ["item_id", "item_start", "n_words", "doc_id", "doc_start"]
    types = [pa.string(), *[pa.int64()] * 4]
    schema = "item_id string, item_start long, n_words long, doc_id long, doc_start long"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def places(blocks: list) -> DataFrame:
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [b.value for b in blocks]
            for batch in batches:
                for start, texts in _slices(batch.column(1).cast(pa.large_binary())):
                    shard, ids = _Shard(texts), batch.column(0).slice(start, len(texts))
                    for block in held:
                        found = Found(block, shard.ids(block))
                        s = np.flatnonzero(found.longest)
                        which, at = found.places(s, found.longest[s])
                        d, s = shard.owner[at], s[which]
                        columns = [[block.names[i] for i in block.item[s]], s - block.first[block.item[s]], found.longest[s], ids.take(pa.array(d)), at - shard.first[d]]
                        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types)], names=names)

        return materialize(rows.mapInArrow(slim(find), schema), "matches")

    each = functools.reduce(DataFrame.unionByName, (places(blocks) for blocks in _blocks(benchmark, window, item_col, item_text_col)), docs.sparkSession.createDataFrame([], schema))
    best = each.groupBy("item_id", "item_start").agg(F.max("n_words").alias("n_words"))
    return each.join(best, ["item_id", "item_start", "n_words"], "left_semi").select(names).distinct()


#: DuckDB SQL over ``documents`` and ``benchmark`` for the query's contract columns.
ORACLE_SQL = f"""
WITH words AS (SELECT * FROM (SELECT 'd' AS kind, CAST(doc_id AS VARCHAR) AS id, text FROM documents UNION ALL SELECT 'b', CAST(item_id AS VARCHAR), text FROM benchmark)),
w AS MATERIALIZED (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM words),
items AS (SELECT id AS item_id, w, least(len(w), {WINDOW}) AS k FROM w WHERE kind = 'b' AND len(w) > 0),
win AS MATERIALIZED (SELECT DISTINCT item_id, k, w[i:i + k - 1] AS words FROM items, unnest(range(1, len(w) - k + 2)) AS t(i)),
sizes AS (SELECT DISTINCT k FROM win),
grams AS (SELECT id, i, k, w[i:i + k - 1] AS words FROM w, sizes, unnest(range(1, len(w) - k + 2)) AS t(i) WHERE kind = 'd' AND len(w) >= k),
hits AS MATERIALIZED (SELECT g.id, g.i, g.k, win.item_id FROM grams g JOIN win ON g.words = win.words AND g.k = win.k),
hit_words AS (SELECT id, count(DISTINCT j) AS n_hit FROM (SELECT id, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT id, i, k FROM hits)) GROUP BY id),
found AS (SELECT id, list_sort(list(DISTINCT item_id)) AS items FROM hits GROUP BY id)
SELECT CAST(w.id AS BIGINT) AS doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit_words USING (id) LEFT JOIN found USING (id) WHERE kind = 'd'
"""
