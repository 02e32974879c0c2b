"""Approximate nearest neighbours with a forest of random-projection trees.

The trees are fitted on a bounded sample (``SAMPLE`` vectors): each node splits at the median of
the projection on the widest of a few directions between random pairs.  Every vector is then
put into one leaf of each tree.  A query searches all trees through one priority queue of
nodes, nearest first by the distance to the splitting planes crossed, until the leaves it has
taken hold ``reach`` times as many rows as the table (trees overlap, so fewer distinct ones).
Rows of those leaves are ranked by the query exactly, in double precision, on the original vectors.

``reach`` is fitted with the trees: the least of ``REACHES`` that finds ``WANTED`` of the nearest vectors of
``PROBES`` sampled ones within the sample, by brute force.  On vectors with structure that is a few
hundredths; on vectors of random directions, which no tree separates, half of the table or more.

The index is never shuffled: queries go to its tasks in blocks of bounded size, each query with
a bit for every leaf that it takes.  A task multiplies the rows of each leaf with the queries that take it,
so its work follows what is taken; only where that, with the gathering of queries by leaf, is more than
the product of all rows and queries does it take this and leave out what is not taken (``cheaper_by_leaf``).
Products only tell which rows can be among the nearest, with room for their rounding.
Equal vectors are one point of the index that carries its smallest ids, since no more can be
among the nearest.  So neither a leaf, a vector nor a query block grows with the table.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part,
nor do null ids; vectors are only near others of their length, and each length has an index of its
own; of rows that share an id the one with the smallest vector, component by component, counts; fewer
candidates than ``k`` are all returned; ties go to the smaller id; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.session import materialize, run_path

TREES = 8
SAMPLE = 16_384
LEAF = 8  # sampled vectors in a leaf
DIRECTIONS = 8
REACHES = (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 1.0, 1.25, 1.5, 2.0, 8.0)
PROBES, WANTED = 48, 0.95
GATHER = 6  # products that gathering a query's vector for a leaf costs as much as
ROWS_AT_ONCE = 1 << 15  # of a task
QUERY_BLOCK = 8_192
AT_ONCE = 512  # queries in one matrix product


class Forest:
    """Complete binary trees; node i of a tree has the children 2 i + 1 and 2 i + 2."""

    def __init__(self, sample: np.ndarray, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.depth = max(0, int(np.log2(max(1, len(sample) / LEAF))))
        inner = (1 << self.depth) - 1
        self.normals = np.zeros((TREES, inner, sample.shape[1]))
        self.offsets = np.zeros((TREES, inner))
        for tree in range(TREES):
            members = {0: np.arange(len(sample))}
            for node in range(inner):
                at = members.pop(node)
                points = sample[at]
                a, b = rng.integers(0, max(1, len(at)), (2, DIRECTIONS))
                normal = points[a] - points[b] if len(at) else np.zeros((1, sample.shape[1]))
                size = np.linalg.norm(normal, axis=1)
                normal[size == 0] = rng.normal(size=((size == 0).sum(), sample.shape[1]))
                normal /= np.linalg.norm(normal, axis=1, keepdims=True)
                along = points @ normal.T
                best = int(along.std(axis=0).argmax()) if len(at) else 0
                self.normals[tree, node] = normal[best]
                self.offsets[tree, node] = np.median(along[:, best]) if len(at) else 0.0
                right = along[:, best] >= self.offsets[tree, node] if len(at) else np.zeros(0, bool)
                members[2 * node + 1], members[2 * node + 2] = at[~right], at[right]

    @property
    def leaves(self) -> int:
        return 1 << self.depth

    def place(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row in each tree."""
        out = np.zeros((len(x), TREES), np.int32)
        for tree in range(TREES):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                along = np.einsum("ij,ij->i", x, self.normals[tree, node])
                node = 2 * node + 1 + (along >= self.offsets[tree, node])
            out[:, tree] = node - (self.leaves - 1)
        return out

    def search(self, q: np.ndarray, sizes: np.ndarray, wanted: float) -> list[tuple[int, int]]:
        """Leaves (tree, leaf) in the order of one queue over all trees, until they hold ``wanted`` rows."""
        away = np.einsum("tnd,d->tn", self.normals, q) - self.offsets if self.depth else None
        queue, found, held, inner = [(0.0, tree, 0) for tree in range(TREES)], [], 0, self.leaves - 1
        while queue and held < wanted:
            distance, tree, node = heapq.heappop(queue)
            while node < inner:
                side = away[tree, node]
                near = 2 * node + 1 + (side >= 0)
                heapq.heappush(queue, ((distance * distance + side * side) ** 0.5, tree, 4 * node + 3 - near))
                node = near
            found.append((tree, int(node) - inner))
            held += sizes[tree, int(node) - inner]
        return found


def fitted_reach(forest: Forest, sample: np.ndarray, k: int) -> float:
    """The least of ``REACHES`` at which ``PROBES`` of the sample find ``WANTED`` of their k nearest in it."""
    n = len(sample)
    if n <= 2 * k:
        return REACHES[-1]
    places, trees = forest.place(sample), np.arange(TREES)
    sizes = np.stack([np.bincount(places[:, t], minlength=forest.leaves) for t in range(TREES)])
    least = []  # for each of the nearest of each probe
    for i in np.unique(np.linspace(0, n - 1, min(PROBES, n)).astype(int)):
        far = ((sample - sample[i]) ** 2).sum(axis=1)
        far[i] = np.inf
        near = np.argpartition(far, k)[:k]
        taken = np.array(forest.search(sample[i], sizes, REACHES[-1] * n))
        # How much of the table was taken when a leaf was.
        held = np.full(sizes.shape, np.inf)
        held[tuple(taken.T)] = (np.cumsum(sizes[tuple(taken.T)]) - sizes[tuple(taken.T)]) / n
        least.append(held[trees, places[near]].min(axis=1))
    least = np.concatenate(least)
    return next((r for r in REACHES if (least < r).mean() >= WANTED), REACHES[-1])


def _usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec")).where("vec_id is not null and vec is not null and size(vec) > 0")
    return rows.where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _top(rows: DataFrame, by: str, order: list[str], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark also cuts each task's groups to k before the shuffle."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(rank) <= k)


def nearest(vectors: DataFrame, is_query, k: int = 10, reach: float | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row with ``is_query`` (a condition on ``vec_id``) its k nearest.

    ``score`` is the Euclidean distance; without ``reach`` it is fitted.
    """
    spark = vectors.sparkSession
    usable = materialize(_usable(vectors, id_col, vec_col).groupBy("vec_id").agg(F.min("vec").alias("vec")), "vectors")
    lengths = [r[0] for r in usable.groupBy(F.size("vec")).count().collect()]  # a row for each length of a vector
    target = run_path(spark, "neighbours")
    for dim in lengths:
        _nearest_of_length(usable.where(F.size("vec") == dim) if len(lengths) > 1 else usable, dim, is_query, k, reach, target)
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = spark.read.schema("query_id long, vec_id long, score double").parquet(target)
    return _top(found, "query_id", ["score", "vec_id"], k).select("query_id", "rank", "vec_id", "score")


def _nearest_of_length(usable: DataFrame, dim: int, is_query, k: int, reach: float | None, target: str) -> None:
    """Append ``query_id, vec_id, score`` for all vectors of one length to ``target``."""
    spark = usable.sparkSession
    few = _top(usable, "vec", ["vec_id"], k + 1)
    points = materialize(few.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("point", F.col("ids")[0]), "points")
    n = points.count()
    sample = points.where(F.pmod(F.xxhash64("point"), F.lit(1 << 30)) < 1.2 * SAMPLE / n * (1 << 30)).orderBy(F.xxhash64("point"), "point").limit(SAMPLE).select("vec").toArrow()
    sampled = _matrix(sample.column(0), dim) if sample.num_rows else np.zeros((0, dim))
    forest = spark.sparkContext.broadcast(Forest(sampled))
    reach = fitted_reach(forest.value, sampled, k) if reach is None else reach
    kind = dict(points.dtypes)["vec"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                leaves = forest.value.place(_matrix(batch.column(1), dim))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(leaves), pa.list_(pa.int32()))], names=["point", "vec", "leaves"])

    index = materialize(points.select("point", "vec").mapInArrow(place, f"point long, vec {kind}, leaves array<int>"), "forest-index")
    sizes = np.zeros((TREES, forest.value.leaves), np.int64)
    for row in index.select(F.posexplode("leaves").alias("tree", "leaf")).groupBy("tree", "leaf").count().collect():  # at most the forest's leaves
        sizes[row.tree, row.leaf] = row["count"]
    shared = spark.sparkContext.broadcast(sizes)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = []
            for q in _matrix(batch.column(1), dim) if len(batch) else ():
                taken = np.zeros(sizes.shape, bool)
                taken[tuple(np.array(forest.value.search(q, shared.value, reach * n)).T)] = True
                bits.append(np.packbits(taken.ravel()).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bits, pa.binary())], names=["query", "vec", "taken"])

    asked = materialize(usable.where(is_query).join(points.select("vec", "point"), "vec").select(F.col("vec_id").alias("query_id"), F.col("point").alias("asked")), "queries")
    wanted = materialize(points.join(asked.select(F.col("asked").alias("point")).distinct(), "point", "left_semi").select(F.col("point").alias("query"), "vec").mapInArrow(take, f"query long, vec {kind}, taken binary"), "asked")
    blocks = max(1, -(-wanted.count() // QUERY_BLOCK))
    hits = run_path(spark, "hits")
    for block in range(blocks):
        part = wanted.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).toArrow().combine_chunks()  # a block of queries
        if part.num_rows:
            queries = spark.sparkContext.broadcast(_Queries(part, dim, sizes.size))
            each = index.mapInArrow(_ranking(queries, dim, k + 1), "query long, point long, score double")
            _top(each, "query", ["score", "point"], k + 1).drop("rank").write.mode("append").parquet(hits)
            queries.unpersist()
    if wanted.isEmpty():
        spark.createDataFrame([], "query_id long, vec_id long, score double").write.mode("append").parquet(target)
        return
    found = spark.read.schema("query long, point long, score double").parquet(hits)
    ids = found.join(points.select("point", "ids"), "point").select("query", "score", F.explode("ids").alias("vec_id"))
    few = _top(ids, "query", ["score", "vec_id"], k + 1).drop("rank")
    own = asked.join(few, asked.asked == few["query"]).where("query_id <> vec_id").select("query_id", "vec_id", "score")
    own.write.mode("append").parquet(target)


class _Queries:
    """A block of queries: ids, vectors, and for each leaf the queries that take it, as bits."""

    def __init__(self, rows: pa.Table, dim: int, leaves: int):
        self.ids = rows.column("query").to_numpy()
        self.vectors = _matrix(rows.column("vec"), dim)
        self.square = (self.vectors**2).sum(axis=1)
        taken = np.stack([np.unpackbits(np.frombuffer(b.as_py(), np.uint8), count=leaves) for b in rows.column("taken")])
        self.takers = np.packbits(taken.T, axis=1)  # leaf of all trees x queries
        self.n_takers = taken.sum(axis=0)


def cheaper_by_leaf(q: _Queries, leaves: np.ndarray) -> bool:
    """Whether products by leaf, with the gathering of queries for each leaf, are fewer than those of all rows and queries."""
    by_leaf = q.n_takers[leaves].sum() + GATHER * q.n_takers[np.unique(leaves)].sum()
    return by_leaf < len(leaves) * len(q.ids)


class _Best:
    """The k nearest points of each query so far."""

    def __init__(self, q: _Queries, k: int):
        self.q, self.k = q, k
        self.bound = np.full(len(q.ids), np.inf)  # the k-th least distance, squared
        self.held: tuple = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.float64))  # query, point, distance
        self.fresh: list[tuple] = []
        self.waiting = 0
        self.products = 0  # of a row and a query

    def offer(self, points: np.ndarray, x: np.ndarray, square: np.ndarray, rows: np.ndarray, who: np.ndarray, own: np.ndarray | None = None) -> None:
        """Rows beside queries ``who``, all of them or where ``own`` says so."""
        q, k = self.q, self.k
        some, asked = x[rows], q.vectors[who]
        self.products += len(rows) * len(who)
        about = square[rows][:, None] + q.square[who][None, :] - 2.0 * (some @ asked.T)
        slack = 1e-9 * (square[rows].max() + q.square[who].max())  # far more than the products' rounding
        if own is not None:
            about[~own] = np.inf
        limit = np.minimum(self.bound[who], np.partition(about, k - 1, axis=0)[k - 1] if len(rows) > k else np.inf) + slack
        row, col = np.nonzero(about <= limit[None, :])
        if own is not None:
            kept = own[row, col]
            row, col = row[kept], col[kept]
        if len(row):
            self.fresh.append((who[col], points[rows[row]], np.sqrt(((some[row] - asked[col]) ** 2).sum(axis=1))))
            self.waiting += len(row)
            if self.waiting > max(2 * k * len(q.ids), 1 << 18):
                self.settle()

    def settle(self) -> None:
        who, point, far = (np.concatenate([self.held[i], *(f[i] for f in self.fresh)]) for i in range(3))
        order = np.lexsort((point, far, who))
        who, point, far = who[order], point[order], far[order]
        new = np.ones(len(who), bool)  # a point may come once for each tree
        new[1:] = (who[1:] != who[:-1]) | (point[1:] != point[:-1])
        who, point, far = who[new], point[new], far[new]
        place = np.arange(len(who)) - np.searchsorted(who, who, "left")
        last = place == self.k - 1
        self.bound[who[last]] = far[last] ** 2
        self.held, self.fresh, self.waiting = (who[place < self.k], point[place < self.k], far[place < self.k]), [], 0


def rank_rows(best: _Best, points: np.ndarray, x: np.ndarray, leaves: np.ndarray) -> None:
    """Offer rows to the queries that take one of their leaves (``leaves``: row x tree, numbered over all trees)."""
    q, square = best.q, (x**2).sum(axis=1)
    if cheaper_by_leaf(q, leaves):
        for tree in range(leaves.shape[1]):
            order = np.argsort(leaves[:, tree], kind="stable")
            cuts = np.flatnonzero(np.diff(leaves[order, tree])) + 1
            for rows in np.split(order, cuts):
                who = np.flatnonzero(np.unpackbits(q.takers[leaves[rows[0], tree]], count=len(q.ids)))
                for lo in range(0, len(rows) if len(who) else 0, AT_ONCE):
                    best.offer(points, x, square, rows[lo : lo + AT_ONCE], who)
        return
    takers = np.bitwise_or.reduce(q.takers[leaves], axis=1)  # row x queries
    rows = np.arange(len(x))
    for lo in range(0, len(q.ids), AT_ONCE):
        who = np.arange(lo, min(lo + AT_ONCE, len(q.ids)))
        own = np.unpackbits(takers[:, lo // 8 : (lo + AT_ONCE) // 8], axis=1, count=len(who)).view(bool)
        best.offer(points, x, square, rows, who, own)


def _ranking(shared, dim: int, k: int):
    """The task's k nearest points of each query among those whose leaves it takes."""

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(shared.value, k)
        waiting, size, most = [], 0, 512  # few rows first, so that bounds are known for most
        trees = len(best.q.takers)

        def work() -> None:
            points, x, leaves = (np.concatenate([w[i] for w in waiting]) for i in range(3))
            for lo in range(0, len(points), ROWS_AT_ONCE):
                part = slice(lo, lo + ROWS_AT_ONCE)
                rank_rows(best, points[part], x[part], leaves[part])
            best.settle()

        for batch in batches:
            if len(batch):
                leaves = batch.column(2).flatten().to_numpy().reshape(len(batch), -1)
                waiting.append((batch.column(0).to_numpy(), _matrix(batch.column(1), dim), leaves + np.arange(leaves.shape[1]) * (trees // leaves.shape[1])))
                size += len(batch)
                if size >= most:
                    work()
                    waiting, size, most = [], 0, min(4 * most, ROWS_AT_ONCE)
        if waiting:
            work()
        yield pa.RecordBatch.from_arrays([pa.array(best.q.ids[best.held[0]]), pa.array(best.held[1]), pa.array(best.held[2])], names=["query", "point", "score"])

    return rank
