import numpy as np
from pyspark.sql import functions as F

from ridgeline.llm import ann, queries

SF = "/root/testdata/sf0.1"


def brute(rows, is_query, k=10):
    rows = sorted(set((i, tuple(v)) for i, v in rows))
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for i in np.flatnonzero([is_query(j) for j in ids]):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def result(frame):
    out = {}
    for r in frame.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_on_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, got = brute(rows, lambda i: i % 100 == 0), result(queries.op10_nearest(spark, SF))
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want])
    print("recall", recall)
    assert recall >= 0.9
    near = {(q, i): s for q, v in want.items() for i, s in v}
    assert all(abs(near[q, i] - s) < 1e-12 for q, v in got.items() for i, s in v if (q, i) in near)


def test_copies_ties_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "AT_ONCE", 8)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 3)
    monkeypatch.setattr(ann, "LEAF", 4)
    rng = np.random.default_rng(2)
    grid = [tuple(float(x) for x in v) for v in rng.integers(0, 3, (120, 3)) + 1]
    rows = [(i, list(v)) for i, v in enumerate(grid)] + [(200 + i, [1.0, 1.0, 1.0]) for i in range(60)] + [(5, list(grid[5]))]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = result(ann.nearest(vectors, F.col("vec_id") % 20 == 0, reach=1000.0))  # all leaves: exact
    assert got == brute(rows, lambda i: i % 20 == 0)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 1.0]), (6, [1.0, 2.0]), (7, [1.0]), (8, []), (9, [4.0, 6.0]), (20, [5.0]), (21, [2.0] * 3), (9, [4.0, 7.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"vec": F.lit(1), "score": F.lit("s")})
    every = F.col("vec_id") >= 0
    assert result(ann.nearest(vectors, every)) == {0: [(6, 0.0), (9, 5.0)], 6: [(0, 0.0), (9, 5.0)], 9: [(0, 5.0), (6, 5.0)], 7: [(20, 4.0)], 20: [(7, 4.0)]}
    assert ann.nearest(vectors.limit(0), every).count() == 0
    assert ann.nearest(vectors.where("vec_id = 0"), every).count() == 0


def test_recall_grows_not_worse_with_the_table(spark):
    """At two sizes of a table without clusters, the hardest kind."""
    for n in (1500, 6000):
        x = np.random.default_rng(n).normal(size=(n, 24))
        rows = [(i, v.tolist()) for i, v in enumerate(x)]
        want = brute(rows, lambda i: i % 100 == 0)
        got = result(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0))
        assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]) >= 0.9


def clustered(n, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(60, 24))
    return centres[rng.integers(0, 60, n)] + rng.normal(size=(n, 24)) * 0.05


def placed(x, reach, monkeypatch):
    """Products of all rows and one query in ten, at a reach, and the result."""
    forest = ann.Forest(x)
    leaves = forest.place(x) + np.arange(ann.TREES) * forest.leaves
    sizes = np.stack([np.bincount(c, minlength=forest.leaves) for c in forest.place(x).T])
    who = np.arange(0, len(x), 10)
    taken = np.zeros((len(who), *sizes.shape), bool)
    for i, q in enumerate(who):
        taken[(i, *np.array(forest.search(x[q], sizes, reach * len(x))).T)] = True
    kind = ann.pa.list_(ann.pa.float64())
    rows = ann.pa.table({"query": who, "vec": ann.pa.array([v.tolist() for v in x[who]], kind), "taken": [np.packbits(t.ravel()).tobytes() for t in taken]})
    best = ann._Best(ann._Queries(rows.combine_chunks(), x.shape[1], sizes.size), 11)
    for lo in range(0, len(x), 500):
        part = slice(lo, lo + 500)
        ann.rank_rows(best, np.arange(len(x))[part], x[part], leaves[part])
    best.settle()
    own = taken.reshape(len(who), -1)[:, leaves].any(axis=2)
    far = np.where(own, ((x[who][:, None] - x[None]) ** 2).sum(axis=2), np.inf)
    want = [sorted((f, j) for j, f in enumerate(row) if f < np.inf)[:11] for row in far]
    got = {i: [] for i in range(len(who))}
    for i, point, distance in zip(*best.held):
        got[i].append((distance, point))
    assert all(len(g) == len(w) and np.allclose([d for d, _ in g], [f**0.5 for f, _ in w]) for g, w in zip(got.values(), want))
    return best.products


def test_products_follow_the_reach(monkeypatch):
    """What is multiplied falls with the reach, at two sizes, and each way gives what its leaves hold."""
    for n in (2000, 6000):
        x = clustered(n)
        few, some, all_ = (placed(x, reach, monkeypatch) for reach in (0.05, 0.2, 8.0))
        print("products", n, few, some, all_, "all pairs", n * n // 10)
        assert few < 0.15 * n * n / 10 and few < some < all_ == n * n // 10


def test_the_reach_is_fitted_to_the_data():
    for x, low, high in ((clustered(3000), 0.0, 0.2), (np.random.default_rng(3).normal(size=(3000, 64)), 0.4, 2.0)):
        assert low < ann.fitted_reach(ann.Forest(x), x, 10) <= high
    assert ann.fitted_reach(ann.Forest(np.ones((5, 2))), np.ones((5, 2)), 10) == ann.REACHES[-1]


def test_clustered_vectors(spark):
    x = clustered(4000, 2)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want = brute(rows, lambda i: i % 100 == 0)
    got = result(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0))
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]) >= 0.9
