"""Kernels over tiles and iterations against heaps, union-find and all-pairs distances."""

import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.operators import distance, fixpoint, hydrology, regions, routing
from ridgeline.operators.stencil import OFFSETS
from ridgeline.operators.searches import Ask, Searches
from ridgeline.sources.grid import Grid

STEPS = list(OFFSETS.values())


def frame(spark, **arrays):
    first = next(iter(arrays.values()))
    rows = [(r, c, *(None if a.dtype.kind == "f" and np.isnan(a[r, c]) else a[r, c].item() for a in arrays.values())) for r in range(first.shape[0]) for c in range(first.shape[1])]
    kinds = {"f": "double", "b": "boolean", "i": "long"}
    return spark.createDataFrame(rows, "r long, c long, " + ", ".join(f"{n} {kinds[a.dtype.kind]}" for n, a in arrays.items()))


def dense(found, name, shape):
    out = np.full(shape, np.nan)
    for r in found.select("r", "c", name).collect():
        if r[2] is not None:
            out[r.r, r.c] = r[2]
    return out


def heap_fill(z, rise=1e-3):
    h, w = z.shape
    out, seen, heap = np.full(z.shape, np.nan), np.isnan(z), []
    for r in range(h):
        for c in range(w):
            if not np.isnan(z[r, c]) and any(not (0 <= r + a < h and 0 <= c + b < w) or np.isnan(z[r + a, c + b]) for a, b in STEPS):
                heapq.heappush(heap, (z[r, c], r, c))
                seen[r, c] = True
    while heap:
        v, r, c = heapq.heappop(heap)
        out[r, c] = v
        for a, b in STEPS:
            if 0 <= r + a < h and 0 <= c + b < w and not seen[r + a, c + b]:
                seen[r + a, c + b] = True
                heapq.heappush(heap, (z[r + a, c + b] if z[r + a, c + b] > v else v + rise, r + a, c + b))
    return out


def dijkstra(cost, source, z=None, px=30.0):
    h, w = cost.shape
    far, heap = np.full(cost.shape, np.inf), [(0.0, source)]
    far[source] = 0
    bar = lambda r, c: 0 <= r < h and 0 <= c < w and np.isnan(cost[r, c])
    while heap:
        d, (r, c) = heapq.heappop(heap)
        if d > far[r, c]:
            continue
        for a, b in STEPS:
            y, x = r + a, c + b
            if not (0 <= y < h and 0 <= x < w) or np.isnan(cost[y, x]) or (a and b and (bar(y, c) or bar(r, x))):
                continue
            length = px * math.sqrt(2) if a and b else px
            step = (cost[r, c] + cost[y, x]) / 2 * (length if z is None else length / 1000 / (6 * math.exp(-3.5 * abs((z[y, x] - z[r, c]) / length + 0.05))))
            if d + step < far[y, x]:
                far[y, x] = d + step
                heapq.heappush(heap, (d + step, (y, x)))
    return far


@pytest.mark.parametrize("seed", [0, 1])
def test_fill_is_priority_flood(spark, seed):
    rng = np.random.default_rng(seed)
    z = rng.integers(0, 6, (23, 31)).astype(float) + (rng.random((23, 31)) if seed else 0)
    z[rng.random(z.shape) < 0.04] = np.nan
    got = dense(hydrology.fill(frame(spark, z=z), Grid(23, 31), size=8), "filled", z.shape)
    assert np.allclose(got, heap_fill(z), atol=1e-9, equal_nan=True)
    assert (got[~np.isnan(z)] >= z[~np.isnan(z)]).all()


def test_accumulation_on_a_ramp(spark):
    z = np.tile(-np.arange(12.0), (5, 1))
    found = hydrology.flow(frame(spark, filled=z), Grid(5, 12))
    up = dense(found, "upstream", z.shape)
    assert up.sum() >= 60 and (up[:, 0] == 1).all() and up.max() >= 12


def slow_upstream(z, d8):
    total = np.where(np.isnan(z), 0, 1)
    steps = list(OFFSETS.values())
    for r, c in sorted(zip(*np.nonzero(~np.isnan(z))), key=lambda p: -z[p]):
        if d8[r, c] >= 0:
            dr, dc = steps[int(d8[r, c])]
            total[r + dr, c + dc] += total[r, c]
    return np.where(np.isnan(z), np.nan, total)


def test_accumulation_across_tiles(spark):
    rng = np.random.default_rng(4)
    z = rng.random((26, 33)) + np.abs(np.arange(33) - 16) * 0.05
    z[rng.random(z.shape) < 0.05] = np.nan
    for size in (7, 512):
        found = hydrology.flow(frame(spark, filled=z), Grid(26, 33), size=size)
        assert np.array_equal(dense(found, "upstream", z.shape), slow_upstream(z, dense(found, "d8", z.shape)), equal_nan=True)


def test_settling_by_blocks(spark):
    """Blocks smaller than the tile give what one sweep over all gives."""
    rng = np.random.default_rng(9)
    z = rng.random((41, 37))
    water = np.full((43, 39), np.nan)
    water[1:-1, 1:-1] = np.inf
    water[1, 1:-1] = z[0]
    grown = np.full((43, 39), np.nan)
    grown[1:-1, 1:-1] = z
    whole = [hydrology._pour({"z": grown}, water.copy(), 1e-3)]
    fixpoint_block = fixpoint.settle.__defaults__
    try:
        fixpoint.settle.__defaults__ = (8,)
        whole.append(hydrology._pour({"z": grown}, water.copy(), 1e-3))
    finally:
        fixpoint.settle.__defaults__ = fixpoint_block
    assert np.array_equal(*whole, equal_nan=True)


@pytest.mark.parametrize("connectivity", [4, 8])
def test_regions_are_components(spark, connectivity):
    rng = np.random.default_rng(connectivity)
    mask = rng.random((25, 30)) < 0.55
    got = dense(regions.regions(frame(spark, m=mask), Grid(25, 30), "m", connectivity, size=7), "region", mask.shape)
    want, near = np.full(mask.shape, np.nan), regions.EIGHT if connectivity == 8 else regions.FOUR
    for r, c in zip(*np.nonzero(mask)):
        if np.isnan(want[r, c]):
            stack, want[r, c] = [(r, c)], r * 30 + c
            while stack:
                y, x = stack.pop()
                for a, b in near:
                    if 0 <= y + a < 25 and 0 <= x + b < 30 and mask[y + a, x + b] and np.isnan(want[y + a, x + b]):
                        want[y + a, x + b] = r * 30 + c
                        stack.append((y + a, x + b))
    assert np.array_equal(got, want, equal_nan=True)


def test_large_regions_outlines_and_numbers(spark):
    m = np.zeros((9, 9), bool)
    m[1:4, 1:4], m[2, 2], m[4, 4], m[7, 7] = True, False, True, True
    g = Grid(9, 9, dx=10.0, dy=-10.0)
    cells = frame(spark, m=m)
    big = regions.large_regions(cells, g, "m", 0.02, size=4)
    assert big.count() == 9 and regions.large_regions(cells, g, "m", 0.0, size=4).count() == 10
    assert {r.label for r in regions.numbered(regions.regions(cells, g, "m", 8, 4)).collect()} == {1, 2}
    out = {r.region: r for r in regions.outlines(regions.regions(cells, g, "m", 8, 4), g).collect()}
    ring = out[7 * 9 + 7].rings
    assert [[(p.r, p.c) for p in x] for x in ring] == [[(7, 7), (7, 8), (8, 8), (8, 7), (7, 7)]]
    area = lambda x: sum(a.c * b.r - b.c * a.r for a, b in zip(x, x[1:])) / 2
    assert sum(area(x) for x in out[10].rings) == 9 and out[10].area_m2 == 900.0  # the hole runs the other way


def test_flat_water(spark):
    rng = np.random.default_rng(3)
    z = 500 + rng.random((30, 40)) * 50 + 50
    z[:, :10], z[5:15, 20:32] = 0.0, 512.0
    z[25:27, 30:33] = 300.0
    got = regions.flat_water(frame(spark, z=z), Grid(30, 40), 4e4, size=16)
    kinds = {(r.r, r.c): r.water for r in got.collect()}
    assert set(kinds.values()) == {"sea", "lake"} and kinds[3, 3] == "sea" and kinds[10, 26] == "lake" and (26, 31) not in kinds


@pytest.mark.parametrize("timed", [False, True])
def test_distances_and_paths(spark, timed):
    rng = np.random.default_rng(7)
    cost = rng.uniform(1, 5, (20, 26))
    cost[rng.random(cost.shape) < 0.25] = np.nan
    cost[0, 0] = cost[19, 25] = 1.0
    z = np.cumsum(rng.normal(0, 4, cost.shape), axis=1) if timed else None
    g, cells = Grid(20, 26), frame(spark, cost=cost, z=z if timed else np.zeros(cost.shape))
    far = dijkstra(cost, (0, 0), z)
    found = routing.distances(cells, g, (0, 0), z="z" if timed else None, size=9)
    got = dense(found, "distance", cost.shape)
    assert np.allclose(np.where(np.isinf(far), np.nan, far), got, equal_nan=True, rtol=1e-12)
    reached = [tuple(map(int, x)) for x in np.argwhere(np.isfinite(far))]
    target = max(reached, key=lambda p: far[p])
    walked = sorted(Searches(cells, g, [Ask((0, 0), (target,))], z="z" if timed else None, size=9).paths().collect(), key=lambda r: r.seq)
    assert (walked[0].r, walked[0].c) == (0, 0) and (walked[-1].r, walked[-1].c) == target
    assert all(max(abs(a.r - b.r), abs(a.c - b.c)) == 1 and a.distance < b.distance for a, b in zip(walked, walked[1:]))
    back = dense(routing.distances(cells, g, target, z="z" if timed else None, reverse=True, size=9), "distance", cost.shape)
    assert math.isclose(back[0, 0], far[target], rel_tol=1e-9)
    wide = routing.corridor(cells, g, [((0, 0), target)], 0.05, z="z" if timed else None, size=9).collect()
    assert {(r.r, r.c) for r in walked} <= {(r.r, r.c) for r in wide} and min(r.slack for r in wide) == pytest.approx(0, abs=1e-9)
    graph = {(e.src, e.dst): e.w for e in routing.edges(cells, g, z="z" if timed else None).collect()}
    ids = [r.r * 26 + r.c for r in walked]
    assert sum(graph[a, b] for a, b in zip(ids, ids[1:])) == pytest.approx(far[target])


def test_route_order_and_errors(spark):
    cost = np.ones((12, 12))
    g, cells = Grid(12, 12), frame(spark, cost=cost)
    points = [(0, 0), (0, 10), (0, 4), (0, 7), (11, 11)]
    assert routing.waypoint_order(cells, g, points, size=16) == [0, 2, 3, 1, 4]
    legs = routing.route(cells, g, [(0, 0), (0, 5), (5, 5)], size=16).collect()
    assert len(legs) == 11 and len({(r.r, r.c) for r in legs}) == 11
    with pytest.raises(ValueError):
        routing.route(cells, g, [(0, 0), (0, 0)], size=16)
    cost[6, :] = np.nan
    with pytest.raises(ValueError):
        routing.route(frame(spark, cost=cost), g, [(0, 0), (11, 11)], size=16)


def test_best_order_is_optimal():
    import itertools

    rng = np.random.default_rng(4)
    for n in (3, 4, 6):
        costs = {(i, j): float(rng.random()) for i in range(n) for j in range(n) if i != j}
        way = routing.best_order(n, costs)
        total = lambda w: sum(costs[a, b] for a, b in zip(w, w[1:]))
        assert total(way) == min(total((0, *p, n - 1)) for p in itertools.permutations(range(1, n - 1)))


def test_connectivity(spark):
    s = np.full((8, 10), 10.0)
    s[:, 5] = 70.0
    g, cells = Grid(8, 10), frame(spark, slope=s)
    assert routing.connecting_slope(cells, g, [(0, 0), (0, 9)], size=16) == 70
    m = np.zeros((6, 6), bool)
    m[:3, :3] = m[3:, 3:] = True
    assert routing.only_by_corner(frame(spark, m=m), Grid(6, 6), [(0, 0), (5, 5)], "m", size=16)


def test_distance_and_nearest_against_all_pairs(spark):
    rng = np.random.default_rng(9)
    mask = rng.random((21, 17)) < 0.04
    g, at = Grid(21, 17, dx=20.0, dy=-30.0), np.argwhere(mask)
    r, c = np.indices(mask.shape)
    d = np.sqrt(((r[..., None] - at[:, 0]) * 30.0) ** 2 + ((c[..., None] - at[:, 1]) * 20.0) ** 2)
    cells = frame(spark, m=mask, v=(r * 17 + c).astype(float))
    found = distance.distance_to(cells, g, "m")
    assert np.allclose(dense(found, "distance", mask.shape), d.min(axis=2))
    for row in found.collect():
        assert mask[row.near_r, row.near_c]
    near = dense(distance.nearest_feature(cells, g, "m", "v", 70.0), "value", mask.shape)
    assert np.array_equal(np.isnan(near), d.min(axis=2) > 70)
    got = {(x.r, x.c) for x in distance.buffer(cells, g, "m", 70.0).collect()}
    assert got == {tuple(map(int, x)) for x in np.argwhere(d.min(axis=2) <= 70)}
    assert distance.distance_to(cells.withColumn("m", F.lit(False)), g, "m").where("distance is not null").count() == 0


def test_rasterize_by_cell_centre(spark):
    g = Grid(12, 12, x0=0.0, dx=1.0, y0=12.0, dy=-1.0)
    outer, hole = [(1, 1), (10, 1.2), (9, 10), (2, 9)], [(4, 4), (7, 4), (7, 7), (4, 7)]
    sides = [(1, *p, *q) for ring in (outer, hole) for p, q in zip(ring, [*ring[1:], ring[0]])]
    got = {(r.r, r.c) for r in distance.rasterize(spark.createDataFrame([tuple(map(float, s)) for s in sides], "fid double, x1 double, y1 double, x2 double, y2 double"), g).collect()}

    def inside(x, y):
        return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for ring in (outer, hole) for a, b in zip(ring, [*ring[1:], ring[0]])) % 2 == 1

    assert got == {(r, c) for r in range(12) for c in range(12) if inside(c + 0.5, 11.5 - r)}


def test_resample(spark):
    source = Grid(10, 12, x0=0.0, dx=10.0, y0=100.0, dy=-10.0)
    r, c = np.indices((10, 12))
    plane = frame(spark, z=(3.0 * c + 2.0 * r).astype(float))
    target = Grid(6, 6, x0=31.0, dx=7.0, y0=73.0, dy=-7.0)
    for method, tolerance in (("bilinear", 1e-9), ("cubic", 1e-9), ("nearest", 3.0)):
        got = distance.resample(plane, source, target, "z", method).collect()
        assert len(got) == 36
        for row in got:
            x, y = 31 + (row.c + 0.5) * 7, 73 - (row.r + 0.5) * 7
            assert abs(row.z - (3 * (x / 10 - 0.5) + 2 * ((100 - y) / 10 - 0.5))) <= tolerance


def test_one_tile_of_a_batch_at_a_time():
    import tracemalloc

    import pyarrow as pa

    from ridgeline.operators.fixpoint import one_by_one

    batch = pa.RecordBatch.from_pydict({"tr": list(range(32)), "state": [bytes([k]) * (1 << 20) for k in range(32)]})
    tracemalloc.start()
    seen = [(row["tr"], row["state"][0], len(row["state"])) for row in one_by_one(iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == [(k, k, 1 << 20) for k in range(32)] and peak < 4 << 20


def test_distance_windows_run_one_way(spark):
    """No frame to an unbounded end, which Spark goes through anew for each row of a column."""
    cells = frame(spark, m=np.eye(5, dtype=bool))
    plan = distance.distance_to(cells, Grid(5, 5), "m")._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan


@pytest.mark.parametrize("share", [0.3, 0.01, 0.0])
def test_nearest_of_whole_strips(share):
    rng = np.random.default_rng(3)
    for n in (1, 7, 150):
        height = np.where(rng.random((6, n)) < share, rng.integers(0, 9, (6, n)) ** 2 * 900.0, np.inf)
        every = height[:, None, :] + 900.0 * (np.arange(n)[:, None] - np.arange(n)) ** 2
        best, k = distance._nearest(height, 30.0)
        assert np.array_equal(best, every.min(axis=2))
        assert np.array_equal(k, np.where(np.isfinite(best), every.argmin(axis=2), -1))


def test_rounds_write_the_tiles_that_changed(spark, monkeypatch):
    """A round of filling writes no tile that it left as it was."""
    paths = []
    monkeypatch.setattr(fixpoint, "run_path", lambda s, name, made=fixpoint.run_path: paths.append(made(s, name)) or paths[-1])
    z = np.tile(100.0 - np.arange(24.0), (24, 1))
    z[3:6, 7:9] = 50.0  # a pit on the border of two of nine tiles
    got = dense(hydrology.fill(frame(spark, z=z), Grid(24, 24), size=8), "filled", z.shape)
    assert np.allclose(got, heap_fill(z), atol=1e-9)
    written = [spark.read.parquet(p).count() for p in paths]
    assert len(written) > 1 and written[0] == 9 and sum(written[1:]) < 9 * (len(written) - 1)


def test_scores_read_a_written_table(spark, monkeypatch):
    """Percentiles go over the cells several times, so water and stream strips are not found anew for each."""
    from ridgeline.plans import scene

    class Seen(Exception):
        pass

    def stop(cells, o):
        raise Seen(cells._jdf.queryExecution().optimizedPlan().toString())

    monkeypatch.setattr(scene.score, "score", stop)
    z = np.random.default_rng(2).random((12, 12)) * 9
    with pytest.raises(Seen) as seen:
        scene.surface(frame(spark, z=z), Grid(12, 12))
    assert "Join" not in str(seen.value) and "Window" not in str(seen.value)


def test_searches_find_states_without_shuffling_them(spark):
    """The newest state of a tile is picked by its round beside the data; nothing groups the states themselves."""
    cost = np.random.default_rng(5).random((20, 20)) + 1
    cost[3:17, 10] = np.nan
    found = Searches(frame(spark, cost=cost), Grid(20, 20), [Ask((0, 0)), Ask((19, 3))], size=7)
    plan = found.states._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by" not in plan and "LeftSemi" in plan and "edges" in found.states.columns
    far = found.cells().where("search = 1")
    want = dijkstra(cost, (19, 3))
    assert np.allclose(dense(far, "distance", cost.shape), np.where(np.isfinite(want), want, np.nan), equal_nan=True)
