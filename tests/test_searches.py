"""Many searches at once, bounded searches, fords and settings, against heaps on small grids of many tiles."""

import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.functions import cellwise as fn
from ridgeline.operators import routing
from ridgeline.operators.searches import Ask, Searches
from ridgeline.sources.grid import Grid
from tests.test_connectivity import frame


def heap_search(cost, source, z=None, ford=None, px=30.0, decay=fn.DECAY, reverse=False):
    far = np.full(cost.shape, np.inf)
    heap = [(0.0, source)]
    ok = lambda r, c: 0 <= r < cost.shape[0] and 0 <= c < cost.shape[1]
    while heap:
        d, (r, c) = heapq.heappop(heap)
        if d >= far[r, c]:
            continue
        far[r, c] = d
        for dr in (-1, 0, 1):
            for dc in (-1, 0, 1):
                a, b = r + dr, c + dc
                if (dr, dc) == (0, 0) or not ok(a, b) or np.isnan(cost[a, b]):
                    continue
                beside = [(r + dr, c), (r, c + dc)] if dr and dc else []
                beside = [p for p in beside if ok(*p)]
                if any(np.isnan(cost[p]) for p in beside):
                    continue
                length = px * math.hypot(dr, dc)
                w = (cost[r, c] + cost[a, b]) / 2
                if z is None:
                    w *= length
                else:
                    grade = (z[a, b] - z[r, c]) * (-1 if reverse else 1) / length
                    w *= length / 1000 / (6.0 * math.exp(-decay * abs(grade + 0.05)))
                if ford is not None and beside:
                    corner, ends = max(ford[p] for p in beside), max(ford[r, c], ford[a, b])
                    if corner > ends and corner > 1:
                        w *= corner / ends
                heapq.heappush(heap, (d + w, (a, b)))
    return far


def scene(seed=7, shape=(20, 26), closed=0.25):
    rng = np.random.default_rng(seed)
    cost = rng.uniform(1, 5, shape)
    cost[rng.random(shape) < closed] = np.nan
    cost[0, 0] = cost[-1, -1] = cost[0, -1] = 1.0
    return cost, np.cumsum(rng.normal(0, 4, shape), axis=1)


def dense(rows, shape):
    out = np.full(shape, np.inf)
    for r in rows:
        if r.distance is not None:
            out[r.r, r.c] = r.distance
    return out


@pytest.mark.parametrize("size", [7, 64])
def test_all_searches_and_settings_in_one(spark, size):
    cost, z = scene()
    dear = np.where(np.isnan(cost), np.nan, 1 + 2 * (cost - 1))
    g = Grid(*cost.shape)
    cells = frame(spark, cost=cost, dear=dear, z=z)
    asks = [Ask((0, 0)), Ask((19, 25), reverse=True), Ask((0, 25), cost="dear"), Ask((0, 0), decay=1.3), Ask((int(np.argwhere(np.isnan(cost))[0][0]), int(np.argwhere(np.isnan(cost))[0][1])))]
    found = Searches(cells, g, asks, z="z", size=size)
    rows = found.cells().collect()
    assert len(rows) == len(asks) * cost.size
    wants = [heap_search(cost, (0, 0), z), heap_search(cost, (19, 25), z, reverse=True), heap_search(dear, (0, 25), z), heap_search(cost, (0, 0), z, decay=1.3), np.full(cost.shape, np.inf)]
    for k, want in enumerate(wants):
        assert np.allclose(dense([r for r in rows if r.search == k], cost.shape), want, rtol=1e-12)


def test_fords_are_paid_at_corners(spark):
    cost, _ = scene(3, closed=0.1)
    rng = np.random.default_rng(1)
    ford = np.where(rng.random(cost.shape) < 0.3, rng.choice([2.0, 8.0], cost.shape), 1.0)
    g, cells = Grid(*cost.shape), frame(spark, cost=cost * ford, ford=ford)
    want, without = heap_search(cost * ford, (0, 0), ford=ford), heap_search(cost * ford, (0, 0))
    got = dense(Searches(cells, g, [Ask((0, 0))], ford="ford", size=7).cells().collect(), cost.shape)
    assert np.allclose(got, want, rtol=1e-12) and (want > without + 1e-9).any()
    path = routing.route(cells, g, [(0, 0), (19, 25)], ford="ford", size=7)
    assert path.agg(F.max("distance")).first()[0] == pytest.approx(want[19, 25])


def test_bounded_search_is_exact_at_its_target_and_runs_less(spark):
    cost = np.random.default_rng(5).uniform(1, 1.5, (12, 80))
    g, cells = Grid(*cost.shape), frame(spark, cost=cost)
    whole, near = (Searches(cells, g, [Ask((6, 2), ((5, 14),))], size=6, bounded=b) for b in (False, True))
    far = heap_search(cost, (6, 2))
    assert whole.costs_of_targets()[0, 0] == pytest.approx(far[5, 14]) == near.costs_of_targets()[0, 0]
    tiles = 2 * 14
    assert whole.written >= tiles and near.written < whole.written / 2 and near.states.count() < tiles / 2
    # What is written follows the tiles that changed: no round of the whole grid.
    assert whole.written < tiles * whole.rounds / 2
    steps = sorted(near.paths().collect(), key=lambda r: r.seq)
    assert (steps[0].r, steps[0].c) == (6, 2) and (steps[-1].r, steps[-1].c) == (5, 14) and steps[-1].distance == pytest.approx(far[5, 14])


def test_states_are_merged_on_long_ways(spark, monkeypatch):
    cost = np.full((21, 21), np.nan)  # a winding corridor
    for k in range(0, 21, 2):
        cost[k, :] = 1.0
        if k < 20:
            cost[k + 1, 20 if k % 4 == 0 else 0] = 1.0
    g = Grid(21, 21)
    found = Searches(frame(spark, cost=cost), g, [Ask((0, 0), ((20, 20),)), Ask((20, 20), ((0, 0),))], size=5)
    want = heap_search(cost, (0, 0))[20, 20]
    assert found.rounds > 8 and found.costs_of_targets() == {(0, 0): pytest.approx(want), (1, 0): pytest.approx(want)}
    ways = found.paths().collect()
    assert len(ways) == 2 * int(np.isfinite(cost).sum() - 0)


def test_pairs_legs_and_corridor(spark):
    cost, z = scene(11, closed=0.15)
    g, cells = Grid(*cost.shape), frame(spark, cost=cost, z=z)
    points = [(0, 0), (0, 25), (19, 25)]
    far = [heap_search(cost, p, z) for p in points]
    pairs = routing.pair_costs(cells, g, points, z="z", size=7)
    assert pairs == {(0, 1): pytest.approx(far[0][points[1]]), (0, 2): pytest.approx(far[0][points[2]]), (1, 2): pytest.approx(far[1][points[2]])}
    wide = {(r.r, r.c): r.slack for r in routing.corridor(cells, g, list(zip(points, points[1:])), 0.1, z="z", size=7).collect()}
    back = [heap_search(cost, p, z, reverse=True) for p in points]
    slack = np.minimum(*((far[k] + back[k + 1]) / far[k][points[k + 1]] - 1 for k in (0, 1)))
    want = {tuple(map(int, p)): slack[tuple(p)] for p in np.argwhere(slack <= 0.1 + 1e-9)}
    assert wide == {p: pytest.approx(v, abs=1e-9) for p, v in want.items()}
    with pytest.raises(routing.NoWay):
        routing.route(cells.withColumn("cost", F.when(F.col("r") != 7, F.col("cost"))), g, points, size=7)
