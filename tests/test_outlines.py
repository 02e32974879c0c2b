"""Outlines of regions over many tiles, against walking each region's sides in order."""

import numpy as np
import pytest

from ridgeline.operators import regions
from ridgeline.plans import network
from ridgeline.sources.grid import Grid
from tests.duck import same
from tests.test_connectivity import frame

SF = "/root/testdata/sf0.001"


def walked(cells):
    """cells: {(r, c): region} -> {region: rings}; each ring from its first corner on, where corners touch to the left."""
    after = {}
    for (r, c), region in cells.items():
        for (dr, dc), (a, b) in {(-1, 0): ((0, 0), (0, 1)), (0, 1): ((0, 1), (1, 1)), (1, 0): ((1, 1), (1, 0)), (0, -1): ((1, 0), (0, 0))}.items():
            if cells.get((r + dr, c + dc)) != region:
                after.setdefault(region, {}).setdefault((r + a[0], c + a[1]), []).append((r + b[0], c + b[1]))
    out = {}
    for region, leaving in after.items():
        todo, rings = {(p, q) for p, qs in leaving.items() for q in qs}, []
        while todo:
            side = min(todo)
            ring = []
            while side in todo:
                todo.discard(side)
                ring.append(side)
                (p, q) = side
                came = (q[0] - p[0], q[1] - p[1])
                side = (q, min(leaving[q], key=lambda t: came[1] * (t[0] - q[0]) - came[0] * (t[1] - q[1])))
            turns = [p for k, (p, q) in enumerate(ring) if (q[0] - p[0], q[1] - p[1]) != (p[0] - ring[k - 1][0][0], p[1] - ring[k - 1][0][1])]
            rings.append([*turns, turns[0]])
        out[region] = rings
    return out


def spiral(n):
    m, r, c, d = np.zeros((n, n), bool), 0, -1, 0
    for length in (n, *(x for k in range(n - 1, 0, -2) for x in (k, k))):
        for _ in range(length):
            r, c = r + (0, 1, 0, -1)[d], c + (1, 0, -1, 0)[d]
            m[r, c] = True
        d = (d + 1) % 4
    return m


@pytest.mark.parametrize("size", [5, 64])
@pytest.mark.parametrize("kind", ["random", "dense", "spiral"])
def test_outlines(spark, size, kind):
    rng = np.random.default_rng(6)
    m = spiral(33) if kind == "spiral" else rng.random((31, 40)) < (0.35 if kind == "random" else 0.7)
    g = Grid(*m.shape)
    found = regions.regions(frame(spark, m=m), g, "m", size=size)
    cells = {(r.r, r.c): r.region for r in found.collect()}
    got = {r.region: r for r in regions.outlines(found, g, size).collect()}
    want = walked(cells)
    assert got.keys() == want.keys()
    for region, row in got.items():
        assert [[tuple(p) for p in ring] for ring in row.rings] == want[region]
        inside = sum(1 for v in cells.values() if v == region)
        twice = sum(a[1] * b[0] - a[0] * b[1] for ring in want[region] for a, b in zip(ring, ring[1:]))
        assert row.n_cells == inside == abs(twice) / 2 and row.area_m2 == inside * g.cell_area


def test_no_region(spark):
    g = Grid(4, 4)
    found = regions.regions(frame(spark, m=np.zeros((4, 4), bool)), g, "m")
    assert regions.outlines(found, g).count() == 0 and regions.numbered(found).count() == 0


def test_numbers_follow_the_first_cells(spark):
    m = np.random.default_rng(1).random((40, 40)) < 0.2
    g = Grid(40, 40)
    rows = regions.numbered(regions.regions(frame(spark, m=m), g, "m")).collect()
    names = sorted({r.region for r in rows})
    assert len(names) > 50 and {r.region: r.label for r in rows} == {n: k + 1 for k, n in enumerate(names)}


@pytest.mark.parametrize("name", ["blocked_outlines", "blocked_regions"])
def test_queries(spark, name):
    same(network.QUERIES[name](spark, SF), SF, network.ORACLES[name])
