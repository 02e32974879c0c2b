"""The working CRS and grid, warping and alignment, margins of polygons."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.operators import distance
from ridgeline.plans import field
from ridgeline.sources import working
from ridgeline.sources.grid import Grid
from tests.duck import same
from tests.test_connectivity import frame

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["warped_to_utm", "resampled_cubic", "resampled_to_corners", "resampled_nearest", "polygon_cells", "polygon_margin", "polygon_measures"])
def test_queries(spark, name):
    same(field.QUERIES[name](spark, SF), SF, field.ORACLES[name])


def plane(spark, grid):
    r, c = np.indices((grid.rows, grid.cols))
    return frame(spark, z=2.0 * r + 3.0 * c)


def test_choice_of_the_working_grid(spark):
    degrees = Grid(40, 50, -45.1, 1 / 3600, -22.0, -1 / 3600, crs="EPSG:4326")
    made = working.working_relief(plane(spark, degrees), degrees)
    assert made.grid.crs == "EPSG:32723" and made.reprojected and not made.grid.rotated and made.grid.px == made.grid.py and 25 < made.grid.px < 33
    assert made.cells.count() == made.grid.rows * made.grid.cols
    fixed = working.working_relief(plane(spark, degrees), degrees, cell=30.0).grid
    assert fixed.px == 30 and fixed.x0 % 30 == 0 and fixed.y0 % 30 == 0
    cut = Grid(20, 30, degrees.x0 + 10 * degrees.dx, degrees.dx, degrees.y0 + 10 * degrees.dy, degrees.dy, crs="EPSG:4326")
    part = working.working_relief(plane(spark, cut), cut, cell=30.0).grid
    assert (part.x0 - fixed.x0) % 30 == 0 and (part.y0 - fixed.y0) % 30 == 0
    utm = Grid(10, 12, 500_000.0, 30.0, 7_500_000.0, -30.0)
    kept = working.working_relief(plane(spark, utm), utm)
    assert kept.grid == utm and not kept.reprojected and kept.reason.endswith("kept")
    oblong = Grid(10, 12, 500_000.0, 30.0, 7_500_000.0, -20.0)
    square = working.working_relief(plane(spark, oblong), oblong)
    assert (square.grid.px, square.grid.py, square.grid.crs) == (20.0, 20.0, utm.crs) and "oblong" in square.reason and not square.reprojected
    turned = Grid(10, 12, 500_000.0, 30.0, 7_500_000.0, -30.0, 3.0, 3.0)
    assert not working.working_relief(plane(spark, turned), turned).grid.rotated
    mercator = Grid(10, 12, -5_000_000.0, 30.0, -2_500_000.0, -30.0, crs="EPSG:3857")
    assert working.working_relief(plane(spark, mercator), mercator).grid.crs.startswith("EPSG:327")


def test_strict_mode_polar_note_and_alignment(spark):
    nameless = Grid(10, 12, -45.1, 1 / 3600, -22.0, -1 / 3600, crs="")
    with pytest.raises(working.WorkingGridError, match="no CRS"):
        working.working_relief(plane(spark, nameless), nameless)
    made = working.working_relief(plane(spark, nameless), nameless, strict=False)
    assert made.assigned and made.original_crs == "" and "assumed" in made.messages[0] and made.grid.crs == "EPSG:32723"
    polar = Grid(10, 12, 10.0, 1 / 3600, 85.0, -1 / 3600, crs="EPSG:4326")
    assert any("84" in m for m in working.working_relief(plane(spark, polar), polar).messages)
    utm = Grid(10, 12, 500_000.0, 30.0, 7_500_000.0, -30.0)
    other = Grid(5, 6, 500_060.0, 15.0, 7_499_940.0, -15.0)
    for method in ("nearest", "bilinear", "cubic"):
        got = {(r.r, r.c): r.z for r in working.align(plane(spark, utm), utm, other, method=method).collect()}
        assert len(got) == 30
        for (r, c), z in got.items():
            fr, fc = 2 + (r + 0.5) / 2 - 0.5, 2 + (c + 0.5) / 2 - 0.5
            want = 2 * math.floor(fr + 0.5) + 3 * math.floor(fc + 0.5) if method == "nearest" else 2 * fr + 3 * fc
            assert z == pytest.approx(want)


def test_tiles_of_any_size_give_the_same(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(size=(37, 41))
    z[rng.random(z.shape) < 0.2] = np.nan
    source, target = Grid(37, 41, 0.0, 10.0, 0.0, -10.0, 0.7, -0.4), Grid(60, 60, 20.0, 7.0, -15.0, -7.0)
    for method in ("nearest", "bilinear", "cubic"):
        a, b = ({(r.r, r.c): r.z for r in distance.resample(frame(spark, z=z), source, target, "z", method, size=size).collect()} for size in (16, 64))
        assert a == b and len(a) > 500


def test_margin_is_round(spark):
    g = Grid(40, 40, 0.0, 10.0, 400.0, -10.0)
    sides = [(0, 153.0, 151.0, 247.0, 163.0), (0, 247.0, 163.0, 201.0, 242.0), (0, 201.0, 242.0, 153.0, 151.0)]
    edges = spark.createDataFrame(sides, "fid int, x1 double, y1 double, x2 double, y2 double")
    got = {(r.r, r.c) for r in distance.constraint_cells(edges, g, 57.0).collect()}
    want = set()
    for r in range(40):
        for c in range(40):
            x, y, inside, least = 10 * (c + 0.5), 400 - 10 * (r + 0.5), False, math.inf
            for _, x1, y1, x2, y2 in sides:
                if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                    inside = not inside
                t = min(max(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2), 0), 1)
                least = min(least, math.hypot(x - x1 - (x2 - x1) * t, y - y1 - (y2 - y1) * t))
            if inside or least <= 57:
                want.add((r, c))
    assert got == want and len(want) > len({(r.r, r.c) for r in distance.constraint_cells(edges, g).collect()})
    measured = distance.polygon_measures(edges).first()
    assert measured.area == pytest.approx(abs(sum(a * d - c * b for _, a, b, c, d in sides)) / 2) and measured.length == pytest.approx(sum(math.hypot(c - a, d - b) for _, a, b, c, d in sides))
