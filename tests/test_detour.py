"""Detours forced by the slope limit, and the extent of corridors, on a small grid."""

import pytest
from pyspark.sql import functions as F

from ridgeline.operators import routing
from ridgeline.plans import scene
from ridgeline.sources.grid import Grid


def test_detour_and_extent(spark):
    g = Grid(30, 9)
    px = g.cell_area**0.5
    cells = spark.range(270).select(F.expr("id div 9").alias("r"), (F.col("id") % 9).alias("c"))
    steep = (F.col("c") == 4) & (F.col("r") < 29)
    cells = cells.withColumns({"z": F.lit(1.0), "slope": F.when(steep, 90.0).otherwise(5.0), "free": F.lit(1.0), "cost": F.when(~steep, 1.0)})
    path, free = (routing.route(cells, g, [(0, 0), (0, 8)], cost=c).join(cells, ["r", "c"]) for c in ("cost", "free"))
    row = routing.slope_detour(path, free, g, ["leg"], 85.0).first()
    assert row.free_length_m == pytest.approx(8 * px) and row.metres_above == pytest.approx(2 * px) and row.steepest == 90.0
    assert row.ratio == pytest.approx(row.length_m / (8 * px)) and row.ratio > 1.25
    assert row.detour == (row.length_m - 8 * px >= 500)
    assert not routing.slope_detour(free, free, g, ["leg"], 85.0).first().detour
    extent = routing.corridor_extent(cells.where("r <= 3"), free, cells, g).first()
    assert extent.area_ha == pytest.approx(36 * g.cell_area / 1e4) and extent.farthest_m == pytest.approx(3 * px)


def test_scene_reports(spark):
    g = Grid(30, 9)
    cells = spark.range(270).select(F.expr("id div 9").alias("r"), (F.col("id") % 9).alias("c"))
    steep = (F.col("c") == 4) & (F.col("r") < 29)
    cells = cells.withColumns({"z": F.lit(1.0), "slope": F.when(steep, 90.0).otherwise(5.0), "valid": F.lit(True), "barrier": F.lit(False), "penalty": F.lit(1.0), "raw_score": F.lit(0.5), "passable": ~steep, "cost": F.when(~steep, 1.0)})
    points = [(g.x0 + (k + 0.5) * g.dx, g.y0 + 0.5 * g.dy) for k in (0, 8)]
    found = scene.route(cells, g, points, scene.SceneOptions(streams=False))
    assert found["detour"].first().ratio > 1.25


def test_alternatives(spark):
    """Two corridors round a wall, of 20 and 24 steps: which of them counts, and how far they lie apart."""
    g = Grid(25, 21, 500_000.0, 30.0, 7_500_000.0, -30.0)
    cells = spark.range(525).select(F.expr("id div 21").alias("r"), (F.col("id") % 21).alias("c"))
    wall = (F.col("c") == 10) & ~F.col("r").isin(10, 22)
    cells = cells.withColumn("cost", F.when(~wall, 1.0))
    stops = [(10, 0), (10, 20)]
    path = routing.route(cells, g, stops)
    slack = {(r.r, r.c): r.slack for r in routing.corridor(cells, g, [tuple(stops)], 2.0).collect()}
    assert slack[10, 5] == pytest.approx(0) and slack[22, 10] > 0.15
    share = slack[22, 10] / 2  # the second way is beyond the slack, and within three times as much
    few = routing.alternatives(cells, g, path, stops, share, 10.0)
    assert {(r.r, r.c): r.slack for r in few["cells"].collect()} == pytest.approx({k: v for k, v in slack.items() if v <= share})
    assert {(r.r, r.c): r.slack_pct for r in few["raster"].collect()} == pytest.approx({k: 100 * max(v, 0) for k, v in slack.items() if v <= 3 * share})
    assert few["raster"].where("r = 22 and c = 10").count() == 1 and few["cells"].where("r = 22 and c = 10").count() == 0
    many = routing.alternatives(cells, g, path, stops, slack[22, 10], 10.0)["extent"].first()
    away = max(30.0 * abs(r - 10) for (r, c), v in slack.items() if v <= slack[22, 10] + 1e-9)
    assert many.farthest_m == pytest.approx(away) and many.apart and many.slack_pct == pytest.approx(100 * slack[22, 10])
    assert not routing.alternatives(cells, g, path, stops, slack[22, 10], 100.0)["extent"].first().apart
    parts = few["outlines"].collect()
    assert sum(p.n_cells for p in parts) == few["cells"].count()


def test_corridor_lines_and_profile(spark):
    g = Grid(20, 20, 500_000.0, 30.0, 7_500_000.0, -30.0)
    path = spark.createDataFrame([(0, k, 10, 5 + k, float(k)) for k in range(6)] + [(1, 0, 3, 3, 7.0)], "leg int, seq int, r long, c long, slope double")
    got = {(r.r, r.c) for r in routing.buffered(path, g, ["leg"], 45.0).collect()}
    near = lambda r, c: abs(r - 10) <= 1.5 and ((max(5 - c, c - 10, 0) * 30) ** 2 + ((r - 10) * 30) ** 2) <= 45**2
    alone = lambda r, c: ((r - 3) * 30) ** 2 + ((c - 3) * 30) ** 2 <= 45**2
    assert got == {(r, c) for r in range(20) for c in range(20) if near(r, c) or alone(r, c)}
    lines = {r.leg: r.coordinates for r in routing.lines(path, g, ["leg"]).collect()}
    assert lines[0] == [[500_000 + 30 * (5.5 + k), 7_500_000 - 30 * 10.5] for k in range(6)] and len(lines[1]) == 1
    row = routing.profile(path, ["leg"], ["slope"]).where("leg = 0").first()
    assert (row.slope_mean, row.slope_median, row.slope_max) == (2.5, 2.5, 5.0)
