"""Products of a whole scene appear together or not at all."""

import os

import pytest
from pyspark.sql import functions as F

from ridgeline import session
from ridgeline.plans import scene
from ridgeline.sources import geotiff
from ridgeline.sources.grid import Grid


def hill(spark, n):
    return spark.range(n * n).select(F.expr(f"id div {n}").alias("r"), (F.col("id") % n).alias("c")).select(
        "r", "c", (600 + F.col("r") * 2 + F.sin(F.col("c") / 5) * 20 + F.cos(F.col("r") / 7) * 15).cast("float").alias("z")
    )


def test_a_run_is_published_as_a_whole(spark, tmp_path, monkeypatch):
    g, target = Grid(40, 40, 500_000.0, 30.0, 7_500_000.0, -30.0), f"file://{tmp_path}/out"
    cells, o = hill(spark, 40), scene.SceneOptions(stream_basin_km2=0.05, least_patch_ha=0.1)
    root = session.shared_root(spark).removeprefix("file://")
    before = {n for n in os.listdir(root) if n.startswith("scene-")} if os.path.isdir(root) else set()
    assert scene.products(spark, target) == {}
    made = scene.run(cells, g, target, o=o)
    known = scene.products(spark, target)
    assert set(known) == {*made, "zones.geojsonl", *scene.RASTERS}
    assert spark.read.parquet(known["classes"]).count() == made["classes"].count() > 0
    score, grid = geotiff.read_geotiff(spark, known["score"])
    assert grid == g and score.where("z is not null").count() > 0
    # A run that fails half-way leaves nothing of its own, and what was published.
    monkeypatch.setattr(scene.vectors, "to_geojson", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        scene.run(cells, g, target, o=o)
    assert scene.products(spark, target) == known and len([n for n in os.listdir(tmp_path / "out") if n.startswith("run-")]) == 1
    events = spark.read.schema("event string, payload map<string,string>").json(f"{target}/log")
    assert {r.event for r in events.select("event").distinct().collect()} >= {"start", "layer", "raster", "end", "failed"}
    monkeypatch.undo()
    scene.run(cells, g, target, o=o)
    assert scene.products(spark, target) != known
    # No intermediate table is left.
    assert {n for n in os.listdir(root) if n.startswith("scene-")} == before


def test_a_route_is_published_with_its_shapes(spark, tmp_path):
    g, target = Grid(40, 40, 500_000.0, 30.0, 7_500_000.0, -30.0), f"file://{tmp_path}/out"
    o = scene.SceneOptions(streams=False, least_patch_ha=0.1, alternatives=0.05)
    points = [(500_045.0, 7_499_955.0), (501_095.0, 7_498_905.0)]
    scene.run(hill(spark, 40), g, target, points, o)
    known = scene.products(spark, target)
    shapes = {n: spark.read.json(known[f"{n}.geojsonl"]) for n in ("route", "route_corridor", "route_alternatives")}
    line = shapes["route"].first()
    assert line.geometry.type == "LineString" and line.geometry.coordinates[0] == [500_045.0, 7_499_955.0] and line.geometry.coordinates[-1] == [501_095.0, 7_498_905.0]
    attributes = spark.read.parquet(known["route_attributes"]).first()
    assert line.properties.length_m == pytest.approx(attributes.length_m) and attributes.slope_max >= attributes.slope_median >= 0 and 0 <= attributes.raw_score_mean <= 1
    strip = shapes["route_corridor"].first()
    assert strip.geometry.type == "Polygon" and strip.properties.buffer_m == 100.0 and strip.properties.n_cells > 7 * line.properties.length_m / 30 / 2
    slack, grid = geotiff.read_geotiff(spark, known["slack"])
    shown = spark.read.parquet(known["route_alternatives_raster"])
    assert grid == g and slack.where("z is not null").count() == shown.count() >= spark.read.parquet(known["route_alternatives"]).count() > 0
    assert sum(r.properties.n_cells for r in shapes["route_alternatives"].collect()) == spark.read.parquet(known["route_alternatives"]).count()


def test_points_outside_are_named(spark):
    g = Grid(8, 8, 500_000.0, 30.0, 7_500_000.0, -30.0)
    cells = hill(spark, 8).withColumn("cost", F.lit(1.0))
    with pytest.raises(ValueError, match="point 2 .* outside of the relief"):
        scene.route(cells, g, [(500_010.0, 7_499_990.0), (499_000.0, 7_499_990.0)])
