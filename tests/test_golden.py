"""The analytic scene against its published values."""

import math

import pytest
from pyspark.sql import functions as F

from ridgeline.operators import classes, hydrology, terrain
from ridgeline.plans import scene
from ridgeline.session import materialize
from ridgeline.sources.grid import analytic_scene


@pytest.fixture(scope="module")
def analytic(spark):
    cells, grid = analytic_scene(spark)
    return materialize(cells, "analytic"), grid


def shares(found):
    n = {r["class"]: r["count"] for r in found.groupBy("class").count().collect()}
    return {k: round(100 * v / sum(n.values()), 2) for k, v in n.items()}


def test_classes_by_slope_alone(analytic):
    cells, grid = analytic
    assert shares(classes.classify(terrain.slope(cells, grid))) == {1: 28.73, 2: 35.37, 3: 30.34, 4: 5.29, 5: 0.27}


def test_scene(analytic):
    cells, grid = analytic
    made = materialize(scene.surface(cells, grid), "scene")
    row = hydrology.metrics(made, grid).first()
    assert row.channels == 932 and row.network_km == pytest.approx(35.863, abs=1e-3) and row.density == pytest.approx(0.4428, abs=1e-4)
    assert shares(made) == {1: 26.30, 2: 36.33, 3: 30.96, 4: 6.13, 5: 0.27}
    s = made.agg(F.min("score"), F.median("score"), F.max("score"), F.min("risk"), F.median("risk"), F.max("risk"), F.sum(F.col("cost").isNull().cast("int"))).first()
    assert [round(float(x), 4) for x in s[:6]] == [0.1333, 0.6468, 0.9763, 0.0108, 0.2752, 1.0] and s[6] == 311
    outlines = scene.zones(made, grid).agg(F.count("*"), F.sum("area_ha")).first()
    assert outlines[0] == 21 and outlines[1] == pytest.approx(1970.3, abs=0.1)
    points = [(500900, 7491900), (506600, 7493700), (508100, 7499100)]
    found = scene.route(made, grid, points)
    a = found["attributes"].first()
    assert a.length_m == pytest.approx(13159.0, rel=1e-3) and a.hours == pytest.approx(3.67, rel=1e-3) and a.time_text == "3h40"
    assert a.gain_m == pytest.approx(898.9, rel=1e-3) and a.loss_m == pytest.approx(579.4, rel=1e-3) and float(a.alt_max) == pytest.approx(1577.8, rel=1e-3)
    assert math.isclose(a.field_hours, 9.17, rel_tol=1e-3) and a.vertices == 392
    crossings = sorted(float(r.area) for r in found["crossings"].collect())
    assert crossings == pytest.approx([1.251, 7.662], abs=1e-3)
