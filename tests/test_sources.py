import json
import math

import pytest
from pyspark.sql import functions as F

from ridgeline.functions.crs import convert
from ridgeline.operators import sequences
from ridgeline.sources import rasters, vectors
from ridgeline.sources.grid import Grid, complete, problems, utm_zone


def test_grid_geometry(spark):
    g = Grid(4, 5, 100.0, 30.0, 900.0, -30.0)
    x, y = g.to_world(F.col("r"), F.col("c"))
    cells = spark.createDataFrame([(2, 3)], "r long, c long").select(x.alias("x"), y.alias("y"))
    assert cells.first() == (205.0, 825.0)
    r, c = g.to_cell(F.col("x"), F.col("y"))
    assert cells.select(r, c).first() == (2, 3)
    assert g.bounds == (100.0, 780.0, 250.0, 900.0) and g.cell_area == 900 and g.to_cells_of(100) == 4
    assert g.aligned(40.0) == Grid(4, 5, 80.0, 40.0, 920.0, -40.0)
    assert problems(g, Grid(4, 5, 100.0, 30.0, 900.0, -30.0), (1.0, None)) == (["nodata"], [])
    assert problems(g, Grid(4, 6, 100.0, 31.0, 900.0, -30.0))[1] == ["shape", "transform"]
    assert complete(spark.createDataFrame([(0, 0, 1.0)], "r long, c long, z double"), g).count() == 20
    with pytest.raises(ValueError):
        Grid(1, 5)
    with pytest.raises(ValueError):
        Grid(20, 20).size_warning(refuse=100)
    assert utm_zone(-45.0, -22.0) == "EPSG:32723" and utm_zone(181.0, 10.0) == "EPSG:32601"


def test_coordinates(spark):
    def at(x, y, a, b):
        u, v = convert(F.lit(float(x)), F.lit(float(y)), a, b)
        return tuple(spark.range(1).select(u.alias("u"), v.alias("v")).first())

    assert at(3, 0, "EPSG:4326", "EPSG:32631") == pytest.approx((500_000.0, 0.0), abs=1e-6)
    # Quarter meridian: 10001965.729 m on this ellipsoid.
    assert at(3, 90, "EPSG:4326", "EPSG:32631")[1] / 0.9996 == pytest.approx(10_001_965.729, abs=1e-3)
    assert at(180, 0, "EPSG:4326", "EPSG:3857")[0] == pytest.approx(20_037_508.342789, abs=1e-5)
    for crs, lon, lat in (("EPSG:32723", -46.9, -22.3), ("EPSG:32645", 86.9, 27.9), ("EPSG:3857", 10.0, 60.0)):
        assert at(*at(lon, lat, "EPSG:4326", crs), crs, "EPSG:4326") == pytest.approx((lon, lat), abs=1e-9)
    with pytest.raises(ValueError):
        at(0, 0, "EPSG:4326", "EPSG:2154")


def test_ascii_grid_round_trip(spark, tmp_path):
    g = Grid(3, 4, 100.0, 10.0, 330.0, -10.0)
    rows = [(r, c, None if (r, c) == (1, 2) else r * 10 + c + 0.5) for r in range(3) for c in range(4)]
    cells = spark.createDataFrame(rows, "r long, c long, z float")
    rasters.write_ascii_grid(cells, g, "z", f"file://{tmp_path}/grid")
    text = [p.read_text() for p in sorted((tmp_path / "grid").glob("part-*"))]
    (tmp_path / "one.asc").write_text("".join(text))
    back, grid = rasters.read_ascii_grid(spark, f"file://{tmp_path}/one.asc")
    assert grid == g and sorted(map(tuple, back.collect())) == sorted(rows)


def test_cells_skip_tiles(spark, tmp_path):
    cells = spark.range(400).select(F.expr("id div 20").alias("r"), (F.col("id") % 20).alias("c"), F.lit(1.0).alias("z"))
    rasters.write_cells(cells, f"file://{tmp_path}/cells", 8)
    part = rasters.read_cells(spark, f"file://{tmp_path}/cells", (2, 5, 9, 12), 8)
    assert part.count() == 16 and "PartitionFilters: [isnotnull(tr" in part._jdf.queryExecution().toString()


def test_geojson(spark, tmp_path):
    feature = lambda kind, xy: {"type": "Feature", "properties": {"name": kind}, "geometry": {"type": kind, "coordinates": xy}}
    path = tmp_path / "f.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [feature("MultiPoint", [[3, 0], [3, 1]]), feature("Polygon", [[[0, 0], [1, 0], [1, 1], [0, 0]]]), feature("Point", [4, 2])]}))
    got = vectors.points(spark, f"file://{path}", "EPSG:32631").orderBy("ord").collect()
    assert [p.ord for p in got] == [0, 1, 2] and got[0].x == pytest.approx(500_000) and got[1].y == pytest.approx(110_574.4 * 0.9996, abs=0.5)
    assert vectors.polygon_sides(spark, f"file://{path}").count() == 3
    out = vectors.to_geojson(got and spark.createDataFrame([(1.0, 2.0, "a")], "x double, y double, n string"), "Point", F.array("x", "y"), ["n"]).first().value
    assert json.loads(out) == feature("Point", [1.0, 2.0]) | {"properties": {"n": "a"}}


def test_typed_points(spark):
    rows = [("-45.5; -22.5",), ("-45.5,-22.5",), (" -45.5  -22.5 ",), ("north",), ("",), (None,)]
    got = [(r.x, r.y) for r in vectors.typed_points(spark.createDataFrame(rows, "t string"), "t").collect()]
    assert got == [(-45.5, -22.5)] * 3 + [(None, None)] * 3


def test_tracks(spark, tmp_path):
    (tmp_path / "a.gpx").write_text('<gpx><trk><trkseg><trkpt lat="1" lon="2"><ele>3</ele><time>2024-01-01T00:00:00Z</time></trkpt><trkpt lat="1.5" lon="2.5"></trkpt></trkseg><trkseg><trkpt lat="9" lon="8"/></trkseg></trk></gpx>')
    (tmp_path / "b.kml").write_text('<kml xmlns:gx="g"><Placemark><gx:Track><when>2024-01-01T00:00:00Z</when><when>2024-01-01T00:01:00Z</when><gx:coord>2 1 3</gx:coord><gx:coord>2.5 1.5 4</gx:coord><gx:coord>0 0 0</gx:coord></gx:Track></Placemark></kml>')
    (tmp_path / "c.kml").write_text("<kml><Placemark><LineString><coordinates> 2,1,3 2.5,1.5 </coordinates></LineString></Placemark></kml>")
    get = lambda n: [(r.seg, r.seq, r.lon, r.lat, r.ele, r.ts and r.ts.isoformat()) for r in vectors.read_tracks(spark, f"file://{tmp_path}/{n}").orderBy("seg", "seq").collect()]
    assert get("a.gpx") == [(0, 0, 2.0, 1.0, 3.0, "2024-01-01T00:00:00"), (0, 1, 2.5, 1.5, None, None), (1, 0, 8.0, 9.0, None, None)]
    assert get("b.kml") == [(0, 0, 2.0, 1.0, 3.0, "2024-01-01T00:00:00"), (0, 1, 2.5, 1.5, 4.0, "2024-01-01T00:01:00")]
    assert get("c.kml") == [(0, 0, 2.0, 1.0, 3.0, None), (0, 1, 2.5, 1.5, None, None)]


def test_distance_windows(spark):
    rows = [("a", i, 30.0 * i, 0.0, 1.0 * i, 30 * i + (500 if i > 20 else 0)) for i in range(40)] + [("b", 0, 0.0, 0.0, 0.0, 0)]
    fixes = spark.createDataFrame(rows, "track string, seq long, x double, y double, ele double, t long")
    got = sorted(map(tuple, sequences.distance_windows(fixes.repartition(3), 100.0).collect()))
    want, start, dist, paused, win = [], 0, 0.0, False, 0
    for i in range(1, 40):
        dist += 30
        paused |= rows[i][5] - rows[i - 1][5] > 120
        if dist >= 100:
            if not paused:
                dt = rows[i][5] - rows[start][5]
                want.append(("a", win, (i - start) / dist, dist / dt * 3.6, dist, float(dt)))
            start, dist, paused, win = i, 0.0, False, win + 1
    assert got == want and len(want) == 8


def test_corner_cells(spark):
    path = spark.createDataFrame([(0, i, i, i) for i in range(6)], "leg int, seq int, r int, c int")
    streams = spark.createDataFrame([(i, i + 1, 5.0 + i) for i in range(5)], "r int, c int, area double")
    got = sorted(sequences.with_corners(path, ["leg"], streams).collect(), key=lambda r: r.seq)
    assert [(r.r, r.c) for r in got] == [x for i in range(5) for x in ((i, i), (i, i + 1))] + [(5, 5)]


def test_straight_and_samples(spark):
    ends = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 20.0)], "k int, x1 double, y1 double, x2 double, y2 double")
    got = sorted(sequences.straight(ends, 5, ["k"]).collect(), key=lambda r: r.seq)
    assert [(r.x, r.y) for r in got] == [(2.5 * i, 5.0 * i) for i in range(5)]
    g = Grid(2, 2, 0.0, 10.0, 20.0, -10.0)
    cells = spark.createDataFrame([(0, 0, 1.0), (1, 1, 4.0)], "r long, c long, z double")
    points = spark.createDataFrame([(5.0, 15.0), (15.0, 5.0), (99.0, 0.0)], "x double, y double")
    assert [r.z for r in sequences.sample_cells(points, cells, g, ["z"]).orderBy("x").collect()] == [1.0, 4.0, None]


def test_walking_functions(spark):
    from ridgeline.functions import cellwise as fn

    row = spark.range(1).select(fn.tobler_hours(F.lit(0.0), F.lit(1000.0)), fn.tobler_hours(F.lit(5.0), F.lit(0.0)), fn.hours_text(F.lit(3.6699)), fn.slope_class(F.lit(20.0)), fn.slope_class(F.lit(None).cast("double")), fn.preference(F.lit(0.0), F.lit(2.0)), fn.preference(F.lit(None).cast("double"), F.lit(2.0))).first()
    assert row[0] == pytest.approx(1 / (6 * math.exp(-0.175))) and tuple(row)[1:] == (0.0, "3h40", 2, 0, 1.0, 0.0)
    assert fn.class_labels((20.0, 35.0, 60.0, 100.0)) == ["< 20 %", "20-35 %", "35-60 %", "60-100 %", ">= 100 %"]
    with pytest.raises(ValueError):
        fn.slope_class(F.lit(1.0), (20.0, 20.0, 60.0, 100.0))
    with pytest.raises(ValueError):
        fn.linear(F.lit(1.0), 2.0, 2.0)
