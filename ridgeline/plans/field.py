"""Queries on points, polygons, resampling and agreement with field data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.functions import crs
from ridgeline.operators import classes, distance, sequences, terrain, validation
from ridgeline.plans import scene
from ridgeline.plans.surface import CLASS_SQL, SLOPE, relief
from ridgeline.session import materialize, run_path
from ridgeline.sources import geotiff, working
from ridgeline.sources.grid import ORDERS_SQL, Grid, analytic_scene

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"""WITH {ORDERS_SQL}, t AS (SELECT r, c FROM cells WHERE r < w - 1 AND c < w - 1)
SELECT t.r, t.c, round(avg(s.z::DOUBLE), 5) AS z FROM t JOIN cells s ON s.r IN (t.r, t.r + 1) AND s.c IN (t.c, t.c + 1) WHERE s.z IS NOT NULL GROUP BY t.r, t.c""")
def resampled_to_corners(spark, sf_dir):
    cells, grid = relief(spark, sf_dir)
    target = Grid(grid.rows - 1, grid.cols - 1, grid.x0 + 15.0, grid.dx, grid.y0 - 15.0, grid.dy)
    return distance.resample(cells, grid, target, "z").select("r", "c", F.round("z", 5).alias("z"))


@query(f"""WITH {ORDERS_SQL}, t AS (SELECT r, c, least(floor((r + 0.5::DOUBLE) * 2 / 3), w - 1) AS sr, least(floor((c + 0.5::DOUBLE) * 2 / 3), w - 1) AS sc FROM cells)
SELECT t.r, t.c, s.z::DOUBLE AS z FROM t JOIN cells s ON s.r = sr AND s.c = sc WHERE s.z IS NOT NULL""")
def resampled_nearest(spark, sf_dir):
    cells, grid = relief(spark, sf_dir)
    target = Grid(grid.rows, grid.cols, grid.x0, 20.0, grid.y0, -20.0)
    return distance.resample(cells, grid, target, "z", "nearest")


@query(f"WITH {ORDERS_SQL} SELECT r, c, z::DOUBLE AS z FROM cells")
def geotiff_round_trip(spark, sf_dir):
    cells, grid = relief(spark, sf_dir)
    target = run_path(spark, "relief-tiles")
    geotiff.write_geotiff(cells, grid, "z", target)
    back, _ = geotiff.read_geotiff(spark, target)
    return back.select("r", "c", F.col("z").cast("double").alias("z"))


TRIANGLES = """tri AS (SELECT s_suppkey AS fid, 500000 + (s_suppkey * 37 % 900) + 0.3::DOUBLE AS ax, 7500000 - (s_suppkey * 53 % 900) - 0.7::DOUBLE AS ay FROM supplier),
sides AS (SELECT fid, ax AS x1, ay AS y1, ax + 211.7::DOUBLE AS x2, ay - 31.1::DOUBLE AS y2 FROM tri UNION ALL SELECT fid, ax + 211.7::DOUBLE, ay - 31.1::DOUBLE, ax + 83.9::DOUBLE, ay - 187.3::DOUBLE FROM tri UNION ALL SELECT fid, ax + 83.9::DOUBLE, ay - 187.3::DOUBLE, ax, ay FROM tri)"""


def triangles(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    k = F.col("s_suppkey")
    t = s.select(k.alias("fid"), (F.lit(500_000) + k * 37 % 900 + 0.3).alias("x"), (F.lit(7_500_000) - k * 53 % 900 - 0.7).alias("y"))
    corners = [(0.0, 0.0), (211.7, -31.1), (83.9, -187.3)]
    side = lambda a, b: F.struct(*((F.col(n) + p[i]).alias(f"{n}{j}") for j, p in ((1, a), (2, b)) for i, n in enumerate("xy")))
    return t.select("fid", F.explode(F.array(*(side(a, b) for a, b in zip(corners, [*corners[1:], corners[0]])))).alias("s")).select("fid", "s.*")


@query(f"""WITH {ORDERS_SQL}, {TRIANGLES}, p AS (SELECT r, c, 500000 + (c + 0.5::DOUBLE) * 30 AS x, 7500000 - (r + 0.5::DOUBLE) * 30 AS y FROM cells)
SELECT DISTINCT r, c FROM (SELECT r, c, fid FROM p JOIN sides ON (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY r, c, fid HAVING count(*) % 2 = 1)""")
def polygon_cells(spark, sf_dir):
    _, grid = relief(spark, sf_dir)
    return distance.constraint_cells(triangles(spark, sf_dir), grid)


@query(f"""WITH {ORDERS_SQL}, {TRIANGLES}, p AS (SELECT r, c, 500000 + (c + 0.5::DOUBLE) * 30 AS x, 7500000 - (r + 0.5::DOUBLE) * 30 AS y FROM cells),
inside AS (SELECT r, c FROM (SELECT r, c, fid FROM p JOIN sides ON (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY r, c, fid HAVING count(*) % 2 = 1)),
near AS (SELECT r, c, x, y, x1, y1, x2 - x1 AS vx, y2 - y1 AS vy FROM p JOIN sides ON x BETWEEN least(x1, x2) - 75 AND greatest(x1, x2) + 75 AND y BETWEEN least(y1, y2) - 75 AND greatest(y1, y2) + 75),
t AS (SELECT *, least(greatest(((x - x1) * vx + (y - y1) * vy) / (vx * vx + vy * vy), 0), 1) AS t FROM near)
SELECT r, c FROM inside UNION SELECT r, c FROM t WHERE power(x - x1 - vx * t, 2) + power(y - y1 - vy * t, 2) <= 75 * 75""")
def polygon_margin(spark, sf_dir):
    _, grid = relief(spark, sf_dir)
    return distance.constraint_cells(triangles(spark, sf_dir), grid, 75.0)


@query(f"WITH {TRIANGLES} SELECT fid, round(abs(sum(x1 * y2 - x2 * y1)) / 2, 2) AS area, round(sum(sqrt(power(x2 - x1, 2) + power(y2 - y1, 2))), 4) AS length FROM sides GROUP BY fid")
def polygon_measures(spark, sf_dir):
    return distance.polygon_measures(triangles(spark, sf_dir)).select("fid", F.round("area", 2).alias("area"), F.round("length", 4).alias("length"))


def _cubic(d: str) -> str:
    return f"CASE WHEN abs({d}) <= 1 THEN {d} * {d} * (abs({d}) * 1.5::DOUBLE - 2.5::DOUBLE) + 1 ELSE ((abs({d}) * -0.5::DOUBLE + 2.5::DOUBLE) * abs({d}) - 4) * abs({d}) + 2 END"


@query(f"""WITH {ORDERS_SQL}, t AS (SELECT r, c, w, (r + 0.5::DOUBLE) * 2 / 3 - 0.5::DOUBLE AS fr, (c + 0.5::DOUBLE) * 2 / 3 - 0.5::DOUBLE AS fc FROM cells),
k AS (SELECT t.r, t.c, s.z::DOUBLE AS z, fr - s.r AS a, fc - s.c AS b FROM t, range(-1, 3) i(i), range(-1, 3) j(j) JOIN cells s ON s.r = floor(fr) + i AND s.c = floor(fc) + j WHERE s.z IS NOT NULL)
SELECT r, c, round(sum({_cubic("a")} * ({_cubic("b")}) * z) / sum({_cubic("a")} * ({_cubic("b")})), 4) AS z FROM (SELECT r, c, z, a, b FROM k) GROUP BY r, c HAVING abs(sum({_cubic("a")} * ({_cubic("b")}))) > 1e-6""")
def resampled_cubic(spark, sf_dir):
    cells, grid = relief(spark, sf_dir)
    target = Grid(grid.rows, grid.cols, grid.x0, 20.0, grid.y0, -20.0)
    return distance.resample(cells, grid, target, "z", "cubic").where("z is not null").select("r", "c", F.round("z", 4).alias("z"))


DEGREE_CELL = 1 / 3600  # of a second of arc, as the common reliefs have it


def _series(of: str, factors: tuple, even: str, other: str, sign: str = "+") -> str:
    return of + "".join(f" {sign} {a!r}::DOUBLE * {even.format(k=2 * k)} * {other.format(k=2 * k)}" for k, a in enumerate(factors, 1))


def _utm_sql() -> str:
    """Tables ``corners`` (of the relief in degrees, in UTM) and, for lattice cells ``x, y``, ``back`` with their longitude and latitude."""
    e, radius, middle = crs._e, crs.SCALE * crs._radius, -45.0
    t = f"sinh(atanh(sin(radians(lat))) - atanh(sin(radians(lat)) * {e!r}::DOUBLE) * {e!r}::DOUBLE)"
    x = _series("eta", crs._ALPHA, "cos(xi * {k})", "sinh(eta * {k})")
    y = _series("xi", crs._ALPHA, "sin(xi * {k})", "cosh(eta * {k})")
    u = _series("xi", crs._BETA, "sin(xi * {k})", "cosh(eta * {k})", "-")
    v = _series("eta", crs._BETA, "cos(xi * {k})", "sinh(eta * {k})", "-")
    lat = _series("chi", crs._DELTA, "sin(chi * {k})", "1")
    return f"""edge AS (SELECT -45.2::DOUBLE + a * w / 3600.0::DOUBLE AS lon, -22.1::DOUBLE - b * w / 3600.0::DOUBLE AS lat FROM dims, (VALUES (0, 0), (0, 1), (1, 0), (1, 1), (0.5, 0), (0.5, 1)) q(a, b)),
f1 AS (SELECT {t} AS t, radians(lon - ({middle!r}::DOUBLE)) AS lam FROM edge),
f2 AS (SELECT atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(t * t + 1)) AS eta FROM f1),
corners AS (SELECT ({x}) * {radius!r}::DOUBLE + 500000 AS x, ({y}) * {radius!r}::DOUBLE + 10000000 AS y FROM f2),
span AS (SELECT floor(min(x) / 30)::BIGINT - 2 AS c0, ceil(max(x) / 30)::BIGINT + 2 AS c1, floor(min(y) / 30)::BIGINT - 2 AS r0, ceil(max(y) / 30)::BIGINT + 2 AS r1 FROM corners),
lattice AS (SELECT (c + 0.5::DOUBLE) * 30 AS x, (r + 0.5::DOUBLE) * 30 AS y FROM (SELECT unnest(range(c0, c1)) AS c FROM span), (SELECT unnest(range(r0, r1)) AS r FROM span)),
b1 AS (SELECT x, y, (y - 10000000) / {radius!r}::DOUBLE AS xi, (x - 500000) / {radius!r}::DOUBLE AS eta FROM lattice),
b2 AS (SELECT x, y, {u} AS u, {v} AS v FROM b1),
b3 AS (SELECT x, y, u, v, asin(sin(u) / cosh(v)) AS chi FROM b2),
back AS (SELECT x, y, degrees(atan2(sinh(v), cos(u))) + ({middle!r}::DOUBLE) AS lon, degrees({lat}) AS lat FROM b3)"""


@query(f"""WITH {ORDERS_SQL}, {_utm_sql()},
p AS (SELECT x, y, (lon + 45.2::DOUBLE) * 3600 AS fc, (-22.1::DOUBLE - lat) * 3600 AS fr, w FROM back, dims),
t AS (SELECT x, y, fr - 0.5::DOUBLE AS fr, fc - 0.5::DOUBLE AS fc FROM p WHERE fc >= 0 AND fc < w AND fr >= 0 AND fr < w),
k AS (SELECT x, y, (1 - abs(fr - r)) * (1 - abs(fc - c)) AS weight, z::DOUBLE AS z FROM t, range(0, 2) i(i), range(0, 2) j(j) JOIN cells ON r = floor(fr) + i AND c = floor(fc) + j WHERE z IS NOT NULL)
SELECT x, y, round(sum(weight * z) / sum(weight), 2) AS z FROM k GROUP BY x, y""")
def warped_to_utm(spark, sf_dir):
    cells, grid = relief(spark, sf_dir)
    in_degrees = Grid(grid.rows, grid.cols, -45.2, DEGREE_CELL, -22.1, -DEGREE_CELL, crs="EPSG:4326")
    made = working.working_relief(cells.select("r", "c", "z"), in_degrees, cell=30.0)
    x, y = made.grid.to_world(F.col("r"), F.col("c"))
    return made.cells.where("z is not null").select(x.alias("x"), y.alias("y"), F.round("z", 2).alias("z"))


POINTS = "pts AS (SELECT event_id, 500000 + value * 12 AS x, 7500000 - (event_id * 7 % 1500) AS y FROM events)"


def points(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", (F.lit(500_000) + F.col("value") * 12).alias("x"), (F.lit(7_500_000) - F.col("event_id") * 7 % 1500).alias("y"))


@query(f"WITH {ORDERS_SQL}, {POINTS} SELECT event_id, z FROM pts LEFT JOIN cells ON r = floor((7500000 - y) / 30) AND c = floor((x - 500000) / 30)")
def sampled_altitudes(spark, sf_dir):
    cells, grid = relief(spark, sf_dir)
    return sequences.sample_cells(points(spark, sf_dir), cells, grid, ["z"]).select("event_id", "z")


@query(f"""WITH {SLOPE}, {POINTS}, k AS (SELECT r, c, {CLASS_SQL} AS class FROM t1),
u AS (SELECT class, count(*) AS n FROM pts JOIN k ON r = floor((7500000 - y) / 30) AND c = floor((x - 500000) / 30) WHERE class > 0 GROUP BY class),
a AS (SELECT class, count(*) AS n FROM k WHERE class > 0 GROUP BY class)
SELECT a.class, round(coalesce(u.n / sum(u.n) OVER (), 0), 6) AS used, round(a.n / sum(a.n) OVER (), 6) AS available, round(coalesce(u.n / sum(u.n) OVER (), 0) / (a.n / sum(a.n) OVER ()), 5) AS ratio FROM a LEFT JOIN u USING (class)""")
def class_use(spark, sf_dir):
    cells, grid = relief(spark, sf_dir)
    classed = classes.classify(terrain.slope(cells, grid))
    used = sequences.sample_cells(points(spark, sf_dir), classed, grid, ["class"])
    return validation.class_use(used, classed).select("class", F.round("used", 6).alias("used"), F.round("available", 6).alias("available"), F.round("ratio", 5).alias("ratio"))


@query(f"WITH {SLOPE} SELECT round(corr(z::DOUBLE, slope::DOUBLE), 6) AS z_slope, round(corr(extra, slope::DOUBLE), 6) AS extra_slope FROM t1")
def raster_correlations(spark, sf_dir):
    cells, grid = relief(spark, sf_dir)
    found = validation.correlations(terrain.slope(cells, grid), {"z_slope": (F.col("z"), F.col("slope")), "extra_slope": (F.col("extra"), F.col("slope"))})
    return found.select(*(F.round(c, 6).alias(c) for c in found.columns))


@query(f"""WITH {SLOPE}, b AS (SELECT floor((z::DOUBLE - 700) / 50)::BIGINT + 1 AS bin, slope::DOUBLE AS s FROM t1 WHERE slope IS NOT NULL AND z >= 700 AND z < 1300)
SELECT bin, 700 + (bin - 0.5::DOUBLE) * 50 AS center, count(*) AS n, round(quantile_cont(s, 0.5), 4) AS median FROM b GROUP BY bin HAVING count(*) >= 5""")
def slope_medians_by_altitude(spark, sf_dir):
    cells, grid = relief(spark, sf_dir)
    found = validation.binned_medians(terrain.slope(cells, grid), "z", "slope", 700.0, 1300.0, 12, 5)
    return found.select("bin", "center", "n", F.round("median", 4).alias("median"))


@query(f"WITH {ORDERS_SQL}, l AS (SELECT z::DOUBLE AS a, lag(z::DOUBLE) OVER (PARTITION BY r ORDER BY c) AS b FROM cells) SELECT count(*) AS n, round(corr(a, b), 6) AS lag1 FROM l WHERE a IS NOT NULL AND b IS NOT NULL")
def altitude_autocorrelation(spark, sf_dir):
    cells, _ = relief(spark, sf_dir)
    return validation.autocorrelation(cells, ["r"], "c", "z").select("n", F.round("lag1", 6).alias("lag1"))


@query(f"""WITH {ORDERS_SQL}, g AS (SELECT r, abs(z::DOUBLE - lag(z::DOUBLE) OVER (PARTITION BY r ORDER BY c)) / 30 * 100 AS g FROM cells)
SELECT r, count(*) AS n, round(quantile_cont(g, 0.5), 4) AS p50, round(quantile_cont(g, 0.75), 4) AS p75, round(quantile_cont(g, 0.9), 4) AS p90, round(quantile_cont(g, 0.99), 4) AS p99,
  round(avg((g > 60)::INT::DOUBLE), 6) AS over60, round(avg((g > 100)::INT::DOUBLE), 6) AS over100 FROM g WHERE g IS NOT NULL GROUP BY r""")
def transects(spark, sf_dir):
    cells, _ = relief(spark, sf_dir)
    found = validation.transect(cells, ["r"], "c", "z", 30.0)
    return found.select("r", "n", *(F.round(f"p{p}", 4).alias(f"p{p}") for p in (50, 75, 90, 99)), F.round("over60", 6).alias("over60"), F.round("over100", 6).alias("over100"))


@query(f"""WITH {SLOPE}, d AS (SELECT r AS leg, c AS seq, r + (c % 2) AS r, c FROM cells WHERE r < w - 1),
n AS (SELECT *, lead(r) OVER (PARTITION BY leg ORDER BY seq) AS nr, lead(c) OVER (PARTITION BY leg ORDER BY seq) AS nc FROM d),
k AS (SELECT leg, seq, r AS kr, nc AS kc, 0 AS k FROM n WHERE nr <> r AND nc <> c UNION ALL SELECT leg, seq, nr, c, 1 FROM n WHERE nr <> r AND nc <> c),
h AS (SELECT k.*, extra, row_number() OVER (PARTITION BY leg, seq ORDER BY extra DESC, k) AS i FROM k JOIN cells ON kr = cells.r AND kc = cells.c AND blocked)
SELECT leg, row_number() OVER (PARTITION BY leg ORDER BY seq) - 1 AS seq, r, c FROM (SELECT leg, seq::DOUBLE AS seq, r, c FROM d UNION ALL SELECT leg, seq + 0.5::DOUBLE, kr, kc FROM h WHERE i = 1)""")
def corner_cells(spark, sf_dir):
    cells, grid = relief(spark, sf_dir)
    zigzag = cells.where(F.col("r") < grid.rows - 1).select(F.col("r").alias("leg"), F.col("c").alias("seq"), (F.col("r") + F.col("c") % 2).alias("r"), "c")
    streams = cells.where("blocked").select("r", "c", F.col("extra").alias("area"))
    return sequences.with_corners(zigzag, ["leg"], streams).withColumn("seq", F.col("seq").cast("long"))


@query(f"""WITH {TRIANGLES} SELECT fid, k AS seq, round(ax + 211.7::DOUBLE * k / 9.0::DOUBLE, 6) AS x, round(ay - 31.1::DOUBLE * k / 9.0::DOUBLE, 6) AS y FROM tri, range(0, 10) q(k)""")
def straight_lines(spark, sf_dir):
    t = triangles(spark, sf_dir).where("y2 < y1 AND x2 > x1 + 200")
    return sequences.straight(t, 10, ["fid"]).select("fid", F.col("seq").cast("long").alias("seq"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


# Whole scenes; the fixpoints inside them have no SQL (see tests/test_golden.py for their values).

_PI2 = "6.283185307179586::DOUBLE"


@query(f"""WITH g AS (SELECT i // 300 AS r, i % 300 AS c, (i % 300) * 30.0::DOUBLE AS x, (i // 300) * 30.0::DOUBLE AS y FROM range(90000) t(i)),
b AS (SELECT *, sin(x * {_PI2} / 7000) * 900 + 4500 AS bed FROM g)
SELECT r, c, round(CAST(900 + (9000 - y) * 0.045::DOUBLE + exp(-(power(x - 2700, 2) + power(y - 2400, 2)) / (2 * 1450.0::DOUBLE * 1450)) * 780 + exp(-(power(x - 6600, 2) + power(y - 6300, 2)) / (2 * 1650.0::DOUBLE * 1650)) * 560
  + sin(x * {_PI2} / 2100) * cos(y * {_PI2} / 2700) * 95 + sin((x + y) * {_PI2} / 1300) * 38 - exp(-power(y - bed, 2) / (2 * 430.0::DOUBLE * 430)) * 230
  + (1 - 2 / (exp(2 * ((y - 6900) / 40)) + 1)) * exp(-power(x - 4200, 2) / (2 * 1100.0::DOUBLE * 1100)) * 130 AS FLOAT)::DOUBLE, 2) AS z FROM b""")
def analytic_relief(spark, sf_dir):
    cells, _ = analytic_scene(spark)
    return cells.select("r", "c", F.round(F.col("z").cast("double"), 2).alias("z"))


SCENE = scene.SceneOptions(stream_basin_km2=0.1, band_size=100.0, least_patch_ha=0.2)


def whole_scene(spark, sf_dir):
    cells, grid = relief(spark, sf_dir)
    return materialize(scene.surface(cells, grid, SCENE, "blocked"), "scene"), grid


@query()
def scene_classes(spark, sf_dir):
    made, _ = whole_scene(spark, sf_dir)
    return made.groupBy("class", "zone", "channel").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("score"), F.round(F.avg("risk"), 4).alias("risk"))


@query()
def scene_zones(spark, sf_dir):
    made, grid = whole_scene(spark, sf_dir)
    return scene.zones(made, grid, SCENE).select("region", "n_cells", "area_m2", "area_ha", F.size("rings").alias("rings"))


@query()
def scene_route(spark, sf_dir):
    made, grid = whole_scene(spark, sf_dir)
    end = 30.0 * (grid.rows - 3)
    return scene.route(made, grid, [(grid.x0 + 45.0, grid.y0 - 45.0), (grid.x0 + end, grid.y0 - end)], SCENE)["attributes"]


@query()
def published_scene(spark, sf_dir):
    """All products of the relief of the tables, published and counted."""
    cells, grid = relief(spark, sf_dir)
    made = scene.run(cells, grid, run_path(spark, "published-scene"), None, SCENE, "blocked")
    return reduce(DataFrame.unionByName, [frame.agg(F.count("*").alias("n")).select(F.lit(name).alias("product"), "n") for name, frame in made.items()])


@query()
def example_scene(spark, sf_dir):
    """All products of the analytic scene of 90,000 cells, written and counted."""
    cells, grid = analytic_scene(spark)
    target = run_path(spark, "example-scene")
    made = scene.run(materialize(cells, "analytic"), grid, target, [(500_900, 7_491_900), (506_600, 7_493_700), (508_100, 7_499_100)])
    counts = [F.lit(name).alias("product") for name in made]
    each = [frame.agg(F.count("*").alias("n")).select(label, "n") for label, frame in zip(counts, made.values())]
    return reduce(DataFrame.unionByName, each)
