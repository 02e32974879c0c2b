"""Queries over the relief that the ``orders`` table gives: derivatives, statistics, scores, classes, zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions import cellwise as fn
from ridgeline.operators import classes, score, stats, terrain
from ridgeline.operators.stencil import OFFSETS, along_row, sql_gradient
from ridgeline.session import materialize
from ridgeline.sources.grid import ORDERS_SQL, Grid, scene_from_orders

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# The steps of the relief as common table expressions.
SLOPE = f"""{ORDERS_SQL},
g1 AS MATERIALIZED (SELECT *, {sql_gradient("z", "x")} AS zx, {sql_gradient("z", "y")} AS zy FROM cells),
t1 AS MATERIALIZED (SELECT *, CAST(sqrt(zx * zx + zy * zy) * 100.0::DOUBLE AS FLOAT) AS slope FROM g1)"""
CURVE = f"""{SLOPE},
g2 AS MATERIALIZED (SELECT *, {sql_gradient("zx", "x")} AS zxx, {sql_gradient("zy", "x")} AS zyx, {sql_gradient("zy", "y")} AS zyy, zx * zx + zy * zy AS p FROM t1),
t2 AS MATERIALIZED (SELECT r, c, w, z, extra, blocked, zx, zy, slope,
  CAST(CASE WHEN zx IS NULL THEN NULL WHEN p > 1e-12 THEN (zxx * zy * zy - zyx * zx * zy * 2.0::DOUBLE + zyy * zx * zx) / (p * sqrt(p + 1.0::DOUBLE)) ELSE 0 END AS FLOAT) AS plan,
  CAST(CASE WHEN zx IS NULL THEN NULL WHEN p > 1e-12 THEN (zxx * zx * zx + zyx * zx * zy * 2.0::DOUBLE + zyy * zy * zy) / (p * (p + 1.0::DOUBLE) * sqrt(p + 1.0::DOUBLE)) ELSE 0 END AS FLOAT) AS profile
  FROM g2)"""


def sql_near(name: str) -> str:
    """Subquery of ``cells``-like rows with the array ``near`` of the eight neighbours, in OFFSETS order."""
    pick = {-1: "lag", 1: "lead"}
    flat = ", ".join(f"{pick[d]}({name}) OVER (PARTITION BY r ORDER BY c) AS {'we'[d > 0]}" for d in (-1, 1))
    tall = ", ".join(f"{pick[d]}({n}) OVER (PARTITION BY c ORDER BY r) AS {'ns'[d > 0]}{n}" for d in (-1, 1) for n in ("w", "here", "e"))
    order = "nw, nhere, ne, w, e, sw, shere, se"
    return f"SELECT r, c, here, [{order}] AS near FROM (SELECT *, {tall} FROM (SELECT r, c, {name} AS here, {flat} FROM {{source}}))"


def relief(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Grid]:
    return scene_from_orders(spark, sf_dir)


def derived(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Grid]:
    """The relief with its derivatives, written once: what follows reads it several times."""
    cells, grid = relief(spark, sf_dir)
    return materialize(terrain.derive(cells, grid), "derived"), grid


CLASS_SQL = "CASE WHEN slope IS NULL THEN 0 ELSE 1 + (slope >= 20)::INT + (slope >= 35)::INT + (slope >= 60)::INT + (slope >= 100)::INT END"


@query(f"WITH {SLOPE}, k AS (SELECT {CLASS_SQL} AS class FROM t1) SELECT class, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM k WHERE class > 0 GROUP BY class")
def class_shares(spark, sf_dir):
    cells, grid = relief(spark, sf_dir)
    found = stats.class_shares(classes.classify(terrain.slope(cells, grid)))
    return found.select("class", "n", F.round("share", 6).alias("share"))


@query(f"WITH {SLOPE} SELECT avg(CASE WHEN slope < 35 THEN 1.0::DOUBLE ELSE 0 END) AS walkable FROM t1 WHERE slope IS NOT NULL")
def walkable_fraction(spark, sf_dir):
    cells, grid = relief(spark, sf_dir)
    return classes.classify(terrain.slope(cells, grid)).agg(stats.walkable_fraction().alias("walkable"))


@query(f"WITH {SLOPE} SELECT r, c, round(zx, 10) AS zx, round(zy, 10) AS zy, round(CAST(slope AS DOUBLE), 3) AS slope FROM t1")
def slope_percent(spark, sf_dir):
    cells, grid = relief(spark, sf_dir)
    return terrain.slope(cells, grid).select("r", "c", F.round("zx", 10).alias("zx"), F.round("zy", 10).alias("zy"), F.round(F.col("slope").cast("double"), 3).alias("slope"))


@query(f"WITH {CURVE} SELECT r, c, round(CAST(plan AS DOUBLE), 6) AS plan, round(CAST(profile AS DOUBLE), 6) AS profile FROM t2")
def curvatures(spark, sf_dir):
    cells, _ = derived(spark, sf_dir)
    return cells.select("r", "c", F.round(F.col("plan").cast("double"), 6).alias("plan"), F.round(F.col("profile").cast("double"), 6).alias("profile"))


@query(f"""WITH {ORDERS_SQL}, n AS ({sql_near("CAST(z AS DOUBLE)").format(source="cells")})
SELECT r, c, CASE WHEN here IS NULL THEN NULL ELSE round(list_avg(list_transform(list_filter(near, lambda x: x IS NOT NULL), lambda x: abs(here - x))), 6) END AS tri FROM n""")
def ruggedness(spark, sf_dir):
    cells, _ = relief(spark, sf_dir)
    return terrain.ruggedness(cells).select("r", "c", F.round("tri", 6).alias("tri"))


@query(f"""WITH {SLOPE}, k AS (SELECT r, c, CASE WHEN zx IS NULL THEN NULL ELSE [sin(atan(sqrt(zx * zx + zy * zy))) * cos(atan2(-zy, zx)), sin(atan(sqrt(zx * zx + zy * zy))) * sin(atan2(-zy, zx)), cos(atan(sqrt(zx * zx + zy * zy)))] END AS v FROM t1),
n AS ({sql_near("v").format(source="k")}),
f AS (SELECT r, c, here, list_filter(list_append(near, here), lambda x: x IS NOT NULL) AS l FROM n)
SELECT r, c, CASE WHEN here IS NULL THEN NULL ELSE abs(round(least(greatest(1 - sqrt(
  power(list_sum(list_transform(l, lambda x: x[1])), 2) + power(list_sum(list_transform(l, lambda x: x[2])), 2) + power(list_sum(list_transform(l, lambda x: x[3])), 2)) / len(l), 0), 1), 6)) END AS vrm FROM f""")
def vector_ruggedness(spark, sf_dir):
    cells, grid = relief(spark, sf_dir)
    return terrain.vector_ruggedness(terrain.slope(cells, grid)).select("r", "c", F.abs(F.round("vrm", 6)).alias("vrm"))


def _plain(along: str) -> str:
    over = "(PARTITION BY r ORDER BY c)" if along == "x" else "(PARTITION BY c ORDER BY r)"
    at, v = ("c" if along == "x" else "r"), "CAST(z AS DOUBLE)"
    a, b = f"lag({v}) OVER {over}", f"lead({v}) OVER {over}"
    return f"CASE WHEN {at} = 0 THEN ({b} - {v}) / 30.0::DOUBLE WHEN {at} = w - 1 THEN ({v} - {a}) / 30.0::DOUBLE ELSE ({b} - {a}) / 60.0::DOUBLE END"


@query(f"""WITH {ORDERS_SQL}, g AS (SELECT r, c, z, {_plain("x")} AS gx, {_plain("y")} AS gy FROM cells)
SELECT r, c, CASE WHEN z IS NULL OR gx IS NULL OR gy IS NULL THEN NULL WHEN gx = 0 AND gy = 0 THEN 0 ELSE round(gy / sqrt(gx * gx + gy * gy), 6) END AS northness FROM g""")
def northness(spark, sf_dir):
    cells, grid = relief(spark, sf_dir)
    return terrain.northness(cells, grid).select("r", "c", F.round("northness", 6).alias("northness"))


@query(f"""WITH {ORDERS_SQL}, f AS (SELECT r, c, z AS known, coalesce(CAST(z AS DOUBLE), avg(CAST(z AS DOUBLE)) OVER ()) AS z FROM cells),
a AS (SELECT *, {sql_gradient("z", "x")} AS gx, {sql_gradient("z", "y")} AS gy FROM f),
b AS (SELECT *, {sql_gradient("gx", "x")} AS dxx, {sql_gradient("gy", "y")} AS dyy FROM a)
SELECT r, c, CASE WHEN known IS NOT NULL THEN round(CAST(CAST(degrees(atan(sqrt(gx * gx + gy * gy))) AS FLOAT) AS DOUBLE), 3) END AS slope_deg,
       CASE WHEN known IS NOT NULL THEN round(dxx, 6) END AS dxx, CASE WHEN known IS NOT NULL THEN round(dyy, 6) END AS dyy FROM b""")
def filled_slope_degrees(spark, sf_dir):
    cells, grid = relief(spark, sf_dir)
    return terrain.filled_slope_degrees(cells, grid).select("r", "c", F.round(F.col("slope_deg").cast("double"), 3).alias("slope_deg"), F.round("dxx", 6).alias("dxx"), F.round("dyy", 6).alias("dyy"))


@query(f"""WITH {ORDERS_SQL}, q AS (SELECT r, c, CAST(floor(z / 100) AS INT) AS z FROM cells), n AS ({sql_near("z").format(source="q")})
SELECT r, c, here IS NOT NULL AND coalesce(list_max(near), here) <= here AND coalesce(list_min(near), here) >= here AS flat FROM n""")
def flat_cells(spark, sf_dir):
    cells, _ = relief(spark, sf_dir)
    return terrain.flat(cells.withColumn("z", F.floor(F.col("z").cast("double") / 100).cast("int"))).select("r", "c", "flat")


_STEPS = ", ".join("42.42640687119285::DOUBLE" if dr and dc else "30.0::DOUBLE" for dr, dc in OFFSETS.values())


@query(f"""WITH {ORDERS_SQL}, n AS ({sql_near("CAST(z AS DOUBLE)").format(source="cells")}),
d AS (SELECT r, c, here, list_transform(range(1, 9), lambda i: coalesce((here - near[i]) / [{_STEPS}][i], -1)) AS drops FROM n)
SELECT r, c, CASE WHEN here IS NULL THEN NULL WHEN list_max(drops) > 0 THEN CAST(list_position(drops, list_max(drops)) - 1 AS INT) ELSE -1 END AS d8 FROM d""")
def flow_direction(spark, sf_dir):
    cells, grid = relief(spark, sf_dir)
    return terrain.flow_direction(cells, grid).select("r", "c", "d8")


_DIAG = "count(*) AS total, count(v) AS valid, count(*) - count(v) AS nodata, round(min(v), 6) AS v_min, round(max(v), 6) AS v_max, round(avg(v), 6) AS v_mean, round(stddev_pop(v), 6) AS v_std, " + ", ".join(
    f"round(quantile_cont(v, {p / 100}), 6) AS p{p}" for p in stats.PERCENTS
)


@query(f"WITH {CURVE} SELECT raster, {_DIAG} FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS raster, CAST({n} AS DOUBLE) AS v FROM t2" for n in ("z", "slope", "plan", "profile", "extra")) + ") GROUP BY raster")
def raster_diagnostics(spark, sf_dir):
    cells, _ = derived(spark, sf_dir)
    found = stats.diagnostics(cells, ["z", "slope", "plan", "profile", "extra"])
    return found.select("raster", "total", "valid", "nodata", *(F.round(c, 6).alias(c) for c in found.columns[4:]))


def _limit_sql(v: str, p: int, where: str = "TRUE") -> str:
    q, m = f"quantile_cont(abs(CAST({v} AS DOUBLE)), {p / 100}) FILTER ({where})", f"max(abs(CAST({v} AS DOUBLE))) FILTER ({where})"
    return f"CASE WHEN {q} > 0 THEN {q} WHEN {m} > 0 THEN {m} ELSE 1.0::DOUBLE END"


SCORED = f"""{CURVE},
lim AS (SELECT {_limit_sql("plan", 99)} AS plan99, {_limit_sql("profile", 99)} AS profile99, {_limit_sql("plan", 95)} AS plan95, {_limit_sql("profile", 95)} AS profile95,
        quantile_cont(extra, 0.05) FILTER (z IS NOT NULL) AS extra5, quantile_cont(extra, 0.95) FILTER (z IS NOT NULL) AS extra95 FROM t2),
s1 AS (SELECT t2.*, z IS NOT NULL AS valid,
  least(greatest((z::DOUBLE - 0) / 2600.0::DOUBLE, 0), 1) AS s_alt, 1 - least(greatest(slope::DOUBLE / 50.0::DOUBLE, 0), 1) AS s_slope,
  (1 - least(greatest(abs(plan::DOUBLE) / plan99, 0), 1)) * 0.8::DOUBLE + 0.2::DOUBLE AS s_plan, (1 - least(greatest(abs(profile::DOUBLE) / profile99, 0), 1)) * 0.8::DOUBLE + 0.2::DOUBLE AS s_profile,
  1 - least(greatest((extra - extra5) / (extra95 - extra5), 0), 1) AS s_extra,
  least(greatest(abs(plan::DOUBLE) / plan95, 0), 1) AS k_plan, least(greatest(abs(profile::DOUBLE) / profile95, 0), 1) AS k_profile FROM t2, lim),
s2 AS MATERIALIZED (SELECT *, CASE WHEN valid THEN CAST((s_alt * 0.5::DOUBLE + s_slope + s_plan + s_profile + s_extra * 0.5::DOUBLE) / 4.0::DOUBLE AS FLOAT) END AS raw_score,
  CASE WHEN valid THEN CAST(least(greatest(power(least(greatest(slope::DOUBLE / 85.0::DOUBLE, 0), 1), 1.35::DOUBLE) * 0.75::DOUBLE + (k_plan + k_profile) / 2 * 0.25::DOUBLE, 0), 1) AS FLOAT) END AS risk,
  valid AND z BETWEEN 0 AND 2600 AND slope <= 85 AS in_zone_range FROM s1),
s3 AS MATERIALIZED (SELECT *, CASE WHEN in_zone_range THEN raw_score END AS score FROM s2)"""

OPTIONS = score.ScoreOptions(weights={"altitude": 0.5, "slope": 1.0, "plan": 1.0, "profile": 1.0}, extra="extra", extra_weight=0.5)


def scored(spark, sf_dir):
    cells, _ = derived(spark, sf_dir)
    return score.score(cells, OPTIONS)


@query(f"WITH {SCORED} SELECT r, c, round(CAST(score AS DOUBLE), 4) AS score, round(CAST(risk AS DOUBLE), 4) AS risk, in_zone_range IS TRUE AS in_zone_range FROM s3")
def suitability_and_risk(spark, sf_dir):
    s = scored(spark, sf_dir)
    return s.select("r", "c", F.round(F.col("score").cast("double"), 4).alias("score"), F.round(F.col("risk").cast("double"), 4).alias("risk"), F.coalesce("in_zone_range", F.lit(False)).alias("in_zone_range"))


@query(f"WITH {SCORED} SELECT round(plan99, 9) AS plan99, round(profile99, 9) AS profile99, round(plan95, 9) AS plan95, round(profile95, 9) AS profile95, round(extra5, 6) AS extra5, round(extra95, 6) AS extra95 FROM lim")
def scene_limits(spark, sf_dir):
    cells, _ = derived(spark, sf_dir)
    found = score.scene_limits(cells.withColumn("valid", F.col("z").isNotNull()), OPTIONS)
    return found.select(*(F.round(f"limit_{n}", 9 if "p" in n else 6).alias(n) for n in ("plan99", "profile99", "plan95", "profile95", "extra5", "extra95")))


BANDS = f"""{SCORED},
bands AS (SELECT CAST(floor(z::DOUBLE / 100.0::DOUBLE) AS BIGINT) AS band, count(*) AS n, quantile_cont(score::DOUBLE, 0.75) AS threshold FROM s3 WHERE score IS NOT NULL GROUP BY 1 HAVING count(*) >= 50),
zones AS MATERIALIZED (SELECT s3.*, coalesce(score >= CAST(threshold AS FLOAT), FALSE) AS zone FROM s3 LEFT JOIN bands ON floor(z::DOUBLE / 100.0::DOUBLE) = band)"""


@query(f"WITH {BANDS} SELECT band, band * 100.0::DOUBLE AS low, (band + 1) * 100.0::DOUBLE AS high, n, round(threshold, 5) AS threshold FROM bands")
def band_thresholds(spark, sf_dir):
    found = stats.band_thresholds(materialize(scored(spark, sf_dir), "scored"), 75.0, 100.0)
    return found.select("band", "low", "high", "n", F.round("threshold", 5).alias("threshold"))


def zoned(spark, sf_dir):
    return stats.select_zones(materialize(scored(spark, sf_dir), "scored"), 75.0, 100.0)


@query(f"WITH {BANDS} SELECT CAST(floor(z::DOUBLE / 100.0::DOUBLE) AS BIGINT) AS band, count(*) AS cells, sum(zone::INT)::BIGINT AS in_zone FROM zones GROUP BY 1")
def zones_by_band(spark, sf_dir):
    z = zoned(spark, sf_dir)
    return z.groupBy(F.floor(F.col("z").cast("double") / 100.0).alias("band")).agg(F.count("*").alias("cells"), F.sum(F.col("zone").cast("int")).alias("in_zone"))


@query(f"WITH {SCORED} SELECT sum((score >= CAST(t AS FLOAT))::INT)::BIGINT AS cells, round(any_value(t), 5) AS threshold FROM s3, (SELECT quantile_cont(score::DOUBLE, 0.75) AS t FROM s3)")
def scene_threshold(spark, sf_dir):
    s = materialize(scored(spark, sf_dir), "scored")
    zones = stats.select_zones(s, 75.0, None).agg(F.sum(F.col("zone").cast("int")).alias("cells"))
    limit = stats.percentiles(s, {"threshold": (F.col("score"), 75)})
    return zones.join(F.broadcast(limit.select(F.round("threshold", 5).alias("threshold"))))  # one row each


@query(f"""WITH {SCORED}, d AS (SELECT count(*) AS n, avg((score >= 0.999::DOUBLE)::INT::DOUBLE) AS saturated, quantile_cont(score::DOUBLE, 0.95) - quantile_cont(score::DOUBLE, 0.05) AS amplitude,
  quantile_cont(score::DOUBLE, 0.5) AS p50, quantile_cont(score::DOUBLE, 0.9) AS p90, quantile_cont(score::DOUBLE, 0.99) AS p99 FROM s3 WHERE score IS NOT NULL)
SELECT n, round(saturated, 6) AS saturated, round(amplitude, 4) AS amplitude, round(p50, 4) AS p50, round(p90, 4) AS p90, round(p99, 4) AS p99, saturated >= 0.4 OR amplitude < 0.05 AS weak FROM d""")
def discrimination(spark, sf_dir):
    found = stats.discrimination(materialize(scored(spark, sf_dir), "scored"))
    return found.select("n", F.round("saturated", 6).alias("saturated"), *(F.round(c, 4).alias(c) for c in ("amplitude", "p50", "p90", "p99")), "weak")


@query(f"WITH {SLOPE} SELECT 'extra' AS raster, count(*) AS n, round(arg_max(extra, abs(extra)), 4) AS extreme FROM t1 WHERE abs(extra) > 100000 HAVING count(*) > 0")
def absurd_values(spark, sf_dir):
    cells, _ = relief(spark, sf_dir)
    return stats.absurd_values(cells, ["z", "extra"], 100_000.0).select("raster", "n", F.round("extreme", 4).alias("extreme"))


@query(f"WITH {SLOPE}, d AS (SELECT avg((z BETWEEN 5000 AND 6000)::INT::DOUBLE) AS a, avg((slope <= 3)::INT::DOUBLE) AS s FROM t1 WHERE z IS NOT NULL) SELECT round(a, 6) AS in_altitude, round(s, 6) AS under_slope, CASE WHEN a < 0.01 THEN 'altitude' WHEN s < 0.05 THEN 'slope' END AS reason FROM d")
def empty_mask_reasons(spark, sf_dir):
    cells, grid = relief(spark, sf_dir)
    found = stats.empty_mask_reasons(terrain.slope(cells, grid), 5000.0, 6000.0, 3.0)
    return found.select(F.round("in_altitude", 6).alias("in_altitude"), F.round("under_slope", 6).alias("under_slope"), "reason")


@query(f"""WITH {BANDS}, v AS (SELECT z::DOUBLE AS v, zone FROM zones WHERE z IS NOT NULL),
f AS (SELECT v, sum(sum(zone::INT)) OVER (ORDER BY v) / sum(sum(zone::INT)) OVER () AS fa, sum(sum((NOT zone)::INT)) OVER (ORDER BY v) / sum(sum((NOT zone)::INT)) OVER () AS fb FROM v GROUP BY v)
SELECT round(max(abs(fa - fb)), 6) AS ks FROM f""")
def zone_ks(spark, sf_dir):
    return stats.ks_distance(zoned(spark, sf_dir), "z").select(F.round("ks", 6).alias("ks"))


def _cover_sql(edges: str) -> str:
    return f"""WITH {BANDS}, v AS (SELECT z::DOUBLE AS v, zone FROM zones WHERE z IS NOT NULL), e AS (SELECT {edges} AS edges FROM v),
k AS (SELECT CAST(len(list_filter(edges[2:10], lambda x: v >= x)) AS INT) AS bin, any_value(edges) AS edges, count(*) AS n, sum(zone::INT) AS nz FROM v, e GROUP BY 1),
s AS (SELECT bin, edges[bin + 1] AS low, edges[bin + 2] AS high, n / sum(n) OVER () AS a, nz / sum(nz) OVER () AS b FROM k),
t AS (SELECT *, a < 0.005 OR b >= a * 0.2 AS covered FROM s),
u AS (SELECT *, (NOT covered AND coalesce(lag(covered) OVER (ORDER BY bin), TRUE))::INT AS st FROM t)
SELECT bin, round(low, 4) AS low, round(high, 4) AS high, round(a, 6) AS area_share, round(b, 6) AS zone_share, covered, CASE WHEN NOT covered THEN CAST(sum(st) OVER (ORDER BY bin) AS BIGINT) END AS gap FROM u"""


def _cover(frame):
    return frame.select("bin", *(F.round(c, 4).alias(c) for c in ("low", "high")), *(F.round(c, 6).alias(c) for c in ("area_share", "zone_share")), "covered", "gap")


@query(_cover_sql("list_transform(range(0, 11), lambda i: min(v) + (max(v) - min(v)) * i / 10.0::DOUBLE)"))
def altitude_coverage(spark, sf_dir):
    return _cover(stats.representativeness(zoned(spark, sf_dir), "z"))


@query(_cover_sql("quantile_cont(v, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])"))
def decile_coverage(spark, sf_dir):
    return _cover(stats.representativeness(zoned(spark, sf_dir), "z", equal_width=False))


@query(f"""WITH {SLOPE}, k AS (SELECT *, {CLASS_SQL} AS k0 FROM t1), l AS (SELECT quantile_cont(extra, 0.9) AS p90, quantile_cont(z::DOUBLE, 0.95) AS p95 FROM k WHERE k0 > 0),
a AS (SELECT *, CASE WHEN k0 BETWEEN 1 AND 3 AND extra > p90 THEN k0 + 1 ELSE k0 END AS k1 FROM k, l),
b AS (SELECT *, CASE WHEN k1 BETWEEN 1 AND 3 AND z > p95 THEN k1 + 1 ELSE k1 END AS k2 FROM a)
SELECT r, c, CASE WHEN k2 > 0 AND blocked THEN 5 ELSE k2 END AS class FROM b""")
def modified_classes(spark, sf_dir):
    cells, grid = relief(spark, sf_dir)
    return classes.classify(terrain.slope(cells, grid), roughness="extra", wetness="z", blocked="blocked").select("r", "c", "class")


@query(f"""WITH {SCORED} SELECT r, c, round(1 / (raw_score + 0.05::DOUBLE), 3) AS inverse, round(exp((1 - raw_score::DOUBLE) * 6.0::DOUBLE) * CASE WHEN blocked THEN 8.0::DOUBLE ELSE 1 END, 3) AS exponential,
  round((1 - raw_score::DOUBLE) * 2 + 1, 4) AS tobler FROM s3""")
def route_costs(spark, sf_dir):
    s = scored(spark, sf_dir)
    v = F.col("raw_score").cast("double")
    penalty = F.when(F.col("blocked"), fn.PENALTY).otherwise(1.0)
    return s.select("r", "c", F.round(fn.route_cost(v, "inverse"), 3).alias("inverse"), F.round(fn.route_cost(v, "exponential", 6.0, penalty), 3).alias("exponential"), F.round(fn.route_cost(v, "tobler"), 4).alias("tobler"))


@query(f"""WITH {ORDERS_SQL}, d AS (SELECT r, c, z::DOUBLE AS z, lead(z::DOUBLE) OVER (PARTITION BY r ORDER BY c) - z::DOUBLE AS dz FROM cells)
SELECT r, c, round(30.0::DOUBLE / 1000.0::DOUBLE / (exp(abs(dz / 30.0::DOUBLE + 0.05::DOUBLE) * -3.5::DOUBLE) * 6.0::DOUBLE), 8) AS hours, round(CAST(z * 0.3048::DOUBLE AS FLOAT)::DOUBLE, 3) AS metres,
  CASE WHEN z IS NOT NULL THEN round(tan(radians(least(greatest(z / 20, 0), 89.9::DOUBLE))) * 100, 4) END AS percent, round(500000 + (c + 0.5::DOUBLE) * 30, 3) AS x, round(7500000 - (r + 0.5::DOUBLE) * 30, 3) AS y FROM d""")
def cell_functions(spark, sf_dir):
    cells, grid = relief(spark, sf_dir)
    z = F.col("z").cast("double")
    rows = cells.withColumn("dz", F.lead(z).over(along_row()) - z)
    x, y = grid.to_world(F.col("r"), F.col("c"))
    return rows.select(
        "r", "c", F.round(fn.tobler_hours(F.col("dz"), F.lit(30.0)), 8).alias("hours"), F.round(fn.feet_to_metres(z).cast("double"), 3).alias("metres"),
        F.round(fn.degrees_to_percent(z / 20), 4).alias("percent"), F.round(x, 3).alias("x"), F.round(y, 3).alias("y"),
    )


@query("SELECT o_orderkey, (floor(floor(o_totalprice / 1000 * 60 + 0.5) / 60)::BIGINT)::VARCHAR || 'h' || lpad((floor(o_totalprice / 1000 * 60 + 0.5)::BIGINT % 60)::VARCHAR, 2, '0') AS text, least(greatest(o_totalprice * 0.0005::DOUBLE, 1), 50) AS patch FROM orders")
def texts_and_patches(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select("o_orderkey", fn.hours_text(F.col("o_totalprice") / 1000).alias("text"), fn.minimum_patch_ha(F.col("o_totalprice")).alias("patch"))


@query(f"""WITH {SCORED} SELECT count(*) AS passable, sum((in_zone_range AND NOT blocked)::INT)::BIGINT AS zone_cells, sum(CASE WHEN blocked THEN 8.0::DOUBLE ELSE 1 END) AS penalty FROM s3 WHERE valid AND slope <= 85""")
def constraints(spark, sf_dir):
    s = scored(spark, sf_dir)
    avoid = score.constrain(s, "blocked").where("passable")
    cost = score.constrain(s, "blocked", mode="penalise").where("passable")
    a = avoid.agg(F.count("*").alias("passable"), F.sum(F.col("in_zone_range").cast("int")).alias("zone_cells"))
    return a.join(F.broadcast(cost.agg(F.sum("penalty").alias("penalty"))))


@query(f"""WITH {SLOPE}, a AS (SELECT r, c FROM t1 WHERE slope < 35), b AS (SELECT r, c FROM t1 WHERE blocked)
SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT 'difference', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def mask_sets(spark, sf_dir):
    cells, grid = relief(spark, sf_dir)
    rows = terrain.slope(cells, grid).select(F.coalesce(F.col("slope") < 35, F.lit(False)).alias("a"), F.col("blocked").alias("b"))
    # Masks of one grid are columns, so set operations are Boolean expressions: no shuffle.
    each = F.array(*(F.struct(F.lit(n).alias("op"), v.alias("hit")) for n, v in (("union", F.col("a") | F.col("b")), ("intersect", F.col("a") & F.col("b")), ("difference", F.col("a") & ~F.col("b")))))
    return rows.select(F.explode(each).alias("e")).select("e.*").groupBy("op").agg(F.sum(F.col("hit").cast("int")).alias("n"))
