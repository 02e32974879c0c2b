"""Queries on drainage, regions, distances, routes and sequences over the relief of ``orders``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.functions.cellwise import tobler_speed
from ridgeline.operators import distance, hydrology, regions, routing, sequences, terrain, validation
from ridgeline.operators.stencil import OFFSETS, along_row, sql_gradient
from ridgeline.plans.surface import SLOPE, relief, sql_near
from ridgeline.session import materialize
from ridgeline.sources.grid import ORDERS_SQL, Grid

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


OFFSET_SQL = "o(i, dr, dc) AS (VALUES " + ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(OFFSETS.values())) + ")"


def costs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Grid]:
    """The relief with ``cost`` on cells up to 60 % that are not blocked."""
    cells, grid = relief(spark, sf_dir)
    sloped = terrain.slope(cells, grid)
    cost = F.when((F.col("slope") <= 60) & ~F.col("blocked"), F.col("slope").cast("double") / 20.0 + 1.0)
    return sloped.select("r", "c", "z", "slope", "extra", "blocked", cost.alias("cost")), grid


COST = f"{SLOPE}, k AS MATERIALIZED (SELECT r, c, w, z, extra, blocked, CASE WHEN slope <= 60 AND NOT blocked THEN slope::DOUBLE / 20.0::DOUBLE + 1.0::DOUBLE END AS cost FROM t1)"


@query(f"""WITH {COST}, {OFFSET_SQL},
e AS (SELECT a.r * a.w + a.c AS src, b.r * a.w + b.c AS dst, (a.cost + b.cost) / 2 * CASE WHEN dr <> 0 AND dc <> 0 THEN 42.42640687119285::DOUBLE ELSE 30 END AS w, a.r AS r, a.c AS c, dr, dc
      FROM k a, o JOIN k b ON b.r = a.r + dr AND b.c = a.c + dc WHERE a.cost IS NOT NULL AND b.cost IS NOT NULL)
SELECT src, dst, round(e.w, 4) AS w FROM e LEFT JOIN k p ON p.r = e.r + dr AND p.c = e.c LEFT JOIN k q ON q.r = e.r AND q.c = e.c + dc
WHERE dr = 0 OR dc = 0 OR (p.cost IS NOT NULL AND q.cost IS NOT NULL)""")
def route_edges(spark, sf_dir):
    cells, grid = costs(spark, sf_dir)
    return routing.edges(cells, grid).select("src", "dst", F.round("w", 4).alias("w"))


_ROUNDS = 20  # 2 ** 20 steps: no way down is longer than all cells of these tables
_DOUBLING = ",\n".join(
    f"""s{i + 1} AS MATERIALIZED (SELECT a.id, n.ptr, a.total + coalesce(u.more, 0) AS total FROM s{i} a LEFT JOIN s{i} n ON a.ptr = n.id
  LEFT JOIN (SELECT ptr, sum(total)::BIGINT AS more FROM s{i} WHERE ptr IS NOT NULL GROUP BY ptr) u ON a.id = u.ptr)"""
    for i in range(_ROUNDS)
)


@query(f"""WITH {ORDERS_SQL}, {OFFSET_SQL},
d AS (SELECT a.r * a.w + a.c AS id, b.r * a.w + b.c AS ptr, row_number() OVER (PARTITION BY a.r, a.c ORDER BY (a.z::DOUBLE - b.z::DOUBLE) / CASE WHEN dr <> 0 AND dc <> 0 THEN 42.42640687119285::DOUBLE ELSE 30 END DESC, i) AS k
      FROM cells a, o JOIN cells b ON b.r = a.r + dr AND b.c = a.c + dc WHERE a.z > b.z),
s0 AS MATERIALIZED (SELECT r * w + c AS id, d.ptr, 1::BIGINT AS total FROM cells LEFT JOIN d ON d.id = r * w + c AND k = 1 WHERE z IS NOT NULL),
{_DOUBLING}
SELECT id // w AS r, id % w AS c, total AS upstream FROM s{_ROUNDS}, dims""")
def flow_accumulation(spark, sf_dir):
    cells, grid = relief(spark, sf_dir)
    return hydrology.flow(cells, grid, "z").select("r", "c", "upstream")


@query(f"""WITH {ORDERS_SQL}, f AS (SELECT r, c FROM cells WHERE blocked)
SELECT a.r, a.c, round(sqrt(min((a.r - f.r) * (a.r - f.r) * 900.0::DOUBLE + (a.c - f.c) * (a.c - f.c) * 900.0::DOUBLE)), 6) AS distance FROM cells a, f GROUP BY a.r, a.c""")
def distance_to_marks(spark, sf_dir):
    cells, grid = relief(spark, sf_dir)
    return distance.distance_to(cells, grid, "blocked").select("r", "c", F.round("distance", 6).alias("distance"))


@query(f"""WITH {ORDERS_SQL}, f AS (SELECT r, c FROM cells WHERE blocked)
SELECT DISTINCT a.r, a.c FROM cells a JOIN f ON a.r BETWEEN f.r - 4 AND f.r + 4 AND a.c BETWEEN f.c - 4 AND f.c + 4 WHERE (a.r - f.r) * (a.r - f.r) * 900 + (a.c - f.c) * (a.c - f.c) * 900 <= 100 * 100""")
def buffer_of_marks(spark, sf_dir):
    cells, grid = relief(spark, sf_dir)
    return distance.buffer(cells, grid, "blocked", 100.0)


@query(f"""WITH {ORDERS_SQL}, p AS (SELECT r * w + c AS ord, r, c FROM cells WHERE z IS NULL),
d AS (SELECT p.ord, a.r AS ar, a.c AS ac, (a.r - p.r) * (a.r - p.r) * 900.0::DOUBLE + (a.c - p.c) * (a.c - p.c) * 900.0::DOUBLE AS d2 FROM p JOIN cells a ON a.r BETWEEN p.r - 5 AND p.r + 5 AND a.c BETWEEN p.c - 5 AND p.c + 5 WHERE a.z IS NOT NULL AND NOT a.blocked),
k AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY d2, ar, ac) AS n FROM d)
SELECT p.ord, p.r, p.c, ar AS snap_r, ac AS snap_c, round(sqrt(d2), 6) AS moved_m FROM p LEFT JOIN k ON k.ord = p.ord AND n = 1""")
def snapped_points(spark, sf_dir):
    cells, grid = relief(spark, sf_dir)
    free = cells.withColumn("free", F.col("z").isNotNull() & ~F.col("blocked"))
    lost = cells.where("z is null").select((F.col("r") * grid.cols + F.col("c")).alias("ord"), "r", "c")
    return distance.snap(lost, free, grid, "free", 5).select("ord", "r", "c", "snap_r", "snap_c", F.round("moved_m", 6).alias("moved_m"))


def rows_as_paths(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Grid]:
    cells, grid = costs(spark, sf_dir)
    return cells.select(F.col("r").alias("leg"), F.col("c").alias("seq"), "r", "c", "z", "slope", "extra", "blocked").where("z is not null"), grid


PATHS = f"{SLOPE}, path AS MATERIALIZED (SELECT r AS leg, c AS seq, r, c, z, slope, extra, blocked FROM t1 WHERE z IS NOT NULL)"


@query(f"""WITH {PATHS}, s AS (SELECT *, sqrt((c - lag(c) OVER w) * (c - lag(c) OVER w))::DOUBLE * 30 AS m, z::DOUBLE - lag(z::DOUBLE) OVER w AS dz FROM path WINDOW w AS (PARTITION BY leg ORDER BY seq))
SELECT leg, count(*) AS vertices, round(sum(m), 3) AS length_m, round(sum(m / 1000 / (exp(abs(dz / m + 0.05::DOUBLE) * -3.5::DOUBLE) * 6)), 6) AS hours, round(sum(greatest(dz, 0)), 3) AS gain_m, round(sum(greatest(-dz, 0)), 3) AS loss_m,
  min(z) AS alt_min, max(z) AS alt_max, arg_min(z, seq) AS alt_start, arg_max(z, seq) AS alt_end FROM s GROUP BY leg""")
def path_metrics(spark, sf_dir):
    path, grid = rows_as_paths(spark, sf_dir)
    m = routing.path_metrics(path, grid, ["leg"])
    return m.select("leg", "vertices", *(F.round(c, 3).alias(c) for c in ("length_m", "gain_m", "loss_m")), F.round("hours", 6).alias("hours"), "alt_min", "alt_max", "alt_start", "alt_end")


@query(f"""WITH {PATHS}, s AS (SELECT *, (c - lag(c) OVER w) * 30.0::DOUBLE AS m, slope > 40 OR lag(slope) OVER w > 40 AS hi FROM path WINDOW w AS (PARTITION BY leg ORDER BY seq))
SELECT leg, max(slope) AS steepest, coalesce(sum(m) FILTER (hi), 0) AS metres_above FROM s GROUP BY leg""")
def slope_detours(spark, sf_dir):
    path, grid = rows_as_paths(spark, sf_dir)
    return routing.detour(path, grid, ["leg"], 40.0)


CONTACTS = f"""{PATHS}, m AS (SELECT *, blocked AND NOT coalesce(lag(blocked) OVER w, FALSE) AS st FROM path WINDOW w AS (PARTITION BY leg ORDER BY seq)),
runs AS (SELECT *, sum(st::INT) OVER (PARTITION BY leg ORDER BY seq) AS contact FROM m),
con AS MATERIALIZED (SELECT leg, contact::BIGINT AS contact, min(seq) AS first, max(seq) AS last, count(*) AS n_cells, max(extra) AS area, arg_min(r, seq) AS entry_r, arg_min(c, seq) AS entry_c FROM runs WHERE blocked GROUP BY leg, contact)"""


@query(f"WITH {CONTACTS} SELECT * FROM con")
def stream_contacts(spark, sf_dir):
    path, _ = rows_as_paths(spark, sf_dir)
    return sequences.contacts(path, ["leg"], "blocked", "extra")


@query(f"""WITH {CONTACTS}, g AS (SELECT *, CASE WHEN (first - lag(last) OVER w) * 30.0::DOUBLE <= 150 AND greatest(area, lag(area) OVER w) <= least(area, lag(area) OVER w) * 2 THEN 0 ELSE 1 END AS new FROM con WINDOW w AS (PARTITION BY leg ORDER BY contact)),
e AS (SELECT *, sum(new) OVER (PARTITION BY leg ORDER BY contact) AS event FROM g)
SELECT leg, event::BIGINT AS event, count(*) AS n_contacts, min(first) AS first, max(last) AS last, max(area) AS area, arg_min(entry_r, first) AS entry_r, arg_min(entry_c, first) AS entry_c, (max(last) - min(first)) * 30.0::DOUBLE AS extent_m,
  CASE WHEN count(*) > 1 OR (max(last) - min(first)) * 30.0::DOUBLE > 150 THEN 'alongside' ELSE 'crossing' END AS kind FROM e GROUP BY leg, event""")
def stream_events(spark, sf_dir):
    path, grid = rows_as_paths(spark, sf_dir)
    return sequences.merge_contacts(sequences.contacts(path, ["leg"], "blocked", "extra"), ["leg"], grid)


@query(f"WITH {PATHS}, m AS (SELECT leg, blocked AND NOT coalesce(lag(blocked) OVER (PARTITION BY leg ORDER BY seq), TRUE) AS up FROM path) SELECT leg, sum(up::INT)::BIGINT AS entries FROM m GROUP BY leg")
def mask_entries(spark, sf_dir):
    path, _ = rows_as_paths(spark, sf_dir)
    return sequences.rising_edges(path, ["leg"], "blocked")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines from ``events``: one for each user, steps by value and event number."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return e.select(F.col("user_id").alias("track"), order.alias("seq"), (F.col("event_id") % 400).cast("double").alias("x"), F.round(F.col("value") * 3.0, 3).alias("y"))


TRACKS = "tr AS MATERIALIZED (SELECT user_id AS track, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, (event_id % 400)::DOUBLE AS x, round(value * 3.0::DOUBLE, 3) AS y FROM events)"


@query(f"""WITH {TRACKS}, l AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM tr WINDOW w AS (PARTITION BY track ORDER BY seq)),
s AS (SELECT *, sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) AS len FROM l),
f AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY track ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fr FROM s),
p AS (SELECT track, unnest(range(ceil(fr / 50)::BIGINT, ceil((fr + len) / 50)::BIGINT)) AS k FROM f WHERE len > 0)
SELECT track, (SELECT count(*) FROM p WHERE p.track = f.track) + 1 AS points, round(max(fr + coalesce(len, 0)), 3) AS length FROM f GROUP BY track""")
def densified_lengths(spark, sf_dir):
    d = sequences.densify(tracks(spark, sf_dir), 50.0, ["track"])
    return d.groupBy("track").agg(F.count("*").alias("points"), F.round(F.max("at"), 3).alias("length"))


@query(f"""WITH {TRACKS}, seg AS (SELECT track, x AS x1, y AS y1, coalesce(lead(x) OVER w, x) AS x2, coalesce(lead(y) OVER w, y) AS y2 FROM tr WINDOW w AS (PARTITION BY track ORDER BY seq)),
p AS (SELECT track, seq, x + 7 AS x, y + (seq % 5) * 10 AS y FROM tr),
d AS (SELECT p.track, p.seq, min(sqrt(power(x - x1 - (x2 - x1) * t, 2) + power(y - y1 - (y2 - y1) * t, 2))) AS d FROM (
  SELECT p.*, x1, y1, x2, y2, CASE WHEN x1 = x2 AND y1 = y2 THEN 0 ELSE least(greatest(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (power(x2 - x1, 2) + power(y2 - y1, 2)), 0), 1) END AS t FROM p JOIN seg USING (track)) p GROUP BY p.track, p.seq)
SELECT track, count(*) AS n, round(avg((d <= 12)::INT::DOUBLE), 6) AS share FROM d GROUP BY track""")
def line_agreement(spark, sf_dir):
    lines = tracks(spark, sf_dir)
    moved = lines.select("track", F.col("seq").alias("at"), (F.col("x") + 7).alias("x"), (F.col("y") + F.col("seq") % 5 * 10).alias("y"))
    return sequences.agreement(moved, lines, ["track"], 12.0).select("track", "n", F.round("share", 6).alias("share"))


_MOVED_SQL = "mv AS MATERIALIZED (SELECT track, seq, x + 7 AS x, y + (seq % 5) * 10 AS y FROM tr)"


def _inside_sql(name: str, line: str, other: str) -> str:
    """DuckDB SQL: length of each track's ``line`` within 12 of its ``other`` line, from all pairs of whole sides."""
    side = "(SELECT track, seq, x AS x1, y AS y1, coalesce(lead(x) OVER w, x) AS x2, coalesce(lead(y) OVER w, y) AS y2 FROM {} WINDOW w AS (PARTITION BY track ORDER BY seq))"
    limits = lambda at, rate, low, high: f"CASE WHEN {rate} <> 0 THEN [least(({low} - {at}) / {rate}, ({high} - {at}) / {rate}), greatest(({low} - {at}) / {rate}, ({high} - {at}) / {rate})] WHEN {at} BETWEEN {low} AND {high} THEN [-1.0::DOUBLE, 2.0::DOUBLE] END"
    disk = lambda dx, dy: f"CASE WHEN power(({dx}) * vx + ({dy}) * vy, 2) >= v2 * (power({dx}, 2) + power({dy}, 2) - 144) THEN [(-(({dx}) * vx + ({dy}) * vy) - sqrt(power(({dx}) * vx + ({dy}) * vy, 2) - v2 * (power({dx}, 2) + power({dy}, 2) - 144))) / v2, (-(({dx}) * vx + ({dy}) * vy) + sqrt(power(({dx}) * vx + ({dy}) * vy, 2) - v2 * (power({dx}, 2) + power({dy}, 2) - 144))) / v2] END"
    return f"""{name}_s AS MATERIALIZED (SELECT *, x2 - x1 AS vx, y2 - y1 AS vy, power(x2 - x1, 2) + power(y2 - y1, 2) AS v2 FROM {side.format(line)}),
{name}_p AS (SELECT a.track, a.seq, a.vx, a.vy, a.v2, b.x2 - b.x1 AS wx, b.y2 - b.y1 AS wy, a.x1 - b.x1 AS fx, a.y1 - b.y1 AS fy FROM {name}_s a JOIN {side.format(other)} b ON a.track = b.track WHERE a.v2 > 0),
{name}_q AS (SELECT track, seq, v2, {disk('fx', 'fy')} AS d1, {disk('fx - wx', 'fy - wy')} AS d2,
  CASE WHEN wx <> 0 OR wy <> 0 THEN {limits('(wx * fy - wy * fx)', '(wx * vy - wy * vx)', '(-12 * sqrt(wx * wx + wy * wy))', '(12 * sqrt(wx * wx + wy * wy))')} END AS b1,
  CASE WHEN wx <> 0 OR wy <> 0 THEN {limits('(wx * fx + wy * fy)', '(wx * vx + wy * vy)', '0', '(wx * wx + wy * wy)')} END AS b2 FROM {name}_p),
{name}_b AS (SELECT *, CASE WHEN b1 IS NOT NULL AND b2 IS NOT NULL AND greatest(b1[1], b2[1]) <= least(b1[2], b2[2]) THEN [greatest(b1[1], b2[1]), least(b1[2], b2[2])] END AS b FROM {name}_q),
{name}_i AS (SELECT track, seq, v2, greatest(least(d1[1], d2[1], b[1]), 0) AS lo, least(greatest(d1[2], d2[2], b[2]), 1) AS hi FROM {name}_b WHERE d1 IS NOT NULL OR d2 IS NOT NULL OR b IS NOT NULL),
{name}_u AS (SELECT track, seq, v2, hi - greatest(lo, least(hi, coalesce(max(hi) OVER (PARTITION BY track, seq ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lo))) AS fresh FROM {name}_i WHERE lo < hi),
{name} AS (SELECT track, length_m, coalesce(inside_m, 0) AS inside_m FROM (SELECT track, sum(sqrt(v2)) AS length_m FROM {name}_s GROUP BY track) LEFT JOIN (SELECT track, sum(fresh * sqrt(v2)) AS inside_m FROM {name}_u GROUP BY track) USING (track))"""


@query(f"""WITH {TRACKS}, {_MOVED_SQL}, {_inside_sql('a', 'mv', 'tr')}, {_inside_sql('b', 'tr', 'mv')}
SELECT track, round(a.length_m, 3) AS length_m, round(a.inside_m, 3) AS inside_m, round(a.inside_m / nullif(a.length_m, 0), 6) AS share, round(b.inside_m / nullif(b.length_m, 0), 6) AS share_back FROM a JOIN b USING (track)""")
def line_overlap(spark, sf_dir):
    lines = tracks(spark, sf_dir)
    moved = lines.select("track", "seq", (F.col("x") + 7).alias("x"), (F.col("y") + F.col("seq") % 5 * 10).alias("y"))
    there = sequences.overlap(moved, lines, ["track"], 12.0)
    back = sequences.overlap(lines, moved, ["track"], 12.0).select("track", F.round("share", 6).alias("share_back"))
    return there.join(back, "track").select("track", F.round("length_m", 3).alias("length_m"), F.round("inside_m", 3).alias("inside_m"), F.round("share", 6).alias("share"), "share_back")


OPTIMA = [i / 100 for i in range(0, 11)]


@query(f"""WITH {ORDERS_SQL}, g AS (SELECT (lead(z::DOUBLE) OVER (PARTITION BY r ORDER BY c) - z::DOUBLE) / 30 AS g, extra FROM cells),
s AS (SELECT g, ln(6 * exp(abs(g + 0.05::DOUBLE) * -3.5::DOUBLE) * (0.8::DOUBLE + (extra % 1) * 0.4::DOUBLE)) AS y FROM g WHERE g IS NOT NULL),
t AS (SELECT o / 100.0::DOUBLE AS best, y, abs(g + o / 100.0::DOUBLE) AS x FROM s, range(0, 11) q(o)),
f AS (SELECT best, regr_slope(y, x) AS k, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2, count(*) AS n FROM t GROUP BY best)
SELECT best, round(exp(a), 4) AS fastest, round(-k, 4) AS decay, round(r2, 5) AS r2, n FROM f ORDER BY f.r2 DESC LIMIT 1""")
def walking_speed_fit(spark, sf_dir):
    cells, _ = relief(spark, sf_dir)
    z = F.col("z").cast("double")
    g = cells.select(((F.lead(z).over(along_row()) - z) / 30).alias("gradient"), "extra").where("gradient is not null")
    windows = g.select("gradient", (tobler_speed(F.col("gradient")) * (0.8 + F.col("extra") % 1 * 0.4)).alias("speed_kmh"))
    fit = sequences.fit_tobler(windows, OPTIMA)
    return fit.select("best", F.round("fastest", 4).alias("fastest"), F.round("decay", 4).alias("decay"), F.round("r2", 5).alias("r2"), "n")


@query(f"""WITH {ORDERS_SQL}, g AS (SELECT (lead(z::DOUBLE) OVER (PARTITION BY r ORDER BY c) - z::DOUBLE) / 30 AS g, extra FROM cells),
s AS (SELECT g, extra / 100000 AS f, ln(6 * exp(abs(g + 0.05::DOUBLE) * -3.5::DOUBLE) * (0.8::DOUBLE + extra / 1000000)) AS y FROM g WHERE g IS NOT NULL AND extra IS NOT NULL),
t AS (SELECT o / 100.0::DOUBLE AS best, y, f, abs(g + o / 100.0::DOUBLE) AS x FROM s, range(0, 11) q(o)),
c AS (SELECT best, count(*) AS n, avg(x) AS mx, avg(f) AS mf, avg(y) AS my, covar_pop(x, x) AS xx, covar_pop(f, f) AS ff, covar_pop(x, f) AS xf, covar_pop(x, y) AS xy, covar_pop(f, y) AS fy, covar_pop(y, y) AS yy FROM t GROUP BY best),
k AS (SELECT *, (xy * ff - fy * xf) / (xx * ff - xf * xf) AS k, (fy * xx - xy * xf) / (xx * ff - xf * xf) AS e FROM c)
SELECT best, round(exp(my - k * mx - e * mf), 4) AS fastest, round(-k, 4) AS decay, round(e, 4) AS effect, round((k * xy + e * fy) / yy, 5) AS r2, n FROM k ORDER BY (k * xy + e * fy) / yy DESC LIMIT 1""")
def walking_speed_with_factor(spark, sf_dir):
    cells, _ = relief(spark, sf_dir)
    z = F.col("z").cast("double")
    g = cells.select(((F.lead(z).over(along_row()) - z) / 30).alias("gradient"), "extra").where("gradient is not null")
    windows = g.select("gradient", (F.col("extra") / 100_000).alias("factor"), (tobler_speed(F.col("gradient")) * (0.8 + F.col("extra") / 1_000_000)).alias("speed_kmh"))
    fit = sequences.fit_with_factor(windows, OPTIMA, "factor")
    return fit.select("best", *(F.round(c, 4).alias(c) for c in ("fastest", "decay", "effect")), F.round("r2", 5).alias("r2"), "n")


@query("""WITH s AS (SELECT l_linenumber AS setting, l_suppkey % 7 AS "case", round(avg(l_quantity), 6) AS value FROM lineitem GROUP BY 1, 2),
o AS (SELECT *, (sum(value) OVER w - value) / (count(*) OVER w - 1) AS others FROM s WINDOW w AS (PARTITION BY setting)),
k AS (SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY others DESC, setting DESC) AS n FROM o)
SELECT "case", setting, value AS own FROM k WHERE n = 1""")
def leave_one_out(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    results = items.groupBy(F.col("l_linenumber").alias("setting"), (F.col("l_suppkey") % 7).alias("case")).agg(F.round(F.avg("l_quantity"), 6).alias("value"))
    return sequences.leave_one_out(results)


# Iterative ones.  DuckDB follows them with recursive tables that keep one row for each key.

FILLED = f"""{OFFSET_SQL},
f0 AS MATERIALIZED (SELECT a.r * a.w + a.c AS id, a.r, a.c, a.w, a.z::DOUBLE AS z, count(b.z) < 8 AS outlet FROM cells a, o LEFT JOIN cells b ON b.r = a.r + dr AND b.c = a.c + dc WHERE a.z IS NOT NULL GROUP BY ALL),
nb AS MATERIALIZED (SELECT a.id, b.id AS nid, b.z AS nz FROM f0 a, o JOIN f0 b ON b.r = a.r + dr AND b.c = a.c + dc),
fl(id, level) USING KEY (id) AS (SELECT id, z FROM f0 WHERE outlet UNION
  SELECT nid, min(new) FROM (SELECT nb.nid, CASE WHEN nz > fl.level THEN nz ELSE fl.level + 0.001::DOUBLE END AS new FROM fl JOIN nb ON nb.id = fl.id)
  LEFT JOIN recurring.fl AS old ON old.id = nid WHERE new < coalesce(old.level, 'inf'::DOUBLE) GROUP BY nid)"""


@query(f"WITH RECURSIVE {ORDERS_SQL}, {FILLED} SELECT cells.r, cells.c, round(fl.level, 6) AS filled FROM cells LEFT JOIN fl ON fl.id = r * w + c")
def depression_filling(spark, sf_dir):
    cells, grid = relief(spark, sf_dir)
    return hydrology.fill(cells, grid).select("r", "c", F.round("filled", 6).alias("filled"))


_STEPS = ", ".join("42.42640687119285::DOUBLE" if dr and dc else "30.0::DOUBLE" for dr, dc in OFFSETS.values())
DRAINED = f"""{ORDERS_SQL}, {FILLED},
fd AS MATERIALIZED (SELECT cells.r, cells.c, z, fl.level AS filled FROM cells LEFT JOIN fl ON fl.id = r * w + c),
nn AS ({sql_near("filled").format(source="fd")}),
dd AS MATERIALIZED (SELECT r, c, here, list_transform(range(1, 9), lambda i: coalesce((here - near[i]) / [{_STEPS}][i], -1)) AS drops FROM nn),
d8 AS MATERIALIZED (SELECT r, c, CASE WHEN here IS NULL THEN NULL WHEN list_max(drops) > 0 THEN CAST(list_position(drops, list_max(drops)) - 1 AS INT) ELSE -1 END AS d8 FROM dd),
s0 AS MATERIALIZED (SELECT r * w + c AS id, CASE WHEN d8 >= 0 THEN (r + dr) * w + c + dc END AS ptr, 1::BIGINT AS total FROM d8 CROSS JOIN dims LEFT JOIN o ON o.i = d8 WHERE d8 IS NOT NULL),
{_DOUBLING},
gr AS (SELECT r, c, z, filled, {sql_gradient("filled", "x")} AS gx, {sql_gradient("filled", "y")} AS gy FROM fd),
dr AS MATERIALIZED (SELECT gr.r, gr.c, z, filled, d8, total AS upstream, CAST(total * 900 / 1000000.0::DOUBLE AS FLOAT) AS basin_km2, ln(greatest(total * 900 / 30.0::DOUBLE, 1e-6) / greatest(sqrt(gx * gx + gy * gy), {hydrology.LEAST_GRADE})) AS twi
  FROM gr CROSS JOIN dims JOIN d8 ON d8.r = gr.r AND d8.c = gr.c LEFT JOIN s{_ROUNDS} s ON s.id = gr.r * w + gr.c)"""


@query(f"""WITH RECURSIVE {DRAINED}
SELECT r, c, z, round(filled, 6) AS filled, d8, upstream, round(basin_km2::DOUBLE, 6) AS basin_km2, coalesce(basin_km2 >= 0.05::DOUBLE, FALSE) AS channel, CASE WHEN filled IS NOT NULL THEN round(twi, 5) END AS twi FROM dr""")
def drainage(spark, sf_dir):
    cells, grid = relief(spark, sf_dir)
    found = hydrology.analyse(cells, grid, 0.05)
    return found.select("r", "c", "z", F.round("filled", 6).alias("filled"), "d8", "upstream", F.round(F.col("basin_km2").cast("double"), 6).alias("basin_km2"), "channel", F.round("twi", 5).alias("twi"))


@query(f"""WITH RECURSIVE {DRAINED},
v AS (SELECT *, coalesce(basin_km2 >= 0.05::DOUBLE, FALSE) AS channel, CASE WHEN d8 >= 0 THEN [{_STEPS}][d8 + 1] ELSE 30 END AS step FROM dr WHERE z IS NOT NULL),
k AS (SELECT count(*) AS valid, sum(channel::INT)::BIGINT AS channels, sum(step) FILTER (channel) / 1000 AS network_km, sum((d8 < 0)::INT)::BIGINT AS sinks,
  quantile_cont(twi, 0.05) AS twi_p5, quantile_cont(twi, 0.5) AS twi_p50, quantile_cont(twi, 0.95) AS twi_p95 FROM v)
SELECT valid, channels, round(network_km, 4) AS network_km, sinks, round(twi_p5, 5) AS twi_p5, round(twi_p50, 5) AS twi_p50, round(twi_p95, 5) AS twi_p95, round(channels / valid, 6) AS channel_share,
  round(coalesce(network_km, 0) / (valid * 900 / 1000000.0::DOUBLE), 5) AS density FROM k""")
def drainage_metrics(spark, sf_dir):
    cells, grid = relief(spark, sf_dir)
    found = hydrology.metrics(materialize(hydrology.analyse(cells, grid, 0.05), "drainage"), grid)
    digits = {"network_km": 4, "twi_p5": 5, "twi_p50": 5, "twi_p95": 5, "channel_share": 6, "density": 5}
    return found.select("valid", "channels", "sinks", *(F.round(n, k).alias(n) for n, k in digits.items()))


@query(f"""WITH RECURSIVE {ORDERS_SQL}, {OFFSET_SQL}, b AS MATERIALIZED (SELECT r * w + c AS id, r, c FROM cells WHERE blocked),
e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM b a, o JOIN b ON b.r = a.r + dr AND b.c = a.c + dc),
reach(id, src) AS (SELECT id, id FROM b UNION SELECT e.b, reach.src FROM reach JOIN e ON e.a = reach.id),
m AS (SELECT id, min(src) AS region FROM reach GROUP BY id)
SELECT region, r, c, dense_rank() OVER (ORDER BY region)::INT AS label FROM m JOIN b USING (id)""")
def blocked_regions(spark, sf_dir):
    cells, grid = relief(spark, sf_dir)
    return regions.numbered(regions.regions(cells, grid, "blocked"))


@query(f"""WITH RECURSIVE {ORDERS_SQL}, {OFFSET_SQL}, b AS MATERIALIZED (SELECT r * w + c AS id, r, c FROM cells WHERE blocked),
e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM b a, o JOIN b ON b.r = a.r + dr AND b.c = a.c + dc),
reach(id, src) AS (SELECT id, id FROM b UNION SELECT e.b, reach.src FROM reach JOIN e ON e.a = reach.id),
m AS MATERIALIZED (SELECT r, c, min(src) AS region FROM reach JOIN b USING (id) GROUP BY r, c),
h(dr, dc, sr, sc, d, vr, vc) AS (VALUES (-1, 0, 0, 0, 2, 0, 1), (0, 1, 0, 1, 3, 1, 0), (1, 0, 1, 1, 1, 0, -1), (0, -1, 1, 0, 0, -1, 0)),
s AS MATERIALIZED (SELECT m.region, m.r + sr AS r, m.c + sc AS c, d, vr, vc, ((m.r + sr) * (w + 1) + m.c + sc) * 4 + d AS id FROM dims, m, h WHERE NOT EXISTS (SELECT 1 FROM m n WHERE n.region = m.region AND n.r = m.r + dr AND n.c = m.c + dc)),
nx AS MATERIALIZED (SELECT x.id, y.id AS nid, y.d <> x.d AS turns FROM s x JOIN s y ON y.region = x.region AND y.r = x.r + x.vr AND y.c = x.c + x.vc QUALIFY row_number() OVER (PARTITION BY x.id ORDER BY x.vc * y.vr - x.vr * y.vc) = 1),
walk(id, cur, seq) AS (SELECT id, id, 0 FROM s UNION ALL SELECT walk.id, nid, seq + 1 FROM walk JOIN nx ON nx.id = walk.cur WHERE nid <> walk.id),
heads AS (SELECT id FROM walk GROUP BY id HAVING min(cur) = id)
SELECT s.region, walk.id AS ring, seq, s.r, s.c FROM walk JOIN heads USING (id) JOIN s ON s.id = walk.cur JOIN nx ON nx.nid = walk.cur WHERE turns""")
def blocked_outlines(spark, sf_dir):
    cells, grid = relief(spark, sf_dir)
    return regions.boundaries(regions.regions(cells, grid, "blocked"), grid)


@query()
def zone_outlines(spark, sf_dir):
    cells, grid = relief(spark, sf_dir)
    return regions.outlines(regions.large_regions(cells.withColumn("high", F.col("z") > 1000), grid, "high", 0.5), grid)


def _ends(grid: Grid) -> tuple[tuple[int, int], tuple[int, int]]:
    return (grid.rows // 5, grid.cols * 3 // 4), (grid.rows * 2 // 3, grid.cols * 5 // 8)


def _open(cells: DataFrame, grid: Grid) -> DataFrame:
    """Route ends are always passable."""
    ends = [r * grid.cols + c for r, c in _ends(grid)]
    return cells.withColumn("cost", F.when((F.col("r") * grid.cols + F.col("c")).isin(ends), F.coalesce("cost", F.lit(1.0))).otherwise(F.col("cost")))


def _far(name: str, source: str) -> str:
    """A recursive table of least costs from the node that ``source`` gives."""
    return f"""{name}(id, far) USING KEY (id) AS (SELECT {source}, 0.0::DOUBLE FROM dims UNION
  SELECT dst, min(new) FROM (SELECT dst, {name}.far + g.w AS new FROM {name} JOIN g ON g.src = {name}.id) LEFT JOIN recurring.{name} AS old ON old.id = dst WHERE new < coalesce(old.far, 'inf'::DOUBLE) GROUP BY dst)"""


_START, _END = "w // 5 * w + w * 3 // 4", "w * 2 // 3 * w + w * 5 // 8"
GRAPH = f"""{COST}, {OFFSET_SQL},
q AS MATERIALIZED (SELECT r, c, w, coalesce(cost, CASE WHEN r * w + c IN ({_START}, {_END}) THEN 1.0::DOUBLE END) AS cost FROM k),
g AS MATERIALIZED (SELECT a.r * a.w + a.c AS src, b.r * a.w + b.c AS dst, (a.cost + b.cost) / 2 * CASE WHEN dr <> 0 AND dc <> 0 THEN 42.42640687119285::DOUBLE ELSE 30 END AS w
  FROM q a, o JOIN q b ON b.r = a.r + dr AND b.c = a.c + dc LEFT JOIN q n ON n.r = a.r + dr AND n.c = a.c LEFT JOIN q m ON m.r = a.r AND m.c = a.c + dc
  WHERE a.cost IS NOT NULL AND b.cost IS NOT NULL AND (dr = 0 OR dc = 0 OR (n.cost IS NOT NULL AND m.cost IS NOT NULL)))"""


@query(f"WITH RECURSIVE {GRAPH}, {_far('d', _START)} SELECT r, c, round(far, 4) AS distance FROM q LEFT JOIN d ON d.id = r * w + c")
def travel_distances(spark, sf_dir):
    cells, grid = costs(spark, sf_dir)
    return routing.distances(_open(cells, grid), grid, _ends(grid)[0]).select("r", "c", F.round("distance", 4).alias("distance"))


@query(f"""WITH RECURSIVE {GRAPH}, {_far('d', _START)},
best AS MATERIALIZED (SELECT dst, arg_min(src, far + g.w) AS src FROM g JOIN d ON d.id = g.src GROUP BY dst),
walk(id, step) AS (SELECT {_END}, 0 FROM dims UNION ALL SELECT best.src, step + 1 FROM walk JOIN best ON best.dst = walk.id JOIN d ON d.id = walk.id WHERE far > 0)
SELECT 0 AS leg, (SELECT max(step) FROM walk) - step AS seq, walk.id // w AS r, walk.id % w AS c, round(far, 4) AS distance FROM walk JOIN d ON d.id = walk.id, dims""")
def least_cost_route(spark, sf_dir):
    cells, grid = costs(spark, sf_dir)
    found = routing.route(_open(cells, grid), grid, list(_ends(grid)))
    return found.select("leg", "seq", "r", "c", F.round("distance", 4).alias("distance"))


@query(f"""WITH RECURSIVE {GRAPH}, {_far('d', _START)}, {_far('u', _END)}, t AS (SELECT far AS total FROM d, dims WHERE id = {_END})
SELECT d.id // w AS r, d.id % w AS c, round((d.far + u.far) / total - 1, 6) AS slack FROM d JOIN u ON u.id = d.id, t, dims WHERE (d.far + u.far) / total - 1 <= 0.05::DOUBLE + 1e-9::DOUBLE""")
def alternatives_corridor(spark, sf_dir):
    cells, grid = costs(spark, sf_dir)
    return routing.corridor(_open(cells, grid), grid, [_ends(grid)], 0.05).select("r", "c", F.round("slack", 6).alias("slack"))


def _alternatives(spark, sf_dir):
    cells, grid = costs(spark, sf_dir)
    open_ = materialize(_open(cells, grid), "open-cells")
    path = materialize(routing.route(open_, grid, list(_ends(grid))), "route")
    return routing.alternatives(open_, grid, path, list(_ends(grid)), 0.05, 100.0)


@query(f"""WITH RECURSIVE {GRAPH}, {_far('d', _START)}, {_far('u', _END)}, t AS (SELECT far AS total FROM d, dims WHERE id = {_END})
SELECT d.id // w AS r, d.id % w AS c, round(100 * greatest((d.far + u.far) / total - 1, 0), 4) AS slack_pct FROM d JOIN u ON u.id = d.id, t, dims WHERE (d.far + u.far) / total - 1 <= 0.15::DOUBLE + 1e-9::DOUBLE""")
def alternatives_slack(spark, sf_dir):
    return _alternatives(spark, sf_dir)["raster"].select("r", "c", F.round("slack_pct", 4).alias("slack_pct"))


@query(f"""WITH RECURSIVE {GRAPH}, {_far('d', _START)}, {_far('u', _END)}, t AS (SELECT far AS total FROM d, dims WHERE id = {_END}),
best AS MATERIALIZED (SELECT dst, arg_min(src, far + g.w) AS src FROM g JOIN d ON d.id = g.src GROUP BY dst),
walk(id) AS (SELECT {_END} FROM dims UNION ALL SELECT best.src FROM walk JOIN best ON best.dst = walk.id JOIN d ON d.id = walk.id WHERE far > 0),
on_way AS MATERIALIZED (SELECT id // w AS pr, id % w AS pc FROM walk, dims),
near AS MATERIALIZED (SELECT d.id // w AS r, d.id % w AS c FROM d JOIN u ON u.id = d.id, t, dims WHERE (d.far + u.far) / total - 1 <= 0.05::DOUBLE + 1e-9::DOUBLE),
far_off AS (SELECT r, c, min(sqrt(power(r - pr, 2) + power(c - pc, 2))) * 30 AS away FROM near, on_way GROUP BY r, c)
SELECT round(count(*) * 0.09::DOUBLE, 4) AS area_ha, round(max(away), 3) AS farthest_m, max(away) > 400 AS apart FROM far_off""")
def alternatives_extent(spark, sf_dir):
    return _alternatives(spark, sf_dir)["extent"].select(F.round("area_ha", 4).alias("area_ha"), F.round("farthest_m", 3).alias("farthest_m"), "apart")


@query(f"""WITH RECURSIVE {SLOPE}, {OFFSET_SQL},
s AS MATERIALIZED (SELECT r * w + c AS id, r, c, CASE WHEN r * w + c = {_START} THEN coalesce(CASE WHEN NOT blocked THEN slope END, 0) WHEN NOT blocked THEN slope END::DOUBLE AS slope FROM t1),
nb AS MATERIALIZED (SELECT a.id, b.id AS nid, b.slope FROM s a, o JOIN s b ON b.r = a.r + dr AND b.c = a.c + dc WHERE (dr = 0 OR dc = 0) AND a.slope IS NOT NULL AND b.slope IS NOT NULL),
m(id, lim) USING KEY (id) AS (SELECT id, slope FROM s, dims WHERE id = {_START} UNION
  SELECT nid, min(new) FROM (SELECT nb.nid, greatest(m.lim, nb.slope) AS new FROM m JOIN nb ON nb.id = m.id) LEFT JOIN recurring.m AS old ON old.id = nid WHERE new < coalesce(old.lim, 'inf'::DOUBLE) GROUP BY nid)
SELECT s.r, s.c, round(lim, 4) AS "limit" FROM s LEFT JOIN m ON m.id = s.id""")
def connecting_slopes(spark, sf_dir):
    cells, grid = relief(spark, sf_dir)
    start = _ends(grid)[0]
    at_start = (F.col("r") == start[0]) & (F.col("c") == start[1])
    slope = F.when(~F.col("blocked"), F.col("slope"))
    sloped = terrain.slope(cells, grid).select("r", "c", F.when(at_start, F.coalesce(slope, F.lit(0.0))).otherwise(slope).alias("slope"))
    return routing.least_limits(sloped, grid, start).select("r", "c", F.round("limit", 4).alias("limit"))


@query(f"""WITH RECURSIVE {TRACKS}, x AS MATERIALIZED (SELECT track, row_number() OVER (PARTITION BY track ORDER BY seq) AS k, x, y, y / 10 AS ele, seq * 100.0::DOUBLE AS t FROM tr),
s(track, k, win, sx, sele, st, px, py, pt, dist, paused, done, wdist, wdt, wrise, wpaused) AS (
  SELECT track, k, 0, x, ele, t, x, y, t, 0.0::DOUBLE, FALSE, FALSE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, FALSE FROM x WHERE k = 1 UNION ALL
  SELECT track, k, win + done::INT, sx, CASE WHEN done THEN ele ELSE sele END, CASE WHEN done THEN t ELSE st END, x, y, t, CASE WHEN done THEN 0 ELSE far END, hold AND NOT done, done, far, t - st, ele - sele, hold
  FROM (SELECT x.*, win, sx, sele, st, dist + sqrt(power(x.x - px, 2) + power(x.y - py, 2)) AS far, paused OR x.t - pt > 150 AS hold, dist + sqrt(power(x.x - px, 2) + power(x.y - py, 2)) >= 500 AS done
        FROM s JOIN x ON x.track = s.track AND x.k = s.k + 1))
SELECT track, win - 1 AS win, round(wrise / wdist, 6) AS gradient, round(wdist / wdt * 3.6::DOUBLE, 6) AS speed_kmh, round(wdist, 4) AS dist_m, wdt AS dt_s
FROM s WHERE done AND NOT wpaused AND wdt > 0 AND wdist / wdt * 3.6::DOUBLE BETWEEN 0.2 AND 100""")
def track_windows(spark, sf_dir):
    e = tracks(spark, sf_dir)
    fixes = e.select("track", "seq", "x", "y", (F.col("y") / 10).alias("ele"), (F.col("seq") * 100).alias("t"))
    found = sequences.distance_windows(fixes, 500.0, 150.0, (0.2, 100.0))
    return found.select("track", "win", F.round("gradient", 6).alias("gradient"), F.round("speed_kmh", 6).alias("speed_kmh"), F.round("dist_m", 4).alias("dist_m"), "dt_s")


SETTINGS = [validation.Setting(0.0), validation.Setting(1.0), validation.Setting(2.0, 1.3), validation.Setting(4.0, 5.0)]
_SETTINGS_SQL = "p(setting, slowdown, decay) AS (VALUES " + ", ".join(f"({k}, {s.slowdown}::DOUBLE, {s.decay}::DOUBLE)" for k, s in enumerate(SETTINGS)) + ")"


@query(f"""WITH RECURSIVE {COST}, {OFFSET_SQL}, {_SETTINGS_SQL},
q AS MATERIALIZED (SELECT r, c, w, z::DOUBLE AS z, CASE WHEN r * w + c IN ({_START}, {_END}) OR (slope <= 60 AND NOT blocked) THEN greatest(1 - coalesce(slope, 0)::DOUBLE / 60.0::DOUBLE, 0) END AS score FROM t1),
e AS MATERIALIZED (SELECT a.r * a.w + a.c AS src, b.r * a.w + b.c AS dst, (2 - a.score - b.score) / 2 AS rough, b.z - a.z AS dz, CASE WHEN dr <> 0 AND dc <> 0 THEN 42.42640687119285::DOUBLE ELSE 30 END AS len
  FROM q a, o JOIN q b ON b.r = a.r + dr AND b.c = a.c + dc LEFT JOIN q n ON n.r = a.r + dr AND n.c = a.c LEFT JOIN q m ON m.r = a.r AND m.c = a.c + dc
  WHERE a.score IS NOT NULL AND b.score IS NOT NULL AND a.z IS NOT NULL AND b.z IS NOT NULL AND (dr = 0 OR dc = 0 OR (n.score IS NOT NULL AND m.score IS NOT NULL))),
g AS MATERIALIZED (SELECT setting, src, dst, (1 + slowdown * rough) * len / 1000 / (exp(abs(dz / len + 0.05::DOUBLE) * -decay) * 6) AS w FROM e, p),
d(setting, id, far) USING KEY (setting, id) AS (SELECT setting, {_START}, 0.0::DOUBLE FROM p, dims UNION
  SELECT setting, dst, min(new) FROM (SELECT g.setting, dst, d.far + g.w AS new FROM d JOIN g ON g.src = d.id AND g.setting = d.setting)
  LEFT JOIN (SELECT setting AS s, id, far FROM recurring.d) AS old ON old.id = dst AND old.s = setting WHERE new < coalesce(old.far, 'inf'::DOUBLE) GROUP BY setting, dst)
SELECT p.setting, r, c, round(far, 6) AS hours FROM p, q JOIN d ON d.id = r * w + c AND d.setting = p.setting""")
def parameter_sweep(spark, sf_dir):
    cells, grid = costs(spark, sf_dir)
    start, end = _ends(grid)
    ends = (F.col("r") * grid.cols + F.col("c")).isin([r * grid.cols + c for r, c in (start, end)])
    score = F.when(ends | F.col("cost").isNotNull(), F.greatest(1.0 - F.coalesce("slope", F.lit(0.0)).cast("double") / 60.0, F.lit(0.0)))
    found = validation.sweep(cells.select("r", "c", "z", score.alias("score")), grid, SETTINGS, [(start, ())]).cells()
    return found.where("distance is not null").select(F.col("search").alias("setting"), "r", "c", F.round("distance", 6).alias("hours"))


WINDOWS = [(250.0, 150.0), (500.0, 150.0), (1000.0, 150.0), (500.0, 50.0), (500.0, 1000.0)]
_WINDOWS_SQL = "p(setting, length, pause) AS (VALUES " + ", ".join(f"({k}, {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in enumerate(WINDOWS)) + ")"


@query(f"""WITH RECURSIVE {TRACKS}, {_WINDOWS_SQL}, x AS MATERIALIZED (SELECT track, row_number() OVER (PARTITION BY track ORDER BY seq) AS k, x, y, y / 10 AS ele, seq * 100.0::DOUBLE AS t FROM tr),
s(setting, length, pause, track, k, sele, st, px, py, pt, dist, paused, done, wdist, wdt, wrise, wpaused) AS (
  SELECT setting, length, pause, track, k, ele, t, x, y, t, 0.0::DOUBLE, FALSE, FALSE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, FALSE FROM x, p WHERE k = 1 UNION ALL
  SELECT setting, length, pause, track, k, CASE WHEN done THEN ele ELSE sele END, CASE WHEN done THEN t ELSE st END, x, y, t, CASE WHEN done THEN 0 ELSE far END, hold AND NOT done, done, far, t - st, ele - sele, hold
  FROM (SELECT setting, length, s.pause, x.*, sele, st, dist + sqrt(power(x.x - px, 2) + power(x.y - py, 2)) AS far, paused OR x.t - pt > s.pause AS hold, dist + sqrt(power(x.x - px, 2) + power(x.y - py, 2)) >= length AS done
        FROM s JOIN x ON x.track = s.track AND x.k = s.k + 1)),
v AS (SELECT setting, wrise / wdist AS g, ln(wdist / wdt * 3.6::DOUBLE) AS y FROM s WHERE done AND NOT wpaused AND wdt > 0 AND wdist / wdt * 3.6::DOUBLE BETWEEN 0.2 AND 100),
t AS (SELECT setting, o / 100.0::DOUBLE AS best, y, abs(g + o / 100.0::DOUBLE) AS x FROM v, range(0, 11) q(o)),
f AS (SELECT setting, best, regr_slope(y, x) AS k, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2, count(*) AS n FROM t GROUP BY setting, best)
SELECT setting, best, round(exp(a), 4) AS fastest, round(-k, 4) AS decay, round(r2, 5) AS r2, n FROM f WHERE r2 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY setting ORDER BY f.r2 DESC, best) = 1""")
def window_sensitivity(spark, sf_dir):
    e = tracks(spark, sf_dir)
    fixes = e.select("track", "seq", "x", "y", (F.col("y") / 10).alias("ele"), (F.col("seq") * 100).alias("t"))
    fit = sequences.fit_tobler(sequences.windows_of_settings(fixes, WINDOWS, (0.2, 100.0)), OPTIMA, ["setting"])
    return fit.select("setting", "best", F.round("fastest", 4).alias("fastest"), F.round("decay", 4).alias("decay"), F.round("r2", 5).alias("r2"), "n")
