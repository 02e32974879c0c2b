"""Grids as DataFrames: one row per cell, one column per raster, NoData as NULL."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """Geotransform and shape; cell (r, c) covers [r, r+1) x [c, c+1), rows run downward if dy < 0."""

    rows: int
    cols: int
    x0: float = 0.0
    dx: float = 30.0
    y0: float = 0.0
    dy: float = -30.0
    rx: float = 0.0
    ry: float = 0.0
    crs: str = "EPSG:32723"

    def __post_init__(self):
        if self.rows < 2 or self.cols < 2:
            raise ValueError("a grid needs at least two rows and two columns")
        if not self.dx or not self.dy:
            raise ValueError("a grid needs a cell size other than 0")

    @property
    def px(self) -> float:
        return math.hypot(self.dx, self.ry)

    @property
    def py(self) -> float:
        return math.hypot(self.rx, self.dy)

    @property
    def rotated(self) -> bool:
        return bool(self.rx or self.ry)

    @property
    def geographic(self) -> bool:
        return self.crs == "EPSG:4326"

    @property
    def cell_area(self) -> float:
        """Square metres; degrees are measured at the centre's latitude."""
        if not self.geographic:
            return abs(self.dx * self.dy - self.rx * self.ry)
        lat = self.y0 + self.dy * self.rows / 2
        return abs(self.dx) * 111_320.0 * math.cos(math.radians(lat)) * abs(self.dy) * 110_574.0

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        xs = [self.x0 + a * self.dx + b * self.rx for a in (0, self.cols) for b in (0, self.rows)]
        ys = [self.y0 + a * self.ry + b * self.dy for a in (0, self.cols) for b in (0, self.rows)]
        return min(xs), min(ys), max(xs), max(ys)

    def to_world(self, r: Column, c: Column) -> tuple[Column, Column]:
        """Coordinates of a cell's centre."""
        x = F.lit(self.x0) + (c + 0.5) * self.dx + (r + 0.5) * self.rx
        y = F.lit(self.y0) + (c + 0.5) * self.ry + (r + 0.5) * self.dy
        return x, y

    def to_cell(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Row and column of the cell that holds a point; may lie outside of the grid."""
        det = self.dx * self.dy - self.rx * self.ry
        u, v = x - self.x0, y - self.y0
        c = F.floor((u * self.dy - v * self.rx) / det)
        r = F.floor((v * self.dx - u * self.ry) / det)
        return r.cast("long"), c.cast("long")

    def holds(self, r: Column, c: Column) -> Column:
        return r.between(0, self.rows - 1) & c.between(0, self.cols - 1)

    def to_cells_of(self, metres: float) -> int:
        """A distance in whole cells, at least one."""
        return max(1, math.ceil(metres / math.sqrt(self.cell_area)))

    def aligned(self, cell: float) -> Grid:
        """The grid of square ``cell`` whose lines are multiples of it and that covers this one."""
        x_min, y_min, x_max, y_max = self.bounds
        x0, y0 = math.floor(x_min / cell) * cell, math.ceil(y_max / cell) * cell
        return replace(self, rows=math.ceil((y0 - y_min) / cell), cols=math.ceil((x_max - x0) / cell), x0=x0, y0=y0, dx=cell, dy=-cell, rx=0.0, ry=0.0)

    def size_warning(self, warn: int = 8_000_000, refuse: int | None = None) -> str | None:
        """A note on a large grid; raises above ``refuse`` cells, which Spark itself does not need."""
        cells = self.rows * self.cols
        if refuse is not None and cells > refuse:
            raise ValueError(f"{cells} cells are more than {refuse}")
        return f"{cells} cells, about {cells * 230 / 1e9:.1f} GB in one process" if cells > warn else None


def problems(a: Grid, b: Grid, nodata: tuple[float | None, float | None] = (None, None)) -> tuple[list[str], list[str]]:
    """All differences of two grids, and those that keep them from being combined cell by cell."""
    found = []
    if (a.rows, a.cols) != (b.rows, b.cols):
        found.append("shape")
    if any(abs(x - y) > 1e-9 for x, y in zip((a.x0, a.dx, a.rx, a.y0, a.ry, a.dy), (b.x0, b.dx, b.rx, b.y0, b.ry, b.dy))):
        found.append("transform")
    if a.crs != b.crs:
        found.append("crs")
    return found + ["nodata"] * (nodata[0] != nodata[1]), found


def utm_zone(lon: float, lat: float) -> str:
    """EPSG code of the UTM zone of a position."""
    lon = (lon + 180) % 360 - 180
    return f"EPSG:{(32600 if lat >= 0 else 32700) + int((lon + 180) / 6) + 1}"


def complete(cells: DataFrame, grid: Grid) -> DataFrame:
    """Every cell of the grid, those that are missing with NULLs."""
    spark = cells.sparkSession
    every = spark.range(grid.rows * grid.cols).select(F.expr(f"id div {grid.cols}").alias("r"), (F.col("id") % grid.cols).alias("c"))
    return every.join(cells, ["r", "c"], "left")


def nodata_to_null(v: Column, nodata: float | None) -> Column:
    v = F.when(F.isnan(v), None).otherwise(v)
    return v if nodata is None else F.nullif(v, F.lit(nodata))


ANALYTIC = Grid(300, 300, 500_000.0, 30.0, 7_500_000.0, -30.0)


def analytic_scene(spark: SparkSession) -> tuple[DataFrame, Grid]:
    """A closed-form relief with two massifs, a river and an escarpment: ``r, c, z``.

    Fixed values: all numbers below are those of the published example.
    """
    x, y = F.col("c") * 30.0, F.col("r") * 30.0
    sq = lambda v: v * v
    bell = lambda height, mx, my, s: F.exp(-(sq(x - mx) + sq(y - my)) / (2.0 * s * s)) * height
    bed = F.sin(x * (2 * math.pi) / 7000.0) * 900.0 + 4500.0
    z = (
        F.lit(900.0) + (9000.0 - y) * 0.045 + bell(780.0, 2700.0, 2400.0, 1450.0) + bell(560.0, 6600.0, 6300.0, 1650.0)
        + F.sin(x * (2 * math.pi) / 2100.0) * F.cos(y * (2 * math.pi) / 2700.0) * 95.0 + F.sin((x + y) * (2 * math.pi) / 1300.0) * 38.0
        - F.exp(-sq(y - bed) / (2.0 * 430.0**2)) * 230.0 + F.tanh((y - 6900.0) / 40.0) * F.exp(-sq(x - 4200.0) / (2.0 * 1100.0**2)) * 130.0
    )
    cells = spark.range(300 * 300).select(F.expr("id div 300").alias("r"), (F.col("id") % 300).alias("c"))
    return cells.select("r", "c", z.cast("float").alias("z")), ANALYTIC


def scene_from_orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Grid]:
    """A square relief that grows with the table: ``r, c, z, extra, blocked``.

    Every order is a cell, by its key; cells without an order have NULLs and are not blocked.
    """
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderpriority")
    w = max(2, math.isqrt(orders.agg(F.max("o_orderkey")).first()[0] or 0) + 1)
    cells = spark.range(w * w).join(orders, F.col("id") == F.col("o_orderkey"), "left")
    r, c = F.expr(f"id div {w}"), F.col("id") % w
    u, v = r / w, c / w
    z = F.lit(800.0) + u * (1.0 - u) * v * (1.0 - v) * 6000.0 + v * 200.0 - u * 90.0 + F.col("o_totalprice") % 50.0 / 10.0
    return cells.select(
        r.alias("r"), c.alias("c"), F.when(F.col("id") % 97 == 13, None).otherwise(z.cast("float")).alias("z"),
        F.col("o_totalprice").alias("extra"), F.coalesce(F.col("o_orderpriority") == "1-URGENT", F.lit(False)).alias("blocked"),
    ), Grid(w, w, 500_000.0, 30.0, 7_500_000.0, -30.0)


#: The same relief for DuckDB: common table expressions ``dims`` and ``cells``.
ORDERS_SQL = """
dims AS (SELECT greatest(2, CAST(ceil(sqrt(max(o_orderkey) + 1)) AS BIGINT)) AS w FROM orders),
cells AS MATERIALIZED (
  SELECT r, c, CASE WHEN k % 97 = 13 THEN NULL
                    ELSE CAST(800.0::DOUBLE + u * (1.0::DOUBLE - u) * v * (1.0::DOUBLE - v) * 6000.0::DOUBLE + v * 200.0::DOUBLE - u * 90.0::DOUBLE + p % 50.0::DOUBLE / 10.0::DOUBLE AS FLOAT) END AS z,
         p AS extra, coalesce(prio = '1-URGENT', FALSE) AS blocked, w
  FROM (SELECT k, k // w AS r, k % w AS c, w, CAST(k // w AS DOUBLE) / w AS u, CAST(k % w AS DOUBLE) / w AS v,
               o_totalprice AS p, o_orderpriority AS prio FROM (SELECT unnest(range(w * w)) AS k, w FROM dims) LEFT JOIN orders ON o_orderkey = k))"""
