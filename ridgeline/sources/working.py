"""From any relief to one that can be measured: the choice of a working CRS and grid, warping, and alignment.

The choice looks at the grid alone.  A relief in degrees or Web Mercator goes to the UTM zone of its centre;
a rotated grid or one of oblong cells to square cells, north up, in its own CRS; a stated cell size
puts cell edges on multiples of it, so that any cut of a relief gets the same cells; all else stays as it is.
Warping is one pass over tiles of the source with a halo (``distance.resample``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions import crs
from ridgeline.operators.distance import resample
from ridgeline.sources.grid import Grid, complete, utm_zone

EDGE_POINTS = 33  # of each side, to find how far it reaches in another CRS
POLAR = 84.0


class WorkingGridError(ValueError):
    """A relief that cannot be measured, or a result that does not lie on the grid asked for."""


@dataclass(frozen=True)
class Working:
    """A prepared relief, and what was done to it."""

    cells: DataFrame
    grid: Grid
    original_crs: str
    reprojected: bool
    assigned: bool
    reason: str
    messages: tuple[str, ...]


def _extent(spark: SparkSession, grid: Grid, target: str) -> tuple[float, float, float, float]:
    """Bounds of a grid in another CRS, by points along its sides."""
    k = [i / (EDGE_POINTS - 1) for i in range(EDGE_POINTS)]
    edge = [(a * grid.cols, b * grid.rows) for t in k for a, b in ((t, 0), (t, 1), (0, t), (1, t))]
    points = spark.createDataFrame([(grid.x0 + c * grid.dx + r * grid.rx, grid.y0 + c * grid.ry + r * grid.dy) for c, r in edge], "x double, y double")
    x, y = crs.convert(F.col("x"), F.col("y"), grid.crs, target)
    row = points.select(x.alias("x"), y.alias("y")).agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    return tuple(row)


def centre_in_degrees(spark: SparkSession, grid: Grid) -> tuple[float, float]:
    """Longitude and latitude of the middle of a grid."""
    x, y = (grid.x0 + grid.cols / 2 * grid.dx + grid.rows / 2 * grid.rx, grid.y0 + grid.cols / 2 * grid.ry + grid.rows / 2 * grid.dy)
    point = spark.createDataFrame([(x, y)], "x double, y double").select(*(v.alias(n) for n, v in zip("xy", crs.to_degrees(F.col("x"), F.col("y"), grid.crs)))).first()
    return point.x, point.y


def metric_crs(spark: SparkSession, grid: Grid) -> str:
    """The UTM zone of the middle of a grid."""
    return utm_zone(*centre_in_degrees(spark, grid))


def covering_grid(spark: SparkSession, grid: Grid, target: str, cell: float | None = None) -> Grid:
    """The square, north-up grid in another CRS that covers ``grid``.

    Without ``cell``, cells are as many along the diagonal as before; with it, edges are multiples of it.
    """
    x_min, y_min, x_max, y_max = _extent(spark, grid, target)
    size = cell or math.hypot(x_max - x_min, y_max - y_min) / math.hypot(grid.rows, grid.cols)
    around = Grid(2, 2, x_min, (x_max - x_min) / 2, y_max, -(y_max - y_min) / 2, crs=target)
    return around.aligned(size) if cell else replace(around, rows=max(2, math.ceil((y_max - y_min) / size - 1e-9)), cols=max(2, math.ceil((x_max - x_min) / size - 1e-9)), dx=size, dy=-size)


def warp(cells: DataFrame, source: Grid, target: Grid, value: str = "z", method: str = "bilinear") -> DataFrame:
    """``r, c, value`` of every cell of ``target``, by whatever way there is between the two CRS; NULL where the source has nothing."""
    x, y = crs.convert(*target.to_world(F.col("r"), F.col("c")), target.crs, source.crs)
    return complete(resample(cells, source, target, value, method, x, y), target)


def align(cells: DataFrame, source: Grid, reference: Grid, value: str = "z", method: str = "bilinear") -> DataFrame:
    """A raster on the grid of a reference; raises if the two still cannot be combined cell by cell."""
    made = warp(cells, source, reference, value, method)
    ends = made.agg(F.min("r"), F.max("r"), F.min("c"), F.max("c"), F.count("*")).first()
    if tuple(ends) != (0, reference.rows - 1, 0, reference.cols - 1, reference.rows * reference.cols):
        raise WorkingGridError(f"the aligned raster is not on the reference grid: rows {ends[0]} to {ends[1]}, columns {ends[2]} to {ends[3]}, {ends[4]} cells")
    return made


def working_relief(cells: DataFrame, grid: Grid, value: str = "z", cell: float | None = None, default_crs: str = "EPSG:4326", strict: bool = True, method: str = "bilinear") -> Working:
    """A relief in metres: the choice described above, made and carried out in one call.

    A relief without CRS is an error in ``strict`` mode; otherwise it is taken to be in ``default_crs``.
    """
    spark, messages, assigned = cells.sparkSession, [], False
    original = grid.crs
    if not grid.crs:
        if strict:
            raise WorkingGridError("the relief has no CRS; assign one, or allow a default by strict=False")
        grid, assigned = replace(grid, crs=default_crs), True
        messages.append(f"the relief has no CRS: {default_crs} is assumed")
    mercator = grid.crs == "EPSG:3857"
    if (grid.geographic or mercator) and abs(lat := centre_in_degrees(spark, grid)[1]) > POLAR:
        messages.append(f"latitude {lat:.1f}: UTM zones end at {POLAR:g} degrees, lengths are distorted")
    if grid.geographic or mercator:
        crs_of_work = metric_crs(spark, grid)
        target = covering_grid(spark, grid, crs_of_work, cell)
        reason = f"{'CRS in degrees' if grid.geographic else 'projection that is not metric'}: taken to {crs_of_work}"
    elif cell:
        target, reason = grid.aligned(cell), f"{grid.crs} kept, cells of {cell:g}"
    elif grid.rotated or abs(grid.px - grid.py) > 1e-6 * max(grid.px, grid.py):
        x_min, y_min, x_max, y_max = grid.bounds
        side = min(grid.px, grid.py)
        target = Grid(max(2, math.ceil((y_max - y_min) / side - 1e-9)), max(2, math.ceil((x_max - x_min) / side - 1e-9)), x_min, side, y_max, -side, crs=grid.crs)
        reason = f"{'rotated grid' if grid.rotated else 'oblong cells'}: taken to square cells of {side:g}, north up"
    else:
        return Working(cells, grid, original, False, assigned, f"{grid.crs} kept", tuple([*messages, f"{grid.crs} kept"]))
    return Working(align(cells, grid, target, value, method), target, original, target.crs != grid.crs, assigned, reason, tuple([*messages, reason]))
