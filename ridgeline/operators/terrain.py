"""Surface derivatives: slope, curvatures, ruggedness, aspect."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.operators.stencil import OFFSETS, along_column, along_row, gradients, with_neighbours
from ridgeline.sources.grid import Grid


def slope(cells: DataFrame, grid: Grid) -> DataFrame:
    """Adds ``zx``, ``zy`` and ``slope`` in percent."""
    derived = gradients(cells, "z", grid.px, grid.py, ("zx", "zy"))
    return derived.withColumn("slope", (F.hypot("zx", "zy") * 100.0).cast("float"))


def curvatures(cells: DataFrame, grid: Grid) -> DataFrame:
    """Adds ``plan`` (tangential) and ``profile`` curvature; concave is positive.

    Needs ``zx`` and ``zy``; the same gradient is taken of them.
    """
    second = gradients(gradients(cells, "zx", grid.px, grid.py, ("zxx", "zxy")), "zy", grid.px, grid.py, ("zyx", "zyy"))
    zx, zy, zxx, zyx, zyy = (F.col(n) for n in ("zx", "zy", "zxx", "zyx", "zyy"))
    p = zx * zx + zy * zy
    q = p + 1.0
    plan = (zxx * zy * zy - zyx * zx * zy * 2.0 + zyy * zx * zx) / (p * F.sqrt(q))
    profile = (zxx * zx * zx + zyx * zx * zy * 2.0 + zyy * zy * zy) / (p * q * F.sqrt(q))
    steep = F.when(zx.isNull(), F.lit(None)).when(p > 1e-12, F.lit(True)).otherwise(F.lit(False))
    pick = lambda v: F.when(steep.isNull(), None).when(steep, v).otherwise(0.0).cast("float")
    return second.withColumns({"plan": pick(plan), "profile": pick(profile)}).drop("zxx", "zxy", "zyx", "zyy")


def derive(cells: DataFrame, grid: Grid) -> DataFrame:
    """Slope and both curvatures."""
    return curvatures(slope(cells, grid), grid)


def _sum(values: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, values)


def ruggedness(cells: DataFrame) -> DataFrame:
    """Adds ``tri``: the mean absolute difference to the neighbours that exist; NULL without any."""
    around = with_neighbours(cells, ["z"])
    z = F.col("z").cast("double")
    each = [F.abs(z - F.col(f"around.{k}.z").cast("double")) for k in OFFSETS]
    total, count = _sum([F.coalesce(d, F.lit(0.0)) for d in each]), _sum([F.when(d.isNotNull(), 1).otherwise(0) for d in each])
    return around.withColumn("tri", F.when(count > 0, total / count)).drop("around")


def vector_ruggedness(cells: DataFrame) -> DataFrame:
    """Adds ``vrm``: 1 minus the mean length of the 3x3 sum of unit normals.  Needs ``zx`` and ``zy``."""
    tilt, aspect = F.atan(F.hypot("zx", "zy")), F.atan2(-F.col("zy"), F.col("zx"))
    normals = cells.withColumns({"nx": F.sin(tilt) * F.cos(aspect), "ny": F.sin(tilt) * F.sin(aspect), "nz": F.cos(tilt)})
    around = with_neighbours(normals, ["nx", "ny", "nz"])
    sums = {n: _sum([F.col(n), *(F.coalesce(F.col(f"around.{k}.{n}"), F.lit(0.0)) for k in OFFSETS)]) for n in ("nx", "ny", "nz")}
    count = _sum([F.lit(1), *(F.when(F.col(f"around.{k}.nz").isNotNull(), 1).otherwise(0) for k in OFFSETS)])
    length = F.sqrt(sums["nx"] * sums["nx"] + sums["ny"] * sums["ny"] + sums["nz"] * sums["nz"])
    vrm = F.least(F.greatest(1.0 - length / count, F.lit(0.0)), F.lit(1.0))
    return around.withColumn("vrm", F.when(F.col("nz").isNotNull(), vrm)).drop("around", "nx", "ny", "nz")


def northness(cells: DataFrame, grid: Grid) -> DataFrame:
    """Adds ``northness``, the cosine of aspect: 1 falls to the north, -1 to the south, 0 is flat.

    Uses plain differences, so NoData spreads to its neighbours.
    """
    v = F.col("z").cast("double")

    def plain(window, spacing):
        a, b = F.lag(v).over(window), F.lead(v).over(window)
        first, last = F.row_number().over(window) == 1, F.lead(F.lit(1)).over(window).isNull()
        return F.when(first, (b - v) / spacing).when(last, (v - a) / spacing).otherwise((b - a) / (2.0 * spacing))

    gx, gy = plain(along_row(), grid.px), plain(along_column(), grid.py)
    derived = cells.withColumn("__gx", gx).withColumn("__gy", gy)
    steep = F.hypot("__gx", "__gy")
    north = F.when(v.isNull() | steep.isNull(), None).when(steep > 0, F.col("__gy") / steep).otherwise(0.0)
    return derived.withColumn("northness", north).drop("__gx", "__gy")


def filled_slope_degrees(cells: DataFrame, grid: Grid) -> DataFrame:
    """Adds ``slope_deg`` and second differences ``dxx``, ``dyy`` of the surface with NoData at the mean."""
    mean = cells.agg(F.avg(F.col("z").cast("double")).alias("__mean"))
    filled = cells.join(F.broadcast(mean)).withColumn("__z", F.coalesce(F.col("z").cast("double"), F.col("__mean")))
    first = gradients(filled, "__z", grid.px, grid.py, ("__gx", "__gy"))
    second = gradients(gradients(first, "__gx", grid.px, grid.py, ("dxx", "__a")), "__gy", grid.px, grid.py, ("__b", "dyy"))
    known = F.col("z").isNotNull()
    return second.withColumns({
        "slope_deg": F.when(known, F.degrees(F.atan(F.hypot("__gx", "__gy")))).cast("float"),
        "dxx": F.when(known, F.col("dxx")), "dyy": F.when(known, F.col("dyy")),
    }).drop("__mean", "__z", "__gx", "__gy", "__a", "__b")


def flat(cells: DataFrame) -> DataFrame:
    """Adds ``flat``: the cell is as high as all its neighbours that exist."""
    around = with_neighbours(cells, ["z"])
    near = [F.col("z"), *(F.col(f"around.{k}.z") for k in OFFSETS)]
    return around.withColumn("flat", F.col("z").isNotNull() & (F.greatest(*near) == F.least(*near))).drop("around")


def flow_direction(cells: DataFrame, grid: Grid, name: str = "z") -> DataFrame:
    """Adds ``d8``: the index of the steepest drop in OFFSETS, the first of equals, -1 without one."""
    around = with_neighbours(cells, [name])
    diagonal = (grid.px**2 + grid.py**2) ** 0.5
    z, best = F.col(name).cast("double"), []
    for i, (k, (dr, dc)) in enumerate(OFFSETS.items()):
        step = diagonal if dr and dc else grid.py if dr else grid.px
        drop = (z - F.col(f"around.{k}.{name}").cast("double")) / step
        best.append(F.when(drop > 0, F.struct(drop.alias("drop"), F.lit(-i).alias("i"))))
    d8 = F.when(z.isNull(), None).otherwise(F.coalesce(-F.greatest(*best)["i"], F.lit(-1)))
    return around.withColumn("d8", d8.cast("int")).drop("around")
