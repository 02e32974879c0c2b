"""Drainage: depression filling, flow accumulation, channels and wetness."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.operators.fixpoint import TILE, settle, shifted, tile_fixpoint, to_cells, to_tiles
from ridgeline.operators.stats import percentiles
from ridgeline.operators.stencil import OFFSETS, gradients, with_neighbours
from ridgeline.operators.terrain import flow_direction
from ridgeline.sources.grid import Grid

RISE = 1e-3
LEAST_GRADE = 1e-3


def _pour(static: dict, water: np.ndarray, rise: float) -> np.ndarray:
    """Lowest surface that drains: each cell at its height, or just above its lowest neighbour."""
    z = static["z"][1:-1, 1:-1]

    def sweep(rows: slice, cols: slice, window: np.ndarray) -> bool:
        here, inner, changed = z[rows, cols], window[1:-1, 1:-1], False
        while True:
            low = np.minimum.reduce([np.where(np.isnan(n := shifted(window, *o)), np.inf, n) for o in OFFSETS.values()])
            new = np.minimum(inner, np.where(here > low, here, low + rise))  # NaN stays
            if np.array_equal(new, inner, equal_nan=True):
                return changed
            inner[...], changed = new, True

    return settle(water, sweep)


def fill(cells: DataFrame, grid: Grid, rise: float = RISE, size: int = TILE) -> DataFrame:
    """``r, c, filled``: the surface without depressions, each cell above a lower neighbour.

    Water starts at the grid's edge and beside NoData.  The result is the one fixpoint of a
    monotone rule, whatever the order in which tiles settle.
    """
    around = with_neighbours(cells.select("r", "c", "z"), ["z"])
    outlet = F.lit(False)
    for k in OFFSETS:
        outlet = outlet | F.col(f"around.{k}.z").isNull()
    z = F.col("z").cast("double")
    start = F.when(z.isNull(), None).when(outlet, z).otherwise(float("inf"))
    tiles = to_tiles(around.select("r", "c", z.alias("z"), start.alias("state")), grid, ["z", "state"], size)
    settled = tile_fixpoint(tiles, grid, ["z"], partial(_pour, rise=rise), size)
    return to_cells(settled, grid, ["state"], size=size).withColumnRenamed("state", "filled")


def _gather(static: dict, total: np.ndarray) -> np.ndarray:
    """Own cell and all that drains into it: cells pass their total on once nothing more comes."""
    high, wide = total.shape
    to = np.full((high, wide), -1)
    for k, (dr, dc) in enumerate(OFFSETS.values()):
        r, c = np.nonzero(static["d8"] == k)
        inside = (r + dr > 0) & (r + dr < high - 1) & (c + dc > 0) & (c + dc < wide - 1)
        to[r[inside], c[inside]] = ((r + dr) * wide + c + dc)[inside]
    to = to.ravel()
    inner = np.zeros((high, wide), bool)
    inner[1:-1, 1:-1] = ~np.isnan(static["d8"][1:-1, 1:-1])
    inner = inner.ravel()
    sums = np.where(inner, 1.0, 0.0)
    border = np.flatnonzero(~inner & (to >= 0) & ~np.isnan(total.ravel()))  # what other tiles have gathered so far
    np.add.at(sums, to[border], total.ravel()[border])
    waits = np.bincount(to[inner & (to >= 0)], minlength=len(to))
    front = np.flatnonzero(inner & (waits == 0))
    while len(front):
        front = front[to[front] >= 0]
        np.add.at(sums, to[front], sums[front])
        np.subtract.at(waits, to[front], 1)
        front = np.unique(to[front])
        front = front[waits[front] == 0]
    out = total.copy()
    out[1:-1, 1:-1] = np.where(inner, sums, np.nan).reshape(high, wide)[1:-1, 1:-1]
    return out


def flow(cells: DataFrame, grid: Grid, name: str = "filled", size: int = TILE) -> DataFrame:
    """``r, c, d8, upstream``: direction and number of cells that drain through each, itself included.

    Tiles add up their own cells, and pass on what leaves them; rounds follow the number of
    tiles on the longest way down.
    """
    directed = flow_direction(cells, grid, name).where(F.col(name).isNotNull())
    tiles = to_tiles(directed.select("r", "c", "d8", F.lit(1.0).alias("state")), grid, ["d8", "state"], size)
    settled = tile_fixpoint(tiles, grid, ["d8"], _gather, size)
    found = to_cells(settled, grid, ["d8", "state"], size=size).where("d8 is not null")
    return found.select("r", "c", F.col("d8").cast("int").alias("d8"), F.col("state").cast("long").alias("upstream"))


def wetness(cells: DataFrame, grid: Grid) -> DataFrame:
    """Adds ``twi`` to cells with ``filled`` and ``upstream``: ln(catchment per width / grade)."""
    sloped = gradients(cells, "filled", grid.px, grid.py, ("__gx", "__gy"))
    catchment = F.col("upstream") * grid.cell_area / ((grid.px + grid.py) / 2.0)
    grade = F.greatest(F.hypot("__gx", "__gy"), F.lit(LEAST_GRADE))
    twi = F.when(F.col("filled").isNotNull(), F.ln(F.greatest(catchment, F.lit(1e-6)) / grade))
    return sloped.withColumn("twi", twi).drop("__gx", "__gy")


def analyse(cells: DataFrame, grid: Grid, least_basin_km2: float = 1.0, size: int = TILE) -> DataFrame:
    """``r, c, z, filled, d8, upstream, basin_km2, channel, twi`` of every cell."""
    filled = cells.select("r", "c", "z").join(fill(cells, grid, size=size), ["r", "c"])
    joined = filled.join(flow(filled, grid, size=size), ["r", "c"], "left")
    basin = (F.col("upstream") * grid.cell_area / 1e6).cast("float")
    return wetness(joined, grid).withColumn("basin_km2", basin).withColumn("channel", F.coalesce(F.col("basin_km2") >= least_basin_km2, F.lit(False)))


def metrics(drainage: DataFrame, grid: Grid) -> DataFrame:
    """Channel cells and share, length and density of the network, sinks, wetness percentiles."""
    steps = list(OFFSETS.values())
    diagonal = (grid.px**2 + grid.py**2) ** 0.5
    length = F.element_at(F.array(*(F.lit(diagonal if a and b else grid.py if a else grid.px) for a, b in steps)), F.col("d8") + 1)
    step = F.when(F.col("d8") >= 0, length).otherwise(grid.px)
    valid = drainage.where("z is not null")
    found = valid.agg(
        F.count("*").alias("valid"), F.sum(F.col("channel").cast("int")).alias("channels"), (F.sum(F.when(F.col("channel"), step)) / 1000.0).alias("network_km"),
        F.sum(F.when(F.col("d8") < 0, 1).otherwise(0)).alias("sinks"),
    )
    found = found.join(F.broadcast(percentiles(valid, {f"twi_p{p}": (F.col("twi"), p) for p in (5, 50, 95)})))  # one row each
    return found.withColumns({"channel_share": F.col("channels") / F.col("valid"), "density": F.coalesce("network_km", F.lit(0.0)) / (F.col("valid") * grid.cell_area / 1e6)})


def ford_class(basin_km2, ford_most_km2: float = 50.0):
    """1 where a stream can be forded, 2 above the ceiling, NULL off streams."""
    return F.when(basin_km2.isNotNull(), F.when(basin_km2 > ford_most_km2, 2).otherwise(1))
