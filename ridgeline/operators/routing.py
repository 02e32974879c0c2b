"""Least-cost routes on the grid: edges, distances, paths, orders of waypoints, corridors.

Distances are fixpoints over tiles (``searches``): each tile relaxes its own cells and only borders
travel, so a search is bound by no task, and all searches of a route or corridor run together.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions import cellwise as fn
from ridgeline.operators.distance import distance_to, within
from ridgeline.operators.fixpoint import TILE, settle, shifted, tile_fixpoint, to_cells, to_tiles
from ridgeline.operators.regions import outlines, regions
from ridgeline.operators.searches import ROUNDING, Ask, Searches
from ridgeline.operators.stencil import OFFSETS, with_neighbours
from ridgeline.session import materialize
from ridgeline.sources.grid import Grid

DETOUR_RATIO, DETOUR_METRES = 1.25, 500.0
SHOWN, APART_BUFFERS, APART_CELLS = 3.0, 4.0, 10.0


def edges(cells: DataFrame, grid: Grid, cost: str = "cost", z: str | None = None) -> DataFrame:
    """``src, dst, w`` between passable neighbours (node = row * cols + col).

    A step costs the mean of its cells' costs by its length, or by walking time if ``z`` is given.
    A diagonal step needs both cells beside it to be passable or outside of the grid.
    """
    inside = F.lit(1).alias("inside")
    around = with_neighbours(cells.select("r", "c", F.col(cost).cast("double").alias("cost"), *([F.col(z).cast("double").alias("z")] if z else []), inside), ["cost", "inside", *(["z"] if z else [])])
    px = grid.cell_area**0.5
    out = []
    for k, (dr, dc) in OFFSETS.items():
        there = F.col(f"around.{k}.cost")
        length = px * (2**0.5 if dr and dc else 1.0)
        mean = (F.col("cost") + there) / 2.0
        w = mean * (fn.tobler_hours(F.col(f"around.{k}.z") - F.col("z"), F.lit(length)) if z else length)
        free = there.isNotNull()
        for name in [n for n, o in OFFSETS.items() if dr and dc and o in ((dr, 0), (0, dc))]:
            free = free & (F.col(f"around.{name}.cost").isNotNull() | F.col(f"around.{name}.inside").isNull())
        out.append(F.when(free & F.col("cost").isNotNull(), F.struct(((F.col("r") + dr) * grid.cols + F.col("c") + dc).alias("dst"), w.alias("w"))))
    each = around.select((F.col("r") * grid.cols + F.col("c")).alias("src"), F.explode(F.array(*out)).alias("e")).where("e is not null")
    return each.select("src", "e.dst", "e.w")


def distances(cells: DataFrame, grid: Grid, source: tuple[int, int], cost: str = "cost", z: str | None = None, reverse: bool = False, size: int = TILE) -> DataFrame:
    """``r, c, distance, back`` from a cell to all others (to it from all, reversed); see ``Searches``."""
    return Searches(cells, grid, [Ask(source, cost=cost, reverse=reverse)], z, size=size).cells().drop("search")


def route(cells: DataFrame, grid: Grid, points: list[tuple[int, int]], cost: str = "cost", z: str | None = None, optimise: bool = False, ford: str | None = None, size: int = TILE) -> DataFrame:
    """``leg, seq, r, c, distance`` through the points in order (or in the best order of the inner ones).

    All legs are one set of searches, each bounded by what its end costs.  They share no cell twice: each
    but the first starts after its first cell.  ``ford`` is a raster of factors for crossing streams.
    Raises if a leg has no way or two points in a row are one cell.
    """
    order = waypoint_order(cells, grid, points, cost, z, size) if optimise and len(points) > 3 else list(range(len(points)))
    points = [points[i] for i in order]
    pairs = list(zip(points, points[1:]))
    for k, (a, b) in enumerate(pairs):
        if a == b:
            raise ValueError(f"points {k} and {k + 1} of the route are in one cell")
    found = materialize(Searches(cells, grid, [Ask(a, (b,), cost) for a, b in pairs], z, ford, size, bounded=True).paths(), "legs")
    reached = {row.search for row in found.select("search").distinct().collect()}  # a row for each leg
    for k, (a, b) in enumerate(pairs):
        if k not in reached:
            raise NoWay(f"no way from {a} to {b}")
    return found.where("search = 0 or seq > 0").select(F.col("search").alias("leg"), "seq", "r", "c", "distance")


def pair_costs(cells: DataFrame, grid: Grid, points: list[tuple[int, int]], cost: str = "cost", z: str | None = None, size: int = TILE) -> dict[tuple[int, int], float]:
    """Costs between points, but into the first and out of the last: one set of searches, one for each start."""
    n = len(points)
    into = [[j for j in range(1, n) if j != i] for i in range(n - 1)]
    asks = [Ask(points[i], tuple(points[j] for j in into[i]), cost) for i in range(n - 1)]
    found = Searches(cells, grid, asks, z, size=size, bounded=True).costs_of_targets()
    return {(i, j): found.get((i, k), float("inf")) for i in range(n - 1) for k, j in enumerate(into[i])}


def best_order(n: int, costs: dict[tuple[int, int], float]) -> list[int]:
    """Held-Karp over the inner points, ends fixed."""
    inner = range(1, n - 1)
    best = {(1 << (j - 1), j): (costs[0, j], (0, j)) for j in inner}
    for _ in range(n - 3):
        grown: dict = {}
        for (seen, i), (total, way) in best.items():
            for j in inner:
                if not seen >> (j - 1) & 1:
                    key, value = (seen | 1 << (j - 1), j), (total + costs[i, j], (*way, j))
                    if key not in grown or value < grown[key]:
                        grown[key] = value
        best = grown
    ends = [(total + costs[j, n - 1], (*way, n - 1)) for (_, j), (total, way) in best.items()] or [(costs[0, n - 1], (0, n - 1))]
    total, way = min(ends)
    if total == float("inf"):
        raise NoWay("no order joins all points")
    return list(way)


def waypoint_order(cells: DataFrame, grid: Grid, points: list[tuple[int, int]], cost: str = "cost", z: str | None = None, size: int = TILE, most: int = 8) -> list[int]:
    if len(points) - 2 > most:
        raise ValueError(f"at most {most} inner points can be put in order")
    return best_order(len(points), pair_costs(cells, grid, points, cost, z, size))


def corridor(cells: DataFrame, grid: Grid, legs: list[tuple[tuple[int, int], tuple[int, int]]], slack: float, cost: str = "cost", z: str | None = None, size: int = TILE) -> DataFrame:
    """``r, c, slack``: cells on ways that cost at most ``slack`` (a share) more than the best, least over legs.

    Both searches of every leg are one set, bounded by that cost.  Legs without a way, or of no cost, have no corridor.
    """
    asks = [ask for a, b in legs for ask in (Ask(a, (b,), cost), Ask(b, (a,), cost, reverse=True))]
    found = Searches(cells, grid, asks, z, size=size, bounded=True, beyond=1.0 + slack + ROUNDING)
    far = materialize(found.cells().where("distance is not null").select((F.col("search") / 2).cast("int").alias("leg"), (F.col("search") % 2).alias("way"), "r", "c", "distance"), "corridor")
    there, back = (far.where(F.col("way") == k).select("leg", "r", "c", F.col("distance").alias(f"d{k}")) for k in (0, 1))
    best = [far.where((F.col("leg") == k) & (F.col("way") == 0) & (F.col("r") == b[0]) & (F.col("c") == b[1]) & (F.col("distance") > 0)) for k, (_, b) in enumerate(legs)]
    best = reduce(DataFrame.unionByName, best).select("leg", F.col("distance").alias("best"))
    both = there.join(back, ["leg", "r", "c"]).join(F.broadcast(best), "leg")  # a row for each leg
    inside = both.select("r", "c", ((F.col("d0") + F.col("d1")) / F.col("best") - 1.0).alias("slack")).where(F.col("slack") <= slack + ROUNDING)
    return inside.groupBy("r", "c").agg(F.min("slack").alias("slack"))


class NoWay(ValueError):
    """Points of a route that no way joins, with what would join them.

    ``needed``: the least slope limit, in whole percent, that would do, or None; ``by_corner``: whether
    the points only meet where cells touch at a corner.
    """

    def __init__(self, message: str, needed: int | None = None, by_corner: bool = False):
        super().__init__(message)
        self.needed, self.by_corner = needed, by_corner


def _highest(static: dict, least: np.ndarray) -> np.ndarray:
    """One tile's least highest value on the way from the source, over four neighbours."""
    own = static["value"][1:-1, 1:-1]
    least[np.isnan(least)] = np.inf

    def sweep(rows: slice, cols: slice, window: np.ndarray) -> bool:
        inner, here, changed = window[1:-1, 1:-1], own[rows, cols], False
        shut = np.isnan(here)
        while True:
            new = np.minimum(inner, np.maximum(here, np.minimum.reduce([shifted(window, *o) for o in ((-1, 0), (0, -1), (0, 1), (1, 0))])))
            new[shut] = np.inf
            if np.array_equal(new, inner):
                return changed
            inner[...], changed = new, True

    return settle(least, sweep)


def least_limits(cells: DataFrame, grid: Grid, source: tuple[int, int], value: str = "slope", size: int = TILE) -> DataFrame:
    """``r, c, limit``: the least limit on ``value`` under which a cell is joined to the source.

    That is the smallest, over all ways, of the greatest value on the way, both ends included: one fixpoint in
    place of labelling once for each limit.  A way takes four neighbours, since a diagonal step needs both
    cells beside it.  Cells without a value are closed; what nothing joins has NULL.
    """
    start = F.when((F.col("r") == source[0]) & (F.col("c") == source[1]), F.col(value).cast("double")).otherwise(float("inf"))
    rows = cells.select("r", "c", F.col(value).cast("double").alias("value"), start.alias("state"))
    tiles = tile_fixpoint(to_tiles(rows, grid, ["value", "state"], size), grid, ["value"], _highest, size)
    found = to_cells(tiles, grid, ["state"], None, ["state"], size)
    return found.select("r", "c", F.when(F.col("state") < float("inf"), F.col("state")).alias("limit"))


def _at(cells: DataFrame, grid: Grid, points: list[tuple[int, int]]) -> DataFrame:
    """The rows of the points, as many at most."""
    return cells.where((F.col("r") * grid.cols + F.col("c")).isin([r * grid.cols + c for r, c in points]))


def joined(cells: DataFrame, grid: Grid, points: list[tuple[int, int]], mask: str, connectivity: int = 4, size: int = TILE) -> bool:
    """Whether cells lie in one region of the mask."""
    at = _at(regions(cells, grid, mask, connectivity, size), grid, points).collect()
    return len(at) == len(set(points)) and len({row.region for row in at}) == 1


def only_by_corner(cells: DataFrame, grid: Grid, points: list[tuple[int, int]], mask: str, size: int = TILE) -> bool:
    """Whether some of the ways between cells all pass a corner where four cells touch."""
    return joined(cells, grid, points, mask, 8, size) and not joined(cells, grid, points, mask, 4, size)


def connecting_slope(cells: DataFrame, grid: Grid, points: list[tuple[int, int]], slope: str = "slope", least: float = 0.0, size: int = TILE) -> int | None:
    """Least slope limit, in whole percent and not under ``least``, that joins all points; None if none does.

    Cells that are closed for other reasons have a NULL slope.
    """
    found = {(row.r, row.c): row.limit for row in _at(least_limits(cells, grid, points[0], slope, size), grid, points).collect()}
    limits = [found.get(tuple(p)) for p in points]
    return None if None in limits else int(np.ceil(max(*limits, least)))


def explain_no_way(cells: DataFrame, grid: Grid, points: list[tuple[int, int]], slope_max: float, cost: str = "cost", slope: str = "slope", size: int = TILE) -> NoWay:
    """The error for points that no way joins.  ``slope`` is NULL where more than the slope closes a cell."""
    top = cells.agg(F.max(slope)).first()[0]
    # With no slope above the limit, the limit is not what parts the points.
    needed = connecting_slope(cells, grid, points, slope, slope_max, size) if top is not None and top > slope_max else None
    by_corner = only_by_corner(cells.withColumn("__open", F.col(cost).isNotNull()), grid, points, "__open", size)
    if needed is not None:
        hint = f"a slope limit of {needed} % would join them; it is {slope_max:g} % now, on cells of {grid.cell_area**0.5:g} m"
    elif by_corner:
        hint = "their ways only meet where cells touch at a corner, which has no width to walk through"
    else:
        hint = "no slope limit joins them: barriers, water or cells without data lie between"
    return NoWay(f"no way between the points: {hint}", needed, by_corner)


def path_metrics(path: DataFrame, grid: Grid, by: list[str], z: str = "z") -> DataFrame:
    """Length, walking time, ascent, descent and altitudes of paths with ``seq, r, c`` and altitude."""
    over = Window.partitionBy(*by).orderBy("seq")
    px = grid.cell_area**0.5
    step = F.hypot(F.col("r") - F.lag("r").over(over), F.col("c") - F.lag("c").over(over)) * px
    rise = F.col(z).cast("double") - F.lag(F.col(z).cast("double")).over(over)
    steps = path.withColumns({"__step": step, "__rise": rise})
    return steps.groupBy(*by).agg(
        F.count("*").alias("vertices"), F.coalesce(F.sum("__step"), F.lit(0.0)).alias("length_m"), F.coalesce(F.sum(fn.tobler_hours(F.col("__rise"), F.col("__step"))), F.lit(0.0)).alias("hours"),
        F.coalesce(F.sum(F.greatest("__rise", F.lit(0.0))), F.lit(0.0)).alias("gain_m"), F.coalesce(F.sum(F.greatest(-F.col("__rise"), F.lit(0.0))), F.lit(0.0)).alias("loss_m"),
        F.min(z).alias("alt_min"), F.max(z).alias("alt_max"), F.min_by(z, "seq").alias("alt_start"), F.max_by(z, "seq").alias("alt_end"),
    )


def detour(path: DataFrame, grid: Grid, by: list[str], limit: float, slope: str = "slope") -> DataFrame:
    """``steepest, metres_above``: the greatest slope, and the length of steps with an end above the limit."""
    over = Window.partitionBy(*by).orderBy("seq")
    step = F.hypot(F.col("r") - F.lag("r").over(over), F.col("c") - F.lag("c").over(over)) * grid.cell_area**0.5
    above = (F.col(slope) > limit) | (F.lag(slope).over(over) > limit)
    steps = path.withColumns({"__m": F.when(above, step)})
    return steps.groupBy(*by).agg(F.max(slope).alias("steepest"), F.coalesce(F.sum("__m"), F.lit(0.0)).alias("metres_above"))


def slope_detour(path: DataFrame, free: DataFrame, grid: Grid, by: list[str], limit: float, slope: str = "slope", z: str = "z") -> DataFrame:
    """A route beside the one without the slope limit: lengths, their ratio, and ``detour`` where the limit forces a long way round.

    ``steepest`` and ``metres_above`` are those of the route without the limit.
    """
    length = lambda p, name: path_metrics(p, grid, by, z).select(*by, F.col("length_m").alias(name))
    both = length(path, "length_m").join(length(free, "free_length_m"), by).join(detour(free, grid, by, limit, slope), by)
    ratio = F.try_divide("length_m", "free_length_m")
    long = (ratio >= DETOUR_RATIO) & (F.col("length_m") - F.col("free_length_m") >= DETOUR_METRES) & (F.col("metres_above") > 0)
    return both.withColumns({"ratio": ratio, "detour": F.coalesce(long, F.lit(False))})


def profile(path: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """``<value>_mean, <value>_median, <value>_max`` over the vertices of each path that have the value."""
    each = [a for v in values for a in (F.avg(v).alias(f"{v}_mean"), F.median(v).alias(f"{v}_median"), F.max(v).alias(f"{v}_max"))]
    return path.groupBy(*by).agg(*each)


def lines(path: DataFrame, grid: Grid, by: list[str]) -> DataFrame:
    """``coordinates``: the cell centres ``[x, y]`` of each path in order, one value for a path, as vector files want it."""
    whole = path.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("seq", F.array(*grid.to_world(F.col("r"), F.col("c"))).alias("at")))).alias("k"))
    return whole.select(*by, F.transform("k", lambda p: p["at"]).alias("coordinates"))


def buffered(path: DataFrame, grid: Grid, by: list[str], margin: float) -> DataFrame:
    """``r, c`` of cells whose centre is at most ``margin`` from the paths' lines."""
    x, y = grid.to_world(F.col("r"), F.col("c"))
    over = Window.partitionBy(*by).orderBy("seq")
    sides = path.select(x.alias("x1"), y.alias("y1"), F.lead(x).over(over).alias("x2"), F.lead(y).over(over).alias("y2"))
    return within(sides.withColumns({"x2": F.coalesce("x2", "x1"), "y2": F.coalesce("y2", "y1")}), grid, margin)


def alternatives(cells: DataFrame, grid: Grid, path: DataFrame, stops: list[tuple[int, int]], slack: float, buffer_m: float, cost: str = "cost", z: str | None = None) -> dict[str, DataFrame]:
    """What nearly as good ways there are beside the route through ``stops``.

    ``cells``: ``r, c, slack`` of cells on ways that cost at most ``slack`` (a share) more; ``raster``: ``r, c, slack_pct`` up
    to ``SHOWN`` times as much, which also shows what nearly came in; ``extent``: one row of area, the greatest distance from
    the route, and ``apart``, whether that is more than ``APART_BUFFERS`` buffers and ``APART_CELLS`` cells: a small change
    of the relief may then move the whole route; ``outlines``: the parts of the corridor as rings of corners.

    One corridor of the widest slack gives all of it.  ``cells`` are complete; cells of the corridor that are not in them do not count.
    """
    wide = materialize(corridor(cells, grid, list(zip(stops, stops[1:])), SHOWN * slack, cost, z), "alternatives")
    near = wide.where(F.col("slack") <= slack + ROUNDING)
    apart = F.col("farthest_m") > max(APART_BUFFERS * buffer_m, APART_CELLS * grid.px)
    extent = corridor_extent(near, path, cells, grid).withColumns({"slack_pct": F.lit(100.0 * slack), "apart": apart})
    parts = outlines(regions(near.withColumn("in", F.lit(True)), grid, "in"), grid)
    raster = wide.select("r", "c", (100.0 * F.greatest("slack", F.lit(0.0))).alias("slack_pct"))
    return {"cells": near, "raster": raster, "extent": extent, "outlines": parts}


def corridor_extent(wide: DataFrame, path: DataFrame, cells: DataFrame, grid: Grid) -> DataFrame:
    """``area_ha, farthest_m``: one row of a corridor's area and its greatest distance from the route, on complete ``cells``."""
    marked = cells.select("r", "c").join(path.select("r", "c", F.lit(True).alias("on")).distinct(), ["r", "c"], "left")
    away = distance_to(marked, grid, "on").select("r", "c", "distance")
    return wide.join(away, ["r", "c"]).agg((F.count("*") * grid.cell_area / 1e4).alias("area_ha"), F.coalesce(F.max("distance"), F.lit(0.0)).alias("farthest_m"))
