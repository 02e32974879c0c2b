"""Exact Euclidean distance to marked cells, buffers, nearest features, snapping, containment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.sources.grid import Grid

GATHER_TILE = 512  # rows and columns of the source, gathered from at once
STRIP = 16  # rows whose nearest columns are sought at once
CLOSE = 32  # columns to each side that are compared one by one


def _envelope(height: np.ndarray, spacing: float) -> tuple[np.ndarray, np.ndarray]:
    """For each place, min over k of height[k] + (spacing * (place - k))**2 and its k, by the lower envelope of parabolas."""
    n, at = len(height), np.flatnonzero(np.isfinite(height))
    if not len(at):
        return np.full(n, np.inf), np.full(n, -1)
    s2, hull, cut = spacing * spacing, [int(at[0])], [-np.inf]
    for q in map(int, at[1:]):
        while True:
            p = hull[-1]
            x = ((height[q] + s2 * q * q) - (height[p] + s2 * p * p)) / (2 * s2 * (q - p))
            if x > cut[-1]:
                break
            hull.pop()
            cut.pop()
        hull.append(q)
        cut.append(x)
    k = np.array(hull)[np.searchsorted(np.array(cut), np.arange(n), "left") - 1] if len(hull) > 1 else np.full(n, hull[0])
    place = np.arange(n)
    return height[k] + s2 * (place - k) ** 2, k


def _nearest(height: np.ndarray, spacing: float) -> tuple[np.ndarray, np.ndarray]:
    """``_envelope`` of each row of ``height``: what lies close is compared for all rows at once, farther places by their parabolas.

    Most places of a well marked grid need few steps; a row that needs more than ``CLOSE`` is done whole.
    """
    n, s2 = height.shape[1], spacing * spacing
    best, k = height.copy(), np.where(np.isfinite(height), np.arange(n), -1)
    for step in range(1, min(CLOSE, n - 1) + 1):
        open_ = best >= s2 * step * step  # nothing farther is nearer, nor an equal in a smaller place
        if not open_.any():
            return best, k
        for here, there in ((slice(step, None), slice(None, -step)), (slice(None, -step), slice(step, None))):
            d2 = height[:, there] + s2 * step * step
            place = np.arange(n)[there]
            nearer = (d2 < best[:, here]) | (np.isfinite(d2) & (d2 == best[:, here]) & (place < k[:, here]))
            np.copyto(best[:, here], d2, where=nearer)
            np.copyto(k[:, here], np.broadcast_to(place, nearer.shape), where=nearer)
    for i in np.flatnonzero((best >= s2 * min(CLOSE + 1, n) ** 2).any(axis=1)):
        best[i], k[i] = _envelope(height[i], spacing)
    return best, k


def distance_to(cells: DataFrame, grid: Grid, mask: str) -> DataFrame:
    """``r, c, distance, near_r, near_c`` of every cell of a complete grid; NULL where nothing is marked.

    Separable: running windows down and up the columns find the nearest marked row above and below, then each
    row finds its nearest column in one task, together with the rows of its strip.
    """
    above = Window.partitionBy("c").orderBy("r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Upwards and not to an unbounded end: such a frame is gone through anew for each row.
    below = Window.partitionBy("c").orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = F.when(F.col(mask), F.col("r"))
    rows = cells.select("r", "c", F.last(here, ignorenulls=True).over(above).alias("a"), F.last(here, ignorenulls=True).over(below).alias("b"))
    nearer = F.when(F.col("b").isNull() | (F.col("r") - F.col("a") <= F.col("b") - F.col("r")), F.col("a")).otherwise(F.col("b"))
    tall = rows.select("r", "c", nearer.alias("near"), F.floor(F.col("r") / STRIP).alias("strip"))

    def strip(key: tuple, t: pa.Table) -> pa.Table:
        top = key[0].as_py() * STRIP
        r, c = t.column("r").to_numpy(), t.column("c").to_numpy()
        near = np.full((STRIP, grid.cols), np.nan)
        near[r - top, c] = t.column("near").to_numpy(zero_copy_only=False)
        away = (near - np.arange(top, top + STRIP)[:, None]) * grid.py
        d2, k = _nearest(np.where(np.isnan(near), np.inf, away**2), grid.px)
        d2, k, row = d2[r - top, c], k[r - top, c], near[r - top, k[r - top, c]]
        some = np.isfinite(d2)
        pick = lambda v: pa.array(np.where(some, v, 0), mask=~some)
        return pa.table({"r": r, "c": c, "distance": pick(np.sqrt(np.where(some, d2, 0))), "near_r": pick(np.nan_to_num(row).astype(np.int64)), "near_c": pick(k)})

    return tall.groupBy("strip").applyInArrow(strip, "r long, c long, distance double, near_r long, near_c long")


def buffer(cells: DataFrame, grid: Grid, mask: str, radius: float) -> DataFrame:
    """``r, c`` of the cells whose centre is within ``radius`` of a marked cell's centre.

    Every marked cell gives the offsets of a disk, so only marked cells and their
    surroundings move, whatever the size of the grid.
    """
    nr, nc = int(radius // grid.py), int(radius // grid.px)
    disk = [(a, b) for a in range(-nr, nr + 1) for b in range(-nc, nc + 1) if (a * grid.py) ** 2 + (b * grid.px) ** 2 <= radius * radius]
    offsets = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in disk)))
    spread = cells.where(F.col(mask)).select("r", "c", offsets.alias("o")).select((F.col("r") + F.col("o.a")).alias("r"), (F.col("c") + F.col("o.b")).alias("c"))
    return spread.where(grid.holds(F.col("r"), F.col("c"))).distinct()


def nearest_feature(cells: DataFrame, grid: Grid, mask: str, value: str, radius: float) -> DataFrame:
    """``r, c, distance, value``: cells near marked ones, with the value of the nearest marked cell."""
    near = distance_to(cells, grid, mask).where(F.col("distance") <= radius)
    marked = cells.where(F.col(mask)).select(F.col("r").alias("near_r"), F.col("c").alias("near_c"), F.col(value).alias("value"))
    return near.join(marked, ["near_r", "near_c"]).select("r", "c", "distance", "value")


def snap(points: DataFrame, cells: DataFrame, grid: Grid, mask: str, most_cells: int = 30) -> DataFrame:
    """Each of ``ord, r, c`` with ``snap_r, snap_c, moved_m``: the nearest marked cell, the first in row order on ties.

    Points reach cells through blocks of ``most_cells`` rows and columns, so a point meets
    nine blocks and not the grid.
    """
    block = lambda name, d=0: F.floor(F.col(name) / most_cells) + d
    around = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1))))
    asked = points.select("ord", F.col("r").alias("pr"), F.col("c").alias("pc"), around.alias("o")).select("ord", "pr", "pc", (block("pr") + F.col("o.a")).alias("br"), (block("pc") + F.col("o.b")).alias("bc"))
    there = cells.where(F.col(mask)).select("r", "c", block("r").alias("br"), block("c").alias("bc"))
    d2 = ((F.col("r") - F.col("pr")) * grid.py) ** 2 + ((F.col("c") - F.col("pc")) * grid.px) ** 2
    close = asked.join(there, ["br", "bc"]).where((F.abs(F.col("r") - F.col("pr")) <= most_cells) & (F.abs(F.col("c") - F.col("pc")) <= most_cells))
    best = close.groupBy("ord").agg(F.min(F.struct(d2.alias("d2"), "r", "c")).alias("best"))
    return points.join(best, "ord", "left").select("ord", "r", "c", F.col("best.r").alias("snap_r"), F.col("best.c").alias("snap_c"), F.sqrt("best.d2").alias("moved_m"))


def rasterize(edges: DataFrame, grid: Grid) -> DataFrame:
    """``r, c`` of cells whose centre lies inside polygons given as ``fid, x1, y1, x2, y2`` (ring sides).

    A side meets the rows whose centre line it crosses; crossings of a row are paired in
    order (even-odd rule) and each pair fills a run of cells.  Work follows the outline.
    """
    y1, y2 = (F.least("y1", "y2"), F.greatest("y1", "y2"))
    row_of = lambda y: (F.lit(grid.y0) - y) / -grid.dy - 0.5
    first, last = F.greatest(F.ceil(row_of(y2)), F.lit(0)), F.least(F.ceil(row_of(y1)) - 1, F.lit(grid.rows - 1))
    crossed = edges.where((F.col("y1") != F.col("y2")) & (first <= last)).select("fid", "x1", "y1", "x2", "y2", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("r"))
    y = F.lit(grid.y0) + (F.col("r") + 0.5) * grid.dy
    x = F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    lines = crossed.select("fid", "r", x.alias("x")).groupBy("fid", "r").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    pairs = lines.select("fid", "r", F.explode(F.expr("transform(sequence(0, size(xs) div 2 - 1), i -> struct(xs[2 * i] AS a, xs[2 * i + 1] AS b))")).alias("p"))
    col_of = lambda v: (v - grid.x0) / grid.dx - 0.5
    c1, c2 = F.greatest(F.ceil(col_of(F.col("p.a"))), F.lit(0)), F.least(F.ceil(col_of(F.col("p.b"))) - 1, F.lit(grid.cols - 1))
    return pairs.where(c1 <= c2).select("r", F.explode(F.sequence(c1.cast("long"), c2.cast("long"))).alias("c")).distinct()


def constraint_cells(edges: DataFrame, grid: Grid, margin: float = 0.0) -> DataFrame:
    """Cells whose centre is inside polygons, or at most ``margin`` from their sides."""
    inside = rasterize(edges, grid)
    return inside if margin <= 0 else inside.union(within(edges, grid, margin)).distinct()


TAPS = {"nearest": (0,), "bilinear": (0, 1), "cubic": (-1, 0, 1, 2)}


def _weights(d: np.ndarray, method: str) -> np.ndarray:
    d = np.abs(d)
    if method == "nearest":
        return np.ones_like(d)
    if method == "bilinear":
        return np.maximum(1.0 - d, 0.0)
    return np.where(d <= 1, d * d * (d * 1.5 - 2.5) + 1.0, np.where(d < 2, ((d * -0.5 + 2.5) * d - 4.0) * d + 2.0, 0.0))


def resample(cells: DataFrame, source: Grid, target: Grid, value: str, method: str = "bilinear", x=None, y=None, size: int | None = None) -> DataFrame:
    """``r, c, value`` on the target grid.

    ``x`` and ``y`` give the source coordinates of a target cell, if not its own centre's (see
    ``crs``).  Target cells go to the source tile that they lie in, and source cells to their tile and, at its edge,
    to those beside it, so every row is sent about once; a tile then gathers the 1, 4 or 16 values of each of
    its target cells.  NoData is left out and the weights of the rest are scaled up.
    """
    if method not in TAPS:
        raise ValueError(f"no resampling method {method}")
    spark = cells.sparkSession
    every = spark.range(target.rows * target.cols).select(F.expr(f"id div {target.cols}").alias("r"), (F.col("id") % target.cols).alias("c"))
    wx, wy = target.to_world(F.col("r"), F.col("c"))
    at = every.withColumns({"__x": wx if x is None else x, "__y": wy if y is None else y})
    det = source.dx * source.dy - source.rx * source.ry
    u, v = F.col("__x") - source.x0, F.col("__y") - source.y0
    fc, fr = (u * source.dy - v * source.rx) / det, (v * source.dx - u * source.ry) / det
    if not source.rotated:
        fc, fr = u / source.dx, v / source.dy
    at = at.where((fc >= 0) & (fc < source.cols) & (fr >= 0) & (fr < source.rows))
    shift = 0.0 if method == "nearest" else 0.5
    # A tile of finer target cells holds fewer source cells, so that it has as many rows.
    size = size or max(16, int(GATHER_TILE * min(1.0, (target.rows * target.cols / (source.rows * source.cols)) ** -0.5)))
    asked = at.select("r", "c", (fr - shift).alias("fr"), (fc - shift).alias("fc")).withColumns({"tr": F.floor(F.col("fr") / size), "tc": F.floor(F.col("fc") / size)})
    # A source cell is needed where the row before a target cell's place is at most two above it or one below.
    near = [F.array_distinct(F.array(*(F.floor((F.col(n) + d) / size) for d in (-2, 1)))) for n in "rc"]
    known = cells.where(F.col(value).isNotNull()).select("r", "c", F.col(value).cast("double").alias("v"), F.explode(near[0]).alias("tr"), near[1].alias("tcs")).withColumn("tc", F.explode("tcs")).drop("tcs")
    taps = TAPS[method]
    schema = pa.schema([("r", pa.int64()), ("c", pa.int64()), ("v", pa.float64())])

    def gather(key: tuple, wanted: pa.Table, have: pa.Table) -> pa.Table:
        if not wanted.num_rows or not have.num_rows:
            return schema.empty_table()
        top, left = (k.as_py() * size - 1 for k in key)
        values = np.full((size + 3, size + 3), np.nan)
        values[have.column("r").to_numpy() - top, have.column("c").to_numpy() - left] = have.column("v").to_numpy()
        fr, fc = wanted.column("fr").to_numpy(), wanted.column("fc").to_numpy()
        r0, c0 = np.floor(fr), np.floor(fc)
        total, weight, some = np.zeros(len(fr)), np.zeros(len(fr)), np.zeros(len(fr), bool)
        for a in taps:
            for b in taps:
                v = values[(r0 + a).astype(np.int64) - top, (c0 + b).astype(np.int64) - left]
                here = ~np.isnan(v)
                w = _weights(fr - r0 - a, method) * _weights(fc - c0 - b, method)
                total += np.where(here, w * np.where(here, v, 0.0), 0.0)
                weight += np.where(here, w, 0.0)
                some |= here
        made = np.divide(total, weight, out=np.full(len(fr), np.nan), where=weight != 0)
        rows = pa.table([wanted.column("r"), wanted.column("c"), pa.array(made, mask=weight == 0)], schema=schema)
        return rows.filter(pa.array(some))

    found = asked.groupBy("tr", "tc").cogroup(known.groupBy("tr", "tc")).applyInArrow(gather, "r long, c long, v double")
    return found.select("r", "c", F.col("v").alias(value))


def within(edges: DataFrame, grid: Grid, margin: float) -> DataFrame:
    """``r, c`` of cells whose centre is at most ``margin`` from a side of ``x1, y1, x2, y2``: round corners, exactly.

    Sides are cut to pieces of twice the margin, and a piece meets the cells of its own box alone, so work follows the outline.
    """
    n = F.greatest(F.ceil(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) / max(2 * margin, 4 * max(grid.px, grid.py))), F.lit(1))
    cut = edges.select("x1", "y1", "x2", "y2", n.alias("n")).select("x1", "y1", "x2", "y2", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    along = lambda a, k: F.col(f"{a}1") + (F.col(f"{a}2") - F.col(f"{a}1")) * (F.col("k") + k) / F.col("n")
    pieces = cut.select(*(along(a, k).alias(f"{p}{a}") for p, k in (("p", 0), ("q", 1)) for a in "xy"))

    def span(name: str, origin: float, step: float, count: int):
        """Rows or columns whose centres may be near enough, with one to spare at each end."""
        ends = [(F.col(f"{p}{name}") - origin) / step - 0.5 for p in "pq"]
        reach = margin / abs(step) + 1
        return F.greatest(F.ceil(F.least(*ends) - reach), F.lit(0)).cast("long"), F.least(F.floor(F.greatest(*ends) + reach), F.lit(count - 1)).cast("long")

    rows, cols = span("y", grid.y0, grid.dy, grid.rows), span("x", grid.x0, grid.dx, grid.cols)
    boxed = pieces.where((rows[0] <= rows[1]) & (cols[0] <= cols[1])).select("*", F.explode(F.sequence(*rows)).alias("r")).select("*", F.explode(F.sequence(*cols)).alias("c"))
    x, y = grid.to_world(F.col("r"), F.col("c"))
    vx, vy = F.col("qx") - F.col("px"), F.col("qy") - F.col("py")
    t = F.coalesce(F.try_divide((x - F.col("px")) * vx + (y - F.col("py")) * vy, vx * vx + vy * vy), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    near = (x - F.col("px") - vx * t) ** 2 + (y - F.col("py") - vy * t) ** 2 <= margin * margin
    return boxed.where(near).select("r", "c").distinct()


def polygon_measures(edges: DataFrame) -> DataFrame:
    """``fid, area, length`` of polygons by their sides; holes run the other way round."""
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    return edges.groupBy("fid").agg(F.abs(F.sum(cross) / 2).alias("area"), F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("length"))
