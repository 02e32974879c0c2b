"""How well a model fits the field: correlations, binned medians, transects, use of classes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions import cellwise as fn
from ridgeline.operators import sequences
from ridgeline.operators.fixpoint import TILE
from ridgeline.operators.searches import Ask, Searches
from ridgeline.operators.stats import order_statistics
from ridgeline.session import materialize
from ridgeline.sources.grid import Grid


def correlations(rows: DataFrame, pairs: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One row with the correlation of each named pair."""
    return rows.agg(*(F.corr(a.cast("double"), b.cast("double")).alias(n) for n, (a, b) in pairs.items()))


def binned_medians(rows: DataFrame, x: str, y: str, low: float, high: float, bins: int, least: int = 1) -> DataFrame:
    """``bin, center, n, median`` of ``y`` in equal bins of ``x`` (1 to ``bins``; what lies outside is left out)."""
    at = F.width_bucket(F.col(x).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins))
    placed = materialize(rows.select(at.alias("bin"), F.col(y).cast("double").alias("median")).where("bin is not null and median is not null"), "binned")
    found = placed.groupBy("bin").agg(F.count("*").alias("n")).join(order_statistics(placed, "bin", "median", [50]), "bin")
    width = (high - low) / bins
    return found.where(F.col("bin").between(1, bins) & (F.col("n") >= least)).select(F.col("bin").cast("long").alias("bin"), (low + (F.col("bin") - 0.5) * width).alias("center"), "n", "median")


@dataclass(frozen=True)
class Setting:
    """Parameters of a route: how much terrain slows down, how fast speed falls with the grade, the factor on drainage."""

    slowdown: float = 2.0
    decay: float = fn.DECAY
    penalty: float = 1.0


def sweep(cells: DataFrame, grid: Grid, settings: list[Setting], cases: list[tuple[tuple[int, int], tuple[tuple[int, int], ...]]], score: str = "score", z: str = "z", drainage: str | None = None, size: int = TILE, bounded: bool = False) -> Searches:
    """The searches of all cases (a start and its ends) under all settings, as one set; number ``setting * len(cases) + case``.

    Settings that share slowdown and penalty share a cost raster.
    """
    rasters = {(s.slowdown, s.penalty): f"cost_of_{k}" for k, s in enumerate(settings)}
    wet = F.coalesce(F.col(drainage), F.lit(False)) if drainage else F.lit(False)
    costs = {name: (1.0 + slowdown * (1.0 - F.col(score).cast("double"))) * F.when(wet, penalty).otherwise(1.0) for (slowdown, penalty), name in rasters.items()}
    asks = [Ask(start, tuple(ends), rasters[s.slowdown, s.penalty], decay=s.decay) for s in settings for start, ends in cases]
    return Searches(cells.select("r", "c", z, *(v.alias(n) for n, v in costs.items())), grid, asks, z, size=size, bounded=bounded)


def calibration(cells: DataFrame, grid: Grid, tracks: DataFrame, settings: list[Setting], within: float = 250.0, step: float = 10.0, score: str = "score", z: str = "z", drainage: str | None = None, size: int = TILE) -> DataFrame:
    """``setting, case, value``: how much of each walked track lies within a distance of the route that a setting gives.

    ``tracks``: lines of ``case, seq, x, y``; a route leads from the cell of a track's first point to that of its last.
    Where a setting has no way, the value is 0.  ``sequences.leave_one_out`` chooses a setting for each track by the others.
    """
    ends = tracks.groupBy("case").agg(*(f(F.struct("x", "y"), "seq").alias(n) for n, f in (("first", F.min_by), ("last", F.max_by)))).orderBy("case")
    at = lambda p: F.struct(*(v.alias(n) for n, v in zip("rc", grid.to_cell(p["x"], p["y"]))))
    known = ends.select("case", at(F.col("first")).alias("a"), at(F.col("last")).alias("b")).collect()  # a row for each track that was asked for
    cases = [((int(k.a.r), int(k.a.c)), ((int(k.b.r), int(k.b.c)),)) for k in known]
    found = sweep(cells, grid, settings, cases, score, z, drainage, size, bounded=True).paths()
    x, y = grid.to_world(F.col("r"), F.col("c"))
    names = F.array(*(F.lit(k["case"]) for k in known))
    routes = materialize(found.select(F.floor(F.col("search") / len(known)).cast("int").alias("setting"), F.element_at(names, (F.col("search") % len(known) + 1).cast("int")).alias("case"), "seq", x.alias("x"), y.alias("y")), "calibration-routes")
    points = sequences.densify(tracks, step, ["case"]).withColumn("setting", F.explode(F.array(*(F.lit(k) for k in range(len(settings))))))
    return sequences.agreement(points, routes, ["setting", "case"], within).select("setting", "case", F.col("share").alias("value"))


def autocorrelation(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Correlation of a series with itself one step before, over all series."""
    v = F.col(value).cast("double")
    pairs = rows.select(v.alias("a"), F.lag(v).over(Window.partitionBy(*by).orderBy(order)).alias("b")).dropna()
    return pairs.agg(F.count("*").alias("n"), F.corr("a", "b").alias("lag1"))


def transect(rows: DataFrame, by: list[str], order: str, z: str, step: float) -> DataFrame:
    """Grades along transects, by key: how many, percentiles in percent, shares above 60 and 100 %."""
    grade = F.abs(F.col(z).cast("double") - F.lag(F.col(z).cast("double")).over(Window.partitionBy(*by).orderBy(order))) / step * 100.0
    graded = rows.select(*by, grade.alias("g")).dropna(subset=["g"])
    return graded.groupBy(*by).agg(
        F.count("*").alias("n"), *(F.percentile("g", F.lit(p / 100)).alias(f"p{p}") for p in (50, 75, 90, 99)),
        F.avg(F.when(F.col("g") > 60, 1.0).otherwise(0.0)).alias("over60"), F.avg(F.when(F.col("g") > 100, 1.0).otherwise(0.0)).alias("over100"),
    )


def class_use(fixes: DataFrame, cells: DataFrame, name: str = "class") -> DataFrame:
    """``class, used, available, ratio``: shares of classes under track fixes against the scene's.

    Both sides have a handful of rows when they meet.
    """
    all_ = Window.partitionBy(F.lit(0))
    share = lambda rows, into: rows.where(F.col(name) > 0).groupBy(F.col(name).alias("class")).agg(F.count("*").alias("k")).select("class", (F.col("k") / F.sum("k").over(all_)).alias(into))
    both = share(cells, "available").join(share(fixes, "used"), "class", "left")
    return both.select("class", F.coalesce("used", F.lit(0.0)).alias("used"), "available", (F.coalesce("used", F.lit(0.0)) / F.col("available")).alias("ratio"))
