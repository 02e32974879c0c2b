"""Neighbours on a complete grid.

A 3x3 neighbourhood is two windows: over each row for left and right, then over each column
for the three values above and below.  That is two shuffles for all eight neighbours and any
number of rasters, with no join and no blow-up of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def along_row():
    return Window.partitionBy("r").orderBy("c")


def along_column():
    return Window.partitionBy("c").orderBy("r")


#: Offsets (dr, dc) in the order that ties are resolved: the first wins.
OFFSETS = {"nw": (-1, -1), "n": (-1, 0), "ne": (-1, 1), "w": (0, -1), "e": (0, 1), "sw": (1, -1), "s": (1, 0), "se": (1, 1)}


def with_neighbours(cells: DataFrame, names: list[str], into: str = "around") -> DataFrame:
    """Adds the struct ``into`` with a struct of the rasters ``names`` for each of the eight offsets."""
    here = F.struct(*(F.col(n) for n in names))
    flat = cells.withColumns({"__here": here, "__w": F.lag(here).over(along_row()), "__e": F.lead(here).over(along_row())})
    line = F.struct("__w", "__here", "__e")
    tall = flat.withColumns({"__n": F.lag(line).over(along_column()), "__s": F.lead(line).over(along_column())})
    around = F.struct(
        *(F.col(f"__n.{a}").alias(b) for a, b in (("__w", "nw"), ("__here", "n"), ("__e", "ne"))), F.col("__w").alias("w"), F.col("__e").alias("e"),
        *(F.col(f"__s.{a}").alias(b) for a, b in (("__w", "sw"), ("__here", "s"), ("__e", "se"))),
    )
    return tall.withColumn(into, around).drop("__here", "__w", "__e", "__n", "__s")


def masked_gradient(before: Column, here: Column, after: Column, spacing: float) -> Column:
    """Central difference, one-sided beside NoData or the edge, 0 without neighbours, NULL on NoData."""
    return (
        F.when(here.isNull(), None)
        .when(before.isNotNull() & after.isNotNull(), (after - before) / (2.0 * spacing))
        .when(after.isNotNull(), (after - here) / spacing)
        .when(before.isNotNull(), (here - before) / spacing)
        .otherwise(0.0)
    )


def gradients(cells: DataFrame, name: str, px: float, py: float, into: tuple[str, str]) -> DataFrame:
    """Adds the masked gradients of a raster along rows and along columns."""
    v = F.col(name).cast("double")
    gx = masked_gradient(F.lag(v).over(along_row()), v, F.lead(v).over(along_row()), px)
    gy = masked_gradient(F.lag(v).over(along_column()), v, F.lead(v).over(along_column()), py)
    return cells.withColumn(into[0], gx).withColumn(into[1], gy)


def sql_gradient(name: str, along: str, spacing: float = 30.0) -> str:
    """The masked gradient as DuckDB SQL over a complete grid."""
    over = "(PARTITION BY r ORDER BY c)" if along == "x" else "(PARTITION BY c ORDER BY r)"
    v = f"CAST({name} AS DOUBLE)"
    a, b = f"lag({v}) OVER {over}", f"lead({v}) OVER {over}"
    return f"CASE WHEN {v} IS NULL THEN NULL WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN ({b} - {a}) / {2 * spacing}::DOUBLE WHEN {b} IS NOT NULL THEN ({b} - {v}) / {spacing}::DOUBLE WHEN {a} IS NOT NULL THEN ({v} - {a}) / {spacing}::DOUBLE ELSE 0.0::DOUBLE END"
