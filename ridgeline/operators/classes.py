"""Walkability classes 1 (easy) to 5 (impassable), 0 for NoData."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.cellwise import slope_class
from ridgeline.operators.stats import percentiles

BREAKS = (20.0, 35.0, 60.0, 100.0)


def classify(cells: DataFrame, breaks: tuple[float, ...] = BREAKS, roughness: str | None = None, wetness: str | None = None, blocked: str | None = None) -> DataFrame:
    """Adds ``class`` from the slope; rough ground (above P90) and wet ground (above P95) each demote
    classes 1 to 3 by one, and blocked cells are class 5."""
    out = cells.withColumn("class", slope_class(F.col("slope"), breaks))
    tests = [(n, p) for n, p in ((roughness, 90), (wetness, 95)) if n]
    if tests:
        limits = percentiles(out.where("class > 0"), {f"__{n}": (F.col(n), p) for n, p in tests})
        out = out.join(F.broadcast(limits))
        for n, _ in tests:
            out = out.withColumn("class", F.when(F.col("class").between(1, 3) & (F.col(n).cast("double") > F.col(f"__{n}")), F.col("class") + 1).otherwise(F.col("class"))).drop(f"__{n}")
    if blocked:
        out = out.withColumn("class", F.when((F.col("class") > 0) & F.col(blocked), 5).otherwise(F.col("class")))
    return out.withColumn("class", F.col("class").cast("int"))
