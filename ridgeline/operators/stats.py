"""Scene statistics: diagnostics, limits, thresholds by band, discrimination, representativeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.session import materialize

PERCENTS = (5, 25, 50, 75, 95)
STEPS_A_DOUBLING = 64  # coarse buckets between a value and twice that
FINE_BUCKETS = 4096  # of a coarse bucket


def percentile(v: Column, p: float) -> Column:
    """Exact, interpolated between order statistics."""
    return F.percentile(v.cast("double"), F.lit(p / 100.0))


def _coarse(v: Column) -> Column:
    """A bucket that never falls as the value grows: by the logarithm of its size, with NaN last."""
    step = F.floor(F.least(F.log2(F.abs(v)), F.lit(1100.0)) * STEPS_A_DOUBLING) + 1100 * STEPS_A_DOUBLING
    return F.when(F.isnan(v), 1 << 20).when(v == 0, 0).when(v > 0, step).otherwise(-step)


def _fine(v: Column, lo: Column, hi: Column) -> Column:
    return F.when(hi > lo, F.floor((v - lo) / (hi - lo) * FINE_BUCKETS)).otherwise(0)


def _holding(counts: DataFrame, inside: list[str], by: str, asked: DataFrame) -> DataFrame:
    """Those of ``counts`` that hold an asked rank, with ``percent, rank`` and ``below``, the number of values before them.

    ``counts`` has ``n`` for each ``inside, by``; ``asked`` has ``inside, percent, rank, below``.
    """
    to = F.sum("n").over(Window.partitionBy(*inside).orderBy(by))
    placed = counts.withColumn("before", to - F.col("n")).join(asked, inside).withColumn("below", F.col("below") + F.col("before"))
    low, high = ((F.col("below") <= f("rank")) & (f("rank") < F.col("below") + F.col("n")) for f in (F.floor, F.ceil))
    return placed.where(low | high).drop("before", "n")


def order_statistics(rows: DataFrame, key: str, value: str, percents: list[float]) -> DataFrame:
    """``key, percent, value``: exact, interpolated percentiles of each key, at any number of values.

    Three passes over ``rows``, which should be a written table, move counts only.  The first counts
    coarse buckets, of which a key has a fixed number at most; the second counts fine buckets of the coarse
    ones that hold an asked rank, the third the values of such fine ones.  Null keys and values are left out.
    """
    rows = rows.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).where("k is not null and v is not null").withColumn("b", _coarse(F.col("v")))
    extent = (F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    coarse = rows.groupBy("k", "b").agg(*extent)
    wanted = F.explode(F.array(*(F.lit(float(p)) for p in percents)))
    coarse = coarse.withColumn("all", F.sum("n").over(Window.partitionBy("k")))
    to = F.sum("n").over(Window.partitionBy("k").orderBy("b"))
    ranked = coarse.withColumn("below", to - F.col("n")).withColumn("percent", wanted).withColumn("rank", F.col("percent") / 100.0 * (F.col("all") - 1).cast("double"))
    low, high = ((F.col("below") <= f("rank")) & (f("rank") < F.col("below") + F.col("n")) for f in (F.floor, F.ceil))
    first = materialize(ranked.where(low | high).select("k", "b", "lo", "hi", "percent", "rank", "below"), "coarse-buckets")
    within = rows.join(first.select("k", "b", "lo", "hi").distinct(), ["k", "b"]).select("k", "b", "v", _fine(F.col("v"), F.col("lo"), F.col("hi")).alias("f"))
    fine = within.groupBy("k", "b", "f").agg(F.count("*").alias("n"))
    second = materialize(_holding(fine, ["k", "b"], "f", first.drop("lo", "hi")), "fine-buckets")
    values = within.join(second.select("k", "b", "f").distinct(), ["k", "b", "f"]).groupBy("k", "b", "f", "v").agg(F.count("*").alias("n"))
    # A rank between two values has one of them before it and one after it.
    found = _holding(values, ["k", "b", "f"], "v", second).groupBy("k", "percent").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.first("rank").alias("rank"))
    between = F.col("rank") - F.floor("rank")
    return found.select(F.col("k").alias(key), "percent", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * between).alias(value))


def percentiles(cells: DataFrame, wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """One row with each wanted percentile, written, as several steps beside it read it; ``cells`` should be a written table."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), v.cast("double").alias("v")) for n, (v, _) in wanted.items())))
    found = order_statistics(cells.select(each.alias("e")).select("e.*"), "name", "v", sorted({p for _, p in wanted.values()}))
    pick = lambda n, p: F.max(F.when((F.col("name") == n) & (F.col("percent") == float(p)), F.col("v"))).alias(n)
    return materialize(found.agg(*(pick(n, p) for n, (_, p) in wanted.items())), "percentiles")


def keyed_percentiles(rows: DataFrame, key: str, value: str, percents: list[float]) -> DataFrame:
    """``key`` and ``p5, p25, ...``: percentiles of each key; ``rows`` should be a written table."""
    found = order_statistics(rows, key, value, percents)
    return found.groupBy(key).agg(*(F.max(F.when(F.col("percent") == float(p), F.col(value))).alias(f"p{p:g}") for p in percents))


def diagnostics(cells: DataFrame, names: list[str]) -> DataFrame:
    """One row for each raster: counts, range, mean, population deviation and percentiles."""
    long = cells.select(F.explode(F.array(*(F.struct(F.lit(n).alias("raster"), F.col(n).cast("double").alias("v")) for n in names))).alias("e")).select("e.*")
    plain = long.groupBy("raster").agg(
        F.count("*").alias("total"), F.count("v").alias("valid"), (F.count("*") - F.count("v")).alias("nodata"),
        F.min("v").alias("v_min"), F.max("v").alias("v_max"), F.avg("v").alias("v_mean"), F.stddev_pop("v").alias("v_std"),
    )
    return plain.join(keyed_percentiles(long, "raster", "v", PERCENTS), "raster", "left")


def band_thresholds(cells: DataFrame, percent: float, size: float = 200.0, least_cells: int = 50, z: str = "z", score: str = "score") -> DataFrame:
    """``band, low, high, n, threshold``: the percentile of the score in each altitude band with enough cells."""
    size = max(50.0, size)
    band = F.floor(F.col(z).cast("double") / size)
    rows = cells.where(F.col(score).isNotNull() & F.col(z).isNotNull()).select(band.alias("band"), F.col(score).alias("threshold"))
    name = f"p{percent:g}"
    counts = rows.groupBy("band").agg(F.count("*").alias("n"))
    found = counts.join(keyed_percentiles(rows, "band", "threshold", [percent]).withColumnRenamed(name, "threshold"), "band")
    return found.where(F.col("n") >= least_cells).select("band", (F.col("band") * size).alias("low"), ((F.col("band") + 1) * size).alias("high"), "n", "threshold")


def select_zones(cells: DataFrame, percent: float = 75.0, size: float | None = 200.0, threshold: float | None = None, least_cells: int = 50) -> DataFrame:
    """Adds ``zone``: the score reaches the threshold of the cell's band, or of the scene if ``size`` is None.

    Cells of bands without a threshold are in no zone; NULL scores are in none.
    """
    if threshold is not None:
        return cells.withColumn("zone", F.coalesce(F.col("score") >= F.lit(threshold).cast("float"), F.lit(False)))
    if size is None:
        limits = percentiles(cells, {"__t": (F.col("score"), percent)})
        joined = cells.join(F.broadcast(limits))
    else:
        limits = band_thresholds(cells, percent, size, least_cells).select(F.col("band").alias("__band"), F.col("threshold").alias("__t"))
        joined = cells.join(limits, F.floor(F.col("z").cast("double") / max(50.0, size)) == F.col("__band"), "left").drop("__band")
    return joined.withColumn("zone", F.coalesce(F.col("score") >= F.col("__t").cast("float"), F.lit(False))).drop("__t")


def class_shares(cells: DataFrame, name: str = "class") -> DataFrame:
    """``class, n, share`` of all cells with a class."""
    counts = cells.where(F.col(name) > 0).groupBy(F.col(name).cast("int").alias("class")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def walkable_fraction(name: str = "class", up_to: int = 2) -> Column:
    """Aggregate: share of classes up to one; NULL without classes."""
    return F.avg(F.when(F.col(name) > 0, F.when(F.col(name) <= up_to, 1.0).otherwise(0.0)))


def discrimination(cells: DataFrame, score: str = "score", saturated: float = 0.999) -> DataFrame:
    """How well a score tells cells apart: share at the top, spread, suggested thresholds, and a warning."""
    v = F.col(score).cast("double")
    rows = cells.where(v.isNotNull())
    plain = rows.agg(F.count("*").alias("n"), F.avg(F.when(v >= saturated, 1.0).otherwise(0.0)).alias("saturated"))
    wide = percentiles(rows, {f"p{p}": (v, p) for p in (5, 50, 90, 95, 99)})
    found = plain.join(F.broadcast(wide)).withColumn("amplitude", F.col("p95") - F.col("p5"))  # one row each
    return found.select("n", "saturated", "amplitude", "p50", "p90", "p99", ((F.col("saturated") >= 0.40) | (F.col("amplitude") < 0.05)).alias("weak"))


def absurd_values(cells: DataFrame, names: list[str], most: float = 1e6) -> DataFrame:
    """``raster, n, extreme``: values that are infinite or beyond ``most`` in size."""
    long = cells.select(F.explode(F.array(*(F.struct(F.lit(n).alias("raster"), F.col(n).cast("double").alias("v")) for n in names))).alias("e")).select("e.*")
    return long.where(F.abs("v") > most).groupBy("raster").agg(F.count("*").alias("n"), F.max_by("v", F.abs("v")).alias("extreme"))


def empty_mask_reasons(cells: DataFrame, alt_min: float, alt_max: float, slope_max: float) -> DataFrame:
    """Shares of cells within the altitude range and under the slope limit, and which of them is too small."""
    found = cells.where("z is not null").agg(
        F.avg(F.when(F.col("z").between(alt_min, alt_max), 1.0).otherwise(0.0)).alias("in_altitude"),
        F.avg(F.when(F.col("slope") <= slope_max, 1.0).otherwise(0.0)).alias("under_slope"),
    )
    return found.withColumn("reason", F.when(F.col("in_altitude") < 0.01, "altitude").when(F.col("under_slope") < 0.05, "slope"))


def ks_distance(cells: DataFrame, value: str, zone: str = "zone", bins: int = 1024) -> DataFrame:
    """``ks``: the largest gap between the cumulative shares of zone cells and of all others.

    Values are cut into bins whose totals are added up first, so the running counts of the
    values of a bin need no other bin; exact, without a global sort and without sampling.
    """
    rows = cells.select(F.col(value).cast("double").alias("v"), F.col(zone).alias("z")).where("v is not null and z is not null")
    span = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum(F.when(F.col("z"), 1).otherwise(0)).alias("na"), F.sum(F.when(F.col("z"), 0).otherwise(1)).alias("nb"))
    counts = rows.groupBy("v").agg(F.sum(F.when(F.col("z"), 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("z"), 0).otherwise(1)).alias("b"))
    binned = counts.join(F.broadcast(span)).withColumn("bin", F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)).otherwise(0))
    totals = binned.groupBy("bin").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # over at most bins + 1 rows
    bases = totals.select("bin", F.coalesce(F.sum("ta").over(before), F.lit(0)).alias("base_a"), F.coalesce(F.sum("tb").over(before), F.lit(0)).alias("base_b"))
    within = Window.partitionBy("bin").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = binned.join(F.broadcast(bases), "bin").select(((F.col("base_a") + F.sum("a").over(within)) / F.col("na") - (F.col("base_b") + F.sum("b").over(within)) / F.col("nb")).alias("gap"))
    return running.agg(F.max(F.abs("gap")).alias("ks"))


def representativeness(cells: DataFrame, value: str, bins: int = 10, equal_width: bool = True, least_share: float = 0.2, least_area: float = 0.005, zone: str = "zone") -> DataFrame:
    """``bin, low, high, area_share, zone_share, covered, gap``: how the zones cover the range of a variable.

    Bins are of equal width, or deciles.  A bin with a fair share of the area is covered if its
    share of the zones is at least ``least_share`` of that; ``gap`` numbers runs of bins that are not.
    """
    rows = cells.select(F.col(value).cast("double").alias("v"), F.col(zone).alias("z")).where("v is not null")
    if equal_width:
        edges = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).select(F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / float(bins)).alias("edges"))
    else:
        names = {f"e{i}": (F.col("v"), 100.0 * i / bins) for i in range(bins + 1)}
        edges = percentiles(rows, names).select(F.array(*names).alias("edges"))
    inside = F.size(F.filter(F.slice("edges", 2, bins - 1), lambda e: F.col("v") >= e))
    placed = rows.join(F.broadcast(edges)).groupBy(inside.alias("bin")).agg(F.first("edges").alias("edges"), F.count("*").alias("n"), F.sum(F.when(F.col("z"), 1).otherwise(0)).alias("nz"))
    all_ = Window.partitionBy(F.lit(0))
    shares = placed.select("bin", F.element_at("edges", F.col("bin") + 1).alias("low"), F.element_at("edges", F.col("bin") + 2).alias("high"), (F.col("n") / F.sum("n").over(all_)).alias("area_share"), F.coalesce(F.try_divide(F.col("nz").cast("double"), F.sum("nz").over(all_).cast("double")), F.lit(0.0)).alias("zone_share"))
    covered = shares.withColumn("covered", (F.col("area_share") < least_area) | (F.col("zone_share") >= F.col("area_share") * least_share))
    by_bin = Window.partitionBy(F.lit(0)).orderBy("bin")
    starts = F.when(~F.col("covered") & F.coalesce(F.lag("covered").over(by_bin), F.lit(True)), 1).otherwise(0)
    return covered.withColumn("__s", starts).withColumn("gap", F.when(~F.col("covered"), F.sum("__s").over(by_bin))).drop("__s")


def describe_representativeness(found: DataFrame, name: str, unit: str = "") -> DataFrame:
    """``variable, covered, bins, missing, text, warn``: a sentence on the rows of ``representativeness``.

    ``missing`` are the runs of bins that the zones leave out; it is a warning if there are any.
    """
    runs = found.where("gap is not null").groupBy("gap").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    missing = runs.agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("missing"))
    counts = found.agg(F.count("*").alias("bins"), F.coalesce(F.sum(F.col("covered").cast("int")), F.lit(0)).alias("covered"))
    number = lambda v: F.regexp_replace(F.format_number(v, 2), ",", "")
    gaps = F.array_join(F.transform("missing", lambda m: F.concat(number(m["low"]), F.lit(" to "), number(m["high"]))), ", ")
    text = F.concat(F.lit(f"{name}: zones cover "), F.col("covered"), F.lit(" of "), F.col("bins"), F.lit(" bins"), F.when(F.size("missing") > 0, F.concat(F.lit("; missing "), gaps, F.lit(f" {unit}".rstrip()))).otherwise(""))
    both = counts.join(F.broadcast(missing))  # one row each
    return both.select(F.lit(name).alias("variable"), "covered", "bins", "missing", text.alias("text"), (F.size("missing") > 0).alias("warn"))
