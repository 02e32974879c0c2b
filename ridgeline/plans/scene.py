"""A whole scene: from a relief and options to scores, classes, zones, drainage and routes."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions import cellwise as fn
from ridgeline.operators import classes, distance, hydrology, regions, routing, score, sequences, stats, terrain
from ridgeline.session import materialize, remove, scratch
from ridgeline.sources import geotiff, rasters, vectors
from ridgeline.sources.grid import Grid


@dataclass(frozen=True)
class SceneOptions:
    """What a scene computes; the defaults are those of a walking trip in open country."""

    score: score.ScoreOptions = field(default_factory=score.ScoreOptions)
    breaks: tuple[float, float, float, float] = (20.0, 35.0, 60.0, 100.0)
    percentile: float = 75.0
    threshold: float | None = None
    band_size: float | None = 200.0
    zones: str = "score"  # or "walkability"
    least_patch_ha: float = -1.0  # negative: from the area
    streams: bool = True
    stream_basin_km2: float = 1.0
    ford_most_km2: float = 50.0
    stream_buffer_m: float = 30.0
    constraint_mode: str = "avoid"
    cost_model: str = "tobler"
    contrast: float = 6.0
    route_margin_m: float = 5000.0
    route_buffer_m: float = 100.0
    field_speed_kmh: float = 2.4
    alternatives: float = 0.0
    optimise_order: bool = False

    def __post_init__(self):
        if not 1 <= self.percentile <= 99:
            raise ValueError("the percentile is between 1 and 99")
        if self.threshold is not None and not 0 <= self.threshold <= 1:
            raise ValueError("the threshold is between 0 and 1")
        if self.zones not in ("score", "walkability") or self.constraint_mode not in ("avoid", "penalise") or self.cost_model not in ("inverse", "exponential", "tobler"):
            raise ValueError("unknown mode")
        if self.stream_basin_km2 < 0.01 or self.ford_most_km2 < 0.1 or self.route_margin_m < 100 or self.route_buffer_m < 1 or not 0.1 <= self.field_speed_kmh <= 6 or not 0 <= self.alternatives <= 0.5:
            raise ValueError("an option is out of its range")


def surface(cells: DataFrame, grid: Grid, o: SceneOptions = SceneOptions(), constraint: str | None = None) -> DataFrame:
    """Every raster of the scene beside each other: derivatives, drainage, score, risk, class, cost and zone.

    Steps that several others need are written once: derivatives, drainage, water and strips along streams, and the result.
    """
    derived = materialize(terrain.derive(cells, grid), "derived")
    if o.streams:
        drained = hydrology.analyse(derived.select("r", "c", "z"), grid, o.stream_basin_km2).select("r", "c", "filled", "d8", "upstream", "basin_km2", "channel", "twi")
        derived = materialize(derived.join(drained, ["r", "c"]), "drained")
        water = regions.flat_water(derived.select("r", "c", "z"), grid)
        strip = distance.nearest_feature(derived, grid, "channel", "basin_km2", o.stream_buffer_m).select("r", "c", F.col("value").alias("stream_km2"))
        derived = materialize(derived.join(water, ["r", "c"], "left").join(strip, ["r", "c"], "left"), "with-water")
        derived = derived.withColumn("stream_class", hydrology.ford_class(F.col("stream_km2"), o.ford_most_km2))
    scored = score.constrain(score.score(derived, o.score), constraint, "stream_class" if o.streams else None, o.constraint_mode)
    dry = F.lit(True) if not o.streams else F.col("water").isNull()
    scored = scored.withColumns({"in_zone_range": F.col("in_zone_range") & dry, "blocked_route": ~F.col("passable") | F.col("barrier") | ~dry})
    scored = scored.withColumn("score", F.when(F.col("in_zone_range"), F.col("raw_score")))
    cost = fn.route_cost(F.col("raw_score").cast("double"), o.cost_model, o.contrast, F.col("penalty")).cast("float")
    scored = scored.withColumn("cost", F.when(~F.col("blocked_route"), cost))
    classed = materialize(classes.classify(scored, o.breaks, wetness="twi" if o.streams else None, blocked="barrier"), "classed")
    if o.zones == "walkability":
        return classed.withColumn("zone", F.col("in_zone_range"))
    return stats.select_zones(classed, o.percentile, None if o.threshold is not None else o.band_size, o.threshold)


def zones(cells: DataFrame, grid: Grid, o: SceneOptions = SceneOptions()) -> DataFrame:
    """Outlines of the zones that are large enough."""
    least = o.least_patch_ha
    if least < 0:
        # One number for the whole scene.
        area = cells.agg(F.sum(F.when(F.col("valid") & F.col("z").between(o.score.alt_min, o.score.alt_max), 1).otherwise(0))).first()[0] or 0
        least = min(max(0.0005 * area * grid.cell_area / 1e4, 1.0), 50.0)
    return regions.outlines(regions.large_regions(cells, grid, "zone", least), grid)


def route(cells: DataFrame, grid: Grid, points: list[tuple[float, float]], o: SceneOptions = SceneOptions()) -> dict[str, DataFrame]:
    """The route through points (coordinates of the grid): its cells, attributes, corridor, stream events and alternatives.

    ``ends`` says how far each point moved to a cell that can be walked, and in ``warned`` whether that is more than
    ``MOVED_WARN_M``; ``corridor`` has the outline of what lies within the route's buffer; ``lines`` has each leg as one
    line.  A point outside of the relief, or far from every such cell, is an error that names it.
    Raises ``routing.NoWay``, with the slope limit that would join them, if the points are not joined.
    """
    spark = cells.sparkSession
    asked = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "ord long, x double, y double")
    r, c = grid.to_cell(F.col("x"), F.col("y"))
    snapped = distance.snap(asked.select("ord", r.alias("r"), c.alias("c")), cells.withColumn("open", F.col("cost").isNotNull()), grid, "open")
    snapped = snapped.withColumn("warned", F.col("moved_m") > MOVED_WARN_M)
    moved = snapped.orderBy("ord").collect()  # as many as the points asked for
    for p, (x, y) in zip(moved, points):
        if not (0 <= p.r < grid.rows and 0 <= p.c < grid.cols):
            raise ValueError(f"point {p.ord + 1} ({x:g}, {y:g}) is outside of the relief")
        if p.snap_r is None:
            raise ValueError(f"point {p.ord + 1} ({x:g}, {y:g}) is far from every cell that can be walked")
    ends = [(p.snap_r, p.snap_c) for p in moved]
    margin = grid.to_cells_of(o.route_margin_m)
    window = [(min(p[k] for p in ends) - margin, max(p[k] for p in ends) + margin) for k in (0, 1)]
    crop = materialize(cells.where(F.col("r").between(*window[0]) & F.col("c").between(*window[1])), "crop")
    timed = "z" if o.cost_model == "tobler" else None
    open_ = F.col("valid") & F.col("slope").isNotNull() & ~F.col("barrier") & (F.col("water").isNull() if o.streams else F.lit(True))
    try:
        order = routing.waypoint_order(crop, grid, ends, z=timed) if o.optimise_order and len(ends) > 3 else range(len(ends))
        stops = [ends[i] for i in order]
        found = materialize(routing.route(crop, grid, stops, z=timed), "route")
    except routing.NoWay:
        closed = crop.withColumn("slope", F.when(open_, F.col("slope")))
        raise routing.explain_no_way(closed, grid, ends, o.score.slope_max) from None
    path = found.join(crop.drop("distance"), ["r", "c"])
    line_order = found.select("leg", "seq", "r", "c").withColumn("k", F.col("leg") * (1 << 32) + F.col("seq"))
    whole = path.withColumn("all", F.lit(0)).withColumn("seq", F.col("leg") * (1 << 32) + F.col("seq"))
    metrics = routing.path_metrics(whole, grid, ["all"]).join(routing.profile(whole, ["all"], ["slope", "raw_score"]), "all")
    cost = found.groupBy("leg").agg(F.max("distance").alias("d")).agg(F.sum("d").alias("cost"))
    attributes = metrics.join(F.broadcast(cost)).withColumns({"field_hours": F.col("hours") * (fn.BEST_SPEED / o.field_speed_kmh), "time_text": fn.hours_text(F.col("hours"))}).drop("all")
    strip = routing.buffered(found, grid, ["leg"], o.route_buffer_m).withColumn("in", F.lit(True))
    corridor = regions.outlines(regions.regions(strip, grid, "in"), grid).withColumn("buffer_m", F.lit(o.route_buffer_m))
    legs = routing.lines(found, grid, ["leg"]).join(routing.path_metrics(path, grid, ["leg"]), "leg")
    out = {"path": found, "attributes": attributes, "ends": snapped, "corridor": corridor, "lines": legs}
    free_cost = fn.route_cost(F.col("raw_score").cast("double"), o.cost_model, o.contrast, F.col("penalty")).cast("float")
    if crop.where(open_ & ~F.col("passable")).limit(1).count():
        unlimited = materialize(crop.withColumn("cost", F.when(open_, free_cost)), "unlimited")
        free = materialize(routing.route(unlimited, grid, stops, z=timed), "free-route").join(crop.drop("distance"), ["r", "c"])
        free = free.withColumn("all", F.lit(0)).withColumn("seq", F.col("leg") * (1 << 32) + F.col("seq"))
        out["detour"] = routing.slope_detour(whole, free, grid, ["all"], o.score.slope_max).drop("all")
    if o.streams:
        line = line_order.select(F.lit(0).alias("all"), F.col("k").alias("seq"), "r", "c")
        streams = crop.where("channel").select("r", "c", F.col("basin_km2").alias("area"))
        axis = sequences.with_corners(line, ["all"], streams).join(streams, ["r", "c"], "left")
        out["crossings"] = sequences.merge_contacts(sequences.contacts(axis.withColumn("on", F.col("area").isNotNull()), ["all"], "on", "area"), ["all"], grid)
    if o.alternatives:
        beside = routing.alternatives(crop, grid, found, stops, o.alternatives, o.route_buffer_m, z=timed)
        out |= {"alternatives" if k == "cells" else f"alternatives_{k}": v for k, v in beside.items()}
    return out


MOVED_WARN_M = 100.0
RASTERS = ("score", "risk", "class", "zone", "cost")


def products(spark: SparkSession, target: str) -> dict[str, str]:
    """Name and place of the products of the last complete run into ``target``; none before the first."""
    try:
        runs = spark.read.schema(_MANIFEST).json(f"{target.rstrip('/')}/manifest")
    except AnalysisException:
        return {}
    last = runs.orderBy(F.desc("at"), F.desc("run")).first()
    return {p.name: p.place for p in last.products} if last else {}


_MANIFEST = "run string, at timestamp, products array<struct<name:string,place:string>>"


def run(cells: DataFrame, grid: Grid, target: str, points: list[tuple[float, float]] | None = None, o: SceneOptions = SceneOptions(), constraint: str | None = None) -> dict[str, DataFrame]:
    """The whole scene: computes everything, publishes products and a log below ``target``, returns the products as written.

    Rasters are GeoTIFF tiles in a folder for each, the slack of alternatives among them; zones, route, stream crossings
    and alternatives are Parquet tables; zones, legs of the route, its corridor and the alternatives also GeoJSON lines
    with their attributes.  The log has an event for each step, and one for each warning.

    All products go to a folder of the run.  When all are complete, one row of the manifest names them (``products``), which
    Spark commits as a whole; a run that fails leaves its log and no product, and products of earlier runs stay as they
    were.  Intermediate tables are removed in any case.
    """
    spark, folder = cells.sparkSession, target.rstrip("/")
    name = f"run-{uuid.uuid4().hex}"
    log: list[tuple[str, dict]] = [("start", {"run": name, "rows": grid.rows, "cols": grid.cols, "crs": grid.crs, "points": len(points or [])})]
    try:
        with scratch(spark, "scene"):
            made, files = _products(cells, grid, f"{folder}/{name}", points, o, constraint, log)
        rows = [(name, [{"name": n, "place": f"{folder}/{name}/{n}"} for n in [*made, *files]])]
        manifest = spark.createDataFrame(rows, "run string, products array<struct<name:string,place:string>>").withColumn("at", F.current_timestamp())
        manifest.coalesce(1).write.mode("append").json(f"{folder}/manifest")
    except BaseException as failure:
        remove(spark, f"{folder}/{name}")
        rasters.log_events(spark, [*log, ("failed", {"error": f"{type(failure).__name__}: {failure}"[:500]})], f"{folder}/log")
        raise
    rasters.log_events(spark, [*log, ("end", {"run": name})], f"{folder}/log")
    return made


def _products(cells: DataFrame, grid: Grid, folder: str, points: list[tuple[float, float]] | None, o: SceneOptions, constraint: str | None, log: list) -> tuple[dict[str, DataFrame], list[str]]:
    """Compute and write all products to ``folder``: the tables, and the names of the other products."""
    spark = cells.sparkSession
    if note := grid.size_warning():
        log.append(("large", {"note": note}))
    made = materialize(surface(cells, grid, o, constraint), "scene")
    layers: dict[str, DataFrame] = {"classes": stats.class_shares(made), "discrimination": stats.discrimination(made), "zones": zones(made, grid, o)}
    if o.streams:
        layers["drainage"] = hydrology.metrics(made, grid)
    if points:
        try:
            found = route(made, grid, points, o)
        except routing.NoWay as no_way:
            log.append(("no_way", {"needed_slope": no_way.needed, "only_by_corner": no_way.by_corner}))
            raise
        layers |= {"route" if k == "path" else f"route_{k}": v for k, v in found.items()}
    out = {}
    for name, frame in layers.items():
        frame.write.parquet(f"{folder}/{name}")
        out[name] = spark.read.parquet(f"{folder}/{name}")
        log.append(("layer", {"name": name, "rows": out[name].count()}))
    corner = lambda p: F.array(F.lit(grid.x0) + p["c"] * grid.dx + p["r"] * grid.rx, F.lit(grid.y0) + p["c"] * grid.ry + p["r"] * grid.dy)
    rings = F.transform("rings", lambda ring: F.transform(ring, corner))
    shapes = {"zones": ("zones", "Polygon", rings, ["region", "n_cells", "area_ha"])}
    if points:
        shapes["route"] = ("route_lines", "LineString", F.col("coordinates"), ["leg", "length_m", "hours", "gain_m", "loss_m", "alt_min", "alt_max"])
        shapes["route_corridor"] = ("route_corridor", "Polygon", rings, ["buffer_m", "n_cells", "area_ha"])
        if o.alternatives:
            shapes["route_alternatives"] = ("route_alternatives_outlines", "Polygon", rings, ["n_cells", "area_ha"])
        _warn(out, log)
    for name, (table, kind, coordinates, properties) in shapes.items():
        vectors.to_geojson(out[table], kind, coordinates, properties).write.text(f"{folder}/{name}.geojsonl")
    drawn = {name: made.select("r", "c", F.col(name).cast("float").alias(name)) for name in RASTERS}
    if points and o.alternatives:
        drawn["slack"] = made.select("r", "c").join(out["route_alternatives_raster"].select("r", "c", F.col("slack_pct").cast("float").alias("slack")), ["r", "c"], "left")
    for name, raster in drawn.items():
        geotiff.write_geotiff(raster, grid, name, f"{folder}/{name}")
        log.append(("raster", {"name": name}))
    return out, [*(f"{name}.geojsonl" for name in shapes), *drawn]


def _warn(made: dict[str, DataFrame], log: list) -> None:
    """Events for points that moved far, a detour forced by the slope limit, and alternatives far from the route."""
    for p in made["route_ends"].where("moved_m > 0").orderBy("ord").collect():  # as many as the points asked for
        log.append(("point_moved", {"point": p.ord + 1, "metres": round(p.moved_m, 1), "warned": p.warned}))
    if "route_detour" in made:
        row = made["route_detour"].first()
        if row and row.detour:
            log.append(("slope_detour", {"ratio": round(row.ratio, 3), "metres_above": round(row.metres_above, 1)}))
    if "route_alternatives_extent" in made:
        row = made["route_alternatives_extent"].first()
        if row.apart:
            log.append(("alternatives_apart", {"slack_pct": row.slack_pct, "farthest_m": round(row.farthest_m, 1), "area_ha": round(row.area_ha, 2)}))
