"""Rasters from and to files: ASCII grids as text, cells as Parquet, and a JSON-lines log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.sources.grid import Grid, nodata_to_null

NODATA = -9999.0


def read_ascii_grid(spark: SparkSession, path: str, crs: str = "EPSG:32723") -> tuple[DataFrame, Grid]:
    """``r, c, z`` and the grid of an ESRI ASCII grid; the file is read by lines, the header alone by the driver.

    Lines are numbered within the parts of the file and moved by the lines of the parts before, which are summed
    first: no task sees all lines.
    """
    lines = spark.read.text(path)
    # At most six header lines start with a letter.
    head = {k.lower(): float(v) for k, v in (r.value.split() for r in lines.where(F.col("value").rlike("^[A-Za-z]")).limit(6).collect())}
    size, rows, cols = head["cellsize"], int(head["nrows"]), int(head["ncols"])
    half = size / 2 if "xllcenter" in head else 0.0
    grid = Grid(rows, cols, head.get("xllcorner", head.get("xllcenter", 0.0)) - half, size, head.get("yllcorner", head.get("yllcenter", 0.0)) - half + rows * size, -size, crs=crs)
    body = lines.where(~F.col("value").rlike("^[A-Za-z]") & (F.trim("value") != "")).withColumn("__at", F.monotonically_increasing_id())
    # The upper bits of __at number the part, the lower 33 the line in it.
    parts = body.select("value", F.shiftright("__at", 33).alias("part"), F.col("__at").bitwiseAND((1 << 33) - 1).alias("line"))
    totals = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each part
    numbered = parts.join(F.broadcast(before), "part").select("value", (F.col("line") + F.col("before")).alias("r"))
    values = numbered.select("r", F.posexplode(F.split(F.trim("value"), r"\s+")).alias("c", "v"))
    return values.select("r", F.col("c").cast("long").alias("c"), nodata_to_null(F.col("v").cast("double"), head.get("nodata_value", NODATA)).cast("float").alias("z")), grid


def write_ascii_grid(cells: DataFrame, grid: Grid, value: str, path: str) -> None:
    """Write an ESRI ASCII grid of square cells; one text line for each row of the grid, in order."""
    if abs(grid.px - grid.py) > 1e-9 or grid.rotated:
        raise ValueError("an ASCII grid has square cells and no rotation")
    spark = cells.sparkSession
    head = [f"ncols {grid.cols}", f"nrows {grid.rows}", f"xllcorner {grid.x0!r}", f"yllcorner {grid.y0 + grid.rows * grid.dy!r}", f"cellsize {grid.px!r}", f"NODATA_value {NODATA:g}"]
    top = spark.createDataFrame([(i - len(head), line) for i, line in enumerate(head)], "r long, value string")
    v = F.coalesce(F.col(value).cast("string"), F.lit(f"{NODATA:g}"))
    lines = cells.groupBy("r").agg(F.sort_array(F.collect_list(F.struct("c", v.alias("v")))).alias("l")).select("r", F.array_join("l.v", " ").alias("value"))
    top.unionByName(lines).repartitionByRange("r").sortWithinPartitions("r").select("value").write.mode("overwrite").text(path)


def write_cells(cells: DataFrame, path: str, tile: int = 4096) -> None:
    """Cells as Parquet in folders of large tiles, so that a read of a window opens only its tiles."""
    at = cells.withColumns({"tr": F.floor(F.col("r") / tile), "tc": F.floor(F.col("c") / tile)})
    at.repartition("tr", "tc").write.mode("overwrite").partitionBy("tr", "tc").parquet(path)


def read_cells(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None, tile: int = 4096) -> DataFrame:
    """Cells back, of the rows and columns ``window`` (first and last of each) if given: whole tiles are skipped."""
    cells = spark.read.parquet(path)
    if window:
        r0, r1, c0, c1 = window
        cells = cells.where(F.col("tr").between(r0 // tile, r1 // tile) & F.col("tc").between(c0 // tile, c1 // tile) & F.col("r").between(r0, r1) & F.col("c").between(c0, c1))
    return cells.drop("tr", "tc")


def log_events(spark: SparkSession, events: list[tuple[str, dict]], path: str, first: bool = False) -> None:
    """Append events as JSON lines with the time; ``first`` starts the log anew."""
    rows = [(name, {k: str(v) for k, v in payload.items()}) for name, payload in events]
    frame = spark.createDataFrame(rows, "event string, payload map<string,string>").select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "event", "payload")
    frame.coalesce(1).write.mode("overwrite" if first else "append").json(path)
