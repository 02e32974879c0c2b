"""Points, lines, polygons and tracks from GeoJSON, GPX and KML, and back to GeoJSON; all by Spark's readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.functions.crs import convert

_GEOMETRY = "struct<type:string,coordinates:string>"
_FEATURES = f"type string, features array<struct<type:string,geometry:{_GEOMETRY},properties:map<string,string>>>"


def features(spark: SparkSession, path: str) -> DataFrame:
    """``fid, kind, coordinates, properties`` of a GeoJSON collection; coordinates are JSON text."""
    read = spark.read.schema(_FEATURES).option("multiLine", True).json(path)
    return read.select(F.posexplode("features").alias("fid", "f")).select("fid", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties"))


def points(spark: SparkSession, path: str, crs: str = "EPSG:4326") -> DataFrame:
    """``ord, x, y``: all points in order of the features, multi-points flattened."""
    read = features(spark, path)
    one = F.when(F.col("kind") == "Point", F.array(F.from_json("coordinates", "array<double>"))).when(F.col("kind") == "MultiPoint", F.from_json("coordinates", "array<array<double>>"))
    flat = read.select("fid", F.posexplode(one).alias("k", "p"))
    x, y = convert(F.col("p")[0], F.col("p")[1], "EPSG:4326", crs)
    # A file of way points is short; its order is that of the features.
    return flat.select((F.row_number().over(Window.orderBy("fid", "k")) - 1).alias("ord"), x.alias("x"), y.alias("y"))


def polygon_sides(spark: SparkSession, path: str, crs: str = "EPSG:4326") -> DataFrame:
    """``fid, x1, y1, x2, y2``: the sides of all rings of polygons and multi-polygons."""
    read = features(spark, path)
    rings = F.when(F.col("kind") == "Polygon", F.array(F.from_json("coordinates", "array<array<array<double>>>"))).when(F.col("kind") == "MultiPolygon", F.from_json("coordinates", "array<array<array<array<double>>>>"))
    flat = read.select("fid", F.explode(F.flatten(rings)).alias("ring"))
    pair = F.expr("transform(sequence(0, size(ring) - 2), i -> struct(ring[i] AS a, ring[i + 1] AS b))")
    sides = flat.where(F.size("ring") > 1).select("fid", F.explode(pair).alias("s"))
    (x1, y1), (x2, y2) = (convert(F.col(f"s.{n}")[0], F.col(f"s.{n}")[1], "EPSG:4326", crs) for n in "ab")
    return sides.select("fid", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def typed_points(texts: DataFrame, column: str) -> DataFrame:
    """Adds ``x, y`` from coordinates typed as ``lon; lat``, ``lon, lat`` or ``lon lat``; NULL if unreadable."""
    parts = F.filter(F.split(F.trim(F.col(column)), r"\s*;\s*|\s*,\s*|\s+"), lambda p: p != "")
    good = F.size(parts) == 2
    return texts.withColumns({"x": F.when(good, F.get(parts, F.lit(0)).try_cast("double")), "y": F.when(good, F.get(parts, F.lit(1)).try_cast("double"))})


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """``track, seg, seq, lon, lat, ele, ts`` of GPX files."""
    segment = "trkpt array<struct<_lat:double,_lon:double,ele:double,time:string>>"
    read = spark.read.schema(segment).option("rowTag", "trkseg").format("xml").load(path)
    named = read.select(F.col("_metadata.file_path").alias("track"), "trkpt").withColumn("__at", F.monotonically_increasing_id())
    numbered = named.withColumn("seg", F.row_number().over(Window.partitionBy("track").orderBy("__at")) - 1)
    fixes = numbered.select("track", "seg", F.posexplode("trkpt").alias("seq", "p"))
    return fixes.select("track", "seg", "seq", F.col("p._lon").alias("lon"), F.col("p._lat").alias("lat"), F.col("p.ele").alias("ele"), F.to_timestamp("p.time").alias("ts"))


def read_kml_tracks(spark: SparkSession, path: str) -> DataFrame:
    """``track, seg, seq, lon, lat, ele, ts`` of ``gx:Track`` elements: times and positions in pairs."""
    read = spark.read.schema("`gx:coord` array<string>, `when` array<string>").option("rowTag", "gx:Track").format("xml").load(path)
    named = read.select(F.col("_metadata.file_path").alias("track"), F.col("gx:coord").alias("where"), "when").withColumn("__at", F.monotonically_increasing_id())
    numbered = named.withColumn("seg", F.row_number().over(Window.partitionBy("track").orderBy("__at")) - 1)
    n = F.least(F.size("where"), F.size("when"))
    zipped = F.arrays_zip(F.slice("where", F.lit(1), n).alias("where"), F.slice("when", F.lit(1), n).alias("when"))
    fixes = numbered.select("track", "seg", F.posexplode(zipped).alias("seq", "p"))
    part = lambda i: F.get(F.split(F.trim(F.col("p.where")), r"\s+"), F.lit(i)).try_cast("double")
    return fixes.select("track", "seg", "seq", part(0).alias("lon"), part(1).alias("lat"), part(2).alias("ele"), F.to_timestamp("p.when").alias("ts"))


def read_kml_lines(spark: SparkSession, path: str) -> DataFrame:
    """``track, seg, seq, lon, lat, ele, ts`` of KML line strings; there are no times."""
    read = spark.read.schema("coordinates string").option("rowTag", "LineString").format("xml").load(path)
    named = read.select(F.col("_metadata.file_path").alias("track"), "coordinates").withColumn("__at", F.monotonically_increasing_id())
    numbered = named.withColumn("seg", F.row_number().over(Window.partitionBy("track").orderBy("__at")) - 1)
    fixes = numbered.select("track", "seg", F.posexplode(F.split(F.trim("coordinates"), r"\s+")).alias("seq", "p"))
    part = lambda i: F.get(F.split("p", ","), F.lit(i)).try_cast("double")
    return fixes.select("track", "seg", "seq", part(0).alias("lon"), part(1).alias("lat"), part(2).alias("ele"), F.lit(None).cast("timestamp").alias("ts"))


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Tracks by the file's suffix; a KML without tracks gives its lines."""
    if path.lower().endswith(".gpx"):
        return read_gpx(spark, path)
    if not path.lower().endswith(".kml"):
        raise ValueError(f"{path} is neither GPX nor KML")
    tracks = read_kml_tracks(spark, path)
    return tracks if tracks.limit(1).count() else read_kml_lines(spark, path)


def to_geojson(rows: DataFrame, kind: str, coordinates, properties: list[str]) -> DataFrame:
    """``value``: one GeoJSON feature for each row, for Spark's text writer; ``coordinates`` is an array column."""
    geometry = F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))).alias("value"))
