"""Relief tiles from and to GeoTIFF files.

A relief comes as one file or a mosaic of files.  A first pass reads headers only and gives a row for each
block (strip or tile) with its place in the file; blocks are then dealt to tasks by their bytes, and each
task reads the byte ranges of its blocks, so one large file is the work of many tasks and no file is
ever a single value.  Going out, cells are grouped by tiles of bounded size, and each tile becomes a file of its own.

Read are band 1 of one or more bands, integers and floats of 8 to 64 bits, both byte orders, plain and Deflate
blocks, and both predictors.  Other files raise.  Paths are URIs that Arrow opens.

Defined results: values equal to the file's NoData, and NaN, are NULL; cells that no file
covers are absent; where files overlap, a cell is there once for each.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.session import materialize
from ridgeline.sources.grid import Grid

TILE = 1024
NODATA = -9999.0

#: Fixed values of the TIFF format: bytes and struct letter of each field type, and the tags used.
FIELD_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d"}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_OFFSETS, BANDS, STRIP_ROWS, STRIP_BYTES, PLANAR = 256, 257, 258, 259, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, TRANSFORM, GEO_KEYS, NODATA_TAG = 33550, 33922, 34264, 34735, 42113
GEOGRAPHIC_KEY, PROJECTED_KEY = 2048, 3072
PLAIN, DEFLATE, OLD_DEFLATE = 1, 8, 32946

PIECE_BYTES = 8 << 20  # of blocks, for one task
PAGE = 1 << 16  # of a header, read at once
STRIP = 64  # rows of a strip that is written
_HEAD = "file string, rows long, cols long, x0 double, dx double, y0 double, dy double, rx double, ry double, crs string, block_rows int, block_cols int, dtype string, bands int, compression int, predictor int, nodata double, places array<struct<at:long,n:long>>"


@dataclass(frozen=True)
class Header:
    grid: Grid
    dtype: str
    bands: int
    compression: int
    predictor: int
    block: tuple[int, int]  # rows, columns
    places: tuple[tuple[int, int], ...]  # offset and bytes of each block of band 1
    nodata: float | None


class _Pages:
    """Bytes of a file by place, read a page or more at a time."""

    def __init__(self, read):
        self.read, self.start, self.held = read, 0, b""

    def get(self, form: str, at: int) -> tuple:
        n = struct.calcsize(form)
        if not self.start <= at <= at + n <= self.start + len(self.held):
            self.start, self.held = at, self.read(max(n, PAGE), at)
        return struct.unpack_from(form, self.held, at - self.start)


def _fields(pages: _Pages) -> tuple[str, dict[int, tuple]]:
    order = {b"II": "<", b"MM": ">"}.get(pages.get("2s", 0)[0])
    if order is None or pages.get(order + "H", 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at = pages.get(order + "I", 4)[0]
    entries = [(at + 2 + 12 * k, *pages.get(order + "HHI", at + 2 + 12 * k)) for k in range(pages.get(order + "H", at)[0])]
    found = {}
    for entry, tag, kind, n in entries:
        if kind in FIELD_TYPES:
            form = f"{order}{n}{FIELD_TYPES[kind]}"
            found[tag] = pages.get(form, entry + 8 if struct.calcsize(form) <= 4 else pages.get(order + "I", entry + 8)[0])
    return order, found


def _crs(fields: dict[int, tuple]) -> str:
    keys = fields.get(GEO_KEYS, ())
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    code = codes.get(PROJECTED_KEY) or codes.get(GEOGRAPHIC_KEY)
    return f"EPSG:{code}" if code else ""


def header(read) -> Header:
    """What a file says of itself; ``read(n, at)`` gives ``n`` of its bytes, or what there is."""
    order, f = _fields(_Pages(read))
    first = lambda tag, default=None: f[tag][0] if tag in f else default
    rows, cols, bands = first(HEIGHT), first(WIDTH), first(BANDS, 1)
    if TRANSFORM in f:
        m = f[TRANSFORM]
        x0, dx, rx, y0, ry, dy = m[3], m[0], m[1], m[7], m[4], m[5]
    elif PIXEL_SCALE in f and TIE_POINT in f:
        (sx, sy), tie = f[PIXEL_SCALE][:2], f[TIE_POINT]
        x0, dx, rx, y0, ry, dy = tie[3] - tie[0] * sx, sx, 0.0, tie[4] + tie[1] * sy, 0.0, -sy
    else:
        raise ValueError("the file has no geotransform")
    tiled = TILE_OFFSETS in f
    block = (first(TILE_HEIGHT), first(TILE_WIDTH)) if tiled else (min(rows, first(STRIP_ROWS, rows)), cols)
    places = tuple(zip(f[TILE_OFFSETS if tiled else STRIP_OFFSETS], f[TILE_BYTES if tiled else STRIP_BYTES]))
    apart = first(PLANAR, 1) == 2
    if apart:
        places = places[: len(places) // bands]
    kind = {1: "u", 2: "i", 3: "f"}.get(first(SAMPLE_FORMAT, 1))
    if kind is None or first(BITS) % 8:
        raise ValueError("values of this kind are not read")
    nodata = f[NODATA_TAG][0].split(b"\0")[0].strip() if NODATA_TAG in f else b""
    grid = Grid(rows, cols, x0, dx, y0, dy, rx, ry, _crs(f))
    return Header(grid, f"{order}{kind}{first(BITS) // 8}", 1 if apart else bands, first(COMPRESSION, PLAIN), first(PREDICTOR, 1), block, places, float(nodata) if nodata else None)


def block_values(head: Header, packed: bytes) -> np.ndarray:
    """Band 1 of one block, as doubles; the last strip may be short."""
    if head.compression == PLAIN:
        raw = packed
    elif head.compression in (DEFLATE, OLD_DEFLATE):
        raw = zlib.decompress(packed)
    else:
        raise ValueError(f"compression {head.compression} is not read")
    dtype, cols = np.dtype(head.dtype), head.block[1]
    rows = len(raw) // (cols * head.bands * dtype.itemsize)
    raw = raw[: rows * cols * head.bands * dtype.itemsize]
    if head.predictor == 3:
        # Differences of bytes along a row, the high bytes of all its values first.
        planes = np.cumsum(np.frombuffer(raw, np.uint8).reshape(rows, -1, head.bands), axis=1, dtype=np.uint8)
        joined = planes.reshape(rows, dtype.itemsize, cols * head.bands).transpose(0, 2, 1)
        values = np.ascontiguousarray(joined).view(dtype.newbyteorder(">")).reshape(rows, cols, head.bands)
    else:
        values = np.frombuffer(raw, dtype).reshape(rows, cols, head.bands)
        if head.predictor == 2:
            values = np.cumsum(values, axis=1, dtype=dtype.newbyteorder("="))
    return values[:, :, 0].astype(np.float64)


def _open(uri: str) -> pa.NativeFile:
    store, path = fs.FileSystem.from_uri(uri if "://" in uri else uri.replace(":/", ":///", 1))
    return store.open_input_file(path)


def heads(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file of ``path``: its grid, how its values are kept, and where its blocks are.  Only headers are read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for uri in batch.column(0).to_pylist():
                with _open(uri) as source:
                    size = source.size()
                    h = header(lambda n, at: source.read_at(min(n, max(0, size - at)), at))
                g = h.grid
                rows.append({"file": uri, **{n: getattr(g, n) for n in ("rows", "cols", "x0", "dx", "y0", "dy", "rx", "ry", "crs")}, "block_rows": h.block[0], "block_cols": h.block[1], "dtype": h.dtype, "bands": h.bands, "compression": h.compression, "predictor": h.predictor, "nodata": h.nodata, "places": [{"at": a, "n": n} for a, n in h.places]})
            yield pa.RecordBatch.from_pylist(rows, schema=_HEAD_ARROW)

    # The source lists files without reading them, since their content is not selected.
    files = spark.read.format("binaryFile").load(path).select("path")
    return files.mapInArrow(read, _HEAD)


_HEAD_ARROW = pa.schema(
    [("file", pa.string()), ("rows", pa.int64()), ("cols", pa.int64()), *((n, pa.float64()) for n in ("x0", "dx", "y0", "dy", "rx", "ry")), ("crs", pa.string()), ("block_rows", pa.int32()), ("block_cols", pa.int32()), ("dtype", pa.string())]
    + [("bands", pa.int32()), ("compression", pa.int32()), ("predictor", pa.int32()), ("nodata", pa.float64()), ("places", pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())])))]
)


def _shared_grid(found: DataFrame, path: str) -> Grid:
    """The grid of all files together: same cell size and CRS, corners on one lattice."""
    row0, col0 = F.col("y0") / F.col("dy"), F.col("x0") / F.col("dx")
    one = found.agg(
        F.countDistinct(F.struct("dx", "dy", "rx", "ry", "crs")).alias("kinds"), *(F.first(n).alias(n) for n in ("dx", "dy", "rx", "ry", "crs", "rows", "cols")), F.count("*").alias("n"),
        F.min_by("y0", row0).alias("y0"), F.min_by("x0", col0).alias("x0"), F.max(row0 + F.col("rows")).alias("row1"), F.min(row0).alias("row0"), F.max(col0 + F.col("cols")).alias("col1"), F.min(col0).alias("col0"),
    ).first()
    if one.kinds != 1 or (one.n > 1 and (one.rx or one.ry)):
        raise ValueError(f"the files of {path} do not share one grid")
    if one.n == 1:
        return Grid(one.rows, one.cols, one.x0, one.dx, one.y0, one.dy, one.rx, one.ry, one.crs)
    return Grid(round(one.row1 - one.row0), round(one.col1 - one.col0), one.x0, one.dx, one.y0, one.dy, crs=one.crs)


def read_geotiff(spark: SparkSession, path: str, piece_bytes: int = PIECE_BYTES) -> tuple[DataFrame, Grid]:
    """``r, c, z`` of all files of ``path`` and the grid that they share."""
    found = materialize(heads(spark, path), "geotiff-heads")
    grid = _shared_grid(found, path)
    off = {"r0": (F.col("y0") - grid.y0) / grid.dy, "c0": (F.col("x0") - grid.x0) / grid.dx}
    if not found.where(F.greatest(*(F.abs(v - F.round(v)) for v in off.values())) > 1e-3).isEmpty():
        raise ValueError("a file lies between the cells of the others")
    across = F.ceil(F.col("cols") / F.col("block_cols"))
    top, left = F.floor(F.col("k") / across) * F.col("block_rows"), F.col("k") % across * F.col("block_cols")
    each = found.withColumns({n: F.round(v).cast("long") for n, v in off.items()}).select("*", F.posexplode("places").alias("k", "place"))
    blocks = each.select(
        "file", "place.at", "place.n", (F.col("r0") + top).cast("long").alias("top"), (F.col("c0") + left).cast("long").alias("left"), (F.col("rows") - top).cast("long").alias("high"), (F.col("cols") - left).cast("long").alias("wide"),
        "block_rows", "block_cols", "dtype", "bands", "compression", "predictor", "nodata",
    )

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            for b in batch.to_pylist():
                if b["file"] != name:
                    name, source = b["file"], _open(b["file"])
                head = Header(grid, b["dtype"], b["bands"], b["compression"], b["predictor"], (b["block_rows"], b["block_cols"]), (), b["nodata"])
                z = block_values(head, source.read_at(b["n"], b["at"]))[: b["high"], : b["wide"]]
                gone = np.isnan(z) | (z == head.nodata if head.nodata is not None else False)
                r, c = np.indices(z.shape)
                yield pa.RecordBatch.from_arrays([pa.array((r + b["top"]).ravel()), pa.array((c + b["left"]).ravel()), pa.array(z.astype(np.float32).ravel(), mask=gone.ravel())], names=["r", "c", "z"])

    total = blocks.agg(F.sum("n")).first()[0] or 0
    placed = blocks.repartition(max(1, -(-total // piece_bytes)), "file", F.floor(F.col("at") / piece_bytes)).sortWithinPartitions("file", "at")
    return placed.mapInArrow(cells, "r long, c long, z float"), grid


def pack(values: np.ndarray, grid: Grid, nodata: float = NODATA, kind: str = "f4") -> bytes:
    """A GeoTIFF file with Deflate strips of ``STRIP`` rows; ``kind`` is a NumPy type, such as ``f4`` or ``u1``."""
    strips = [zlib.compress(np.ascontiguousarray(values[k : k + STRIP], f"<{kind}").tobytes(), 6) for k in range(0, len(values), STRIP)]
    sizes = [len(x) for x in strips]
    strip, places = b"".join(strips), [8 + sum(sizes[:k]) for k in range(len(sizes))]
    model, key = (2, GEOGRAPHIC_KEY) if grid.geographic else (1, PROJECTED_KEY)
    keys = (1, 1, 0, 3, 1024, 0, 1, model, 1025, 0, 1, 1, key, 0, 1, int(grid.crs.removeprefix("EPSG:") or 32767))
    where = (grid.dx, grid.rx, 0.0, grid.x0, grid.ry, grid.dy, 0.0, grid.y0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)
    text = f"{nodata:g}".encode() + b"\0"
    entries = [
        (WIDTH, "I", (values.shape[1],)), (HEIGHT, "I", (values.shape[0],)), (BITS, "H", (8 * int(kind[1:]),)), (COMPRESSION, "H", (DEFLATE,)), (262, "H", (1,)), (STRIP_OFFSETS, "I", tuple(places)),
        (BANDS, "H", (1,)), (STRIP_ROWS, "I", (STRIP,)), (STRIP_BYTES, "I", tuple(sizes)), (SAMPLE_FORMAT, "H", ("uif".index(kind[0]) + 1,)), (TRANSFORM, "d", where), (GEO_KEYS, "H", keys), (NODATA_TAG, "s", (text,)),
    ]
    codes = {v: k for k, v in FIELD_TYPES.items() if k in (2, 3, 4, 12)}
    start = 8 + len(strip) + len(strip) % 2
    spare, table = b"", struct.pack("<H", len(entries))
    for tag, letter, value in entries:
        n = len(value[0]) if letter == "s" else len(value)
        body = struct.pack(f"<{n}{letter}", *value)
        if len(body) > 4:
            place = start + 2 + 12 * len(entries) + 4 + len(spare)
            spare, body = spare + body + b"\0" * (len(body) % 2), struct.pack("<I", place)
        table += struct.pack("<HHI", tag, codes[letter], n) + body.ljust(4, b"\0")
    return b"II" + struct.pack("<HI", 42, start) + strip + b"\0" * (len(strip) % 2) + table + struct.pack("<I", 0) + spare


def geotiff_tiles(cells: DataFrame, grid: Grid, value: str, tile: int = TILE, nodata: float = NODATA, kind: str = "f4") -> DataFrame:
    """``tile_r, tile_c, content``: one GeoTIFF for each tile that has cells; NULL cells are NoData.

    A tile at the grid's edge is cut to the grid; a last row or column of cells alone goes to
    the tile before it.
    """
    rows, cols = grid.rows, grid.cols
    last_r, last_c = (max(0, -(-n // tile) - 1 - (n % tile == 1)) for n in (rows, cols))

    def draw(key: tuple, table: pa.Table) -> pa.Table:
        tr, tc = (k.as_py() for k in key)
        r0, c0 = tr * tile, tc * tile
        z = np.full((rows - r0 if tr == last_r else tile, cols - c0 if tc == last_c else tile), nodata)
        known = table.filter(table.column("v").is_valid())
        z[known.column("r").to_numpy() - r0, known.column("c").to_numpy() - c0] = known.column("v").to_numpy()
        x0, y0 = grid.x0 + c0 * grid.dx + r0 * grid.rx, grid.y0 + c0 * grid.ry + r0 * grid.dy
        return pa.table({"tile_r": [tr], "tile_c": [tc], "content": [pack(z, replace(grid, rows=z.shape[0], cols=z.shape[1], x0=x0, y0=y0), nodata, kind)]})

    of = lambda name, last: F.least(F.floor(F.col(name) / tile).cast("long"), F.lit(last).cast("long"))
    at = cells.where(grid.holds(F.col("r"), F.col("c"))).select(of("r", last_r).alias("tr"), of("c", last_c).alias("tc"), F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col(value).cast("double").alias("v"))
    return at.groupBy("tr", "tc").applyInArrow(draw, "tile_r long, tile_c long, content binary")


def write_geotiff(cells: DataFrame, grid: Grid, value: str, path: str, **options) -> DataFrame:
    """Write the tiles to files ``tile_<r>_<c>.tif`` in the folder ``path`` (a URI that Arrow opens).

    Each file gets its name when it is complete, so a repeated task replaces it as a whole.
    Returns ``tile_r, tile_c, file``, already written.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        for batch in batches:
            names = [f"tile_{r}_{c}.tif" for r, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            for name, content in zip(names, batch.column(2)):
                part = f"{folder}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(content.as_buffer())
                store.move(part, f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(names, pa.string())], names=["tile_r", "tile_c", "file"])

    return materialize(geotiff_tiles(cells, grid, value, **options).mapInArrow(write, "tile_r long, tile_c long, file string"), "geotiff-index")
