import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.sources import geotiff
from ridgeline.sources.grid import Grid

GRID = Grid(5, 7, 1000.0, 10.0, 5000.0, -10.0)


def cells_of(spark, rows, cols):
    id_ = F.col("id")
    z = F.when(id_ % 11 == 3, None).otherwise((id_ * 1.25 - 4).cast("float"))
    return spark.range(rows * cols).select(F.expr(f"id div {cols}").alias("r"), (id_ % cols).alias("c"), z.alias("z"))


def reader(data):
    return lambda n, at: data[at : at + n]


@pytest.mark.parametrize("order", "<>")
def test_blocks_with_predictors(order):
    z = np.arange(35, dtype=np.int64).reshape(5, 7) * 37 % 101
    head = geotiff.Header(GRID, f"{order}i2", 1, geotiff.DEFLATE, 2, (5, 7), (), None)
    raw = np.diff(z, axis=1, prepend=0).astype(f"{order}i2").tobytes()
    assert (geotiff.block_values(head, zlib.compress(raw)) == z).all()
    head = geotiff.Header(GRID, f"{order}f4", 1, geotiff.PLAIN, 3, (5, 7), (), None)
    planes = z.astype(">f4").view(np.uint8).reshape(5, 7, 4).transpose(0, 2, 1).reshape(5, 28)
    raw = np.diff(planes.astype(np.int64), axis=1, prepend=0).astype(np.uint8).tobytes()
    assert (geotiff.block_values(head, raw) == z).all()
    two = geotiff.Header(GRID, f"{order}u1", 2, geotiff.PLAIN, 1, (5, 7), (), None)
    assert (geotiff.block_values(two, np.stack([z, z + 1], axis=2).astype("u1").tobytes()) == z).all()


def test_mosaic_round_trip(spark, tmp_path):
    # 9 columns with tiles of 4: the last column goes to the tile before it.
    grid = Grid(6, 9, 1000.0, 10.0, 5000.0, -10.0)
    cells = cells_of(spark, 6, 9)
    index = geotiff.write_geotiff(cells, grid, "z", f"file://{tmp_path}/out", tile=4)
    assert sorted(r.file for r in index.collect()) == ["tile_0_0.tif", "tile_0_1.tif", "tile_1_0.tif", "tile_1_1.tif"]
    back, found = geotiff.read_geotiff(spark, f"file://{tmp_path}/out")
    assert found == grid
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, cells.collect()))


def test_classes_and_rotation(spark, tmp_path):
    grid = Grid(3, 4, 10.0, 2.0, 20.0, -2.0, 0.5, -0.5, "EPSG:4326")
    cells = spark.range(12).select(F.expr("id div 4").alias("r"), (F.col("id") % 4).alias("c"), F.when(F.col("id") > 2, F.col("id") % 6).alias("k"))
    geotiff.write_geotiff(cells, grid, "k", f"file://{tmp_path}/out", nodata=0.0, kind="u1")
    back, found = geotiff.read_geotiff(spark, f"file://{tmp_path}/out")
    assert found == grid
    assert {(r.r, r.c): r.z for r in back.collect()} == {(i // 4, i % 4): float(i % 6) if i > 2 and i % 6 else None for i in range(12)}


def test_strips_and_damage():
    z = np.arange(35, dtype="<f4").reshape(5, 7)
    data = geotiff.pack(z, GRID)
    head = geotiff.header(reader(data))
    assert head.grid == GRID and head.nodata == -9999.0 and head.block == (5, 7)
    (at, n), = head.places
    assert (geotiff.block_values(head, data[at : at + n]) == z).all()
    with pytest.raises(ValueError):
        geotiff.header(reader(b"PK" + data[2:]))
    with pytest.raises(ValueError):
        geotiff.header(reader(data.replace(struct.pack("<HH", geotiff.TRANSFORM, 12), struct.pack("<HH", 65000, 12))))


def test_grids_that_differ(spark, tmp_path):
    for k, size in enumerate((10.0, 20.0)):
        (tmp_path / f"{k}.tif").write_bytes(geotiff.pack(np.zeros((5, 7), "<f4"), Grid(5, 7, 1000.0, size, 5000.0, -size)))
    with pytest.raises(ValueError):
        geotiff.read_geotiff(spark, f"file://{tmp_path}/*.tif")


def test_one_file_of_many_blocks_is_read_by_many_tasks(spark, tmp_path):
    rng = np.random.default_rng(2)
    z = rng.normal(500, 100, (700, 300)).astype("<f4")
    z[rng.random(z.shape) < 0.05] = -9999.0
    grid = Grid(700, 300, 1000.0, 10.0, 5000.0, -10.0)
    (tmp_path / "one.tif").write_bytes(geotiff.pack(z, grid))
    (head,) = geotiff.heads(spark, f"file://{tmp_path}").collect()
    assert len(head.places) == 11 and head.rows == 700
    back, found = geotiff.read_geotiff(spark, f"file://{tmp_path}", piece_bytes=100_000)
    assert found == grid
    rows = back.select("r", "c", "z", F.spark_partition_id().alias("task")).collect()
    assert len({r.task for r in rows}) >= 4
    got = np.zeros(z.shape)
    for r in rows:
        got[r.r, r.c] = -9999.0 if r.z is None else r.z
    assert len(rows) == z.size and (got == z).all()


def test_headers_larger_than_a_page(monkeypatch):
    monkeypatch.setattr(geotiff, "PAGE", 16)
    monkeypatch.setattr(geotiff, "STRIP", 2)
    z = np.arange(700, dtype="<f4").reshape(100, 7)
    data = geotiff.pack(z, Grid(100, 7, 1000.0, 10.0, 5000.0, -10.0))
    head = geotiff.header(reader(data))
    assert len(head.places) == 50 and (np.concatenate([geotiff.block_values(head, data[a : a + n]) for a, n in head.places]) == z).all()
    with pytest.raises(ValueError, match="compression 5"):
        geotiff.block_values(geotiff.Header(GRID, "<f4", 1, 5, 1, (5, 7), (), None), b"")
