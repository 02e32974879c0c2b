"""Iteration on DataFrames: connected components, and fixpoints over tiles.

Every round is written to the shared folder, so lineage stays short and lost executors cost a
round at most.  Components need a number of rounds that grows with the logarithm of the input;
tile fixpoints exchange one-cell borders, so only borders cross tiles.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.session import materialize, run_path
from ridgeline.sources.grid import Grid

TILE = 512
BLOCK = 64  # of a tile, swept at once


def connected(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns ``a``, ``b``); the root is the smallest node.

    Large-star and small-star rounds; each is a grouping with map-side minimum and a join, so
    a node with very many links is never gathered.  Rounds end when the links no longer change.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    state = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x"), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)")).alias("s")).first()
        if now == state or not now.n:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        large = materialize(large, "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")), F.struct("a", F.col("low").alias("b")))).alias("e")).select("e.*")
        edges = materialize(small.where("a <> b").distinct(), "small-star")


# -- tiles ----------------------------------------------------------------------------------


def tile_shape(grid: Grid, tr: int, tc: int, size: int) -> tuple[int, int]:
    return min(size, grid.rows - tr * size), min(size, grid.cols - tc * size)


def to_tiles(cells: DataFrame, grid: Grid, names: list[str], size: int = TILE) -> DataFrame:
    """``tr, tc`` and one binary column of doubles for each raster, with a border of one cell.

    Cells beside a tile go to it too, so a tile knows its surroundings; what is NULL, missing or
    outside of the grid is NaN.
    """
    near = [F.array_distinct(F.array(*(F.floor((F.col(a) + d) / size) for d in (0, -1, 1)))) for a in ("r", "c")]
    spread = cells.select("r", "c", *(F.col(n).cast("double").alias(n) for n in names), F.explode(near[0]).alias("tr"), near[1].alias("tcs")).withColumn("tc", F.explode("tcs")).drop("tcs")
    inside = spread.where((F.col("tr") >= 0) & (F.col("tc") >= 0) & (F.col("tr") * size < grid.rows) & (F.col("tc") * size < grid.cols))

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        tr, tc = key[0].as_py(), key[1].as_py()
        h, w = tile_shape(grid, tr, tc, size)
        r, c = rows.column("r").to_numpy() - tr * size + 1, rows.column("c").to_numpy() - tc * size + 1
        out = {"tr": [tr], "tc": [tc]}
        for n in names:
            a = np.full((h + 2, w + 2), np.nan)
            a[r, c] = rows.column(n).to_numpy(zero_copy_only=False)
            out[n] = [a.tobytes()]
        return pa.table(out, schema=pa.schema([("tr", pa.int64()), ("tc", pa.int64()), *((n, pa.binary()) for n in names)]))

    return inside.groupBy("tr", "tc").applyInArrow(pack, "tr long, tc long, " + ", ".join(f"{n} binary" for n in names))


def unpack(row: dict, names: list[str], grid: Grid, size: int) -> dict[str, np.ndarray]:
    h, w = tile_shape(grid, row["tr"], row["tc"], size)
    return {n: np.frombuffer(row[n]).reshape(h + 2, w + 2).copy() for n in names}


def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of batches; a batch may hold many tiles, of which one at a time becomes Python objects."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def edge_strips(a: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """What each of the eight neighbours needs of a tile's own cells."""
    cut = {-1: slice(1, 2), 0: slice(1, -1), 1: slice(-2, -1)}
    return {(dr, dc): a[cut[dr], cut[dc]] for dr in (-1, 0, 1) for dc in (-1, 0, 1) if dr or dc}


def settle(state: np.ndarray, sweep: Callable, block: int = BLOCK) -> np.ndarray:
    """Bring one tile (with its border) to a fixpoint, block by block, and return it.

    ``sweep(rows, cols, window)`` brings ``window``, the state of those inner rows and columns and
    the cells around them, to its own fixpoint in place and tells whether it changed.  Only
    blocks beside one that changed are swept again, so work follows the front of the change.
    """
    high, wide = state.shape[0] - 2, state.shape[1] - 2
    places = [(r, c) for r in range(0, high, block) for c in range(0, wide, block)]
    waiting, queued = deque(places), set(places)
    while waiting:
        at = waiting.popleft()
        queued.discard(at)
        rows, cols = (slice(a, min(a + block, n)) for a, n in zip(at, (high, wide)))
        if sweep(rows, cols, state[rows.start : rows.stop + 2, cols.start : cols.stop + 2]):
            for dr in (-block, 0, block):
                for dc in (-block, 0, block):
                    beside = (at[0] + dr, at[1] + dc)
                    if (dr or dc) and 0 <= beside[0] < high and 0 <= beside[1] < wide and beside not in queued:
                        waiting.append(beside)
                        queued.add(beside)
    return state


def changed_edges(before: np.ndarray, after: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """Offset and values of those edges of a tile that are not what they were; the other neighbours know them already."""
    old = edge_strips(before)
    return [(*at, strip) for at, strip in edge_strips(after).items() if not np.array_equal(strip, old[at], equal_nan=True)]


def edges_to(changed: DataFrame, by: list[str]) -> DataFrame:
    """``by, tr, tc`` of the tiles that edges of ``changed`` go to: a few numbers for each tile at most, to be broadcast."""
    each = changed.select(*by, "tr", "tc", F.explode("edges").alias("e"))
    return each.select(*by, (F.col("tr") + F.col("e.dr")).alias("tr"), (F.col("tc") + F.col("e.dc")).alias("tc")).distinct()


def latest(every: DataFrame, keys: list[str], among: DataFrame | None = None) -> DataFrame:
    """The newest row of each key (or of those ``among`` them), found by its round, so that no state is shuffled for it."""
    rounds = every.select(*keys, "round")
    if among is not None:
        rounds = rounds.join(F.broadcast(among), keys, "left_semi")
    return every.join(F.broadcast(rounds.groupBy(*keys).agg(F.max("round").alias("round"))), [*keys, "round"], "left_semi")


def tile_fixpoint(tiles: DataFrame, grid: Grid, static: list[str], kernel: Callable, size: int = TILE, state: str = "state", most_rounds: int = 100_000) -> DataFrame:
    """Iterate ``kernel(static arrays, state array) -> state array`` on all tiles until nothing changes.

    The kernel brings one tile to its own fixpoint, given its border.  A round sends the edges that
    changed to the tiles beside them, which run again.  Only those are read for it, and only
    states that changed are written, as a delta beside the earlier ones; when the deltas outgrow the states they
    are merged.  A grid of one tile needs no round.
    """
    names = [*static, state]
    fields = [("tr", pa.int64()), ("tc", pa.int64()), ("round", pa.int32()), (state, pa.binary()), ("edges", pa.list_(pa.struct([("dr", pa.int32()), ("dc", pa.int32()), ("strip", pa.binary())])))]
    schema, ddl = pa.schema(fields), f"tr long, tc long, round int, {state} binary, edges array<struct<dr:int,dc:int,strip:binary>>"

    def stepper(round_: int) -> Callable:
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            border = {-1: slice(0, 1), 0: slice(1, -1), 1: slice(-1, None)}
            for row in one_by_one(batches):
                a = unpack(row, names, grid, size)
                before, moved = a[state].copy(), a[state]
                for s in row.get("strips") or ():
                    part = moved[border[s["dr"]], border[s["dc"]]]
                    part[...] = np.frombuffer(s["strip"]).reshape(part.shape)
                if round_ and np.array_equal(before, moved, equal_nan=True):
                    continue
                after = kernel({n: a[n] for n in static}, moved)
                if round_ and np.array_equal(after, before, equal_nan=True):
                    continue
                edges = [{"dr": dr, "dc": dc, "strip": np.ascontiguousarray(strip).tobytes()} for dr, dc, strip in changed_edges(before, after)]
                yield pa.RecordBatch.from_pylist([{"tr": row["tr"], "tc": row["tc"], "round": round_, state: after.tobytes(), "edges": edges}], schema=schema)

        return step

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in one_by_one(batches):
            a = unpack(row, names, grid, size)
            row[state] = kernel({n: a[n] for n in static}, a[state]).tobytes()
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("tr", pa.int64()), ("tc", pa.int64()), *((n, pa.binary()) for n in names)]))

    tiles = tiles.select("tr", "tc", *names)
    if max(grid.rows, grid.cols) <= size:
        return tiles.mapInArrow(alone, tiles.schema)
    spark, keys = tiles.sparkSession, ["tr", "tc"]
    tiles = materialize(tiles, "tiles")
    still = tiles.drop(state)
    work, paths, merged, pending = tiles, [], 0, 0
    for round_ in range(most_rounds):
        path = run_path(spark, "tile-states")
        work.mapInArrow(stepper(round_), ddl).write.parquet(path)
        changed = spark.read.schema(ddl).parquet(path)
        n = changed.select("tr").count()
        paths.append(path)
        if not n:
            return still.join(latest(spark.read.schema(ddl).parquet(*paths), keys).select(*keys, state), keys)
        pending += n
        if pending > 2 * max(merged, 1) and len(paths) > 4:
            whole = run_path(spark, "tile-states")
            latest(spark.read.schema(ddl).parquet(*paths), keys).write.parquet(whole)
            paths, pending = [whole], 0
            merged = spark.read.schema(ddl).parquet(whole).select("tr").count()
        asked = edges_to(changed, [])
        sent = changed.select(*keys, F.explode("edges").alias("e"))
        strips = sent.select((F.col("tr") + F.col("e.dr")).alias("tr"), (F.col("tc") + F.col("e.dc")).alias("tc"), F.struct((-F.col("e.dr")).alias("dr"), (-F.col("e.dc")).alias("dc"), F.col("e.strip").alias("strip")).alias("s"))
        strips = strips.groupBy(*keys).agg(F.collect_list("s").alias("strips"))  # of eight neighbours at most
        known = latest(spark.read.schema(ddl).parquet(*paths), keys, asked).select(*keys, state)
        work = still.join(F.broadcast(asked), keys, "left_semi").join(known, keys).join(strips, keys)
    raise RuntimeError("no fixpoint within the rounds allowed")


def to_cells(tiles: DataFrame, grid: Grid, names: list[str], finish: Callable | None = None, outputs: list[str] | None = None, size: int = TILE) -> DataFrame:
    """``r, c`` and doubles (NaN as NULL): the arrays themselves or what ``finish`` makes of them."""
    outputs = outputs or names

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in one_by_one(batches):
            arrays = unpack(row, names, grid, size)
            made = finish(arrays) if finish else arrays
            h, w = tile_shape(grid, row["tr"], row["tc"], size)
            r, c = np.divmod(np.arange(h * w), w)
            columns = [pa.array(r + row["tr"] * size), pa.array(c + row["tc"] * size)]
            columns += [pa.array(np.ascontiguousarray(made[n][1:-1, 1:-1]).ravel(), from_pandas=True, type=pa.float64()) for n in outputs]
            yield pa.RecordBatch.from_arrays(columns, names=["r", "c", *outputs])

    return tiles.select("tr", "tc", *names).mapInArrow(spread, "r long, c long, " + ", ".join(f"{n} double" for n in outputs))


def shifted(a: np.ndarray, dr: int, dc: int) -> np.ndarray:
    """The neighbour at an offset of every inner cell."""
    return a[1 + dr : a.shape[0] - 1 + dr, 1 + dc : a.shape[1] - 1 + dc]
