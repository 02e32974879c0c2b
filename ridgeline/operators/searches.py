"""Many least-cost searches at once, over shared tiles.

A search is an ``Ask``: a start (or an end, reversed), a cost raster, a walking model and, if given, targets.
The cost tiles are packed once for all searches; each search has states of its own, for the tiles it has
reached and no others.  A round sends the borders of what changed to the tiles beside, of all
searches together, so the number of rounds is that of the longest search and not their sum.

What a round writes are the states that it changed, as a delta beside the earlier ones; when
the deltas outgrow the states they are merged.  Writing so follows the fronts, not the grid.
With ``bounded`` searches a border does not travel on where its least cost is above ``beyond`` times what the search's
targets already cost: those tiles cannot matter to the ways there, and no tile behind them runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions import cellwise as fn
from ridgeline.operators.fixpoint import TILE, changed_edges, edges_to, latest, one_by_one, settle, shifted, tile_shape, to_tiles, unpack
from ridgeline.operators.stencil import OFFSETS
from ridgeline.session import materialize, run_path
from ridgeline.sources.grid import Grid

STEPS = list(OFFSETS.values())
ROUNDING = 1e-9  # of costs, when they are compared with a bound
_STATE = "search int, tr long, tc long, round int, state binary, goals array<struct<target:int,far:double>>, edges array<struct<dr:int,dc:int,least:double,strip:binary>>"
_EDGES = pa.list_(pa.struct([("dr", pa.int32()), ("dc", pa.int32()), ("least", pa.float64()), ("strip", pa.binary())]))
_STATE_ARROW = pa.schema([("search", pa.int32()), ("tr", pa.int64()), ("tc", pa.int64()), ("round", pa.int32()), ("state", pa.binary()), ("goals", pa.list_(pa.struct([("target", pa.int32()), ("far", pa.float64())]))), ("edges", _EDGES)])


@dataclass(frozen=True)
class Ask:
    """One search: ``source``, where it has to get to (none: everywhere), over which cost, how fast on slopes."""

    source: tuple[int, int]
    targets: tuple[tuple[int, int], ...] = ()
    cost: str = "cost"
    reverse: bool = False
    decay: float = fn.DECAY


def moves(static: dict, px: float, timed: bool, reverse: bool, decay: float = fn.DECAY) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    """For each offset, the cost of coming from that neighbour (or of going there, reversed).

    A diagonal step needs both cells beside it to be passable or outside of the grid; where one of them has a
    higher ``ford`` factor than both ends, the step costs as much more, so that no stream is crossed for nothing.
    """
    cost, inside, ford = static["cost"], ~np.isnan(static["inside"]), static.get("ford")
    here = cost[1:-1, 1:-1]
    for dr, dc in STEPS:
        length = px * (2**0.5 if dr and dc else 1.0)
        w = (here + shifted(cost, dr, dc)) / 2.0
        if timed:
            rise = (static["z"][1:-1, 1:-1] - shifted(static["z"], dr, dc)) * (-1.0 if reverse else 1.0)
            w = w * (length / 1000.0 / (np.exp(-decay * np.abs(rise / length + fn.BEST_GRADE)) * fn.BEST_SPEED))
        else:
            w = w * length
        if dr and dc:
            beside = ((dr, 0), (0, dc))
            for o in beside:
                w = np.where(np.isnan(shifted(cost, *o)) & shifted(inside, *o), np.nan, w)
            if ford is not None:
                at = lambda o: np.nan_to_num(shifted(ford, *o), nan=1.0)
                ends, corner = np.maximum(at((0, 0)), at((dr, dc))), np.maximum(*map(at, beside))
                w = np.where((corner > ends) & (corner > 1.0), w * corner / np.maximum(ends, 1e-12), w)
        yield (dr, dc), np.where(np.isnan(w), np.inf, w)


def relax(static: dict, far: np.ndarray, px: float, timed: bool, reverse: bool, decay: float = fn.DECAY) -> np.ndarray:
    """Bring one tile's costs to their fixpoint, given its border."""
    steps = list(moves(static, px, timed, reverse, decay))
    closed = np.isnan(static["cost"][1:-1, 1:-1])
    far[np.isnan(far)] = np.inf

    def sweep(rows: slice, cols: slice, window: np.ndarray) -> bool:
        inner, shut, changed = window[1:-1, 1:-1], closed[rows, cols], False
        here = [(o, w[rows, cols]) for o, w in steps]
        while True:
            new = np.minimum.reduce([inner, *(shifted(window, *o) + w for o, w in here)])
            new[shut] = np.inf
            if np.array_equal(new, inner):
                return changed
            inner[...], changed = new, True

    return settle(far, sweep)


def came_from(static: dict, far: np.ndarray, px: float, timed: bool, reverse: bool = False, decay: float = fn.DECAY) -> tuple[np.ndarray, np.ndarray]:
    """``distance, back`` of a tile's own cells: NaN where nothing leads, ``back`` the offset's index towards the predecessor."""
    sums = np.stack([shifted(far, *o) + w for o, w in moves(static, px, timed, reverse, decay)])
    here = far[1:-1, 1:-1]
    reached = np.isfinite(here)
    return np.where(reached, here, np.nan), np.where(reached & (here > 0), sums.argmin(axis=0).astype(float), np.nan)


class Searches:
    """Settled searches; ``search`` in results is the index of the ask."""

    def __init__(self, cells: DataFrame, grid: Grid, asks: list[Ask], z: str | None = None, ford: str | None = None, size: int = TILE, bounded: bool = False, beyond: float = 1.0):
        self.grid, self.asks, self.size, self.timed, self.px = grid, list(asks), size, z is not None, grid.cell_area**0.5
        self.bounded, self.beyond = bounded, beyond
        self.costs = sorted({a.cost for a in asks})
        named = {f"cost_{k}": F.col(c).cast("double") for k, c in enumerate(self.costs)} | {"inside": F.lit(1.0)}
        named |= {n: F.col(c).cast("double") for n, c in (("z", z), ("ford", ford)) if c}
        self.names = list(named)
        self.spark = cells.sparkSession
        self.tiles = to_tiles(cells.select("r", "c", *(v.alias(n) for n, v in named.items())), grid, self.names, size)
        self.goals: dict[tuple[int, int], float] = {}
        self.written = self.rounds = 0
        self.one_tile = max(grid.rows, grid.cols) <= size
        if self.one_tile:
            start = F.explode(F.array(*(F.lit(k) for k in range(len(self.asks))))).alias("search")
            self.states = self.tiles.select("*", start, F.lit(None).cast("binary").alias("state"), F.lit(None).cast("array<struct<dr:int,dc:int,strip:binary>>").alias("strips")).mapInArrow(self._step(0), _STATE)
        else:
            self.tiles = materialize(self.tiles, "cost-tiles")
            self._settle()

    def _reader(self):
        """Function from a row of tiles and an ask to the rasters of that ask's search."""
        names, grid, size, which = self.names, self.grid, self.size, {c: f"cost_{k}" for k, c in enumerate(self.costs)}

        def read(row: dict, ask: Ask) -> dict:
            wanted = [which[ask.cost], *(n for n in names if not n.startswith("cost_"))]
            arrays = unpack(row, wanted, grid, size)
            return {"cost" if n == wanted[0] else n: a for n, a in arrays.items()}

        return read

    def _step(self, round_: int):
        """Function that brings rows of tile, state and strips to their fixpoints and returns the states that changed."""
        asks, grid, size, px, timed, read = self.asks, self.grid, self.size, self.px, self.timed, self._reader()

        high, wide = -(-grid.rows // size), -(-grid.cols // size)

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in one_by_one(batches):
                ask, at = asks[row["search"]], (row["tr"] * size, row["tc"] * size)
                h, w = tile_shape(grid, row["tr"], row["tc"], size)
                own = read(row, ask)
                far = np.full((h + 2, w + 2), np.inf) if row["state"] is None else np.frombuffer(row["state"]).reshape(h + 2, w + 2).copy()
                before, ring = far.copy(), {-1: slice(0, 1), 0: slice(1, -1), 1: slice(-1, None)}
                for s in row["strips"] or ():
                    part = far[ring[s["dr"]], ring[s["dc"]]]
                    np.minimum(part, np.frombuffer(s["strip"]).reshape(part.shape), out=part)
                r, c = ask.source[0] - at[0], ask.source[1] - at[1]
                if 0 <= r < h and 0 <= c < w and not np.isnan(own["cost"][r + 1, c + 1]):
                    far[r + 1, c + 1] = 0.0
                after = relax(own, far, px, timed, ask.reverse, ask.decay)
                if np.array_equal(after[1:-1, 1:-1], before[1:-1, 1:-1]):
                    continue
                goals = [{"target": k, "far": float(after[r - at[0] + 1, c - at[1] + 1])} for k, (r, c) in enumerate(ask.targets) if 0 <= r - at[0] < h and 0 <= c - at[1] < w]
                edges = [{"dr": dr, "dc": dc, "least": float(strip.min()), "strip": np.ascontiguousarray(strip).tobytes()} for dr, dc, strip in changed_edges(before, after) if 0 <= row["tr"] + dr < high and 0 <= row["tc"] + dc < wide]
                yield pa.RecordBatch.from_pylist([{"search": row["search"], "tr": row["tr"], "tc": row["tc"], "round": round_, "state": after.tobytes(), "goals": goals, "edges": edges}], schema=_STATE_ARROW)

        return step

    def _sent(self, changed: DataFrame) -> DataFrame:
        """Changed states with those of their changed edges that may still matter to the search's targets."""
        limit = F.element_at(F.array(*(F.lit(self._limit(k)) for k in range(len(self.asks)))), F.col("search") + 1)
        return changed.select("search", "tr", "tc", F.filter("edges", lambda e: (e["least"] < float("inf")) & (e["least"] <= limit)).alias("edges"))

    def _limit(self, search: int) -> float:
        targets = range(len(self.asks[search].targets))
        if not self.bounded or not targets:
            return float("inf")
        return max(self.goals.get((search, k), float("inf")) for k in targets) * self.beyond * (1 + ROUNDING)

    def _note(self, changed: DataFrame) -> tuple[int, list]:
        """Count a round's states, keep what targets cost now, and return the count and the tiles' extent."""
        goals = F.flatten(F.collect_list(F.when(F.size("goals") > 0, F.transform("goals", lambda g: F.struct("search", g["target"].alias("target"), g["far"].alias("far"))))))
        # One row: a goal comes from one tile, so there are as many as targets at most.
        row = changed.agg(F.count("*").alias("n"), goals.alias("goals"), *(f(c).alias(f"{f.__name__}_{c}") for c in ("tr", "tc") for f in (F.min, F.max))).first()
        self.goals |= {(g.search, g.target): g.far for g in row.goals}
        return row.n, [row.min_tr, row.max_tr, row.min_tc, row.max_tc]

    def _settle(self) -> None:
        keys, size = ["search", "tr", "tc"], self.size
        sources = self.spark.createDataFrame([(k, a.source[0] // size, a.source[1] // size) for k, a in enumerate(self.asks)], "search int, tr long, tc long")
        work = self.tiles.join(F.broadcast(sources), ["tr", "tc"]).select("*", F.lit(None).cast("binary").alias("state"), F.lit(None).cast("array<struct<dr:int,dc:int,strip:binary>>").alias("strips"))
        paths, merged, pending = [], 0, 0
        while True:
            path = run_path(self.spark, "search-states")
            work.mapInArrow(self._step(self.rounds), _STATE).write.parquet(path)
            changed = self.spark.read.schema(_STATE).parquet(path)
            n, extent = self._note(changed)
            paths.append(path)
            self.rounds, self.written, pending = self.rounds + 1, self.written + n, pending + n
            if not n:
                break
            if pending > 2 * max(merged, 1) and len(paths) > 4:
                whole = materialize(self._latest(paths), "search-states")
                paths, merged, pending = [whole.inputFiles()[0].rsplit("/", 1)[0]], whole.count(), 0
            sent = self._sent(changed)
            asked = edges_to(sent, ["search"])  # a row of three numbers for each tile and search at most
            each = sent.select(*keys, F.explode("edges").alias("e"))
            strips = each.select("search", (F.col("tr") + F.col("e.dr")).alias("tr"), (F.col("tc") + F.col("e.dc")).alias("tc"), F.struct((-F.col("e.dr")).alias("dr"), (-F.col("e.dc")).alias("dc"), F.col("e.strip").alias("strip")).alias("s"))
            strips = strips.groupBy(*keys).agg(F.collect_list("s").alias("strips"))  # of eight neighbours at most
            near = self.spark.read.schema(_STATE).parquet(*paths).where(F.col("tr").between(extent[0] - 1, extent[1] + 1) & F.col("tc").between(extent[2] - 1, extent[3] + 1))
            known = latest(near, keys, asked).select(*keys, "state")
            wanted = self.tiles.join(F.broadcast(asked.select("tr", "tc").distinct()), ["tr", "tc"], "left_semi")
            work = strips.join(known, keys, "left").join(wanted, ["tr", "tc"])
        self.states = self._latest(paths)

    def _latest(self, paths: list[str]) -> DataFrame:
        return latest(self.spark.read.schema(_STATE).parquet(*paths), ["search", "tr", "tc"])

    def costs_of_targets(self) -> dict[tuple[int, int], float]:
        """``(search, target) -> cost``, of what can be reached."""
        if self.one_tile and not self.goals:
            self.states = materialize(self.states, "search-states")
            self._note(self.states)
        return {k: v for k, v in self.goals.items() if v < float("inf")}

    def cells(self) -> DataFrame:
        """``search, r, c, distance, back``: ``back`` is the offset's index towards the predecessor; unreached cells have NULLs."""
        asks, grid, size, px, timed, read = self.asks, self.grid, self.size, self.px, self.timed, self._reader()

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in one_by_one(batches):
                h, w = tile_shape(grid, row["tr"], row["tc"], size)
                distance = back = np.full((h, w), np.nan)
                if row["state"] is not None:
                    ask = asks[row["search"]]
                    far = np.frombuffer(row["state"]).reshape(h + 2, w + 2)
                    distance, back = came_from(read(row, ask), far, px, timed, ask.reverse, ask.decay)
                r, c = np.divmod(np.arange(h * w), w)
                columns = [pa.array(np.full(h * w, row["search"], np.int32)), pa.array(r + row["tr"] * size), pa.array(c + row["tc"] * size)]
                columns += [pa.array(np.ascontiguousarray(a).ravel(), from_pandas=True, type=pa.float64()) for a in (distance, back)]
                yield pa.RecordBatch.from_arrays(columns, names=["search", "r", "c", "distance", "back"])

        spread_ddl, names = "search int, r long, c long, distance double, back double", ["search", "tr", "tc", "state", *self.names]
        if self.one_tile:
            every = self.tiles.withColumn("search", F.explode(F.array(*(F.lit(k) for k in range(len(self.asks))))))
            return every.join(self.states.select("search", "tr", "tc", "state"), ["search", "tr", "tc"], "left").mapInArrow(spread, spread_ddl)
        reached = self.states.select("search", "tr", "tc", "state").join(self.tiles, ["tr", "tc"]).select(*names)
        every = self.tiles.select("tr", "tc", F.explode(F.array(*(F.lit(k) for k in range(len(self.asks))))).alias("search"))
        missed = every.join(F.broadcast(self.states.select("search", "tr", "tc")), ["search", "tr", "tc"], "left_anti")  # three numbers for each tile
        missed = missed.select("search", "tr", "tc", *(F.lit(None).cast("binary").alias(n) for n in ("state", *self.names)))
        return reached.unionByName(missed).mapInArrow(spread, spread_ddl)

    def paths(self) -> DataFrame:
        """``search, target, seq, r, c, distance``: the cells from each source to each of its targets (by index), in order.

        Ways of all searches are walked back together, inside one tile at a time each; what goes from tile to tile is the
        cell where a way leaves, so the work follows the ways and not the grid.
        """
        asks, grid, size, px, timed, read = self.asks, self.grid, self.size, self.px, self.timed, self._reader()
        spark, folder = self.spark, run_path(self.spark, "walked")
        self.states = materialize(self.states, "search-states")
        schema = "search int, target int, step long, r long, c long, distance double, out_r long, out_c long"
        waiting = [(k, t, 0, r, c) for k, a in enumerate(asks) for t, (r, c) in enumerate(a.targets)]
        fields = [*[pa.int32()] * 2, *[pa.int64()] * 3, pa.float64(), *[pa.int64()] * 2]
        while waiting:
            at_tile: dict = {}
            for search, target, step, r, c in waiting:
                at_tile.setdefault((search, r // size, c // size), []).append((target, step, r, c))

            def walk(batches, at_tile=at_tile):
                for batch in batches:
                    for row in batch.to_pylist():
                        ask, top, left = asks[row["search"]], row["tr"] * size, row["tc"] * size
                        h, w = tile_shape(grid, row["tr"], row["tc"], size)
                        own = read(row, ask)
                        far, back = came_from(own, np.frombuffer(row["state"]).reshape(h + 2, w + 2), px, timed, ask.reverse, ask.decay)
                        out: list = []
                        for target, step, r, c in at_tile[row["search"], row["tr"], row["tc"]]:
                            r, c = r - top, c - left
                            while not np.isnan(far[r, c]):
                                here, toward = (row["search"], target, step, r + top, c + left, float(far[r, c])), back[r, c]
                                if not np.isnan(toward):
                                    r, c = r + STEPS[int(toward)][0], c + STEPS[int(toward)][1]
                                inside = 0 <= r < h and 0 <= c < w
                                out.append((*here, *((None, None) if inside else (r + top, c + left))))
                                step += 1
                                if np.isnan(toward) or not inside:
                                    break
                        columns = list(zip(*out)) or [()] * 8
                        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, fields)], names=["search", "target", "step", "r", "c", "distance", "out_r", "out_c"])

            wanted = spark.createDataFrame(list(at_tile), "search int, tr long, tc long")  # a row for each way at most
            part = run_path(spark, "walked-tile")
            own = self.tiles.join(F.broadcast(wanted.select("tr", "tc").distinct()), ["tr", "tc"], "left_semi")
            rows = self.states.select("search", "tr", "tc", "state").join(F.broadcast(wanted), ["search", "tr", "tc"], "left_semi").join(own, ["tr", "tc"])
            rows.mapInArrow(walk, schema).write.parquet(part)
            made = spark.read.schema(schema).parquet(part)
            made.drop("out_r", "out_c").coalesce(1).write.mode("append").parquet(folder)
            waiting = [(x.search, x.target, x.step + 1, x.out_r, x.out_c) for x in made.where("out_r is not null").collect()]  # a row for each way at most
        walked = spark.read.schema("search int, target int, step long, r long, c long, distance double").parquet(folder)
        last = Window.partitionBy("search", "target")
        return walked.select("search", "target", (F.max("step").over(last) - F.col("step")).alias("seq"), "r", "c", "distance")
