"""Connected regions of a mask: labels, sizes, flat water, outlines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.operators.fixpoint import TILE, connected, settle, shifted, to_cells, to_tiles
from ridgeline.operators.terrain import flat
from ridgeline.session import materialize
from ridgeline.sources.grid import Grid

EIGHT = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]
FOUR = [(-1, 0), (0, -1), (0, 1), (1, 0)]


def _spread(arrays: dict, offsets: list) -> dict:
    """Smallest cell id of each region inside one tile."""
    ids = arrays["id"][1:-1, 1:-1].copy()
    label = np.full(arrays["id"].shape, np.inf)
    label[1:-1, 1:-1] = np.where(np.isnan(ids), np.inf, ids)
    mask = ~np.isnan(ids)

    def sweep(rows: slice, cols: slice, window: np.ndarray) -> bool:
        inner, open_, changed = window[1:-1, 1:-1], mask[rows, cols], False
        while True:
            new = np.where(open_, np.minimum.reduce([inner, *(shifted(window, *o) for o in offsets)]), np.inf)
            if np.array_equal(new, inner):
                return changed
            inner[...], changed = new, True

    settle(label, sweep)
    out = np.full(label.shape, np.nan)
    out[1:-1, 1:-1] = np.where(mask, label[1:-1, 1:-1], np.nan)
    return {"label": out}


def regions(cells: DataFrame, grid: Grid, mask: str, connectivity: int = 8, size: int = TILE) -> DataFrame:
    """``r, c, region`` of the cells in the mask; a region is named by its first cell, row * cols + col.

    Tiles label their own cells; only pairs of cells across tile borders are linked, and
    components of those links join the labels.
    """
    if connectivity not in (4, 8):
        raise ValueError("connectivity is 4 or 8")
    offsets = EIGHT if connectivity == 8 else FOUR
    inside = cells.where(F.col(mask)).select("r", "c", (F.col("r") * grid.cols + F.col("c")).alias("id"))
    tiles = to_tiles(inside, grid, ["id"], size)
    local = to_cells(tiles, grid, ["id"], lambda a: _spread(a, offsets), ["label"], size).where("label is not null")
    local = materialize(local.select("r", "c", F.col("label").cast("long").alias("label")), "labels")
    edge = ((F.col("r") % size).isin(0, size - 1)) | ((F.col("c") % size).isin(0, size - 1))
    border = local.where(edge)
    step = F.explode(F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in offsets if (a, b) > (0, 0))))
    moved = border.select((F.col("label")).alias("a"), "r", "c", step.alias("s")).select("a", (F.col("r") + F.col("s.dr")).alias("r"), (F.col("c") + F.col("s.dc")).alias("c"))
    links = moved.join(border.withColumnRenamed("label", "b"), ["r", "c"]).select("a", "b")
    roots = connected(links)
    return local.join(roots, F.col("label") == F.col("node"), "left").select("r", "c", F.coalesce("root", "label").alias("region"))


def numbered(found: DataFrame) -> DataFrame:
    """Regions numbered from 1 in the order of their first cells: ranks within ranges of names, and the ranges' totals before them."""
    names = found.select("region").distinct().repartitionByRange("region").withColumn("range", F.spark_partition_id())
    names = materialize(names, "region-names")
    totals = names.groupBy("range").agg(F.count("*").alias("n"))
    before = totals.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))  # a row for each range
    rank = F.row_number().over(Window.partitionBy("range").orderBy("region"))
    labels = names.withColumn("rank", rank).join(before, "range").select("region", (F.col("rank") + F.col("before")).cast("int").alias("label"))
    return found.join(labels, "region")


def large_regions(cells: DataFrame, grid: Grid, mask: str, least_ha: float, size: int = TILE) -> DataFrame:
    """The cells of 8-connected regions of at least ``least_ha``; all regions if that is not positive."""
    found = regions(cells, grid, mask, 8, size)
    if least_ha <= 0:
        return found
    least = max(1, int(np.ceil(least_ha * 1e4 / grid.cell_area)))
    big = found.groupBy("region").count().where(F.col("count") >= least).select("region")
    return found.join(big, "region", "left_semi").select("r", "c", "region")


def flat_water(cells: DataFrame, grid: Grid, least_m2: float = 5e5, sea_level: float = 0.5, size: int = TILE) -> DataFrame:
    """``r, c, water``: ``sea`` or ``lake`` for cells of large areas that are flat."""
    found = regions(flat(cells), grid, "flat", 8, size).join(cells.select("r", "c", "z"), ["r", "c"])
    kinds = found.groupBy("region").agg(F.count("*").alias("n"), F.min("z").alias("level")).where(F.col("n") * grid.cell_area >= least_m2)
    named = kinds.select("region", F.when(F.col("level") <= sea_level, "sea").otherwise("lake").alias("water"))
    return found.join(named, "region").select("r", "c", "water")


# Directions of cell sides, in the order of where they lead from a corner.
HEADINGS = [(-1, 0), (0, -1), (0, 1), (1, 0)]
#: For each neighbour that is not of the region: the corner of the cell where its side starts, and the heading with the region on the right.
SIDES = {(-1, 0): ((0, 0), 2), (0, 1): ((0, 1), 3), (1, 0): ((1, 1), 1), (0, -1): ((1, 0), 0)}
_CHAIN = "region long, id long, first_r long, first_c long, first_d int, last_d int, end_r long, end_c long, closed boolean, n long, low long, off long, corners array<struct<at:long,r:long,c:long>>"
_CHAIN_ARROW = pa.schema(
    [("region", pa.int64()), ("id", pa.int64()), ("first_r", pa.int64()), ("first_c", pa.int64()), ("first_d", pa.int32()), ("last_d", pa.int32()), ("end_r", pa.int64()), ("end_c", pa.int64()), ("closed", pa.bool_()), ("n", pa.int64()), ("low", pa.int64()), ("off", pa.int64())]
    + [("corners", pa.list_(pa.struct([("at", pa.int64()), ("r", pa.int64()), ("c", pa.int64())])))]
)


def _turn(d: int, to: int) -> int:
    """Least for the turn to the left, which a side takes where corners touch: the cells there are one region."""
    return HEADINGS[d][1] * HEADINGS[to][0] - HEADINGS[d][0] * HEADINGS[to][1]


def sides(found: DataFrame) -> DataFrame:
    """``region, r, c, d``: sides of cells with another region, or none, beyond them, from corner ``r, c`` on with heading ``d``."""
    cells = found.select("region", "r", "c")
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc"), F.lit(p).alias("r"), F.lit(q).alias("c"), F.lit(d).alias("d")) for (a, b), ((p, q), d) in SIDES.items())))
    around = cells.select("region", "r", "c", each.alias("s")).select("region", "r", "c", "s", (F.col("r") + F.col("s.dr")).alias("nr"), (F.col("c") + F.col("s.dc")).alias("nc"))
    other = cells.select("region", F.col("r").alias("nr"), F.col("c").alias("nc"))
    free = around.join(other, ["region", "nr", "nc"], "left_anti")
    return free.select("region", (F.col("r") + F.col("s.r")).alias("r"), (F.col("c") + F.col("s.c")).alias("c"), F.col("s.d").alias("d"))


def _chains(loose: DataFrame, grid: Grid, size: int) -> DataFrame:
    """Sides strung together as far as one tile goes: closed rings, and chains that end at a corner of another tile."""
    wide = grid.cols + 1

    def string(key: tuple, t: pa.Table) -> pa.Table:
        top, left = (k.as_py() * size for k in key)
        region, r, c, d = (t.column(n).to_pylist() for n in ("region", "r", "c", "d"))
        leaving: dict = {}
        for i, at in enumerate(zip(region, r, c)):
            leaving.setdefault(at, []).append(i)
        after: list = [None] * len(r)
        for i in range(len(r)):
            to = (r[i] + HEADINGS[d[i]][0], c[i] + HEADINGS[d[i]][1])
            if top <= to[0] < top + size and left <= to[1] < left + size:
                after[i] = min(leaving[(region[i], *to)], key=lambda j: _turn(d[i], d[j]))
        name = [(r[i] * wide + c[i]) * 4 + d[i] for i in range(len(r))]
        led, seen, out = set(after), [False] * len(r), []
        first = [i for i in range(len(r)) if i not in led] + sorted(range(len(r)), key=name.__getitem__)
        for start in first:
            if seen[start]:
                continue
            chain, i = [], start
            while i is not None and not seen[i]:
                seen[i] = True
                chain.append(i)
                i = after[i]
            last = chain[-1]
            low = min(range(len(chain)), key=lambda k: name[chain[k]])
            corners = [{"at": k, "r": r[j], "c": c[j]} for k, j in enumerate(chain) if k and d[j] != d[chain[k - 1]]]
            out.append((region[start], name[start], r[start], c[start], d[start], d[last], r[last] + HEADINGS[d[last]][0], c[last] + HEADINGS[d[last]][1], i is not None, len(chain), name[chain[low]], low, corners))
        return pa.Table.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*out), _CHAIN_ARROW)], schema=_CHAIN_ARROW)

    tile = [F.floor(F.col(n) / size).alias(f"t{n}") for n in "rc"]
    return loose.select("region", "r", "c", "d", *tile).groupBy("tr", "tc").applyInArrow(string, _CHAIN)


def boundaries(found: DataFrame, grid: Grid, size: int = TILE) -> DataFrame:
    """``region, ring, seq, r, c``: the corners (row, col) of each region's closed rings, in order, where they turn.

    Sides are strung within tiles.  What goes over tiles are chains, which find their successors by one join and
    their places in the ring by pointer doubling (list ranking), in as many rounds as the logarithm of the chains of the longest ring.
    A ring starts at its first side in the order of corners, which names it; ``seq`` counts sides from there.
    """
    chains = materialize(_chains(sides(found), grid, size), "chains")
    starts = chains.where("not closed").select("region", F.col("first_r").alias("end_r"), F.col("first_c").alias("end_c"), F.col("id").alias("ptr"), F.col("first_d").alias("next_d"))
    turn = F.element_at(F.array(*(F.lit(_turn(a, b)) for a in range(4) for b in range(4))), F.col("last_d") * 4 + F.col("next_d") + 1)
    led = chains.where("not closed").join(starts, ["region", "end_r", "end_c"])
    # A chain's end has two chains to go on with where corners touch, and one elsewhere.
    linked = led.groupBy("id").agg(F.min(F.struct(turn.alias("turn"), "ptr")).alias("go")).select("id", F.col("go.ptr").alias("ptr"))
    state = materialize(chains.join(linked, "id", "left").select("id", F.coalesce("ptr", "id").alias("ptr"), F.col("id").alias("pred"), F.col("ptr").alias("to"), "last_d", "low", "off", F.col("n").alias("len"), "closed"), "chain-places")
    before = state.select(F.coalesce("to", "pred").alias("id"), F.col("last_d").alias("before_d"))
    places = state.select("id", "ptr", "low", "off", "len")
    while not state.where("not closed").isEmpty():
        onward = places.select(F.col("id").alias("ptr"), F.col("ptr").alias("next"), F.col("low").alias("low2"), F.col("off").alias("off2"), F.col("len").alias("len2"))
        best = F.least(F.struct("low", "off"), F.struct(F.col("low2").alias("low"), (F.col("len") + F.col("off2")).alias("off")))
        moved = places.join(onward, "ptr").select("id", F.col("next").alias("ptr"), best["low"].alias("low"), best["off"].alias("off"), (F.col("len") + F.col("len2")).alias("len"), (F.col("low2") < F.col("low")).alias("changed"))
        moved = materialize(moved, "chain-places")
        if moved.where("changed").isEmpty():  # each chain's stretch holds its ring's first side: all have gone round
            break
        places = moved.drop("changed")
    ringed = chains.drop("low", "off").join(places.select("id", F.col("low").alias("ring"), "off"), "id").join(before, "id")
    lengths = ringed.groupBy("ring").agg(F.sum("n").alias("all"))
    own = F.when(F.col("first_d") != F.col("before_d"), F.array(F.struct(F.lit(0).cast("long").alias("at"), F.col("first_r").alias("r"), F.col("first_c").alias("c"))))
    corners = ringed.join(lengths, "ring").select("region", "ring", "off", "all", F.explode(F.concat(F.coalesce(own, F.expr("CAST(array() AS array<struct<at:bigint,r:bigint,c:bigint>>)")), "corners")).alias("k"))
    return corners.select("region", "ring", F.pmod(F.col("k.at") - F.col("off"), F.col("all")).alias("seq"), "k.r", "k.c")


def outlines(found: DataFrame, grid: Grid, size: int = TILE) -> DataFrame:
    """``region, n_cells, area_m2, area_ha, rings``: closed rings of grid corners (row, col) around each region, outer ring first.

    ``boundaries`` has put the corners in order; here the corners of a region become one value.
    """
    corners = boundaries(found, grid, size).groupBy("region", "ring").agg(F.sort_array(F.collect_list(F.struct("seq", "r", "c"))).alias("k"))
    ring = F.transform("k", lambda p: F.struct(p["r"].alias("r"), p["c"].alias("c")))
    rings = corners.groupBy("region").agg(F.sort_array(F.collect_list(F.struct("ring", F.concat(ring, F.slice(ring, 1, 1)).alias("k")))).alias("rings"))
    sizes = found.groupBy("region").agg(F.count("*").alias("n_cells"))
    area = F.col("n_cells") * grid.cell_area
    return sizes.join(rings, "region").select("region", "n_cells", area.alias("area_m2"), (area / 1e4).alias("area_ha"), F.transform("rings", lambda x: x["k"]).alias("rings"))
