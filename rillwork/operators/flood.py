"""Floods from the edge of a whole grid, over tiles: filled elevations, ways out, and structures that drain by their outlets.

The level of a cell is the least F with F = max(z, F(neighbour) + step) over the ways from the seeds, which start at their own
elevation. With a step over 0 every cell but a seed has a strictly lower neighbour, across flats and filled depressions
too: a flat's cells stand by their distance from its way out. Structures: water leaves one by its outlets only, so the flood enters
it there; an outlet opens as soon as the flood reaches it, whatever its own height; land may drain into any of a structure's cells.

Cells are dealt once to blocks of a few tiles' sides, those at a block's edge to the blocks beside it too; a task holds a block.
It floods those of its tiles beside which a level fell until none falls any more, and keeps their levels, so a later flood goes on
from there. From round to round only the levels at a block's edge that fell go to the blocks beside it, and a round floods the
blocks that got some; none falls any more after about as many rounds as a way out crosses blocks.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import flow
from .grid import STEPS
from .iterate import discard, written

STATIC = "tr long, tc long, r array<int>, c array<int>, dem array<double>, structure array<long>, kind array<tinyint>"
LEVELS = "tr long, tc long, level array<double>, out array<struct<tr:long,tc:long,r:int,c:int,level:double>>"
CELL = "r int, c int, dem double, filled double, code int"
#: Bits of a block's cells: its own one (not one beside it), an outlet, a seed.
OWN, OUTLET, SEED = 1, 2, 4
#: The greatest side of a block of several tiles, and of how many tiles' sides one is at most.
BLOCK, SPAN = 256, 4
INF = float("inf")
#: Sweeps over a whole tile before the rest is done cell by cell, in sides of the tile. Rough ground takes one to three.
SWEEPS = 8
#: The steps in the order in which a row-major scan meets the neighbours.
SCAN = sorted(STEPS, key=lambda s: (s[2], s[1]))


class Tile:
    """A tile, or a block of tiles, with a margin of one cell, as arrays: floor (the elevation, -inf at outlets, inf outside), structure, outlet, level.

    A sweep lowers all cells of a tile by their neighbours at once. It takes the same sums and maxima along the ways as a flood from a
    heap, so levels are equal to the bit; only ways that wind through a tile for more than SWEEPS sides are left to a heap."""

    def __init__(self, x: dict) -> None:
        r, c = x["r"].astype(np.int64), x["c"].astype(np.int64)
        own = x["own"] if "own" in x else np.ones(len(r), bool)
        self.top, self.left = int(r[own].min()) - 1, int(c[own].min()) - 1
        shape = (int(r[own].max()) - self.top + 2, int(c[own].max()) - self.left + 2)
        self.at = (r - self.top, c - self.left)
        self.level, self.floor = np.full(shape, INF), np.full(shape, INF)
        self.structure, self.outlet = np.zeros(shape, np.int64), np.zeros(shape, bool)
        void = np.isnan(x["dem"])
        self.structure[self.at], self.outlet[self.at] = x["structure"], x["outlet"]
        self.floor[self.at] = np.where(own, np.where(x["outlet"] | void, -INF, x["dem"]), INF)
        self.level[self.at] = x["level"] if "level" in x else np.where(own & x["seed"] & ~void, x["dem"], INF)
        self.own, self.given = own, (r[own], c[own], x["dem"][own], x["seed"][own])
        self._bound()

    def beside(self, values: np.ndarray, dx: int, dy: int) -> np.ndarray:
        """The neighbours' values of the cells inside the margin."""
        return values[1 + dy : values.shape[0] - 1 + dy, 1 + dx : values.shape[1] - 1 + dx]

    def may_come(self, dx: int, dy: int) -> np.ndarray:
        """Whether the flood comes to the cells from the neighbour there."""
        own = self.structure[1:-1, 1:-1]
        return (own == 0) | (own == self.beside(self.structure, dx, dy)) | self.outlet[1:-1, 1:-1]

    def _bound(self) -> None:
        """The cells to which the flood does not come from all sides, and the places from which it does, their own in place of others."""
        self.bound = np.argwhere((self.structure[1:-1, 1:-1] > 0) & ~self.outlet[1:-1, 1:-1])
        y, x = self.bound.T
        width = self.level.shape[1]
        here = (y + 1) * width + x + 1
        self.ways = np.array([np.where(self.may_come(dx, dy)[y, x], here + dy * width + dx, here) for _, dx, dy in STEPS])

    def come(self, r: np.ndarray, c: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Levels of cells in the margin. The places of those that fell."""
        y, x = r - self.top, c - self.left
        inside = (y >= 0) & (y < self.level.shape[0]) & (x >= 0) & (x < self.level.shape[1])
        y, x, level = y[inside], x[inside], level[inside]
        fell = level < self.level[y, x]
        self.level[y[fell], x[fell]] = level[fell]
        return y[fell], x[fell]

    def flood(self, step: float, side: int | None = None, beside: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        """Tiles of the side are flooded until no level falls: all of them, or those beside the places first."""
        h, w = (n - 2 for n in self.level.shape)
        side = side or max(h, w)
        ny, nx = -(-h // side), -(-w // side)
        wait = np.ones((ny, nx), bool)
        if beside is not None:
            wait[:] = False
            for _, dx, dy in STEPS:
                y, x = beside[0] - 1 + dy, beside[1] - 1 + dx
                inside = (y >= 0) & (y < h) & (x >= 0) & (x < w)
                wait[y[inside] // side, x[inside] // side] = True
        queue = deque(map(tuple, np.argwhere(wait).tolist()))
        parts: dict = {}
        while queue:
            i, j = queue.popleft()
            wait[i, j] = False
            if (i, j) not in parts:
                parts[i, j] = self._part(i * side, j * side, side)
            fell = self._sweep(step, *parts[i, j])
            for _, dx, dy in STEPS:
                to = (i + dy, j + dx)
                if 0 <= to[0] < ny and 0 <= to[1] < nx and not wait[to]:
                    rows = slice(None) if not dy else slice(0, 1) if dy < 0 else slice(-1, None)
                    cols = slice(None) if not dx else slice(0, 1) if dx < 0 else slice(-1, None)
                    if fell[rows, cols].any():
                        wait[to] = True
                        queue.append(to)

    def _part(self, y: int, x: int, side: int) -> tuple:
        """A tile's levels with a margin, its floor, the places of its bound cells inside it and their ways."""
        h, w = (min(side, n - 2 - at) for n, at in zip(self.level.shape, (y, x)))
        by, bx = self.bound[:, 0] - y, self.bound[:, 1] - x
        inside = (by >= 0) & (by < h) & (bx >= 0) & (bx < w)
        floor = np.ascontiguousarray(self.floor[y + 1 : y + 1 + h, x + 1 : x + 1 + w])
        return (y, x), self.level[y : y + h + 2, x : x + w + 2], floor, by[inside] * w + bx[inside], np.ascontiguousarray(self.ways[:, inside])

    def _sweep(self, step: float, at: tuple[int, int], level: np.ndarray, floor: np.ndarray, bound: np.ndarray, ways: np.ndarray) -> np.ndarray:
        """Which cells of the tile fell."""
        inner, flat = level[1:-1, 1:-1], self.level.reshape(-1)
        old = inner.copy()
        rows, new = np.empty((floor.shape[0], level.shape[1])), np.empty(floor.shape)
        for _ in range(SWEEPS * max(level.shape)):
            np.minimum(level[:-2], level[1:-1], out=rows)
            np.minimum(rows, level[2:], out=rows)
            np.minimum(rows[:, :-2], rows[:, 1:-1], out=new)
            np.minimum(new, rows[:, 2:], out=new)
            if len(bound):
                new.reshape(-1)[bound] = flat.take(ways).min(axis=0)
            new += step
            np.maximum(new, floor, out=new)
            fell = new < inner
            if not fell.any():
                return inner < old
            np.minimum(inner, new, out=inner)
        self._from_heap(step, np.argwhere(fell) + 1 + np.array(at))
        # The heap has gone on into the tiles beside this one, the sweeps before it have not.
        return inner < old

    def _from_heap(self, step: float, fell: np.ndarray) -> None:
        """The rest of a flood of which only these cells have not yet reached their neighbours."""
        width = self.level.shape[1]
        level, floor, structure, outlet = (x.ravel().tolist() for x in (self.level, self.floor, self.structure, self.outlet))
        heap = [(level[i], i) for i in (fell[:, 0] * width + fell[:, 1]).tolist()]
        heapq.heapify(heap)
        offsets = [dy * width + dx for _, dx, dy in STEPS]
        while heap:
            low, u = heapq.heappop(heap)
            if low > level[u]:
                continue
            for v in (u + d for d in offsets):
                if floor[v] < INF and (not structure[v] or structure[v] == structure[u] or outlet[v]):
                    up = max(floor[v], low + step)
                    if up < level[v]:
                        level[v] = up
                        heapq.heappush(heap, (up, v))
        self.level[:] = np.array(level).reshape(self.level.shape)

    def codes(self) -> np.ndarray:
        """Pointers to the lowest neighbour that the flood may come from, of equals the first in a row-major scan; 0 at seeds."""
        least = np.full((self.level.shape[0] - 2, self.level.shape[1] - 2), INF)
        code = np.zeros(least.shape, np.int32)
        for k, dx, dy in SCAN:
            there = np.where(self.may_come(dx, dy), self.beside(self.level, dx, dy), INF)
            lower = there < least
            np.copyto(least, there, where=lower)
            code[lower] = 1 << k
        _, _, dem, seed = self.given
        at = tuple(x[self.own] for x in self.at)
        level = self.level[at]
        return np.where((level == INF) | (seed & (level == dem)), 0, code[at[0] - 1, at[1] - 1])


ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "tinyint": pa.int8()}


def _listed(values: np.ndarray, kind: str) -> pa.Array:
    """One row: the values as its array."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values).cast(ARROW[kind]))


def _fallen(t: Tile, old: np.ndarray, side: int, tr: int, tc: int, beside: set[tuple[int, int]]) -> pa.Array:
    """One row: the cells at the block's edge whose levels fell, once for each block beside them."""
    r, c, _, _ = t.given
    level = t.level[tuple(x[t.own] for x in t.at)]
    edge = np.flatnonzero((level < old) & (np.isin(r % side, (0, side - 1)) | np.isin(c % side, (0, side - 1))))
    r, c, level = r[edge], c[edge], level[edge]
    found = []
    for _, dx, dy in STEPS:
        if (tr + dy, tc + dx) in beside:
            at = (((r + dy) // side) == tr + dy) & (((c + dx) // side) == tc + dx)
            n = int(at.sum())
            found.append((np.full(n, tr + dy), np.full(n, tc + dx), r[at], c[at], level[at]))
    cols = [np.concatenate([np.zeros(0), *x]) for x in zip(*found)] if found else [np.zeros(0)] * 5
    kinds = zip(cols, ("tr", "tc", "r", "c", "level"), ("long", "long", "int", "int", "double"))
    fields = {name: pa.array(x).cast(ARROW[kind]) for x, name, kind in kinds}
    return pa.ListArray.from_arrays(pa.array([0, len(cols[0])], pa.int32()), pa.StructArray.from_arrays(list(fields.values()), names=list(fields)))


def _levels(t: Tile, old: np.ndarray, side: int, tr: int, tc: int) -> dict:
    r, c = t.at[0] + t.top, t.at[1] + t.left
    beside = set(zip((r[~t.own] // side).tolist(), (c[~t.own] // side).tolist()))
    return {"tr": pa.array([tr], pa.int64()), "tc": pa.array([tc], pa.int64()), "level": _listed(t.level[t.at], "double"), "out": _fallen(t, old, side, tr, tc, beside)}


def _first(step: float, tile: int, side: int, seeds: Callable) -> Callable[[pa.Table], pa.Table]:
    """A block's rows to one row of arrays, flooded from its own seeds."""

    def run(rows: pa.Table) -> pa.Table:
        x = {n: rows[n].combine_chunks().to_numpy(zero_copy_only=False) for n in ("r", "c", "dem", "structure", "outlet", "own")}
        tr, tc = rows["tr"][0].as_py(), rows["tc"][0].as_py()
        own, r, c = x["own"], x["r"], x["c"]
        if own.any():
            near = own | ((r >= r[own].min() - 1) & (r <= r[own].max() + 1) & (c >= c[own].min() - 1) & (c <= c[own].max() + 1))
            order = np.flatnonzero(near)
            order = order[np.lexsort((c[order], r[order]))]
            x = {n: v[order] for n, v in x.items()}
            x["seed"] = seeds(x) & x["own"]
            t = Tile(x)
            t.flood(step, tile)
            made = _levels(t, np.full(int(t.own.sum()), INF), side, tr, tc)
            kind = OWN * x["own"] + OUTLET * x["outlet"] + SEED * x["seed"]
            return pa.table(made | {"r": _listed(x["r"], "int"), "c": _listed(x["c"], "int"), "dem": _listed(x["dem"], "double"), "structure": _listed(x["structure"], "long"), "kind": _listed(kind, "tinyint")}).select(names)
        return schema.empty_table()

    names = [f.split()[0] for f in (STATIC + LEVELS.removeprefix("tr long, tc long")).split(", ")]
    lists = {n: pa.list_(ARROW[k]) for n, k in (("r", "int"), ("c", "int"), ("dem", "double"), ("structure", "long"), ("kind", "tinyint"), ("level", "double"))}
    fallen = pa.list_(pa.struct([("tr", pa.int64()), ("tc", pa.int64()), ("r", pa.int32()), ("c", pa.int32()), ("level", pa.float64())]))
    schema = pa.schema([("tr", pa.int64()), ("tc", pa.int64()), *lists.items(), ("out", fallen)])
    return run


def _given(b: pa.RecordBatch, i: int) -> Tile:
    x = {n: b.column(n)[i].values.to_numpy(zero_copy_only=False) for n in ("r", "c", "dem", "structure", "kind", "level")}
    kind = x.pop("kind")
    return Tile(x | {"own": kind & OWN > 0, "outlet": kind & OUTLET > 0, "seed": kind & SEED > 0})


def _again(step: float, tile: int, side: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                t = _given(b, i)
                old = t.level[tuple(x[t.own] for x in t.at)]
                fell = t.come(*(f.to_numpy(zero_copy_only=False) for f in b.column("around")[i].values.flatten()))
                t.flood(step, tile, fell)
                made = _levels(t, old, side, b.column("tr")[i].as_py(), b.column("tc")[i].as_py())
                yield pa.RecordBatch.from_arrays(list(made.values()), names=list(made))

    return run


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            t = _given(b, i)
            r, c, dem, _ = t.given
            level = t.level[tuple(x[t.own] for x in t.at)]
            cols = (pa.array(r), pa.array(c), pa.array(dem), pa.array(level, mask=level == INF), pa.array(t.codes()))
            fields = [f.split() for f in CELL.split(", ")]
            yield pa.RecordBatch.from_arrays([x.cast(ARROW[kind]) for x, (_, kind) in zip(cols, fields)], names=[n for n, _ in fields])


def _square(col: str, side: int, d: int = 0) -> Column:
    return F.floor((F.col(col) + d) / side)


def _dealt(cells: DataFrame, side: int) -> DataFrame:
    """The cells by their block, and those at its edge by the blocks beside it too (own is false there)."""
    places = [F.struct(_square("r", side, i).alias("tr"), _square("c", side, j).alias("tc")) for i in (0, -1, 1) for j in (0, -1, 1)]
    inside = F.pmod("r", F.lit(side)).between(1, side - 2) & F.pmod("c", F.lit(side)).between(1, side - 2)
    rows = cells.withColumn("t", F.explode(F.when(inside, F.array(places[0])).otherwise(F.array_distinct(F.array(*places)))))
    own = (F.col("t.tr") == _square("r", side)) & (F.col("t.tc") == _square("c", side))
    return rows.select("t.tr", "t.tc", *cells.columns, own.alias("own"))


def flood(cells: DataFrame, seeds: Callable[[dict], np.ndarray], step: float = 0.0, tile: int = 256) -> DataFrame:
    """cells: r, c, dem, structure (0: none), outlet; seeds: which of a block's cells are. r, c, dem, filled, code (0 at seeds and where no flood comes, there filled is null)."""
    side = tile * max(1, min(SPAN, BLOCK // tile))
    whole = [F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.col("dem").cast("double").alias("dem"), F.coalesce(F.col("structure").cast("long"), F.lit(0)).alias("structure"), F.coalesce("outlet", F.lit(False)).alias("outlet")]
    rows = _dealt(cells.filter("dem IS NOT NULL").select(*whole), side)
    first = written(rows.groupBy("tr", "tc").applyInArrow(_first(step, tile, side, seeds), STATIC + LEVELS.removeprefix("tr long, tc long")))
    blocks, levels = first.drop("level", "out"), first.select("tr", "tc", "level")
    new, made = first, first
    while True:
        came = new.select(F.explode("out").alias("x")).select("x.*")
        active = written(came.groupBy("tr", "tc").agg(F.collect_list(F.struct("r", "c", "level")).alias("around")))
        if active.isEmpty():
            break
        # Blocks are joined with the few that are flooded anew.
        new = written(blocks.join(active, ["tr", "tc"]).join(levels, ["tr", "tc"]).mapInArrow(_again(step, tile, side), LEVELS))
        then = written(levels.join(active.select("tr", "tc"), ["tr", "tc"], "left_anti").unionByName(new.select("tr", "tc", "level")))
        if made is not first:
            discard(made)
        discard(active)
        made = levels = then
    return blocks.join(levels, ["tr", "tc"]).mapInArrow(_cells, CELL)


def _beside(x: dict) -> tuple[np.ndarray, np.ndarray]:
    """Of a block's cells those of which a neighbour is missing (open), and those of which none is lower (pit)."""
    y, z = x["r"] - x["r"].min() + 1, x["c"] - x["c"].min() + 1
    dem = np.full((int(y.max()) + 2, int(z.max()) + 2), INF)
    known = np.zeros(dem.shape, bool)
    dem[y, z], known[y, z] = x["dem"], True
    missing, lower = np.zeros(len(y), bool), np.zeros(len(y), bool)
    for _, dx, dy in STEPS:
        missing |= ~known[y + dy, z + dx]
        lower |= dem[y + dy, z + dx] < x["dem"]
    return missing, ~lower


def _open(x: dict) -> np.ndarray:
    return _beside(x)[0]


def _open_pits(x: dict) -> np.ndarray:
    missing, pit = _beside(x)
    return missing & (pit | (x["structure"] > 0))


def fill_depressions(cells: DataFrame, tile: int = 256, step: float = 0.0) -> DataFrame:
    """r, c, dem, filled: the lowest level at which water leaves the grid (or a hole in it), over the whole grid. With a step
    each cell stands by it above the one it drains to, so flats drain too."""
    given = cells.select("r", "c", "dem").withColumn("structure", F.lit(0)).withColumn("outlet", F.lit(False))
    return flood(given, _open, step, tile).drop("code")


def route(cells: DataFrame, tile: int = 256, step: float = 0.001) -> DataFrame:
    """cells: r, c, dem, structure, outlet. r, c, dem, filled, code: flow directions by the flood; every cell leads to a pit at
    the edge, or to a structure there, without rising in filled."""
    return flood(cells.select("r", "c", "dem", "structure", "outlet"), _open_pits, step, tile)


def edges_of(codes: DataFrame, cols: int) -> DataFrame:
    """cell_index, down (null at code 0) of flow directions on a grid of so many columns."""
    index = lambda r, c: ((r * cols) + c).cast("long")
    r, c = F.col("r"), F.col("c")
    down = F.lit(None).cast("long")
    for k, dx, dy in STEPS:
        down = F.when(F.col("code") == 1 << k, index(r + dy, c + dx)).otherwise(down)
    return codes.select(index(r, c).alias("cell_index"), down.alias("down"))


def flood_outlets(edges: DataFrame, zones: DataFrame) -> DataFrame:
    """id, cell_index: cells by which a structure's water leaves and does not come back, by the ways of a flood. The first
    structure that a way meets below such a cell is another one or none. zones: cell_index, id."""
    own = written(zones.select("cell_index", "id"))
    edges = written(edges.select("cell_index", "down"))  # of a flood, which would be done once for each use
    roots = flow.jump(flow.until(edges, own), []).select(F.col("cell_index").alias("down"), "root")
    met = own.select(F.col("cell_index").alias("root"), F.col("id").alias("met"))
    steps = edges.join(own, "cell_index").join(roots, "down", "left").join(met, "root", "left")
    return steps.filter("met IS NULL OR met <> id").select("id", "cell_index")
