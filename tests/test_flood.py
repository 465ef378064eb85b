"""Floods over tiles against a flood of the whole grid by one heap."""

import heapq
import random

import numpy as np
import pytest

from rillwork.operators import flood

SIDES = {1: (1, -1), 2: (1, 0), 4: (1, 1), 8: (0, 1), 16: (-1, 1), 32: (-1, 0), 64: (-1, -1), 128: (0, -1)}


def whole(grid, zones, outlets, seeds, step):
    """Level and pointer code of every cell that the flood reaches."""
    level = {}
    heap = sorted((grid[at], at) for at in seeds)

    def may(u, v):
        return not zones.get(v) or zones.get(v) == zones.get(u) or v in outlets

    while heap:
        low, at = heapq.heappop(heap)
        if at in level:
            continue
        level[at] = low
        for dx, dy in SIDES.values():
            v = (at[0] + dy, at[1] + dx)
            if v in grid and v not in level and may(at, v):
                heapq.heappush(heap, (low + step if v in outlets else max(grid[v], low + step), v))
    code = {}
    for v in level:
        ways = [(level[u], u, k) for k, (dx, dy) in SIDES.items() if (u := (v[0] + dy, v[1] + dx)) in level and may(u, v)]
        code[v] = 0 if v in seeds and level[v] == grid[v] else min(ways)[2]
    return level, code


def beside(grid, at):
    return [grid.get((at[0] + dy, at[1] + dx)) for dx, dy in SIDES.values()]


def rough(seed, rows=23, cols=19):
    rng = random.Random(seed)
    grid = {(r, c): float(rng.randint(1, 40)) for r in range(rows) for c in range(cols) if rng.random() > 0.03}
    return grid | {(r, c): 2.0 for r in range(6, 17) for c in range(5, 15) if (r, c) in grid}  # a hollow over several tiles


@pytest.mark.parametrize("step", [0.0, 0.5])
def test_fill_is_that_of_the_whole_grid(spark, step):
    grid = rough(6)
    level, _ = whole(grid, {}, set(), {at for at in grid if None in beside(grid, at)}, step)
    table = spark.createDataFrame([(r, c, z) for (r, c), z in grid.items()], "r int, c int, dem double")
    for tile in (4, 7, 64):
        got = {(r.r, r.c): r.filled for r in flood.fill_depressions(table, tile, step).collect()}
        assert got == level
    if step:
        for at, z in got.items():
            assert None in beside(grid, at) or min(beside(got, at)) < z  # flats drain


@pytest.mark.parametrize("tile", [3, 5, 8, 64])
def test_route_through_structures(spark, tile):
    grid = rough(9)
    zones = {(r, c): 1 + (r // 6) * 4 + c // 6 for r, c in grid if r % 6 < 4 and c % 6 < 3}  # structures across tiles
    zones |= {(r, c): 99 for r in range(8, 15) for c in range(13, 18) if (r, c) in grid}
    outlets = {min((at for at in zones if zones[at] == i), key=lambda at: (grid[at], at)) for i in set(zones.values())}
    outlets |= {max(at for at in zones if zones[at] == 99)}  # one has two
    pits = {at for at in grid if None in (s := beside(grid, at)) and not any(z is not None and z < grid[at] for z in s)}
    seeds = pits | {at for at in zones if None in beside(grid, at)}
    level, code = whole(grid, zones, outlets, seeds, 0.001)
    rows = [(r, c, z, zones.get((r, c)), (r, c) in outlets) for (r, c), z in grid.items()]
    table = spark.createDataFrame(rows, "r int, c int, dem double, structure long, outlet boolean")
    got = flood.route(table, tile).collect()
    assert {(r.r, r.c): r.filled for r in got if r.filled is not None} == level
    assert {(r.r, r.c): r.code for r in got if r.filled is not None} == code
    assert len(got) == len(grid)
    # No way leaves a structure but by an outlet.
    for r in got:
        at = (r.r, r.c)
        if r.code:
            dx, dy = SIDES[r.code]
            down = (r.r + dy, r.c + dx)
            assert zones.get(at) in (None, zones.get(down)) or at in outlets


def test_outlets_are_crossings_that_do_not_come_back(spark):
    """A row of cells draining west: structure 5 at 6-7 and 3, a crossing between that comes back; structure 4 further down."""
    edges = spark.createDataFrame([(i, i - 1 if i else None) for i in range(10)], "cell_index long, down long")
    zones = spark.createDataFrame([(7, 5), (6, 5), (3, 5), (1, 4), (0, 4)], "cell_index long, id long")
    got = {(r.id, r.cell_index) for r in flood.flood_outlets(edges, zones).collect()}
    assert got == {(5, 3), (4, 0)}


def test_floods_without_cells_or_ways(spark):
    kind = "r int, c int, dem double, structure long, outlet boolean"
    assert flood.route(spark.createDataFrame([], kind)).count() == 0
    one = spark.createDataFrame([(0, 0, 3.0, None, None), (0, 1, None, None, None)], kind)
    assert [tuple(r) for r in flood.route(one).collect()] == [(0, 0, 3.0, 3.0, 0)]
    # A structure without an outlet and away from the edge is never entered.
    shut = [(r, c, 1.0, 1 if (r, c) == (2, 2) else None, False) for r in range(5) for c in range(5)]
    got = {(r.r, r.c): r.filled for r in flood.route(spark.createDataFrame(shut, kind), 2).collect()}
    assert got[2, 2] is None and sum(v is None for v in got.values()) == 1


def one_tile(grid, zones, outlets, seeds):
    at = sorted(grid)
    pick = lambda f, kind: np.array([f(x) for x in at], kind)
    given = {"r": pick(lambda x: x[0], np.int32), "c": pick(lambda x: x[1], np.int32), "dem": pick(grid.get, float), "around": None}
    given |= {"structure": pick(lambda x: zones.get(x, 0), np.int64), "outlet": pick(outlets.__contains__, bool), "seed": pick(seeds.__contains__, bool)}
    return at, flood.Tile(given)


def test_a_tile_is_flooded_in_sweeps_and_not_cell_by_cell(monkeypatch):
    """Rough ground of 64 x 64 cells, with structures too, takes no heap; ways that wind through all of a tile end in one."""
    rng = random.Random(3)
    grid = {(r, c): float(rng.randint(1, 400)) for r in range(64) for c in range(64)}
    zones = {(r, c): 1 + (r // 16) * 4 + c // 16 for r, c in grid if 3 < r % 16 < 9 and 2 < c % 16 < 12}
    outlets = {min((at for at in zones if zones[at] == i), key=lambda at: (grid[at], at)) for i in set(zones.values())}
    seeds = {at for at in grid if None in beside(grid, at)}
    calls, heap = [], flood.Tile._from_heap
    monkeypatch.setattr(flood.Tile, "_from_heap", lambda self, *a: (calls.append(1), heap(self, *a)))
    for structures in ({}, zones):
        level, code = whole(grid, structures, outlets if structures else set(), seeds, 0.001)
        at, t = one_tile(grid, structures, outlets if structures else set(), seeds)
        t.flood(0.001)
        assert {x: z for x, z in zip(at, t.level[t.at].tolist()) if z < flood.INF} == level and not calls
        assert {x: k for x, k in zip(at, t.codes().tolist()) if x in level} == code
    # A way of one cell's width to and fro between walls.
    maze = {(r, c): 1.0 if r % 2 == 0 or c == (0 if r % 4 == 1 else 60) else 900.0 for r in range(61) for c in range(61)}
    level, code = whole(maze, {}, set(), {(0, 0)}, 0.001)
    at, t = one_tile(maze, {}, set(), {(0, 0)})
    t.flood(0.001)
    assert calls and dict(zip(at, t.level[t.at].tolist())) == level
    assert dict(zip(at, t.codes().tolist())) == code


def winding(rows, cols):
    """A way of one cell's width to and fro between walls."""
    return {(r, c): 1.0 if r % 2 == 0 or c == (1 if r % 4 == 1 else cols - 2) else 900.0 for r in range(rows) for c in range(cols)}


@pytest.mark.parametrize("tile, tables", [(8, 2), (3, None)])
def test_rounds_are_those_between_blocks(spark, monkeypatch, tile, tables):
    """A way through all tiles of one block takes no rounds: the blocks are written, and what goes to others, which is nothing."""
    grid = winding(31, 31)
    calls, write = [], flood.written
    monkeypatch.setattr(flood, "written", lambda df: (calls.append(1), write(df))[1])
    table = spark.createDataFrame([(r, c, z, None, None) for (r, c), z in grid.items()], "r int, c int, dem double, structure long, outlet boolean")
    pits = {at for at in grid if None in (s := beside(grid, at)) and not any(z is not None and z < grid[at] for z in s)}
    level, code = whole(grid, {}, set(), pits, 0.001)
    got = flood.route(table, tile).collect()
    assert {(r.r, r.c): (r.filled, r.code) for r in got} == {at: (level[at], code[at]) for at in grid}
    assert tables is None or len(calls) == tables


@pytest.mark.parametrize("sweeps", [1, 8])
def test_tiles_of_a_block_hand_on_what_falls(monkeypatch, sweeps):
    """Also where the heap takes over after sweeps that let cells beside another tile fall."""
    monkeypatch.setattr(flood, "SWEEPS", sweeps)
    for grid in (winding(31, 31), rough(4, 31, 29)):
        zones = {(r, c): 1 + (r // 9) * 4 + c // 9 for r, c in grid if r % 9 < 4 and c % 9 < 5}
        outlets = {min((at for at in zones if zones[at] == i), key=lambda at: (grid[at], at)) for i in set(zones.values())}
        seeds = {at for at in grid if None in beside(grid, at)}
        for structures, out in (({}, set()), (zones, outlets)):
            level, code = whole(grid, structures, out, seeds, 0.001)
            at, t = one_tile(grid, structures, out, seeds)
            t.flood(0.001, 4)
            assert {x: z for x, z in zip(at, t.level[t.at].tolist()) if z < flood.INF} == level
            assert {x: k for x, k in zip(at, t.codes().tolist()) if x in level} == code


def test_outlets_read_the_flood_once(spark):
    """The ways are a flood's, which would be done anew for each use of them."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    kind = "cell_index long, down long"
    edges = spark.createDataFrame([(i, i - 1 if i else None) for i in range(10)], kind).mapInArrow(counted, kind)
    zones = spark.createDataFrame([(7, 5), (6, 5), (3, 5), (1, 4), (0, 4)], "cell_index long, id long")
    got = {(r.id, r.cell_index) for r in flood.flood_outlets(edges, zones).collect()}
    assert got == {(5, 3), (4, 0)} and seen.value == 10
