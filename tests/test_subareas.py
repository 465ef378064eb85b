"""Buffers, travel times, subareas and tile drains against plain walks on small grids."""

import math
import random

import pytest

from rillwork.functions import hydrology as H
from rillwork.operators import buffers, grid, subarea

ROWS, COLS, M = 24, 24, 10.0


@pytest.fixture(scope="module")
def valley(spark):
    """A tilted valley with a little noise, so that ways are long; two buffers side by side, a third over an end of the grid."""
    rng = random.Random(4)
    rows = []
    for r in range(ROWS):
        for c in range(COLS):
            dem = 200.0 - 3.0 * r + abs(c - 11) * 2.0 + rng.random()
            zone = 1 if 6 <= r < 9 else 2 if 9 <= r < 12 else 3 if r >= 22 else None
            rows.append((r * COLS + c, r, c, dem, zone, r // 8 + 1, c // 6 + 1, float(rng.randint(1, 9))))
    cells = spark.createDataFrame(rows, "cell_index long, r int, c int, dem double, zone int, subbasin int, field int, slope_deg double").cache()
    edges = grid.flow_edges(cells, M, COLS).cache()
    down = {e.cell_index: (e.down, e.dist) for e in edges.collect()}
    return cells, edges, rows, down


def walked(rows, down):
    """Each cell's first exit, as (exit, inside, length)."""
    zone = {x[0]: x[4] for x in rows}
    out = {}
    for at in zone:
        i, length = at, 0.0
        while True:
            to, dist = down[i]
            if to is None:
                break
            length += dist if zone[i] is not None else 0.0
            if zone[i] is not None and (zone[to] != zone[i] or down[to][0] is None):
                out[at] = (i, zone[at] is not None, length)
                break
            i = to
    return out


def test_buffer_parts_are_the_first_exits_of_walks(valley):
    cells, edges, rows, down = valley
    want = walked(rows, down)
    got = {x.cell_index: (x.exit_cell, x.inside, x.length) for x in buffers.buffer_parts(cells, edges, "zone").collect()}
    assert got.keys() == want.keys() and len(want) > 200
    assert all(got[k][:2] == want[k][:2] and math.isclose(got[k][2], want[k][2], abs_tol=1e-6) for k in want)
    assert any(length > 3 * M for _, _, length in want.values())


def test_buffer_table(valley):
    cells, edges, rows, down = valley
    want = walked(rows, down)
    parts = buffers.numbered(buffers.buffer_parts(cells, edges, "zone"))
    got = buffers.buffer_table(parts, cells, "zone", 30.0, 0.01, {"slope_deg": "slope"}).orderBy("id").collect()
    zone, slope = {x[0]: x[4] for x in rows}, {x[0]: x[7] for x in rows}
    ends = sorted({e for e, _, _ in want.values()})
    assert [x.id for x in got] == list(range(1, len(ends) + 1))
    for x, end in zip(got, ends):
        own = [k for k, v in want.items() if v[0] == end]
        inner = [k for k in own if want[k][1]]
        assert x.zone_id == zone[end] and math.isclose(x.drainage_area, len(own) * 0.01, abs_tol=1e-9)
        assert math.isclose(x.length, max(want[k][2] for k in inner), abs_tol=1e-6)
        assert math.isclose(x.area_ratio, x.drainage_area / (x.length * 30 * 0.0001))
        assert math.isclose(x.slope, sum(slope[k] for k in inner) / len(inner), abs_tol=1e-9)


def test_no_buffers_and_no_cells(valley):
    cells, edges, _, _ = valley
    none = cells.withColumn("zone", grid.F.lit(None).cast("int"))
    assert buffers.buffer_parts(none, edges, "zone").count() == 0
    assert buffers.numbered(buffers.buffer_parts(cells.limit(0), edges, "zone")).count() == 0


def test_cells_outside_end_the_ways(valley):
    """Edges may lead to cells that aren't given: water then leaves the grid there, and no cell is lost."""
    cells, edges, rows, down = valley
    some = cells.filter("r < 15")
    steps = buffers.within(edges, some, "zone").collect()
    assert len(steps) == 15 * COLS
    assert {x.down for x in steps} <= {x[0] for x in rows if x[1] < 15} | {None}


def test_travel_times_are_sums_to_the_stream(valley):
    cells, edges, rows, down = valley
    F = grid.F
    given = cells.select("cell_index", F.col("slope_deg").alias("slope"), F.lit(0.1).alias("manning"), (F.col("c") == 11).alias("is_stream"), (F.col("r") + 1).alias("acc"))
    got = {x.cell_index: x for x in subarea.travel_times(given, edges, M, {2: H.DEPTH[2], 100: H.DEPTH[100]}).collect()}
    assert len(got) == len(rows)
    for period in (2, 100):
        a, b = H.DEPTH[period]
        t, d = {}, {}
        for i, r, *_, s in rows:
            s, rad = max(s / 100, 0.001), a * ((r + 1) * 1e-4) ** b
            v = max(min(rad ** (2 / 3) * s**0.5 / 0.1, 3.0), 0.005)
            cel = v * 5 / 3
            t[i], d[i] = 1 / cel, 2 * (v * rad / (2 * s)) / cel**3
        for i, r, c, *_ in rows:
            at, total, spread = i, t[i], d[i]
            while at % COLS != 11 and down[at][0] is not None:
                at = down[at][0]
                total, spread = total + t[at], spread + d[at]
            assert math.isclose(got[i][f"t_{period}"], total * M / 3600, rel_tol=1e-9)
            assert math.isclose(got[i][f"sd_{period}"], spread**0.5 * M**0.5 / 3600, rel_tol=1e-9)


def test_structures_of_subareas(spark):
    """Subarea 1 has four cells, of which a structure covers one; totals count cells outside too. No structure: no row."""
    rows = [(1, 7, None), (1, None, None), (1, None, 9), (1, None, None), (2, 7, 9), (2, 7, None)]
    cells = spark.createDataFrame(rows, "subarea int, pond int, ditch int")
    got = {(x.kind, x.subarea, x.location): (x.area_ha, x.fraction_to_subarea, x.fraction_to_bmp) for x in subarea.structure_lookups(cells, ["pond", "ditch"], 0.5).collect()}
    assert got == {
        ("pond", 1, 7): (0.5, 0.25, 1 / 3), ("pond", 2, 7): (1.0, 1.0, 2 / 3), ("ditch", 1, 9): (0.5, 0.25, 0.5), ("ditch", 2, 9): (0.5, 0.5, 0.5),
    }
    assert subarea.structure_lookups(cells.limit(0), ["pond"], 0.5).count() == 0


def test_tile_drains_search_outlets_then_area_then_the_last_reach(spark):
    """Reaches 1 -> 2 -> 3 -> 0, 4 -> 5 -> 0 and 6 -> 0. Drain 10 meets an outlet below, 20 has none and takes the first
    reach of 10 ha, 30 finds neither, 40 has no cells, 50 spans two subbasins of which the lower one counts."""
    reaches = spark.createDataFrame([(1, 2, 99.0), (2, 3, 1.0), (3, 0, 1.0), (4, 5, 1.0), (5, 0, 10.0), (6, 0, 2.0)], "reach int, receive int, contribution_ha double")
    cells = [(1, 10, 1, 5.0, 8), (2, 10, 1, 6.0, 8), (3, 10, 1, 6.0, 9), (4, 20, 4, 3.0, 9), (5, 30, 6, 3.0, 9), (6, 50, 6, 9.0, 7), (7, 50, 4, 2.0, 7), (8, None, 2, 1.0, 7)]
    grid_cells = spark.createDataFrame(cells, "cell_index long, drain int, subbasin int, dem double, field int")
    features = spark.createDataFrame([(10,), (20,), (30,), (40,), (50,)], "id long")
    outlets = spark.createDataFrame([(3,)], "subbasin int")
    made = subarea.tile_drains(features, grid_cells, "drain", outlets, reaches, 10.0)
    assert {x.id: (x.field, x.subbasin, x.reach) for x in made.collect()} == {10: (8, 1, 3), 20: (9, 4, 5), 30: (9, 6, 6), 50: (7, 4, 5)}
    assert [tuple(x) for x in subarea.outlet_drainage(made).orderBy("id").collect()] == [(1, 3, 3800.0), (2, 5, 3800.0), (3, 6, 3800.0)]
    none = subarea.tile_drains(features, grid_cells, "drain", outlets.limit(0), reaches, 10.0)
    assert {x.id: x.reach for x in none.collect()} == {10: 1, 20: 5, 30: 6, 50: 5}
