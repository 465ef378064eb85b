"""Distances, rings and lines against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from rillwork.operators import distance, rings


@pytest.mark.parametrize("radius", [None, 0, 1, 3, 7])
def test_distance_is_that_of_all_pairs(spark, radius):
    rng = random.Random(2)
    grid = [(r, c) for r in range(25) for c in range(31) if rng.random() > 0.2]
    # Some of the set lie where the grid has no cell, and beyond its edge.
    near = [(r, c) for r in range(-3, 30) for c in range(-2, 33) if rng.random() < 0.03]
    cells, targets = (spark.createDataFrame(x, "r int, c int") for x in (grid, near))
    got = {(r.r, r.c): r.d2 for r in distance.distance_to_set(cells, targets, radius).collect()}
    inside = [t for t in near if 0 <= t[0] <= 24] if radius is None else near
    want = {}
    for r, c in grid:
        d2 = min((r - a) ** 2 + (c - b) ** 2 for a, b in near)
        want[r, c] = d2 if radius is None or d2 <= radius * radius else None
    assert inside and got == want
    assert all(r.d2 is None for r in distance.distance_to_set(cells, targets.limit(0), radius).collect())
    assert distance.distance_to_set(cells.limit(0), targets, radius).count() == 0


def regions(grid):
    """Connected cells of equal values, diagonals included."""
    out = {}
    for at in sorted(grid):
        if at not in out:
            out[at], todo = at, [at]
            while todo:
                r, c = todo.pop()
                for n in ((r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                    if n not in out and grid.get(n) == grid[at]:
                        out[n] = at
                        todo.append(n)
    return out


def test_rings_enclose_their_regions(spark):
    rng = random.Random(8)
    grid = {(r, c): rng.choice([1, 1, 1, 2, 3]) for r in range(18) for c in range(14) if rng.random() > 0.05}
    label = {at: r * 14 + c for at, (r, c) in regions(grid).items()}
    table = spark.createDataFrame([(r, c, v) for (r, c), v in label.items()], "r int, c int, region long")
    corners = rings.rings(table, "region", 14).collect()
    paths = {}
    for x in sorted(corners, key=lambda x: (x.ring, x.place)):
        paths.setdefault((x.region, x.ring), []).append((x.x, x.y))
    area, outer = {}, {}
    for (region, ring), p in paths.items():
        assert all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(p, p[1:] + p[:1]))  # steps from corner to corner
        a = sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(p, p[1:] + p[:1])) / 2
        area[region] = area.get(region, 0) + a
        outer[region] = outer.get(region, 0) + (a > 0)
    sizes = {v: list(label.values()).count(v) for v in set(label.values())}
    assert area == sizes  # holes taken off
    assert set(outer.values()) == {1}  # a region has one outer ring
    assert any(len([1 for r, _ in paths if r == v]) > 1 for v in sizes)  # and some have holes
    got = rings.ring_areas(rings.rings(table, "region", 14), 14).groupBy("region").agg(F.sum("area").alias("a")).collect()
    assert {r.region: r.a for r in got} == sizes
    shapes = {r.region: r.rings for r in rings.polygons(rings.rings(table, "region", 14)).collect()}
    assert set(shapes) == set(sizes) and sum(map(len, shapes.values())) == len(paths)


def test_a_ring_of_a_whole_grid_and_none(spark):
    table = spark.range(40 * 30).select((F.col("id") / 30).cast("int").alias("r"), (F.col("id") % 30).cast("int").alias("c"), F.lit(5).cast("long").alias("region"))
    got = rings.ring_areas(rings.rings(table, "region", 30), 30).collect()
    assert [(r.region, r.n_corners, r.area) for r in got] == [(5, 4, 1200.0)]
    assert rings.ring_areas(rings.rings(table.limit(0), "region", 30), 30).count() == 0
