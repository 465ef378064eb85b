"""Neighbours in squares against a plain look beside each cell."""

import random

import pytest

from rillwork.operators import grid


@pytest.mark.parametrize("side", [4, 256])
def test_neighbours_across_squares(spark, monkeypatch, side):
    monkeypatch.setattr(grid, "SQUARE", side)
    rng = random.Random(1)
    cells = {(r, c): (rng.choice([None, 1, 2, 3]), f"{r}/{c}") for r in range(-6, 11) for c in range(9) if rng.random() > 0.2}
    table = spark.createDataFrame([(r, c, *v, r * 100 + c) for (r, c), v in cells.items()], "r int, c int, v int, w string, key long")
    got = {(x.r, x.c): x for x in grid.neighbour_values(table, "v", "w").collect()}
    assert set(got) == set(cells)
    for (r, c), x in got.items():
        assert x.key == r * 100 + c
        for k, dx, dy in grid.STEPS:
            assert (x[f"n{k}"], x[f"i{k}"]) == cells.get((r + dy, c + dx), (None, None))


def test_neighbours_are_no_copies_of_all_cells(spark):
    """Cells are dealt to about one square each, where three rows for each cell were shuffled, and no window is used."""
    table = spark.range(512 * 128).selectExpr("CAST(id DIV 128 AS INT) r", "CAST(id % 128 AS INT) c", "CAST(id AS DOUBLE) v")
    made = grid.neighbour_values(table, "v")
    assert made.count() == 512 * 128
    assert "Window" not in made._jdf.queryExecution().executedPlan().toString()


def test_cells_without_a_place_have_no_neighbours(spark):
    table = spark.createDataFrame([(None, 1, 5.0), (0, None, 6.0), (0, 0, 7.0), (0, 1, 8.0)], "r int, c int, v double")
    got = {x.v: [x[f"n{k}"] for k in range(8)] for x in grid.neighbour_values(table, "v").collect()}
    assert got[5.0] == got[6.0] == [None] * 8
    assert got[7.0] == [None, 8.0, *[None] * 6] and got[8.0] == [None] * 5 + [7.0, None, None]
