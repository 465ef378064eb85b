"""What ways bring from their roots, and what they keep of their cells, across blocks."""

import random

import pytest

from rillwork.operators import buffers, delineation, flow


@pytest.mark.parametrize("block", [8, 1 << 16])
def test_subbasins_are_the_outlets_numbers(spark, monkeypatch, block):
    monkeypatch.setattr(flow, "BLOCK", block)
    rng = random.Random(2)
    down = {i: rng.randrange(i) if i and rng.random() > 0.1 else None for i in range(120)}
    points = {i for i in down if rng.random() < 0.2} | {500}  # one that is no cell
    edges = spark.createDataFrame(list(down.items()), "cell_index long, down long")
    at = spark.createDataFrame([(p,) for p in points], "cell_index long")

    def outlet(i):
        while i is not None and i not in points:
            i = down[i]
        return i

    want = {i: outlet(i) for i in down}
    ids = {p: k for k, p in enumerate(sorted(points - {500}), 1)}
    sheds = delineation.watersheds(edges, at)
    assert {x.cell_index: x.outlet for x in sheds.collect()} == want
    got = delineation.subbasins(edges, at)
    assert {(x.cell_index, x.outlet, x.subbasin) for x in got.collect()} == {(i, p, ids[p]) for i, p in want.items() if p is not None}
    old = delineation.number_subbasins(sheds).select(*got.columns)
    assert got.schema["subbasin"].dataType == old.schema["subbasin"].dataType and sorted(got.collect()) == sorted(old.collect())


def test_ways_are_not_joined_with_their_roots_again(spark):
    """Exits of buffers and outlets come along the ways: no join after the last one of the ways' own."""
    edges = spark.createDataFrame([(i, i - 1 if i else None, 10.0) for i in range(9)], "cell_index long, down long, dist double")
    cells = spark.createDataFrame([(i, 1 if i in (4, 5, 7) else None) for i in range(9)], "cell_index long, zone int")
    parts = buffers.buffer_parts(cells, edges, "zone")
    assert "Join" not in parts._jdf.queryExecution().analyzed().toString()
    assert {(x.cell_index, x.exit_cell, x.inside, x.length) for x in parts.collect()} == {(4, 4, True, 10.0), (5, 4, True, 20.0), (6, 4, False, 20.0), (7, 7, True, 10.0), (8, 7, False, 10.0)}
    sheds = delineation.watersheds(edges, cells.filter("zone = 1"))
    assert "Join" not in sheds._jdf.queryExecution().analyzed().toString()
