import random
import statistics

import pytest
from pyspark.sql import functions as F

from rillwork.operators import checks, contract, flow, raster, relations, structures, weights, zonal
from rillwork.operators import grid as grid_ops
from rillwork.streaming.readings import reading_stream, upsert, windowed_sums


def forest(n, seed):
    rng = random.Random(seed)
    return [(i, None if i == 0 or rng.random() < 0.1 else rng.randrange(i), float(rng.randint(1, 9))) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_jump_and_tree_against_loops(spark, seed):
    rows = forest(60, seed)
    down, w = {i: d for i, d, _ in rows}, {i: x for i, _, x in rows}
    table = spark.createDataFrame(rows, "cell_index long, down long, dist double")
    paths = {}
    for i in down:
        paths[i] = [i]
        while down[paths[i][-1]] is not None:
            paths[i].append(down[paths[i][-1]])
    got = {r.cell_index: r for r in flow.jump(table, ["dist"]).collect()}
    assert all((got[i].root, got[i].steps, got[i].dist) == (p[-1], len(p) - 1, sum(w[x] for x in p)) for i, p in paths.items())
    up = {r.cell_index: r for r in flow.tree(table.withColumn("one", F.lit(1).cast("long")), ["one"], "dist").collect()}
    for i in down:
        above = [p for p in paths.values() if i in p]
        assert up[i].one == len(above)
        assert up[i].longest == max(sum(w[x] for x in p[: p.index(i)]) for p in above)


def test_closure_ranks(spark):
    rows = [(i, i - 1) for i in range(1, 12)]
    got = {(r.node, r.below, r["rank"]) for r in flow.closure(spark.createDataFrame(rows, "reach long, receive long"), "reach", "receive").collect()}
    assert got == {(i, j, i - j) for i in range(1, 12) for j in range(i)}  # 0 is the terminal


def test_weights_sum_to_one(spark):
    cells = spark.createDataFrame([(i, i // 5, i % 5) for i in range(25)], "cell_index long, r int, c int")
    stations = spark.createDataFrame([(0, 1.0, 1.0), (1, 4.0, 0.0), (2, 2.0, 4.0)], "idx int, sx double, sy double")
    near = weights.nearest(cells, stations, 3, 1.0)
    assert near.count() == 75 and weights.distances(cells, stations, 2.0).filter('d2 >= 4').count() == 0
    for w in (weights.inverse_distance(near), weights.quantise(weights.inverse_distance(near)), weights.quadrant(near), weights.triangle(near)):
        assert all(abs(r.s - 1) < 1e-9 for r in w.groupBy("cell_index").agg(F.sum("weight").alias("s")).collect())
    on = {r.idx: r.weight for r in weights.inverse_distance(near).filter("cell_index = 6").collect()}
    assert on == {0: 1.0, 1: 0.0, 2: 0.0}


def test_borders(spark):
    line = spark.createDataFrame([(1, [(0.5, 0.5), (3.5, 1.5)]), (2, [(5.0, 5.0)]), (3, [(2.0, 4.0), (2.0, 1.0)])], "id long, line array<struct<x:double,y:double>>")
    got = {(r.id, r.r, r.c) for r in raster.rasterise_lines(line, 1.0).collect()}
    assert got == {(1, 0, 0), (1, 0, 1), (1, 1, 2), (1, 1, 3), (3, 4, 2), (3, 3, 2), (3, 2, 2), (3, 1, 2)}
    ring = [{"x": 0.0, "y": 0.0}, {"x": 20.0, "y": 0.0}, {"x": 20.0, "y": 20.0}, {"x": 0.0, "y": 20.0}]
    table = spark.createDataFrame([(1, ring), (2, ring)], "id long, ring array<struct<x:double,y:double>>")
    got = raster.borders(table, 10.0).collect()
    assert len(got) == 8 and all((r.id, r.owners) == (1, 2) for r in got)
    assert table.select(raster.polygon_area().alias("a")).first().a == 400.0
    assert [tuple(r) for r in raster.border_conflicts(table, 10.0).collect()] == [(1, 2, 8)]
    hole = spark.createDataFrame([(1, [[(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0)], [(3.0, 3.0), (6.0, 3.0), (6.0, 6.0), (3.0, 6.0)]])], "id long, rings array<array<struct<x:double,y:double>>>")
    for band in (2, 512):
        got = {(r.r, r.c) for r in raster.rasterise(hole, 1.0, band).collect()}
        assert len(got) == 72 and (4, 4) not in got and (0, 0) in got


def test_pivot_and_issues(spark):
    rows = spark.createDataFrame([(1, 1, 10, 1), (1, 1, 11, 2), (1, 2, 5, 1), (9, 1, 3, 1)], "k int, t int, v int, s int")
    keys = spark.createDataFrame([(1,), (2,)], "k int")
    assert sorted(map(tuple, relations.pivot_types(rows, "k", "t", "v", "s", [1, 2], keys).collect())) == [(1, 11, 5), (2, 0, 0)]


def test_stream_equals_batch(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    stream = windowed_sums(reading_stream(spark, folder))
    target, checkpoint = str(tmp_path / "t"), str(tmp_path / "c")
    upsert(stream, target, checkpoint).awaitTermination(120)
    out = {(r.start, r.event_type): r.n for r in spark.read.parquet(target).collect()}
    batch = {(r.start, r.event_type): r.n for r in windowed_sums(spark.read.parquet(f"{folder}/events.parquet")).collect()}
    assert out and set(out) <= set(batch) and all(batch[k] == n for k, n in out.items())


def test_cycles_are_errors(spark):
    table = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (3, 1, 1.0), (4, None, 1.0)], "cell_index long, down long, dist double")
    for run in (lambda: flow.jump(table, ["dist"]), lambda: flow.tree(table, ["dist"]), lambda: contract.contract(table), lambda: flow.closure(table, "cell_index", "down")):
        with pytest.raises(RuntimeError):
            run()


def test_numbers_and_neighbours_with_holes(spark):
    rng = random.Random(8)
    values = {(r, c): float(rng.randint(1, 9)) for r in range(12) for c in range(9) if rng.random() > 0.2}
    table = spark.createDataFrame([(r, c, r * 100 + c, v) for (r, c), v in values.items()], "r int, c int, cell_index long, v double")
    for row in grid_ops.neighbour_values(table, "v").collect():
        for k, dx, dy in grid_ops.STEPS:
            assert row[f"n{k}"] == values.get((row.r + dy, row.c + dx))
    got = sorted((r.v, r.cell_index, r.n) for r in grid_ops.rank_rows(table, "v", "cell_index", name="n").collect())
    assert [n for *_, n in got] == list(range(1, len(values) + 1))


def test_checks(spark):
    one = {"rows": 5, "cols": 4, "epsg": 1, "res_x": 10.2, "west": 0.0, "east": 40.0}
    assert checks.extent_findings(one, one | {"west": 5.0, "res_x": 10.9}) == [] and checks.extent_findings(one, one | {"rows": 6, "east": 99.0}) == ["rows", "east"]
    assert checks.layer_findings(["ID", "OPERATION"], "point_source", "Point", "point", 1, 2) == ["projection", "column table_name"]
    lots = spark.createDataFrame([(1, 1, 7, "3, 4", "0.5,0.5"), (2, 1, 7, "3,9", "1"), (3, 5, 0, None, None)], "id int, ani_id int, cb int, stoid string, storatio string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id int")
    got = sorted(map(tuple, checks.findings(checks.feedlot(lots, ids(3, 4), ids(7), ids(1))).collect()))
    assert got == [("feedlot of no animal", 3), ("feedlot of no storage", 2), ("feedlot storages and shares differ in number", 2)]


def test_snap_in_structures_against_all_pairs(spark):
    rng = random.Random(12)
    targets = [(rng.randrange(3), rng.randrange(200), rng.randrange(200), float(rng.randrange(4))) for _ in range(80)]
    points = [(rng.randrange(4), rng.randrange(200), rng.randrange(200)) for _ in range(60)]
    t = spark.createDataFrame(targets, "id int, r int, c int, dem double")
    p = spark.createDataFrame(points, "id int, r int, c int")

    def best(i, r, c, key):
        return min((((r - a) ** 2 + (c - b) ** 2, *key(a, b, z)) for k, a, b, z in targets if k == i), default=None)

    for radius in (2, 500):
        got = {(x.id, x.r, x.c): (x.tr, x.tc) for x in structures.snap_within(p, t, radius).collect()}
        assert got == {q: b[1:] for q in set(points) if (b := best(*q, lambda a, b, z: (a, b)))}
        got = {(x.id, x.r, x.c): (x.tr, x.tc) for x in structures.snap_to_edge(p, t, radius).collect()}
        assert got == {q: b[2:] for q in set(points) if (b := best(*q, lambda a, b, z: (z, a, b)))}


def test_medians_of_zones(spark):
    rows = [(k % 4 if k % 9 else None, float(k * 37 % 11) if k % 5 else None) for k in range(200)] + [(9, None), (8, 2.0)]
    got = {r.zone: r.median for r in zonal.zonal_stats(spark.createDataFrame(rows, "zone int, v double"), "zone", "v").collect()}
    want = {}
    for z, v in rows:
        want.setdefault(z, []).extend([v] if v is not None else [])
    assert got == {z: statistics.median(v) if v else None for z, v in want.items()}
