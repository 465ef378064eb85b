import pytest

from rillwork.engine import Engine
from rillwork.operators import raster
from rillwork.sources import config, io, schemas
from rillwork.sources.views import CELL_M, COLS, cells


def test_ascii_grid_and_store(spark, tmp_path):
    path = tmp_path / "dem.asc"
    path.write_text("ncols 3\nnrows 2\nxllcorner 0\nyllcorner 0\ncellsize 10\nNODATA_value -9999\n1 2 -9999\n4 5.5 6\n")
    grid, head = io.read_ascii_grid(spark, f"file://{path}")
    assert head["ncols"] == 3 and sorted(map(tuple, grid.collect())) == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 4.0), (1, 1, 5.5), (1, 2, 6.0)]
    store = io.pack_cells(grid.withColumnRenamed("value", "dem").selectExpr("*", "case when c = 0 then dem end as soil"), ["dem", "soil"])
    assert {r.raster: (r.n, r["min"], r["max"]) for r in io.grid_ranges(store).collect()} == {"dem": (5, 1.0, 6.0), "soil": (2, 1.0, 4.0)}


def test_text_sources(spark, tmp_path):
    (tmp_path / "lut.csv").write_text("a,b,c\n1,7,x\n2,8,y\n")
    (tmp_path / "curve.txt").write_text("storage area discharge\n1 2 3\n 4.5  5 6 \n")
    (tmp_path / "points.tsv").write_text("1\tPOINT (1.5 -2)\n2\tLINESTRING (0 0, 1 1)\n")
    assert sorted(map(tuple, io.read_lookup(spark, str(tmp_path / "lut.csv")).collect())) == [(1, 7), (2, 8)]
    assert sorted(map(tuple, io.read_rating_curve(spark, str(tmp_path / "curve.txt")).collect())) == [(1.0, 2.0, 3.0), (4.5, 5.0, 6.0)]
    assert list(map(tuple, io.read_points(spark, str(tmp_path / "points.tsv")).collect())) == [(1, 1.5, -2.0)]
    assert {r.source for r in io.read_named_files(spark, str(tmp_path / "lut.csv"), "a int, b int, c string").collect()} == {"lut"}


def test_config():
    p = config.load("[rasters]\ndem = d.asc\nsoil =\n[options]\nreuse = Yes\nids = 1, 2\n", "x")
    assert p.rasters == {"dem": "d.asc"} and p.flag("reuse") and p.numbers("ids") == [1, 2] and config.missing(p) == ["soil", "landuse"]
    assert config.load(config.template(), "y").rasters == {}
    with pytest.raises(ValueError):
        config.load("[other]\na = 1\n", "z")


def test_tables_and_engine(spark, tmp_path):
    engine = Engine(spark, cells(spark, "/root/testdata/sf0.001"), CELL_M, COLS)
    assert engine["overlay"].count() == engine["overlay"].select("row_id").distinct().count()
    assert engine["watershed"].count() == engine.cells.count() and engine["flow_edges"] is engine["flow_edges"]
    assert schemas.same_columns(spark.createDataFrame([(1, 2)], "B int, a int"), ["A", "b"])
    df = spark.createDataFrame([(1, "x"), (0, "y"), (-3, "z")], "k int, v string")
    assert io.first_value(df, "v", "x", "k") == 1 and io.first_value(df, "v", "none", "k") is None
    assert [r[0] for r in df.select(io.positive("k")).collect()] == [1, None, None]
    io.station_lines(df, str(tmp_path / "lines"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "lines")).collect()) == ["-3|z", "0|y", "1|x"]


def test_more_sources_and_sinks(spark, tmp_path):
    (tmp_path / "shapes.tsv").write_text("1\tPOLYGON ((0 0, 4 0, 4 3, 0 0))\n2\tLINESTRING (0 0, 1 1.5)\n")
    ring = io.read_polygons(spark, str(tmp_path / "shapes.tsv")).first()
    assert ring.id == 1 and [tuple(p) for p in ring.ring] == [(0, 0), (4, 0), (4, 3), (0, 0)]
    assert [tuple(p) for p in io.read_lines(spark, str(tmp_path / "shapes.tsv")).first().line] == [(0, 0), (1, 1.5)]
    (tmp_path / "soil.csv").write_text("a,b\n1,2\n")
    (tmp_path / "own.csv").write_text("a,b\n3,4\n5,6\n")
    assert io.default_table(spark, str(tmp_path), "soil").count() == 1 and io.default_table(spark, str(tmp_path), "soil", {"soil": str(tmp_path / "own.csv")}).count() == 2
    assert {r.period for r in io.year_lookups(spark, str(tmp_path / "soil.csv"), str(tmp_path / "own.csv")).collect()} == {"before", "after"}
    w = spark.createDataFrame([("P", 1, 0, 0.5), ("P", 1, 1, 0.5), ("T", 1, 0, 1.0)], "type string, cell_index long, idx int, weight double")
    io.save_weights(io.duplicate(w, "P", "PET"), str(tmp_path / "w"))
    store = spark.read.parquet(str(tmp_path / "w"))
    assert store.count() == 5 and io.station_weights(store, "PET", 1).collect() == [(1, 0.5)]
    io.save_csv(w, str(tmp_path / "csv"))
    io.save_vector(w, str(tmp_path / "vec"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == spark.read.parquet(str(tmp_path / "vec")).count() == 3
    io.model_files(spark, str(tmp_path), ["a", "b"])
    assert [r.value for r in spark.read.text(f"{tmp_path}/config.fig").collect()] == ["a", "b"] and spark.read.text(f"{tmp_path}/file.out").first().value == "OUTPUTTYPE | 1"
    assert io.json_rows(w, "type", "idx").first().json == '{"type":"P","idx":0}'


def test_catalogue_tables(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS rill_t LOCATION '{tmp_path}/db'")
    io.create_tables(spark, "rill_t")
    assert io.table_exists(spark, "rill_t.reach") and not io.table_exists(spark, "rill_t.none")
    io.insert_rows(spark, [{"reach": 1, "receive": 0}, {"reach": 2, "elevation": 3.5}], "rill_t.reach")
    assert sorted(map(tuple, spark.table("rill_t.reach").collect()), key=str) == [(1, 0, None, None), (2, None, None, 3.5)]
    assert io.save_table(spark.createDataFrame([(1,)], "a int"), "rill_t.x") and not io.save_table(spark.createDataFrame([], "a int"), "rill_t.x")
    spark.sql("DROP DATABASE rill_t CASCADE")


def test_whole_run(spark, tmp_path):
    c = cells(spark, "/root/testdata/sf0.001").drop("acc", "is_stream", "subbasin")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS rill_e LOCATION '{tmp_path}/db'")
    inventory = c.selectExpr("2001 as year", "field", "landuse as code", "cell_index")
    engine = Engine(spark, c, CELL_M, COLS, stream_ha=0.04, inventory=inventory, pour_points={"outlets": spark.createDataFrame([(7,)], "cell_index long")})
    engine.run("rill_e", str(tmp_path / "model"), ["x"])
    reaches = spark.table("rill_e.reach_parameter")
    assert reaches.count() == spark.table("rill_e.subbasins").select("subbasin").distinct().count() > 100 and len(reaches.columns) == 15 + 34
    lines = [r.value for r in spark.read.text(str(tmp_path / "model/reachParameter.txt")).collect()]
    assert lines[0] == str(reaches.count()) and lines[1] == "49" and lines[2].startswith("#reach_id\tsubbasin_id") and lines[3].startswith("1\t1\t1\t")
    lookup = {(r.node, r.below) for r in spark.table("rill_e.reach_lookup").collect()}
    assert {r.reach_id for r in reaches.collect()} == {n for n, b in lookup if b == 0}
    spark.sql("DROP DATABASE rill_e CASCADE")


def test_only_what_changed_is_built(spark, tmp_path):
    c = cells(spark, "/root/testdata/sf0.001").drop("acc", "is_stream", "subbasin")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS rill_u LOCATION '{tmp_path}/db'")
    point = spark.createDataFrame([(1, 7, None, "t"), (2, 900, "2001-02-03", "u")], "id long, cell_index long, operation string, table_name string")
    features = {
        "point_source": point,
        "feedlot": spark.createDataFrame([(5, 1, 10, None, None, None, None)], "id long, ani_id long, cb int, adult int, nonadult int, stoid string, storatio string"),
        "livestock": spark.createDataFrame([(1, 3)], "ID long, Man_ID long"),
    }

    def run(table, **more):
        engine = Engine(spark, table, CELL_M, COLS, stream_ha=0.04, features=features | more)
        return engine.run("rill_u", str(tmp_path / "model"))

    first = run(c)
    assert {"acc", "reach_lookup", "point_source", "manure_feedlot", "reach_bmp"} <= set(first) and "reservoir" not in first
    assert first.index("flow_edges") < first.index("acc") < first.index("subbasins") < first.index("reach_parameter") < first.index("reach_bmp")
    assert spark.table("rill_u.reach_bmp").columns == ["subbasin", "point_source"] and spark.table("rill_u.point_source").count() == 2
    assert run(c) == []
    # A changed land use rebuilds what is made of it alone, a new point source its own dependents.
    assert run(c.selectExpr("* except (landuse)", "if(cell_index = 3, 4 - landuse, landuse) as landuse")) == ["dominant_landuse"]
    moved = point.selectExpr("id", "cell_index + 1 as cell_index", "operation", "table_name")
    assert run(c.selectExpr("* except (landuse)", "if(cell_index = 3, 4 - landuse, landuse) as landuse"), point_source=moved) == ["point_source", "reach_bmp"]
    spark.sql("DROP DATABASE rill_u CASCADE")


def test_polygons_keep_their_holes(spark, tmp_path):
    (tmp_path / "shapes.tsv").write_text(
        "1\tPOLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (3 3, 6 3, 6 6, 3 6, 3 3))\n2\tMULTIPOLYGON (((20 0, 22 0, 22 2, 20 2)), ((30 0, 33 0, 33 3, 30 3), (31 1, 32 1, 32 2, 31 2)))\n3\tPOINT (1 1)\n"
    )
    shapes = io.read_polygons(spark, str(tmp_path / "shapes.tsv"))
    assert sorted((r.id, len(r.rings)) for r in shapes.collect()) == [(1, 2), (2, 1), (2, 2)]
    cells_of = raster.rasterise(shapes, 1.0).groupBy("id").count().collect()
    assert {r.id: r["count"] for r in cells_of} == {1: 72, 2: 4 + 8}


def test_windows_of_a_grid_store(spark, tmp_path, capsys):
    c = cells(spark, "/root/testdata/sf0.001")
    io.save_grid(c.select("r", "c", "dem", "soil", "texture"), str(tmp_path / "grid"), 4)
    own = io.read_window(spark, str(tmp_path / "grid"), ["dem"], (3, 10, 6, 40), 4)
    want = c.filter("r between 3 and 6 and c between 10 and 40").select("r", "c", "dem")
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, want.collect())) and own.count() == 4 * 31
    own.explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(band" in plan and "GreaterThanOrEqual(r,3)" in plan and "LessThanOrEqual(c,40)" in plan
    assert "ReadSchema: struct<r:int,c:int,dem:" in plan and "soil" not in plan
    assert io.read_window(spark, str(tmp_path / "grid"), ["soil"], band=4).count() == c.count()


def test_a_raster_is_a_table_or_a_file(spark, tmp_path):
    (tmp_path / "dem.asc").write_text("ncols 1\nnrows 1\nxllcorner 0\nyllcorner 0\ncellsize 10\nNODATA_value -9999\n7\n")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS rill_r LOCATION '{tmp_path}/db'")
    io.save_table(spark.createDataFrame([(0, 0, 3.0)], "r int, c int, value double"), "rill_r.DEM")
    assert io.raster(spark, "rill_r", "Dem", "nowhere").first().value == 3.0
    assert io.raster(spark, "rill_r", "soil", f"file://{tmp_path}/dem.asc").first().value == 7.0
    with pytest.raises(LookupError):
        io.raster(spark, "rill_none", "soil")
    spark.sql("DROP DATABASE rill_r CASCADE")
