import datetime as dt

import pytest

from rillwork.operators import checks, subarea, weights
from rillwork.sources import io, project

SCENARIO = """
[model]
model_folder = /m
[scenario]
name = base
model_type =
start_date = 2001/02/03
[climate_station]
P = 3, 1
T = 2
[climate_interpolation]
method = thiessen
"""


def test_model_file():
    text = "[DEFAULT]\nsoil_lookup = s.csv\n[watershed]\ndem_raster = 100%.tif\nsoil_raster =\n[delineation]\nuse_all_pour_points_from_stream_threshold = Yes\n[pasture_crop_land]\npasture_crop_land_landuse_ids = 4, 9\n[else]\na = 1\n"
    m = project.Model.load(text)
    assert m.inputs("raster") == {"dem": "100%.tif"} and m.inputs("lookup") == {"soil": "s.csv"}
    assert m.flag("delineation.use_all_pour_points_from_stream_threshold") and not m.flag("marginal_crop_land.marginal_crop_land_simulation")
    assert m.numbers("pasture_crop_land.pasture_crop_land_landuse_ids") == [4, 9] and m.numbers("pasture_crop_land.none") == []
    assert m.findings() == ["model.model_folder is required", "watershed.soil_raster is required", "watershed.landuse_raster is required"]
    assert project.Model.load("").values == {} and project.Model.load(project.template(project.MODEL)).values == {}


def test_scenario_file():
    s = project.Scenario.load(SCENARIO)
    assert (s.model_type, s.interval, s.radius, s.method) == ("cell", "daily", 10_000_000, "thiessen")
    assert s.stations == {"P": [3, 1], "TMAX": [2], "TMIN": [2]} and s.start == dt.date(2001, 2, 3) and s.end is None
    held = {"P": [1, 3], "TMAX": [2], "TMIN": [2], "RM": [1]}
    done = s.resolved(held, dt.date(2000, 1, 1), dt.date(2002, 1, 1))
    assert done.end == dt.date(2002, 1, 1) and done.stations == s.stations
    lines = done.file_in(10.0, 500, -1, 7)
    assert lines[:5] == ["VERSIONTYPE|0", "ISPREPAREFORSUBAREAINPUT|0", "CELLSIZE|10.0", "CELLNUMBER|500", "SUBAREANUMBER|-1"]
    assert lines[5:12] == ["SUBBASINCOUNT|7", "INTERVAL|daily", "STARTTIME|2001/02/03", "ENDTIME|2002/01/01", "SITECOUNT|2|P", "SITENAME|3|P", "SITENAME|1|P"]
    with pytest.raises(ValueError, match="TMAX 2, TMIN 2"):
        s.resolved({"P": [1, 3]}, dt.date(2000, 1, 1), dt.date(2002, 1, 1))
    with pytest.raises(ValueError, match="span"):
        s.resolved(held, dt.date(2001, 3, 1), dt.date(2002, 1, 1))
    for bad in ("1,,2", "1,x"):
        with pytest.raises(ValueError, match="whole numbers"):
            project.Scenario.load(SCENARIO.replace("3, 1", bad))
    with pytest.raises(ValueError, match="scenario.name"):
        project.Scenario.load("[model]\nmodel_folder = /m\n")
    free = project.Scenario.load("[model]\nmodel_folder = /m\n[scenario]\nname = a\nmodel_type = subarea\n").resolved(held, dt.date(2000, 1, 1), dt.date(2002, 1, 1))
    assert free.stations == held and "CELLNUMBER|-1" in free.file_in(10.0, 500, 40, 7) and "SUBAREANUMBER|40" in free.file_in(10.0, 500, 40, 7)


def test_input_file_keeps_the_order(spark, tmp_path):
    lines = [f"L{i}|x" for i in range(40)]
    io.input_file(spark, f"{tmp_path}/file.in", lines)
    assert [r.value for r in spark.read.text(f"{tmp_path}/file.in").collect()] == lines


def test_names_of_weights(spark):
    used = spark.createDataFrame([("P", 1), ("P", 2), ("TMAX", 2), ("TMAX", 1), ("TMIN", 1), ("WS", 3), ("WD", 3)], "type string, idx int")
    assert {r.name: r["first"] for r in weights.weight_names(used).collect()} == {"weight_p": "P", "weight_t": "P", "weight_w": "WS", "weight_pet": "P"}
    own = used.union(spark.createDataFrame([("PET", 3)], "type string, idx int"))
    assert {r.name: r["first"] for r in weights.weight_names(own).collect()} == {"weight_p": "P", "weight_t": "P", "weight_w": "PET", "weight_pet": "PET"}
    cells = spark.createDataFrame([(0, 0, 0), (1, 0, 9)], "cell_index long, r int, c int")
    stations = spark.createDataFrame([(1, 0.0, 0.0), (2, 9.0, 0.0), (3, 4.0, 0.0)], "idx int, sx double, sy double")
    got = {(r.name, r.cell_index): r.idx for r in weights.scenario_weights("thiessen", cells, stations, used, 4.0).collect()}
    assert got == {(n, c): i for n, at in (("weight_p", (1, 2)), ("weight_t", (1, 2)), ("weight_pet", (1, 2)), ("weight_w", (3, 3))) for c, i in enumerate(at)}
    assert weights.scenario_weights("thiessen", cells, stations, used.limit(0), 4.0).count() == 0


def test_feedlots_and_outlets_in_both_directions(spark):
    feedlots = spark.createDataFrame([(1, "7"), (2, "0"), (3, " "), (4, None), (5, "8")], "id int, cb string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id int")
    storages = spark.createDataFrame([("1",), ("9",), ("0",), (None,)], "feedlot string")
    found = checks.findings(checks.feedlot_references(feedlots, ids(1, 2, 2, 3, 4, 6), ids(7), storages))
    assert {tuple(r) for r in found.collect()} == {
        ("feedlot without outlet", 5), ("outlet of no feedlot", 6), ("several outlets of a feedlot", 2), ("catch basin of a feedlot unknown", 8), ("feedlot of a storage unknown", 9),
    }
    assert checks.feedlot_references(feedlots) == [] and checks.feedlot_layers(True, True, True) == []
    assert checks.feedlot_layers(False, True, False) == ["feedlot boundaries are required with outlets"]


def test_wascobs_of_unknown_fields_or_drains_have_no_row(spark):
    cells = spark.createDataFrame([(0, 1), (1, 1), (2, 5)], "cell_index long, subbasin int")
    features = spark.createDataFrame([(1, 1, 8, 30), (2, 2, 8, 30), (3, 2, 9, 30), (4, 2, 8, 31)], "id int, cell_index long, field_id int, drain_id int")
    drains = spark.createDataFrame([(30, 4)], "id int, reach int")
    made = subarea.wascobs(features, cells, drains, spark.createDataFrame([(8,), (8,)], "id int"), 0.5)
    assert {(r.id, r.subbasin, r.reach, r.contribution_ha) for r in made.collect()} == {(1, 1, 4, 1.0), (2, 5, 4, 0.5)}


@pytest.mark.parametrize("kind", ["cell", "subarea"])
def test_climate_of_a_run(spark, tmp_path, kind):
    """The stations of the readings, the period that the file names, and weights that sum to one for each cell or subarea."""
    from rillwork.engine import Engine
    from rillwork.sources.views import CELL_M, COLS, cells

    own = cells(spark, "/root/testdata/sf0.001").drop("acc", "is_stream", "subbasin")
    engine = Engine(spark, own, CELL_M, COLS, stream_ha=0.04)
    stations = spark.createDataFrame([(1, 3.0, 2.0), (2, 90.0, 8.0), (3, 60.0, 4.0)], "idx int, sx double, sy double")
    days = [("P", 1, "2000-01-01"), ("P", 2, "2000-01-05"), ("TMAX", 2, "2000-01-02"), ("TMAX", 1, "2000-01-02"), ("WS", 3, "2000-01-02")]
    readings = spark.createDataFrame([(t, s, dt.date.fromisoformat(d)) for t, s, d in days], "type string, station int, day date")
    text = f"[model]\nmodel_folder = /m\n[scenario]\nname = a\nmodel_type = {kind}\nstart_date = 2000-01-02\n[climate_interpolation]\nmethod = thiessen\nradius = 200\n"
    spark.sql("CREATE DATABASE IF NOT EXISTS rill_c")
    done = engine.climate("rill_c", str(tmp_path), project.Scenario.load(text), stations, readings)
    assert done.stations == {"P": [1, 2], "TMAX": [1, 2], "WS": [3]} and done.end == dt.date(2000, 1, 5)
    lines = [r.value for r in spark.read.text(f"{tmp_path}/file.in").collect()]
    inside = own.join(engine["subbasins"].select("cell_index", "subbasin"), "cell_index")
    assert f"SUBBASINCOUNT|{inside.select('subbasin').distinct().count()}" in lines
    n = inside.count() if kind == "cell" else inside.select("subbasin", "field").distinct().count()
    assert f"{'CELLNUMBER' if kind == 'cell' else 'SUBAREANUMBER'}|{n}" in lines and lines[-2:] == ["SITECOUNT|1|WS", "SITENAME|3|WS"]
    made = spark.table("rill_c.weight")
    key = "cell_index" if kind == "cell" else "subarea"
    sums = made.groupBy("name", key).agg({"weight": "sum"}).collect()
    assert len(sums) == 4 * n and all(abs(r[2] - 1) < 1e-9 for r in sums)
    assert {r.name: r.idx for r in made.filter("name = 'weight_w'").select("name", "idx").distinct().collect()} == {"weight_w": 3}
    spark.sql("DROP DATABASE rill_c CASCADE")
