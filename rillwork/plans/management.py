"""Management tables, structures and checks over features that the driver's tables stand in for."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bmp, checks, delineation, grid, structures
from ..sources.views import CELL_HA, CELL_M, CELLS, COLS, REACHES, cells, reaches, table
from .drainage import GRID
from .registry import query

START_YEAR = 1992

#: Point features: suppliers on cells. Polygons: the cells of a field on soil P are a wetland.
POINTS = "points AS (SELECT s_suppkey AS id, s_suppkey * 13 AS cell_index, s_acctbal AS amount, s_nationkey AS nation, s_name AS name FROM supplier)"
WETLANDS = "wet AS (SELECT cell_index, r, c, dem, is_stream, CAST(field AS BIGINT) AS id FROM cells WHERE soil = 'P')"
LIVESTOCK = "livestock AS (SELECT n_nationkey AS id, n_regionkey AS man_id, n_nationkey * 10.0 + 50 AS weight, n_nationkey * 0.5 AS man_day, n_nationkey * 2.0 AS tss, n_nationkey * 4.0 AS water FROM nation WHERE n_nationkey > 2)"
FERTILIZER = "fertilizer AS (SELECT r_regionkey AS ifnum, r_regionkey * 0.01 AS fminn, r_regionkey * 0.02 AS fminp, r_regionkey * 0.03 AS forgn, r_regionkey * 0.04 AS forgp FROM region)"


def points(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 13).alias("cell_index"), F.col("s_acctbal").alias("amount"), F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"))


def wetlands(spark, sf_dir):
    return cells(spark, sf_dir).filter("soil = 'P'").select("cell_index", "r", "c", "dem", "is_stream", F.col("field").cast("long").alias("id"))


def livestock(spark, sf_dir):
    n, k = table(spark, sf_dir, "nation").filter("n_nationkey > 2"), F.col("n_nationkey")
    terms = ((k * 10.0 + 50).alias("Ani_Weight"), (k * 0.5).alias("Man_Day"), (k * 2.0).alias("Man_TSS_Fra"), (k * 4.0).alias("Water_Drink"))
    return n.select(k.alias("ID"), F.col("n_regionkey").alias("Man_ID"), *terms)


def fertilizer(spark, sf_dir):
    k = F.col("r_regionkey")
    terms = [(k * v).alias(n) for n, v in (("FMINN", 0.01), ("FMINP", 0.02), ("FORGN", 0.03), ("FORGP", 0.04))]
    return table(spark, sf_dir, "region").select(k.alias("IFNUM"), *terms)


@query(f"SELECT DISTINCT subbasin, {', '.join(f'1.0::DOUBLE AS {m}' for m in bmp.MULTIPLIERS)} FROM cells", CELLS)
def subbasin_multiplier(spark, sf_dir):
    return bmp.subbasin_multiplier(cells(spark, sf_dir))


@query(
    "SELECT id, subbasin, CASE WHEN id % 4 = 0 THEN DATE '1900-01-01' ELSE DATE '2001-05-01' END AS operation, amount AS sa_em, amount * 2 AS v_em, amount / 2 AS sa_pr, amount AS v_pr, CASE WHEN id % 3 = 0 THEN 'table' ELSE 'attributes' END AS method FROM points LEFT JOIN cells USING (cell_index)",
    CELLS, POINTS,
)
def reservoirs(spark, sf_dir):
    a = F.col("amount")
    f = points(spark, sf_dir).select("id", "cell_index", F.when(F.col("id") % 4 != 0, "2001-05-01").alias("op"), a.alias("sa_em"), (a * 2).alias("v_em"), (a / 2).alias("sa_pr"), a.alias("v_pr"), F.when(F.col("id") % 3 == 0, F.col("name")).otherwise("").alias("file"))
    return bmp.reservoir(f, cells(spark, sf_dir))


@query("SELECT id, subbasin, CASE WHEN id % 4 = 0 THEN DATE '1900-01-01' ELSE DATE '2001-05-01' END AS operation, name AS table_name FROM points LEFT JOIN cells USING (cell_index)", CELLS, POINTS)
def point_sources(spark, sf_dir):
    f = points(spark, sf_dir).select("id", "cell_index", F.when(F.col("id") % 4 != 0, "2001-05-01").alias("operation"), F.col("name").alias("table_name"))
    return bmp.point_source(f, cells(spark, sf_dir))


@query("SELECT p.id, c.subbasin, coalesce(r.receive, -1) AS receive FROM points p LEFT JOIN cells c USING (cell_index) LEFT JOIN reaches r ON c.subbasin = r.reach AND r.receive > 1", CELLS, POINTS, REACHES)
def catch_basins(spark, sf_dir):
    receive = reaches(spark, sf_dir).filter("receive > 1").select(F.col("reach").alias("subbasin"), "receive")
    return bmp.catch_basin(points(spark, sf_dir), cells(spark, sf_dir), receive)


@query("SELECT p.id, p.nation AS ani_id, l.man_id AS Man_ID, CAST(0 AS INTEGER) AS cb, CAST(p.id % 9 AS BIGINT) AS adult, CAST(0 AS INTEGER) AS nonadult, '' AS stoid, p.name AS storatio FROM points p JOIN livestock l ON p.nation = l.id", POINTS, LIVESTOCK)
def feedlots(spark, sf_dir):
    none = F.lit(None).cast("int")
    f = points(spark, sf_dir).select("id", F.col("nation").alias("ani_id"), none.alias("cb"), (F.col("id") % 9).alias("adult"), none.alias("nonadult"), F.lit(None).cast("string").alias("stoid"), F.col("name").alias("storatio"))
    return bmp.feedlot(f, livestock(spark, sf_dir))


@query(
    """SELECT s.id, s.feedlot, round(s.area, 4) AS contribution, round(s.area / sum(s.area) OVER (PARTITION BY s.feedlot), 6) AS fraction, round(coalesce(w.texture * 1.5, 0), 3) AS distance, round(coalesce(w.dem, 0), 3) AS height FROM
    (SELECT id, id % 7 AS feedlot, max(acc * 0.01) AS area, arg_max(cell_index, [acc * 0.01, -cell_index]) AS cell_index FROM (SELECT w.id, w.cell_index, c.acc FROM wet w JOIN cells c USING (cell_index)) GROUP BY id) s LEFT JOIN (SELECT * FROM cells WHERE landuse < 4) w USING (cell_index)""",
    CELLS, WETLANDS,
)
def manure_storages(spark, sf_dir):
    c, w = cells(spark, sf_dir), wetlands(spark, sf_dir)
    zones = w.select("id", "cell_index").join(c.select("cell_index", (F.col("acc") * CELL_HA).alias("acc_ha")), "cell_index")
    ways = c.filter("landuse < 4").select("cell_index", (F.col("texture") * 1.5).alias("distance"), F.col("dem").alias("fall"))
    made = bmp.manure_storage(w.select("id").distinct().withColumn("feedlot", F.col("id") % 7), zones, ways)
    return made.select("id", "feedlot", F.round("contribution", 4).alias("contribution"), F.round("fraction", 6).alias("fraction"), F.round("distance", 3).alias("distance"), F.round("height", 3).alias("height"))


@query("SELECT p.id, c.subbasin, c.field, p.amount FROM points p LEFT JOIN cells c USING (cell_index)", CELLS, POINTS)
def dugouts(spark, sf_dir):
    return bmp.containing(points(spark, sf_dir), cells(spark, sf_dir), "subbasin", "field").select("id", "subbasin", "field", "amount")


@query("SELECT p.id, c.subbasin FROM points p JOIN cells c USING (cell_index)", CELLS, POINTS)
def offsite_watering(spark, sf_dir):
    return bmp.copied_key(points(spark, sf_dir), "cell_index", cells(spark, sf_dir).withColumnRenamed("cell_index", "cell"), "cell", "subbasin").select("id", "subbasin")


GRAZING = """grazing AS (SELECT l_suppkey AS reach, CAST(l_partkey % 97 + 1 AS INTEGER) AS field, CAST(l_suppkey % 25 AS INTEGER) AS ani, CAST(l_shipdate AS DATE) AS start, CAST(l_quantity % 4 AS INTEGER) AS days,
 l_linenumber % 2 AS source, l_linenumber % 3 AS access, l_discount * 10 AS density, l_tax AS part, l_quantity AS adult, l_discount AS bank FROM lineitem)"""
AMOUNTS = """amounts AS (SELECT g.reach, g.start, g.days, g.bank, u / 1000 * man_day * part * 0.5 AS manure, u * water / 100 / 1000 AS drink, tss, fminn, fminp, forgn, forgp FROM
 (SELECT g.*, l.man_day, l.tss, l.water, l.man_id, density * f.area * l.weight * adult / 100 AS u FROM grazing g JOIN (SELECT field, count(*) * 0.01 AS area FROM cells GROUP BY field) f ON g.field = f.field JOIN livestock l ON g.ani = l.id WHERE source = 1 AND access <> 2) g
 JOIN fertilizer ON g.man_id = ifnum)"""


@query(
    """SELECT reach AS ReachId, CAST(year(day) - 1991 AS INTEGER) AS Year, CAST(month(day) AS INTEGER) AS Month, CAST(day(day) AS INTEGER) AS Day, round(sum(CAST(round((manure) * 1000000) AS BIGINT))::BIGINT / 1000000.0::DOUBLE, 3) AS Manure, round(sum(CAST(round((tss / 100 * manure) * 1000000) AS BIGINT))::BIGINT / 1000000.0::DOUBLE, 3) AS TSS, round(sum(CAST(round((fminn * manure) * 1000000) AS BIGINT))::BIGINT / 1000000.0::DOUBLE, 3) AS NO3, 0.0::DOUBLE AS NH4,
    round(sum(CAST(round((forgn * manure) * 1000000) AS BIGINT))::BIGINT / 1000000.0::DOUBLE, 3) AS OrgN, round(sum(CAST(round((fminp * manure) * 1000000) AS BIGINT))::BIGINT / 1000000.0::DOUBLE, 3) AS SolP, round(sum(CAST(round((forgp * manure) * 1000000) AS BIGINT))::BIGINT / 1000000.0::DOUBLE, 3) AS OrgP, round(sum(CAST(round((drink) * 1000000) AS BIGINT))::BIGINT / 1000000.0::DOUBLE, 3) AS DrinkWater, min(bank) AS BankK_Change FROM (SELECT *, start + CAST(d AS INTEGER) AS day FROM (SELECT *, unnest(range(0, days)) AS d FROM amounts)) GROUP BY reach, day""",
    CELLS, LIVESTOCK, FERTILIZER, GRAZING, AMOUNTS,
)
def reach_deposits(spark, sf_dir):
    """Grazing joined with fields, animals and manures; amounts by formula; eight sums by reach and day."""
    li, day = table(spark, sf_dir, "lineitem"), F.to_date("l_shipdate")
    g = li.select(
        (F.col("l_partkey") % 97 + 1).cast("int").alias("Location"), (F.col("l_suppkey") % 25).cast("int").alias("Ani_ID"), F.col("l_suppkey").alias("SourceID"), (F.col("l_linenumber") % 2).alias("Source"),
        (F.col("l_linenumber") % 3).alias("Access"), (F.year(day) - START_YEAR + 1).alias("Year"), F.month(day).alias("GraMon"), F.dayofmonth(day).alias("GraDay"), (F.col("l_quantity") % 4).cast("int").alias("Days"),
        (F.col("l_discount") * 10).alias("GR_Density"), F.col("l_tax").alias("DayFra"), F.col("l_quantity").alias("Ani_adult"), F.lit(0.5).alias("Drinking_time"), F.col("l_discount").alias("BankK_Change"),
    )
    fields = cells(spark, sf_dir).groupBy(F.col("field").alias("id")).agg((F.count("*") * CELL_HA).alias("Area_Ha"))
    rows = bmp.deposit_rows(g, fields, livestock(spark, sf_dir), fertilizer(spark, sf_dir), START_YEAR)
    made = bmp.reach_deposit(rows, START_YEAR)
    return made.select("ReachId", "Year", "Month", "Day", *[F.round(c, 3).alias(c) for c in bmp.DEPOSITS], "BankK_Change")


@query("SELECT o_orderkey AS location, CAST(year(o_orderdate) AS INTEGER) AS year, p_size AS crop FROM orders JOIN part ON o_custkey = p_partkey AND (CASE WHEN p_size % 2 = 0 THEN 'before' ELSE 'after' END) = (CASE WHEN year(o_orderdate) <= 2010 THEN 'before' ELSE 'after' END) WHERE p_size > 5")
def crop_lookup(spark, sf_dir):
    """Crop codes of a year's lookup, of which those that don't proceed have no model id."""
    crops = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("location"), F.year("o_orderdate").alias("year"), F.col("o_custkey").alias("code"))
    model = F.when(F.col("p_size") > 5, F.col("p_size").cast("string")).otherwise("Not proceed")
    lookups = table(spark, sf_dir, "part").select(F.when(F.col("p_size") % 2 == 0, "before").otherwise("after").alias("period"), F.col("p_partkey").alias("code"), model.alias("model_id"))
    return bmp.crops_by_lookup(crops, lookups)


@query("SELECT id AS part, count(*) AS n, round(avg(c.dem), 1) AS mean_dem, round(avg(c.slope_deg), 4) AS mean_slope_deg, round(avg(c.texture), 4) AS mean_texture, round(avg(c.acc), 3) AS mean_acc FROM wet w JOIN cells c USING (cell_index) GROUP BY id", CELLS, WETLANDS)
def buffer_part_means(spark, sf_dir):
    parts = wetlands(spark, sf_dir).select("cell_index", F.col("id").alias("part"))
    m = bmp.buffer_means(parts, cells(spark, sf_dir), "dem", "slope_deg", "texture", "acc")
    return m.select("part", "n", F.round("mean_dem", 1).alias("mean_dem"), F.round("mean_slope_deg", 4).alias("mean_slope_deg"), F.round("mean_texture", 4).alias("mean_texture"), F.round("mean_acc", 3).alias("mean_acc"))


@query("SELECT subbasin AS subarea, round(coalesce(avg(CASE WHEN texture > 6 THEN NULL ELSE texture END), 0), 4) AS texture, round(coalesce(avg(CASE WHEN field % 5 = 0 THEN NULL ELSE slope_deg END), 0), 4) AS slope FROM cells GROUP BY subbasin", CELLS)
def subarea_parameters(spark, sf_dir):
    c = cells(spark, sf_dir)
    own = c.select("cell_index", F.when(F.col("texture") > 6, -32768.0).otherwise(F.col("texture")).alias("texture"), F.when(F.col("field") % 5 == 0, -32768.0).otherwise(F.col("slope_deg")).alias("slope"))
    m = bmp.subarea_means(own, c.select("cell_index", F.col("subbasin").alias("subarea")), "texture", "slope")
    return m.select("subarea", F.round("texture", 4).alias("texture"), F.round("slope", 4).alias("slope"))


@query("SELECT field, arg_min(subbasin, [mean, subbasin]) AS subbasin, round(min(mean), 3) AS mean FROM (SELECT field, subbasin, avg(dem) AS mean FROM cells GROUP BY field, subbasin) GROUP BY field", CELLS)
def tile_drain_subbasin(spark, sf_dir):
    return bmp.lowest_subbasin(cells(spark, sf_dir), "field", "dem").withColumn("mean", F.round("mean", 3))


@query("SELECT field, max(subbasin) AS subbasin FROM cells GROUP BY field", CELLS)
def zone_greatest_subbasin(spark, sf_dir):
    return bmp.greatest_subbasin(cells(spark, sf_dir), "field")


@query("SELECT c.subbasin, max(p.id) AS id FROM points p JOIN cells c USING (cell_index) GROUP BY c.subbasin", CELLS, POINTS)
def wascob_drainage(spark, sf_dir):
    """A wascob drains the subbasin that holds it; of several in one the last counts."""
    return bmp.one_each(bmp.containing(points(spark, sf_dir), cells(spark, sf_dir), "subbasin"), "subbasin", "id")


LEAVES = "leaves AS (SELECT w.id, w.cell_index, p.down FROM pointer p JOIN wet w ON p.cell_index = w.cell_index LEFT JOIN wet v ON p.down = v.cell_index WHERE v.id IS NULL OR v.id <> w.id)"
OUTLET = "outlet AS (SELECT l.id, arg_min(l.cell_index, [w.dem, -l.cell_index]) AS cell_index, min(w.dem) AS dem FROM leaves l JOIN wet w USING (cell_index) GROUP BY l.id)"


def _exits(spark, sf_dir):
    return structures.exits(grid.flow_edges(cells(spark, sf_dir), CELL_M, COLS), wetlands(spark, sf_dir))


@query("SELECT w.id, count(*) AS n_cells, any_value(n) AS n_outlets, bool_or(is_stream) AS riparian, any_value(o.cell_index) AS outlet FROM wet w JOIN (SELECT id, count(*) AS n FROM leaves GROUP BY id) l USING (id) JOIN outlet o USING (id) GROUP BY w.id", *GRID, WETLANDS, LEAVES, OUTLET)
def wetland_outlets(spark, sf_dir):
    """Cells, outlets, whether a stream passes, and the lowest outlet."""
    out, c, w = _exits(spark, sf_dir), cells(spark, sf_dir), wetlands(spark, sf_dir)
    low = structures.lowest_outlets(out, c).select("id", F.col("cell_index").alias("outlet"))
    return structures.counts(w.select("cell_index", "id"), out, c).join(low, "id")


@query(
    "SELECT o.id, coalesce(CASE WHEN w.id <> o.id THEN w.id END, 0) AS next FROM outlet o LEFT JOIN (SELECT id, arg_max(pos, k) AS pos FROM flows GROUP BY id) f USING (id) LEFT JOIN wet w ON f.pos = w.cell_index",
    *GRID, WETLANDS, LEAVES, OUTLET,
    "flows AS (SELECT o.id, p.down AS pos, 0 AS k FROM outlet o JOIN pointer p USING (cell_index) WHERE p.down IS NOT NULL UNION ALL SELECT f.id, p.down, f.k + 1 FROM flows f JOIN pointer p ON f.pos = p.cell_index WHERE p.down IS NOT NULL AND f.pos NOT IN (SELECT cell_index FROM wet))",
)
def wetland_tree(spark, sf_dir):
    """The wetland that each one's outlet drains to."""
    out = structures.lowest_outlets(_exits(spark, sf_dir), cells(spark, sf_dir))
    return structures.downstream_structure(grid.flow_edges(cells(spark, sf_dir), CELL_M, COLS), wetlands(spark, sf_dir).select("cell_index", "id"), out)


@query("SELECT id, r, c, tr, tc FROM (SELECT p.*, w.r AS tr, w.c AS tc, row_number() OVER (PARTITION BY p.id, p.r, p.c ORDER BY (p.r - w.r) * (p.r - w.r) + (p.c - w.c) * (p.c - w.c), w.r, w.c) AS k FROM (SELECT CAST(s_suppkey % 97 + 1 AS BIGINT) AS id, CAST(s_suppkey % 60 AS INTEGER) AS r, CAST(s_suppkey * 7 % 128 AS INTEGER) AS c FROM supplier) p JOIN wet w USING (id)) WHERE k = 1 GROUP BY ALL", CELLS, WETLANDS)
def snap_in_structure(spark, sf_dir):
    p = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 97 + 1).alias("id"), (F.col("s_suppkey") % 60).cast("int").alias("r"), (F.col("s_suppkey") * 7 % 128).cast("int").alias("c")).distinct()
    return structures.snap_within(p, wetlands(spark, sf_dir))


@query("SELECT id, r, c, tr, tc FROM (SELECT p.*, w.r AS tr, w.c AS tc, row_number() OVER (PARTITION BY p.id, p.r, p.c ORDER BY (p.r - w.r) * (p.r - w.r) + (p.c - w.c) * (p.c - w.c), w.dem, w.r, w.c) AS k FROM (SELECT DISTINCT CAST(s_suppkey % 97 + 1 AS BIGINT) AS id, CAST(s_suppkey % 60 AS INTEGER) AS r, CAST(s_suppkey * 7 % 128 AS INTEGER) AS c FROM supplier) p JOIN (SELECT DISTINCT w.* FROM wet w JOIN leaves USING (cell_index)) w ON p.id = w.id) WHERE k = 1", *GRID, WETLANDS, LEAVES)
def snap_to_edge(spark, sf_dir):
    p = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 97 + 1).alias("id"), (F.col("s_suppkey") % 60).cast("int").alias("r"), (F.col("s_suppkey") * 7 % 128).cast("int").alias("c")).distinct()
    edge = wetlands(spark, sf_dir).join(_exits(spark, sf_dir).select("cell_index").distinct(), "cell_index", "left_semi")
    return structures.snap_to_edge(p, edge)


@query(
    "SELECT region, arg_max(id, [n, -id]) AS id, max(n) AS n FROM (SELECT a AS id, min(b) AS region FROM meet GROUP BY a) JOIN (SELECT c_custkey AS id, c_nationkey AS n FROM customer) USING (id) GROUP BY region",
    "pairs AS (SELECT DISTINCT s_suppkey AS a, s_suppkey * 7 % 100 AS b FROM supplier WHERE s_suppkey % 3 = 0)",
    "side AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs)",
    "meet AS (SELECT a, a AS b FROM side UNION SELECT m.a, s.b FROM meet m JOIN side s ON m.b = s.a)",
)
def conflict_groups(spark, sf_dir):
    """Of features whose borders meet, each connected group's biggest stays."""
    s = table(spark, sf_dir, "supplier").filter("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") * 7 % 100).alias("b"))
    sizes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("n"))
    return delineation.biggest_of_group(s.distinct(), sizes)


@query("SELECT w.cell_index, w.id FROM wet w WHERE id IN (SELECT id FROM wet JOIN cells USING (cell_index) WHERE subbasin > 20)", CELLS, WETLANDS)
def structures_inside(spark, sf_dir):
    return structures.inside_basin(wetlands(spark, sf_dir).select("cell_index", "id"), cells(spark, sf_dir).filter("subbasin > 20"))


@query("SELECT p_partkey, round((p_size + p_retailprice) / 2, 4) AS average_k, round((p_retailprice + p_partkey) / 2, 4) AS average_porosity FROM part WHERE p_retailprice > 950 AND contains(p_type, 'A')")
def soil_averages(spark, sf_dir):
    p = checks.containing_text(checks.large_enough(table(spark, sf_dir, "part"), "p_retailprice", 950), "p_type", "A")
    own = (F.round(bmp.averages(F.col("p_size"), F.col("p_retailprice")), 4).alias("average_k"), F.round(bmp.averages(F.col("p_retailprice"), F.col("p_partkey")), 4).alias("average_porosity"))
    return p.select("p_partkey", *own)


@query("SELECT reach, row_number() OVER (ORDER BY reach) AS new_id FROM (SELECT DISTINCT l_suppkey * 3 AS reach FROM lineitem)")
def distinct_reaches(spark, sf_dir):
    """New ids of the reaches that drains flow to, ascending."""
    return grid.rank_rows(table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") * 3).alias("reach")).distinct(), "reach", name="new_id")


@query(
    """SELECT 'reservoir sa_em not above zero' AS rule, id AS key FROM points WHERE amount <= 0 UNION SELECT 'reservoir v_em not above zero', id FROM points WHERE amount * 2 <= 0 UNION SELECT 'reservoir sa_pr not above zero', id FROM points WHERE amount - 500 <= 0
    UNION SELECT 'reservoir v_pr not above zero', id FROM points WHERE amount <= 0 UNION SELECT 'reservoir emergency below principal', id FROM points WHERE amount < amount - 500 OR amount * 2 < amount
    UNION SELECT 'wascob start is no date', id FROM points WHERE id % 13 = 0 OR id % 32 = 0 UNION SELECT 'wascob volumes out of order', id FROM points WHERE nation > 20 OR 20 > amount UNION SELECT 'wascob of no field', id FROM points WHERE nation > 0 AND nation NOT IN (SELECT field FROM cells WHERE field > 3)
    UNION SELECT 'wascob of no tile drain', id FROM points WHERE id > 0 AND id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)""",
    CELLS, POINTS,
)
def feature_findings(spark, sf_dir):
    """Reservoirs' and wascobs' rules with their references."""
    p, a = points(spark, sf_dir), F.col("amount")
    res = p.select("id", a.alias("sa_em"), (a * 2).alias("v_em"), (a - 500).alias("sa_pr"), a.alias("v_pr"))
    was = p.select("id", F.lit(2000).alias("StartYear"), (F.col("id") % 13).cast("int").alias("StartMon"), (F.col("id") % 32).cast("int").alias("StartDay"), F.col("nation").cast("double").alias("DeadV"), F.lit(20.0).alias("NormV"), a.alias("MaxV"), F.lit(1.0).alias("DeadA"), F.lit(1.0).alias("NormA"), F.lit(1.0).alias("MaxA"), F.col("nation").alias("FieldID"), F.col("id").alias("TdrainID"))
    was = was.withColumn("StartDay", F.when((F.col("StartDay") > 28), 28).otherwise(F.col("StartDay")))
    fields = cells(spark, sf_dir).filter("field > 3").select(F.col("field").alias("id"))
    drains = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"))
    return checks.findings(checks.reservoir(res), checks.wascob(was, fields, drains))


@query(
    """SELECT 'station unknown' AS rule, CAST(idx AS BIGINT) AS key FROM used WHERE idx NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey < 40) UNION SELECT 'station without readings', idx FROM used LEFT JOIN span USING (type, idx) WHERE a IS NULL
    UNION SELECT 'station period too short', idx FROM used JOIN span USING (type, idx) WHERE a > DATE '2024-01-05' OR b < DATE '2024-01-20'""",
    "used AS (SELECT DISTINCT event_type AS type, user_id % 60 AS idx FROM events)",
    "span AS (SELECT event_type AS type, user_id AS idx, min(CAST(ts AS DATE)) AS a, max(CAST(ts AS DATE)) AS b FROM events GROUP BY ALL)",
)
def station_findings(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    used = e.select(F.col("event_type").alias("type"), (F.col("user_id") % 60).alias("idx")).distinct()
    known = table(spark, sf_dir, "supplier").filter("s_suppkey < 40").select(F.col("s_suppkey").alias("idx"))
    own = e.select(F.col("event_type").alias("type"), F.col("user_id").alias("idx"), F.to_date("ts").alias("day"))
    return checks.findings(checks.stations(used, known, own, "2024-01-05", "2024-01-20"))
