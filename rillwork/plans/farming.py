"""Crop rotation, schedules and scenario tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.calendar import day
from ..operators import distance, relations, rotation
from ..sources.views import CELLS, REACHES, SEASONS, cells, reaches, seasons, table
from .registry import query

INVENTORY = "inventory AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(o_custkey % 400 AS INTEGER) AS field, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS code, o_orderkey AS cell_index FROM orders)"


@query("SELECT field AS location, year - y0 + 1 AS year, code AS crop FROM (SELECT *, row_number() OVER (PARTITION BY year, field ORDER BY n DESC, first) AS k FROM (SELECT year, field, code, count(*) AS n, min(cell_index) AS first FROM inventory GROUP BY year, field, code)), (SELECT min(year) AS y0 FROM inventory) WHERE k = 1", INVENTORY)
def dominant_crop(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return rotation.dominant_crop(o.select(F.year("o_orderdate").alias("year"), (F.col("o_custkey") % 400).cast("int").alias("field"), F.substring("o_orderpriority", 1, 1).cast("int").alias("code"), F.col("o_orderkey").alias("cell_index")))


def management(spark):
    """One row for each of five crops: windows, days to harvest, whether it is sown in the year before."""
    i = F.col("id").cast("int")
    return spark.range(1, 6).select(
        i.alias("crop"), day(i + 3, F.lit(1)).alias("plant_first"), day(i + 3, F.lit(20)).alias("plant_last"), day(i + 5, F.lit(5)).alias("harvest_first"), day(i + 5, F.lit(25)).alias("harvest_last"),
        F.when(i % 2 == 0, i * 30).alias("growing_days"), (i == 5).alias("previous_year"),
    )


MANAGEMENT = """management AS (SELECT crop, make_date(2000, crop + 3, 1) AS plant_first, make_date(2000, crop + 3, 20) AS plant_last, make_date(2000, crop + 5, 5) AS harvest_first, make_date(2000, crop + 5, 25) AS harvest_last,
 CASE WHEN crop % 2 = 0 THEN crop * 30 END AS growing_days, crop = 5 AS previous_year FROM (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS crop))"""
CALENDAR = """planted AS (SELECT location, year, crop, growing_days, previous_year, harvest_first, plant_first + CAST((CAST(location AS BIGINT) * 7919 + year * 104729 + 1299709) % 20 AS INTEGER) AS planting FROM seasons JOIN management USING (crop)),
 calendar AS (SELECT location, year, crop, previous_year, planting, CASE WHEN growing_days > 0 THEN planting + growing_days ELSE harvest_first + CAST((CAST(location AS BIGINT) * 7919 + year * 104729 + 2599418) % 21 AS INTEGER) END AS harvest FROM planted)"""
FARM = (SEASONS, MANAGEMENT, CALENDAR)


def calendar(spark, sf_dir):
    return rotation.crop_calendar(seasons(spark, sf_dir), management(spark))


@query("SELECT * FROM calendar", *FARM)
def crop_calendar(spark, sf_dir):
    return calendar(spark, sf_dir)


@query(
    """SELECT c.location, c.crop, greatest(c.year - CASE WHEN c.previous_year THEN 1 ELSE 0 END, 1) AS year, CASE WHEN c.year - CASE WHEN c.previous_year THEN 1 ELSE 0 END = 0 THEN DATE '2000-01-01'
    WHEN c.previous_year AND c.planting < p.harvest THEN p.harvest ELSE c.planting END AS planting, c.harvest FROM (SELECT * REPLACE (year - 1991 AS year) FROM calendar) c LEFT JOIN (SELECT * REPLACE (year - 1991 AS year) FROM calendar) p ON c.location = p.location AND c.year = p.year + 1""",
    *FARM,
)
def winter_wheat_shift(spark, sf_dir):
    return rotation.winter_shift(calendar(spark, sf_dir).withColumn("year", F.col("year") - 1991))


def operations(spark):
    """Two operations for each crop: one counted from harvest or planting, one in a window."""
    i = F.col("id").cast("int")
    one = spark.range(1, 6).select(i.alias("crop"), F.when(i % 2 == 0, F.lit(-90)).otherwise(F.lit(-995)).alias("code"), day(i + 2, F.lit(1)).alias("first"), day(i + 2, F.lit(15)).alias("last"), (i * 10.0).alias("rate"))
    return one.unionByName(one.withColumn("code", F.lit(0)).withColumn("rate", F.col("rate") * 2))


OPERATIONS = "operations AS (SELECT crop, code, make_date(2000, crop + 2, 1) AS first, make_date(2000, crop + 2, 15) AS last, rate FROM (SELECT crop, CASE WHEN crop % 2 = 0 THEN -90 ELSE -995 END AS code, crop * 10.0::DOUBLE AS rate FROM management UNION ALL SELECT crop, 0, crop * 20.0::DOUBLE FROM management))"
SCHEDULE = "SELECT location, year, crop, CASE WHEN code > -100 AND code < 0 THEN harvest + (code + 100) WHEN code <= -100 THEN planting + (code + 1000) ELSE first + CAST((CAST(location AS BIGINT) * 7919 + year * 104729 + {} * 1299709) % 15 AS INTEGER) END AS day, code, rate FROM calendar JOIN operations USING (crop)"


@query(SCHEDULE.format(3), *FARM, OPERATIONS)
def fertilizer_schedule(spark, sf_dir):
    return rotation.scheduled(calendar(spark, sf_dir), operations(spark), 3)


@query(SCHEDULE.format(4) + " WHERE rate > 10", *FARM, OPERATIONS)
def tillage_schedule(spark, sf_dir):
    return rotation.scheduled(calendar(spark, sf_dir), operations(spark).filter("rate > 10"), 4)


@query("SELECT s.*, f.subbasin FROM (" + SCHEDULE.format(5) + ") s JOIN (SELECT field, arg_min(subbasin, cell_index) AS subbasin FROM cells GROUP BY field) f ON s.location = f.field", *FARM, OPERATIONS, CELLS)
def grazing_schedule(spark, sf_dir):
    s = rotation.scheduled(calendar(spark, sf_dir), operations(spark), 5)
    f = cells(spark, sf_dir).groupBy(F.col("field").alias("location")).agg(F.min_by("subbasin", "cell_index").alias("subbasin"))
    return s.join(f, "location")


@query("SELECT location, k AS operation, 5 AS month, 10 + k AS day FROM (SELECT DISTINCT location FROM seasons), (SELECT unnest(range(1, 4)) AS k)", SEASONS)
def single_crop_cross(spark, sf_dir):
    """Every default operation (a fixed few) for every location."""
    ops = F.explode(F.array(*[F.lit(k).cast("long") for k in (1, 2, 3)]))
    return seasons(spark, sf_dir).select("location").distinct().select("location", ops.alias("operation")).select("location", "operation", F.lit(5).alias("month"), (F.col("operation") + 10).alias("day"))


@query(
    """SELECT reach, day, sum(manure)::BIGINT / 100000.0::DOUBLE AS manure, sum(drink)::BIGINT / 10.0::DOUBLE AS drink, min(bank) AS bank FROM (SELECT l_suppkey AS reach, CAST(l_shipdate AS DATE) + CAST(d AS INTEGER) AS day, CAST(round(l_extendedprice * 100) AS BIGINT) AS manure, CAST(round(l_tax * 100) AS BIGINT) AS drink, l_discount AS bank
    FROM (SELECT *, unnest(range(0, CAST(l_quantity AS INTEGER))) AS d FROM lineitem WHERE l_returnflag = 'R')) GROUP BY reach, day"""
)
def grazing_deposit(spark, sf_dir):
    """Amounts are summed as whole units, so that the order of addition doesn't show."""
    li = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    g = li.select(F.col("l_suppkey").alias("reach"), F.to_date("l_shipdate").alias("start"), F.col("l_quantity").cast("int").alias("days"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("manure"), F.round(F.col("l_tax") * 100).cast("long").alias("drink"), F.col("l_discount").alias("bank"))
    out = rotation.daily_deposit(g, ["manure", "drink"], "bank")
    return out.select("reach", "day", (F.col("manure") / 100_000).alias("manure"), (F.col("drink") / 10).alias("drink"), "bank")


@query("SELECT DISTINCT location, CAST(kind AS BIGINT) AS kind, 1.0::DOUBLE AS factor FROM seasons, (SELECT unnest(range(1, 7)) AS kind)", SEASONS)
def manure_locations(spark, sf_dir):
    kinds = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(6).cast("long")))
    return seasons(spark, sf_dir).select("location").distinct().select("location", kinds.alias("kind"), F.lit(1.0).alias("factor"))


@query("SELECT p_partkey % 42 + 1 AS bmp_type, count(*) AS n, 'distribution_' || (p_partkey % 42 + 1) AS distribution, 'parameter_' || (p_partkey % 42 + 1) AS parameter FROM part GROUP BY ALL")
def bmp_scenarios(spark, sf_dir):
    kinds = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 42 + 1).alias("bmp_type")).agg(F.count("*").alias("n"))
    return kinds.select("bmp_type", "n", F.concat(F.lit("distribution_"), "bmp_type").alias("distribution"), F.concat(F.lit("parameter_"), "bmp_type").alias("parameter"))


@query("SELECT DISTINCT a.cell_index, a.field FROM cells a JOIN cells b ON abs(a.r - b.r) <= 2 AND abs(a.c - b.c) <= 2 AND (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) <= 4 WHERE a.slope_deg > 20 AND a.landuse IN (1, 2) AND b.landuse = 5 AND b.soil = 'P'", CELLS)
def marginal_land(spark, sf_dir):
    """Steep crop cells within two cells of other land."""
    c = cells(spark, sf_dir)
    near = distance.buffer(c, c.filter("landuse = 5 and soil = 'P'"), 2)
    return c.filter("slope_deg > 20 and landuse in (1, 2)").join(near, ["r", "c"], "left_semi").select("cell_index", "field")


@query("SELECT cell_index, field, CAST(field + 2 * pow(10, floor(log10(m)) + 2) AS BIGINT) AS pasture_id FROM cells, (SELECT max(field) AS m FROM cells) WHERE landuse IN (3, 5)", CELLS)
def pasture_land(spark, sf_dir):
    """Ids of pasture parts lie above those of all fields."""
    c = cells(spark, sf_dir)
    most = c.agg(F.max("field").alias("m"))  # one row
    return c.filter("landuse in (3, 5)").join(most, F.lit(True)).select("cell_index", "field", (F.col("field") + 2 * F.pow(F.lit(10.0), F.floor(F.log10("m")) + 2)).cast("long").alias("pasture_id"))


@query(
    """SELECT 'reservoir without area' AS rule, p_partkey AS key FROM part WHERE p_size < 3 UNION SELECT 'storage of no feedlot', CAST(c_custkey AS BIGINT) FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier)
    UNION SELECT 'id used twice', CAST(l_orderkey AS BIGINT) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"""
)
def validation_issues(spark, sf_dir):
    part, customer, supplier, li = (table(spark, sf_dir, t) for t in ("part", "customer", "supplier", "lineitem"))
    lonely = customer.join(supplier.select(F.col("s_nationkey").alias("c_nationkey")), "c_nationkey", "left_anti")
    twice = li.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).filter("n > 1")
    return relations.issues([("reservoir without area", part.filter("p_size < 3"), "p_partkey"), ("storage of no feedlot", lonely, "c_custkey"), ("id used twice", twice, "l_orderkey")])


@query("SELECT row_number() OVER (ORDER BY layer, pos) AS fid, layer, pos FROM (SELECT 1 AS layer, s_suppkey AS pos FROM supplier UNION ALL SELECT 2, c_custkey FROM customer UNION ALL SELECT 3, p_partkey FROM part)")
def merge_points(spark, sf_dir):
    """Layers one after the other under new ids."""
    from ..operators.grid import number_rows

    s, c, p = (table(spark, sf_dir, t) for t in ("supplier", "customer", "part"))
    rows = s.select(F.lit(1).alias("layer"), F.col("s_suppkey").alias("pos")).union(c.select(F.lit(2), "c_custkey")).union(p.select(F.lit(3), "p_partkey"))
    return number_rows(rows.withColumn("block", F.col("layer").cast("long") * 1_000_000_000 + F.floor(F.col("pos") / 4096)), "block", "pos", name="fid").select("fid", "layer", "pos")


@query("SELECT 'missing' AS side, reach AS id FROM (SELECT reach FROM reaches EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'shared', reach FROM (SELECT reach FROM reaches INTERSECT SELECT o_custkey FROM orders)", REACHES)
def set_difference(spark, sf_dir):
    ids, used = reaches(spark, sf_dir).select(F.col("reach").alias("id")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    return ids.subtract(used).select(F.lit("missing").alias("side"), "id").union(ids.intersect(used).select(F.lit("shared").alias("side"), "id"))


@query("SELECT n_name, r_name, count(*) AS n, round(sum(c_acctbal), 2) AS total, coalesce(sum(orders_n), 0)::BIGINT AS orders_n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT o_custkey, count(*) AS orders_n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey GROUP BY n_name, r_name")
def dimension_joins(spark, sf_dir):
    """A fact table with two dimensions and a pre-aggregated one."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("k"))
    c = table(spark, sf_dir, "customer").join(o, "c_custkey", "left")
    j = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return j.groupBy("n_name", "r_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"), F.coalesce(F.sum("k"), F.lit(0)).alias("orders_n"))


@query("SELECT o_custkey, o_orderkey, k FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3")
def top_outlets(spark, sf_dir):
    """The three greatest of each structure."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("k")).filter("k <= 3")
