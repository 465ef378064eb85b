"""Subareas, buffers and tile drains on the rasters that the engine derives itself (subbasins, accumulation, streams)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hydrology as H
from ..operators import buffers, checks, reach, subarea, weights
from ..operators.iterate import written
from ..sources.views import CELL_HA, CELL_M, CELLS, STATIONS, cells, stations, table
from .delineation import CHAIN, STEPS_SQL, delineated
from .registry import query

#: Buffers: the fields' cells of landuse 3, strips those of landuse 5, tile drains those of soil O. Customers' keys are the drains' ids.
VALUES = {"slope_deg": "slope", "texture": "sol_k", "porosity": "sol_porosity", "rootdepth": "root_depth"}
KINDS = ["riparian_buffer", "riparian_buffer_drainage", "filter_strip", "filter_strip_drainage", "tile_drain"]
#: Upstream area from which on a reach takes the tile drains above it. The reference value of 10 ha would leave none on these grids.
LEAST_HA = 0.1


def model_cells(spark, sf_dir):
    c, edges = delineated(spark, sf_dir)
    more = c.withColumns({
        "slope": F.tan(F.radians("slope_deg")) * 100, "manning": F.col("landuse") * 0.05, "usle_p": F.lit(1.0), "capacity": F.col("texture") * 0.02,
        "wetland": F.col("soil") == "P", "porosity": F.col("texture") * 0.03, "rootdepth": F.col("landuse") * 100.0,
        "buffer": F.when(F.col("landuse") == 3, F.col("field")), "strip": F.when(F.col("landuse") == 5, F.col("field")),
        "drain": F.when(F.col("soil") == "O", F.col("field")),
    })
    return more, edges


PERIODS = "(VALUES (2, 0.04, 0.45), (10, 0.12, 0.52), (100, 0.18, 0.55)) p(period, a, b)"
MODEL = """mcells AS (SELECT x.*, s.subbasin AS sub, a.acc AS up, a.acc * 0.01 >= 0.04 AS stream, tan(radians(x.slope_deg)) * 100 AS slope,
 CASE WHEN x.landuse = 3 THEN x.field END AS buffer, CASE WHEN x.landuse = 5 THEN x.field END AS strip, CASE WHEN x.soil = 'O' THEN x.field END AS drain
 FROM cells x JOIN dsub s USING (cell_index) JOIN dacc a USING (cell_index)),
 msteps AS (SELECT u.*, n.cell_index AS down, p.dist, n.buffer AS n_buffer, n.strip AS n_strip, q.down IS NULL OR e.cell_index IS NULL AS n_end
 FROM mcells u JOIN pointer p USING (cell_index) LEFT JOIN mcells n ON p.down = n.cell_index LEFT JOIN pointer q ON q.cell_index = n.cell_index LEFT JOIN mcells e ON e.cell_index = q.down)"""
TIMES = f"""mterms AS (SELECT cell_index, period, 1 / cel AS t, 2 * d / pow(cel, 3) AS delta FROM (SELECT *, v * rad / (2 * s) AS d, v * 5 / 3 AS cel FROM (SELECT *,
 greatest(least(pow(rad, 2.0 / 3) * sqrt(s) / greatest(landuse * 0.05, 0.001), 3.0), 0.005) AS v FROM (SELECT m.*, p.period, greatest(slope / 100, 0.001) AS s, p.a * pow(up * 0.0001, p.b) AS rad FROM mcells m, {PERIODS})))),
 mtravel AS (SELECT cell_index, cell_index AS pos FROM mcells UNION ALL SELECT w.cell_index, s.down FROM mtravel w JOIN msteps s ON s.cell_index = w.pos WHERE NOT s.stream AND s.down IS NOT NULL),
 mtimes AS (SELECT cell_index, max(t) FILTER (period = 2) AS t_2, max(t) FILTER (period = 10) AS t_10, max(t) FILTER (period = 100) AS t_100, max(sd) FILTER (period = 2) AS sd_2,
 max(sd) FILTER (period = 10) AS sd_10, max(sd) FILTER (period = 100) AS sd_100 FROM (SELECT w.cell_index, period, sum(t) * 10 / 3600 AS t, sqrt(sum(delta)) * sqrt(10.0::DOUBLE) / 3600 AS sd
 FROM mtravel w JOIN mterms x ON x.cell_index = w.pos GROUP BY w.cell_index, period) GROUP BY cell_index)"""
SUBAREAS = "msub AS (SELECT *, dense_rank() OVER (ORDER BY sub, field) AS subarea FROM mcells)"


def parts_sql(zone: str) -> str:
    """Ways to the first exit of a buffer, one step a time."""
    return f"""{zone}_steps AS (SELECT *, {zone} IS NOT NULL AND down IS NOT NULL AND (n_{zone} IS NULL OR n_{zone} <> {zone} OR n_end) AS is_exit, CASE WHEN {zone} IS NULL THEN 0 ELSE coalesce(dist, 0) END AS step FROM msteps),
 {zone}_ways AS (SELECT cell_index, cell_index AS pos, step AS length, is_exit FROM {zone}_steps UNION ALL SELECT w.cell_index, y.cell_index, w.length + y.step, y.is_exit
 FROM {zone}_ways w JOIN {zone}_steps x ON x.cell_index = w.pos JOIN {zone}_steps y ON y.cell_index = x.down WHERE NOT w.is_exit),
 {zone}_parts AS (SELECT w.cell_index, w.pos AS exit_cell, w.length, s.{zone} IS NOT NULL AS inside, dense_rank() OVER (ORDER BY w.pos) AS part FROM {zone}_ways w JOIN {zone}_steps s USING (cell_index) WHERE w.is_exit)"""


def table_sql(zone: str, width: float) -> str:
    return f"""SELECT 1 AS scenario, part AS id, 0 AS year, zone_id, subbasin, 6 AS vegetation_id, round(length, 4) AS length, {width}::DOUBLE AS width, round(length * {width} * 0.0001, 6) AS area_ha,
 round(n * 0.01, 4) AS drainage_area, round(n * 0.01 / (length * {width} * 0.0001), 4) AS area_ratio, round(slope, 5) AS slope, round(sol_k, 5) AS sol_k, round(sol_porosity, 5) AS sol_porosity, round(root_depth, 4) AS root_depth
 FROM (SELECT part, max({zone}) FILTER (p.cell_index = exit_cell) AS zone_id, max(sub) FILTER (p.cell_index = exit_cell) AS subbasin, max(length) FILTER (inside) AS length, count(*) AS n, avg(slope_deg) FILTER (inside) AS slope,
 avg(texture) FILTER (inside) AS sol_k, avg(texture * 0.03::DOUBLE) FILTER (inside) AS sol_porosity, avg(landuse * 100.0::DOUBLE) FILTER (inside) AS root_depth FROM {zone}_parts p JOIN mcells USING (cell_index) GROUP BY part)"""


def buffer_rows(spark, sf_dir, zone, width):
    c, edges = model_cells(spark, sf_dir)
    parts = buffers.numbered(buffers.buffer_parts(c, edges, zone))
    made = buffers.buffer_table(parts, c, zone, width, CELL_HA, VALUES)
    digits = {"length": 4, "area_ha": 6, "drainage_area": 4, "area_ratio": 4, "slope": 5, "sol_k": 5, "sol_porosity": 5, "root_depth": 4}
    return made.withColumns({n: F.round(n, d) for n, d in digits.items()})


@query(table_sql("buffer", buffers.RIPARIAN_M), *CHAIN, MODEL, parts_sql("buffer"))
def riparian_buffers(spark, sf_dir):
    """The parts of riparian buffers with their drainage areas, sizes and soils."""
    return buffer_rows(spark, sf_dir, "buffer", buffers.RIPARIAN_M)


@query(table_sql("strip", buffers.STRIP_M), *CHAIN, MODEL, parts_sql("strip"))
def filter_strips(spark, sf_dir):
    return buffer_rows(spark, sf_dir, "strip", buffers.STRIP_M)


@query(
    "SELECT cell_index, round(t_2, 6) AS t_2, round(t_10, 6) AS t_10, round(t_100, 6) AS t_100, round(sd_2, 6) AS sd_2, round(sd_10, 6) AS sd_10, round(sd_100, 6) AS sd_100 FROM mtimes",
    *CHAIN, MODEL, TIMES,
)
def travel_time_spread(spark, sf_dir):
    """Mean and standard deviation of the travel time to the stream for three return periods."""
    c, edges = model_cells(spark, sf_dir)
    times = subarea.travel_times(c, edges, CELL_M, H.DEPTH)
    return times.select("cell_index", *[F.round(n, 6).alias(n) for n in times.columns[1:]])


@query(
    """SELECT subarea AS id, sub AS subbasin_id, field AS field_id, round(count(*) * 0.01, 4) AS area, round(count(*) FILTER (soil = 'P') / count(*), 6) AS wetland_fraction, round(avg(dem), 6) AS elevation,
    round(avg(slope), 5) AS slope, 1.0::DOUBLE AS usle_p, round(avg(moisture), 6) AS moisture_initial, round(avg(up), 4) AS flow_accumulation_average, round(avg(t_2), 6) AS travel_time_average_2,
    round(avg(t_10), 6) AS travel_time_average_10, round(avg(t_100), 6) AS travel_time_average_100, round(avg(sd_2), 6) AS travel_time_std_2, round(avg(sd_10), 6) AS travel_time_std_10,
    round(avg(sd_100), 6) AS travel_time_std_100, 1 AS topography_weight, round(sqrt(count(*) * 0.01 * 10000) / 10, 4) AS lateral_width
    FROM msub JOIN mtimes USING (cell_index) JOIN mwet USING (cell_index) GROUP BY subarea, sub, field""",
    *CHAIN, MODEL, TIMES, SUBAREAS,
    """mindex AS (SELECT cell_index, texture * 0.02::DOUBLE AS capacity, CASE WHEN slope > 0 THEN ln(up * 100.0 / (slope / 100)) END AS wti FROM mcells),
 mwet AS (SELECT cell_index, CASE WHEN wti IS NOT NULL THEN ((least(wti, 0.8 * hi) - lo) * 0.95 / (0.8 * hi - lo) + 0.05) * capacity END AS moisture FROM mindex, (SELECT min(wti) AS lo, max(wti) AS hi FROM mindex))""",
)
def subarea_parameters_full(spark, sf_dir):
    """The subarea table with all its columns."""
    c, edges = model_cells(spark, sf_dir)
    wet = subarea.moisture(c, CELL_M * CELL_M, "capacity")
    own = subarea.with_subarea(c).join(subarea.travel_times(c, edges, CELL_M, H.DEPTH), "cell_index").join(wet, "cell_index")
    made = subarea.subarea_table(own, CELL_HA)
    digits = {"area": 4, "elevation": 6, "slope": 5, "flow_accumulation_average": 4, "lateral_width": 4}
    whole = ("id", "subbasin_id", "field_id", "usle_p", "topography_weight")
    return made.select(*whole, *[F.round(n, digits.get(n, 6)).alias(n) for n in made.columns if n not in whole])


@query("SELECT row_number() OVER (ORDER BY r, c) - 1 AS valid_index, subarea FROM msub", *CHAIN, MODEL, SUBAREAS)
def subarea_cells(spark, sf_dir):
    return subarea.cell_table(subarea.with_subarea(model_cells(spark, sf_dir)[0]))


@query(
    """SELECT 'soil' AS kind, subarea, soil AS type, round(count(*) * 0.01, 4) AS area FROM msub GROUP BY subarea, soil UNION ALL
    SELECT 'landuse', subarea, CAST(landuse AS VARCHAR), round(count(*) * 0.01, 4) FROM msub GROUP BY subarea, landuse""",
    *CHAIN, MODEL, SUBAREAS,
)
def subarea_types(spark, sf_dir):
    """The areas of soil types and landuse types within subareas."""
    own = subarea.with_subarea(model_cells(spark, sf_dir)[0])
    of = lambda k: subarea.shares(own, k, CELL_HA).select(F.lit(k).alias("kind"), "subarea", F.col(k).cast("string").alias("type"), F.round("area", 4).alias("area"))
    return of("soil").union(of("landuse"))


@query(
    """SELECT kind, subarea, location, round(count(*) * 0.01, 4) AS area_ha, round(count(*) / max(n_subarea), 6) AS fraction_to_subarea, round(count(*) / max(n_location), 6) AS fraction_to_bmp FROM
    (SELECT *, count(*) OVER (PARTITION BY kind, location) AS n_location FROM (SELECT k.kind, s.subarea, k.location, z.n AS n_subarea FROM msub s JOIN (SELECT subarea, count(*) AS n FROM msub GROUP BY subarea) z USING (subarea) JOIN
    (SELECT 'riparian_buffer' AS kind, cell_index, part AS location FROM buffer_parts WHERE inside UNION ALL SELECT 'riparian_buffer_drainage', cell_index, part FROM buffer_parts UNION ALL
    SELECT 'filter_strip', cell_index, part FROM strip_parts WHERE inside UNION ALL SELECT 'filter_strip_drainage', cell_index, part FROM strip_parts UNION ALL
    SELECT 'tile_drain', cell_index, drain FROM mcells WHERE drain IS NOT NULL) k USING (cell_index))) GROUP BY kind, subarea, location""",
    *CHAIN, MODEL, SUBAREAS, parts_sql("buffer"), parts_sql("strip"),
)
def subarea_structures(spark, sf_dir):
    """What part of each subarea lies in a structure or drains through one, for five kinds in one aggregation."""
    c, edges = model_cells(spark, sf_dir)
    own = subarea.with_subarea(c).select("cell_index", "subarea", F.col("drain").alias("tile_drain"))
    for zone, name in (("buffer", "riparian_buffer"), ("strip", "filter_strip")):
        parts = buffers.numbered(buffers.buffer_parts(c, edges, zone))
        ids = (F.when(F.col("inside"), F.col("part")).alias(name), F.col("part").alias(f"{name}_drainage"))
        own = own.join(parts.select("cell_index", *ids), "cell_index", "left")
    made = subarea.structure_lookups(own, KINDS, CELL_HA)
    return made.select("kind", "subarea", "location", F.round("area_ha", 4).alias("area_ha"), *[F.round(n, 6).alias(n) for n in ("fraction_to_subarea", "fraction_to_bmp")])


DRAINS = """treach AS (SELECT r.subbasin AS reach, r.receive, z.area FROM dreceive r JOIN (SELECT subbasin, max(acc) * 0.01 AS area FROM dcells GROUP BY subbasin) z USING (subbasin)),
 tway AS (SELECT reach AS node, reach AS below, 0 AS rank FROM treach UNION ALL SELECT w.node, t.receive, w.rank + 1 FROM tway w JOIN treach t ON t.reach = w.below WHERE t.receive > 0),
 toutlet AS (SELECT DISTINCT sub AS reach FROM mcells WHERE cell_index IN (SELECT s_suppkey * 101 FROM supplier)),
 tto AS (SELECT w.node, coalesce(arg_min(w.below, w.rank) FILTER (w.below IN (SELECT reach FROM toutlet)), arg_min(w.below, w.rank) FILTER (t.area >= 0.1), arg_max(w.below, w.rank)) AS reach
 FROM tway w JOIN treach t ON t.reach = w.below GROUP BY w.node),
 tlow AS (SELECT drain, arg_min(sub, [mean, sub]) AS sub FROM (SELECT drain, sub, avg(dem) AS mean FROM mcells WHERE drain IS NOT NULL GROUP BY drain, sub) GROUP BY drain),
 tfield AS (SELECT drain, arg_max(field, [n, -first]) AS field FROM (SELECT drain, field, count(*) AS n, min(cell_index) AS first FROM mcells WHERE drain IS NOT NULL GROUP BY drain, field) GROUP BY drain),
 tdrains AS (SELECT c_custkey AS id, c_acctbal AS elevation, c_nationkey AS spacing, f.field, l.sub AS subbasin, o.reach FROM customer JOIN tlow l ON l.drain = c_custkey JOIN tfield f ON f.drain = c_custkey JOIN tto o ON o.node = l.sub)"""


def drains_of(spark, sf_dir, c, edges):
    receive = reach.receiving(reach.with_next(edges, c))
    area = c.groupBy("subbasin").agg((F.max("acc") * CELL_HA).alias("contribution_ha"))
    reaches = written(receive.join(area, "subbasin").withColumnRenamed("subbasin", "reach"))
    at = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 101).alias("cell_index"))
    outlets = c.join(at, "cell_index", "left_semi").select("subbasin")
    features = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("elevation"), F.col("c_nationkey").alias("spacing"))
    return subarea.tile_drains(features, c, "drain", outlets, reaches, LEAST_HA)


@query("SELECT id, elevation, spacing, field, subbasin, reach FROM tdrains", *CHAIN, MODEL, STEPS_SQL, DRAINS)
def tile_drains(spark, sf_dir):
    """Tile drains with field, subbasin and the reach that they drain to."""
    return drains_of(spark, sf_dir, *model_cells(spark, sf_dir))


@query("SELECT row_number() OVER (ORDER BY reach) AS id, reach, 3800.0::DOUBLE AS drainage_capacity FROM (SELECT DISTINCT reach FROM tdrains)", *CHAIN, MODEL, STEPS_SQL, DRAINS)
def outlet_drainage(spark, sf_dir):
    return subarea.outlet_drainage(drains_of(spark, sf_dir, *model_cells(spark, sf_dir)))


@query(
    """SELECT p_partkey AS id, p_size AS field, m.sub AS subbasin, d.reach, p_retailprice AS elevation, round(z.n * 0.01, 4) AS contribution_ha FROM part JOIN tdrains d ON d.id = p_partkey % 120 JOIN mcells m ON m.cell_index = p_partkey
    JOIN (SELECT sub, count(*) AS n FROM mcells GROUP BY sub) z ON z.sub = m.sub WHERE p_size IN (SELECT field FROM mcells)""",
    *CHAIN, MODEL, STEPS_SQL, DRAINS,
)
def wascobs(spark, sf_dir):
    """Parts as wascobs: their key is the cell, their size the field, and the tile drain is one of 120, of which some are unknown."""
    c, edges = model_cells(spark, sf_dir)
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    features = p.select(key.alias("id"), key.alias("cell_index"), F.col("p_size").alias("field_id"), (key % 120).alias("drain_id"), F.col("p_retailprice").alias("elevation"))
    made = subarea.wascobs(features, c, drains_of(spark, sf_dir, c, edges), c.select(F.col("field").alias("id")), CELL_HA)
    return made.select("id", F.col("field_id").alias("field"), "subbasin", "reach", "elevation", F.round("contribution_ha", 4).alias("contribution_ha"))


@query(
    """SELECT 'feedlot without outlet' AS rule, c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL
    SELECT DISTINCT 'outlet of no feedlot', o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL
    SELECT 'several outlets of a feedlot', o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 1 UNION ALL
    SELECT DISTINCT 'catch basin of a feedlot unknown', c_custkey % 150 FROM customer WHERE c_custkey % 150 <> 0 AND c_custkey % 150 NOT IN (SELECT s_suppkey FROM supplier) UNION ALL
    SELECT 'feedlot of a storage unknown', p_partkey FROM part WHERE p_partkey <> 0 AND p_partkey NOT IN (SELECT c_custkey FROM customer)"""
)
def feedlot_findings(spark, sf_dir):
    """Customers as feedlots, their orders as outlets, suppliers as catch basins, parts as storages."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 150).alias("cb"))
    outlets = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    basins = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    storages = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("feedlot"))
    return checks.findings(checks.feedlot_references(c, outlets, basins, storages))


#: Types of reading by an order's number modulo their count; types with the same rest by three have the same stations.
KIND = ("P", "TMAX", "TMIN", "RM", "SR", "WS", "WD")


@query(
    """SELECT n.name, w.cell_index, w.idx, 1.0::DOUBLE AS weight FROM wnames n JOIN (SELECT c.cell_index, s.k, arg_min(s.idx, [(s.sx - c.c) * (s.sx - c.c) + (s.sy - c.r) * (s.sy - c.r), s.idx]) AS idx
    FROM cells c CROSS JOIN wsets s GROUP BY c.cell_index, s.k) w USING (k)""",
    CELLS, STATIONS,
    "wused AS (SELECT DISTINCT l_orderkey % 7 AS kind, (l_orderkey % 7) % 3 AS k, l_suppkey AS idx FROM lineitem WHERE l_suppkey % 3 <> (l_orderkey % 7) % 3)",
    "wsets AS (SELECT DISTINCT u.k, s.idx, s.sx, s.sy FROM wused u JOIN stations s ON s.idx = u.idx)",
    "wnames AS (SELECT DISTINCT k, unnest(CASE kind WHEN 0 THEN ['weight_p', 'weight_pet'] WHEN 1 THEN ['weight_t'] WHEN 3 THEN ['weight_rm'] WHEN 4 THEN ['weight_sr'] WHEN 5 THEN ['weight_w'] ELSE [] END) AS name FROM wused)",
)
def scenario_weights(spark, sf_dir):
    """The nearest station of every cell for all types of a scenario; equal station sets are interpolated once."""
    kind = (F.col("l_orderkey") % len(KIND)).cast("int")
    rows = table(spark, sf_dir, "lineitem").filter(F.col("l_suppkey") % 3 != kind % 3)
    names = F.array(*[F.lit(x) for x in KIND])
    used = rows.select(names[kind].alias("type"), F.col("l_suppkey").cast("int").alias("idx")).distinct()
    return weights.scenario_weights("thiessen", cells(spark, sf_dir), stations(spark, sf_dir), used, 16.0)
