"""The chain from elevation to reaches, each query on what the engine derives itself: D8, accumulation, streams, pour points, watersheds, slope, reaches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hydrology as H
from ..operators import delineation, flow, grid, reach
from ..operators.iterate import written
from ..sources.views import CELL_HA, CELL_M, CELLS, COLS, cells, table
from .drainage import GRID, PATHS
from .registry import query

#: Upstream area from which on a cell is stream.
STREAM_HA = 0.04
KM2 = CELL_M * CELL_M / 1e6

ACC = "dacc AS (SELECT pos AS cell_index, count(*) AS acc FROM paths GROUP BY pos)"
STREAMS = "dstream AS (SELECT cell_index FROM dacc WHERE acc * 0.01 >= 0.04)"
ENDS = """dflow AS (SELECT p.cell_index, p.down FROM pointer p WHERE p.cell_index IN (SELECT cell_index FROM dstream) AND p.down IN (SELECT cell_index FROM dstream)),
 dends AS (SELECT DISTINCT cell_index FROM (SELECT cell_index FROM dflow WHERE down IN (SELECT down FROM dflow GROUP BY down HAVING count(*) > 1)
 UNION ALL SELECT cell_index FROM dstream WHERE cell_index NOT IN (SELECT cell_index FROM dflow)))"""
#: Further sources of pour points: outlets (customers' keys as cells), structures' outlets (the lowest cell of each field of soil P).
SOURCES = """doutlets AS (SELECT c_custkey AS cell_index FROM customer WHERE c_custkey IN (SELECT cell_index FROM dstream)),
 dlow AS (SELECT arg_min(cell_index, [dem, -cell_index]) AS cell_index FROM cells WHERE soil = 'P' GROUP BY field),
 dpour AS (SELECT cell_index, min(k) AS k FROM (SELECT cell_index, 0 AS k FROM dends UNION ALL SELECT cell_index, 1 FROM doutlets UNION ALL SELECT cell_index, 2 FROM dlow) GROUP BY cell_index)"""
SHEDS = """dways AS (SELECT p.cell_index, p.cell_index AS pos, p.cell_index IN (SELECT cell_index FROM dpour) AS done FROM pointer p
 UNION ALL SELECT w.cell_index, e.down, e.down IN (SELECT cell_index FROM dpour) FROM dways w JOIN pointer e ON w.pos = e.cell_index WHERE e.down IS NOT NULL AND NOT w.done),
 dshed AS (SELECT cell_index, max(pos) FILTER (done) AS outlet FROM dways GROUP BY cell_index),
 dsub AS (SELECT cell_index, outlet, CAST(dense_rank() OVER (ORDER BY outlet) AS INTEGER) AS subbasin FROM dshed WHERE outlet IS NOT NULL)"""
CHAIN = (*GRID, PATHS, ACC, STREAMS, ENDS, SOURCES, SHEDS)


def flow_of(spark, sf_dir):
    """The drainage edges, and each cell's upstream cells."""
    edges = written(grid.flow_edges(cells(spark, sf_dir), CELL_M, COLS))
    acc = flow.tree(edges.select("cell_index", "down", F.lit(1).cast("long").alias("acc")), ["acc"])
    return edges, written(acc)


def pour_points_of(spark, sf_dir, edges, acc):
    streams = delineation.threshold_streams(acc, STREAM_HA, CELL_HA)
    outlets = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell_index")).join(streams, "cell_index", "left_semi")
    low = cells(spark, sf_dir).filter("soil = 'P'").groupBy("field").agg(F.min_by("cell_index", F.struct("dem", -F.col("cell_index"))).alias("cell_index"))
    return delineation.merge_pour_points({"streams": delineation.stream_ends(edges, streams), "outlets": outlets, "structures": low})


def delineated(spark, sf_dir):
    """The cells with what the chain derives (acc, is_stream, outlet, subbasin) in place of the stand-ins, and the edges."""
    edges, acc = flow_of(spark, sf_dir)
    points = written(pour_points_of(spark, sf_dir, edges, acc))
    sheds = delineation.subbasins(edges, points)
    base = cells(spark, sf_dir).drop("acc", "is_stream", "subbasin")
    found = base.join(acc, "cell_index").join(sheds, "cell_index").withColumn("is_stream", F.col("acc") * CELL_HA >= STREAM_HA)
    return written(found), edges


@query("SELECT cell_index, acc FROM dacc JOIN dstream USING (cell_index)", *GRID, PATHS, ACC, STREAMS)
def delineation_streams(spark, sf_dir):
    return delineation.threshold_streams(flow_of(spark, sf_dir)[1], STREAM_HA, CELL_HA)


@query("SELECT cell_index, CASE k WHEN 0 THEN 'streams' WHEN 1 THEN 'outlets' ELSE 'structures' END AS source FROM dpour", *CHAIN[:-1])
def delineation_pour_points(spark, sf_dir):
    return pour_points_of(spark, sf_dir, *flow_of(spark, sf_dir))


#: Points beside the streams, each with the stream cell that it goes to.
ASIDE = """aside AS (SELECT 1 AS k, s_suppkey AS id, s_suppkey * 13 % 118 AS pr, s_suppkey * 29 % 128 AS pc FROM supplier UNION ALL SELECT 2, n_nationkey, n_nationkey * 17 % 118, n_nationkey * 23 % 128 FROM nation
 UNION ALL SELECT 3, r_regionkey, r_regionkey * 19 % 118, r_regionkey * 27 % 128 FROM region UNION ALL SELECT 4, p_partkey, p_partkey * 11 % 118, p_partkey * 7 % 128 FROM part),
 moved AS (SELECT k, id, arg_min(cell_index, [(pr - cell_index // 128) * (pr - cell_index // 128) + (pc - cell_index % 128) * (pc - cell_index % 128), cell_index]) AS cell_index FROM aside, dstream
 WHERE (pr - cell_index // 128) * (pr - cell_index // 128) + (pc - cell_index % 128) * (pc - cell_index % 128) <= 25 GROUP BY k, id)"""


@query(
    """SELECT cell_index, ['streams', 'outlets', 'point_sources', 'reservoirs', 'wascobs', 'tile_drains', 'structures'][min(k) + 1] AS source FROM (SELECT cell_index, 0 AS k FROM dends UNION ALL
    SELECT cell_index, k FROM moved UNION ALL SELECT cell_index, 5 FROM doutlets UNION ALL SELECT cell_index, 6 FROM dlow) GROUP BY cell_index""",
    *CHAIN[:-1], ASIDE,
)
def pour_points_of_all(spark, sf_dir):
    """Pour points of seven sources, of which four are moved to the streams."""
    edges, acc = flow_of(spark, sf_dir)
    streams = written(delineation.threshold_streams(acc, STREAM_HA, CELL_HA).select("cell_index"))
    at = lambda name, key, a, b: table(spark, sf_dir, name).select(F.col(key).alias("point_id"), (F.col(key) * a % 118).alias("pr"), (F.col(key) * b % 128).alias("pc"))
    snapped = {"outlets": at("supplier", "s_suppkey", 13, 29), "point_sources": at("nation", "n_nationkey", 17, 23), "reservoirs": at("region", "r_regionkey", 19, 27), "wascobs": at("part", "p_partkey", 11, 7)}
    drains = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell_index")).join(streams, "cell_index", "left_semi")
    low = cells(spark, sf_dir).filter("soil = 'P'").groupBy("field").agg(F.min_by("cell_index", F.struct("dem", -F.col("cell_index"))).alias("cell_index"))
    return delineation.pour_points(edges, streams, snapped, {"tile_drains": drains, "structures": low}, 5, COLS)


@query("SELECT cell_index, outlet, subbasin FROM dsub", *CHAIN)
def delineation_subbasins(spark, sf_dir):
    return delineated(spark, sf_dir)[0].select("cell_index", "outlet", "subbasin")


@query(
    """SELECT x.cell_index, round(degrees(atan(sqrt(pow(((ne + 2 * e + se) - (nw + 2 * w + sw)) / 80.0, 2) + pow(((sw + 2 * s + se) - (nw + 2 * n + ne)) / 80.0, 2)))), 4) AS slope_deg FROM
    (SELECT a.cell_index, coalesce(max(b.dem) FILTER (k = 0), a.dem) AS ne, coalesce(max(b.dem) FILTER (k = 1), a.dem) AS e, coalesce(max(b.dem) FILTER (k = 2), a.dem) AS se,
    coalesce(max(b.dem) FILTER (k = 3), a.dem) AS s, coalesce(max(b.dem) FILTER (k = 4), a.dem) AS sw, coalesce(max(b.dem) FILTER (k = 5), a.dem) AS w,
    coalesce(max(b.dem) FILTER (k = 6), a.dem) AS nw, coalesce(max(b.dem) FILTER (k = 7), a.dem) AS n
    FROM cells a CROSS JOIN steps t LEFT JOIN cells b ON b.r = a.r + t.dy AND b.c = a.c + t.dx GROUP BY a.cell_index, a.dem) x""",
    *GRID[:2],
)
def delineation_slope(spark, sf_dir):
    s = delineation.slope_degrees(cells(spark, sf_dir), "dem", CELL_M)
    return s.select("cell_index", F.round("slope_deg", 4).alias("slope_deg"))


@query("SELECT p.cell_index, p.down, s.subbasin FROM pointer p JOIN dflow f ON p.cell_index = f.cell_index JOIN dsub s ON p.cell_index = s.cell_index", *CHAIN)
def stream_lines(spark, sf_dir):
    c, edges = delineated(spark, sf_dir)
    return delineation.stream_lines(edges, c.filter("is_stream"), c)


@query(
    "SELECT cell_index, link, count(*) OVER (PARTITION BY link) - 1 - n AS place, count(*) OVER (PARTITION BY link) AS size FROM (SELECT cell_index, max(n) AS n, arg_max(pos, n) AS link FROM slink GROUP BY cell_index)",
    *CHAIN[:-2],
    """slink AS (SELECT cell_index, cell_index AS pos, CAST(0 AS BIGINT) AS n FROM dstream UNION ALL
 SELECT l.cell_index, f.down, l.n + 1 FROM slink l JOIN dflow f ON l.pos = f.cell_index WHERE l.pos NOT IN (SELECT cell_index FROM dends))""",
)
def stream_links(spark, sf_dir):
    """Streams as ordered lines between confluences."""
    edges, acc = flow_of(spark, sf_dir)
    streams = written(delineation.threshold_streams(acc, STREAM_HA, CELL_HA).select("cell_index"))
    return delineation.stream_links(edges, streams, delineation.stream_ends(edges, streams))


STEPS_SQL = """dcells AS (SELECT x.cell_index, x.dem, x.landuse, s.subbasin, a.acc, a.acc * 0.01 >= 0.04 AS is_stream FROM cells x JOIN dsub s USING (cell_index) JOIN dacc a USING (cell_index)),
 dsteps AS (SELECT u.*, p.down, p.dist, v.subbasin AS n_subbasin, v.is_stream AS n_is_stream, v.dem AS n_dem FROM pointer p JOIN dcells u ON p.cell_index = u.cell_index LEFT JOIN dcells v ON p.down = v.cell_index),
 dmain AS (SELECT n_subbasin AS subbasin, arg_max(down, [acc, -down]) AS inlet FROM dsteps WHERE is_stream AND n_is_stream AND subbasin <> n_subbasin GROUP BY n_subbasin),
 dhead AS (SELECT subbasin, coalesce(arg_min(cell_index, [acc, cell_index]) FILTER (is_stream), arg_max(cell_index, [acc, -cell_index])) AS inlet FROM dsteps GROUP BY subbasin),
 dinlet AS (SELECT subbasin, coalesce(m.inlet, h.inlet) AS inlet FROM dhead h LEFT JOIN dmain m USING (subbasin)),
 dreceive AS (SELECT subbasin, arg_max(coalesce(n_subbasin, 0), [acc, -cell_index]) AS receive FROM dsteps WHERE n_subbasin IS NULL OR n_subbasin <> subbasin GROUP BY subbasin)"""
WAYS_SQL = """dwalk AS (SELECT i.subbasin, i.inlet AS pos, 0 AS k FROM dinlet i UNION ALL SELECT w.subbasin, s.down, w.k + 1 FROM dwalk w JOIN dsteps s ON w.pos = s.cell_index WHERE s.n_subbasin = w.subbasin),
 dway AS (SELECT w.subbasin, greatest(sum(CASE WHEN s.n_subbasin = w.subbasin THEN s.dist ELSE 0 END), 10.0) AS length,
 greatest(sum(CASE WHEN s.down IS NOT NULL THEN (s.dem - s.n_dem) / s.dist ELSE 0 END) / (count(s.down) + 1) * 100, 0.01) AS slope FROM dwalk w JOIN dsteps s ON w.pos = s.cell_index GROUP BY w.subbasin)"""


@query("SELECT subbasin, inlet FROM dinlet", *CHAIN, STEPS_SQL)
def reach_inlet(spark, sf_dir):
    c, edges = delineated(spark, sf_dir)
    return reach.inlets(reach.with_next(edges, c))


@query("SELECT subbasin, round(length, 4) AS length, round(slope, 5) AS slope FROM dway", *CHAIN, STEPS_SQL, WAYS_SQL)
def reach_length_slope(spark, sf_dir):
    c, edges = delineated(spark, sf_dir)
    w = reach.ways(reach.with_next(edges, c), CELL_M, 0.01)
    return w.select("subbasin", F.round("length", 4).alias("length"), F.round("slope", 5).alias("slope"))


@query("SELECT subbasin, receive FROM dreceive", *CHAIN, STEPS_SQL)
def subbasin_receive(spark, sf_dir):
    c, edges = delineated(spark, sf_dir)
    return reach.receiving(reach.with_next(edges, c))


REACH_COLUMNS = ("length", "width", "depth", "slope", "velocity", "max_elevation", "min_elevation", "ave_elevation", "contribution_area")


@query(
    """SELECT w.subbasin AS reach_id, w.subbasin AS subbasin_id, w.subbasin AS outlet_id, round(w.length, 4) AS length, round(z.width, 4) AS width, round(z.depth, 4) AS depth, round(w.slope, 4) AS slope,
    round(z.velocity, 4) AS velocity, round(z.hi, 4) AS max_elevation, round(z.lo, 4) AS min_elevation, round(z.mean, 4) AS ave_elevation, round(z.area, 4) AS contribution_area, r.receive AS receive_reach_id,
    0.5::DOUBLE AS main_side_slope, 5.0::DOUBLE AS w_ratio, 0.5::DOUBLE AS bank_Ero_frac FROM dway w JOIN dreceive r USING (subbasin) JOIN
    (SELECT subbasin, greatest(avg(pow(acc * 0.0001 * 1.0, 0.56)) FILTER (is_stream), 0.1::DOUBLE) AS width, greatest(avg(pow(acc * 0.0001 * 0.04, 0.45)) FILTER (is_stream), 0.1::DOUBLE) AS depth,
    coalesce(avg(pow(acc * 0.0001 * 0.04, 0.45) / (landuse * 0.05)) FILTER (is_stream), avg(pow(acc * 0.0001 * 0.04, 0.45) / (landuse * 0.05))) AS velocity,
    coalesce(max(dem) FILTER (is_stream), max(dem)) AS hi, coalesce(min(dem) FILTER (is_stream), min(dem)) AS lo, coalesce(avg(dem) FILTER (is_stream), avg(dem)) AS mean,
    max(acc) * 0.01 AS area FROM dcells GROUP BY subbasin) z USING (subbasin)""",
    *CHAIN, STEPS_SQL, WAYS_SQL,
)
def reach_parameter(spark, sf_dir):
    """The reach table of the delineated subbasins, without the order and the roughness, which strahler_order and reach_manning check."""
    c, edges = delineated(spark, sf_dir)
    depth = H.reach_depth(F.col("acc"), KM2, 2)
    c = c.withColumn("width", H.reach_width(F.col("acc"), KM2, 2)).withColumn("depth", depth).withColumn("velocity", depth / (F.col("landuse") * 0.05))
    made = reach.reach_parameter(c, edges, CELL_HA, CELL_M)
    terms = [F.round(n, 4).alias(n) for n in REACH_COLUMNS]
    return made.select("reach_id", "subbasin_id", "outlet_id", *terms, "receive_reach_id", "main_side_slope", "w_ratio", "bank_Ero_frac")


#: Strahler orders of stream cells by passes from the headwaters, and those along each reach's main way.
ORDERS_SQL = """son AS (SELECT cell_index, CASE WHEN n_is_stream THEN down END AS down FROM dsteps WHERE is_stream),
 sneed AS (SELECT down AS cell_index, count(*) AS need FROM son WHERE down IS NOT NULL GROUP BY down),
 sorder(cell_index, o) USING KEY (cell_index) AS (SELECT cell_index, 1 FROM son WHERE cell_index NOT IN (SELECT cell_index FROM sneed) UNION
 SELECT x.down, max(x.o) + CASE WHEN count(*) FILTER (x.o = x.m) >= 2 THEN 1 ELSE 0 END FROM (SELECT p.down, u.o, max(u.o) OVER (PARTITION BY p.down) AS m, count(*) OVER (PARTITION BY p.down) AS have
 FROM recurring.sorder u JOIN son p ON u.cell_index = p.cell_index WHERE p.down IS NOT NULL) x JOIN sneed n ON n.cell_index = x.down
 WHERE x.have = n.need AND x.down NOT IN (SELECT cell_index FROM recurring.sorder) GROUP BY x.down),
 sall AS (SELECT d.cell_index, coalesce(s.o, 1) AS o FROM dsteps d LEFT JOIN sorder s USING (cell_index)),
 sends AS (SELECT min(o) AS lo, max(o) AS hi FROM sorder),
 swalk AS (SELECT w.subbasin, w.k, s.o, lag(s.o) OVER (PARTITION BY w.subbasin ORDER BY w.k) AS last FROM dwalk w JOIN sall s ON s.cell_index = w.pos)"""


@query(
    """SELECT w.subbasin, o.stream_order, round(least(greatest(avg(0.1 - 0.06 * coalesce((w.o - e.lo) / nullif(e.hi - e.lo, 0), 0)), 0.04), 0.1), 6) AS manning FROM swalk w, sends e, rorder o
 WHERE o.subbasin = w.subbasin AND (w.last IS NULL OR w.last <> w.o) GROUP BY w.subbasin, o.stream_order""",
    *CHAIN, STEPS_SQL, WAYS_SQL, ORDERS_SQL,
    """rorder(subbasin, stream_order) USING KEY (subbasin) AS (SELECT subbasin, 1 FROM dreceive WHERE subbasin NOT IN (SELECT receive FROM dreceive) UNION
 SELECT x.receive, max(x.o) + CASE WHEN count(*) FILTER (x.o = x.m) >= 2 THEN 1 ELSE 0 END FROM (SELECT p.receive, u.stream_order AS o, max(u.stream_order) OVER (PARTITION BY p.receive) AS m, count(*) OVER (PARTITION BY p.receive) AS have
 FROM recurring.rorder u JOIN dreceive p ON u.subbasin = p.subbasin WHERE p.receive > 0) x JOIN (SELECT receive, count(*) AS need FROM dreceive GROUP BY receive) n ON n.receive = x.receive
 WHERE x.have = n.need AND x.receive NOT IN (SELECT subbasin FROM recurring.rorder) GROUP BY x.receive)""",
)
def reach_manning(spark, sf_dir):
    """Order of the delineated reaches, and the roughness along their main ways."""
    c, edges = delineated(spark, sf_dir)
    steps = written(reach.with_next(edges, c))
    rough = reach.manning(steps, reach.stream_orders(steps)).withColumn("manning", F.round("manning", 6))
    return rough.join(reach.orders(reach.receiving(steps)), "subbasin").select("subbasin", "stream_order", "manning")


@query(
    "SELECT a AS cell_index, min(b) AS region FROM joined GROUP BY a",
    *GRID[:2],
    "side AS (SELECT a.cell_index AS a, b.cell_index AS b FROM cells a, steps s, cells b WHERE b.r = a.r + s.dy AND b.c = a.c + s.dx AND a.texture = b.texture)",
    "joined AS (SELECT cell_index AS a, cell_index AS b FROM cells UNION SELECT j.a, s.b FROM joined j JOIN side s ON j.b = s.a)",
)
def raster_regions(spark, sf_dir):
    """Polygons of a raster: the connected cells of one value."""
    return delineation.regions(cells(spark, sf_dir), "texture")


@query("SELECT row_number() OVER (ORDER BY r, c) AS fid, landuse AS value, (c + 0.5) * 10.0 AS x, (r + 0.5) * 10.0 AS y FROM cells WHERE landuse = 1", CELLS)
def raster_points(spark, sf_dir):
    c = cells(spark, sf_dir).withColumn("landuse", F.when(F.col("landuse") == 1, 1).otherwise(0))
    return delineation.cells_as_points(c, "landuse", CELL_M)


@query(
    "SELECT cell_index, round(CASE WHEN subbasin % 2 = 1 THEN dem + 200 ELSE dem END, 2) AS raised, CASE WHEN field % 5 = 1 THEN field WHEN texture > 9 THEN texture ELSE landuse END AS landuse, 1.0::DOUBLE AS usle_p FROM cells WHERE landuse > 1 AND soil <> 'P'",
    CELLS,
)
def grid_overrides(spark, sf_dir):
    """A mask refined by another raster, the clipped elevation with a watershed raised, land use with layers over it, a default raster."""
    mask = cells(spark, sf_dir).filter("landuse > 1 and soil <> 'P'").select("cell_index")
    c = delineation.clip(cells(spark, sf_dir), mask)
    up = delineation.raised(F.col("dem"), F.col("subbasin") % 2)
    own = delineation.overridden(F.col("landuse"), F.when(F.col("field") % 5 == 1, F.col("field")), F.when(F.col("texture") > 9, F.col("texture")))
    return c.select("cell_index", F.round(up, 2).alias("raised"), own.alias("landuse"), F.lit(1.0).alias("usle_p"))
