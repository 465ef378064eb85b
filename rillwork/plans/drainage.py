"""Stencils, drainage graphs and reach networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contract, flow, grid, relations
from ..sources.views import CELL_M, CELLS, COLS, REACHES, cells, reaches, table
from .registry import query

STEPS = "steps AS (SELECT * FROM (VALUES (0, 1, -1, sqrt(200.0)), (1, 1, 0, 10.0), (2, 1, 1, sqrt(200.0)), (3, 0, 1, 10.0), (4, -1, 1, sqrt(200.0)), (5, -1, 0, 10.0), (6, -1, -1, sqrt(200.0)), (7, 0, -1, 10.0)) t(k, dx, dy, dist))"
POINTER = """pointer AS (SELECT a.cell_index, a.r, a.c, b.k, b.down, b.dist FROM cells a LEFT JOIN (SELECT * FROM (SELECT a.cell_index, s.k, b.cell_index AS down, s.dist,
 row_number() OVER (PARTITION BY a.cell_index ORDER BY (a.dem - b.dem) / s.dist DESC, s.k) AS n FROM cells a, steps s, cells b WHERE b.r = a.r + s.dy AND b.c = a.c + s.dx AND a.dem > b.dem) WHERE n = 1) b ON a.cell_index = b.cell_index)"""
PATHS = "paths AS (SELECT cell_index, cell_index AS pos, 0 AS steps, 0.0::DOUBLE AS length FROM pointer UNION ALL SELECT p.cell_index, e.down, p.steps + 1, p.length + e.dist FROM paths p JOIN pointer e ON p.pos = e.cell_index WHERE e.down IS NOT NULL)"
GRID = (CELLS, STEPS, POINTER)


def network(spark, sf_dir):
    """The reaches as a graph: cell_index, down (null where water leaves the basin)."""
    r = reaches(spark, sf_dir)
    return r.select(F.col("reach").alias("cell_index"), F.when(F.col("receive") > 0, F.col("receive")).alias("down"))


def edges(spark, sf_dir):
    return grid.flow_edges(cells(spark, sf_dir), CELL_M, COLS)


@query("SELECT cell_index, CASE WHEN k IS NULL THEN 0 ELSE 1 << k END AS code FROM pointer", *GRID)
def d8_pointer(spark, sf_dir):
    return grid.d8_pointer(cells(spark, sf_dir), CELL_M).select("cell_index", "code")


@query("SELECT p.cell_index, CASE WHEN p.down IS NULL THEN -2 WHEN m.cell_index IS NULL THEN -1 ELSE p.down END AS flow_path FROM pointer p LEFT JOIN (SELECT cell_index FROM cells WHERE soil <> 'P') m ON p.down = m.cell_index", *GRID)
def flow_path(spark, sf_dir):
    """-2 without a way down, -1 where it leaves the mask."""
    mask = cells(spark, sf_dir).filter("soil <> 'P'").select(F.col("cell_index").alias("down"), F.lit(True).alias("inside"))
    e = edges(spark, sf_dir).join(mask, "down", "left")
    return e.select("cell_index", F.when(F.col("down").isNull(), -2).when(F.col("inside").isNull(), -1).otherwise(F.col("down")).cast("long").alias("flow_path"))


@query("SELECT cell_index, row_number() OVER (ORDER BY acc, cell_index) - 1 AS flow_order FROM cells", CELLS)
def flow_order(spark, sf_dir):
    """Ranks by accumulation, in ranges of equal size, as most cells have little of it."""
    return grid.rank_rows(cells(spark, sf_dir).select("acc", "cell_index"), "acc", "cell_index", name="flow_order", start=0).select("cell_index", "flow_order")


@query("SELECT cell_index, dense AS new_id FROM cells JOIN (SELECT field, row_number() OVER (ORDER BY min(cell_index)) AS dense FROM cells GROUP BY field) USING (field)", CELLS)
def dense_reorder(spark, sf_dir):
    """Zone ids from 1 in the order in which a row-major scan meets them."""
    c = cells(spark, sf_dir)
    ids = c.groupBy("field").agg(F.min("cell_index").alias("first"))
    return c.join(grid.rank_rows(ids, "first", name="new_id").select("field", "new_id"), "field").select("cell_index", "new_id")


@query("SELECT r, c, row_number() OVER (ORDER BY r, c) - 1 AS valid_index FROM cells WHERE soil <> 'P'", CELLS)
def cell_enumeration(spark, sf_dir):
    c = cells(spark, sf_dir).filter("soil <> 'P'")
    return grid.number_rows(c, "r", "c", name="valid_index", start=0).select("r", "c", "valid_index")


@query("SELECT r, c, field FROM cells WHERE (r, c) NOT IN (SELECT (a.r, a.c) FROM cells a, steps s, cells b WHERE b.r = a.r + s.dy AND b.c = a.c + s.dx AND a.subbasin = b.subbasin GROUP BY a.r, a.c HAVING count(*) = 8)", CELLS, STEPS)
def border_cells(spark, sf_dir):
    c = cells(spark, sf_dir)
    return grid.border_cells(c, "subbasin").join(c.select("r", "c", "field"), ["r", "c"]).select("r", "c", "field")


INFLOW = "inflow AS (SELECT p.cell_index, p.down FROM pointer p JOIN cells a ON p.cell_index = a.cell_index JOIN cells b ON p.down = b.cell_index WHERE a.is_stream AND b.is_stream)"


@query(
    """SELECT DISTINCT cell_index FROM (SELECT cell_index FROM inflow WHERE down IN (SELECT down FROM inflow GROUP BY down HAVING count(*) > 1)
    UNION ALL SELECT p.cell_index FROM pointer p JOIN cells a ON p.cell_index = a.cell_index LEFT JOIN cells b ON p.down = b.cell_index WHERE a.is_stream AND NOT coalesce(b.is_stream, FALSE))""",
    *GRID, INFLOW,
)
def pour_points(spark, sf_dir):
    """Stream cells that flow into a confluence, and the last cells of streams."""
    s = cells(spark, sf_dir).filter("is_stream").select("cell_index")
    e = edges(spark, sf_dir).join(s, "cell_index", "left_semi")
    inside = e.join(s.select(F.col("cell_index").alias("down")), "down", "left_semi")
    meet = inside.groupBy("down").agg(F.count("*").alias("n")).filter("n > 1")
    last = e.join(inside.select("cell_index"), "cell_index", "left_anti").select("cell_index")
    return inside.join(meet, "down", "left_semi").select("cell_index").union(last)


@query("SELECT cell_index, arg_max(pos, steps) AS root, CAST(max(steps) AS BIGINT) AS steps, round(max(length), 4) AS length FROM paths GROUP BY cell_index", *GRID, PATHS)
def watershed_label(spark, sf_dir):
    """Each cell's outlet, and how far it is."""
    w = flow.jump(edges(spark, sf_dir).withColumnRenamed("dist", "length"), ["length"])
    return w.select("cell_index", "root", "steps", F.round("length", 4).alias("length"))


STOPPED = "spaths AS (SELECT cell_index, cell_index AS pos, 0 AS steps, 0.0::DOUBLE AS length FROM pointer UNION ALL SELECT p.cell_index, e.down, p.steps + 1, p.length + e.dist FROM spaths p JOIN pointer e ON p.pos = e.cell_index JOIN cells x ON p.pos = x.cell_index WHERE e.down IS NOT NULL AND NOT x.is_stream)"


def to_stream(spark, sf_dir, sums):
    c = cells(spark, sf_dir)
    e = flow.until(edges(spark, sf_dir), c.filter("is_stream"))
    e = e.withColumn("dist", F.when(F.col("down").isNull(), 0.0).otherwise(F.col("dist")))
    return flow.jump(e, sums)


@query("SELECT cell_index, round(max(length), 4) AS distance, arg_max(pos, steps) AS target FROM spaths GROUP BY cell_index", *GRID, STOPPED)
def distance_to_reach(spark, sf_dir):
    return to_stream(spark, sf_dir, ["dist"]).select("cell_index", F.round("dist", 4).alias("distance"), F.col("root").alias("target"))


@query("SELECT t.cell_index, round(a.dem - b.dem, 2) AS fall FROM (SELECT cell_index, arg_max(pos, steps) AS target FROM spaths GROUP BY cell_index) t JOIN cells a ON t.cell_index = a.cell_index JOIN cells b ON t.target = b.cell_index WHERE b.is_stream", *GRID, STOPPED)
def elevation_drop(spark, sf_dir):
    c = cells(spark, sf_dir)
    low = c.filter("is_stream").select(F.col("cell_index").alias("root"), F.col("dem").alias("low"))
    return to_stream(spark, sf_dir, ["dist"]).join(low, "root").join(c.select("cell_index", "dem"), "cell_index").select("cell_index", F.round(F.col("dem") - F.col("low"), 2).alias("fall"))


@query("SELECT target AS stream_cell, count(*) AS n_cells FROM (SELECT cell_index, arg_max(pos, steps) AS target FROM spaths GROUP BY cell_index) t JOIN cells b ON t.target = b.cell_index WHERE b.is_stream GROUP BY target", *GRID, STOPPED)
def link_outlets(spark, sf_dir):
    """The stream cell that each cell is linked to, with its number of cells."""
    s = cells(spark, sf_dir).filter("is_stream").select(F.col("cell_index").alias("root"))
    return to_stream(spark, sf_dir, ["dist"]).join(s, "root", "left_semi").groupBy(F.col("root").alias("stream_cell")).agg(F.count("*").alias("n_cells"))


TRAVEL = "tpaths AS (SELECT p.cell_index, p.cell_index AS pos, (x.texture * 0.5)::DOUBLE AS t FROM pointer p JOIN cells x ON p.cell_index = x.cell_index UNION ALL SELECT p.cell_index, e.down, p.t + y.texture * 0.5 FROM tpaths p JOIN pointer e ON p.pos = e.cell_index JOIN cells x ON p.pos = x.cell_index JOIN cells y ON e.down = y.cell_index WHERE e.down IS NOT NULL AND NOT x.is_stream)"


@query("SELECT cell_index, round(max(t) * 10 / 3600, 6) AS hours FROM tpaths GROUP BY cell_index", *GRID, TRAVEL)
def travel_time(spark, sf_dir):
    """Sum of the cells' terms from a cell to its stream, both included, in hours."""
    c = cells(spark, sf_dir)
    e = flow.until(edges(spark, sf_dir), c.filter("is_stream")).join(c.select("cell_index", (F.col("texture") * 0.5).alias("t")), "cell_index")
    return flow.jump(e, ["t"]).select("cell_index", F.round(F.col("t") * 10 / 3600, 6).alias("hours"))


@query("SELECT pos AS cell_index, count(*) AS n_cells, round(avg(x.slope_deg), 5) AS mean_slope, round(max(length), 4) AS longest FROM paths p JOIN cells x ON p.cell_index = x.cell_index GROUP BY pos", *GRID, PATHS)
def flow_accumulation(spark, sf_dir):
    """Of each cell's upstream area, itself included: cells, mean of a value, longest path."""
    c = cells(spark, sf_dir).select("cell_index", F.lit(1).cast("long").alias("n_cells"), F.col("slope_deg").alias("total"))
    up = flow.tree(edges(spark, sf_dir).join(c, "cell_index"), ["n_cells", "total"], "dist")
    return up.select("cell_index", "n_cells", F.round(F.col("total") / F.col("n_cells"), 5).alias("mean_slope"), F.round("longest", 4).alias("longest"))


@query(
    "SELECT exit_cell, count(*) AS n_cells, round(count(*) * 0.01, 4) AS area_ha, round(max(length), 4) AS length FROM (SELECT cell_index, arg_max(pos, steps) AS exit_cell, max(length) AS length FROM zpaths GROUP BY cell_index) GROUP BY exit_cell",
    *GRID, "zpaths AS (SELECT cell_index, cell_index AS pos, 0 AS steps, 0.0::DOUBLE AS length FROM pointer UNION ALL SELECT p.cell_index, e.down, p.steps + 1, p.length + e.dist FROM zpaths p JOIN pointer e ON p.pos = e.cell_index JOIN cells x ON p.pos = x.cell_index JOIN cells y ON e.down = y.cell_index WHERE x.subbasin = y.subbasin)",
)
def buffer_parts(spark, sf_dir):
    """The part of a zone that leaves it through one cell: size and longest way to it."""
    c = cells(spark, sf_dir).select("cell_index", "subbasin")
    e = edges(spark, sf_dir).join(c, "cell_index").join(c.select(F.col("cell_index").alias("down"), F.col("subbasin").alias("next")), "down", "left")
    own = F.col("subbasin") == F.col("next")
    e = e.select("cell_index", F.when(own, F.col("down")).alias("down"), F.when(own, F.col("dist")).otherwise(0.0).alias("length"))
    return flow.jump(e, ["length"]).groupBy(F.col("root").alias("exit_cell")).agg(F.count("*").alias("n_cells"), F.round(F.count("*") * 0.01, 4).alias("area_ha"), F.round(F.max("length"), 4).alias("length"))


@query("SELECT c.cell_index, coalesce(CASE WHEN c.landuse <> 3 THEN c.subbasin END, f.first_sub) AS subbasin FROM cells c LEFT JOIN (SELECT field, arg_min(subbasin, cell_index) AS first_sub FROM cells WHERE landuse <> 3 GROUP BY field) f ON c.field = f.field", CELLS)
def repair_subbasin(spark, sf_dir):
    """Cells without a subbasin take the first that their structure meets."""
    c = cells(spark, sf_dir).select("cell_index", "field", F.when(F.col("landuse") != 3, F.col("subbasin")).alias("own"))
    first = c.filter("own is not null").groupBy("field").agg(F.min_by("own", "cell_index").alias("first_sub"))
    return c.join(first, "field", "left").select("cell_index", F.coalesce("own", "first_sub").alias("subbasin"))


BELOW = "below AS (SELECT reach AS node, receive AS below, 1 AS rank FROM reaches UNION ALL SELECT b.node, r.receive, b.rank + 1 FROM below b JOIN reaches r ON b.below = r.reach)"


@query("SELECT node, below, CAST(rank AS BIGINT) AS rank FROM below", REACHES, BELOW)
def reach_lookup(spark, sf_dir):
    """All reaches downstream of each with their rank, and the terminal 0."""
    return flow.closure(reaches(spark, sf_dir), "reach", "receive")


@query("SELECT r.reach, coalesce(max(b.rank), 0) + 1 AS to_outlet FROM reaches r LEFT JOIN below b ON r.reach = b.node AND b.below > 0 GROUP BY r.reach", REACHES, BELOW)
def network_levels(spark, sf_dir):
    r = reaches(spark, sf_dir)
    e = r.select(F.col("reach").alias("cell_index"), F.when(F.col("receive") > 0, F.col("receive")).alias("down"))
    return flow.jump(e, []).select(F.col("cell_index").alias("reach"), (F.col("steps") + 1).alias("to_outlet"))


@query("SELECT subbasin, receive FROM (SELECT c.subbasin, coalesce(d.subbasin, 0) AS receive, row_number() OVER (PARTITION BY c.subbasin ORDER BY c.acc DESC, c.cell_index) AS n FROM cells c JOIN pointer p ON c.cell_index = p.cell_index LEFT JOIN cells d ON p.down = d.cell_index WHERE d.subbasin IS NULL OR d.subbasin <> c.subbasin) WHERE n = 1", *GRID)
def receiving_reach(spark, sf_dir):
    """Where the greatest accumulation leaves a subbasin."""
    c = cells(spark, sf_dir).select("cell_index", "subbasin", "acc")
    e = edges(spark, sf_dir).join(c, "cell_index").join(c.select(F.col("cell_index").alias("down"), F.col("subbasin").alias("next")), "down", "left")
    out = e.filter("next is null or next <> subbasin")
    best = out.groupBy("subbasin").agg(F.max(F.struct("acc", (-F.col("cell_index")).alias("m"), F.coalesce("next", F.lit(0)).alias("receive"))).alias("b"))
    return best.select("subbasin", "b.receive")


@query(
    "SELECT reach, coalesce(min_reach, last_reach) AS drain_reach FROM (SELECT a.node AS reach, arg_min(a.below, a.rank) FILTER (r.contribution_ha >= 10) AS min_reach, arg_max(a.below, a.rank) AS last_reach FROM (SELECT reach AS node, reach AS below, 0 AS rank FROM reaches UNION ALL SELECT * FROM below) a JOIN reaches r ON a.below = r.reach GROUP BY a.node)",
    REACHES, BELOW,
)
def tile_drain_reach(spark, sf_dir):
    """The first reach downstream, itself included, with 10 ha at least; else the last."""
    r = reaches(spark, sf_dir)
    way = flow.closure(r, "reach", "receive").unionByName(r.select(F.col("reach").alias("node"), F.col("reach").alias("below"), F.lit(0).cast("long").alias("rank")))
    big = way.join(r.select(F.col("reach").alias("below"), "contribution_ha"), "below")
    return big.groupBy(F.col("node").alias("reach")).agg(F.coalesce(F.min_by("below", F.when(F.col("contribution_ha") >= 10, F.col("rank"))), F.max_by("below", "rank")).alias("drain_reach"))


@query("SELECT s_suppkey AS subbasin, coalesce(arg_max(p_partkey, l_orderkey * 10 + l_linenumber) FILTER (p_size = 1), 0) AS type_1, coalesce(arg_max(p_partkey, l_orderkey * 10 + l_linenumber) FILTER (p_size = 2), 0) AS type_2, coalesce(arg_max(p_partkey, l_orderkey * 10 + l_linenumber) FILTER (p_size = 3), 0) AS type_3 FROM supplier LEFT JOIN (SELECT l_suppkey, max(p_partkey) AS p_partkey, l_orderkey, l_linenumber, p_size FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) ON s_suppkey = l_suppkey GROUP BY s_suppkey")
def reach_bmp_pivot(spark, sf_dir):
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").filter("p_size <= 3").select("p_partkey", "p_size")
    rows = li.join(p, li["l_partkey"] == p["p_partkey"]).groupBy("l_suppkey", "l_orderkey", "l_linenumber", "p_size").agg(F.max("p_partkey").alias("p_partkey"))
    rows = rows.select(F.col("l_suppkey").alias("subbasin"), "p_size", "p_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    keys = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("subbasin"))
    return relations.pivot_types(rows, "subbasin", "p_size", "p_partkey", "seq", [1, 2, 3], keys)


@query("SELECT reach, CASE WHEN reach % 3 = 0 THEN reach % 5 + 2 ELSE 1 END AS stream_order FROM reaches", REACHES)
def order_with_default(spark, sf_dir):
    r = reaches(spark, sf_dir)
    known = r.filter("reach % 3 = 0").select("reach", (F.col("reach") % 5 + 2).alias("o"))
    return r.select("reach").join(known, "reach", "left").select("reach", F.coalesce("o", F.lit(1)).alias("stream_order"))


@query("SELECT w.reach AS wascob, d.receive AS drain, o.receive AS outlet, c.c_mktsegment AS field FROM reaches w LEFT JOIN reaches d ON w.reach = d.reach LEFT JOIN reaches o ON d.receive = o.reach LEFT JOIN customer c ON o.reach = c.c_custkey", REACHES)
def wascob_chain(spark, sf_dir):
    r = reaches(spark, sf_dir).select("reach", "receive")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o"), F.col("c_mktsegment").alias("field"))
    d = r.select(F.col("reach").alias("wascob"), F.col("receive").alias("drain"))
    o = r.select(F.col("reach").alias("o"), F.col("receive").alias("outlet"))
    return d.join(o, d["drain"] == o["o"], "left").join(c, "o", "left").select("wascob", "drain", "outlet", "field")


@query(
    """SELECT reach, o AS stream_order FROM (SELECT reach, max(CAST(o AS INTEGER)) AS o FROM up GROUP BY reach)""",
    REACHES,
    """leaf AS (SELECT reach FROM reaches WHERE reach NOT IN (SELECT receive FROM reaches)),
 up(reach, o) USING KEY (reach) AS (SELECT reach, 1 FROM leaf UNION
 SELECT receive, max(o) + CASE WHEN count(*) FILTER (o = m) >= 2 THEN 1 ELSE 0 END FROM (SELECT p.receive, u.o, max(u.o) OVER (PARTITION BY p.receive) AS m,
 count(*) OVER (PARTITION BY p.receive) AS have, (SELECT count(*) FROM reaches q WHERE q.receive = p.receive) AS need
 FROM recurring.up u JOIN reaches p ON u.reach = p.reach WHERE p.receive > 0) WHERE have = need AND receive NOT IN (SELECT reach FROM recurring.up) GROUP BY receive)""",
)
def strahler_order(spark, sf_dir):
    """By rake and compress over the reach network."""
    return contract.contract(network(spark, sf_dir)).select(F.col("cell_index").alias("reach"), F.col("order").alias("stream_order"))


@query(
    """SELECT r.reach, d.depth, h.height FROM reaches r JOIN (SELECT r.reach, CAST(coalesce(max(b.rank), 0) AS BIGINT) AS depth FROM reaches r LEFT JOIN below b ON r.reach = b.node AND b.below > 0 GROUP BY r.reach) d ON r.reach = d.reach
 JOIN (SELECT r.reach, CAST(coalesce(max(b.rank), 0) + 1 AS INTEGER) AS height FROM reaches r LEFT JOIN below b ON r.reach = b.below GROUP BY r.reach) h ON r.reach = h.reach""",
    REACHES, BELOW,
)
def network_order(spark, sf_dir):
    """Both directions of the network's levels: steps down to the outlet, and the longest way up to a headwater."""
    e = network(spark, sf_dir)
    up = contract.contract(e, contract.Height, "height")
    return flow.jump(e, []).select("cell_index", F.col("steps").alias("depth")).join(up, "cell_index").select(F.col("cell_index").alias("reach"), "depth", "height")
