"""Zonal and overlay queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid, relations, zonal
from ..sources.views import CELL_HA, CELLS, cells, table
from .registry import query


@query(
    """SELECT row_number() OVER (ORDER BY subbasin, field) AS row_id, field, subbasin, round(area_ha, 4) AS area_ha,
    round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY field), 6) AS to_field, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY subbasin), 6) AS to_subbasin FROM pairs""",
    CELLS, "pairs AS (SELECT field, subbasin, count(*) AS n, count(*) * 0.01 AS area_ha FROM cells GROUP BY field, subbasin)",
)
def overlay_field_subbasin(spark, sf_dir):
    pairs = zonal.overlay(cells(spark, sf_dir), "field", "subbasin", CELL_HA)
    return pairs.select("row_id", "field", "subbasin", F.round("area_ha", 4).alias("area_ha"), F.round("to_field", 6).alias("to_field"), F.round("to_subbasin", 6).alias("to_subbasin"))


@query("SELECT landuse, round(count(*) * 0.01, 4) AS area_ha FROM cells GROUP BY landuse", CELLS)
def category_area(spark, sf_dir):
    return zonal.category_area(cells(spark, sf_dir), "landuse", CELL_HA).withColumn("area_ha", F.round("area_ha", 4))


@query("SELECT subbasin, round(avg(dem), 3) AS mean, round(median(dem), 3) AS median, min(dem) AS min, max(dem) AS max, round(max(dem) - min(dem), 3) AS range, round(stddev_pop(dem), 3) AS stdev, round(sum(dem), 2) AS total FROM cells GROUP BY subbasin", CELLS)
def zonal_stats(spark, sf_dir):
    s = zonal.zonal_stats(cells(spark, sf_dir), "subbasin", "dem")
    return s.select("subbasin", *[F.round(c, 3).alias(c) for c in ("mean", "median", "range", "stdev")], "min", "max", F.round("total", 2).alias("total"))


@query("SELECT field, landuse, n AS n_cells FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, first) AS k FROM (SELECT field, landuse, count(*) AS n, min(cell_index) AS first FROM cells GROUP BY field, landuse)) WHERE k = 1", CELLS)
def zone_majority(spark, sf_dir):
    return zonal.majority(cells(spark, sf_dir), "field", "landuse")


@query("SELECT field, subbasin, n AS n_cells FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, first) AS k FROM (SELECT field, subbasin, count(*) AS n, min(cell_index) AS first FROM cells GROUP BY field, subbasin)) WHERE k = 1", CELLS)
def max_area_class(spark, sf_dir):
    return zonal.majority(cells(spark, sf_dir), "field", "subbasin")


@query("SELECT subbasin, round(count(*) * 0.01, 4) AS area_ha, max(acc) AS max_acc, round(avg(slope_deg), 4) AS mean_slope, round(avg(dem), 3) AS mean_dem, round(avg(texture), 4) AS mean_texture FROM cells GROUP BY subbasin", CELLS)
def subbasin_info(spark, sf_dir):
    return cells(spark, sf_dir).groupBy("subbasin").agg(F.round(F.count("*") * CELL_HA, 4).alias("area_ha"), F.max("acc").alias("max_acc"), F.round(F.avg("slope_deg"), 4).alias("mean_slope"), F.round(F.avg("dem"), 3).alias("mean_dem"), F.round(F.avg("texture"), 4).alias("mean_texture"))


@query("SELECT landuse, min(cell_index) AS first_seen FROM cells GROUP BY landuse", CELLS)
def unique_values(spark, sf_dir):
    return cells(spark, sf_dir).groupBy("landuse").agg(F.min("cell_index").alias("first_seen"))


@query("SELECT count(*) AS n_cells FROM cells WHERE dem > 0", CELLS)
def valid_cell_count(spark, sf_dir):
    return cells(spark, sf_dir).filter("dem > 0").agg(F.count("*").alias("n_cells"))


@query("SELECT max(dem) AS max_dem FROM cells", CELLS)
def global_max(spark, sf_dir):
    return cells(spark, sf_dir).agg(F.max("dem").alias("max_dem"))


@query("SELECT cell_index, field, p_size AS new_value FROM cells LEFT JOIN part ON field = p_partkey", CELLS)
def reclassify_lookup(spark, sf_dir):
    return zonal.reclassify(cells(spark, sf_dir), "field", table(spark, sf_dir, "part"), "p_partkey", "p_size").select("cell_index", "field", "new_value")


@query("SELECT DISTINCT CAST(field AS BIGINT) AS id FROM cells WHERE field NOT IN (SELECT p_size FROM part)", CELLS)
def missing_lookup_ids(spark, sf_dir):
    return zonal.missing_ids(cells(spark, sf_dir), "field", table(spark, sf_dir, "part"), "p_size")


@query("SELECT cell_index, CASE WHEN dem > 200000 THEN 1 ELSE 0 END AS high FROM cells WHERE soil <> 'P' AND landuse > 0", CELLS)
def con_mask(spark, sf_dir):
    c = cells(spark, sf_dir).filter("soil <> 'P' and landuse > 0")
    return c.select("cell_index", grid.con(F.col("dem") > 200_000, F.lit(1), F.lit(0)).alias("high"))


@query("SELECT cell_index, round(CASE WHEN is_stream THEN dem - 10 ELSE dem END, 2) AS burned FROM cells", CELLS)
def burn_dem(spark, sf_dir):
    return cells(spark, sf_dir).select("cell_index", F.round(F.when(F.col("is_stream"), F.col("dem") - 10).otherwise(F.col("dem")), 2).alias("burned"))


@query("SELECT cell_index, landuse FROM cells WHERE landuse IN (2, 4)", CELLS)
def filter_by_values(spark, sf_dir):
    return cells(spark, sf_dir).filter(F.col("landuse").isin(2, 4)).select("cell_index", "landuse")


@query("SELECT field AS farm, field, round(count(*) * 0.01, 4) AS area_ha, 1.0::DOUBLE AS to_farm, 1.0::DOUBLE AS to_field FROM cells GROUP BY field", CELLS)
def identity_fields(spark, sf_dir):
    """Where farms are the fields, every pair is the identity."""
    a = zonal.category_area(cells(spark, sf_dir), "field", CELL_HA)
    return a.select(F.col("field").alias("farm"), "field", F.round("area_ha", 4).alias("area_ha"), F.lit(1.0).alias("to_farm"), F.lit(1.0).alias("to_field"))


@query("SELECT l_partkey, l_suppkey, round(avg(l_quantity), 4) AS mean, min(l_quantity) AS low, max(l_quantity) AS high, count(*) AS n FROM lineitem GROUP BY l_partkey, l_suppkey")
def pair_means(spark, sf_dir):
    """A raster with several values to a cell, reduced to one."""
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.round(F.avg(q), 4).alias("mean"), F.min(q).alias("low"), F.max(q).alias("high"), F.count("*").alias("n"))


@query("SELECT subbasin, count(*) AS n, round(avg(dem), 3) AS mean_dem, round(avg(slope_deg), 4) AS mean_slope, round(max(acc) * 0.01, 4) AS contribution_ha, round(sum(CASE WHEN soil = 'P' THEN 0.01 ELSE 0 END), 4) AS wetland_ha, round(sqrt(count(*) * 0.01 * 10000) / 10, 4) AS lateral_width FROM cells GROUP BY subbasin", CELLS)
def subarea_summary(spark, sf_dir):
    n = F.count("*")
    return cells(spark, sf_dir).groupBy("subbasin").agg(n.alias("n"), F.round(F.avg("dem"), 3).alias("mean_dem"), F.round(F.avg("slope_deg"), 4).alias("mean_slope"), F.round(F.max("acc") * CELL_HA, 4).alias("contribution_ha"), F.round(F.sum(F.when(F.col("soil") == "P", CELL_HA).otherwise(0.0)), 4).alias("wetland_ha"), F.round(F.sqrt(n * CELL_HA * 10_000) / 10, 4).alias("lateral_width"))


@query("SELECT subbasin, landuse, round_even(n * 1.0 / sum(n) OVER (PARTITION BY subbasin), 4) AS fraction FROM (SELECT subbasin, landuse, count(*) AS n FROM cells GROUP BY subbasin, landuse)", CELLS)
def subarea_fractions(spark, sf_dir):
    pairs = cells(spark, sf_dir).groupBy("subbasin", "landuse").agg(F.count("*").alias("n"))
    total = pairs.groupBy("subbasin").agg(F.sum("n").alias("t"))
    return pairs.join(total, "subbasin").select("subbasin", "landuse", F.bround(F.col("n") / F.col("t"), 4).alias("fraction"))


@query("SELECT subbasin, round(avg(c * 10.0 + 5), 4) AS x, round(avg(r * 10.0 + 5), 4) AS y FROM cells GROUP BY subbasin", CELLS)
def subarea_centroid(spark, sf_dir):
    """The centroid of the dissolved cells of a zone."""
    return cells(spark, sf_dir).groupBy("subbasin").agg(F.round(F.avg(F.col("c") * 10.0 + 5), 4).alias("x"), F.round(F.avg(F.col("r") * 10.0 + 5), 4).alias("y"))


@query("SELECT r, c, cell_index, last_value(CASE WHEN landuse = 1 THEN NULL ELSE landuse END IGNORE NULLS) OVER (PARTITION BY r ORDER BY c ROWS UNBOUNDED PRECEDING) AS filled FROM cells", CELLS)
def forward_fill(spark, sf_dir):
    rows = cells(spark, sf_dir).select("r", "c", "cell_index", F.when(F.col("landuse") != 1, F.col("landuse")).alias("v"))
    return relations.forward_fill(rows, "r", ["c"], "v").select("r", "c", "cell_index", "filled")


@query("SELECT subbasin, least(round_even(sum(CASE WHEN texture % 4 IN (0, 1) THEN 14.142135623730951 ELSE 10.0 END), 0), 500.0) AS length_m FROM cells WHERE is_stream GROUP BY subbasin", CELLS)
def grass_waterway_length(spark, sf_dir):
    """Steps along stream cells, diagonal ones longer, capped at the reach's length (500 m)."""
    s = cells(spark, sf_dir).filter("is_stream")
    step = F.when((F.col("texture") % 4).isin(0, 1), 14.142135623730951).otherwise(10.0)
    return s.groupBy("subbasin").agg(F.least(F.bround(F.sum(step), 0), F.lit(500.0)).alias("length_m"))


@query("SELECT subbasin, texture, count(*) AS n, grouping(subbasin) AS g_sub, grouping(texture) AS g_tex FROM cells GROUP BY ROLLUP (subbasin, texture)", CELLS)
def zone_rollup(spark, sf_dir):
    return cells(spark, sf_dir).rollup("subbasin", "texture").agg(F.count("*").alias("n"), F.grouping("subbasin").cast("long").alias("g_sub"), F.grouping("texture").cast("long").alias("g_tex"))
