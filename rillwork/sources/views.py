
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLS = 128
CELL_M = 10.0
CELL_HA = CELL_M * CELL_M / 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each valid cell, all rasters as columns: nodata is NULL or no row."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    r, c = F.floor(key / COLS).cast("int"), (key % COLS).cast("int")
    return o.select(
        r.alias("r"), c.alias("c"), key.alias("cell_index"), F.col("o_totalprice").alias("dem"), (F.col("o_custkey") % 97 + 1).cast("int").alias("field"),
        (F.floor(r / 16) * 8 + F.floor(c / 16) + 1).cast("int").alias("subbasin"), F.substring("o_orderpriority", 1, 1).cast("int").alias("landuse"),
        F.col("o_orderstatus").alias("soil"), (F.col("o_custkey") % 45).cast("double").alias("slope_deg"), (key * 37 % 5000 + 1).cast("double").alias("acc"),
        ((key * 31 + F.col("o_custkey")) % 7 == 0).alias("is_stream"), (F.col("o_custkey") % 12 + 1).cast("int").alias("texture"),
    )


#: The same views for SQL, as common table expressions.
CELLS = """cells AS (SELECT CAST(o_orderkey // 128 AS INTEGER) AS r, CAST(o_orderkey % 128 AS INTEGER) AS c, o_orderkey AS cell_index, o_totalprice AS dem,
 CAST(o_custkey % 97 + 1 AS INTEGER) AS field, CAST((o_orderkey // 128) // 16 * 8 + (o_orderkey % 128) // 16 + 1 AS INTEGER) AS subbasin,
 CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS landuse, o_orderstatus AS soil, CAST(o_custkey % 45 AS DOUBLE) AS slope_deg,
 CAST(o_orderkey * 37 % 5000 + 1 AS DOUBLE) AS acc, (o_orderkey * 31 + o_custkey) % 7 = 0 AS is_stream, CAST(o_custkey % 12 + 1 AS INTEGER) AS texture FROM orders)"""


def reaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reach, receive (0: leaves the basin), contribution in ha."""
    c = table(spark, sf_dir, "customer")
    return c.filter("c_custkey > 0").select(F.col("c_custkey").alias("reach"), F.floor(F.col("c_custkey") / 2).cast("long").alias("receive"), (F.col("c_nationkey") * 1.5).alias("contribution_ha"), F.col("c_acctbal").alias("elevation"))


REACHES = "reaches AS (SELECT c_custkey AS reach, c_custkey // 2 AS receive, c_nationkey * 1.5 AS contribution_ha, c_acctbal AS elevation FROM customer WHERE c_custkey > 0)"


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx, x, y in cells: the suppliers, spread over the grid."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").cast("int").alias("idx"), (F.col("s_suppkey") * 37 % 128).cast("double").alias("sx"), (F.col("s_suppkey") * 1.125).alias("sy"))


STATIONS = "stations AS (SELECT CAST(s_suppkey AS INTEGER) AS idx, CAST(s_suppkey * 37 % 128 AS DOUBLE) AS sx, s_suppkey * 1.125::DOUBLE AS sy FROM supplier)"


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("type"), F.col("user_id").alias("station"), F.to_date("ts").alias("day"), "value")


READINGS = "readings AS (SELECT event_type AS type, user_id AS station, CAST(ts AS DATE) AS day, value FROM events)"


def seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """location, year, crop: one crop for each location and year."""
    o = table(spark, sf_dir, "orders")
    rows = o.select((F.col("o_custkey") % 400).cast("int").alias("location"), F.year("o_orderdate").alias("year"), F.substring("o_orderpriority", 1, 1).cast("int").alias("crop"), "o_orderkey")
    return rows.groupBy("location", "year").agg(F.min_by("crop", "o_orderkey").alias("crop"))


SEASONS = """seasons AS (SELECT location, year, arg_min(crop, o_orderkey) AS crop FROM (SELECT CAST(o_custkey % 400 AS INTEGER) AS location, CAST(year(o_orderdate) AS INTEGER) AS year,
 CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS crop, o_orderkey FROM orders) GROUP BY location, year)"""
