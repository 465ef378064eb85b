"""Station weights and climate series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relations, weights
from ..sources.views import CELLS, READINGS, STATIONS, cells, readings, stations
from ..streaming.readings import windowed_sums
from .registry import query

NEAR = "allnear AS (SELECT cell_index, idx, sx - c AS dx, sy - r AS dy, (sx - c) * (sx - c) + (sy - r) * (sy - r) AS d2 FROM cells, stations)"
#: Cells within which a station counts.
RADIUS = 24.0
WITHIN = "near AS (SELECT * FROM allnear WHERE d2 < 576)"
IDW = """idw AS (SELECT cell_index, idx, raw / sum(raw) OVER (PARTITION BY cell_index) AS weight FROM (SELECT *, CASE WHEN min(d2) OVER (PARTITION BY cell_index) = 0 THEN CASE WHEN d2 = 0 THEN 1.0 ELSE 0.0 END ELSE 1 / d2 END AS raw FROM near))"""


def _nearest(spark, sf_dir, k):
    return weights.nearest(cells(spark, sf_dir), stations(spark, sf_dir), k, 16.0)


@query("SELECT cell_index, idx, round(weight, 6) AS weight FROM idw", CELLS, STATIONS, NEAR, WITHIN, IDW)
def idw_weights(spark, sf_dir):
    return weights.idw(cells(spark, sf_dir), stations(spark, sf_dir), RADIUS).withColumn("weight", F.round("weight", 6))


@query(
    """SELECT cell_index, idx, round((a + CASE WHEN row_number() OVER (PARTITION BY cell_index ORDER BY f DESC, idx) = 1 THEN 10000 - sum(a) OVER (PARTITION BY cell_index) ELSE 0 END) / 10000.0, 4) AS weight
    FROM (SELECT *, CASE WHEN w - a <= 0.5 THEN round(w - a, 6) ELSE 0 END AS f FROM (SELECT *, floor(w) AS a FROM (SELECT cell_index, idx, round(weight * 10000, 6) AS w FROM idw)))""",
    CELLS, STATIONS, NEAR, WITHIN, IDW,
)
def idw_quantised(spark, sf_dir):
    return weights.weights_by("inverse_distance", cells(spark, sf_dir), stations(spark, sf_dir), RADIUS).withColumn("weight", F.round("weight", 4))


@query("SELECT cell_index, idx FROM (SELECT *, row_number() OVER (PARTITION BY cell_index ORDER BY d2, idx) AS k FROM allnear) WHERE k = 1", CELLS, STATIONS, NEAR)
def thiessen(spark, sf_dir):
    return weights.thiessen(_nearest(spark, sf_dir, 1))


@query("SELECT idx, round(CASE WHEN row_number() OVER (ORDER BY idx) = n THEN 10000 - (10000 // n) * (n - 1) ELSE 10000 // n END / 10000.0, 4) AS weight FROM (SELECT idx, count(*) OVER () AS n FROM stations)", STATIONS)
def uniform_weights(spark, sf_dir):
    return weights.uniform(stations(spark, sf_dir)).withColumn("weight", F.round("weight", 4))


@query(
    """SELECT cell_index, idx, round(raw / sum(raw) OVER (PARTITION BY cell_index), 6) AS weight FROM (SELECT *, CASE WHEN min(d2) OVER (PARTITION BY cell_index) = 0 THEN CASE WHEN d2 = 0 THEN 1.0 ELSE 0.0 END ELSE 1 / d2 END AS raw
    FROM (SELECT *, row_number() OVER (PARTITION BY cell_index, dx >= 0, dy >= 0 ORDER BY d2, idx) AS k FROM near) WHERE k = 1)""",
    CELLS, STATIONS, NEAR, WITHIN,
)
def quadrant_weights(spark, sf_dir):
    return weights.by_quadrant(cells(spark, sf_dir), stations(spark, sf_dir), RADIUS).withColumn("weight", F.round("weight", 6))


@query(
    """SELECT cell_index, unnest([i1, i2, i3]) AS idx, round(unnest(CASE WHEN whole > 0 AND a1 + a2 + a3 <= whole + 1e-9 THEN [a1 / whole, a2 / whole, a3 / whole] ELSE [1.0, 0.0, 0.0] END), 6) AS weight FROM
    (SELECT cell_index, i1, i2, i3, abs(x2 * y3 - x3 * y2) AS a1, abs(x1 * y3 - x3 * y1) AS a2, abs(x1 * y2 - x2 * y1) AS a3, abs((x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1)) AS whole FROM
    (SELECT cell_index, max(idx) FILTER (k = 1) AS i1, max(idx) FILTER (k = 2) AS i2, max(idx) FILTER (k = 3) AS i3, max(dx) FILTER (k = 1) AS x1, max(dx) FILTER (k = 2) AS x2, max(dx) FILTER (k = 3) AS x3,
    max(dy) FILTER (k = 1) AS y1, max(dy) FILTER (k = 2) AS y2, max(dy) FILTER (k = 3) AS y3 FROM (SELECT *, row_number() OVER (PARTITION BY cell_index ORDER BY d2, idx) AS k FROM allnear) GROUP BY cell_index))""",
    CELLS, STATIONS, NEAR,
)
def triangle_weights(spark, sf_dir):
    return weights.triangle(_nearest(spark, sf_dir, 3)).withColumn("weight", F.round("weight", 6))


QUADRANT = """quad AS (SELECT cell_index, idx, raw / sum(raw) OVER (PARTITION BY cell_index) AS weight FROM (SELECT *, CASE WHEN min(d2) OVER (PARTITION BY cell_index) = 0
 THEN CASE WHEN d2 = 0 THEN 1.0 ELSE 0.0 END ELSE 1 / d2 END AS raw FROM (SELECT *, row_number() OVER (PARTITION BY cell_index, dx >= 0, dy >= 0 ORDER BY d2, idx) AS k FROM near) WHERE k = 1))"""
QUANTISED = """SELECT cell_index, idx, round((a + CASE WHEN row_number() OVER (PARTITION BY cell_index ORDER BY f DESC, idx) = 1 THEN 10000 - sum(a) OVER (PARTITION BY cell_index) ELSE 0 END) / 10000.0, 4) AS weight
 FROM (SELECT *, CASE WHEN w - a <= 0.5 THEN round(w - a, 6) ELSE 0 END AS f FROM (SELECT *, floor(w) AS a FROM (SELECT cell_index, idx, round(weight * 10000, 6) AS w FROM quad)))"""


@query(QUANTISED, CELLS, STATIONS, NEAR, WITHIN, QUADRANT)
def quadrant_quantised(spark, sf_dir):
    """By the dispatcher of methods."""
    return weights.weights_by("grid", cells(spark, sf_dir), stations(spark, sf_dir), RADIUS).withColumn("weight", F.round("weight", 4))


@query("SELECT subbasin, idx, round(count(*) * 1.0 / any_value(n), 4) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY cell_index ORDER BY d2, idx) AS k FROM allnear) t JOIN cells USING (cell_index) JOIN (SELECT subbasin, count(*) AS n FROM cells GROUP BY subbasin) USING (subbasin) WHERE k = 1 GROUP BY subbasin, idx", CELLS, STATIONS, NEAR)
def subarea_station_shares(spark, sf_dir):
    """The dispatcher with subareas as targets."""
    return weights.weights_by("thiessen", cells(spark, sf_dir), stations(spark, sf_dir), 16.0, "subbasin").withColumn("weight", F.round("weight", 4))


@query("SELECT type, min(type) OVER (PARTITION BY s) AS first, len(s) AS n FROM (SELECT type, list_sort(list(DISTINCT station % 5)) AS s FROM readings GROUP BY type)", READINGS)
def weight_reuse(spark, sf_dir):
    """Types that are read at the same stations share their weights."""
    return weights.same_stations(readings(spark, sf_dir).select("type", (F.col("station") % 5).alias("idx")))


@query("SELECT subbasin, idx, round(avg(weight), 6) AS weight FROM idw JOIN cells USING (cell_index) GROUP BY subbasin, idx", CELLS, STATIONS, NEAR, WITHIN, IDW)
def unit_climate_weight(spark, sf_dir):
    """Weights of subareas in long form: one aggregation instead of a pass for each station."""
    w = weights.idw(cells(spark, sf_dir), stations(spark, sf_dir), RADIUS)
    return w.join(cells(spark, sf_dir).select("cell_index", "subbasin"), "cell_index").groupBy("subbasin", "idx").agg(F.round(F.avg("weight"), 6).alias("weight"))


@query(
    """SELECT point_id, r, c, d2 FROM (SELECT point_id, r, c, d2, row_number() OVER (PARTITION BY point_id ORDER BY d2, r, c) AS k FROM
    (SELECT s_suppkey AS point_id, r, c, CAST((s_suppkey * 13 % 118 - r) * (s_suppkey * 13 % 118 - r) + (s_suppkey * 29 % 128 - c) * (s_suppkey * 29 % 128 - c) AS BIGINT) AS d2 FROM supplier, cells WHERE is_stream) WHERE d2 <= 400) WHERE k = 1""",
    CELLS,
)
def snap_nearest(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("point_id"), (F.col("s_suppkey") * 13 % 118).alias("pr"), (F.col("s_suppkey") * 29 % 128).alias("pc"))
    return weights.snap(p, cells(spark, sf_dir).filter("is_stream"), 20)


@query("SELECT greatest(max(a), DATE '1900-01-01') AS start, least(min(b), DATE '2100-12-31') AS \"end\" FROM (SELECT type, min(day) AS a, max(day) AS b FROM readings GROUP BY type)", READINGS)
def common_period(spark, sf_dir):
    return relations.common_period(readings(spark, sf_dir))


@query("SELECT type, count(DISTINCT station) AS n_stations, min(station) AS first_station FROM readings GROUP BY type", READINGS)
def stations_by_type(spark, sf_dir):
    return readings(spark, sf_dir).select("type", "station").distinct().groupBy("type").agg(F.count("*").alias("n_stations"), F.min("station").alias("first_station"))


@query("SELECT station, CAST(year(day) AS INTEGER) AS year, CAST(month(day) AS INTEGER) AS month, round(sum(value), 3) AS total FROM readings GROUP BY ALL", READINGS)
def period_sums(spark, sf_dir):
    return readings(spark, sf_dir).groupBy("station", F.year("day").alias("year"), F.month("day").alias("month")).agg(F.round(F.sum("value"), 3).alias("total"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL")
def reading_windows(spark, sf_dir):
    """The streaming aggregation, on the stored table."""
    w = windowed_sums(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 3).alias("total"))


@query("SELECT row_number() OVER (ORDER BY type, station) AS id, type, station, n, first_day FROM (SELECT type, station, count(*) AS n, min(day) AS first_day FROM readings GROUP BY type, station)", READINGS)
def station_migration(spark, sf_dir):
    """Tables of single stations become one table by type, with new ids."""
    from ..operators.grid import number_rows

    rows = readings(spark, sf_dir).groupBy("type", "station").agg(F.count("*").alias("n"), F.min("day").alias("first_day"))
    return number_rows(rows, "type", "station", name="id")
