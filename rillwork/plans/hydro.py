"""Hydrologic columns: one projection each, no shuffle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hydrology as H
from ..sources.views import CELLS, cells, table
from .registry import query

KM2 = 0.0001


def _r(x, n=6):
    return F.round(x, n)


@query("SELECT cell_index, round(tan(radians(slope_deg)), 6) AS slope, round(tan(radians(slope_deg)) * 100, 4) AS percent FROM cells", CELLS)
def slope_percent(spark, sf_dir):
    t = H.slope_tan(F.col("slope_deg"))
    return cells(spark, sf_dir).select("cell_index", _r(t).alias("slope"), _r(t * 100, 4).alias("percent"))


@query("SELECT cell_index, round(pow(acc * 0.0001 * 1.2, 0.56), 6) AS width, round(pow(acc * 0.0001 * 0.12, 0.52), 6) AS depth FROM cells WHERE is_stream", CELLS)
def reach_width_depth(spark, sf_dir):
    s = cells(spark, sf_dir).filter("is_stream")
    return s.select("cell_index", _r(H.reach_width(F.col("acc"), KM2, 10)).alias("width"), _r(H.reach_depth(F.col("acc"), KM2, 10)).alias("depth"))


@query("SELECT cell_index, round(greatest(least(sqrt(tan(radians(slope_deg))) * pow(pow(acc * 0.0001 * 0.04, 0.45), 0.6667) / (landuse * 0.05), 3.0), 0.005), 6) AS velocity FROM cells", CELLS)
def velocity(spark, sf_dir):
    v = H.manning_velocity(H.slope_tan(F.col("slope_deg")), H.reach_depth(F.col("acc"), KM2, 2), F.col("landuse") * 0.05)
    return cells(spark, sf_dir).select("cell_index", _r(v).alias("velocity"))


@query(
    "SELECT cell_index, round(wti, 5) AS wti, CASE WHEN wti IS NOT NULL THEN round((least(wti, 0.8 * hi) - lo) * 0.95 / (0.8 * hi - lo) + 0.05, 5) END AS moisture FROM w, (SELECT min(wti) AS lo, max(wti) AS hi FROM w)",
    CELLS, "w AS (SELECT cell_index, CASE WHEN slope_deg > 0 THEN ln(acc * 100.0 / tan(radians(slope_deg))) END AS wti FROM cells)",
)
def wetness_moisture(spark, sf_dir):
    c = cells(spark, sf_dir)
    w = c.select("cell_index", H.wetness_index(F.col("acc"), 100.0, H.slope_tan(F.col("slope_deg"))).alias("wti"))
    ends = w.agg(F.min("wti").alias("lo"), F.max("wti").alias("hi"))  # one row
    m = H.initial_moisture(F.col("wti"), F.col("lo"), F.col("hi"), F.lit(1.0))
    return w.join(ends, F.lit(True)).select("cell_index", _r("wti", 5).alias("wti"), _r(F.when(F.col("wti").isNotNull(), m), 5).alias("moisture"))


def _stream_share():
    return H.stream_fraction(F.when(F.col("is_stream"), H.reach_width(F.col("acc"), KM2, 2) * 20), 10.0, F.when(F.col("texture") % 2 == 0, 4).otherwise(2))


FRACTION = """f AS (SELECT *, coalesce(CASE WHEN is_stream THEN greatest(least(CASE WHEN texture % 2 = 0 THEN 1.41421356 * w - 0.5 * w * w ELSE w END, 1.0), 0.0) END, 0.0) AS stream
 FROM (SELECT *, pow(acc * 0.0001 * 1.0, 0.56) * 20 / 10.0 AS w, tan(radians(slope_deg)) AS s, (landuse % 3) * 0.45 AS imp FROM cells))"""


@query("SELECT cell_index, round(stream, 6) AS fraction FROM f", CELLS, FRACTION)
def stream_fraction(spark, sf_dir):
    return cells(spark, sf_dir).select("cell_index", _r(_stream_share()).alias("fraction"))


@query(
    """SELECT cell_index, round(greatest(least(CASE WHEN stream > 0 THEN stream + (1 - stream) * u ELSE u END, 1.0), 0.0), 6) AS prc FROM (SELECT cell_index, stream,
    CASE WHEN imp > 0 AND imp < 1 THEN p * imp + (0.1 + 0.9 * s / (s + 0.3)) * (1 - imp) ELSE p END AS u FROM (SELECT *, 0.2 + 0.8 * s / (s + 0.5) AS p FROM f))""",
    CELLS, FRACTION,
)
def runoff_coefficient(spark, sf_dir):
    prc = H.runoff_coefficient(F.lit(0.2), H.slope_tan(F.col("slope_deg")), F.lit(0.5), (F.col("landuse") % 3) * 0.45, F.lit(0.1), F.lit(0.3), _stream_share())
    return cells(spark, sf_dir).select("cell_index", _r(prc).alias("prc"))


@query(
    """SELECT cell_index, round(CASE WHEN stream > 0 THEN greatest(least((1 - stream) * land, 1.0), 0.0) ELSE land END, 6) AS dsc FROM (SELECT cell_index, stream,
    CASE WHEN imp > 0 AND imp < 1 THEN (2.5 * imp + 4.0 * (1 - imp)) * exp(-9.5 * slope_deg / 100) ELSE 2.5 * exp(-9.5 * slope_deg / 100) END AS land FROM f)""",
    CELLS, FRACTION,
)
def depression_storage(spark, sf_dir):
    dsc = H.depression_storage(F.lit(2.5), F.col("slope_deg"), (F.col("landuse") % 3) * 0.45, F.lit(4.0), _stream_share())
    return cells(spark, sf_dir).select("cell_index", _r(dsc).alias("dsc"))


@query(
    "SELECT cell_index, round(CASE WHEN stream > 0 THEN greatest(least(100 * stream + (1 - stream) * cn, 100.0), 35.0) ELSE cn END, 5) AS cn2 FROM (SELECT cell_index, stream, 30.0 + 5 * landuse + 10 * ((texture - 1) % 4) AS cn FROM f)",
    CELLS, FRACTION,
)
def curve_number(spark, sf_dir):
    by_group = F.array(*[30.0 + F.col("landuse") * 5 + 10 * g for g in range(4)])
    cn = H.curve_number(by_group, (F.col("texture") - 1) % 4 + 1, _stream_share())
    return cells(spark, sf_dir).select("cell_index", _r(cn, 5).alias("cn2"))


@query(
    "SELECT cell_index, cells.landuse, cells.texture, prc FROM cells JOIN lookup ON cells.landuse = lookup.landuse AND cells.texture = lookup.texture",
    CELLS, "lookup AS (SELECT l.landuse, t.texture, CAST(l.landuse * 100 + t.texture AS DOUBLE) AS prc FROM (SELECT unnest(range(1, 6)) AS landuse) l, (SELECT unnest(range(1, 13)) AS texture) t)",
)
def texture_parameter(spark, sf_dir):
    """The wide lookup with a column for each texture becomes rows, so the dynamic column is an equi-join."""
    wide = spark.range(1, 6).select(F.col("id").cast("int").alias("landuse"), *[(F.col("id") * 100 + t).cast("double").alias(f"PRC_ST{t}") for t in range(1, 13)])
    long = wide.unpivot("landuse", [f"PRC_ST{t}" for t in range(1, 13)], "name", "prc").select("landuse", F.regexp_extract("name", r"(\d+)$", 1).cast("int").alias("texture"), "prc")
    return cells(spark, sf_dir).join(long, ["landuse", "texture"]).select("cell_index", "landuse", "texture", "prc")


@query("SELECT p_partkey, round(CASE WHEN p_size * 3 < 70 THEN 2.85 * pow(p_size * 3, 1.22) / 10 ELSE (7.1 * p_size * 3 + 9.97) / 10 END, 5) AS volume FROM part")
def wetland_volume(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", _r(H.wetland_volume(F.col("p_size") * 3), 5).alias("volume"))


@query("SELECT p_partkey, round(sqrt(p_retailprice * 10000) / 10, 5) AS width, coalesce(nullif(p_size, 7), 0) AS wetland FROM part")
def lateral_width(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", _r(H.lateral_width(F.col("p_retailprice")), 5).alias("width"), F.coalesce(F.nullif("p_size", F.lit(7)), F.lit(0)).alias("wetland"))


TERMS = """terms AS (SELECT *, v * rad / (2 * s) AS d, v * 5 / 3 AS cel FROM (SELECT *, greatest(least(pow(rad, 2.0 / 3) * sqrt(s) / greatest(landuse * 0.05, 0.001), 3.0), 0.005) AS v
 FROM (SELECT *, greatest(tan(radians(slope_deg)) * 100 / 100, 0.001) AS s, 0.12 * pow(acc * 0.0001, 0.52) AS rad FROM cells)))"""


@query("SELECT cell_index, round(rad, 6) AS radius, round(v, 6) AS velocity, round(cel, 6) AS celerity, round(1 / cel, 5) AS t, round(2 * d / pow(cel, 3), 4) AS delta FROM terms", CELLS, TERMS)
def iuh_cell_terms(spark, sf_dir):
    x = H.travel_terms(H.slope_tan(F.col("slope_deg")) * 100, F.col("acc"), F.col("landuse") * 0.05, KM2, 0.12, 0.52)
    return cells(spark, sf_dir).select("cell_index", *[_r(x[n], {"t": 5, "delta": 4}.get(n, 6)).alias(n) for n in x])
