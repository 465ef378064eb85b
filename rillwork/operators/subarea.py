"""Subareas, the pairs of field and subbasin: their cells, their table, and what part of each a structure covers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hydrology as H
from . import flow, zonal
from .buffers import within
from .grid import rank_rows

#: Columns of the subarea table that are means over cells: column of cells, name.
MEANS = {
    "dem": "elevation", "slope": "slope", "usle_p": "usle_p", "moisture": "moisture_initial", "acc": "flow_accumulation_average",
    "t_2": "travel_time_average_2", "t_10": "travel_time_average_10", "t_100": "travel_time_average_100",
    "sd_2": "travel_time_std_2", "sd_10": "travel_time_std_10", "sd_100": "travel_time_std_100",
}


def travel_times(cells: DataFrame, edges: DataFrame, cell_m: float, periods: dict[int, tuple[float, float]]) -> DataFrame:
    """cell_index, t_<period>, sd_<period> in hours for each return period, whose radius is a * (km2) ^ b.

    The terms of the cells from a cell to its stream, both included, are summed: t by celerity, delta by dispersion, of which
    the square root is taken. One doubling carries the sums of all periods. cells: cell_index, acc, slope (percent), manning,
    is_stream."""
    km2 = cell_m * cell_m / 1e6
    terms, names = [], []
    for p, (a, b) in periods.items():
        x = H.travel_terms(F.col("slope"), F.col("acc"), F.col("manning"), km2, a, b)
        terms += [x["t"].alias(f"t_{p}"), x["delta"].alias(f"d_{p}")]
        names += [f"t_{p}", f"d_{p}"]
    inside = within(edges, cells).select("cell_index", "down")
    on = flow.until(inside, cells.filter("is_stream")).join(cells.select("cell_index", *terms), "cell_index")
    sums = flow.jump(on, names)
    hours = lambda p: (F.col(f"t_{p}") * cell_m / 3600).alias(f"t_{p}")
    spread = lambda p: (F.sqrt(F.greatest(F.col(f"d_{p}"), F.lit(0.0))) * cell_m**0.5 / 3600).alias(f"sd_{p}")
    return sums.select("cell_index", *[hours(p) for p in periods], *[spread(p) for p in periods])


def moisture(cells: DataFrame, cell_m2: float, capacity: str) -> DataFrame:
    """cell_index, moisture: the wetness index scaled by the grid's ends, times the capacity; null on flat cells."""
    w = cells.select("cell_index", capacity, H.wetness_index(F.col("acc"), cell_m2, F.col("slope") / 100).alias("wti"))
    ends = w.agg(F.min("wti").alias("lo"), F.max("wti").alias("hi"))  # one row
    wet = H.initial_moisture(F.col("wti"), F.col("lo"), F.col("hi"), F.col(capacity))
    return w.join(F.broadcast(ends), F.lit(True)).select("cell_index", F.when(F.col("wti").isNotNull(), wet).alias("moisture"))


def with_subarea(cells: DataFrame) -> DataFrame:
    """The cells with the number of their pair of field and subbasin, in the order of subbasin and field. Cells without
    either belong to no subarea."""
    pairs = cells.filter("field is not null and subbasin is not null").select("field", "subbasin").distinct()
    return cells.join(rank_rows(pairs, "subbasin", "field", name="subarea"), ["field", "subbasin"])


def cell_table(cells: DataFrame) -> DataFrame:
    """cell_index of the model (valid cells from 0 on in row-major order), subarea."""
    return rank_rows(cells.select("r", "c", "subarea"), "r", "c", name="valid_index", start=0).select("valid_index", "subarea")


def subarea_table(cells: DataFrame, cell_ha: float) -> DataFrame:
    """All eighteen columns by one aggregation. cells: subarea, field, subbasin, wetland (boolean) and the columns of MEANS.
    A subarea whose cells all lack a value has null there; without wetland cells the fraction is 0."""
    wet = F.count(F.when(F.col("wetland"), 1))
    means = [F.avg(c).alias(name) for c, name in MEANS.items()]
    area = (F.count("*") * cell_ha).alias("area")
    found = cells.groupBy("subarea", "subbasin", "field").agg(area, (wet / F.count("*")).alias("wetland_fraction"), *means)
    constant = F.lit(1).alias("topography_weight")
    keys = (F.col("subarea").alias("id"), F.col("subbasin").alias("subbasin_id"), F.col("field").alias("field_id"))
    return found.select(*keys, "area", "wetland_fraction", *MEANS.values(), constant, H.lateral_width(F.col("area")).alias("lateral_width"))


def shares(cells: DataFrame, of: str, cell_ha: float) -> DataFrame:
    """subarea, the other zone and their common area: the tables of soil and landuse types."""
    return cells.filter(F.col(of).isNotNull()).groupBy("subarea", of).agg((F.count("*") * cell_ha).alias("area"))


def structure_lookups(cells: DataFrame, kinds: list[str], cell_ha: float) -> DataFrame:
    """kind, subarea, location, area_ha, fraction_to_subarea, fraction_to_bmp for all kinds of structure at once.

    cells: subarea, and for each kind a column with the structure's id, null outside. Cells are counted by (kind, subarea,
    location) first, outside ones too, so both totals come from these counts and no cell is read again."""
    kind = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("long").alias("location")) for k in kinds])).alias("s")
    counts = cells.select("subarea", kind).groupBy("s.kind", "subarea", "s.location").agg(F.count("*").alias("n"))
    subareas = counts.groupBy("kind", "subarea").agg(F.sum("n").alias("n_subarea"))
    held = counts.filter("location is not null")
    places = held.groupBy("kind", "location").agg(F.sum("n").alias("n_location"))
    both = held.join(subareas, ["kind", "subarea"]).join(places, ["kind", "location"])
    fractions = ((F.col("n") / F.col("n_subarea")).alias("fraction_to_subarea"), (F.col("n") / F.col("n_location")).alias("fraction_to_bmp"))
    return both.select("kind", "subarea", "location", (F.col("n") * cell_ha).alias("area_ha"), *fractions)


def tile_drains(features: DataFrame, cells: DataFrame, zone: str, outlets: DataFrame, reaches: DataFrame, least_ha: float) -> DataFrame:
    """The tile drains that have cells, with their field (of most cells), their subbasin (of the least mean elevation) and
    the reach that they drain to.

    Down from the subbasin, itself included, that is the first reach with an outlet; where no outlet lies on the way, the
    first reach of least_ha at least, else the last one. features: id and attributes. outlets: subbasin.
    reaches: reach, receive (0: leaves the basin), contribution_ha."""
    own = cells.filter(F.col(zone).isNotNull()).withColumn("id", F.col(zone).cast("long"))
    field = zonal.majority(own, "id", "field").select("id", "field")
    pairs = own.groupBy("id", "subbasin").agg(F.avg("dem").alias("mean"))
    low = pairs.groupBy("id").agg(F.min(F.struct("mean", "subbasin")).alias("b")).select("id", F.col("b.subbasin").alias("node"))
    marks = reaches.join(outlets.select(F.col("subbasin").alias("reach"), F.lit(True).alias("has")).distinct(), "reach", "left")
    way = flow.closure(reaches, "reach", "receive").filter("below > 0")
    way = way.unionByName(reaches.select(F.col("reach").alias("node"), F.col("reach").alias("below"), F.lit(0).cast("long").alias("rank")))
    way = way.join(marks.select(F.col("reach").alias("below"), "has", "contribution_ha"), "below")
    by = lambda test: F.min_by("below", F.when(test, F.col("rank")))
    big = F.col("contribution_ha") >= least_ha
    to = way.groupBy("node").agg(F.coalesce(by(F.col("has")), by(big), F.max_by("below", "rank")).alias("reach"))
    return features.join(low.join(to, "node").join(field, "id").select("id", "field", F.col("node").alias("subbasin"), "reach"), "id")


def outlet_drainage(drains: DataFrame, capacity: float = 3800.0) -> DataFrame:
    """A row for each reach that tile drains drain to, numbered in the order of the reaches."""
    ids = rank_rows(drains.select("reach").distinct(), "reach", name="id")
    return ids.select("id", "reach", F.lit(capacity).alias("drainage_capacity"))


def wascobs(features: DataFrame, cells: DataFrame, drains: DataFrame, fields: DataFrame, cell_ha: float) -> DataFrame:
    """Wascobs with the subbasin of their cell, its area as contribution, and the reach of their tile drain. Strict in field
    and tile drain: a wascob that names an unknown one has no row, checks.wascob() tells which.
    features: id, cell_index, field_id, drain_id and attributes; drains as of tile_drains(); fields: id."""
    known = features.join(fields.select(F.col("id").alias("field_id")).distinct(), "field_id", "left_semi")
    on = known.join(drains.select(F.col("id").alias("drain_id"), "reach"), "drain_id")
    area = cells.groupBy("subbasin").agg((F.count("*") * cell_ha).alias("contribution_ha"))
    return on.join(cells.select("cell_index", "subbasin"), "cell_index").join(area, "subbasin")
