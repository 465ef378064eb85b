"""Riparian buffers and filter strips: the parts in which water leaves a buffer, with what drains through them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flow
from .grid import rank_rows
from .iterate import written

#: Widths in m and the vegetation's id; fixed values.
RIPARIAN_M = 30.0
STRIP_M = 10.0
VEGETATION = 6


def within(edges: DataFrame, cells: DataFrame, *fields: str) -> DataFrame:
    """The edges of the given cells; a step to a cell that isn't given is none. Fields come along, the next cell's as n_ ones."""
    low = cells.select(F.col("cell_index").alias("n"), *[F.col(c).alias(f"n_{c}") for c in fields])
    own = edges.select("cell_index", F.col("down").alias("n"), "dist").join(cells.select("cell_index", *fields), "cell_index")
    known = low.withColumn("down", F.col("n"))
    return own.join(known, "n", "left").drop("n")


def exits(steps: DataFrame, zone: str) -> DataFrame:
    """steps: cell_index, down, dist, the zone (null outside of buffers) and the next cell's as n_zone.

    is_exit: water leaves the buffer here. The next cell lies outside or in another buffer, or it is an end of the grid.
    A buffer's cell that is an end itself is no exit, since nothing flows out of it."""
    ends = steps.filter("down is null").select(F.col("cell_index").alias("down"), F.lit(True).alias("n_end"))
    leaves = F.col(f"n_{zone}").isNull() | (F.col(f"n_{zone}") != F.col(zone)) | F.coalesce("n_end", F.lit(False))
    out = F.col(zone).isNotNull() & F.col("down").isNotNull() & leaves
    return steps.join(ends, "down", "left").select("cell_index", "down", "dist", zone, out.alias("is_exit"))


def buffer_parts(cells: DataFrame, edges: DataFrame, zone: str) -> DataFrame:
    """cell_index, exit_cell, inside, length: the first exit on each cell's way down, whether the cell lies in the buffer, and
    the way from it to the exit inside of buffers, the exit's own step included. Cells whose way has no exit have no row.

    Every cell on the way to an exit drains through it. Ways are doubled, and bring the number of exits at their end, one or
    none; a buffer of any size is no group."""
    steps = written(exits(within(edges, cells, zone), zone))
    inside = F.col(zone).isNotNull()
    stop = F.when(~F.col("is_exit"), F.col("down")).alias("down")
    length = F.when(inside, F.coalesce("dist", F.lit(0.0))).otherwise(0.0).alias("length")
    out = F.col("is_exit").cast("int").alias("exits")
    ways = flow.jump(steps.select("cell_index", stop, length, out, inside.alias("inside")), ["length", "exits"], ("inside",))
    return ways.filter("exits > 0").select("cell_index", F.col("root").alias("exit_cell"), "inside", "length")


def numbered(parts: DataFrame) -> DataFrame:
    """The parts of buffer_parts() with their number, in the order of the exits' cells."""
    ids = rank_rows(parts.select("exit_cell").distinct(), "exit_cell", name="part")
    return parts.join(ids, "exit_cell")


def buffer_table(parts: DataFrame, cells: DataFrame, zone: str, width_m: float, cell_ha: float, values: dict[str, str]) -> DataFrame:
    """The parameter table of numbered() parts: one aggregation gives the drainage area, the length and the means of all
    values (column of cells: name) over the cells inside. Length is the longest way inside, so that it doesn't depend on
    the order of a scan; the area is length by width."""
    fields = [F.col("subbasin"), F.col(zone), *[F.col(v) for v in values]]
    own = parts.join(cells.select("cell_index", *fields), "cell_index")
    at_exit = F.col("cell_index") == F.col("exit_cell")
    held = lambda c: F.when(F.col("inside"), F.col(c))
    found = own.groupBy("part").agg(
        F.max(F.when(at_exit, F.col(zone))).alias("zone_id"),
        F.max(F.when(at_exit, F.col("subbasin"))).alias("subbasin"),
        F.max(held("length")).alias("length"),
        (F.count("*") * cell_ha).alias("drainage_area"),
        *[F.avg(held(v)).alias(name) for v, name in values.items()],
    )
    area = F.col("length") * width_m * 0.0001
    terms = (F.lit(VEGETATION).alias("vegetation_id"), "length", F.lit(width_m).alias("width"), area.alias("area_ha"))
    ratio = (F.col("drainage_area") / area).alias("area_ratio")
    first = (F.lit(1).alias("scenario"), F.col("part").alias("id"), F.lit(0).alias("year"))
    return found.select(*first, "zone_id", "subbasin", *terms, "drainage_area", ratio, *values.values())
