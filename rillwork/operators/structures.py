"""Wetlands and other structures on the grid: outlets, counts, the tree of wetlands, snapping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flow
from .iterate import written


def exits(edges: DataFrame, zones: DataFrame) -> DataFrame:
    """Steps by which a structure's cells leave it: id, cell_index, down. zones: cell_index, id."""
    own = zones.select("cell_index", "id")
    e = edges.select("cell_index", "down").join(own, "cell_index").join(own.select(F.col("cell_index").alias("down"), F.col("id").alias("n_id")), "down", "left")
    return e.filter("n_id is null or n_id <> id").select("id", "cell_index", "down")


def lowest_outlets(outlets: DataFrame, cells: DataFrame) -> DataFrame:
    """The lowest outlet of each structure; of equals the last of a row-major scan."""
    own = outlets.join(cells.select("cell_index", "dem"), "cell_index")
    return own.groupBy("id").agg(F.min(F.struct("dem", (-F.col("cell_index")).alias("m"))).alias("b")).select("id", (-F.col("b.m")).alias("cell_index"), "b.dem")


def counts(zones: DataFrame, outlets: DataFrame, cells: DataFrame) -> DataFrame:
    """id, n_cells, n_outlets, riparian (a cell is stream)."""
    size = zones.join(cells.select("cell_index", "is_stream"), "cell_index").groupBy("id").agg(F.count("*").alias("n_cells"), F.bool_or("is_stream").alias("riparian"))
    out = outlets.groupBy("id").agg(F.count("*").alias("n_outlets"))
    return size.join(out, "id", "left").select("id", "n_cells", F.coalesce("n_outlets", F.lit(0)).alias("n_outlets"), "riparian")


def downstream_structure(edges: DataFrame, zones: DataFrame, outlets: DataFrame) -> DataFrame:
    """id, next: the first structure that the water of a structure's outlet meets, 0 if none. outlets: id, cell_index, one for
    each. Ways end at the structures' cells, and are doubled from the cell below an outlet."""
    stops = zones.select("cell_index")
    roots = flow.jump(flow.until(edges.select("cell_index", "down"), stops), []).select("cell_index", "root")
    below = outlets.join(edges.select("cell_index", "down"), "cell_index").select("id", F.col("down").alias("cell_index"))
    met = below.join(roots, "cell_index", "left").join(zones.select(F.col("cell_index").alias("root"), F.col("id").alias("next")), "root", "left")
    return met.select("id", F.coalesce(F.when(F.col("next") != F.col("id"), F.col("next")), F.lit(0)).alias("next"))


def _nearest_own(points: DataFrame, targets: DataFrame, order: tuple[str, ...], radius: int) -> DataFrame:
    """Each point's nearest target of its own structure, of equals the first by order. Points meet the targets of the squares
    around them; those without any within the radius are sought again in four times the radius, until it spans all."""
    left = points.select("id", "r", "c").distinct()
    ends = targets.select("r", "c").union(left.select("r", "c")).agg(F.max("r") - F.min("r"), F.max("c") - F.min("c")).first()
    span = max(1, *(x or 0 for x in ends))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    found, step = [], radius
    while True:
        block = lambda v: F.floor(F.col(v) / step)  # noqa: B023, E731
        asked = left.withColumn("s", around).select("id", "r", "c", (block("r") + F.col("s.i")).alias("br"), (block("c") + F.col("s.j")).alias("bc"))
        other = targets.select("id", F.col("r").alias("tr"), F.col("c").alias("tc"), *(n for n in order if n not in ("tr", "tc")), block("r").alias("br"), block("c").alias("bc"))
        dr, dc = F.col("r") - F.col("tr"), F.col("c") - F.col("tc")
        near = asked.join(other, ["id", "br", "bc"]).withColumn("d2", dr * dr + dc * dc).filter(F.col("d2") <= step * step)
        found.append(written(near.groupBy("id", "r", "c").agg(F.min(F.struct("d2", *order)).alias("b")).select("id", "r", "c", "b.tr", "b.tc")))
        if step > 2 * span:
            break
        left = written(left.join(found[-1].select("id", "r", "c"), ["id", "r", "c"], "left_anti"))
        if left.isEmpty():
            break
        step *= 4
    return reduce(DataFrame.unionByName, found)


def snap_within(points: DataFrame, targets: DataFrame, radius: int = 16) -> DataFrame:
    """Each point's nearest cell of its own structure; of equals the first of a row-major scan. points: id, r, c; targets: id, r, c."""
    return _nearest_own(points, targets, ("tr", "tc"), radius)


def snap_to_edge(points: DataFrame, edge: DataFrame, radius: int = 16) -> DataFrame:
    """A point inside a structure goes to its nearest edge cell, of equals to the lowest, then the first. edge: id, r, c, dem."""
    return _nearest_own(points, edge, ("dem", "tr", "tc"), radius)


def inside_basin(zones: DataFrame, subbasins: DataFrame) -> DataFrame:
    """Cells of the structures that lie in a subbasin at all; a structure outside of every one goes."""
    known = zones.join(subbasins.select("cell_index"), "cell_index", "left_semi").select("id").distinct()
    return zones.join(known, "id", "left_semi")
