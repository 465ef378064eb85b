"""Regions of a raster as polygons: their boundary edges, assembled into rings by list ranking.

A side of a cell whose neighbour is of another region is an edge from corner to corner, with the region on its right, so
outer rings run clockwise on the map and holes the other way. At a corner where a region's cells touch diagonally a ring turns left,
to the cell across, as regions join their diagonal neighbours. Each edge has one next edge, which the neighbours of its cell tell.
Rings that lie in one block of edges (flow.BLOCK) are labelled there; pointer doubling finds the least edge of the others, in as
many rounds as the longest ring's length has bits, and then each edge's place behind it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import flow
from .grid import neighbour_values
from .iterate import discard, written

#: Sides of a cell: the neighbour's number, direction (0 east, 1 south, 2 west, 3 north), start corner (dr, dc) and end corner.
SIDES = [(7, 0, (0, 0), (0, 1)), (1, 1, (0, 1), (1, 1)), (3, 2, (1, 1), (1, 0)), (5, 3, (1, 0), (0, 0))]


def _corner(r: Column, c: Column, cols: int) -> Column:
    return (r * (cols + 1) + c).cast("long")


def edges(cells: DataFrame, region: str, cols: int) -> DataFrame:
    """edge (start corner * 4 + direction), start, direction, region, next (the edge that goes on from its end: to the left, straight
    on or to the right) and turns (whether the one before has another direction). cells: r, c and the region, on a grid of so many columns."""
    wide = neighbour_values(cells.select("r", "c", region), region)
    at = lambda d: _corner(F.col("r") + d[0], F.col("c") + d[1], cols)
    own = lambda k: F.coalesce(F.col(f"n{k % 8}") == F.col(region), F.lit(False))

    def side(k: int, d: int, a: tuple[int, int], b: tuple[int, int]) -> Column:
        # Ahead of an edge along side k lie the cells k + 1 (to the left) and k + 2, behind it k - 1 and k - 2.
        by = F.when(own(k + 1), 3).when(own(k + 2), 0).otherwise(1)
        turns = own(k - 1) | ~own(k - 2)
        return F.when(~own(k), F.struct(at(a).alias("start"), F.lit(d).alias("direction"), (at(b) * 4 + (F.lit(d) + by) % 4).alias("next"), turns.alias("turns")))

    found = wide.select(F.col(region).alias("region"), F.explode(F.array_compact(F.array(*[side(*x) for x in SIDES]))).alias("s")).select("region", "s.*")
    return found.withColumn("edge", F.col("start") * 4 + F.col("direction"))


def _labelled(t: pa.Table) -> pa.Table:
    """A block's edges with the label of their ring, null where the ring leaves the block."""
    edge, to = flow.array(t, "edge"), flow.array(t, "next")
    order = np.argsort(edge)
    at = order[np.minimum(np.searchsorted(edge, to, sorter=order), len(edge) - 1)]
    open_ = edge[at] != to
    at = np.where(open_, np.arange(len(edge)), at)
    label = edge.copy()
    for _ in range(len(edge).bit_length() + 1):
        label, open_, at = np.minimum(label, label[at]), open_ | open_[at], at[at]
        if np.array_equal(label, label[at]) and np.array_equal(open_, open_[at]):
            break
    return pa.table({"edge": t["edge"], "next": t["next"], "label": pa.array(label, mask=open_)})


def labels(links: DataFrame) -> DataFrame:
    """edge, next and label, the least edge of the cycle. links: edge, next, all on cycles."""
    here = written(links.select("edge", "next").groupBy(flow.block("edge")).applyInArrow(_labelled, "edge long, next long, label long"))
    across = here.filter("label is null").select("edge", "next")
    if across.isEmpty():
        return here
    return here.filter("label is not null").unionByName(across.join(least_on_cycle(across), "edge").select("edge", "next", "label"))


def least_on_cycle(links: DataFrame) -> DataFrame:
    """links: edge, next, all on cycles. edge and label, the least edge of the cycle. When no label falls in a round, all have it."""
    now = written(links.select("edge", F.col("next").alias("far"), F.least("edge", "next").alias("label")))
    while True:
        on = now.select(F.col("edge").alias("far"), F.col("far").alias("far2"), F.col("label").alias("label2"))
        then = written(now.join(on, "far").select("edge", F.col("far2").alias("far"), F.least("label", "label2").alias("label"), (F.col("label2") < F.col("label")).alias("fell")))
        discard(now)
        now = then.drop("fell")
        if then.filter("fell").isEmpty():
            return now.select("edge", "label")


def rings(cells: DataFrame, region: str, cols: int) -> DataFrame:
    """region, ring (its least edge), place (from 0), x and y (the corner where an edge begins, in cells), turns (whether the
    ring changes its direction there)."""
    found = written(edges(cells, region, cols))
    named = written(labels(found.select("edge", "next")))
    # The ring is cut before its least edge, so places are steps from there to the end.
    cut = named.select(F.col("edge").alias("cell_index"), F.when(F.col("next") != F.col("label"), F.col("next")).alias("down"))
    steps = flow.jump(cut, []).select(F.col("cell_index").alias("edge"), "steps")
    sizes = named.groupBy("label").agg(F.count("*").alias("size"))
    every = found.drop("next").join(steps, "edge").join(named.select("edge", "label"), "edge").join(sizes, "label")
    return every.select(
        "region", F.col("label").alias("ring"), (F.col("size") - 1 - F.col("steps")).alias("place"), (F.col("start") % (cols + 1)).alias("x"),
        F.floor(F.col("start") / (cols + 1)).alias("y"), "turns",
    )


def ring_areas(corners: DataFrame, cols: int) -> DataFrame:
    """region, ring, n_corners, area in cells (holes are negative): the shoelace formula, edge by edge. An edge's end follows from its start."""
    # The corner after the last one is the first; a ring's corners in order are the edges' starts, so x dy sums up the area.
    own = corners.groupBy("region", "ring").agg(F.sum(F.col("turns").cast("long")).alias("n_corners"), F.array_sort(F.collect_list(F.when(F.col("turns"), F.struct("place", "x", "y")))).alias("p"))
    n = F.size("p")
    terms = F.transform("p", lambda a, i: a["x"] * F.get("p", (i + 1) % n)["y"] - F.get("p", (i + 1) % n)["x"] * a["y"])
    return own.select("region", "ring", "n_corners", (F.aggregate(terms, F.lit(0).cast("long"), lambda a, b: a + b) / 2).alias("area"))


def polygons(corners: DataFrame) -> DataFrame:
    """region and rings: an array of rings, each an array of its corners x, y in order; the outer ones first. A polygon is one row."""
    at = F.struct("place", "x", "y")
    one = corners.filter("turns").groupBy("region", "ring").agg(F.array_sort(F.collect_list(at)).alias("p"), F.min(F.struct("y", "x")).alias("first"))
    path = F.transform("p", lambda a: F.struct(a["x"].alias("x"), a["y"].alias("y")))
    every = one.groupBy("region").agg(F.array_sort(F.collect_list(F.struct("first", path.alias("path")))).alias("all"))
    return every.select("region", F.transform("all", lambda a: a["path"]).alias("rings"))
