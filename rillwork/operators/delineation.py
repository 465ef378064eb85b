"""From elevation to subbasins: streams by threshold, pour points of all sources, watersheds, slope, stream vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import flow, weights
from .grid import STEPS, neighbour_values, rank_rows


def threshold_streams(acc: DataFrame, min_ha: float, cell_ha: float) -> DataFrame:
    """Cells whose upstream area reaches min_ha. acc: cell_index, acc (cells)."""
    return acc.filter(F.col("acc") * cell_ha >= min_ha)


def stream_ends(edges: DataFrame, streams: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """Stream cells that flow into a confluence, and the last cells of streams; cells of skip (structures) are none."""
    own = streams.select("cell_index")
    e = edges.join(own, "cell_index", "left_semi").select("cell_index", "down")
    inside = e.join(own.withColumnRenamed("cell_index", "down"), "down", "left_semi")
    meet = inside.groupBy("down").agg(F.count("*").alias("n")).filter("n > 1")
    last = e.join(inside.select("cell_index"), "cell_index", "left_anti").select("cell_index")
    found = inside.join(meet, "down", "left_semi").select("cell_index").union(last)
    return found.join(skip.select("cell_index"), "cell_index", "left_anti") if skip is not None else found


def merge_pour_points(sources: dict[str, DataFrame]) -> DataFrame:
    """cell_index and source of the pour points of all sources; a cell that several have goes to the first of them."""
    tagged = [df.select("cell_index", F.lit(k).alias("k"), F.lit(name).alias("source")) for k, (name, df) in enumerate(sources.items())]
    every = reduce(DataFrame.unionByName, tagged)
    return every.groupBy("cell_index").agg(F.min(F.struct("k", "source")).alias("b")).select("cell_index", "b.source")


def pour_points(
    edges: DataFrame, streams: DataFrame, snapped: dict[str, DataFrame], placed: dict[str, DataFrame], radius: int, cols: int, skip: DataFrame | None = None,
) -> DataFrame:
    """cell_index and source of the pour points of all sources, in the order given: the streams' ends; points (point_id, pr, pc)
    that go to the nearest stream cell within the radius, and not at all if there is none (outlets, structures of reaches,
    wascobs); and cells that are outlets already (tile drains, structures). streams: cell_index. skip: cells of structures,
    where streams have no ends."""
    own = streams.select(F.floor(F.col("cell_index") / cols).alias("r"), (F.col("cell_index") % cols).alias("c"))
    moved = {name: weights.snap(points, own, radius).select((F.col("r") * cols + F.col("c")).alias("cell_index")) for name, points in snapped.items()}
    return merge_pour_points({"streams": stream_ends(edges, streams, skip), **moved, **{n: df.select("cell_index") for n, df in placed.items()}})


def watersheds(edges: DataFrame, points: DataFrame) -> DataFrame:
    """cell_index and outlet: the first pour point downstream, the cell itself included; NULL where the way meets none.
    Ways bring the number of points at their root, one or none, so roots are not joined with the points."""
    own = points.select("cell_index", F.lit(1).alias("is_point"))
    e = edges.select("cell_index", "down").join(own, "cell_index", "left").select("cell_index", F.when(F.col("is_point").isNull(), F.col("down")).alias("down"), F.coalesce("is_point", F.lit(0)).alias("is_point"))
    return flow.jump(e, ["is_point"]).select("cell_index", F.when(F.col("is_point") > 0, F.col("root")).alias("outlet"))


def subbasins(edges: DataFrame, points: DataFrame) -> DataFrame:
    """cell_index, outlet and subbasin: watersheds() with the outlets' numbers from 1 in the order of their cells; cells without
    outlet are left out. Each point that is a cell is its own outlet, so points are numbered and ways bring the numbers."""
    ids = rank_rows(points.select("cell_index").join(edges.select("cell_index"), "cell_index", "left_semi"), "cell_index", name="subbasin")
    e = edges.select("cell_index", "down").join(ids.select("cell_index", F.col("subbasin").cast("int").alias("subbasin")), "cell_index", "left")
    e = e.select("cell_index", F.when(F.col("subbasin").isNull(), F.col("down")).alias("down"), F.coalesce("subbasin", F.lit(0)).alias("subbasin"))
    return flow.jump(e, ["subbasin"]).filter("subbasin > 0").select("cell_index", F.col("root").alias("outlet"), "subbasin")


def number_subbasins(watershed: DataFrame) -> DataFrame:
    """Subbasin ids from 1 in the order of the outlets' cells; cells without outlet are left out."""
    ids = rank_rows(watershed.filter("outlet is not null").select("outlet").distinct(), "outlet", name="subbasin")
    return watershed.join(ids.select("outlet", F.col("subbasin").cast("int").alias("subbasin")), "outlet")


def slope_degrees(cells: DataFrame, value: str, res: float) -> DataFrame:
    """Slope by the third-order gradient over the eight neighbours; a missing neighbour counts as the cell itself."""
    wide = neighbour_values(cells.select("r", "c", "cell_index", value), value)
    at = [F.coalesce(F.col(f"n{k}"), F.col(value)) for k, _, _ in STEPS]  # from north-east clockwise
    ne, e, se, s, sw, w, nw, n = at
    dx = ((ne + 2 * e + se) - (nw + 2 * w + sw)) / (8 * res)
    dy = ((sw + 2 * s + se) - (nw + 2 * n + ne)) / (8 * res)
    return wide.select("cell_index", F.degrees(F.atan(F.sqrt(dx * dx + dy * dy))).alias("slope_deg"))


def stream_lines(edges: DataFrame, streams: DataFrame, subbasins: DataFrame) -> DataFrame:
    """Streams as line segments from cell to cell, with the subbasin of their upper end: cell_index, down, subbasin."""
    own = streams.select("cell_index")
    e = edges.select("cell_index", "down").join(own, "cell_index", "left_semi").join(own.withColumnRenamed("cell_index", "down"), "down", "left_semi")
    return e.join(subbasins.select("cell_index", "subbasin"), "cell_index").select("cell_index", "down", "subbasin")


def stream_links(edges: DataFrame, streams: DataFrame, ends: DataFrame) -> DataFrame:
    """Streams as lines between confluences: cell_index, link (its last cell), place (from 0 at the upper end) and size. No way is
    walked: pointer doubling counts the steps to the link's end."""
    own = streams.select("cell_index")
    on = edges.select("cell_index", "down").join(own, "cell_index", "left_semi").join(own.select(F.col("cell_index").alias("down"), F.lit(True).alias("wet")), "down", "left")
    way = flow.until(on.select("cell_index", F.when(F.col("wet"), F.col("down")).alias("down")), ends)
    steps = flow.jump(way, []).select("cell_index", F.col("root").alias("link"), "steps")
    sizes = steps.groupBy("link").agg(F.count("*").alias("size"))
    return steps.join(sizes, "link").select("cell_index", "link", (F.col("size") - 1 - F.col("steps")).alias("place"), "size")


def clip(cells: DataFrame, mask: DataFrame) -> DataFrame:
    """The cells inside a mask or a rasterised polygon."""
    return cells.join(mask.select("cell_index").distinct(), "cell_index", "left_semi")


def raised(dem: Column, watershed: Column, by: float = 200.0) -> Column:
    """Elevation with the cells of a watershed raised, the others as they are."""
    return F.when(watershed > 0, dem + by).otherwise(dem)


def overridden(base: Column, *layers: Column) -> Column:
    """The first layer with a value above zero, else the base: marginal land before pasture before land use."""
    return F.coalesce(*[F.when(x > 0, x) for x in layers], base)


def cells_as_points(cells: DataFrame, value: str, res: float) -> DataFrame:
    """Centres of cells with a value above zero, numbered row by row."""
    p = cells.filter(F.col(value) > 0).select("r", "c", F.col(value).alias("value"), ((F.col("c") + 0.5) * res).alias("x"), ((F.col("r") + 0.5) * res).alias("y"))
    return rank_rows(p, "r", "c", name="fid").select("fid", "value", "x", "y")


def regions(cells: DataFrame, value: str) -> DataFrame:
    """Connected regions of equal values (polygons of a raster): cell_index, region (its least cell). Edges join equal neighbours east, south-east, south and south-west."""
    wide = neighbour_values(cells.select("r", "c", "cell_index", value), value, also="cell_index")
    half = [(k, dx, dy) for k, dx, dy in STEPS if k in (1, 2, 3, 4)]
    other = F.array(*[F.when(F.col(f"n{k}") == F.col(value), F.col(f"i{k}")) for k, _, _ in half])
    links = wide.select("cell_index", F.explode(other).alias("b")).filter("b is not null").select(F.col("cell_index").alias("a"), "b")
    found = flow.components(links)
    return cells.select("cell_index").join(found, "cell_index", "left").select("cell_index", F.coalesce("region", "cell_index").alias("region"))


def biggest_of_group(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Of features that touch (a, b), the one of the most cells in each connected group, of equals the least id. sizes: id, n."""
    groups = flow.components(pairs).select(F.col("cell_index").alias("id"), "region")
    best = groups.join(sizes, "id").groupBy("region").agg(F.max(F.struct("n", (-F.col("id")).alias("m"))).alias("b"))
    return best.select("region", (-F.col("b.m")).alias("id"), "b.n")


