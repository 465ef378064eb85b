"""Kernels that built-in operators can't express: polygons to cells."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


FEATURE = "id long, r int, c int"


def scan_lines(rings: list[list[tuple[float, float]]], size: float, first: int, last: int) -> Iterator[tuple[int, int]]:
    """Cells of the rows first to last whose centres lie inside the rings (even-odd rule, so rings in rings are holes), row by row."""
    for r in range(first, last + 1):
        y, cuts = (r + 0.5) * size, []
        for ring in rings:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
                if (y1 <= y) != (y2 <= y):
                    cuts.append(x1 + (y - y1) * (x2 - x1) / (y2 - y1))
        cuts.sort()
        for a, b in zip(cuts[::2], cuts[1::2]):
            for c in range(int(a // size), int(b // size) + 1):
                if a <= (c + 0.5) * size < b:
                    yield r, c


def rasterise(features: DataFrame, size: float, band: int = 512) -> DataFrame:
    """features: id, ring (array of x, y) or rings (array of such, holes included). A row for each cell of each polygon. A
    polygon is cut into bands of so many rows, so that a large one is the work of several tasks."""
    rings = F.col("rings") if "rings" in features.columns else F.array("ring")
    ys = F.transform(F.flatten(rings), lambda p: p["y"])
    row = lambda y: F.floor(y / size).cast("int")
    ends = features.select("id", rings.alias("rings"), row(F.array_min(ys)).alias("lo"), row(F.array_max(ys)).alias("hi")).filter("lo IS NOT NULL")
    bands = ends.select("id", "rings", "hi", F.explode(F.sequence("lo", "hi", F.lit(band))).alias("first"))
    parts = bands.select("id", "rings", "first", F.least(F.col("first") + band - 1, F.col("hi")).alias("last"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, own, lo, hi in zip(b["id"], b["rings"], b["first"], b["last"]):
                rows = [(i, r, c) for r, c in scan_lines([[(p["x"], p["y"]) for p in ring] for ring in own], size, lo, hi)]
                yield pd.DataFrame(rows, columns=["id", "r", "c"])

    return parts.repartition("id", "first").mapInPandas(run, FEATURE)


def rasterise_points(points: DataFrame, size: float) -> DataFrame:
    """id, r, c of points (id, x, y)."""
    return points.select("id", F.floor(F.col("y") / size).cast("int").alias("r"), F.floor(F.col("x") / size).cast("int").alias("c"))


def rasterise_lines(lines: DataFrame, size: float, closed: bool = False) -> DataFrame:
    """id, r, c: the cells that lines (id, line: array of x, y) pass, each once; closed: back to the first point. Each segment
    is a row of its own, and its cells follow from their number along it, so a long line is no single task's."""
    last = F.element_at("line", 1) if closed else F.lit(None)
    nxt = F.coalesce(F.get("line", F.col("pos") + 1), last)
    ends = lines.select("id", "line", F.posexplode("line").alias("pos", "a")).select("id", "a", nxt.alias("b")).filter("b IS NOT NULL")
    cell = lambda p, axis: F.floor(F.col(p)[axis] / size)
    seg = ends.select("id", cell("a", "y").alias("r"), cell("a", "x").alias("c"), (cell("b", "y") - cell("a", "y")).alias("dr"), (cell("b", "x") - cell("a", "x")).alias("dc"))
    n = F.greatest(F.abs("dr"), F.abs("dc"))
    each = seg.withColumn("n", n).select("*", F.explode(F.sequence(F.lit(0).cast("long"), "n")).alias("i"))
    moved = lambda d: F.when(F.col("n") == 0, 0).otherwise(F.signum(d) * F.floor((2 * F.col("i") * F.abs(d) + F.col("n")) / (2 * F.col("n"))))
    return each.select("id", (F.col("r") + moved("dr")).cast("int").alias("r"), (F.col("c") + moved("dc")).cast("int").alias("c")).distinct()


def border_cells(features: DataFrame, size: float) -> DataFrame:
    """id, r, c: the cells that the polygons' edges pass."""
    return rasterise_lines(features.select("id", F.col("ring").alias("line")), size, closed=True)


def borders(features: DataFrame, size: float) -> DataFrame:
    """Cells that the polygons' edges pass; where several meet, the first feature owns the cell."""
    return border_cells(features, size).groupBy("r", "c").agg(F.min("id").alias("id"), F.count("*").alias("owners"))


def bordered(features: DataFrame, size: float) -> DataFrame:
    """r, c, id, border: the polygons with their edges' cells. An edge's owner comes before what lies inside another polygon;
    of several that lie over a cell the first has it."""
    edge = borders(features, size).select("r", "c", "id", F.lit(True).alias("border"))
    inside = rasterise(features, size).groupBy("r", "c").agg(F.min("id").alias("id")).withColumn("border", F.lit(False))
    return edge.unionByName(inside.join(edge.select("r", "c"), ["r", "c"], "left_anti"))


def border_conflicts(features: DataFrame, size: float) -> DataFrame:
    """a, b, n: the owner of border cells, another feature whose edge passes them, and how many they are."""
    own = border_cells(features, size)
    first = own.groupBy("r", "c").agg(F.min("id").alias("a"))
    met = own.join(first, ["r", "c"]).filter(F.col("id") != F.col("a"))
    return met.groupBy("a", F.col("id").alias("b")).agg(F.count("*").alias("n"))


def polygon_area(ring: str = "ring"):
    """Shoelace formula over an array of x, y, inside generated code."""
    n = F.size(ring)
    cross = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(ring, i)["x"] * F.get(ring, (i + 1) % n)["y"] - F.get(ring, (i + 1) % n)["x"] * F.get(ring, i)["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda a, b: a + b)) / 2
