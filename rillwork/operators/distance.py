"""Distance of cells to a set of cells, by a separable Euclidean transform: first down the columns, then along the rows.

Down a column the set's cells divide the rows among them at the middles between neighbours, so each gives the rows that are its own
their distance: as many rows as the grid has, however many cells are in the set and whatever the radius. Along a row the
distance is the lower envelope of one parabola for each column. A task holds a row of the grid.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _columns(targets: DataFrame, rows: tuple[int, int], radius: int | None) -> DataFrame:
    """r, c, g: for each column with cells of the set and each row, the distance to the nearest of them in the column."""
    own = Window.partitionBy("c").orderBy("r")
    near = targets.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c")).distinct()
    near = near.select("c", "r", F.lag("r").over(own).alias("above"), F.lead("r").over(own).alias("below"))
    # Of two that are as near the upper one has the row.
    first = F.coalesce(F.floor((F.col("above") + F.col("r")) / 2) + 1, F.lit(rows[0]))
    last = F.coalesce(F.floor((F.col("r") + F.col("below")) / 2), F.lit(rows[1]))
    if radius is not None:
        first, last = F.greatest(first, F.col("r") - radius), F.least(last, F.col("r") + radius)
    first, last = F.greatest(first, F.lit(rows[0])), F.least(last, F.lit(rows[1]))
    spread = near.select("c", "r", first.alias("first"), last.alias("last")).filter("first <= last")
    return spread.select("c", F.col("r").alias("at"), F.explode(F.sequence("first", "last")).alias("r")).select("r", "c", F.abs(F.col("r") - F.col("at")).alias("g"))


def envelope(c: np.ndarray, g: np.ndarray, ask: np.ndarray) -> np.ndarray:
    """The least (x - c)^2 + g^2 for each x of ask. c: sorted, distinct."""
    if not len(c):
        return np.full(len(ask), -1, np.int64)
    kept: list[int] = []
    cuts: list[float] = []  # from cuts[i] on the parabola kept[i] is the lowest
    f = (c * c + g * g).tolist()
    at = c.tolist()
    for i in range(len(at)):
        cut = -np.inf
        while kept:
            cut = (f[i] - f[kept[-1]]) / (2 * (at[i] - at[kept[-1]]))
            if cut > cuts[-1]:
                break
            kept.pop()
            cuts.pop()
            cut = -np.inf
        kept.append(i)
        cuts.append(cut)
    best = np.array(kept)[np.searchsorted(cuts, ask, "right") - 1]
    return (ask - c[best]) ** 2 + g[best] ** 2


def _row(cells: pa.Table, sites: pa.Table) -> pa.Table:
    ask = cells.column("c").to_numpy()
    order = np.argsort(sites.column("c").to_numpy())
    c, g = (sites.column(n).to_numpy()[order] for n in ("c", "g"))
    d2 = envelope(c, g, ask)
    return pa.table([cells.column("r"), cells.column("c"), pa.array(d2, pa.int64(), mask=d2 < 0)], names=["r", "c", "d2"])


def distance_to_set(cells: DataFrame, targets: DataFrame, radius: int | None = None) -> DataFrame:
    """r, c, d2 of each of the cells (r, c): the squared distance, in cells, to the nearest of the targets (r, c); null without
    any, or beyond the radius."""
    ask = cells.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c")).distinct()
    ends = ask.agg(F.min("r"), F.max("r")).first()
    sites = _columns(targets, (ends[0] or 0, ends[1] or 0), radius)
    found = ask.groupBy("r").cogroup(sites.groupBy("r")).applyInArrow(_row, "r long, c long, d2 long")
    return found if radius is None else found.withColumn("d2", F.when(F.col("d2") <= radius * radius, F.col("d2")))


def buffer(cells: DataFrame, targets: DataFrame, radius: int) -> DataFrame:
    """r, c of the cells within the radius of the targets."""
    return distance_to_set(cells, targets, radius).filter("d2 IS NOT NULL").select("r", "c")
