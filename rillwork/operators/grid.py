"""Operators on cell tables: one row for each valid cell at (r, c)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .iterate import written

#: k = 0..7 from north-east clockwise: code 2^k, column step, row step; even k are diagonals. Fixed values.
STEPS = [(0, 1, -1), (1, 1, 0), (2, 1, 1), (3, 0, 1), (4, -1, 1), (5, -1, 0), (6, -1, -1), (7, 0, -1)]

#: The side of the squares in which cells look at their neighbours; a task's group has as many cells squared at most.
SQUARE = 256


def running_total(df: DataFrame, value: str, *order: str, name: str = "before") -> DataFrame:
    """The sum of value over all rows before each in the order, which has to be unique. Rows are dealt by ranges and written,
    so each task sums its own range; only one row for each range meets in one window. No key or value is a hot one."""
    dealt = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()))
    sums = dealt.groupBy("__part").agg(F.sum(value).alias("__sum"))
    offsets = sums.select("__part", (F.sum("__sum").over(Window.orderBy("__part")) - F.col("__sum")).alias("__offset"))
    own = F.sum(value).over(Window.partitionBy("__part").orderBy(*order)) - F.col(value)
    return dealt.withColumn(name, own).join(F.broadcast(offsets), "__part").withColumn(name, F.col(name) + F.col("__offset")).drop("__part", "__offset")


def rank_rows(df: DataFrame, *order: str, name: str = "row_id", start: int = 1) -> DataFrame:
    """Row numbers in an order that has to be unique, whatever the distribution of its values."""
    one = running_total(df.withColumn("__one", F.lit(1).cast("long")), "__one", *order, name=name)
    return one.withColumn(name, (F.col(name) + start).cast("long")).drop("__one")


def number_rows(df: DataFrame, group: str, *order: str, name: str = "row_id", start: int = 1) -> DataFrame:
    """Row numbers by group, then order, without a window over all rows: numbers within groups, plus the groups' offsets, which are running totals over the groups' sizes."""
    sizes = df.groupBy(group).agg(F.count("*").alias("__n"))
    offsets = running_total(sizes, "__n", group, name="__before").select(group, "__before")
    own = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.join(offsets, group).withColumn(name, (own + F.col("__before") + (start - 1)).cast("long")).drop("__before")


def con(test: Column, yes: Column, no: Column) -> Column:
    """Map algebra's conditional: NULL where the test is NULL."""
    return F.when(test, yes).when(~test, no)


def step_table(res_x: float, res_y: float) -> Column:
    """The eight neighbours as (k, dx, dy, dist)."""
    diagonal = (res_x**2 + res_y**2) ** 0.5
    return F.array(*[F.struct(F.lit(k).alias("k"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(diagonal if k % 2 == 0 else res_x if dy == 0 else res_y).alias("dist")) for k, dx, dy in STEPS])


def _neighbours(t: pa.Table, fields: list[tuple[str, str]], own: list[str]) -> pa.Table:
    """A square's own cells with their neighbours' values; __own is false on the cells of the squares beside it."""
    t = t.combine_chunks()
    is_own, known = (pc.fill_null(x, False).to_numpy(zero_copy_only=False) for x in (t["__own"].combine_chunks(), pc.and_(t["r"].is_valid(), t["c"].is_valid()).combine_chunks()))
    r, c = (t[n].combine_chunks().cast(pa.int64()).fill_null(0).to_numpy() for n in ("r", "c"))
    top, left = (int(x[known].min()) if known.any() else 0 for x in (r, c))
    y, x = np.where(known, r - top + 1, 0), np.where(known, c - left + 1, 0)
    at = np.full((int(y.max()) + 2, int(x.max()) + 2), -1)
    at[y[known], x[known]] = np.flatnonzero(known)
    y, x, lone = y[is_own], x[is_own], ~known[is_own]
    cols = {n: t[n].filter(pa.array(is_own)) for n in own}
    for k, dx, dy in STEPS:
        # Cells without a place have no neighbours.
        to = np.where(lone, -1, at[np.where(lone, 0, y + dy), np.where(lone, 0, x + dx)])
        for name, of in fields:
            cols[f"{name}{k}"] = t[of].take(pa.array(to, mask=to < 0))
    return pa.table(cols)


def neighbour_values(cells: DataFrame, value: str, also: str | None = None) -> DataFrame:
    """The cells with their eight neighbours' values as n0 to n7 (NULL where there is none), and those of also as i0 to i7.

    Cells are dealt to squares of SQUARE cells' side, those at a square's edge to the ones beside it too, and a task looks
    beside the cells of a square: one shuffle of little more than one row for each cell."""
    own = [c for c in cells.columns if c not in ("r", "c")]
    square = lambda n, d: F.floor((F.col(n) + d) / SQUARE)
    places = [F.struct(square("r", i).alias("r"), square("c", j).alias("c"), F.lit(i == j == 0).alias("own")) for i in (0, -1, 1) for j in (0, -1, 1)]
    mine = F.struct(square("r", 0).alias("r"), square("c", 0).alias("c"), F.lit(True).alias("own"))
    inside = F.coalesce((F.pmod("r", F.lit(SQUARE)).between(1, SQUARE - 2)) & (F.pmod("c", F.lit(SQUARE)).between(1, SQUARE - 2)), F.lit(True))
    beside = lambda x: x["own"] | (x["r"] != square("r", 0)) | (x["c"] != square("c", 0))
    dealt = F.explode(F.when(inside, F.array(mine)).otherwise(F.array_distinct(F.filter(F.array(*places), beside)))).alias("__at")
    narrow = list(dict.fromkeys([*own, value, *([also] if also else [])]))
    rows = cells.select("r", "c", *narrow, dealt).select("r", "c", *narrow, F.col("__at.r").alias("__r"), F.col("__at.c").alias("__c"), F.col("__at.own").alias("__own"))
    fields = [("n", value), *([("i", also)] if also else [])]
    names = ["r", "c", *own]
    kinds = cells.select(*names, *[F.col(of).alias(f"{name}{k}") for name, of in fields for k, _, _ in STEPS]).schema
    made = StructType([StructField(f.name, f.dataType, True) for f in kinds])
    order = [f"{name}{k}" for name, _ in fields for k, _, _ in STEPS]
    return rows.groupBy("__r", "__c").applyInArrow(lambda t: _neighbours(t, fields, names).select([*names, *order]), made)


def d8_pointer(cells: DataFrame, res: float) -> DataFrame:
    """r, c, code (2^k of the steepest descent, ties to the least k; 0 without one) and k."""
    wide = neighbour_values(cells.select("r", "c", "cell_index", "dem"), "dem")
    diagonal = (2 * res * res) ** 0.5
    drops = [F.when(F.col("dem") > F.col(f"n{k}"), F.struct(((F.col("dem") - F.col(f"n{k}")) / F.lit(diagonal if k % 2 == 0 else res)).alias("drop"), F.lit(-k).alias("m"))) for k, _, _ in STEPS]
    k = -F.greatest(*drops)["m"]
    return wide.select("r", "c", "cell_index", k.alias("k")).withColumn("code", F.coalesce(F.expr("shiftleft(1, k)"), F.lit(0)))


def flow_edges(cells: DataFrame, res: float, cols: int) -> DataFrame:
    """cell_index, down (NULL at outlets), dist: the drainage graph. down is arithmetic, as a pointer never leaves the grid."""
    step = F.element_at(step_table(res, res), F.col("k") + 1)
    p = d8_pointer(cells, res)
    return p.select("cell_index", F.when(F.col("k").isNotNull(), ((F.col("r") + step["dy"]) * cols + F.col("c") + step["dx"]).cast("long")).alias("down"), F.when(F.col("k").isNotNull(), step["dist"]).otherwise(0.0).alias("dist"))


def border_cells(cells: DataFrame, zone: str) -> DataFrame:
    """Cells of a zone with fewer than eight neighbours in it."""
    wide = neighbour_values(cells.select("r", "c", zone), zone)
    same = [F.coalesce((F.col(f"n{k}") == F.col(zone)).cast("int"), F.lit(0)) for k, _, _ in STEPS]
    return wide.filter(sum(same[1:], same[0]) < 8).select("r", "c", zone)
