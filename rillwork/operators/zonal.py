"""Zonal statistics and overlays: one aggregation answers one question, with explicit tie keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grid import number_rows, running_total


def category_area(cells: DataFrame, zone: str, cell_ha: float) -> DataFrame:
    return cells.groupBy(zone).agg((F.count("*") * cell_ha).alias("area_ha"))


def zone_median(cells: DataFrame, zone: str, value: str) -> DataFrame:
    """The exact median of each zone: equal values are counted first, and a running total over (zone, value) in ranges gives
    their ranks, so no task holds a zone."""
    counts = cells.filter(F.col(value).isNotNull()).groupBy(zone, value).agg(F.count("*").alias("n"))
    ranked = running_total(counts, "n", zone, value)
    ends = ranked.groupBy(F.col(zone).alias("__zone")).agg(F.min("before").alias("start"), F.sum("n").alias("size"))
    own = ranked.join(ends, F.col(zone).eqNullSafe(F.col("__zone"))).withColumn("at", F.col("before") - F.col("start"))
    holds = lambda place: (F.col("at") <= place) & (place < F.col("at") + F.col("n"))
    low, high = (F.max(F.when(holds(F.floor(x / 2)), F.col(value))) for x in (F.col("size") - 1, F.col("size")))
    return own.groupBy(zone).agg(((low + high) / 2).alias("median"))


def zonal_stats(cells: DataFrame, zone: str, value: str) -> DataFrame:
    v = F.col(value)
    sums = cells.groupBy(zone).agg(F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), (F.max(v) - F.min(v)).alias("range"), F.stddev_pop(v).alias("stdev"), F.sum(v).alias("total"))
    median = zone_median(cells, zone, value).withColumnRenamed(zone, "__own")
    return sums.join(median, F.col(zone).eqNullSafe(F.col("__own")), "left").select(zone, "mean", "median", "min", "max", "range", "stdev", "total")


def majority(cells: DataFrame, zone: str, value: str) -> DataFrame:
    """The most frequent value of each zone; of equals the one that a row-major scan meets first. Counts come first, so a large zone is no large group."""
    counts = cells.groupBy(zone, value).agg(F.count("*").alias("n"), F.min("cell_index").alias("first"))
    best = counts.groupBy(zone).agg(F.max(F.struct("n", (-F.col("first")).alias("f"), value)).alias("b"))
    return best.select(zone, F.col(f"b.{value}").alias(value), F.col("b.n").alias("n_cells"))


def overlay(cells: DataFrame, one: str, two: str, cell_ha: float) -> DataFrame:
    """Area of every pair of zones, its share of either, numbered by (two, one). The totals come from the pairs, not from the cells again."""
    pairs = cells.groupBy(one, two).agg(F.count("*").alias("n"))
    by_one = pairs.groupBy(one).agg(F.sum("n").alias("n_one"))
    by_two = pairs.groupBy(two).agg(F.sum("n").alias("n_two"))
    joined = pairs.join(by_one, one).join(by_two, two)
    shares = joined.select(one, two, (F.col("n") * cell_ha).alias("area_ha"), (F.col("n") / F.col("n_one")).alias(f"to_{one}"), (F.col("n") / F.col("n_two")).alias(f"to_{two}"))
    return number_rows(shares, two, one)


def reclassify(cells: DataFrame, value: str, lookup: DataFrame, key: str, new: str) -> DataFrame:
    """Lookup by the value's integer part; missing_ids() tells what a strict lookup would fail on. Spark broadcasts the lookup if its size allows."""
    return cells.join(lookup.select(F.col(key).alias("__key"), F.col(new).alias("new_value")), F.col(value).cast("long") == F.col("__key"), "left").drop("__key")


def missing_ids(cells: DataFrame, value: str, lookup: DataFrame, key: str) -> DataFrame:
    return cells.select(F.col(value).cast("long").alias("id")).distinct().join(lookup.select(F.col(key).cast("long").alias("id")), "id", "left_anti")
