"""Relational steps between features: pivots, defaults, validation, series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pivot_types(rows: DataFrame, key: str, kind: str, value: str, seq: str, kinds: list[int], keys: DataFrame) -> DataFrame:
    """A column for each kind, with the last value by seq; 0 where there is none; every key of keys. One aggregation."""
    own = rows.groupBy(key).agg(*[F.max_by(F.when(F.col(kind) == k, F.col(value)), F.when(F.col(kind) == k, F.col(seq))).alias(f"type_{k}") for k in kinds])
    return keys.join(own, key, "left").select(key, *[F.coalesce(f"type_{k}", F.lit(0)).alias(f"type_{k}") for k in kinds])


def issues(checks: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """All findings of a list of (rule, offending rows, key column), not the first alone."""
    out = None
    for rule, rows, key in checks:
        own = rows.select(F.lit(rule).alias("rule"), F.col(key).cast("long").alias("key")).distinct()
        out = own if out is None else out.unionByName(own)
    return out


def common_period(readings: DataFrame, low: str = "1900-01-01", high: str = "2100-12-31") -> DataFrame:
    """The latest first and the earliest last day over the types."""
    by = readings.groupBy("type").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    return by.agg(F.greatest(F.max("a"), F.lit(low).cast("date")).alias("start"), F.least(F.min("b"), F.lit(high).cast("date")).alias("end"))


def forward_fill(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    own = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("filled", F.last(value, ignorenulls=True).over(own))
