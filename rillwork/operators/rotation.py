"""Crop rotation: dominant crops, calendars and the daily deposit of grazing animals."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import coded_day, in_window

#: Days of a span, and stays in a partition; fixed values.
SPAN = 64
STAYS = 100_000


def dominant_crop(inventory: DataFrame) -> DataFrame:
    """inventory: year, field, code, cell_index. The most frequent code of each field and year, of equals the first met; years count from the first."""
    counts = inventory.groupBy("year", "field", "code").agg(F.count("*").alias("n"), F.min("cell_index").alias("first"))
    best = counts.groupBy("year", "field").agg(F.max(F.struct("n", (-F.col("first")).alias("f"), "code")).alias("b"))
    start = inventory.agg(F.min("year").alias("y0"))
    return best.join(start, F.lit(True)).select(F.col("field").alias("location"), (F.col("year") - F.col("y0") + 1).alias("year"), F.col("b.code").alias("crop"))


def crop_calendar(seasons: DataFrame, management: DataFrame) -> DataFrame:
    """seasons: location, year, crop. management: crop, plant_first, plant_last, harvest_first, harvest_last, growing_days (NULL: a day in the harvest window), previous_year."""
    own = seasons.join(management, "crop")
    planting = in_window(F.col("plant_first"), F.col("plant_last"), F.col("location"), F.col("year"), 1)
    own = own.withColumn("planting", planting)
    harvest = F.when(F.col("growing_days") > 0, F.date_add("planting", F.col("growing_days").cast("int"))).otherwise(in_window(F.col("harvest_first"), F.col("harvest_last"), F.col("location"), F.col("year"), 2))
    return own.select("location", "year", "crop", "previous_year", "planting", harvest.alias("harvest"))


def winter_shift(calendar: DataFrame) -> DataFrame:
    """A crop sown in the previous year isn't planted before that year's harvest; then its year is one less, and year 0 becomes January 1 of year 1."""
    before = calendar.select("location", (F.col("year") + 1).alias("year"), F.col("harvest").alias("last_harvest"))
    held = calendar.join(before, ["location", "year"], "left")
    late = F.when(F.col("previous_year") & (F.col("planting") < F.col("last_harvest")), F.col("last_harvest")).otherwise(F.col("planting"))
    year = F.col("year") - F.col("previous_year").cast("int")
    return held.select("location", "crop", F.greatest(year, F.lit(1)).alias("year"), F.when(year == 0, F.make_date(F.lit(2000), F.lit(1), F.lit(1))).otherwise(late).alias("planting"), "harvest")


def scheduled(calendar: DataFrame, operations: DataFrame, op: int) -> DataFrame:
    """operations: crop, code, first, last and what else is to be carried: a row for each season and operation, with its day."""
    own = calendar.join(operations, "crop")
    on = coded_day(F.col("code"), F.col("first"), F.col("last"), F.col("planting"), F.col("harvest"), F.col("location"), F.col("year"), op)
    return own.select("location", "year", "crop", on.alias("day"), *[c for c in operations.columns if c not in ("crop", "first", "last")])


def daily_deposit(grazing: DataFrame, sums: list[str], least: str) -> DataFrame:
    """grazing: reach, start, days and daily amounts. A row for each reach and day: sums and the least of the bank factor.

    Only stays are shuffled, dealt by reach and span of days; their days are made and summed where they meet, STAYS to a partition."""
    number = F.unix_date("start")
    own = grazing.filter("days > 0 and start is not null")
    n = max(1, math.ceil(own.count() / STAYS))
    spans = F.explode(F.sequence(F.floor(number / SPAN), F.floor((number + F.col("days") - 1) / SPAN))).alias("__span")
    dealt = own.select("reach", number.alias("__first"), (number + F.col("days") - 1).alias("__last"), *sums, least, spans).repartition(n, "reach", "__span")
    low, high = F.greatest(F.col("__first").cast("long"), F.col("__span") * SPAN), F.least(F.col("__last").cast("long"), F.col("__span") * SPAN + SPAN - 1)
    daily = dealt.select("reach", "__span", F.explode(F.sequence(low, high)).alias("__day"), *sums, least)
    found = daily.groupBy("reach", "__span", "__day").agg(*[F.sum(s).alias(s) for s in sums], F.min(least).alias(least))
    return found.select("reach", F.date_from_unix_date(F.col("__day").cast("int")).alias("day"), *sums, least)
