"""Farm calendars: portable pseudo-random days and the codes that tie one day to another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All windows lie in a leap year.
YEAR = 2000


def pick(days: Column, location: Column, year: Column, op: int, seed: int = 0) -> Column:
    """0 to days, from the row's own keys: the same in every run and engine."""
    return F.pmod(location * 7919 + year * 104_729 + F.lit(op * 1_299_709 + seed), days + 1)


def day(month: Column, of_month: Column) -> Column:
    return F.make_date(F.lit(YEAR), month, of_month)


def in_window(first: Column, last: Column, location: Column, year: Column, op: int) -> Column:
    return F.date_add(first, pick(F.datediff(last, first), location, year, op).cast("int"))


def coded_day(code: Column, first: Column, last: Column, planting: Column, harvest: Column, location: Column, year: Column, op: int) -> Column:
    """A code above -100 and below 0 counts from the harvest (by code + 100), one of -100 or less from the planting (by code + 1000); else a day in the window."""
    return F.when((code > -100) & (code < 0), F.date_add(harvest, (code + 100).cast("int"))).when(code <= -100, F.date_add(planting, (code + 1000).cast("int"))).otherwise(in_window(first, last, location, year, op))
