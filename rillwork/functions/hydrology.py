"""Hydrologic formulas as column functions. All stay inside generated code; nodata is NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (A, B) of width and depth by return period in years; fixed values.
WIDTH = {2: (1.0, 0.56), 10: (1.2, 0.56), 100: (1.4, 0.56)}
DEPTH = {2: (0.04, 0.45), 10: (0.12, 0.52), 100: (0.18, 0.55)}
#: Pointer codes of diagonal steps; fixed values.
DIAGONAL = (1, 4, 16, 64)


def clamp(x: Column, low: float, high: float) -> Column:
    """NULL stays NULL, which greatest() and least() alone would pass over."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def slope_tan(degrees: Column) -> Column:
    return F.tan(F.radians(degrees))


def power_law(acc: Column, cell_km2: float, a: float, b: float) -> Column:
    return F.pow(acc * cell_km2 * a, F.lit(b))


def reach_width(acc: Column, cell_km2: float, period: int) -> Column:
    return power_law(acc, cell_km2, *WIDTH.get(period, (1.0, 0.56)))


def reach_depth(acc: Column, cell_km2: float, period: int) -> Column:
    return power_law(acc, cell_km2, *DEPTH.get(period, (0.04, 0.45)))


def manning_velocity(slope: Column, depth: Column, n: Column) -> Column:
    return clamp(F.sqrt(slope) * F.pow(depth, F.lit(0.6667)) / n, 0.005, 3.0)


def wetness_index(acc: Column, cell_m2: float, slope: Column) -> Column:
    """NULL where the slope is zero."""
    return F.log(F.try_divide(acc * cell_m2, slope))


def initial_moisture(wti: Column, low: Column, high: Column, capacity: Column) -> Column:
    """low, high: the index's least and greatest values on the grid."""
    top = 0.8 * high
    return ((F.least(wti, top) - low) * 0.95 / (top - low) + 0.05) * capacity


def stream_fraction(width: Column, cell_m: float, code: Column) -> Column:
    """Share of a cell that its reach covers; longer across a diagonal; none off the reach."""
    f = width / cell_m
    return F.coalesce(clamp(F.when(code.isin(*DIAGONAL), F.lit(1.41421356) * f - F.lit(0.5) * f * f).otherwise(f), 0.0, 1.0), F.lit(0.0))


def runoff_coefficient(base: Column, slope: Column, slope0: Column, impervious: Column, grass: Column, grass_slope0: Column, stream: Column, literal: bool = False) -> Column:
    """literal: the slope factor is one wherever it is defined."""
    factor = lambda s0: F.when(slope + s0 > 0, F.lit(1.0) if literal else slope / (slope + s0)).otherwise(0.0)
    plain = base + (1 - base) * factor(slope0)
    lawn = grass + (1 - grass) * factor(grass_slope0)
    urban = F.when((impervious > 0) & (impervious < 1), plain * impervious + lawn * (1 - impervious)).otherwise(plain)
    return clamp(F.when(stream > 0, stream + (1 - stream) * urban).otherwise(urban), 0.0, 1.0)


def depression_storage(base: Column, slope: Column, impervious: Column, grass: Column, stream: Column) -> Column:
    decay = F.exp(-9.5 * slope / 100)
    land = F.when((impervious > 0) & (impervious < 1), (base * impervious + grass * (1 - impervious)) * decay).otherwise(base * decay)
    return F.when(stream > 0, clamp((1 - stream) * land, 0.0, 1.0)).otherwise(land)


def curve_number(table: Column, group: Column, stream: Column) -> Column:
    """table: array of the numbers of groups A to D; group: 1 to 4."""
    cn = F.element_at(table, group)
    return F.when(stream > 0, clamp(100 * stream + (1 - stream) * cn, 35.0, 100.0)).otherwise(cn)


def wetland_volume(area: Column) -> Column:
    return F.when(area < 70, 2.85 * F.pow(area, F.lit(1.22)) / 10).otherwise((7.1 * area + 9.97) / 10)


def lateral_width(area_ha: Column) -> Column:
    return F.sqrt(area_ha * 10_000) / 10


def travel_terms(slope_percent: Column, acc: Column, manning: Column, cell_km2: float, a: float, b: float) -> dict[str, Column]:
    """Terms of a cell's unit hydrograph: radius, velocity, celerity, t (1/celerity) and delta (2d / celerity^3)."""
    slope = F.greatest(slope_percent / 100, F.lit(0.001))
    radius = a * F.pow(acc * cell_km2, F.lit(b))
    velocity = clamp(F.pow(radius, F.lit(2 / 3)) * F.sqrt(slope) / F.greatest(manning, F.lit(0.001)), 0.005, 3.0)
    celerity = velocity * 5 / 3
    d = velocity * radius / (2 * slope)
    return {"radius": radius, "velocity": velocity, "celerity": celerity, "t": 1 / celerity, "delta": 2 * d / F.pow(celerity, F.lit(3.0))}
