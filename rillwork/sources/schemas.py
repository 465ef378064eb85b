"""Schemas of the tables that the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame

SCHEMAS: dict[str, str] = {
    "cell_store": "raster string, r int, c int, value double",
    "grid_meta": "raster string, rows int, cols int, res_x double, res_y double, west double, east double, south double, north double, nodata double, epsg int",
    "stations": "ID int, NAME string, XPR double, YPR double, LAT double, LONG double, ELEVATION double, AREA double",
    "station_data": "type string, station int, date date, value double",
    "lookup": "original_id int, model_id int",
    "parameter": "Parameter string, Description string, Unit string, Module_ID string, Value double, Impact string, Change double, Max double, Min double, Use int",
    "crop_management": "location int, year int, crop int, planting date, harvest date",
    "reach": "reach int, receive int, contribution_ha double, elevation double",
    "weights": "type string, cell_index long, idx int, weight double",
}


def same_columns(df: DataFrame, columns: list[str]) -> bool:
    """Whether a table has exactly these columns, in any order and case."""
    return sorted(c.lower() for c in df.columns) == sorted(c.lower() for c in columns)
