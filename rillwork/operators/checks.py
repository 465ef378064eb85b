"""Checks of inputs: all findings come back as (rule, key) rows, or as a list of texts for what only metadata tells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relations import issues

#: The attributes that each layer must have; fixed values.
REQUIRED = {
    "reservoir": ("op", "sa_em", "v_em", "sa_pr", "v_pr"),
    "point_source": ("operation", "table_name"),
    "tile_drain": ("Depth", "Spacing", "Radius", "Elevation", "StartYear", "StartMon", "StartDay"),
    "wascob": ("StartYear", "StartMon", "StartDay", "BermElev", "DeadV", "DeadA", "NormV", "NormA", "MaxV", "MaxA", "MaxQ", "FieldID", "TdrainID"),
    "feedlot": ("cb", "ani_id", "adult", "nonadult", "stoid", "storatio"),
}


def extent_findings(one: dict[str, float], two: dict[str, float]) -> list[str]:
    """Two grids fit if rows, columns, whole cell size and projection are equal, and east and west within a cell."""
    found = [n for n in ("rows", "cols", "epsg") if one[n] != two[n]]
    found += ["res" for n in ("res_x",) if int(one[n]) != int(two[n])]
    return found + [n for n in ("west", "east") if abs(one[n] - two[n]) > one["res_x"]]


def layer_findings(columns: list[str], kind: str, shape: str, wanted_shape: str, epsg: int, wanted_epsg: int) -> list[str]:
    """Projection, kind of shape and required attributes of a layer."""
    found = [] if epsg == wanted_epsg else ["projection"]
    found += [] if shape.lower() == wanted_shape.lower() else ["shape"]
    held = {c.lower() for c in columns}
    return found + [f"column {c}" for c in REQUIRED.get(kind, ()) if c.lower() not in held]


def reservoir(rows: DataFrame) -> list[tuple[str, DataFrame, str]]:
    """Areas and volumes must be above zero, and the emergency ones not below the principal ones."""
    bad = lambda c: rows.filter(F.coalesce(F.col(c), F.lit(0.0)) <= 0)
    rules = [(f"reservoir {c} not above zero", bad(c), "id") for c in ("sa_em", "v_em", "sa_pr", "v_pr")]
    return rules + [("reservoir emergency below principal", rows.filter("sa_em < sa_pr or v_em < v_pr"), "id")]


def dated(rows: DataFrame, kind: str) -> list[tuple[str, DataFrame, str]]:
    """Start dates must be days of the calendar."""
    return [(f"{kind} start is no date", rows.filter("try_make_timestamp(StartYear, StartMon, StartDay, 0, 0, 0) is null"), "id")]


def refers(rows: DataFrame, key: str, layer: DataFrame, rule: str) -> tuple[str, DataFrame, str]:
    """Keys above zero must exist in the other layer."""
    return rule, rows.filter(F.col(key) > 0).join(layer.select(F.col("id").alias(key)).distinct(), key, "left_anti"), "id"


def wascob(rows: DataFrame, fields: DataFrame, drains: DataFrame) -> list[tuple[str, DataFrame, str]]:
    order = rows.filter("DeadV > NormV or NormV > MaxV or DeadA > NormA or NormA > MaxA")
    return [*dated(rows, "wascob"), ("wascob volumes out of order", order, "id"), refers(rows, "FieldID", fields, "wascob of no field"), refers(rows, "TdrainID", drains, "wascob of no tile drain")]


def feedlot(rows: DataFrame, storages: DataFrame, basins: DataFrame, livestock: DataFrame) -> list[tuple[str, DataFrame, str]]:
    """Animals, storages and catch basins must exist; storages and their shares are lists of one length, and the shares sum to one."""
    ids = F.split(F.coalesce("stoid", F.lit("")), r"\s*,\s*")
    shares = F.transform(F.split(F.coalesce("storatio", F.lit("")), r"\s*,\s*"), lambda x: x.try_cast("double"))
    has = F.length(F.coalesce("stoid", F.lit(""))) > 0
    total = F.aggregate(shares, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    each = rows.filter(has).select("id", F.explode(ids).alias("s")).select("id", F.expr("try_cast(s as int)").alias("storage"))
    return [
        refers(rows, "ani_id", livestock, "feedlot of no animal"), refers(rows, "cb", basins, "feedlot of no catch basin"), refers(each, "storage", storages, "feedlot of no storage"),
        ("feedlot storages and shares differ in number", rows.filter(has & (F.size(ids) != F.size(shares))), "id"), ("feedlot shares don't sum to one", rows.filter(has & (F.abs(total - 1) > 1e-6)), "id"),
    ]


def feedlot_layers(boundary: bool, outlets: bool, storages: bool) -> list[str]:
    """Outlets and storages of feedlots are of no use without the feedlots."""
    if boundary:
        return []
    return [f"feedlot boundaries are required with {n}" for n, has in (("outlets", outlets), ("storages", storages)) if has]


def feedlot_references(
    feedlots: DataFrame, outlets: DataFrame | None = None, basins: DataFrame | None = None, storages: DataFrame | None = None
) -> list[tuple[str, DataFrame, str]]:
    """Feedlots and outlets match one to one, in both directions; catch basins that feedlots name (cb) and feedlots that
    storages name (feedlot) exist. Null, empty and "0" name none. A layer that isn't given is not checked. The key is the
    id that lacks its counterpart."""
    ids = lambda df: df.select(F.col("id").cast("string").alias("key"))
    named = lambda df, c: df.select(F.trim(F.col(c).cast("string")).alias("key")).filter("key is not null and key not in ('', '0')")
    absent = lambda one, two: one.join(two.distinct(), "key", "left_anti")
    rules = []
    if outlets is not None:
        several = ids(outlets).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
        rules += [("feedlot without outlet", absent(ids(feedlots), ids(outlets)), "key"), ("outlet of no feedlot", absent(ids(outlets), ids(feedlots)), "key")]
        rules.append(("several outlets of a feedlot", several, "key"))
    if basins is not None:
        rules.append(("catch basin of a feedlot unknown", absent(named(feedlots, "cb"), ids(basins)), "key"))
    if storages is not None:
        rules.append(("feedlot of a storage unknown", absent(named(storages, "feedlot"), ids(feedlots)), "key"))
    return rules


def stations(used: DataFrame, known: DataFrame, readings: DataFrame, first: str, last: str) -> list[tuple[str, DataFrame, str]]:
    """Stations that a type uses must exist, have readings of the type, and cover the period. used: type, idx; readings: type, idx, day."""
    absent = used.join(known.select("idx"), "idx", "left_anti")
    span = readings.groupBy("type", "idx").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    held = used.join(span, ["type", "idx"], "left")
    short = held.filter(F.col("a").isNotNull() & ((F.col("a") > F.lit(first).cast("date")) | (F.col("b") < F.lit(last).cast("date"))))
    return [("station unknown", absent, "idx"), ("station without readings", held.filter("a is null"), "idx"), ("station period too short", short, "idx")]


def findings(*groups: list[tuple[str, DataFrame, str]]) -> DataFrame:
    return issues([rule for group in groups for rule in group])


def large_enough(rows: DataFrame, area: str, least_ha: float = 0.0001) -> DataFrame:
    """Without slivers, or without polygons below an area."""
    return rows.filter(F.col(area) > least_ha)


def containing_text(rows: DataFrame, column: str, text: str) -> DataFrame:
    return rows.filter(F.col(column).contains(text))
