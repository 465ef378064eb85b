"""Named assets over a project: each is a DataFrame made on demand, once, and kept as a table where asked."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import hydrology as H
from .operators import bmp, delineation, flow, grid, reach, relations, rotation, subarea, weights, zonal
from .operators.iterate import written
from .sources import io, project
from .sources.io import save_table

Asset = Callable[["Engine"], DataFrame]


def _acc(e: "Engine") -> DataFrame:
    return flow.tree(e["flow_edges"].select("cell_index", "down", F.lit(1).cast("long").alias("acc")), ["acc"])


def _reach_cells(e: "Engine") -> DataFrame:
    own = e.cells.select("cell_index", "dem").join(e["acc"], "cell_index").join(e["subbasins"].select("cell_index", "subbasin"), "cell_index")
    km2 = e.res * e.res / 1e6
    depth = H.reach_depth(F.col("acc"), km2, 2)
    own = own.withColumn("is_stream", F.col("acc") * e.cell_ha >= e.stream_ha).withColumn("width", H.reach_width(F.col("acc"), km2, 2))
    return own.withColumn("depth", depth).withColumn("velocity", H.manning_velocity(F.lit(0.01), depth, F.lit(0.05)))


def _receive(e: "Engine") -> DataFrame:
    return e["reach_parameter"].select(F.col("subbasin_id").alias("subbasin"), F.col("receive_reach_id").alias("receive"))


def _reach_bmp(e: "Engine") -> DataFrame:
    """The structure of each kind in each reach's subbasin, 0 for none; of several the greatest id."""
    kinds = [k for k in REACH_KINDS if k in e.features]
    rows = reduce(DataFrame.unionByName, [e[k].select("subbasin", F.lit(i).alias("kind"), F.col("id").cast("long").alias("id")) for i, k in enumerate(kinds, 1)])
    keys = e["subbasins"].select("subbasin").distinct()
    return relations.pivot_types(rows, "subbasin", "kind", "id", "id", list(range(1, len(kinds) + 1)), keys).withColumnsRenamed({f"type_{i}": k for i, k in enumerate(kinds, 1)})


#: Structures of reaches, in the order of their columns.
REACH_KINDS = ("point_source", "reservoir")

#: What is derived from the cells, by name; each names what it needs through the engine.
ASSETS: dict[str, Asset] = {
    "flow_edges": lambda e: grid.flow_edges(e.cells, e.res, e.cols),
    "acc": _acc,
    "slope": lambda e: delineation.slope_degrees(e.cells, "dem", e.res),
    "streams": lambda e: delineation.threshold_streams(e["acc"], e.stream_ha, e.cell_ha),
    "stream_ends": lambda e: delineation.stream_ends(e["flow_edges"], e["streams"]),
    "pour_points": lambda e: delineation.merge_pour_points({"streams": e["stream_ends"], **e.pour_points}),
    "subbasins": lambda e: delineation.subbasins(e["flow_edges"], e["pour_points"]),
    "stream_lines": lambda e: delineation.stream_lines(e["flow_edges"], e["streams"], e["subbasins"]),
    "watershed": lambda e: flow.jump(e["flow_edges"].withColumnRenamed("dist", "length"), ["length"]),
    "reach_cells": _reach_cells,
    "reach_parameter": lambda e: reach.reach_parameter(e["reach_cells"], e["flow_edges"], e.cell_ha, e.res),
    "reach_lookup": lambda e: flow.closure(e["reach_parameter"].select("reach_id", "receive_reach_id"), "reach_id", "receive_reach_id"),
    "field_cells": lambda e: e.cells.select("cell_index", "field").join(e["subbasins"].select("cell_index", "subbasin"), "cell_index"),
    "overlay": lambda e: zonal.overlay(e["field_cells"], "field", "subbasin", e.cell_ha),
    "field_area": lambda e: zonal.category_area(e.cells, "field", e.cell_ha),
    "dominant_landuse": lambda e: zonal.majority(e.cells, "field", "landuse"),
    "dominant_crop": lambda e: rotation.dominant_crop(e.inventory),
    "subbasin_multiplier": lambda e: bmp.subbasin_multiplier(e["subbasins"]),
    "manure_feedlot": lambda e: bmp.feedlot(e.features["feedlot"], e.features["livestock"]),
    "manure_catch_basin": lambda e: bmp.catch_basin(e.features["catch_basin"], e["subbasins"], _receive(e)),
    "point_source": lambda e: bmp.point_source(e.features["point_source"], e["subbasins"]),
    "reservoir": lambda e: bmp.reservoir(e.features["reservoir"], e["subbasins"]),
    "reach_bmp": _reach_bmp,
}
#: What each asset is made of: other assets, columns of the cells, tables of features, and the engine's own numbers.
NEEDS: dict[str, tuple[str, ...]] = {
    "flow_edges": ("cells.dem", "res", "cols"),
    "acc": ("flow_edges",),
    "slope": ("cells.dem", "res"),
    "streams": ("acc", "stream_ha", "cell_ha"),
    "stream_ends": ("flow_edges", "streams"),
    "pour_points": ("stream_ends", "pour_points.*"),
    "subbasins": ("flow_edges", "pour_points"),
    "stream_lines": ("flow_edges", "streams", "subbasins"),
    "watershed": ("flow_edges",),
    "reach_cells": ("cells.dem", "acc", "subbasins", "res", "cell_ha", "stream_ha"),
    "reach_parameter": ("reach_cells", "flow_edges", "cell_ha", "res"),
    "reach_lookup": ("reach_parameter",),
    "field_cells": ("cells.field", "subbasins"),
    "overlay": ("field_cells", "cell_ha"),
    "field_area": ("cells.field", "cell_ha"),
    "dominant_landuse": ("cells.field", "cells.landuse"),
    "dominant_crop": ("inventory",),
    "subbasin_multiplier": ("subbasins",),
    "manure_feedlot": ("features.feedlot", "features.livestock"),
    "manure_catch_basin": ("features.catch_basin", "subbasins", "reach_parameter"),
    "point_source": ("features.point_source", "subbasins"),
    "reservoir": ("features.reservoir", "subbasins"),
    "reach_bmp": ("point_source", "reservoir", "subbasins"),
}
#: Steps of a whole run, in the order in which tables are built.
DELINEATION = ("flow_edges", "acc", "slope", "streams", "pour_points", "subbasins", "stream_lines")
PARAMETERS = ("reach_parameter", "reach_lookup", "overlay", "field_area", "dominant_landuse", "subbasin_multiplier")
ROTATION = ("dominant_crop",)
#: Management tables, built where their features are given.
MANAGEMENT = ("manure_feedlot", "manure_catch_basin", "point_source", "reservoir", "reach_bmp")


class Engine:
    """Assets by name, each made on demand and once. Those in kept are written and read by all that need them; the others are
    plans that Spark joins into one job. pour_points: further sources by name (cell_index). inventory: year, field, code,
    cell_index. features: tables of management features by name.

    update() builds tables in the order of their needs, and only those whose inputs have changed since they were saved:
    each asset has a fingerprint of what it needs, down to the contents of the columns and tables that were given."""

    def __init__(
        self, spark: SparkSession, cells: DataFrame, res: float, cols: int, assets: dict[str, Asset] | None = None,
        kept: tuple[str, ...] = ("flow_edges", "acc", "subbasins", "reach_parameter"), stream_ha: float = 10.0,
        pour_points: dict[str, DataFrame] | None = None, inventory: DataFrame | None = None,
        features: dict[str, DataFrame] | None = None,
    ) -> None:
        self.features = features or {}
        self.spark, self.cells, self.res, self.cols, self.kept = spark, cells, res, cols, set(kept)
        self.cell_ha, self.stream_ha, self.pour_points, self.inventory = res * res / 10_000, stream_ha, pour_points or {}, inventory
        self.assets = ASSETS | (assets or {})
        self._made: dict[str, DataFrame] = {}
        self._prints: dict[str, str | None] = {}
        self._inputs: dict[str, str | None] = {}

    def delineate(self, database: str) -> list[str]:
        return self.update(database, DELINEATION)

    def parameters(self, database: str) -> list[str]:
        return self.update(database, PARAMETERS)

    def crop_rotation(self, database: str) -> list[str]:
        return self.update(database, ROTATION) if self.inventory is not None else []

    def management(self, database: str) -> list[str]:
        """The management tables of the features that are given."""
        given = [n for n in MANAGEMENT if all(x.partition(".")[2] in self.features for x in NEEDS[n] if x.startswith("features."))]
        if not any(k in self.features for k in REACH_KINDS):
            given.remove("reach_bmp")
        return self.update(database, given)

    def scenario(self, database: str, folder: str, config: list[str]) -> None:
        """The model's files: constants and the reach table."""
        io.model_files(self.spark, folder, config)
        io.reach_parameter_file(self.spark, self["reach_parameter"], f"{folder}/reachParameter.txt")

    def climate(self, database: str, folder: str, scenario: project.Scenario, stations: DataFrame, readings: DataFrame) -> project.Scenario:
        """The scenario's input list and its stations' weights, by the stations and the period of the readings where the
        scenario names none. stations: idx, sx, sy; readings: type, station, day. A type's stations are thousands at most."""
        ends = readings.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
        held: dict[str, list[int]] = {}
        for r in readings.select("type", "station").distinct().orderBy("type", "station").toLocalIterator():
            held.setdefault(r.type, []).append(r.station)
        own = scenario.resolved(held, ends.a, ends.b)
        cells = self.cells.join(self["subbasins"].select("cell_index", "subbasin"), "cell_index")
        areas = subarea.with_subarea(cells) if own.model_type == "subarea" else None
        n = areas.agg(F.countDistinct("subarea").alias("n")).first().n if areas is not None else -1
        lines = own.file_in(self.res, cells.count(), n, cells.agg(F.countDistinct("subbasin").alias("n")).first().n)
        io.input_file(self.spark, f"{folder}/file.in", lines)
        used = self.spark.createDataFrame([(k, i) for k, ids in own.stations.items() for i in ids], "type string, idx int")
        at, zone = (cells, None) if areas is None else (areas, "subarea")
        made = weights.scenario_weights(own.method or "inverse_distance", at, stations, used, own.radius / self.res, zone)
        io.save_table(made, f"{database}.weight")
        return own

    def run(self, database: str, folder: str, config: list[str] | None = None, climate: tuple[project.Scenario, DataFrame, DataFrame] | None = None) -> list[str]:
        """All steps: delineation, parameters, crop rotation, management, scenario, and the climate's files and weights where a
        scenario with stations and readings is given. The tables that were built anew."""
        built = [*self.delineate(database), *self.parameters(database), *self.crop_rotation(database), *self.management(database)]
        self.scenario(database, folder, config or [])
        if climate:
            self.climate(database, folder, *climate)
        return built

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            made = self.assets[name](self)
            self._made[name] = written(made) if name in self.kept else made
        return self._made[name]

    def save(self, database: str, names: list[str]) -> None:
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
        for name in names:
            save_table(self[name], f"{database}.{name}")

    def in_order(self, names: Iterable[str]) -> list[str]:
        """The names, each behind all that it needs."""
        out: list[str] = []

        def visit(name: str) -> None:
            if name not in out:
                for x in NEEDS.get(name, ()):
                    if x in NEEDS:
                        visit(x)
                out.append(name)

        for name in names:
            visit(name)
        return [n for n in out if n in set(names)]

    def _contents(self, df: DataFrame) -> str:
        own = df.agg(F.count("*"), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)]).cast("decimal(38,0)"))).first()
        return f"{sorted(df.columns)} {own[0]} {own[1]}"

    def _input(self, need: str) -> str:
        """What an input holds: a number of the engine, a column of the cells, or a table."""
        kind, _, name = need.partition(".")
        if kind == "cells":
            return self._contents(self.cells.select("cell_index", name))
        if kind == "features":
            return self._contents(self.features[name]) if name in self.features else "none"
        if kind == "pour_points" and name:
            return " ".join(f"{k} {self._contents(df)}" for k, df in self.pour_points.items())
        if kind == "inventory":
            return self._contents(self.inventory)
        return repr(getattr(self, need))

    def fingerprint(self, name: str) -> str | None:
        """Of an asset's needs, all the way down; none for an asset that says nothing of its needs."""
        if name not in self._prints:
            needs = NEEDS.get(name)
            if needs is None or self.assets[name] is not ASSETS.get(name):
                self._prints[name] = None
            else:
                for x in needs:
                    if x not in NEEDS and x not in self._inputs:
                        self._inputs[x] = self._input(x)
                parts = [self.fingerprint(x) if x in NEEDS else self._inputs[x] for x in needs]
                self._prints[name] = None if None in parts else hashlib.md5("|".join([name, *parts]).encode()).hexdigest()
        return self._prints[name]

    def update(self, database: str, names: Iterable[str]) -> list[str]:
        """Build those of the tables whose fingerprints are not the saved ones, in order; the others are read. Returns the names of those built."""
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
        state = f"{database}.asset_state"
        saved = {r.name: r.fingerprint for r in self.spark.table(state).collect()} if io.table_exists(self.spark, state) else {}
        built = []
        for name in self.in_order(list(names)):
            own, table = self.fingerprint(name), f"{database}.{name}"
            if own is None or saved.get(name) != own or not io.table_exists(self.spark, table):
                built.append(name)
                if not save_table(self[name], table):
                    continue  # an empty asset has no table, and is tried again
                saved[name] = own
            self._made[name] = self.spark.table(table)
        if built:
            rows = [(k, v) for k, v in sorted(saved.items()) if v]
            save_table(self.spark.createDataFrame(rows, "name string, fingerprint string"), state)
        return built
