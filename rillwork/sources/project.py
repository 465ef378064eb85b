"""The INI files of a model and of a scenario: sections and options by name, empty ones as absent."""

from __future__ import annotations

import configparser
import datetime as dt
from dataclasses import dataclass, field, replace

TRUE = ("yes", "true")
#: Sections and options of a model's file; fixed values.
MODEL = {
    "default": "input_folder",
    "watershed": "dem_raster soil_raster landuse_raster stream_shapefile boundary_shapefile farm_shapefile field_shapefile outlet_shapefile",
    "lookup": "soil_lookup landuse_lookup",
    "parameter": "SoilLookup",
    "database": "hydroclimate",
    "reach_bmp": "point_source_shapefile flow_diversion_shapefile reservoir_shapefile wetland_boundary_shapefile wetland_outlet_shapefile "
    "manure_catch_basin_shapefile grass_waterway_shapefile access_management_shapefile water_use_shapefile",
    "structure_bmp": "dugout_boundary_shapefile riparian_buffer_shapefile filter_strip_shapefile tile_drain_boundary_shapefile "
    "tile_drain_outlet_shapefile wascob_shapefile",
    "non_structure_bmp": "manure_feedlot_boundary_shapefile manure_feedlot_outlet_shapefile manure_storage_boundary_shapefile offsite_watering_shapefile",
    "reservoir": "reservoir_flow_routing reservoir_flow_data_folder",
    "delineation": "stream_threshold_area_ha use_all_pour_points_from_stream_threshold wetland_min_area_ha",
    "marginal_crop_land": "marginal_crop_land_simulation marginal_crop_land_shapefile marginal_crop_land_non_agriculture_landuse_ids "
    "marginal_crop_land_buffer_size_m marginal_crop_land_slope_threshold_percentage marginal_crop_land_grass_type",
    "pasture_crop_land": "pasture_crop_land_simulation pasture_crop_land_shapefile pasture_crop_land_landuse_ids pasture_crop_land_grass_type",
    "manure_adjustment_bmp": "manure_adjustment_incorporation_within_48h_shapefile manure_adjustment_application_setback_shapefile "
    "manure_adjustment_no_application_on_snow_shapefile manure_adjustment_spring_rather_than_fall_shapefile "
    "manure_adjustment_based_on_n_limit_shapefile manure_adjustment_based_on_p_limit_shapefile",
    "crop_rotation": "method AAFC_crop_inventory_folder first_year last_year include_grazing",
    "model": "model_folder",
}
#: Those of a scenario's file; fixed values.
SCENARIO = {
    "model": "model_folder",
    "scenario": "name model_type interval start_date end_date",
    "climate_station": "P T RM SR WS WD",
    "climate_interpolation": "method radius",
}
#: What a scenario takes where its file says nothing; fixed values.
MODEL_TYPE, INTERVAL, RADIUS = "cell", "daily", 10_000_000


def options(text: str, sections: dict[str, str]) -> dict[str, str]:
    """The options that have a value, by name. An option that its section lacks is taken from [DEFAULT]; others than the
    known ones are passed over, as files of other versions hold more."""
    parser = configparser.ConfigParser(interpolation=None)
    parser.read_string(text)
    found = {}
    for section, names in sections.items():
        held = parser[section] if parser.has_section(section) else parser.defaults()
        for name in names.split():
            value = (held.get(name.lower()) or "").strip()
            if value:
                found[f"{section}.{name}"] = value
    return found


def template(sections: dict[str, str]) -> str:
    """A file with all sections and options, without values."""
    return "\n".join("\n".join([f"[{s}]", *[f"{n} =" for n in names.split()], ""]) for s, names in sections.items())


@dataclass(frozen=True)
class Model:
    values: dict[str, str]

    @classmethod
    def load(cls, text: str) -> Model:
        return cls(options(text, MODEL))

    def get(self, name: str, default: str | None = None) -> str | None:
        return self.values.get(name, default)

    def flag(self, name: str) -> bool:
        return self.values.get(name, "").lower() in TRUE

    def numbers(self, name: str) -> list[int]:
        return whole_numbers(name, self.values.get(name, ""))

    def inputs(self, ending: str) -> dict[str, str]:
        """Inputs of one kind (raster, shapefile, lookup) by name without the kind."""
        own = {k.partition(".")[2]: v for k, v in self.values.items()}
        return {k.removesuffix(f"_{ending}"): v for k, v in own.items() if k.endswith(f"_{ending}")}

    def findings(self) -> list[str]:
        """What a model can't do without."""
        needed = ("model.model_folder", "watershed.dem_raster", "watershed.soil_raster", "watershed.landuse_raster")
        return [f"{n} is required" for n in needed if n not in self.values]


@dataclass(frozen=True)
class Scenario:
    name: str
    model_folder: str
    model_type: str = MODEL_TYPE
    interval: str = INTERVAL
    start: dt.date | None = None
    end: dt.date | None = None
    stations: dict[str, list[int]] = field(default_factory=dict)
    method: str | None = None
    radius: int = RADIUS

    @classmethod
    def load(cls, text: str) -> Scenario:
        """T stands for the greatest and the least temperature. Without a name or a model's folder it is an error."""
        v = options(text, SCENARIO)
        for needed in ("scenario.name", "model.model_folder"):
            if needed not in v:
                raise ValueError(f"{needed} is required")
        stations: dict[str, list[int]] = {}
        for kind in SCENARIO["climate_station"].split():
            if f"climate_station.{kind}" in v:
                ids = whole_numbers(kind, v[f"climate_station.{kind}"])
                stations |= {"TMAX": ids, "TMIN": ids} if kind == "T" else {kind: ids}
        day = lambda n: dt.date.fromisoformat(v[n].replace("/", "-")) if n in v else None
        return cls(
            v["scenario.name"], v["model.model_folder"], v.get("scenario.model_type", MODEL_TYPE), v.get("scenario.interval", INTERVAL),
            day("scenario.start_date"), day("scenario.end_date"), stations, v.get("climate_interpolation.method"),
            int(v.get("climate_interpolation.radius", RADIUS)),
        )

    def resolved(self, held: dict[str, list[int]], first: dt.date, last: dt.date) -> Scenario:
        """With the stations and the period of the readings where the file names none. Stations without readings of their
        type, and days outside of the period, are errors that name all of them."""
        absent = [f"{k} {i}" for k, ids in self.stations.items() for i in ids if i not in held.get(k, ())]
        if absent:
            raise ValueError(f"stations without readings: {', '.join(absent)}")
        if (self.start and self.start < first) or (self.end and self.end > last):
            raise ValueError(f"the readings span {first} to {last}, not {self.start} to {self.end}")
        return replace(self, stations=self.stations or held, start=self.start or first, end=self.end or last)

    def file_in(self, cell_size: float, cells: int, subareas: int, subbasins: int) -> list[str]:
        """The lines of the model's input list; -1 for what the kind of model doesn't have."""
        by_area = self.model_type == "subarea"
        head = {
            "VERSIONTYPE": int(by_area), "ISPREPAREFORSUBAREAINPUT": 0, "CELLSIZE": -1 if by_area else cell_size, "CELLNUMBER": -1 if by_area else cells,
            "SUBAREANUMBER": subareas if by_area else -1, "SUBBASINCOUNT": subbasins, "INTERVAL": self.interval,
            "STARTTIME": f"{self.start:%Y/%m/%d}", "ENDTIME": f"{self.end:%Y/%m/%d}",
        }
        lines = [f"{k}|{v}" for k, v in head.items()]
        for kind, ids in self.stations.items():
            lines += [f"SITECOUNT|{len(ids)}|{kind}", *[f"SITENAME|{i}|{kind}" for i in ids]]
        return lines


def whole_numbers(name: str, text: str) -> list[int]:
    """A comma list; empty means none."""
    if not text.strip():
        return []
    try:
        return [int(x) for x in text.split(",")]
    except ValueError:
        raise ValueError(f"{name} must be whole numbers separated by commas") from None
