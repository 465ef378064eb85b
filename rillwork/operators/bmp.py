"""Builders of the management tables: attributes of features joined with what the grids say of their cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Multipliers of a subbasin, all one at first; fixed values.
MULTIPLIERS = (
    "SHC SOIL_T10 INTERC_MAX INTERC_MIN USLE_C ROOT_DEPTH MANNING FIMP FCIMP CURBDEN URBCOEF DIRTMX THALF TNCONC TPCONC TNO3CONC URBCN2 PET_LAI_COEFFICIENT CONDUCTIVITY DEPTH POROSITY "
    "FIELD_CAPACITY WILTING_POINT RESIDUAL PORE_INDEX DENSITY SAND CLAY SLIT USLE_K CN2 RUNOFF_CO DEPRESSION SOIL_MOIST_IN SOIL_NO3_IN SOIL_ORGN_IN SOIL_SOLP_IN SOIL_ORGP_IN INTERFLOW_SCALE_FACTOR"
).split()
#: A point source without an operation date counts from this day on; a fixed value.
ALWAYS = "1900-01-01"
#: Columns of the daily deposit that are summed.
DEPOSITS = ("Manure", "TSS", "NO3", "NH4", "OrgN", "SolP", "OrgP", "DrinkWater")


def copied_key(features: DataFrame, key: str, layer: DataFrame, layer_key: str, *fields: str) -> DataFrame:
    """Features with fields of the feature that their key names; strict: features without one are left out, missing_keys() tells which."""
    own = layer.select(F.col(layer_key).alias("__key"), *[F.col(f) for f in fields])
    return features.join(own, F.col(key) == F.col("__key")).drop("__key")


def missing_keys(features: DataFrame, key: str, layer: DataFrame, layer_key: str) -> DataFrame:
    return features.filter(F.col(key).isNotNull()).join(layer.select(F.col(layer_key).alias(key)).distinct(), key, "left_anti")


def subbasin_multiplier(subbasins: DataFrame) -> DataFrame:
    return subbasins.select("subbasin").distinct().select("subbasin", *[F.lit(1.0).alias(m) for m in MULTIPLIERS])


def greatest_subbasin(zones: DataFrame, zone: str) -> DataFrame:
    """The greatest subbasin id that each feature's cells meet, 0 for none."""
    return zones.groupBy(zone).agg(F.coalesce(F.max("subbasin"), F.lit(0)).alias("subbasin"))


def lowest_subbasin(zones: DataFrame, zone: str, value: str) -> DataFrame:
    """The subbasin in which a feature's mean elevation is the least; of equals the least id. Pairs first, so that a large feature is no large group."""
    pairs = zones.groupBy(zone, "subbasin").agg(F.avg(value).alias("mean"))
    return pairs.groupBy(zone).agg(F.min(F.struct("mean", "subbasin")).alias("b")).select(zone, "b.subbasin", "b.mean")


def containing(points: DataFrame, cells: DataFrame, *fields: str) -> DataFrame:
    """Points with what the grid says of their cell."""
    return points.join(cells.select("cell_index", *fields), "cell_index", "left")


def one_each(points: DataFrame, zone: str, point: str) -> DataFrame:
    """One feature for each zone, the last of several."""
    return points.filter(F.col(zone).isNotNull()).groupBy(zone).agg(F.max(point).alias(point))


def reservoir(features: DataFrame, cells: DataFrame) -> DataFrame:
    """id, subbasin, operation, areas and volumes; the method is a file's table where one is named, else the attributes."""
    own = containing(features, cells, "subbasin")
    return own.select("id", "subbasin", F.coalesce(F.to_date("op"), F.lit(ALWAYS).cast("date")).alias("operation"), *[F.col(c).cast("double") for c in ("sa_em", "v_em", "sa_pr", "v_pr")], F.when(F.length("file") > 0, "table").otherwise("attributes").alias("method"))


def point_source(features: DataFrame, cells: DataFrame) -> DataFrame:
    own = containing(features, cells, "subbasin")
    return own.select("id", "subbasin", F.coalesce(F.to_date("operation"), F.lit(ALWAYS).cast("date")).alias("operation"), F.col("table_name"))


def catch_basin(features: DataFrame, cells: DataFrame, receive: DataFrame) -> DataFrame:
    """Each basin's subbasin and the reach that receives it, -1 if there is none."""
    own = containing(features, cells, "subbasin").select("id", "subbasin")
    return own.join(receive.select("subbasin", "receive"), "subbasin", "left").select("id", "subbasin", F.coalesce("receive", F.lit(-1)).alias("receive"))


def feedlot(features: DataFrame, livestock: DataFrame) -> DataFrame:
    """Parameter rows; an animal id is required, other attributes default to 0 or ''."""
    known = features.join(livestock.select(F.col("ID").alias("ani_id"), "Man_ID"), "ani_id")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return known.select("id", "ani_id", "Man_ID", zero("cb"), zero("adult"), zero("nonadult"), F.coalesce("stoid", F.lit("")).alias("stoid"), F.coalesce("storatio", F.lit("")).alias("storatio"))


def manure_storage(storages: DataFrame, zones: DataFrame, ways: DataFrame) -> DataFrame:
    """id, feedlot, contribution (cells' upstream area in ha), fraction of the feedlot's storages, distance and height to the reach. zones: id, cell_index, acc_ha; ways: cell_index, distance, fall."""
    area = zones.groupBy("id").agg(F.max("acc_ha").alias("contribution"), F.max_by("cell_index", F.struct("acc_ha", -F.col("cell_index"))).alias("cell_index"))
    own = storages.join(area, "id").join(ways, "cell_index", "left")
    total = own.groupBy("feedlot").agg(F.sum("contribution").alias("total"))
    return own.join(total, "feedlot").select("id", "feedlot", "contribution", (F.col("contribution") / F.col("total")).alias("fraction"), F.coalesce("distance", F.lit(0.0)).alias("distance"), F.coalesce("fall", F.lit(0.0)).alias("height"))


def deposit_rows(grazing: DataFrame, fields: DataFrame, livestock: DataFrame, fertilizer: DataFrame, start_year: int) -> DataFrame:
    """Grazing at a stream (Source 1) with access to it (not 2), with the amounts of a day: animal units of 100 kg by density and
    area give manure and drinking water, and the manure's fractions its nutrients."""
    own = grazing.filter("Source = 1 and Access <> 2")
    own = own.join(fields.select(F.col("id").alias("Location"), "Area_Ha"), "Location")
    own = own.join(livestock.select(F.col("ID").alias("Ani_ID"), "Man_ID", "Ani_Weight", "Man_Day", "Man_TSS_Fra", "Water_Drink"), "Ani_ID")
    own = own.join(fertilizer.select(F.col("IFNUM").alias("Man_ID"), "FMINN", "FMINP", "FORGN", "FORGP"), "Man_ID")
    units = F.col("GR_Density") * F.col("Area_Ha") * F.col("Ani_Weight") * F.col("Ani_adult") / 100
    manure = units / 1000 * F.col("Man_Day") * F.col("DayFra") * F.col("Drinking_time")
    own = own.withColumn("Manure", manure).withColumn("DrinkWater", units * F.col("Water_Drink") / 100 / 1000)
    of = lambda c, by: (F.col(c) * F.col("Manure")).alias(by)
    start = F.make_date(F.col("Year") + (start_year - 1), "GraMon", "GraDay").alias("StartDate")
    nutrients = (of("FMINN", "NO3"), F.lit(0.0).alias("NH4"), of("FORGN", "OrgN"), of("FMINP", "SolP"), of("FORGP", "OrgP"))
    return own.select(F.col("SourceID").alias("ReachId"), start, "Days", "Manure", (F.col("Man_TSS_Fra") / 100 * F.col("Manure")).alias("TSS"), *nutrients, "DrinkWater", "BankK_Change")


def reach_deposit(rows: DataFrame, start_year: int, digits: int = 6) -> DataFrame:
    """A row for each reach and day: eight sums, the least change of the bank, and the day as model year, month and day.
    Amounts are summed as whole units of 10^-digits, so that the order of addition doesn't show."""
    unit = 10**digits
    days = F.explode(F.sequence(F.lit(0), F.col("Days") - 1)).alias("d")
    whole = [F.round(F.col(c) * unit).cast("long").alias(c) for c in DEPOSITS]
    daily = rows.filter("Days > 0").select("ReachId", "StartDate", days, *whole, "BankK_Change").withColumn("Date", F.date_add("StartDate", F.col("d")))
    sums = daily.groupBy("ReachId", "Date").agg(*[F.sum(c).alias(c) for c in DEPOSITS], F.min("BankK_Change").alias("BankK_Change"))
    date = ((F.year("Date") - start_year + 1).alias("Year"), F.month("Date").alias("Month"), F.dayofmonth("Date").alias("Day"))
    return sums.select("ReachId", *date, *[(F.col(c) / unit).alias(c) for c in DEPOSITS], "BankK_Change")


def crop_codes(lookup: DataFrame) -> DataFrame:
    """Lookup rows whose model id is a number; 'Not proceed' and the like go. try_cast keeps the order of filter and cast free."""
    return lookup.withColumn("model_id", F.expr("try_cast(model_id as int)")).filter("model_id is not null")


def lookup_of_year(lookups: DataFrame, year: Column) -> Column:
    """The lookup's period that holds for a year: up to 2010 the earlier codes, then the later ones."""
    return F.when(year <= 2010, F.lit("before")).otherwise(F.lit("after"))


def crops_by_lookup(crops: DataFrame, lookups: DataFrame) -> DataFrame:
    """crops: location, year (calendar), code. lookups: period, code, model_id. The model's crop of each season."""
    own = crops.withColumn("period", lookup_of_year(lookups, F.col("year")))
    return own.join(crop_codes(lookups), ["period", "code"]).select("location", "year", F.col("model_id").alias("crop"))


def default_rotation(spark: SparkSession, path: str, locations: DataFrame) -> DataFrame:
    """A default table (crop, tillage or fertilizer) for every location. Its few rows are read from a CSV file, not written here."""
    rows = spark.read.csv(path, header=True, inferSchema=True)
    return locations.select(F.col("id").alias("Location")).distinct().crossJoin(F.broadcast(rows))


def buffer_means(parts: DataFrame, cells: DataFrame, *values: str) -> DataFrame:
    """Buffer parts with the means of several rasters over their cells: one aggregation for all. parts: cell_index, part."""
    return parts.join(cells.select("cell_index", *values), "cell_index").groupBy("part").agg(F.count("*").alias("n"), *[F.avg(v).alias(f"mean_{v}") for v in values])


def subarea_means(cells: DataFrame, subareas: DataFrame, *values: str, nodata: float = -32768.0) -> DataFrame:
    """Cell parameters with their subarea, as means; nodata counts as none, and a subarea without a value gets 0."""
    own = subareas.select("cell_index", "subarea").join(cells.select("cell_index", *values), "cell_index", "left")
    return own.groupBy("subarea").agg(*[F.coalesce(F.avg(F.nullif(F.col(v), F.lit(nodata))), F.lit(0.0)).alias(v) for v in values])


def averages(first: Column, second: Column) -> Column:
    """Of a soil's first two layers."""
    return (first + second) / 2
