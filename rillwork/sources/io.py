"""Sources and sinks: grids, lookups, tables and small text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .schemas import SCHEMAS


#: Lines of an ASCII grid's header.
HEADER_LINES = 6


def read_ascii_grid(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, float]]:
    """An ASCII grid as cells (r, c, value), nodata left out, and its six header values. The header is the first task's; a
    line's row follows from its place: lines are numbered within their split of the file, and the splits by their sizes."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.monotonically_increasing_id().alias("place"))
    words = F.split("line", r"\s+")
    head = {r.k.lower(): float(r.v) for r in lines.limit(HEADER_LINES).select(words[0].alias("k"), words[1].alias("v")).collect()}
    part = F.shiftright("place", 33)
    sizes = lines.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row for each split
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n") - HEADER_LINES).alias("before"))
    rows = lines.withColumn("part", part).join(F.broadcast(before), "part").select((F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).alias("r"), "line")
    cells = rows.filter("r >= 0 and line <> ''").select(F.col("r").cast("int").alias("r"), F.posexplode(words).alias("c", "v"))
    return cells.select("r", "c", F.expr("try_cast(v as double)").alias("value")).filter(F.col("value") != head.get("nodata_value", -9999.0)), head


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    """The first two columns of a CSV file: original id, model id."""
    table = spark.read.csv(path, header=True)
    return table.select(F.col(f"`{table.columns[0]}`").cast("int").alias("original_id"), F.col(f"`{table.columns[1]}`").cast("int").alias("model_id"))


def read_named_files(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """CSV files of one kind as one table, with the file's stem as source."""
    table = spark.read.schema(schema).csv(pattern, header=True)
    return table.withColumn("source", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]*$", 1))


def read_rating_curve(spark: SparkSession, path: str) -> DataFrame:
    """storage, area, discharge from lines of three numbers between white space."""
    parts = F.regexp_extract("value", r"^\s*(\S+)\s+(\S+)\s+(\S+)", 0)
    words = F.split(F.trim(parts), r"\s+")
    rows = spark.read.text(path).select(words.alias("w")).filter(F.size("w") == 3)
    return rows.select(*[F.expr(f"try_cast(w[{i}] as double)").alias(n) for i, n in enumerate(("storage", "area", "discharge"))]).filter("storage is not null")


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """id, x, y of point features in a text file of id and WKT, tab-separated."""
    rows = spark.read.csv(path, sep="\t", schema="id long, wkt string")
    n = r"(-?[\d.]+(?:[eE][-+]?\d+)?)"
    at = lambda k: F.regexp_extract("wkt", rf"POINT\s*\(\s*{n}\s+{n}\s*\)", k).cast("double")
    return rows.filter(F.col("wkt").startswith("POINT")).select("id", at(1).alias("x"), at(2).alias("y"))


def positive(column: str) -> Column:
    """An integer attribute, of which zero and less mean none."""
    return F.when(F.expr(f"try_cast(`{column}` as int)") > 0, F.expr(f"try_cast(`{column}` as int)"))


def save_table(df: DataFrame, name: str, mode: str = "overwrite", by: list[str] | None = None) -> bool:
    """Replace or append a catalogue table; an empty frame changes nothing."""
    if df.isEmpty():
        return False
    writer = df.write.mode(mode).format("parquet")
    (writer.partitionBy(*by) if by else writer).saveAsTable(name)
    return True


def create_tables(spark: SparkSession, database: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, schema in SCHEMAS.items():
        spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")
        spark.sql(f"CREATE TABLE {database}.{name} ({schema}) USING parquet")


def first_value(df: DataFrame, key: str, value: object, column: str) -> object:
    """Point lookup; None if there is no such row."""
    row = df.filter(F.col(key) == value).select(column).first()
    return row[0] if row else None


def pack_cells(cells: DataFrame, values: list[str]) -> DataFrame:
    """Wide cells as the store's rows, one for each raster and valid cell."""
    return cells.unpivot(["r", "c"], values, "raster", "value").filter("value is not null").select("raster", "r", "c", F.col("value").cast("double").alias("value"))


def grid_ranges(store: DataFrame) -> DataFrame:
    return store.groupBy("raster").agg(F.count("*").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"))


def station_lines(stations: DataFrame, path: str) -> None:
    """The model's input list: a line for each station, values between pipes; one small file."""
    stations.select(F.concat_ws("|", *[F.col(f"`{c}`").cast("string") for c in stations.columns]).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def default_table(spark: SparkSession, folder: str, name: str, own: dict[str, str] | None = None) -> DataFrame:
    """A default table from the folder's CSV files, or the user's own file where one is named."""
    return spark.read.csv((own or {}).get(name) or f"{folder}/{name}.csv", header=True, inferSchema=True)


def year_lookups(spark: SparkSession, before: str, after: str) -> DataFrame:
    """The two crop lookups as one table with the period that each holds for."""
    read = lambda path, period: spark.read.csv(path, header=True).withColumn("period", F.lit(period))
    return read(before, "before").unionByName(read(after, "after"), allowMissingColumns=True)


def station_weights(weights: DataFrame, kind: str, station: int) -> DataFrame:
    """One station's weights of one type. The store is partitioned by type, so others are not read."""
    return weights.filter((F.col("type") == kind) & (F.col("idx") == station)).select("cell_index", "weight")


def save_weights(weights: DataFrame, path: str) -> None:
    """type, cell_index, idx, weight, a folder for each type."""
    weights.write.mode("overwrite").partitionBy("type").parquet(path)


def duplicate(store: DataFrame, kind: str, copy: str, column: str = "type") -> DataFrame:
    """The store with one type's rows again under another name, as where two types share their stations."""
    return store.unionByName(store.filter(F.col(column) == kind).withColumn(column, F.lit(copy)))


def save_vector(features: DataFrame, path: str) -> None:
    """Features with their rings and attributes as one table."""
    features.write.mode("overwrite").parquet(path)


def save_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def insert_rows(spark: SparkSession, rows: list[dict], name: str) -> None:
    """A few rows appended to a catalogue table, in its own columns and types; what a row doesn't name is NULL."""
    columns = spark.table(name).schema
    spark.createDataFrame([tuple(r.get(c.name) for c in columns) for r in rows], columns).write.mode("append").insertInto(name)


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """id, ring (the outer one) and rings (all, holes included, each an array of x, y) of polygons in a text file of id and
    WKT, tab-separated. Each part of a MULTIPOLYGON is a row."""
    rows = spark.read.csv(path, sep="\t", schema="id long, wkt string").filter(F.col("wkt").rlike(r"^\s*(MULTI)?POLYGON"))
    parts = rows.select("id", F.explode(F.regexp_extract_all("wkt", F.lit(r"\(\s*(\([^()]*\)(?:\s*,\s*\([^()]*\))*)\s*\)"), F.lit(1))).alias("part"))
    rings = F.transform(F.regexp_extract_all("part", F.lit(r"\(([^()]*)\)"), F.lit(1)), _coordinates)
    return parts.select("id", rings.alias("rings")).select("id", F.get("rings", F.lit(0)).alias("ring"), "rings")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """id and line (x, y) of line features."""
    rows = spark.read.csv(path, sep="\t", schema="id long, wkt string").filter(F.col("wkt").startswith("LINESTRING"))
    return rows.select("id", _coordinates(F.regexp_extract("wkt", r"\(([^)]*)\)", 1)).alias("line"))


def _coordinates(text: Column) -> Column:
    pairs = F.transform(F.split(F.trim(text), r"\s*,\s*"), lambda p: F.split(F.trim(p), r"\s+"))
    return F.transform(pairs, lambda p: F.struct(p[0].cast("double").alias("x"), p[1].cast("double").alias("y")))


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def _write_text(spark: SparkSession, path: str, lines: list[str]) -> None:
    """A small file of the driver's own lines, as one text part in a folder of the store."""
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "n int, value string")
    rows.coalesce(1).sortWithinPartitions("n").select("value").write.mode("overwrite").text(path)


def model_files(spark: SparkSession, folder: str, config: list[str]) -> None:
    """The model's constant files: what it puts out, and its configuration."""
    _write_text(spark, f"{folder}/file.out", ["OUTPUTTYPE | 1"])
    _write_text(spark, f"{folder}/config.fig", config)


def reach_parameter_file(spark: SparkSession, reaches: DataFrame, path: str) -> None:
    """Numbers of rows and columns, then the header behind a "#", then a line for each reach. Reaches are thousands at most, so one task writes them in order."""
    n, columns = reaches.count(), reaches.columns
    head = spark.createDataFrame([(0, str(n)), (1, str(len(columns))), (2, "#" + "\t".join(columns))], "n long, value string")
    body = reaches.select((F.col("reach_id") + 2).cast("long").alias("n"), F.concat_ws("\t", *[F.col(f"`{c}`").cast("string") for c in columns]).alias("value"))
    head.unionByName(body).coalesce(1).sortWithinPartitions("n").select("value").write.mode("overwrite").text(path)


def json_rows(df: DataFrame, *columns: str) -> DataFrame:
    """Some columns of each row as one JSON text."""
    return df.withColumn("json", F.to_json(F.struct(*[F.col(c) for c in columns])))


#: Canonical names of a project's inputs; fixed values.
CANONICAL = {"dem": "dem", "soil": "soil", "landuse": "landuse", "field": "field", "farm": "farm", "boundary": "boundary", "stream": "user_stream", "outlet": "outlet"}


def ingest(spark: SparkSession, project, database: str) -> list[str]:
    """A project's rasters and vectors as catalogue tables under their canonical names."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    made = []
    for name, path in {**project.rasters, **project.vectors}.items():
        df = read_ascii_grid(spark, path)[0] if name in project.rasters else read_points(spark, path)
        save_table(df, f"{database}.{CANONICAL.get(name, name)}")
        made.append(CANONICAL.get(name, name))
    return made


def save_grid(cells: DataFrame, path: str, band: int = 256) -> None:
    """Cells (r, c and rasters) as a store by bands of rows, in each sorted by c, so that a window reads few row groups."""
    rows = cells.withColumn("band", F.floor(F.col("r") / band).cast("int"))
    rows.repartition("band").sortWithinPartitions("band", "c", "r").write.mode("overwrite").partitionBy("band").parquet(path)


def read_window(spark: SparkSession, path: str, columns: list[str], box: tuple[int, int, int, int] | None = None, band: int = 256) -> DataFrame:
    """r, c and the columns of a grid store inside a box (first row, first column, last row, last column). The bands are partitions,
    rows and columns are filters that the scan takes, and only the columns asked for are read."""
    own = spark.read.parquet(path)
    if box:
        r1, c1, r2, c2 = box
        own = own.filter(F.col("band").between(r1 // band, r2 // band) & F.col("r").between(r1, r2) & F.col("c").between(c1, c2))
    return own.select("r", "c", *columns)


def raster(spark: SparkSession, database: str, name: str, path: str | None = None) -> DataFrame:
    """A raster's cells (r, c, value): the catalogue's table if there is one, whatever the case of its name, else the file; an error without both."""
    held = {t.name.lower(): t.name for t in spark.catalog.listTables(database)} if spark.catalog.databaseExists(database) else {}
    if name.lower() in held:
        return spark.table(f"{database}.{held[name.lower()]}")
    if not path:
        raise LookupError(f"neither a table {database}.{name} nor a file")
    return read_ascii_grid(spark, path)[0]


def input_file(spark: SparkSession, path: str, lines: list[str]) -> None:
    """The model's input list: its head, and a line for each type and station."""
    _write_text(spark, path, lines)
