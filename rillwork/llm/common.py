"""Helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only in a local session that names none (tests) a temporary folder is made; it goes when the driver ends. On a cluster
    that is an error, as other executors couldn't read it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="rillwork-")
        atexit.register(shutil.rmtree, _OWN["dir"], True)
    return f"file://{_OWN['dir']}"


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: the lineage is cut, and lost executors cost no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table that materialise() wrote and nothing reads any more."""
    spark = df.sparkSession
    for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_bytes(name: str = "text") -> Column:
    """A text column as UTF-8 bytes for Arrow tasks; null counts as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def row_keys(*cols: str) -> list[Column]:
    """k1, k2: 128 bits that stand for a row's id and content where results meet their rows again. They are never null, so null ids join too. Rows equal in all of cols count as the same row."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for c in cols]
    return [F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit("second"), *reversed(parts)).alias("k2")]


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows: what a task makes of texts in Python takes several times their size."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def free_name(columns: list[str], wish: str) -> str:
    """A name like wish that no column has, whatever its case."""
    taken = {c.lower() for c in columns}
    while wish.lower() in taken:
        wish += "_"
    return wish
