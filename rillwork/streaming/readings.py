"""Station readings as a stream: the batch columns with a watermark and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def reading_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def windowed_sums(readings: DataFrame, length: str = "1 day", late: str = "2 days", slide: str | None = None) -> DataFrame:
    """Sums and counts by type and window; state older than the watermark goes. On a batch it gives the same rows."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return readings.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def upsert(stream: DataFrame, target: str, checkpoint: str):
    """Write each batch's windows to a table by overwriting their days: replays leave the same rows."""

    def batch(df: DataFrame, _: int) -> None:
        df.withColumn("day", F.to_date("start")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(target)

    return stream.writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
