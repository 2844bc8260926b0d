"""Streaming extensions: the batch operators on live records. Late rows beyond the watermark are dropped by Spark."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadgrain.functions.scalars import nan_to_null


def record_stream(spark: SparkSession, folder: str, schema: T.StructType, max_files: int = 100) -> DataFrame:
    """Parquet files of a landing folder as a stream of records, NaN as null."""
    return nan_to_null(spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(str(folder)))


def first_sendings(stream: DataFrame, key: str = "rec_id", ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Each key once within the watermark: rows sent again are dropped, and the state stays bounded."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def minute_rollup(stream: DataFrame, ts: str = "ts", late: str = "10 seconds", key: str = "trip_id") -> DataFrame:
    w = F.window(ts, "1 minute")
    g = stream.withWatermark(ts, late).groupBy(key, w).agg(F.avg(F.col("speed_mps").cast("double")).alias("avg_speed_mps"), F.count("*").alias("n_rows"))
    return g.select(key, F.col("window.start").alias("minute"), "avg_speed_mps", "n_rows")


def sliding_rollup(stream: DataFrame, length: str = "2 seconds", step: str = "1 second", ts: str = "ts", late: str = "10 seconds", key: str = "trip_id") -> DataFrame:
    g = stream.withWatermark(ts, late).groupBy(key, F.window(ts, length, step)).agg(F.avg(F.col("speed_mps").cast("double")).alias("avg_speed_mps"), F.count("*").alias("n_rows"))
    return g.select(key, F.col("window.start").alias("start_ts"), F.col("window.end").alias("end_ts"), "avg_speed_mps", "n_rows")


def trip_sessions(stream: DataFrame, gap: str = "10 minutes", ts: str = "ts", late: str = "10 minutes", key: str = "device_id") -> DataFrame:
    """Sessions of a device's records, closed by a gap."""
    g = stream.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap)).agg(F.count("*").alias("n_rows"))
    return g.select(key, F.col("session_window.start").alias("start_ts"), F.col("session_window.end").alias("end_ts"), "n_rows")


def write_batches(stream: DataFrame, out: str, checkpoint: str, available_now: bool = True):
    """Exactly-once Parquet sink: each micro-batch overwrites its own folder, so a replayed one changes nothing."""

    def sink(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(str(Path(out) / f"batch={n}"))

    w = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()
