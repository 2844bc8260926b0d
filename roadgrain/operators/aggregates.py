"""Summaries, rollups and scores, each one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadgrain.functions.geo import haversine_km, haversine_m
from roadgrain.operators.windows import dt_seconds, seconds_between
from roadgrain.schema import NESTED_PATHS

#: Completeness is measured on every leaf of the nested record.
CORE_FIELDS = list(NESTED_PATHS)


def time_summary(df: DataFrame, ts: str = "ts") -> DataFrame:
    """One row: rows, columns, first and last time."""
    return df.agg(F.count("*").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"), F.min(ts).alias("time_min"), F.max(ts).alias("time_max"))


def completeness(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, coverage) per field, absent fields 0, in one pass."""
    have = [f for f in fields if f in df.columns]
    absent = [f for f in fields if f not in df.columns]
    one = df.agg(*[F.coalesce(F.avg(F.col(f"`{f}`").isNotNull().cast("double")), F.lit(0.0)).alias(f"c{i}") for i, f in enumerate(have)], F.count("*").alias("_n"))
    pairs = [F.struct(F.lit(f).alias("field"), F.col(f"c{i}").alias("coverage")) for i, f in enumerate(have)] + [F.struct(F.lit(f).alias("field"), F.lit(0.0).alias("coverage")) for f in absent]
    return one.select(F.explode(F.array(*pairs)).alias("p")).select("p.field", "p.coverage")


def completeness_score(df: DataFrame, fields: list[str]) -> DataFrame:
    """One row: score_pct, equal weights, an absent field counting as missing."""
    return completeness(df, fields).agg((F.avg("coverage") * 100).alias("score_pct"), F.count_if(F.col("coverage") == 0).alias("n_empty"))


def sampling_rate(df: DataFrame, by: list[str], ts: str = "ts", order: list[str] | None = None) -> DataFrame:
    """(keys, median_dt_s, rate_hz): one over the exact median interval."""
    x = dt_seconds(df, by, ts, order)
    return x.groupBy(*by).agg(F.median("dt_s").alias("median_dt_s")).withColumn("rate_hz", F.try_divide(F.lit(1.0), "median_dt_s"))


def trip_distance(df: DataFrame, by: list[str], order: list[str], ts: str = "ts", step: int = 1) -> DataFrame:
    """(keys, distance_km, duration_s, n_points) over every step-th located row."""
    w = Window.partitionBy(*by).orderBy(*order)
    x = df.dropna(subset=["lat", "lon"])
    if step > 1:
        x = x.withColumn("_n", F.row_number().over(w)).where((F.col("_n") - 1) % step == 0)
    d = haversine_km(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    return x.withColumn("_d", d).groupBy(*by).agg(F.coalesce(F.sum("_d"), F.lit(0.0)).alias("distance_km"), seconds_between(F.min(ts), F.max(ts)).alias("duration_s"), F.count("*").alias("n_points"))


def coverage_pct(df: DataFrame, col: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg((F.avg(F.col(col).isNotNull().cast("double")) * 100).alias("coverage_pct"))


def histogram(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n"))


def minute_rollup(df: DataFrame, by: list[str], ts: str = "ts", speed: str = "speed_mps") -> DataFrame:
    """Per minute: mean speed and rows."""
    return df.groupBy(*by, F.date_trunc("minute", ts).alias("minute")).agg(F.avg(F.col(speed).cast("double")).alias("avg_speed_mps"), F.count("*").alias("n_rows"))


def sensor_counts(df: DataFrame, by: list[str]) -> DataFrame:
    """Per key: rows, and rows that carry each sensor."""
    return df.groupBy(*by).agg(F.count("*").alias("n_records"), F.count("lat").alias("n_gps"), F.count("ax_mps2").alias("n_imu"), F.count("gx_rad_s").alias("n_gyro"), F.count("speed_obd_mps").alias("n_obd"))


def volume(df: DataFrame, order: list[str], ts: str = "ts") -> DataFrame:
    """One row: devices, trips, messages, kilometres and hours over all trips."""
    trips = df.groupBy("trip_id").agg(F.min(ts).alias("a"), F.max(ts).alias("z"), F.count("*").alias("n"))
    t = trips.agg(F.count("trip_id").alias("n_trips"), F.sum("n").alias("n_messages"), F.sum(seconds_between(F.col("a"), F.col("z")) / 3600).alias("duration_hours"))
    d = trip_distance(df, ["trip_id"], order, ts).agg(F.sum("distance_km").alias("distance_km"))
    v = df.agg(F.countDistinct("device_id").alias("n_devices"))
    one = lambda x: x.withColumn("_k", F.lit(1))
    return one(t).join(one(d), "_k").join(one(v), "_k").drop("_k")


def rest_norm(df: DataFrame, by: list[str], rest: str = "at_rest") -> DataFrame:
    """Mean acceleration norm over rows at rest."""
    n = F.sqrt(F.col("ax_mps2").cast("double") ** 2 + F.col("ay_mps2").cast("double") ** 2 + F.col("az_mps2").cast("double") ** 2)
    return df.where(rest).groupBy(*by).agg(F.avg(n).alias("rest_norm"), F.count(n).alias("n_rest"))


def acc_frame(df: DataFrame, by: list[str]) -> DataFrame:
    """Accelerometer frame from the mean norm: over 8 raw, under 2 compensated, else partial."""
    n = F.sqrt(F.col("ax_mps2").cast("double") ** 2 + F.col("ay_mps2").cast("double") ** 2 + F.col("az_mps2").cast("double") ** 2)
    g = df.groupBy(*by).agg(F.avg(n).alias("mean_norm"))
    return g.withColumn("acc_frame", F.when(F.col("mean_norm") > 8, "raw").when(F.col("mean_norm") < 2, "compensated").when(F.col("mean_norm").isNotNull(), "partial"))


def carrier_signals(df: DataFrame, by: list[str], moving: float = 1.5) -> DataFrame:
    """Per trip: the signals that tell how a device was carried."""
    n = F.sqrt(F.col("ax_mps2").cast("double") ** 2 + F.col("ay_mps2").cast("double") ** 2 + F.col("az_mps2").cast("double") ** 2)
    g = df.groupBy(*by).agg(
        F.count("*").alias("n_samples"), F.avg((F.col("speed_mps") > moving).cast("double")).alias("speed_moving_frac"), F.max(F.col("speed_mps").cast("double")).alias("speed_max"),
        F.avg(n).alias("norm_mean"), F.stddev_samp(n).alias("norm_std"), F.avg(F.col("vehicle_voltage_v").cast("double")).alias("voltage"),
        F.min("lat").alias("_a"), F.max("lat").alias("_b"), F.min("lon").alias("_c"), F.max("lon").alias("_d"),
    )
    return g.withColumn("drift_m", haversine_m("_a", "_c", "_b", "_d")).drop("_a", "_b", "_c", "_d")


def carrier_state(df: DataFrame, by: list[str], moving: float = 1.5, powered_v: float = 9.0) -> DataFrame:
    """The carrier class of each trip, first rule that holds, with a confidence and whether it is vehicle data."""
    s = carrier_signals(df, by, moving)
    f = lambda c: F.coalesce(c, F.lit(False))
    drives = f(F.col("speed_moving_frac") > 0.05) | f(F.col("speed_max") > 4 * moving)
    powered, known = f(F.col("voltage") > powered_v), F.col("voltage").isNotNull()
    shaken, still = f(F.col("norm_std") > 0.5), f(F.col("drift_m") < 15)
    s = s.withColumn(
        "carrier_state",
        F.when(drives, "mounted_driving").when(powered, "mounted_idle").when(shaken, "handheld").when(still, "desk").when(known, "unplugged").otherwise("unknown"),
    ).withColumn("confidence", F.when(drives | powered, "high").when(known, "medium").otherwise("low"))
    return s.withColumn("is_vehicle_data", F.col("carrier_state").isin("mounted_driving", "mounted_idle"))
