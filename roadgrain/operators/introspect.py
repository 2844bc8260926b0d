"""Which sensors a frame holds: every question answered by one aggregation over the frame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadgrain.schema import cols

#: Groups that are there if all their columns exist and any cell is filled, and those where one column is enough.
ALL_OF = {"gps": ["lat", "lon"], "imu": cols("accel"), "gyro": cols("gyro"), "magneto": cols("magneto")}
ANY_OF = {"obd": cols("obd"), "io": cols("io")}
ORDER = ["gps", "imu", "gyro", "magneto", "obd", "io"]


def presence_exprs(columns: list[str]) -> dict[str, Column]:
    """One boolean aggregate per group; groups whose columns don't exist are false without reading anything."""
    have, out = set(columns), {}
    filled = lambda cs: F.coalesce(F.bool_or(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in cs])), F.lit(False))
    for g, cs in ALL_OF.items():
        out[g] = filled(cs) if have.issuperset(cs) else F.lit(False)
    for g, cs in ANY_OF.items():
        there = [c for c in cs if c in have]
        out[g] = filled(there) if there else F.lit(False)
    return out


def sensor_presence(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """has_gps .. has_io, sensor_profile and the detected profile, for the frame or per key."""
    e = presence_exprs(df.columns)
    aggs = [e[g].alias(f"has_{g}") for g in ORDER]
    one = (df.groupBy(*by) if by else df.groupBy()).agg(F.count("*").alias("n_rows"), *aggs)
    name = F.concat_ws("+", *[F.when(F.col(f"has_{g}"), F.lit(g)) for g in ORDER])
    return one.withColumn("sensor_profile", F.when(name == "", F.lit("empty")).otherwise(name)).withColumn(
        "profile", F.when(F.col("has_gyro"), F.lit("full")).when(F.col("has_imu"), F.lit("imu")).otherwise(F.lit("core"))
    ).withColumn("is_gps_only", F.col("has_gps") & ~F.col("has_imu")).withColumn("is_full_imu", F.col("has_imu") & F.col("has_gyro"))


def _one(df: DataFrame) -> dict:
    return sensor_presence(df).first().asDict()


def has(df: DataFrame, group: str) -> bool:
    """Action: whether the frame holds a sensor group."""
    return bool(df.agg(presence_exprs(df.columns)[group].alias("x")).first()["x"])


def sensor_profile(df: DataFrame) -> str:
    """Action: the joined names of the groups present, or ``empty``."""
    return _one(df)["sensor_profile"]


def detect_profile(df: DataFrame) -> str:
    """Action: full with a gyroscope, imu with an accelerometer, else core."""
    return _one(df)["profile"]


def is_gps_only(df: DataFrame) -> bool:
    return _one(df)["is_gps_only"]


def is_full_imu(df: DataFrame) -> bool:
    return _one(df)["is_full_imu"]
