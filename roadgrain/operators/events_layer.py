"""Driving events, derived columns and the noise model of simulated sources."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadgrain.operators.windows import runs

#: Thresholds of the event rules (SI units).
BRAKE, ACCEL, TURN_GZ, TURN_AY, BUMP, POTHOLE, CURB_AY, DOOR_GY, STOP_MPS, STOP_S = -3.0, 2.5, 0.3, 5.0, 3.0, 5.0, 2.5, 3.0, 0.3, 5.0


def row_events(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows with an array of the event kinds their readings meet; az_delta is against the row before."""
    w = Window.partitionBy(*by).orderBy(*order)
    x = df.withColumn("az_delta", F.abs(F.col("az_mps2").cast("double") - F.lag("az_mps2").over(w).cast("double")))
    ax, ay, gz, gy, d, v = (F.col(c) for c in ("ax_mps2", "ay_mps2", "gz_rad_s", "gy_rad_s", "az_delta", "speed_mps"))
    still = F.coalesce(v < STOP_MPS, F.lit(False))
    kinds = F.array_compact(
        F.array(
            F.when(ax < BRAKE, F.lit("HARSH_BRAKE")),
            F.when(ax > ACCEL, F.lit("HARSH_ACCEL")),
            F.when((F.abs(gz) > TURN_GZ) | (F.abs(ay) > TURN_AY), F.lit("SHARP_TURN")),
            F.when((d >= BUMP) & (d <= POTHOLE), F.lit("SPEED_BUMP")),
            F.when(d > POTHOLE, F.lit("POTHOLE")),
            F.when((F.abs(ay) > CURB_AY) & (d > BUMP), F.lit("CURB")),
            F.when((F.abs(gy) > DOOR_GY) & still, F.lit("DOOR_OPEN")),
        )
    )
    return x.withColumn("event_kinds", kinds)


def event_table(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """(keys, ts, event_type): one row per reading and kind, stops as one row at their start."""
    rows = row_events(df, by, order).select(*by, "ts", F.explode("event_kinds").alias("event_type"))
    still = runs(df.where("speed_mps is not null"), F.col("speed_mps") < STOP_MPS, by, "ts", order, STOP_S)
    return rows.unionByName(still.select(*by, F.col("start_ts").alias("ts"), F.lit("STOP").alias("event_type")))


def gaussian(key: list[str], seed: int):
    """A standard normal number of a row's key, by Box and Muller from two digests."""

    def uniform(n: int):
        h = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key], F.lit(f"{seed}.{n}")), 256)
        return (F.conv(F.substring(h, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)

    return F.sqrt(-2 * F.log(uniform(1))) * F.cos(2 * math.pi * uniform(2))


def add_noise(df: DataFrame, col: str, sigma: float, seed: int, bias_per_s: float = 0.0, quantum: float = 0.0, delay: int = 0, by: list[str] | None = None, ts: str = "ts", out: str | None = None, key: list[str] | None = None) -> DataFrame:
    """Gaussian noise, drift since the key's first row, rounding to a quantum and a delay in rows.

    The noise of a row is drawn from a hash of its ``key`` (keys and time by default) and the seed, so it is the same
    however the rows are partitioned.
    """
    c = F.col(col).cast("double")
    w = Window.partitionBy(*(by or [])).orderBy(ts) if by else None
    if delay:
        if w is None:
            raise ValueError("a delay needs keys")
        c = F.lag(c, delay).over(w)
    if bias_per_s:
        if w is None:
            raise ValueError("a drift needs keys")
        c = c + bias_per_s * (F.unix_micros(ts) - F.unix_micros(F.min(ts).over(Window.partitionBy(*by)))) / 1e6
    c = c + gaussian([*(by or []), ts] if key is None else key, seed) * sigma
    if quantum:
        c = F.bround(c / quantum) * quantum
    return df.withColumn(out or col, c)
