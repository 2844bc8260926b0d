"""Projections, filters, orders, limits and set operations on frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The other names under which sources write a sample's columns; the target itself comes first.
ALIASES = {
    "timestamp": ["time", "ts", "datetime", "time_iso", "time_ms", "timestamp_ms"],
    "speed": ["speed", "speed_mps", "v_mps", "speed_ms", "speed_m_s", "v"],
    "acc_x": ["ax", "accx", "accel_x", "acc_x_mps2", "imu_ax", "ax_mps2"],
    "acc_y": ["ay", "accy", "accel_y", "acc_y_mps2", "imu_ay", "ay_mps2"],
    "acc_z": ["az", "accz", "accel_z", "acc_z_mps2", "imu_az", "az_mps2"],
    "gyro_x": ["gx", "gyrox", "gyro_x_rad_s", "imu_gx", "gx_rad_s"],
    "gyro_y": ["gy", "gyroy", "gyro_y_rad_s", "imu_gy", "gy_rad_s"],
    "gyro_z": ["gz", "gyroz", "gyro_z_rad_s", "imu_gz", "gz_rad_s"],
}
#: The names whose times are epoch milliseconds.
MILLIS = ["time_ms", "timestamp_ms"]


def select(df: DataFrame, cols: list[str]) -> DataFrame:
    """Strict projection: an absent name raises."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise KeyError(f"no columns {missing}")
    return df.select(*[F.col(f"`{c}`") for c in cols])


def select_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    """Projection that ignores absent names."""
    return df.select(*[F.col(f"`{c}`") for c in fields if c in df.columns])


def with_values(df: DataFrame, name: str, values: DataFrame, position: str, value: str = "value") -> DataFrame:
    """Adds values that belong to row numbers, by an equi-join on the row number."""
    v = values.select(F.col(position).alias("_at"), F.col(value).alias("_v"))
    return df.join(v, F.col(position) == F.col("_at"), "left").withColumn(name, F.col("_v")).drop("_at", "_v")


def resolve_aliases(df: DataFrame, overrides: dict[str, str | list[str]] | None = None, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """Target columns that are absent, from the first source name present; a dataset's own list replaces the default one.

    A time of a name in MILLIS is epoch milliseconds; others come as instants. Targets without a source are left out.
    """
    table = dict(aliases or ALIASES) | {k: [v] if isinstance(v, str) else list(v) for k, v in (overrides or {}).items()}
    out = {}
    for target, names in table.items():
        src = next((n for n in [target, *names] if n in df.columns), None)
        if src is None:
            continue
        c = F.col(f"`{src}`")
        if target == "timestamp":
            kind = dict(df.dtypes)[src]
            c = F.timestamp_millis(c.try_cast("double").cast("long")) if src in MILLIS else F.try_to_timestamp(c) if kind == "string" else c.cast("timestamp")
        elif src == target:
            continue
        out[target] = c
    return df.withColumns(out) if out else df


def map_provider(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Vendor names to canonical names; names that are absent are ignored."""
    return df.withColumnsRenamed(mapping)


def add_context(df: DataFrame, name: str, values: dict) -> DataFrame:
    return df.withColumns({f"context.{name}.{k}": F.lit(v) for k, v in values.items()})


def filter_time(df: DataFrame, start=None, end=None, ts: str = "ts") -> DataFrame:
    """Closed interval in UTC; without the column the frame stays as it is, unreadable times drop out."""
    if ts not in df.columns or (start is None and end is None):
        return df
    c = F.try_to_timestamp(ts) if dict(df.dtypes)[ts] == "string" else F.col(ts)
    conds = ([c >= F.lit(start).cast("timestamp")] if start is not None else []) + ([c <= F.lit(end).cast("timestamp")] if end is not None else [])
    return df.where(reduce(lambda a, b: a & b, conds))


def gnss_view(df: DataFrame) -> DataFrame:
    """Rows that carry a position."""
    return df.dropna(how="any", subset=["lat", "lon"])


def sparse_gps(df: DataFrame, gps_ts: str, by: list[str], order: str, null: tuple[str, ...] = ("lat", "lon")) -> DataFrame:
    """Nulls repeated positions: those whose GPS clock is that of the row before."""
    w = Window.partitionBy(*by).orderBy(order)
    same = F.col(gps_ts).eqNullSafe(F.lag(gps_ts).over(w)) & F.lag(F.lit(1)).over(w).isNotNull()
    return df.withColumn("_same", same).withColumns({c: F.when(~F.col("_same"), F.col(c)) for c in null}).drop("_same")


def one_hot_label(flags: list[tuple[str, str]], default: str = "unknown") -> Column:
    """Label of the first flag column that is 1."""
    return reduce(lambda acc, f: acc.when(F.col(f[0]) == 1, F.lit(f[1])), flags, F.when(F.lit(False), F.lit(""))).otherwise(F.lit(default))


def event_defaults(df: DataFrame, flags: list[str], texts: list[str]) -> DataFrame:
    """Missing event columns come as 0 or null; flags are forced into 0..1."""
    out = {c: F.least(F.greatest(F.coalesce(F.col(c).cast("int"), F.lit(0)), F.lit(0)), F.lit(1)) if c in df.columns else F.lit(0) for c in flags}
    return df.withColumns(out | {c: F.lit(None).cast("string") for c in texts if c not in df.columns})


def decimate(df: DataFrame, step: int, by: list[str], order: list[str]) -> DataFrame:
    """Every step-th row of each key, the first included."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where((F.col("_n") - 1) % step == 0).drop("_n")


def top_keys(df: DataFrame, key: str, n: int | None = 5, first: str | None = None) -> DataFrame:
    """The n keys with most rows; ties by the least ``first`` value, else by key; None gives all."""
    c = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n_rows"), *([F.min(first).alias("_first")] if first else []))
    c = c.orderBy(F.desc("n_rows"), *([F.asc("_first")] if first else []), F.asc(key))
    return (c if n is None else c.limit(n)).drop("_first")


def keep_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_semi")


def at_least(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows of keys with at least n rows."""
    big = df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= n).select(key)
    return df.join(big, key, "left_semi")


def union_frames(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL by name; columns that one side lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def tag(df: DataFrame, **values) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in values.items()})
