"""Unit conversions, clocks, clips and text helpers as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

G0 = 9.80665


def g_to_mps2(c: Column) -> Column:
    return (c * G0).cast("float")


def mg_to_mps2(c: Column) -> Column:
    return (c * (G0 / 1000)).cast("float")


def deg_to_rad(c: Column) -> Column:
    """Degrees, or degrees per second, to radians."""
    return F.radians(c)


def kmh_to_mps(c: Column) -> Column:
    """km/h to m/s; text that is no number gives null."""
    return c.try_cast("double") / 3.6


def mph_to_mps(c: Column) -> Column:
    return c.try_cast("double") * 0.44704


def km_to_m(c: Column) -> Column:
    return c * 1000


def miles_to_m(c: Column) -> Column:
    return c * 1609.344


def epoch_to_ts(c: Column, unit: str = "s") -> Column:
    """UTC instant of an epoch number in s, ms, us or ns (never by way of a double for ns)."""
    if unit == "s":
        return F.timestamp_micros(F.round(c.cast("double") * 1e6).cast("long"))
    if unit == "ms":
        return F.timestamp_millis(c.cast("long"))
    if unit == "us":
        return F.timestamp_micros(c.cast("long"))
    if unit == "ns":
        return F.timestamp_micros(_ns_div(c))
    raise ValueError(f"no clock unit {unit!r}")


def _ns_div(c: Column) -> Column:
    """Floor division by 1000 on longs, right below zero as well."""
    n = c.cast("long")
    return ((n - F.pmod(n, F.lit(1000).cast("long"))) / 1000).cast("decimal(20,0)").cast("long")


def to_ts(c: Column) -> Column:
    """Text to a UTC instant; unreadable text gives null."""
    return F.try_to_timestamp(c)


def ts_to_ns(c: Column) -> Column:
    """Epoch nanoseconds of an instant."""
    return F.unix_micros(c) * F.lit(1000).cast("long")


def clip(c: Column, low: float, high: float) -> Column:
    """Clip that keeps nulls (least and greatest would skip them)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def clip_filled(c: Column, low: float, high: float) -> Column:
    """Nulls become 0, then clip."""
    return F.least(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(low)), F.lit(high))


def flag01(c: Column) -> Column:
    """Any number as an event flag of 0 or 1."""
    return F.least(F.greatest(F.coalesce(c.cast("int"), F.lit(0)), F.lit(0)), F.lit(1))


def norm3(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def numeric(c: Column, to: str = "double", strict: bool = False) -> Column:
    """Number of a text: ``strict`` raises on what is none, else it becomes null; integers cut fractions."""
    f = (lambda x, t: x.cast(t)) if strict else (lambda x, t: x.try_cast(t))
    return f(f(c, "double"), to) if to in ("int", "bigint", "long") else f(c, to)


def slug(c: Column) -> Column:
    """Blanks as underscores, trimmed."""
    return F.replace(F.trim(c), F.lit(" "), F.lit("_"))


def iso(c: Column) -> Column:
    """ISO text of an instant, UTC, microseconds."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def is_extra(name: str) -> bool:
    """Whether a column name is of the free ``x_`` kind."""
    return name.startswith("x_")


def first_true(pairs: list[tuple[Column, str]], default: str) -> Column:
    """Label of the first condition that holds (one-hot flags to a label)."""
    return reduce(lambda acc, p: acc.when(p[0], F.lit(p[1])), pairs, F.when(F.lit(False), F.lit(""))).otherwise(F.lit(default))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes null in every float and double column: done once at each source."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.select(*[F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")).alias(c) if c in floats else F.col(f"`{c}`") for c in df.columns]) if floats else df


def flatten_structs(df: DataFrame) -> DataFrame:
    """Nested structs as columns of dotted names; arrays and maps stay as they are."""

    def leaves(schema: T.StructType, path: tuple[str, ...]):
        for f in schema:
            here = (*path, f.name)
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, here)
            else:
                yield here

    return df.select(*[F.col(".".join(f"`{p}`" for p in path)).alias(".".join(path)) for path in leaves(df.schema, ())])


#: SQL bodies of the functions offered to SQL users.
SQL_FUNCTIONS = {
    "haversine_m": "(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE RETURN 2 * 6371000 * atan2(sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)), sqrt(abs(1 - (pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)))))",
    "nmea_to_degrees": "(v DOUBLE) RETURNS DOUBLE RETURN cast(v / 100 AS INT) + (v - 100 * cast(v / 100 AS INT)) / 60",
    "g_to_mps2": "(v DOUBLE) RETURNS FLOAT RETURN cast(v * 9.80665D AS FLOAT)",
    "kmh_to_mps": "(v DOUBLE) RETURNS DOUBLE RETURN v / 3.6D",
    "deg_to_rad": "(v DOUBLE) RETURNS DOUBLE RETURN radians(v)",
    "accel_norm": "(x DOUBLE, y DOUBLE, z DOUBLE) RETURNS DOUBLE RETURN sqrt(x * x + y * y + z * z)",
}


def register_sql(spark: SparkSession) -> list[str]:
    """Temporary SQL functions, inlined by the optimiser (no Python at run time)."""
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(SQL_FUNCTIONS)
