"""Row-to-row operators within a key, ordered by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from roadgrain.functions.geo import bearing_deg, curvature, haversine_m
from roadgrain.operators.position import before


def _w(by: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def seconds_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(b) - F.unix_micros(a)) / 1e6


def dt_seconds(df: DataFrame, by: list[str], ts: str = "ts", order: list[str] | None = None, out: str = "dt_s") -> DataFrame:
    """Seconds since the row before, null on the first."""
    return df.withColumn(out, seconds_between(F.lag(ts).over(_w(by, order or [ts])), F.col(ts)))


def speed_from_positions(df: DataFrame, by: list[str], ts: str = "ts", order: list[str] | None = None, cap: float | None = None, out: str = "speed_from_pos") -> DataFrame:
    """Great-circle speed from the row before; a zero interval gives null (the pandas form gives inf).

    Without keys the row before is the one of the whole frame. With ``cap`` the result is clipped to 0..cap and cast to float, as the CSV adapters want it.
    """
    if by:
        w = _w(by, order or [ts])
        lat, lon, t, x = F.lag("lat").over(w), F.lag("lon").over(w), F.lag(ts).over(w), df
    else:  # over the whole frame, in blocks of time
        x = before(df.withColumn("_us", F.unix_micros(ts)), ["lat", "lon", ts], ["_us"], block=600_000_000)
        lat, lon, t = (F.col("_prev")[c] for c in ("lat", "lon", ts))
    v = F.try_divide(haversine_m(lat, lon, F.col("lat"), F.col("lon")), seconds_between(t, F.col(ts)))
    if cap is not None:
        v = F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(0.0)), F.lit(cap))).cast("float")
    return x.withColumn(out, v).drop("_us", "_prev")


def changed(df: DataFrame, col: str, by: list[str], order: list[str], out: str = "changed") -> DataFrame:
    """Whether the value differs from the row before; true on the first."""
    w = _w(by, order)
    return df.withColumn(out, F.lag(F.lit(1)).over(w).isNull() | ~F.col(col).eqNullSafe(F.lag(col).over(w)))


def monotonic_violations(df: DataFrame, col: str, by: list[str], order: list[str], strict: bool = True) -> DataFrame:
    """Rows that don't follow the row before them (in the given physical order)."""
    p = F.lag(col).over(_w(by, order))
    return df.withColumn("_p", p).where(F.col(col) <= F.col("_p") if strict else F.col(col) < F.col("_p")).drop("_p")


def rest_flag(df: DataFrame, by: list[str], ts: str = "ts", speed: str = "speed_mps", slow: float = 0.5, calm: float = 0.3, span_s: float = 2.0, out: str = "at_rest") -> DataFrame:
    """Slow, or a small spread of the acceleration norm over the last ``span_s`` seconds."""
    w = Window.partitionBy(*by).orderBy("_us").rangeBetween(-int(span_s * 1e6), 0)
    n = F.sqrt(F.col("ax_mps2").cast("double") ** 2 + F.col("ay_mps2").cast("double") ** 2 + F.col("az_mps2").cast("double") ** 2)
    x = df.withColumn("_us", F.unix_micros(ts)).withColumn("_norm", n).withColumn("norm_std", F.stddev_samp("_norm").over(w))
    return x.withColumn(out, F.coalesce(F.col(speed) < slow, F.lit(False)) | F.coalesce(F.col("norm_std") < calm, F.lit(False))).drop("_us", "_norm")


def elapsed(df: DataFrame, by: list[str], ts: str = "ts", out: str = "elapsed_s") -> DataFrame:
    return df.withColumn(out, seconds_between(F.min(ts).over(Window.partitionBy(*by)), F.col(ts)))


def heading_from_positions(df: DataFrame, by: list[str], order: list[str], out: str = "heading_from_pos") -> DataFrame:
    w = _w(by, order)
    return df.withColumn(out, bearing_deg(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")))


def upsample_positions(df: DataFrame, by: list[str], ts: str = "ts", order: list[str] | None = None) -> DataFrame:
    """Fills null positions linearly in time between the fixes around them and marks them ``interpolated``."""
    w = _w(by, order or [ts])
    fix = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.struct(F.unix_micros(ts).alias("t"), "lat", "lon"))
    x = df.withColumn("_f", fix)
    x = x.withColumn("_a", F.last("_f", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_b", F.first("_f", True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    k = F.try_divide(F.unix_micros(ts) - F.col("_a.t"), F.col("_b.t") - F.col("_a.t"))
    filled = lambda c: F.coalesce(F.when(F.col("_f").isNotNull(), F.col(f"_f.{c}")), F.col(f"_a.{c}") + k * (F.col(f"_b.{c}") - F.col(f"_a.{c}")))
    x = x.withColumn("interpolated", F.col("_f").isNull() & F.col("_a").isNotNull() & F.col("_b").isNotNull())
    return x.withColumn("lat", filled("lat")).withColumn("lon", filled("lon")).drop("_f", "_a", "_b")


def step_distance(df: DataFrame, by: list[str], order: list[str], out: str = "dist_m") -> DataFrame:
    w = _w(by, order)
    return df.withColumn(out, haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")))


def derivative(df: DataFrame, col: str, by: list[str], ts: str = "ts", order: list[str] | None = None, out: str | None = None) -> DataFrame:
    """Change per second from the row before (jerk from acceleration, yaw rate from heading)."""
    w = _w(by, order or [ts])
    c = F.col(col).cast("double")
    return df.withColumn(out or f"d_{col}", F.try_divide(c - F.lag(c).over(w), seconds_between(F.lag(ts).over(w), F.col(ts))))


def yaw_rate(df: DataFrame, by: list[str], ts: str = "ts", order: list[str] | None = None) -> DataFrame:
    """Degrees per second, the heading's short way round."""
    w = _w(by, order or [ts])
    turn = F.pmod(F.col("heading_deg").cast("double") - F.lag("heading_deg").over(w).cast("double") + 180, F.lit(360.0)) - 180
    return df.withColumn("yaw_rate_deg_s", F.try_divide(turn, seconds_between(F.lag(ts).over(w), F.col(ts))))


def interval_deviation(df: DataFrame, by: list[str], ts: str = "ts", order: list[str] | None = None, tolerance: float = 0.5) -> DataFrame:
    """Rows whose interval is off the key's median by more than ``tolerance`` of it."""
    x = dt_seconds(df, by, ts, order)
    med = x.groupBy(*by).agg(F.median("dt_s").alias("median_dt_s"))
    return x.join(med, by).withColumn("irregular", F.abs(F.col("dt_s") - F.col("median_dt_s")) > tolerance * F.col("median_dt_s"))


def bursts(df: DataFrame, by: list[str], gap_s: float, ts: str = "ts", order: list[str] | None = None) -> DataFrame:
    """(keys, burst_no, n_frames, start_ts, end_ts): frames between gaps longer than gap_s."""
    w = _w(by, order or [ts])
    new = F.coalesce((seconds_between(F.lag(ts).over(w), F.col(ts)) > gap_s).cast("int"), F.lit(1))
    x = df.withColumn("_n", new).withColumn("burst_no", F.sum("_n").over(w))
    return x.groupBy(*by, "burst_no").agg(F.count("*").alias("n_frames"), F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"))


def runs(df: DataFrame, cond: Column, by: list[str], ts: str = "ts", order: list[str] | None = None, least_s: float = 0.0) -> DataFrame:
    """(keys, start_ts, end_ts, n_rows, duration_s) of successive rows that meet a condition for ``least_s``."""
    w = _w(by, order or [ts])
    x = df.withColumn("_c", F.coalesce(cond, F.lit(False))).withColumn("_f", F.when(F.col("_c") & ~F.coalesce(F.lag("_c").over(w), F.lit(False)), 1).otherwise(0))
    x = x.withColumn("_i", F.sum("_f").over(w)).where("_c")
    g = x.groupBy(*by, "_i").agg(F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count("*").alias("n_rows"))
    return g.withColumn("duration_s", seconds_between(F.col("start_ts"), F.col("end_ts"))).where(F.col("duration_s") >= least_s).drop("_i")


#: Radii (m) below which a curve is of a class; thresholds of our own, as no published ones exist.
CURVES = [(25.0, "hairpin"), (75.0, "sharp"), (200.0, "moderate"), (1000.0, "gentle")]


def curve_radius(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Radius (m) of the circle through the fix before, this one and the next, its curvature (1/m) and class; null where two coincide."""
    w = _w(by, order)
    k = curvature(*[f(c).over(w) for f, c in ((F.lag, "lat"), (F.lag, "lon"))], F.col("lat"), F.col("lon"), *[F.lead(c).over(w) for c in ("lat", "lon")])
    x = df.withColumn("curvature_1_m", k).withColumn("curve_radius_m", F.try_divide(F.lit(1.0), F.abs("curvature_1_m")))
    label = F.when(F.col("curvature_1_m").isNull(), None)
    for r, name in CURVES:
        label = label.when(F.col("curve_radius_m") < r, name)
    return x.withColumn("curve_class", label.otherwise("straight"))


def curvature_rate(df: DataFrame, by: list[str], order: list[str], ts: str = "ts") -> DataFrame:
    """``curve_radius`` and the change of the curvature per second from the fix before."""
    return derivative(curve_radius(df, by, order), "curvature_1_m", by, ts, order, "curvature_rate")
