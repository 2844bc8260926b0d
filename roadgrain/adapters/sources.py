"""One plan per source: explicit CSV schemas, unit projections, as-of joins, derived columns.

Every adapter scans each sensor once over all trips or sessions; nothing loops over them.
"""

from __future__ import annotations

import re
import warnings
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadgrain.functions import scalars as U
from roadgrain.functions.geo import nmea_to_degrees
from roadgrain.operators.asof import asof_join, lookup, positional_join
from roadgrain.operators.frame import at_least, keep_keys, one_hot_label, sparse_gps, top_keys
from roadgrain.operators.windows import speed_from_positions
from roadgrain.sources.readers import read_columns_text, read_csv

f32 = lambda c: c.cast("float")


def load_aegis(
    spark: SparkSession, path: str, top_n_trips: int | None = 5, with_gyro: bool = True, with_obd: bool = True, by_trip: bool = False, tolerances_ms: dict[str, int] | None = None, least_rows: int = 0
) -> DataFrame:
    """Acceleration clock with the nearest position, rotation and OBD speed.

    ``by_trip`` keeps joins inside trips; ``tolerances_ms`` (keys gps, gyro, obd) nulls what lies further off.
    """
    root, tol = Path(path), tolerances_ms or {}
    xyz = "trip_id string, timestamp string, x_value double, y_value double, z_value double"
    acc = read_csv(spark, root / "accelerations.csv", xyz)
    acc = acc.withColumn("ts", acc["timestamp"] if dict(acc.dtypes)["timestamp"] == "timestamp" else F.try_to_timestamp("timestamp"))
    if least_rows:
        acc = at_least(acc, "trip_id", least_rows)
    keep = top_keys(acc, "trip_id", top_n_trips, first="ts")
    trips = lambda df: keep_keys(df, keep, "trip_id")
    a = trips(acc).select("trip_id", "ts", *[U.g_to_mps2(F.col(f"{c}_value")).alias(f"a{c}_mps2") for c in "xyz"])
    by = ["trip_id"] if by_trip else []
    us = lambda k: None if k not in tol else tol[k] * 1000
    clock = lambda df: df.withColumnRenamed("timestamp", "ts") if dict(df.dtypes)["timestamp"] == "timestamp" else df.withColumn("ts", F.try_to_timestamp("timestamp"))
    pos = trips(clock(read_csv(spark, root / "positions.csv", "trip_id string, timestamp string, latitude double, longitude double, altitude double")))
    pos = pos.select("trip_id", "ts", nmea_to_degrees(F.col("latitude")).alias("lat"), nmea_to_degrees(F.col("longitude")).alias("lon"), f32(F.col("altitude")).alias("altitude_gps_m"))
    side = lambda df: df if by else df.drop("trip_id")
    x = asof_join(a, side(pos), "ts", by, us("gps")).drop("ts_r", "delta_us")
    if with_gyro and (root / "gyroscopes.csv").exists():
        g = trips(clock(read_csv(spark, root / "gyroscopes.csv", xyz))).select("trip_id", "ts", *[f32(U.deg_to_rad(F.col(f"{c}_value"))).alias(f"g{c}_rad_s") for c in "xyz"])
        x = asof_join(x, side(g), "ts", by, us("gyro")).drop("ts_r", "delta_us")
    if with_obd and (root / "obdData.csv").exists():
        o = trips(clock(read_csv(spark, root / "obdData.csv", "trip_id string, timestamp string, obdPid string, data string"))).where("obdPid = '0D'")
        x = asof_join(x, side(o.select("trip_id", "ts", f32(U.kmh_to_mps(F.col("data"))).alias("speed_obd_mps"))), "ts", by, us("obd")).drop("ts_r", "delta_us")
    x = speed_from_positions(x, by, "ts", cap=80.0, out="speed_mps")
    meta = read_csv(spark, root / "trips.csv", "trip_id string, beaglebone_id string", ts=None)
    x = lookup(x, meta.withColumnRenamed("beaglebone_id", "device_id"), "trip_id", "device_id", "unknown", valid=r"^\d+$")
    return x.dropna(subset=["ax_mps2", "ay_mps2", "az_mps2", "lat", "lon"])


#: The surface flags of the road label file, in order of precedence, and the label each stands for.
SURFACES = [
    ("speed_bump_asphalt", "speed_bump"),
    ("speed_bump_cobblestone", "speed_bump_cobble"),
    ("cobblestone_road", "cobblestone"),
    ("dirt_road", "dirt"),
    ("unpaved_road", "unpaved"),
    ("asphalt_road", "asphalt"),
]


def load_pvs(spark: SparkSession, path: str, trip_idx: int | None = None, placement: str = "dashboard", side: str = "left", labels: bool = False, sparse: bool = False) -> DataFrame:
    """Folders ``PVS n``: IMU of one placement with its position, satellites' data as of the nearest fix."""
    dirs = sorted((p for p in Path(path).glob("PVS *") if p.is_dir()), key=lambda p: int(re.findall(r"\d+", p.name)[-1]))
    if trip_idx is not None:
        dirs = dirs[trip_idx - 1 : trip_idx]
    files = [p / f"dataset_gps_mpu_{side}.csv" for p in dirs if (p / f"dataset_gps_mpu_{side}.csv").exists()]
    if not files:
        raise FileNotFoundError(f"no PVS trips under {path}")
    trip = F.replace(F.regexp_extract(F.url_decode(F.input_file_name()), r"/(PVS [0-9]+)/[^/]*$", 1), F.lit(" "), F.lit("_"))
    raw = read_csv(spark, files, None, ts=None).withColumn("trip_id", trip).withColumn("_row", F.monotonically_increasing_id())
    num = lambda c: F.col(c).try_cast("double") if c in raw.columns else F.lit(None).cast("double")
    x = raw.select(
        "trip_id", U.epoch_to_ts(num("timestamp"), "s").alias("ts"), *[f32(num(f"acc_{c}_{placement}")).alias(f"a{c}_mps2") for c in "xyz"],
        *[f32(U.deg_to_rad(num(f"gyro_{c}_{placement}"))).alias(f"g{c}_rad_s") for c in "xyz"], *[f32(num(f"mag_{c}_{placement}")).alias(f"m{c}_uT") for c in "xyz"],
        num("latitude").alias("lat"), num("longitude").alias("lon"), f32(U.clip_filled(num("speed"), 0.0, 50.0)).alias("speed_mps"), num("timestamp_gps").alias("_gps"), "_row",
    ).withColumn("device_id", F.lit(f"pvs_{placement}_{side}"))
    gps = [p / "dataset_gps.csv" for p in dirs if (p / "dataset_gps.csv").exists()]
    if gps:
        g = read_csv(spark, gps, None, ts=None).withColumn("trip_id", trip)
        if "elevation" in g.columns:
            pick = lambda c, t: (F.col(c).try_cast("double").cast(t) if c in g.columns else F.lit(None).cast(t))
            g = g.select("trip_id", U.epoch_to_ts(F.col("timestamp").try_cast("double"), "s").alias("ts"), pick("elevation", "float").alias("altitude_gps_m"), pick("hdop", "float").alias("hdop"), pick("satellites", "tinyint").alias("n_satellites"))
            x = asof_join(x, g, "ts", ["trip_id"]).drop("ts_r", "delta_us")
    if labels:
        lab = [p / f"dataset_labels.csv" for p in dirs if (p / "dataset_labels.csv").exists()]
        if lab:
            pos = lambda df: df.withColumn("_n", F.expr("row_number() over (partition by trip_id order by _row)"))
            lt = read_csv(spark, lab, None, ts=None).withColumn("trip_id", trip).withColumn("_row", F.monotonically_increasing_id())
            flags = [f for f in SURFACES if f[0] in lt.columns]
            lt = pos(lt.withColumns({f[0]: F.col(f[0]).try_cast("int") for f in flags})).select(F.col("trip_id").alias("_t"), F.col("_n").alias("_m"), one_hot_label(flags).alias("road_surface"))
            x = pos(x).join(lt, (F.col("trip_id") == F.col("_t")) & (F.col("_n") == F.col("_m")), "left").drop("_t", "_m", "_n")
    if sparse:
        return sparse_gps(x, "_gps", ["trip_id"], "_row").drop("_gps", "_row")
    return x.dropna(subset=["ax_mps2", "ay_mps2", "az_mps2", "lat", "lon"]).drop("_gps", "_row")


def load_stride(spark: SparkSession, path: str, category: str | None = None, session_idx: int | None = None, with_gyro: bool = True, with_magneto: bool = False) -> DataFrame:
    """Folders category/session of phone sensors; one scan per sensor, keyed by session."""
    cats = sorted(p for p in Path(path).iterdir() if p.is_dir())
    if category is not None:
        if category not in {p.name for p in cats}:
            raise ValueError(f"no category {category!r}")
        cats = [p for p in cats if p.name == category]
    sessions = [s for c in cats for s in sorted(p for p in c.iterdir() if p.is_dir())]
    if session_idx is not None:
        sessions = sessions[session_idx : session_idx + 1]
    sessions = [s for s in sessions if (s / "TotalAcceleration.csv").exists() and (s / "Location.csv").exists()]
    if not sessions:
        raise FileNotFoundError(f"no sessions under {path}")
    key = F.regexp_replace(F.regexp_extract(F.url_decode(F.input_file_name()), r"([^/]+/[^/]+)/[^/]*$", 1), "[/ ]", "_")

    def sensor(name: str) -> DataFrame | None:
        files = [s / f"{name}.csv" for s in sessions if (s / f"{name}.csv").exists()]
        return read_csv(spark, files, None, ts=None).withColumn("trip_id", key).withColumn("ts", U.epoch_to_ts(F.col("time").try_cast("long"), "ns")) if files else None

    a = sensor("TotalAcceleration")
    x = a.select("trip_id", "ts", *[f32(F.col(c).try_cast("double")).alias(f"a{c}_mps2") for c in "xyz"])
    loc = sensor("Location")
    opt = {"altitude": "altitude_gps_m", "bearing": "heading_deg", "horizontalAccuracy": "h_accuracy_m"}
    d = lambda c: F.col(c).try_cast("double")
    loc = loc.select("trip_id", "ts", d("latitude").alias("lat"), d("longitude").alias("lon"), f32(U.clip_filled(d("speed"), 0.0, 50.0)).alias("speed_mps"), *[f32(d(k)).alias(v) for k, v in opt.items() if k in loc.columns])
    x = asof_join(x, loc, "ts", ["trip_id"]).drop("ts_r", "delta_us")
    for on, name, pre, suf in ((with_gyro, "Gyroscope", "g", "_rad_s"), (with_magneto, "Magnetometer", "m", "_uT")):
        s = sensor(name) if on else None
        if s is not None:
            x = asof_join(x, s.select("trip_id", "ts", *[f32(d(c)).alias(f"{pre}{c}{suf}") for c in "xyz"]), "ts", ["trip_id"]).drop("ts_r", "delta_us")
    return x.withColumn("device_id", F.lit("stride_phone")).dropna(subset=["ax_mps2", "ay_mps2", "az_mps2", "lat", "lon"])


#: Positional names of the header-less files.
UAH_ACC = ["t", "active", "ax_g", "ay_g", "az_g", "ax_kf", "ay_kf", "az_kf", "roll_deg", "pitch_deg"]
UAH_GPS = ["t", "speed_kmh", "lat", "lon", "altitude", "v_acc", "h_acc", "course", "d_course", "pos_state", "lane_state"]


def load_uah(spark: SparkSession, path: str, freq_hz: int = 10, start: str = "2015-01-01T00:00:00Z") -> DataFrame:
    """Trips of blank-separated text: a synthetic clock on the accelerometer's rows, GPS row k on row k * freq."""
    acc = sorted(Path(path).rglob("RAW_ACCELEROMETERS.txt"))
    if not acc:
        raise FileNotFoundError(f"no accelerometer files under {path}")
    for p in [p for p in acc if not p.with_name("RAW_GPS.txt").exists()]:
        warnings.warn(f"trip {p.parent.name} has no position file and is left out", stacklevel=2)
        acc.remove(p)
    if not acc:
        raise FileNotFoundError(f"no trip with position files under {path}")
    trip = F.regexp_extract(F.url_decode("file"), r"([^/]+)/[^/]*$", 1)
    rows = lambda files, names: read_columns_text(spark, files, names).withColumn("trip_id", trip).withColumn("n", F.expr("row_number() over (partition by trip_id order by row_no) - 1"))
    a = rows(acc, UAH_ACC)
    t0 = F.unix_micros(F.lit(start).cast("timestamp"))
    a = a.select("trip_id", "n", F.timestamp_micros(t0 + F.floor(F.col("n") * 1e6 / freq_hz).cast("long")).alias("ts"), *[U.g_to_mps2(F.col(f"a{c}_g")).alias(f"a{c}_mps2") for c in "xyz"], *[f32(U.deg_to_rad(F.col(f"{r}_deg"))).alias(f"x_uah_{r}_rad") for r in ("roll", "pitch")])
    gps = [p.with_name("RAW_GPS.txt") for p in acc if p.with_name("RAW_GPS.txt").exists()]
    g = rows(gps, UAH_GPS).select(F.col("trip_id").alias("_t"), F.col("n").alias("k"), "lat", "lon", f32(U.kmh_to_mps(F.col("speed_kmh"))).alias("speed_mps"), f32(F.col("course")).alias("heading_deg"), f32(F.col("altitude")).alias("altitude_gps_m"))
    out = positional_join(a, g.withColumnRenamed("_t", "trip_id"), "n", "k", freq_hz, by=["trip_id"])
    return out.drop("k", "n").withColumn("device_id", F.lit("uah_phone"))


#: Names of a simulator's columns, and those of its ground truth, which become extras.
SIMULATED = {"timestamp": "ts", "speed": "speed_mps", "alt": "altitude_gps_m", "heading": "heading_deg"} | {f"acc_{a}": f"a{a}_mps2" for a in "xyz"} | {f"gyro_{a}": f"g{a}_rad_s" for a in "xyz"}
GROUND_TRUTH = ["event", "event_infra", "event_behavior", "event_context", "road_type", "slope_pct", "target_speed"]


def load_simulated(spark: SparkSession, path: str, trip_id: str = "sim", device_id: str = "simulator", prefix: str = "x_sim_") -> DataFrame:
    """Simulator samples, renamed, ground truth under the prefix; the clock read from ISO text."""
    df = read_csv(spark, path, None, ts=None).withColumnsRenamed(SIMULATED | {c: prefix + c for c in GROUND_TRUTH})
    text = [c for c in df.columns if not c.startswith(prefix) and c not in ("ts", "trip_id", "device_id")]
    df = df.withColumns({c: F.col(c).try_cast("double") for c in text}).withColumn("ts", F.try_to_timestamp("ts"))
    return df.withColumns({k: F.lit(v) for k, v in (("trip_id", trip_id), ("device_id", device_id)) if k not in df.columns})


#: providers' names of the record's columns, with the factor to the record's unit where theirs differs.
PROVIDERS = {
    "samsara": {"time": ("ts", None), "latitude": ("lat", None), "longitude": ("lon", None), "speed": ("speed_mps", 1 / 3.6), "bearingDeg": ("heading_deg", None), "engineState": ("ignition", None), "odometerMeters": ("odometer_m", None), "engineRpm": ("rpm", None)},
    "webfleet": {"gpstime": ("ts", None), "lat": ("lat", None), "lon": ("lon", None), "speed": ("speed_mps", 1 / 3.6), "heading": ("heading_deg", None), "ignition": ("ignition", None), "mileage": ("odometer_m", 1000.0)},
    "geotab": {"dateTime": ("ts", None), "latitude": ("lat", None), "longitude": ("lon", None), "speed": ("speed_mps", 1 / 3.6), "bearing": ("heading_deg", None), "ignition": ("ignition", None), "odometer": ("odometer_m", None), "engineRpm": ("rpm", None)},
    "teltonika": {"timestamp": ("ts", None), "latitude": ("lat", None), "longitude": ("lon", None), "avl_1": ("speed_mps", 1 / 3.6), "avl_13": ("heading_deg", None), "avl_22": ("altitude_gps_m", None), "avl_239": ("ignition", None), "avl_16": ("odometer_m", None), "avl_10": ("rpm", None), "external.powersource.voltage": ("vehicle_voltage_v", None)},
}
#: providers' names of nested-record leaves.
NESTED_PROVIDER = {"speed": "motion.speed_kph", "heading": "position.heading_deg", "bearing": "position.heading_deg", "latitude": "position.lat", "longitude": "position.lon", "altitude": "position.altitude_m", "fuelLevel": "energy.fuel_pct", "odometer": "powertrain.odometer_km", "engineRpm": "powertrain.rpm", "energyConsumed": "energy.consumed_kwh", "satelliteCount": "quality.num_satellites", "hdop": "quality.hdop", "VIN": "source.device_id", "driverId": "context.fleet.driver_id"}


def map_provider(df: DataFrame, provider: str) -> DataFrame:
    """Provider columns renamed and scaled to SI; others stay as they are."""
    if provider not in PROVIDERS:
        raise ValueError(f"no provider {provider!r}")
    m = {k: v for k, v in PROVIDERS[provider].items() if k in df.columns}
    rest = [F.col(f"`{c}`") for c in df.columns if c not in m]
    return df.select(*[(F.col(f"`{k}`") if f is None else F.col(f"`{k}`").try_cast("double") * f).alias(n) for k, (n, f) in m.items()], *rest)


__all__ = ["GROUND_TRUTH", "NESTED_PROVIDER", "PROVIDERS", "SIMULATED", "load_aegis", "load_pvs", "load_simulated", "load_stride", "load_uah", "map_provider", "positional_join"]
