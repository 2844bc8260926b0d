"""Column catalogue of the flat record, profiles, legacy tables and nested records."""

from __future__ import annotations

from pyspark.sql import types as T

D, F32, S, TS = T.DoubleType(), T.FloatType(), T.StringType(), T.TimestampType()


def _fields(spec: list[tuple[str, T.DataType, bool]]) -> list[T.StructField]:
    return [T.StructField(n, t, nullable) for n, t, nullable in spec]


#: The functional groups of the record and their types (name, type, nullable).
GROUPS: dict[str, list[T.StructField]] = {
    "datetime": _fields([("ts", TS, False)]),
    "gnss": _fields([("lat", D, True), ("lon", D, True), ("speed_mps", F32, True)]),
    "gnss_extra": _fields([("heading_deg", F32, True), ("altitude_gps_m", F32, True), ("hdop", F32, True), ("h_accuracy_m", F32, True), ("n_satellites", T.ByteType(), True)]),
    "accel": _fields([("ax_mps2", F32, False), ("ay_mps2", F32, False), ("az_mps2", F32, False)]),
    "gyro": _fields([("gx_rad_s", F32, True), ("gy_rad_s", F32, True), ("gz_rad_s", F32, True)]),
    "magneto": _fields([("mx_uT", F32, True), ("my_uT", F32, True), ("mz_uT", F32, True)]),
    "obd": _fields([("speed_obd_mps", F32, True), ("rpm", F32, True), ("odometer_m", D, True)]),
    "io": _fields([("ignition", T.BooleanType(), True), ("vehicle_voltage_v", F32, True)]),
    "metadata": _fields([("device_id", S, True), ("trip_id", S, True)]),
}
#: The groups each profile makes mandatory, and those it may add.
PROFILES = {"core": ["datetime", "gnss"], "imu": ["datetime", "gnss", "accel"], "full": ["datetime", "gnss", "accel", "gyro"]}
OPTIONAL = {"core": ["gnss_extra", "obd", "io", "metadata"], "imu": ["gnss_extra", "gyro", "magneto", "obd", "io", "metadata"], "full": ["gnss_extra", "magneto", "obd", "io", "metadata"]}
#: Columns of higher layers, which must not stand in a record.
EXCLUDED = ["road_type", "speed_limit_kmh", "altitude_dem_m", "slope_pct", "event", "lat_matched", "carrier_state", "is_vehicle_data"]
#: Extended optional groups, dotted names.
EXTENDED = {
    "engine": ["status", "rpm", "coolant_temp_c", "load_pct", "oil_temp_c"],
    "fuel": ["level_pct", "rate_lph", "used_l", "range_km", "type"],
    "odometer": ["total_km", "trip_km", "source"],
    "diagnostics": ["dtc_count", "mil_status", "obd_voltage_v", "throttle_pct"],
    "energy": ["battery_level_pct", "battery_voltage_v", "battery_temp_c", "energy_used_kwh", "charging_status"],
}
#: Contexts, each a namespace that a reader may ignore.
CONTEXTS = {
    "topography": ["slope_deg", "surface_type"],
    "weather": ["temp_c", "precip_mm"],
    "road_genome": ["curve_radius_m", "clothoid_k", "risk_index"],
    "environmental_impact": ["co2_grams", "energy_recovered_kwh"],
}

LEGACY = {
    "trajectory": T.StructType(_fields([("timestamp_ns", T.LongType(), False), ("lat", D, False), ("lon", D, False), ("alt", F32, True), ("speed_mps", F32, False)])),
    "imu": T.StructType(_fields([("timestamp_ns", T.LongType(), False), *((f"acc_{a}", F32, False) for a in "xyz"), *((f"gyro_{a}", F32, False) for a in "xyz")])),
    "events": T.StructType(_fields([("timestamp_ns", T.LongType(), False), ("event_type", S, False), ("severity", T.ByteType(), True), ("meta", S, True)])),
}

#: Leaves of the nested record: path -> (type, least, most, allowed values); required ones end in "!".
NESTED_LEAVES: dict[str, tuple[str, float | None, float | None, list[str] | None]] = {
    "timestamp!": ("string", None, None, None),
    "vehicle_id!": ("string", None, None, None),
    "position.lat!": ("double", -90, 90, None),
    "position.lon!": ("double", -180, 180, None),
    "position.altitude_m": ("double", None, None, None),
    "position.heading_deg": ("double", 0, 360, None),
    "motion.speed_kph": ("double", 0, None, None),
    "motion.bearing_deg": ("double", 0, 360, None),
    "quality.hdop": ("double", None, None, None),
    "quality.vdop": ("double", None, None, None),
    "quality.pdop": ("double", None, None, None),
    "quality.num_satellites": ("int", 0, None, None),
    "quality.fix_type": ("string", None, None, ["none", "2d", "3d", "dgps", "rtk"]),
    "imu.accel.x_ms2": ("double", None, None, None),
    "imu.accel.y_ms2": ("double", None, None, None),
    "imu.accel.z_ms2": ("double", None, None, None),
    "imu.gyro.x_rads": ("double", None, None, None),
    "imu.gyro.y_rads": ("double", None, None, None),
    "imu.gyro.z_rads": ("double", None, None, None),
    "imu.mag.x_ut": ("double", None, None, None),
    "imu.mag.y_ut": ("double", None, None, None),
    "imu.mag.z_ut": ("double", None, None, None),
    "imu.sample_rate_hz": ("double", None, None, None),
    "powertrain.rpm": ("double", 0, None, None),
    "powertrain.odometer_km": ("double", 0, None, None),
    "powertrain.throttle_pct": ("double", 0, 100, None),
    "powertrain.coolant_temp_c": ("double", None, None, None),
    "powertrain.battery_voltage_v": ("double", None, None, None),
    "energy.fuel_pct": ("double", 0, 100, None),
    "energy.fuel_l": ("double", 0, None, None),
    "energy.fuel_rate_lph": ("double", 0, None, None),
    "energy.consumed_kwh": ("double", 0, None, None),
    "energy.recovered_kwh": ("double", 0, None, None),
    "energy.state_of_charge_pct": ("double", 0, 100, None),
    "energy.charging_status": ("string", None, None, ["disconnected", "charging", "charged", "error"]),
    "energy.energy_source": ("string", None, None, ["ice", "hev", "phev", "bev"]),
    "events": ("array<struct<event_id:string,type:string,severity:string,start:string,end:string,metadata:map<string,string>>>", None, None, None),
    "context": ("map<string,map<string,string>>", None, None, None),
    "source.schema_version": ("string", None, None, ["0.2"]),
    "source.provider": ("string", None, None, None),
    "source.device_id": ("string", None, None, None),
    "source.ingest_timestamp": ("string", None, None, None),
}
#: Names without the mark of required ones.
NESTED_PATHS = {k.rstrip("!"): v for k, v in NESTED_LEAVES.items()}
NESTED_REQUIRED = [k[:-1] for k in NESTED_LEAVES if k.endswith("!")]
SEVERITIES = ["low", "medium", "high"]


def _nested() -> str:
    tree: dict = {}
    for path, (kind, *_) in NESTED_PATHS.items():
        *above, leaf = path.split(".")
        node = tree
        for p in above:
            node = node.setdefault(p, {})
        node[leaf] = kind
    write = lambda n: "struct<" + ",".join(f"{k}:{write(v) if isinstance(v, dict) else v}" for k, v in n.items()) + ">"
    return ", ".join(f"{k} {write(v) if isinstance(v, dict) else v}" for k, v in tree.items())


#: The nested record as a Spark type in DDL; read JSON with it, then ``flatten_structs``.
NESTED = _nested()


def schema_for_profile(profile: str = "imu", include_optional: bool = False) -> T.StructType:
    """Mandatory columns of a profile, with the optional groups on demand."""
    if profile not in PROFILES:
        raise ValueError(f"no profile {profile!r}; there are {sorted(PROFILES)}")
    names = PROFILES[profile] + (OPTIONAL[profile] if include_optional else [])
    return T.StructType([f for g in names for f in GROUPS[g]])


COMPLETE = T.StructType([f for g in GROUPS.values() for f in g])
KNOWN = {f.name: f for f in COMPLETE}


def cols(group: str) -> list[str]:
    return [f.name for f in GROUPS[group]]


#: Tables by name: v0.8 profiles, the whole catalogue and the legacy trio (legacy imu as ``imu_legacy``).
TABLES = {"core": schema_for_profile("core"), "imu": schema_for_profile("imu"), "full": schema_for_profile("full"), "complete": COMPLETE, "trajectory": LEGACY["trajectory"], "events": LEGACY["events"], "imu_legacy": LEGACY["imu"]}
