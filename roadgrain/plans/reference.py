"""Queries of the engine's own operators over the test tables, each beside its SQL twin.

``records`` holds copies of rows sent again; ``base`` takes each rec_id once and leaves it partitioned by trip, so the
windows that follow need no further shuffle. ``once`` is for the queries without windows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadgrain import schema as S
from roadgrain.functions import geo, scalars
from roadgrain.operators import aggregates as A
from roadgrain.operators import asof, events_layer, frame, introspect, windows
from roadgrain.sources import table
from roadgrain.validate import rule_counts

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TRIP, ORDER = ["trip_id"], ["ts", "rec_id"]


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def base(s: SparkSession, d: str, *cols: str) -> DataFrame:
    keep = list(dict.fromkeys(["rec_id", "trip_id", "ts", *cols]))
    return scalars.nan_to_null(table(s, d, "records").select(*keep)).repartition("trip_id").dropDuplicates(["trip_id", "rec_id"])


def once(s: SparkSession, d: str, *cols: str) -> DataFrame:
    """Each row of records once, without an order by trip: copies meet in a partial aggregation before the shuffle."""
    keep = list(dict.fromkeys(["rec_id", "trip_id", "ts", *cols]))
    return scalars.nan_to_null(table(s, d, "records").select(*keep)).distinct()


def obd(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "obd_points").where("trip_id is not null").distinct()


def r6(c: Column | str, n: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), n)


def us(c: str = "ts") -> Column:
    return F.unix_micros(c)


# SQL fragments.
REC = """r AS (SELECT DISTINCT rec_id, trip_id, device_id, ts, epoch_us(ts) AS us, CASE WHEN NOT isnan(lat) THEN lat END AS lat, CASE WHEN NOT isnan(lon) THEN lon END AS lon, CAST(speed_mps AS DOUBLE) AS speed, CAST(heading_deg AS DOUBLE) AS heading,
 CAST(ax_mps2 AS DOUBLE) AS ax, CAST(ay_mps2 AS DOUBLE) AS ay, CAST(az_mps2 AS DOUBLE) AS az, CAST(gx_rad_s AS DOUBLE) AS gx, CAST(gy_rad_s AS DOUBLE) AS gy, CAST(gz_rad_s AS DOUBLE) AS gz,
 CAST(speed_obd_mps AS DOUBLE) AS speed_obd, rpm, odometer_m, ignition, CAST(vehicle_voltage_v AS DOUBLE) AS volt, hdop, n_satellites, altitude_gps_m FROM records)"""
W = "OVER (PARTITION BY trip_id ORDER BY us, rec_id)"
OBD = "o AS (SELECT DISTINCT obd_id, trip_id, epoch_us(ts) AS us, obd_pid, raw_value FROM obd_points WHERE trip_id IS NOT NULL)"
NORM = "sqrt(ax*ax + ay*ay + az*az)"


def hav(a: str, b: str, c: str, d: str, radius: float = 6371000.0) -> str:
    h = f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"
    return f"2 * {radius} * atan2(sqrt({h}), sqrt(abs(1 - {h})))"


# Scans and projections.
@query("SELECT count(*) AS n_rows, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us FROM records")
def scan_summary(s, d):
    return A.time_summary(table(s, d, "records").select("ts")).select("n_rows", us("time_min").alias("first_us"), us("time_max").alias("last_us"))


@query(f"WITH {REC} SELECT rec_id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM r WHERE lat IS NOT NULL AND lon IS NOT NULL")
def gnss_view(s, d):
    return frame.gnss_view(once(s, d, "lat", "lon")).select("rec_id", r6("lat").alias("lat"), r6("lon").alias("lon"))


@query("SELECT DISTINCT rec_id, trip_id FROM records WHERE ts >= TIMESTAMPTZ '2021-01-04 06:00:00+00' AND ts <= TIMESTAMPTZ '2021-01-04 12:00:00+00'")
def filter_time(s, d):
    r = frame.filter_time(table(s, d, "records"), "2021-01-04T06:00:00Z", "2021-01-04T12:00:00Z")
    return frame.select(r, ["rec_id", "trip_id"]).distinct()


@query(f"WITH {REC} SELECT rec_id, device_id, trip_id FROM r")
def select_fields(s, d):
    return frame.select_fields(once(s, d, "device_id"), ["rec_id", "no_such_field", "device_id", "trip_id"])


@query(f"WITH {REC}, k AS (SELECT rec_id, trip_id, us, CAST(floor(us / 2000000.0) AS BIGINT) AS g, lat FROM r) SELECT rec_id, CASE WHEN n > 1 AND g = pg THEN NULL ELSE round(lat, 6) END AS lat FROM (SELECT *, lag(g) {W} AS pg, row_number() {W} AS n FROM k)")
def gnss_sparse(s, d):
    r = base(s, d, "lat").withColumn("gps_clock", F.floor(us() / F.lit(2e6)))
    return frame.sparse_gps(r.withColumn("_o", F.struct("ts", "rec_id")), "gps_clock", TRIP, "_o", ("lat",)).select("rec_id", r6("lat").alias("lat"))


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN 'a' WHEN event_type = 'view' THEN 'b' ELSE 'unknown' END AS label FROM events")
def one_hot_label(s, d):
    e = table(s, d, "events").select("event_id", (F.col("event_type") == "click").cast("int").alias("is_click"), (F.col("event_type") == "view").cast("int").alias("is_view"))
    return e.select("event_id", frame.one_hot_label([("is_click", "a"), ("is_view", "b")]).alias("label"))


@query("SELECT event_id, CAST(least(greatest(trunc(value / 100), 0), 1) AS INTEGER) AS flag, CAST(0 AS INTEGER) AS absent_flag, CAST(NULL AS VARCHAR) AS note FROM events")
def event_defaults(s, d):
    e = table(s, d, "events").select("event_id", (F.col("value") / 100).alias("flag"))
    return frame.event_defaults(e, ["flag", "absent_flag"], ["note"])


@query("SELECT user_id AS device, event_id, round(value, 6) AS speed, 'sensor' AS \"context.source.kind\" FROM events")
def provider_map(s, d):
    e = frame.map_provider(table(s, d, "events").select("user_id", "event_id", "value"), {"user_id": "device", "value": "speed"})
    return frame.add_context(e.withColumn("speed", r6("speed")), "source", {"kind": "sensor"})


@query("SELECT event_id, epoch_us(ts) AS ts_us, round(value, 6) AS lat FROM events")
def alias_resolution(s, d):
    e = table(s, d, "events").select("event_id", F.col("ts").alias("time"), F.col("value").alias("gps_lat"))
    x = frame.resolve_aliases(e, {"lat": ["nope", "gps_lat"]})
    return x.select("event_id", us("timestamp").alias("ts_us"), r6("lat").alias("lat"))


@query(f"WITH {REC} SELECT rec_id FROM (SELECT rec_id, row_number() {W} AS n FROM r) WHERE (n - 1) % 10 = 0")
def decimation(s, d):
    return frame.decimate(base(s, d), 10, TRIP, ORDER).select("rec_id")


@query("SELECT event_id, CAST(NULL AS BIGINT) AS l_orderkey, user_id AS key FROM events UNION ALL SELECT NULL, l_orderkey, l_partkey FROM lineitem")
def union_frames(s, d):
    return frame.union_frames([table(s, d, "events").select("event_id", F.col("user_id").alias("key")), table(s, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("key"))]).select("event_id", "l_orderkey", "key")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(s, d):
    return scalars.flatten_structs(table(s, d, "events").select("event_id", F.from_json("props", "k long").alias("p"))).select("event_id", F.col("`p.k`").alias("k"))


# Joins.
NEAREST = f"""
{REC}, {OBD}, rr AS (SELECT trip_id, us, min(rec_id) AS lo, max(rec_id) AS hi FROM r GROUP BY 1, 2),
b AS (SELECT o.obd_id, rr.us AS bus, rr.hi AS bid FROM o ASOF LEFT JOIN rr ON o.trip_id = rr.trip_id AND o.us >= rr.us),
f AS (SELECT o.obd_id, rr.us AS fus, rr.lo AS fid FROM o ASOF LEFT JOIN rr ON o.trip_id = rr.trip_id AND o.us <= rr.us),
n AS (SELECT o.obd_id, o.us, CASE WHEN bus IS NOT NULL AND (fus IS NULL OR o.us - bus <= fus - o.us) THEN bid ELSE fid END AS rec_id,
 CASE WHEN bus IS NOT NULL AND (fus IS NULL OR o.us - bus <= fus - o.us) THEN bus ELSE fus END - o.us AS delta_us
 FROM o JOIN b USING (obd_id) JOIN f USING (obd_id))
"""


def _asof(s, d, tolerance=None, bucket=None, direction="nearest"):
    left = obd(s, d).select("obd_id", "trip_id", "ts")
    j = asof.asof_join(left, base(s, d).select("rec_id", "trip_id", "ts"), "ts", TRIP, tolerance, direction, bucket_us=bucket)
    return j.select("obd_id", "rec_id", "delta_us")


@query(f"WITH {NEAREST} SELECT obd_id, rec_id, delta_us FROM n")
def asof_nearest(s, d):
    return _asof(s, d)


@query(f"WITH {NEAREST} SELECT obd_id, rec_id, delta_us FROM n")
def asof_nearest_bucketed(s, d):
    return _asof(s, d, bucket=60_000_000)


@query(f"WITH {NEAREST} SELECT obd_id, CASE WHEN abs(delta_us) <= 200000 THEN rec_id END AS rec_id, CASE WHEN abs(delta_us) <= 200000 THEN delta_us END AS delta_us FROM n")
def asof_tolerance(s, d):
    return _asof(s, d, 200_000)


@query(f"WITH {NEAREST} SELECT o.obd_id, b.bid AS rec_id, b.bus - o.us AS delta_us FROM o LEFT JOIN b USING (obd_id)")
def asof_backward(s, d):
    return _asof(s, d, direction="backward")


@query(f"WITH {NEAREST} SELECT o.obd_id, f.fid AS rec_id, f.fus - o.us AS delta_us FROM o LEFT JOIN f USING (obd_id)")
def asof_forward(s, d):
    return _asof(s, d, direction="forward")


@query(f"WITH {NEAREST} SELECT count(*) AS pairs, max(abs(delta_us)) AS max_abs_delta_us, round(avg(CASE WHEN abs(delta_us) <= 200000 THEN 1.0 ELSE 0.0 END), 6) AS within_ratio, CAST(sum(CASE WHEN abs(delta_us) > 200000 THEN 1 ELSE 0 END) AS BIGINT) AS exceeds FROM n WHERE delta_us IS NOT NULL")
def alignment_metrics(s, d):
    m = asof.alignment_metrics(obd(s, d), base(s, d), "ts", TRIP, 200_000)
    return m.withColumn("within_ratio", r6("within_ratio"))


@query(f"WITH {REC} SELECT r.rec_id, coalesce(t.acc_frame, 'raw') AS acc_frame FROM r LEFT JOIN trips t ON r.trip_id = t.trip_id AND r.ts >= t.started_at AND r.ts <= t.ended_at")
def acc_frame_tag(s, d):
    p = table(s, d, "trips").select("trip_id", "started_at", "ended_at", "acc_frame", F.lit(1).alias("ord"))
    return asof.interval_tag(once(s, d), p, "ts", "acc_frame", "raw", TRIP, "started_at", "ended_at").select("rec_id", "acc_frame")


@query("SELECT DISTINCT rec_id, CASE WHEN ts >= TIMESTAMPTZ '2021-01-04 03:00:00+00' AND ts <= TIMESTAMPTZ '2021-01-04 09:00:00+00' THEN 'partial' WHEN ts >= TIMESTAMPTZ '2021-01-04 06:00:00+00' THEN 'compensated' ELSE 'raw' END AS acc_frame FROM records")
def acc_frame_case(s, d):
    c = asof.interval_case(F.col("ts"), [("2021-01-04T03:00:00Z", "2021-01-04T09:00:00Z", "partial"), ("2021-01-04T06:00:00Z", "present", "compensated")], "raw")
    return table(s, d, "records").select("rec_id", c.alias("acc_frame")).distinct()


@query(f"WITH {REC}, t AS (SELECT trip_id, min(device_id) AS d FROM trips GROUP BY 1) SELECT r.rec_id, CASE WHEN regexp_matches(r.trip_id, '^[A-Z]+-[0-9]') THEN coalesce(t.d, 'unknown') ELSE 'unknown' END AS device_id FROM r LEFT JOIN t USING (trip_id)")
def device_lookup(s, d):
    return asof.lookup(once(s, d), table(s, d, "trips").select("trip_id", "device_id"), "trip_id", "device_id", "unknown", r"^[A-Z]+-[0-9]").select("rec_id", "device_id")


@query(f"WITH {REC} SELECT rec_id FROM r JOIN (SELECT trip_id FROM trips WHERE carrier_state IN ('mounted_driving', 'mounted_idle')) t USING (trip_id)")
def carrier_filter(s, d):
    t = table(s, d, "trips").where(F.col("carrier_state").isin("mounted_driving", "mounted_idle"))
    return frame.keep_keys(once(s, d), t, "trip_id").select("rec_id")


@query(f"WITH {REC}, c AS (SELECT trip_id, epoch_us(started_at) AS us, profile_name FROM trips) SELECT r.rec_id, c.profile_name FROM r ASOF LEFT JOIN c ON r.trip_id = c.trip_id AND r.us >= c.us")
def config_step(s, d):
    c = table(s, d, "trips").select("trip_id", F.col("started_at").alias("ts"), "profile_name")
    return asof.step_value(base(s, d), c, "ts", TRIP).select("rec_id", "profile_name")


@query(f"WITH {REC}, n AS (SELECT *, row_number() {W} - 1 AS n FROM r), k AS (SELECT trip_id AS t, rec_id AS fix_id, row_number() OVER (PARTITION BY trip_id ORDER BY us, rec_id) - 1 AS k FROM r WHERE lat IS NOT NULL) SELECT n.rec_id, k.fix_id FROM n LEFT JOIN k ON n.trip_id = k.t AND n.n = k.k * 4")
def positional_join(s, d):
    w = F.expr("row_number() over (partition by trip_id order by ts, rec_id) - 1")
    n = base(s, d, "lat").withColumn("n", w)
    k = base(s, d, "lat").where("lat is not null").select("trip_id", F.col("rec_id").alias("fix_id"), w.alias("k"))
    return asof.positional_join(n, k, "n", "k", 4, by=TRIP).select("rec_id", "fix_id")


# Introspection and validation.
_PRES = ", ".join(
    f"coalesce(bool_or({e}), false) AS has_{g}"
    for g, e in (("gps", "lat IS NOT NULL OR lon IS NOT NULL"), ("imu", "ax IS NOT NULL OR ay IS NOT NULL OR az IS NOT NULL"), ("gyro", "gx IS NOT NULL OR gy IS NOT NULL OR gz IS NOT NULL"), ("magneto", "false"), ("obd", "speed_obd IS NOT NULL OR rpm IS NOT NULL OR odometer_m IS NOT NULL"), ("io", "ignition IS NOT NULL OR volt IS NOT NULL"))
)
_NAME = "concat_ws('+', CASE WHEN has_gps THEN 'gps' END, CASE WHEN has_imu THEN 'imu' END, CASE WHEN has_gyro THEN 'gyro' END, CASE WHEN has_obd THEN 'obd' END, CASE WHEN has_io THEN 'io' END)"
_PSEL = f"n_rows, has_gps, has_imu, has_gyro, has_magneto, has_obd, has_io, CASE WHEN {_NAME} = '' THEN 'empty' ELSE {_NAME} END AS sensor_profile, CASE WHEN has_gyro THEN 'full' WHEN has_imu THEN 'imu' ELSE 'core' END AS profile, has_gps AND NOT has_imu AS is_gps_only, has_imu AND has_gyro AS is_full_imu"
SENSORS = [*S.cols("gnss"), *S.cols("accel"), *S.cols("gyro"), *S.cols("obd"), *S.cols("io")]


@query(f"WITH {REC} SELECT {_PSEL} FROM (SELECT count(*) AS n_rows, {_PRES} FROM r)")
def sensor_presence(s, d):
    return introspect.sensor_presence(once(s, d, *SENSORS))


@query(f"WITH {REC} SELECT trip_id, {_PSEL} FROM (SELECT trip_id, count(*) AS n_rows, {_PRES} FROM r GROUP BY 1)")
def sensor_presence_by_trip(s, d):
    return introspect.sensor_presence(once(s, d, *SENSORS), TRIP)


@query(f"""WITH {REC} SELECT count(*) AS n_rows, count(*) FILTER (lat < -90 OR lat > 90) AS lat_range, count(*) FILTER (lon < -180 OR lon > 180) AS lon_range,
count(*) FILTER (heading < 0 OR heading >= 360) AS heading_range, count(*) FILTER (speed < 0) AS speed_mps_negative, count(*) FILTER (speed_obd < 0) AS speed_obd_mps_negative,
CAST(CASE WHEN count(*) FILTER (lat IS NOT NULL AND lon IS NOT NULL) = 0 THEN 1 ELSE 0 END AS BIGINT) AS no_fix, count(*) FILTER (speed > 70) AS speed_high, count(*) FILTER (speed >= 100) AS speed_impossible,
CAST(CASE WHEN bool_and(coalesce(gx, 0) = 0 AND coalesce(gy, 0) = 0 AND coalesce(gz, 0) = 0) AND bool_or(coalesce(gx, 1) = 0 OR coalesce(gy, 1) = 0 OR coalesce(gz, 1) = 0) THEN 1 ELSE 0 END AS BIGINT) AS gyro_zero_filled FROM r""")
def rule_counts_strict(s, d):
    return rule_counts(once(s, d, "lat", "lon", "heading_deg", "speed_mps", "speed_obd_mps", *S.cols("gyro")), "strict")


@query(f"WITH {REC} SELECT trip_id, count(*) AS n_rows, count(*) FILTER (lat < -90 OR lat > 90) AS lat_range, count(*) FILTER (lon < -180 OR lon > 180) AS lon_range, count(*) FILTER (speed < 0) AS speed_mps_negative FROM r GROUP BY 1")
def rule_counts_by_trip(s, d):
    return rule_counts(once(s, d, "lat", "lon", "speed_mps"), "basic", TRIP)


@query(f"WITH {REC} SELECT rec_id FROM (SELECT rec_id, us, lag(us) OVER (PARTITION BY trip_id ORDER BY rec_id) AS p FROM r) WHERE us < p")
def monotonic_violations(s, d):
    return windows.monotonic_violations(base(s, d), "ts", TRIP, ["rec_id"], strict=False).select("rec_id")


@query(f"WITH {REC}, w AS (SELECT trip_id, us - lag(us) {W} AS d FROM r), m AS (SELECT trip_id, median(d / 1e6) AS m FROM w GROUP BY 1) SELECT trip_id, round(m, 4) AS median_dt_s, round(1 / m, 3) AS rate_hz, 1 / m < 1.8 OR 1 / m > 2.2 AS off_band FROM m")
def rate_band(s, d):
    r = A.sampling_rate(base(s, d), TRIP, order=ORDER)
    return r.select("trip_id", r6("median_dt_s", 4).alias("median_dt_s"), r6("rate_hz", 3).alias("rate_hz"), ((F.col("rate_hz") < 1.8) | (F.col("rate_hz") > 2.2)).alias("off_band"))


# Windows.
@query(f"WITH {REC} SELECT rec_id, round((us - lag(us) {W}) / 1e6, 6) AS dt_s FROM r")
def dt_seconds(s, d):
    return windows.dt_seconds(base(s, d), TRIP, order=ORDER).select("rec_id", r6("dt_s").alias("dt_s"))


LOC = f"{REC}, g AS (SELECT rec_id, trip_id, us, lat, lon, lag(lat) {W} AS pa, lag(lon) {W} AS po, lag(us) {W} AS pu FROM r WHERE lat IS NOT NULL AND lon IS NOT NULL)"


def fixes(s, d):
    return frame.gnss_view(base(s, d, "lat", "lon"))


@query(f"WITH {LOC} SELECT rec_id, round(CASE WHEN us > pu THEN ({hav('pa', 'po', 'lat', 'lon')}) / ((us - pu) / 1e6) END, 3) AS speed_from_pos FROM g")
def speed_from_pos(s, d):
    return windows.speed_from_positions(fixes(s, d), TRIP, order=ORDER).select("rec_id", r6("speed_from_pos", 3).alias("speed_from_pos"))


@query(f"WITH {LOC} SELECT rec_id, round(CASE WHEN us > pu THEN least(greatest(({hav('pa', 'po', 'lat', 'lon')}) / ((us - pu) / 1e6), 0), 80) END, 2) AS speed FROM g")
def speed_clipped(s, d):
    return windows.speed_from_positions(fixes(s, d), TRIP, order=ORDER, cap=80.0, out="speed").select("rec_id", r6("speed", 2).alias("speed"))


@query(f"WITH {LOC} SELECT rec_id, round({hav('pa', 'po', 'lat', 'lon')}, 3) AS dist_m FROM g")
def step_distance(s, d):
    return windows.step_distance(fixes(s, d), TRIP, ORDER).select("rec_id", r6("dist_m", 3).alias("dist_m"))


_Y = "sin(radians(lon - po)) * cos(radians(lat))"
_X = "cos(radians(pa)) * sin(radians(lat)) - sin(radians(pa)) * cos(radians(lat)) * cos(radians(lon - po))"


@query(f"WITH {LOC} SELECT rec_id, round(degrees(atan2({_Y}, {_X})) + CASE WHEN degrees(atan2({_Y}, {_X})) < 0 THEN 360 ELSE 0 END, 2) AS heading FROM g WHERE lat <> pa OR lon <> po")
def heading_from_pos(s, d):
    x = windows.heading_from_positions(fixes(s, d), TRIP, ORDER, "heading").withColumn("pa", F.expr("lag(lat) over (partition by trip_id order by ts, rec_id)")).withColumn("po", F.expr("lag(lon) over (partition by trip_id order by ts, rec_id)"))
    return x.where("lat <> pa or lon <> po").select("rec_id", r6("heading", 2).alias("heading"))


@query(f"WITH {REC} SELECT rec_id, n = 1 OR hdop IS DISTINCT FROM p AS changed FROM (SELECT rec_id, hdop, lag(hdop) {W} AS p, row_number() {W} AS n FROM r)")
def change_flag(s, d):
    return windows.changed(base(s, d, "hdop"), "hdop", TRIP, ORDER).select("rec_id", "changed")


@query(f"WITH {REC}, x AS (SELECT rec_id, speed, stddev_samp({NORM}) OVER (PARTITION BY trip_id ORDER BY us RANGE BETWEEN 2000000 PRECEDING AND CURRENT ROW) AS sd FROM r) SELECT rec_id, coalesce(speed < 0.5, false) OR coalesce(sd < 0.3, false) AS at_rest FROM x")
def rest_window(s, d):
    return windows.rest_flag(base(s, d, "speed_mps", *S.cols("accel")), TRIP).select("rec_id", "at_rest")


@query(f"WITH {REC} SELECT rec_id, round((us - min(us) OVER (PARTITION BY trip_id)) / 1e6, 6) AS elapsed_s FROM r")
def elapsed_time(s, d):
    return windows.elapsed(base(s, d), TRIP).select("rec_id", r6("elapsed_s").alias("elapsed_s"))


@query(f"""WITH {REC}, f AS (SELECT *, CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN us END AS t FROM r),
w AS (SELECT *, last_value(t IGNORE NULLS) OVER a AS t0, last_value(CASE WHEN t IS NOT NULL THEN lat END IGNORE NULLS) OVER a AS a0, first_value(t IGNORE NULLS) OVER b AS t1, first_value(CASE WHEN t IS NOT NULL THEN lat END IGNORE NULLS) OVER b AS a1
 FROM f WINDOW a AS (PARTITION BY trip_id ORDER BY us, rec_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY trip_id ORDER BY us, rec_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT rec_id, round(CASE WHEN t IS NOT NULL THEN lat WHEN t1 > t0 THEN a0 + (us - t0) / CAST(t1 - t0 AS DOUBLE) * (a1 - a0) END, 6) AS lat, t IS NULL AND t0 IS NOT NULL AND t1 IS NOT NULL AS interpolated FROM w""")
def gps_upsample(s, d):
    return windows.upsample_positions(base(s, d, "lat", "lon"), TRIP, order=ORDER).select("rec_id", r6("lat").alias("lat"), "interpolated")


@query(f"WITH {REC} SELECT rec_id, round(CASE WHEN us > pu THEN (ax - pax) / ((us - pu) / 1e6) END, 4) AS jerk FROM (SELECT rec_id, us, ax, lag(us) {W} AS pu, lag(ax) {W} AS pax FROM r)")
def jerk(s, d):
    return windows.derivative(base(s, d, "ax_mps2"), "ax_mps2", TRIP, order=ORDER, out="jerk").select("rec_id", r6("jerk", 4).alias("jerk"))


@query(f"WITH {REC}, h AS (SELECT rec_id, us, heading, lag(us) {W} AS pu, lag(heading) {W} AS ph FROM r WHERE heading IS NOT NULL), t AS (SELECT rec_id, us, pu, heading - ph + 180 AS x FROM h) SELECT rec_id, round(CASE WHEN us > pu THEN (x - 360 * floor(x / 360) - 180) / ((us - pu) / 1e6) END, 3) AS yaw_rate_deg_s FROM t")
def yaw_rate(s, d):
    return windows.yaw_rate(base(s, d, "heading_deg").where("heading_deg is not null"), TRIP, order=ORDER).select("rec_id", r6("yaw_rate_deg_s", 3).alias("yaw_rate_deg_s"))


@query(f"WITH {REC}, w AS (SELECT rec_id, trip_id, (us - lag(us) {W}) / 1e6 AS d FROM r), m AS (SELECT trip_id, median(d) AS m FROM w GROUP BY 1) SELECT rec_id FROM w JOIN m USING (trip_id) WHERE abs(d - m) > 0.5 * m")
def irregular_intervals(s, d):
    return windows.interval_deviation(base(s, d), TRIP, order=ORDER).where("irregular").select("rec_id")


@query(f"WITH {REC}, g AS (SELECT trip_id, us, rec_id, CASE WHEN (us - lag(us) {W}) / 1e6 > 3 OR lag(us) {W} IS NULL THEN 1 ELSE 0 END AS n FROM r), b AS (SELECT trip_id, us, CAST(sum(n) {W} AS BIGINT) AS burst_no FROM g) SELECT trip_id, burst_no, count(*) AS n_frames, min(us) AS start_us, max(us) AS end_us FROM b GROUP BY 1, 2")
def bursts(s, d):
    return windows.bursts(base(s, d), TRIP, 3.0, order=ORDER).select("trip_id", "burst_no", "n_frames", us("start_ts").alias("start_us"), us("end_ts").alias("end_us"))


STOPS = f"""v AS (SELECT trip_id, us, rec_id, speed < 0.3 AS c FROM r WHERE speed IS NOT NULL), u AS (SELECT *, CASE WHEN c AND NOT coalesce(lag(c) {W}, false) THEN 1 ELSE 0 END AS f FROM v),
i AS (SELECT *, sum(f) {W} AS i FROM u), st AS (SELECT trip_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n_rows FROM i WHERE c GROUP BY trip_id, i HAVING max(us) - min(us) >= 5000000)"""


@query(f"WITH {REC}, {STOPS} SELECT trip_id, start_us, end_us, n_rows FROM st")
def stop_runs(s, d):
    x = windows.runs(base(s, d, "speed_mps").where("speed_mps is not null"), F.col("speed_mps") < 0.3, TRIP, "ts", ORDER, 5.0)
    return x.select("trip_id", us("start_ts").alias("start_us"), us("end_ts").alias("end_us"), "n_rows")


_CURVES = f"""{LOC}, w AS (SELECT *, lead(lat) OVER x AS na, lead(lon) OVER x AS no FROM g WINDOW x AS (PARTITION BY trip_id ORDER BY us, rec_id)),
m AS (SELECT rec_id, (lon - po) * kx AS ax, (lat - pa) * ky AS ay, (no - lon) * kx AS bx, (na - lat) * ky AS b2 FROM (SELECT *, cos(radians(lat)) * radians(1) * 6371000 AS kx, radians(1) * 6371000 AS ky FROM w)),
k AS (SELECT rec_id, 2 * (ax * b2 - ay * bx) AS c, sqrt(ax*ax + ay*ay) * sqrt(bx*bx + b2*b2) * sqrt((ax+bx)*(ax+bx) + (ay+b2)*(ay+b2)) AS n FROM m), q AS (SELECT CASE WHEN n <> 0 THEN abs(c / n) END AS c FROM k)"""


@query(f"WITH {_CURVES} SELECT CASE WHEN c IS NULL THEN NULL WHEN c > 1 / 25.0 THEN 'hairpin' WHEN c > 1 / 75.0 THEN 'sharp' WHEN c > 1 / 200.0 THEN 'moderate' WHEN c > 1 / 1000.0 THEN 'gentle' ELSE 'straight' END AS curve_class, count(*) AS n FROM q GROUP BY 1")
def curve_classes(s, d):
    return windows.curve_radius(fixes(s, d), TRIP, ORDER).groupBy("curve_class").agg(F.count("*").alias("n"))


# Aggregations.
@query(f"WITH {REC} SELECT trip_id, epoch_us(date_trunc('minute', ts)) AS minute_us, round(avg(speed), 5) AS avg_speed_mps, count(*) AS n_rows FROM r GROUP BY 1, 2")
def minute_rollup(s, d):
    m = A.minute_rollup(once(s, d, "speed_mps"), TRIP)
    return m.select("trip_id", us("minute").alias("minute_us"), r6("avg_speed_mps", 5).alias("avg_speed_mps"), "n_rows")


@query(f"WITH {REC} SELECT trip_id, count(*) AS n_rows FROM r GROUP BY 1 ORDER BY n_rows DESC, trip_id LIMIT 5")
def top_n_trips(s, d):
    return frame.top_keys(once(s, d), "trip_id", 5)


@query(f"WITH {REC} SELECT rec_id FROM r WHERE trip_id IN (SELECT trip_id FROM r GROUP BY 1 HAVING count(*) >= 300)")
def long_trips_only(s, d):
    return frame.at_least(once(s, d), "trip_id", 300).select("rec_id")


def real(f: str) -> str:
    """SQL of a column whose NaN is null, as every source of the engine has it."""
    return f"CASE WHEN NOT isnan({f}) THEN {f} END" if f in ("lat", "lon") else f


_FIELDS = ["ts", "lat", "lon", "speed_mps", "heading_deg", "altitude_gps_m", "hdop", "ax_mps2", "gx_rad_s", "mx_uT", "device_id"]


@query(" UNION ALL ".join(f"SELECT '{f}' AS field, " + ("0.0" if f == "mx_uT" else f"round(avg(CASE WHEN {f} IS NOT NULL THEN 1.0 ELSE 0.0 END), 6)") + " AS coverage FROM " + ("(SELECT 1)" if f == "mx_uT" else "(SELECT rec_id, any_value(" + real(f) + ") AS " + f + " FROM records GROUP BY 1)") for f in _FIELDS))
def completeness(s, d):
    return A.completeness(once(s, d, *[f for f in _FIELDS if f not in ("mx_uT", "ts")]), _FIELDS).withColumn("coverage", r6("coverage"))


@query("WITH b AS (SELECT rec_id, " + ", ".join(f"any_value({real(f)}) AS {f}" for f in _FIELDS if f != "mx_uT") + " FROM records GROUP BY 1) SELECT round(100 * (" + " + ".join(f"avg(CASE WHEN {f} IS NOT NULL THEN 1.0 ELSE 0.0 END)" for f in _FIELDS if f != "mx_uT") + f") / {len(_FIELDS)}, 4) AS score_pct, CAST(1 AS BIGINT) AS n_empty FROM b")
def completeness_score(s, d):
    return A.completeness_score(once(s, d, *[f for f in _FIELDS if f not in ("mx_uT", "ts")]), _FIELDS).withColumn("score_pct", r6("score_pct", 4))


@query(f"WITH {REC} SELECT trip_id, round(100 * avg(CASE WHEN lat IS NOT NULL THEN 1.0 ELSE 0.0 END), 5) AS coverage_pct FROM r GROUP BY 1")
def gps_coverage(s, d):
    return A.coverage_pct(once(s, d, "lat"), "lat", TRIP).withColumn("coverage_pct", r6("coverage_pct", 5))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def label_histogram(s, d):
    return A.histogram(table(s, d, "events"), "event_type")


@query(f"WITH {LOC} SELECT trip_id, round(coalesce(sum({hav('pa', 'po', 'lat', 'lon', 6371.0088)}), 0), 5) AS distance_km, round((max(us) - min(us)) / 1e6, 6) AS duration_s, count(*) AS n_points FROM g GROUP BY 1")
def trip_distance(s, d):
    t = A.trip_distance(base(s, d, "lat", "lon"), TRIP, ORDER)
    return t.select("trip_id", r6("distance_km", 5).alias("distance_km"), r6("duration_s").alias("duration_s"), "n_points")


@query(f"WITH {REC} SELECT trip_id, count(*) AS n_records, count(lat) AS n_gps, count(ax) AS n_imu, count(gx) AS n_gyro, count(speed_obd) AS n_obd FROM r GROUP BY 1")
def trip_summary(s, d):
    return A.sensor_counts(once(s, d, "lat", "ax_mps2", "gx_rad_s", "speed_obd_mps"), TRIP)


@query(f"WITH {REC}, g AS (SELECT trip_id, us, lat, lon, lag(lat) {W} AS pa, lag(lon) {W} AS po FROM r WHERE lat IS NOT NULL AND lon IS NOT NULL), t AS (SELECT trip_id, max(us) - min(us) AS d FROM r GROUP BY 1) SELECT (SELECT count(DISTINCT device_id) FROM r) AS n_devices, (SELECT count(*) FROM t) AS n_trips, (SELECT count(*) FROM r) AS n_messages, (SELECT round(sum({hav('pa', 'po', 'lat', 'lon', 6371.0088)}), 2) FROM g) AS distance_km, (SELECT round(sum(d) / 3.6e9, 5) FROM t) AS duration_hours")
def volume(s, d):
    v = A.volume(base(s, d, "device_id", "lat", "lon"), ORDER)
    return v.select("n_devices", "n_trips", "n_messages", r6("distance_km", 2).alias("distance_km"), r6("duration_hours", 5).alias("duration_hours"))


@query(f"WITH {REC} SELECT trip_id, round(m, 5) AS mean_norm, CASE WHEN m > 8 THEN 'raw' WHEN m < 2 THEN 'compensated' WHEN m IS NOT NULL THEN 'partial' END AS acc_frame FROM (SELECT trip_id, avg({NORM}) AS m FROM r GROUP BY 1)")
def acc_frame_detect(s, d):
    return A.acc_frame(once(s, d, *S.cols("accel")), TRIP).withColumn("mean_norm", r6("mean_norm", 5))


@query(f"WITH {REC}, x AS (SELECT trip_id, {NORM} AS n, speed, stddev_samp({NORM}) OVER (PARTITION BY trip_id ORDER BY us RANGE BETWEEN 2000000 PRECEDING AND CURRENT ROW) AS sd FROM r) SELECT trip_id, round(avg(n), 5) AS rest_norm, count(n) AS n_rest FROM x WHERE coalesce(speed < 0.5, false) OR coalesce(sd < 0.3, false) GROUP BY 1")
def rest_norm(s, d):
    return A.rest_norm(windows.rest_flag(base(s, d, "speed_mps", *S.cols("accel")), TRIP), TRIP).withColumn("rest_norm", r6("rest_norm", 5))


_SIG = f"""SELECT trip_id, count(*) AS n_samples, avg(CASE WHEN speed IS NULL THEN NULL WHEN speed > 1.5 THEN 1.0 ELSE 0.0 END) AS mf, max(speed) AS sm, stddev_samp({NORM}) AS sd, avg(volt) AS volt,
 min(lat) AS a, max(lat) AS b, min(lon) AS c, max(lon) AS e FROM r GROUP BY 1"""
_STATE = f"CASE WHEN coalesce(mf > 0.05, false) OR coalesce(sm > 6, false) THEN 'mounted_driving' WHEN coalesce(volt > 9, false) THEN 'mounted_idle' WHEN coalesce(sd > 0.5, false) THEN 'handheld' WHEN coalesce({hav('a', 'c', 'b', 'e')} < 15, false) THEN 'desk' WHEN volt IS NOT NULL THEN 'unplugged' ELSE 'unknown' END"


@query(f"WITH {REC}, g AS ({_SIG}) SELECT trip_id, n_samples, round(mf, 6) AS speed_moving_frac, round(sm, 5) AS speed_max, {_STATE} AS carrier_state, CASE WHEN coalesce(mf > 0.05, false) OR coalesce(sm > 6, false) OR coalesce(volt > 9, false) THEN 'high' WHEN volt IS NOT NULL THEN 'medium' ELSE 'low' END AS confidence FROM g")
def carrier_state(s, d):
    c = A.carrier_state(once(s, d, "lat", "lon", "speed_mps", "vehicle_voltage_v", *S.cols("accel")), TRIP)
    return c.select("trip_id", "n_samples", r6("speed_moving_frac").alias("speed_moving_frac"), r6("speed_max", 5).alias("speed_max"), "carrier_state", "confidence")


@query("SELECT coalesce(carrier_state, 'unknown') AS carrier_state, count(*) AS n, coalesce(carrier_state, 'unknown') IN ('mounted_driving', 'mounted_idle') AS is_vehicle_data FROM trips GROUP BY 1, 3")
def carrier_summary(s, d):
    t = table(s, d, "trips").select(F.coalesce("carrier_state", F.lit("unknown")).alias("carrier_state"))
    return A.histogram(t, "carrier_state").withColumn("is_vehicle_data", F.col("carrier_state").isin("mounted_driving", "mounted_idle"))


# Events layer.
_AZD = f"e0 AS (SELECT *, abs(az - lag(az) {W}) AS azd FROM r)"
_KINDS = [
    ("HARSH_BRAKE", "ax < -3"), ("HARSH_ACCEL", "ax > 2.5"), ("SHARP_TURN", "abs(gz) > CAST(0.3 AS DOUBLE) OR abs(ay) > 5"), ("SPEED_BUMP", "azd >= 3 AND azd <= 5"), ("POTHOLE", "azd > 5"),
    ("CURB", "abs(ay) > 2.5 AND azd > 3"), ("DOOR_OPEN", "abs(gy) > 3 AND speed < 0.3"),
]


@query(f"WITH {REC}, {_AZD}, {STOPS} " + " UNION ALL ".join(f"SELECT trip_id, us, '{k}' AS event_type FROM e0 WHERE {c}" for k, c in _KINDS) + " UNION ALL SELECT trip_id, start_us, 'STOP' FROM st")
def event_rules(s, d):
    e = events_layer.event_table(base(s, d, "speed_mps", *S.cols("accel"), *S.cols("gyro")), TRIP, ORDER)
    return e.select("trip_id", us().alias("us"), "event_type")


def _uniform(n: int) -> str:
    return f"(CAST('0x' || substr(sha256(rec_id || '|7.{n}'), 1, 12) AS BIGINT) + 0.5) / 281474976710656"


@query(f"WITH {REC}, l AS (SELECT rec_id, lag(ax) {W} + 0.001 * (us - min(us) OVER (PARTITION BY trip_id)) / 1e6 + 0.05 * sqrt(-2 * ln({_uniform(1)})) * cos(2 * pi() * {_uniform(2)}) AS x FROM r) SELECT rec_id, round(round_even(x / 0.01, 0) * 0.01, 2) + 0 AS noisy FROM l WHERE abs(x / 0.01 - floor(x / 0.01) - 0.5) > 1e-6 OR x IS NULL")
def noise_model(s, d):
    r = base(s, d, "ax_mps2")
    n = events_layer.add_noise(r, "ax_mps2", 0.05, 7, bias_per_s=0.001, delay=1, by=TRIP, ts="ts", out="x", key=["rec_id"])
    x = F.col("x") / 0.01
    # Values between two quanta may fall to either.
    n = n.where((F.abs(x - F.floor(x) - 0.5) > 1e-6) | F.col("x").isNull())
    return n.select("rec_id", (F.round(F.bround(x) * 0.01, 2) + 0.0).alias("noisy"))


# Scalars.
@query("SELECT obd_id, CASE WHEN obd_pid = '0D' THEN round(TRY_CAST(raw_value AS DOUBLE) / 3.6, 6) END AS speed_mps, round(TRY_CAST(raw_value AS DOUBLE) * 0.44704, 6) AS mph_as_mps FROM (SELECT DISTINCT obd_id, trip_id, ts, obd_pid, raw_value FROM obd_points)")
def unit_conversions(s, d):
    o = table(s, d, "obd_points").distinct()
    return o.select("obd_id", F.when(F.col("obd_pid") == "0D", r6(scalars.kmh_to_mps(F.col("raw_value")))).alias("speed_mps"), r6(scalars.mph_to_mps(F.col("raw_value"))).alias("mph_as_mps"))


@query("SELECT event_id, round(trunc(v / 100) + (v - 100 * trunc(v / 100)) / 60, 8) AS degrees FROM (SELECT event_id, value * 20 - 5000 AS v FROM events)")
def nmea_degrees(s, d):
    return table(s, d, "events").select("event_id", r6(geo.nmea_to_degrees(F.col("value") * 20 - 5000), 8).alias("degrees"))


@query("SELECT event_id, epoch_us(ts) AS from_s, epoch_us(ts) AS from_ns, epoch_us(ts) * 1000 AS ns FROM events")
def clock_units(s, d):
    u = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(s, d, "events").select("event_id", u.alias("u"))
    return e.select("event_id", us_of(scalars.epoch_to_ts(F.col("u").cast("decimal(30,6)") / 1000000, "s")).alias("from_s"), us_of(scalars.epoch_to_ts(F.col("u") * 1000, "ns")).alias("from_ns"), scalars.ts_to_ns(F.timestamp_micros("u")).alias("ns"))


def us_of(c: Column) -> Column:
    return F.unix_micros(c)


@query("SELECT event_id, round(least(greatest(value, 50), 80), 6) AS clipped, round(CASE WHEN event_id % 3 = 0 THEN 0 ELSE least(value, 50) END, 6) AS filled FROM events")
def clips(s, d):
    e = table(s, d, "events").select("event_id", "value", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("gappy"))
    return e.select("event_id", r6(scalars.clip(F.col("value"), 50.0, 80.0)).alias("clipped"), r6(scalars.clip_filled(F.col("gappy"), 0.0, 50.0)).alias("filled"))


@query("SELECT s_suppkey, replace(trim(s_name), ' ', '_') AS slug, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS padded, starts_with(s_name, 'Supp') AS is_supp FROM supplier")
def text_normal(s, d):
    t = table(s, d, "supplier")
    return t.select("s_suppkey", scalars.slug(F.col("s_name")).alias("slug"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("padded"), F.startswith("s_name", F.lit("Supp")).alias("is_supp"))


@query(f"WITH {REC} SELECT rec_id, round({NORM}, 5) AS norm FROM r")
def accel_norm(s, d):
    n = scalars.norm3(*(F.col(c).cast("double") for c in S.cols("accel")))
    return once(s, d, *S.cols("accel")).select("rec_id", r6(n, 5).alias("norm"))


@query("SELECT event_id, round(" + hav("45 + (event_id % 1000) * 1e-4", "5 + (event_id * 7 % 1000) * 1e-4", "45", "5") + ", 4) AS metres FROM events")
def sql_functions(s, d):
    scalars.register_sql(s)
    e = table(s, d, "events").select("event_id", (45 + F.col("event_id") % 1000 * 1e-4).alias("lat"), (5 + F.col("event_id") * 7 % 1000 * 1e-4).alias("lon"))
    return e.selectExpr("event_id", "round(haversine_m(lat, lon, 45D, 5D), 4) AS metres")


# Spark's own operators that the catalogue lists without a counterpart, over the star tables.
@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing_summary(s, d):
    li = table(s, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def nation_revenue(s, d):
    t = lambda n: table(s, d, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def customers_without_orders(s, d):
    return table(s, d, "customer").join(table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers, GROUPING(o_orderstatus) AS gs, GROUPING(o_orderpriority) AS gp FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def order_cube(s, d):
    return table(s, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"), F.grouping("o_orderstatus").cast("long").alias("gs"), F.grouping("o_orderpriority").cast("long").alias("gp"))


@query("SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) WHERE k <= 3")
def top_parts_per_brand(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(s, d, "part").withColumn("k", F.row_number().over(w)).where("k <= 3").select("p_brand", "p_partkey")


@query("SELECT user_id, count(*) AS n, min(ts_us) AS start_us FROM (SELECT user_id, ts_us, sum(f) OVER (PARTITION BY user_id ORDER BY ts_us) AS i FROM (SELECT user_id, epoch_us(ts) AS ts_us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 7200000000 THEN 0 ELSE 1 END AS f FROM events)) GROUP BY user_id, i")
def user_sessions(s, d):
    g = table(s, d, "events").groupBy("user_id", F.session_window("ts", "2 hours")).agg(F.count("*").alias("n"), F.min("ts").alias("t"))
    return g.select("user_id", "n", F.unix_micros(F.col("t").cast("timestamp")).alias("start_us"))
