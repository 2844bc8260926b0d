"""Queries of readers, writers, adapters, validators and manifests over the test tables, each beside its SQL twin.

What these operators read is first written by the engine's own writers into the shared scratch folder.
"""

from __future__ import annotations

import json
from pathlib import Path

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadgrain import manifest as M
from roadgrain import schema as S
from roadgrain import validate as V
from roadgrain.adapters import load, sources
from roadgrain.functions import scalars
from roadgrain.operators import asof, events_layer, frame, position, windows
from roadgrain.plans.reference import LOC, NORM, ORDER, REC, TRIP, base, fixes, hav, once, query, r6
from roadgrain.session import scratch
from roadgrain.sources import readers, sinks, table


def ts_us(c: str = "ts"):
    return F.unix_micros(c)


def dataset(s, parts: dict[str, DataFrame], **meta) -> Path:
    """A folder with the frames as Parquet and their manifest; returns the manifest's path."""
    d = scratch(s)
    for name, df in parts.items():
        sinks.write_zstd(df, d / f"{name}.parquet")
    (d / "manifest.yaml").write_text(yaml.safe_dump({"dataset_id": "test", **meta}))
    return d / "manifest.yaml"


def one_file(df: DataFrame, path: Path) -> None:
    """A frame as one CSV file of that name, as the sources have it."""
    sinks.write_csv(df.coalesce(1), path.with_suffix(".parts"))
    next(path.with_suffix(".parts").glob("part-*.csv")).rename(path)


# Readers and writers.
@query("SELECT rec_id, epoch_us(ts) AS us, CASE WHEN NOT isnan(lat) THEN round(lat, 6) END AS lat FROM records")
def parquet_file(s, d):
    p = scratch(s) / "records.parquet"
    sinks.write_parquet(table(s, d, "records").select("rec_id", "ts", "lat"), p)
    return readers.read(s, p).select("rec_id", ts_us().alias("us"), r6("lat").alias("lat"))


@query("SELECT rec_id, epoch_us(ts) AS us FROM records")
def nanosecond_clock(s, d):
    p = scratch(s) / "ns.parquet"
    sinks.write_zstd(table(s, d, "records").select("rec_id", scalars.ts_to_ns(F.col("ts")).alias("ts")), p)
    return readers.read_parquet(s, p, ["rec_id", "ts"]).select("rec_id", ts_us().alias("us"))


@query("SELECT obd_id, trip_id, epoch_us(ts) AS us FROM obd_points")
def csv_file(s, d):
    p = scratch(s) / "obd"
    sinks.write_csv(table(s, d, "obd_points").select("obd_id", "trip_id", F.col("ts").alias("timestamp")), p)
    return readers.read_csv(s, p, "obd_id long, trip_id string, timestamp string").select("obd_id", "trip_id", ts_us("timestamp").alias("us"))


@query("SELECT trip_id, device_id AS \"who.device\", epoch_us(started_at) AS \"when.us\" FROM trips")
def json_lines(s, d):
    p = scratch(s) / "trips"
    t = table(s, d, "trips").select("trip_id", F.struct(F.col("device_id").alias("device")).alias("who"), F.struct(ts_us("started_at").alias("us")).alias("when"))
    sinks.write_jsonl(t, p)
    return readers.RecordSet.from_jsonl(s, p).df.select("trip_id", "`who.device`", "`when.us`")


@query("SELECT n_nationkey AS key, n_name AS vehicle_id, CAST(n_nationkey AS DOUBLE) AS lat FROM nation")
def json_folder(s, d):
    """Whole documents and lines of one folder, merged into Parquet."""
    f = scratch(s)
    docs = [{"timestamp": "2021-01-04T00:00:00Z", "vehicle_id": r["n_name"], "position": {"lat": float(r["n_nationkey"]), "lon": 1.0}, "key": r["n_nationkey"]} for r in table(s, d, "nation").toLocalIterator()]
    (f / "one.json").write_text(json.dumps(docs[0], indent=1))
    (f / "rest.jsonl").write_text("\n".join(map(json.dumps, docs[1:])))
    sinks.json_dir_to_parquet(s, f, f / "all.parquet")
    return s.read.parquet(str(f / "all.parquet")).select("key", "vehicle_id", F.col("`position.lat`").alias("lat"))


@query("SELECT event_id, round(value, 3) AS value, CAST(NULL AS DOUBLE) AS absent FROM events")
def blank_separated_text(s, d):
    p = scratch(s) / "text"
    table(s, d, "events").select(F.concat(F.lit("  "), F.col("event_id").cast("string"), F.lit("   "), F.round("value", 3).cast("string")).alias("value")).write.text(str(p))
    t = readers.read_columns_text(s, p, ["event_id", "value", "absent"])
    return t.select(F.col("event_id").cast("long").alias("event_id"), F.round("value", 3).alias("value"), "absent")


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def manifest_read(s, d):
    """Data files of a manifest as one frame; a listed file that isn't there is skipped."""
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus")
    m = dataset(s, {"a": o.where("o_orderstatus = 'F'"), "b": o.where("o_orderstatus <> 'F'")}, data_files=[{"path": f"{x}.parquet"} for x in "abc"])
    return readers.read(s, m)


@query("SELECT t.trip_id, t.device_id, n.n_name FROM trips t, nation n WHERE n.n_nationkey = 3")
def dataset_tables(s, d):
    """Tables of a checked manifest, pruned to the columns asked for."""
    m = dataset(s, {"trips": table(s, d, "trips"), "nation": table(s, d, "nation")}, tables={"trips": "trips.parquet", "nation": "nation.parquet"})
    t = readers.Dataset.from_path(m.parent).read(s, "trips", ["trip_id", "device_id"])
    return t.join(F.broadcast(readers.load_dataset(s, m)["nation"].where("n_nationkey = 3").select("n_name")), how="inner", on=F.lit(True))


@query("SELECT 'trips' AS name, count(*) AS n_rows, CAST(7 AS BIGINT) AS n_columns FROM trips UNION ALL SELECT 'nation', count(*), 4 FROM nation")
def dataset_footers(s, d):
    """Rows and columns from the files' footers alone."""
    n = table(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey", F.lit("").alias("note"))
    m = dataset(s, {"trips": table(s, d, "trips"), "nation": n}, tables={"trips": "trips.parquet", "nation": "nation.parquet"})
    rows = [x.replace(",", "").split() for x in readers.Dataset.from_path(m).describe().splitlines()[1:]]
    return s.createDataFrame([(r[0].rstrip(":"), int(r[1]), int(r[3])) for r in rows], "name string, n_rows long, n_columns long")


@query("SELECT count(*) AS n_rows, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM records")
def dataset_summary(s, d):
    m = dataset(s, {"records": table(s, d, "records").select("ts", "rec_id")}, tables={"records": "records.parquet"})
    x = readers.Dataset.from_path(m).summary(s)["records"]
    one = s.createDataFrame([(x["rows"], x["time_min"], x["time_max"])], "n_rows long, a string, z string")
    return one.select("n_rows", F.unix_micros(F.to_timestamp("a")).alias("first_us"), F.unix_micros(F.to_timestamp("z")).alias("last_us"))


@query(f"WITH {REC} SELECT trip_id, count(*) AS n_records, count(lat) AS n_gps, count(ax) AS n_imu, count(gx) AS n_gyro, count(speed_obd) AS n_obd FROM r WHERE trip_id IS NOT NULL GROUP BY 1")
def trips_written(s, d):
    """Files per trip and the sensors' counts beside them, read back."""
    f = scratch(s)
    sinks.write_trips(base(s, d, "lat", "ax_mps2", "gx_rad_s", "speed_obd_mps").where("trip_id is not null"), f / "data", f / "counts")
    n = s.read.parquet(str(f / "data")).groupBy(F.col("trip_id").alias("t")).agg(F.count("*").alias("n"))
    c = readers.read_jsonl(s, f / "counts")
    return c.join(n, (F.col("trip_id") == F.col("t")) & (F.col("n") == F.col("n_records"))).select("trip_id", "n_records", "n_gps", "n_imu", "n_gyro", "n_obd")


@query("SELECT event_id * 1000000 AS timestamp_ns, CAST(event_id % 90 AS DOUBLE) AS lat, CAST(NULL AS FLOAT) AS alt, CAST(event_id % 50 AS DOUBLE) AS speed_mps FROM events")
def simulator_export(s, d):
    """Simulator CSVs as the three legacy tables with their manifest."""
    f, e = scratch(s), table(s, d, "events")
    sinks.write_csv(e.select((F.col("event_id") * 1000000).alias("timestamp_ns"), (F.col("event_id") % 90).alias("lat"), (F.col("event_id") % 180).alias("lon"), (F.col("event_id") % 50).alias("speed")), f / "trajectory")
    sinks.write_csv(e.select((F.col("event_id") * 1000000).alias("timestamp_ns"), *[F.lit(0.5).alias(f"{k}_{a}") for k in ("acc", "gyro") for a in "xyz"]), f / "imu")
    t = readers.load_dataset(s, sinks.export_tables(s, f / "trajectory", f / "imu", f / "out"))
    assert set(t) == {"trajectory", "imu", "events"}
    return readers.read_table(s, f / "out" / "dataset.yaml", "trajectory").select("timestamp_ns", "lat", "alt", F.col("speed_mps").cast("double").alias("speed_mps"))


# Adapters.
def _located(s, d) -> DataFrame:
    r = base(s, d, "lat", "lon", "ax_mps2", "ay_mps2", "az_mps2", "gx_rad_s", "gy_rad_s", "gz_rad_s")
    return r.where("trip_id is not null and lat is not null and lon is not null and ax_mps2 is not null and ay_mps2 is not null and az_mps2 is not null")


_LOCATED = f"{REC}, q AS (SELECT * FROM r WHERE trip_id IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL AND ax IS NOT NULL AND ay IS NOT NULL AND az IS NOT NULL)"


@query(f"WITH {_LOCATED} SELECT trip_id, us, round(CAST(CAST(ax * 9.80665 AS FLOAT) AS DOUBLE), 3) AS ax, round(trunc(lat) + (lat - trunc(lat)) * 100 / 60, 9) AS lat FROM q")
def adapter_aegis(s, d):
    """All trips, joins inside trips; every reading has its own fix, whose degrees and minutes are the record's digits."""
    f, r = scratch(s), _located(s, d)
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp")
    sinks.write_csv(r.select("trip_id", stamp, *[F.col(f"a{c}_mps2").cast("double").alias(f"{c}_value") for c in "xyz"]), f / "accelerations.csv")
    sinks.write_csv(r.select("trip_id", stamp, (F.col("lat") * 100).alias("latitude"), (F.col("lon") * 100).alias("longitude"), F.lit(1.0).alias("altitude")), f / "positions.csv")
    sinks.write_csv(r.select("trip_id", F.lit("b").alias("beaglebone_id")).distinct(), f / "trips.csv")
    a = load("aegis", s, str(f), top_n_trips=None, by_trip=True, tolerances_ms={"gps": 600})
    return a.select("trip_id", ts_us().alias("us"), r6("ax_mps2", 3).alias("ax"), r6("lat", 9).alias("lat"))


@query(f"WITH {_LOCATED} SELECT us, round(ax, 4) AS ax, round(lat, 6) AS lat, 'c_one' AS trip_id FROM q WHERE us IN (SELECT us FROM q GROUP BY us HAVING count(*) = 1)")
def adapter_stride(s, d):
    f, r = scratch(s) / "c" / "one", _located(s, d)
    one = r.groupBy(ts_us().alias("us")).agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("ax_mps2", "ay_mps2", "az_mps2", "lat", "lon")]).where("n = 1").withColumn("time", F.col("us") * 1000)
    one_file(one.select("time", F.col("ax_mps2").alias("x"), F.col("ay_mps2").alias("y"), F.col("az_mps2").alias("z")), f / "TotalAcceleration.csv")
    one_file(one.select("time", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.lit(1.5).alias("speed")), f / "Location.csv")
    return load("stride", s, str(f.parent.parent), with_gyro=False).select(ts_us().alias("us"), r6("ax_mps2", 4).alias("ax"), r6("lat").alias("lat"), "trip_id")


@query(f"WITH {_LOCATED}, n AS (SELECT *, row_number() OVER (ORDER BY rec_id) - 1 AS n FROM q) SELECT us, round(ay, 4) AS ay, round(radians(gx), 7) + 0 AS gx, round(lat, 6) AS lat, CASE WHEN n % 3 = 0 THEN 50.0 ELSE 7.5 END AS speed, CASE n % 4 WHEN 0 THEN 'dirt' WHEN 1 THEN 'asphalt' ELSE 'unknown' END AS road_surface, 'PVS_3' AS trip_id FROM n")
def adapter_pvs(s, d):
    """One folder of the source; labels stand beside the readings, line by line."""
    f = scratch(s)
    r = position.numbered(_located(s, d), "n", ["rec_id"]).repartition(1).sortWithinPartitions("rec_id")
    acc = [F.col(f"a{c}_mps2").cast("double").alias(f"acc_{c}_dashboard") for c in "xyz"]
    gyro = [F.col(f"g{c}_rad_s").cast("double").alias(f"gyro_{c}_dashboard") for c in "xyz"]
    mag = [F.lit(1.0).alias(f"mag_{c}_dashboard") for c in "xyz"]
    clock = F.format_string("%d.%06d", F.floor(ts_us() / 1000000), F.pmod(ts_us(), F.lit(1000000))).alias("timestamp")
    speed = F.when(F.col("n") % 3 == 0, 70.0).otherwise(7.5).alias("speed")
    one_file(r.select(clock, *acc, *gyro, *mag, F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), speed, F.col("n").alias("timestamp_gps")), f / "PVS 3" / "dataset_gps_mpu_left.csv")
    one_file(r.select((F.col("n") % 4 == 0).cast("int").alias("dirt_road"), (F.col("n") % 4 < 2).cast("int").alias("asphalt_road")), f / "PVS 3" / "dataset_labels.csv")
    x = load("pvs", s, str(f), labels=True)
    return x.select(ts_us().alias("us"), r6("ay_mps2", 4).alias("ay"), (r6("gx_rad_s", 7) + 0.0).alias("gx"), r6("lat").alias("lat"), r6("speed_mps", 1).alias("speed"), "road_surface", "trip_id")


@query("SELECT event_id AS n, round(CAST(CAST(event_id % 7 AS DOUBLE) * 9.80665 AS FLOAT), 4) AS ax, CASE WHEN event_id % 10 = 0 AND event_id // 10 < (SELECT count(*) FROM events) THEN CAST(event_id // 10 % 90 AS DOUBLE) END AS lat FROM (SELECT row_number() OVER (ORDER BY event_id) - 1 AS event_id FROM events)")
def adapter_uah(s, d):
    """A synthetic clock on the accelerometer's rows; position k stands on row 10 k."""
    f, e = scratch(s) / "trip", table(s, d, "events")
    f.mkdir(parents=True)
    n = [r["n"] for r in e.agg(F.count("*").alias("n")).collect()][0]
    (f / "RAW_ACCELEROMETERS.txt").write_text("".join(f"{i / 10} 1 {i % 7} 0 1 0 0 1 0 0\n" for i in range(n)))
    (f / "RAW_GPS.txt").write_text("".join(f"{i} 36 {i % 90} 5 100 1 1 0 0 0 0\n" for i in range(n)))
    x = load("uah-driveset", s, str(f.parent))
    return x.select(((ts_us() - 1420070400000000) / 100000).cast("long").alias("n"), r6("ax_mps2", 4).alias("ax"), "lat")


@query("SELECT event_id, round(CAST(event_id % 40 AS DOUBLE), 3) AS speed_mps, CAST(event_id % 3 AS VARCHAR) AS x_sim_event, 'sim' AS trip_id FROM events")
def adapter_simulated(s, d):
    f = scratch(s) / "samples.csv"
    e = table(s, d, "events").select(F.date_format(F.timestamp_micros(F.col("event_id") * 100000), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"), (F.col("event_id") % 40).alias("speed"), (F.col("event_id") % 3).alias("event"))
    sinks.write_csv(e, f)
    x = load("simulated", s, str(f))
    return x.select((ts_us() / 100000).cast("long").alias("event_id"), r6("speed_mps", 3).alias("speed_mps"), "x_sim_event", "trip_id")


@query("SELECT event_id, round(value / 3.6, 5) AS speed_mps, value AS heading_deg, event_type AS other FROM events")
def provider_units(s, d):
    e = table(s, d, "events").select("event_id", F.col("value").alias("speed"), F.col("value").alias("bearingDeg"), F.col("event_type").alias("other"))
    return sources.map_provider(e, "samsara").select("event_id", r6("speed_mps", 5).alias("speed_mps"), "heading_deg", "other")


@query("SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'speed_bump' WHEN 1 THEN 'speed_bump_cobble' WHEN 2 THEN 'cobblestone' WHEN 3 THEN 'dirt' WHEN 4 THEN 'unpaved' WHEN 5 THEN 'asphalt' WHEN 6 THEN 'speed_bump' ELSE 'unknown' END AS road_surface FROM events")
def surface_labels(s, d):
    e = table(s, d, "events").select("event_id", *[(F.col("event_id") % 8 == i).cast("int").alias(f) for i, (f, _) in enumerate(sources.SURFACES)])
    e = e.withColumns({sources.SURFACES[0][0]: F.col(sources.SURFACES[0][0]) + (F.col("event_id") % 8 == 6).cast("int"), "asphalt_road": F.col("asphalt_road") + (F.col("event_id") % 8 == 6).cast("int")})
    return e.select("event_id", frame.one_hot_label(sources.SURFACES).alias("road_surface"))


# Projections and scalars.
@query(f"WITH {REC} SELECT rec_id, us AS ts_us, round(ax, 5) AS acc_x, round(gz, 5) AS gyro_z, round(speed, 5) AS speed FROM r")
def alias_defaults(s, d):
    r = once(s, d, "ax_mps2", "gz_rad_s", "speed_mps").select("rec_id", (ts_us() / 1000.0).alias("ms"), F.col("ts").alias("time_iso"), F.col("ax_mps2").alias("imu_ax"), F.col("gz_rad_s").alias("gyroz"), F.col("speed_mps").alias("speed_m_s"))
    x = frame.resolve_aliases(r.drop("ms"))
    return x.select("rec_id", ts_us("timestamp").alias("ts_us"), r6("acc_x", 5).alias("acc_x"), r6("gyro_z", 5).alias("gyro_z"), r6("speed", 5).alias("speed"))


@query("SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events")
def alias_millis(s, d):
    e = table(s, d, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("time_ms"))
    return frame.resolve_aliases(e).select("event_id", F.unix_millis("timestamp").alias("ms"))


@query("SELECT c_custkey, 12.5 AS \"context.weather.temp_c\", 'gravel' AS \"context.topography.surface_type\" FROM customer")
def context_columns(s, d):
    c = frame.add_context(table(s, d, "customer").select("c_custkey"), "weather", {"temp_c": 12.5})
    return frame.add_context(c, "topography", {"surface_type": "gravel"})


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey * 10 END AS extra FROM supplier")
def values_by_position(s, d):
    t = table(s, d, "supplier").select("s_suppkey")
    v = t.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("pos"), (F.col("s_suppkey") * 10).alias("value"))
    return frame.with_values(t.withColumn("pos", F.col("s_suppkey")), "extra", v, "pos").select("s_suppkey", "extra")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def first_rows(s, d):
    return table(s, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query(f"WITH {REC} SELECT trip_id, count(*) AS n_rows FROM r GROUP BY 1 ORDER BY n_rows DESC, trip_id LIMIT 1")
def longest_trip(s, d):
    return frame.top_keys(once(s, d), "trip_id", 1)


@query(f"WITH {REC} SELECT rec_id FROM r WHERE ax IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")
def complete_rows(s, d):
    return once(s, d, "ax_mps2", "lat", "lon").dropna(subset=["ax_mps2", "lat", "lon"]).select("rec_id")


@query("SELECT event_id, round(CAST(value * 9.80665 AS FLOAT), 2) AS mps2, round(CAST(value * 0.00980665 AS FLOAT), 5) AS from_mg, round(radians(value), 8) AS rad, round(value * 1000, 4) AS m, round(value * 1609.344, 3) AS miles_m FROM events")
def sensor_units(s, d):
    v = F.col("value")
    return table(s, d, "events").select(
        "event_id", r6(scalars.g_to_mps2(v), 2).alias("mps2"), r6(scalars.mg_to_mps2(v), 5).alias("from_mg"), r6(scalars.deg_to_rad(v), 8).alias("rad"), r6(scalars.km_to_m(v), 4).alias("m"), r6(scalars.miles_to_m(v), 3).alias("miles_m")
    )


@query("SELECT obd_id, round(TRY_CAST(raw_value AS DOUBLE), 6) AS number, CAST(trunc(TRY_CAST(raw_value AS DOUBLE)) AS BIGINT) AS whole FROM (SELECT DISTINCT obd_id, trip_id, ts, obd_pid, raw_value FROM obd_points)")
def numbers_of_texts(s, d):
    o = table(s, d, "obd_points").distinct()
    return o.select("obd_id", r6(scalars.numeric(F.col("raw_value"))).alias("number"), scalars.numeric(F.col("raw_value"), "long").alias("whole"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS iso FROM events")
def iso_texts(s, d):
    return table(s, d, "events").select("event_id", scalars.iso(F.col("ts")).alias("iso"))


@query(f"WITH {REC} SELECT rec_id, CAST(round(sqrt(-2 * ln((CAST('0x' || substr(sha256(rec_id || '|7.1'), 1, 12) AS BIGINT) + 0.5) / 281474976710656)) * cos(2 * pi() * ((CAST('0x' || substr(sha256(rec_id || '|7.2'), 1, 12) AS BIGINT) + 0.5) / 281474976710656)), 6) AS DOUBLE) AS noise FROM r")
def seeded_noise(s, d):
    return once(s, d).select("rec_id", F.round(events_layer.gaussian(["rec_id"], 7), 6).alias("noise"))


# Joins.
@query("""WITH v AS (SELECT event_id, epoch_us(ts) AS us FROM events WHERE event_type = 'view'), o AS (SELECT event_id AS other_id, epoch_us(ts) AS us FROM events WHERE event_type <> 'view'),
b AS (SELECT v.event_id, o.other_id, v.us - o.us AS gap FROM v ASOF LEFT JOIN o ON v.us >= o.us), f AS (SELECT v.event_id, o.other_id, o.us - v.us AS gap FROM v ASOF LEFT JOIN o ON v.us <= o.us)
SELECT event_id, CASE WHEN b.gap IS NOT NULL AND (f.gap IS NULL OR b.gap <= f.gap) THEN b.other_id ELSE f.other_id END AS other_id FROM b JOIN f USING (event_id)""")
def asof_without_keys(s, d):
    e = table(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    right = e.where("event_type <> 'view'").select(F.col("event_id").alias("other_id"), "ts")
    return asof.asof_join(e.where("event_type = 'view'").select("event_id", "ts"), right, "ts").select("event_id", "other_id")


@query("SELECT a.p_partkey, b.p_partkey * 1 AS k FROM part a LEFT JOIN part b ON a.p_partkey = b.p_partkey * 4")
def positions_joined(s, d):
    p = table(s, d, "part").select("p_partkey")
    return asof.positional_join(p, p.select(F.col("p_partkey").alias("k")), "p_partkey", "k", 4)


@query("SELECT r_name, count(*) AS n FROM region JOIN nation ON n_regionkey < r_regionkey GROUP BY 1")
def theta_join(s, d):
    return table(s, d, "region").join(table(s, d, "nation"), F.col("n_regionkey") < F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("n"))


@query("SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def keys_in_both(s, d):
    return table(s, d, "orders").select(F.col("o_custkey").alias("k")).intersect(table(s, d, "customer").where("c_acctbal > 0").select("c_custkey"))


@query("SELECT l_returnflag AS k FROM lineitem EXCEPT ALL SELECT o_orderstatus FROM orders")
def rows_left_over(s, d):
    return table(s, d, "lineitem").select(F.col("l_returnflag").alias("k")).exceptAll(table(s, d, "orders").select("o_orderstatus"))


@query("SELECT o_orderpriority, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1, 2")
def counts_in_maps(s, d):
    g = table(s, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    m = g.groupBy("o_orderpriority").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "n"))).alias("m"))
    return m.select("o_orderpriority", F.explode(F.map_filter("m", lambda k, v: v > 0)).alias("status", "n"))


# Windows.
@query(f"WITH {REC} SELECT rec_id FROM (SELECT rec_id, us, lag(us) OVER (PARTITION BY trip_id ORDER BY rec_id) AS p FROM r) WHERE us <= p")
def order_in_blocks(s, d):
    return position.out_of_order(base(s, d), "ts", ["rec_id"], TRIP, strict=True).select("rec_id")


@query(f"WITH {REC} SELECT rec_id, row_number() OVER (ORDER BY rec_id) - 1 AS n FROM r")
def rows_numbered(s, d):
    return position.numbered(base(s, d), "n", ["rec_id"]).select("rec_id", "n")


@query(f"WITH {LOC}, w AS (SELECT *, lead(lat) OVER x AS na, lead(lon) OVER x AS no FROM g WINDOW x AS (PARTITION BY trip_id ORDER BY us, rec_id)), m AS (SELECT rec_id, (lon - po) * kx AS ax, (lat - pa) * ky AS ay, (no - lon) * kx AS bx, (na - lat) * ky AS by_ FROM (SELECT *, cos(radians(lat)) * radians(1) * 6371000 AS kx, radians(1) * 6371000 AS ky FROM w)), k AS (SELECT rec_id, 2 * (ax * by_ - ay * bx) AS c, sqrt(ax*ax + ay*ay) * sqrt(bx*bx + by_*by_) * sqrt((ax+bx)*(ax+bx) + (ay+by_)*(ay+by_)) AS n FROM m) SELECT rec_id, round(c / n, 4) + 0 AS curvature FROM k WHERE n > 0 AND abs(c / n) < 0.01")
def curvatures(s, d):
    x = windows.curve_radius(fixes(s, d), TRIP, ORDER)
    return x.where("abs(curvature_1_m) < 0.01").select("rec_id", (r6("curvature_1_m", 4) + 0.0).alias("curvature"))


@query(f"WITH {REC}, u AS (SELECT us, min(lat) AS lat, min(lon) AS lon FROM r WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY us HAVING count(*) = 1), g AS (SELECT us, lat, lon, lag(us) OVER (ORDER BY us) AS pu, lag(lat) OVER (ORDER BY us) AS pa, lag(lon) OVER (ORDER BY us) AS po FROM u) SELECT us, round(least(greatest(({hav('pa', 'po', 'lat', 'lon')}) / ((us - pu) / 1e6), 0), 80), 2) AS speed FROM g WHERE pu IS NOT NULL")
def speed_across_trips(s, d):
    """The derived speed over the whole frame, trips or not, in blocks of time; instants of one fix only."""
    u = fixes(s, d).groupBy("ts").agg(F.count("*").alias("n"), F.min("lat").alias("lat"), F.min("lon").alias("lon")).where("n = 1")
    x = windows.speed_from_positions(u, [], "ts", cap=80.0, out="speed")
    return x.where("speed is not null").select(ts_us().alias("us"), r6("speed", 2).alias("speed"))


# Validation.
@query(f"""WITH {REC}, o AS (SELECT trip_id, us, lag(us) OVER (PARTITION BY trip_id ORDER BY rec_id) AS p FROM r)
SELECT 'lat_range' AS rule, count(*) FILTER (lat < -90 OR lat > 90) AS n FROM r UNION ALL SELECT 'lon_range', count(*) FILTER (lon < -180 OR lon > 180) FROM r UNION ALL SELECT 'speed_mps_negative', count(*) FILTER (speed < 0) FROM r
UNION ALL SELECT 'speed_high', count(*) FILTER (speed > 70) FROM r UNION ALL SELECT 'ts_order', count(*) FILTER (us <= p) FROM o""")
def dataset_rules(s, d):
    """A written dataset validated from its manifest, order by the rows' places in the files."""
    cols = ["rec_id", "ts", "lat", "lon", "speed_mps", "device_id", "trip_id"]
    m = dataset(s, {"records": once(s, d, *cols).orderBy("rec_id")}, profile="core")
    _, data, _ = M.validate_dataset(s, m, "strict")
    return s.createDataFrame([(k, data.counts[k]) for k in ("lat_range", "lon_range", "speed_mps_negative", "speed_high", "ts_order")], "rule string, n long")


@query(f"WITH {REC}, x AS (SELECT CASE WHEN us <= 1609750800000000 THEN 0 ELSE 1 END AS period, {NORM} AS n, speed, stddev_samp({NORM}) OVER (PARTITION BY trip_id ORDER BY us RANGE BETWEEN 2000000 PRECEDING AND CURRENT ROW) AS sd FROM r), g AS (SELECT period, avg(n) AS m, count(n) AS n_rest FROM x WHERE coalesce(speed < 0.5, false) OR coalesce(sd < 0.3, false) GROUP BY 1) SELECT CAST(period AS INTEGER) AS period, CASE period WHEN 0 THEN 'raw' ELSE 'compensated' END AS frame, round(m, 5) AS rest_norm, n_rest, abs(m - CASE period WHEN 0 THEN 9.81 ELSE 0 END) > 1 AS off FROM g WHERE m IS NOT NULL")
def gravity_periods(s, d):
    cut = "2021-01-04T09:00:00Z"
    g = V.gravity_by_period(base(s, d, "speed_mps", *S.cols("accel")), [(None, cut, "raw"), (cut, "present", "compensated")], TRIP)
    return g.withColumn("rest_norm", r6("rest_norm", 5))


@query("SELECT event_id AS timestamp_ns, CAST(event_id % 90 AS DOUBLE) AS lat, CAST(event_id % 170 AS DOUBLE) AS lon, CAST(event_id % 40 AS DOUBLE) AS speed_mps FROM events")
def legacy_trajectory(s, d):
    e = F.col("event_id")
    t = table(s, d, "events").select(e.cast("string").alias("timestamp_ns"), (e % 90).alias("lat"), (e % 170).alias("lon"), (e % 40).alias("speed_mps"), e.alias("_o"))
    return V.validate_trajectory(t, order=["_o"]).select("timestamp_ns", "lat", "lon", F.col("speed_mps").cast("double").alias("speed_mps"))


@query("SELECT count(*) AS n_rows, count(*) FILTER (event_id % 100 > 50) AS n_high FROM events")
def legacy_imu(s, d):
    e = F.col("event_id")
    t = table(s, d, "events").select(e.alias("timestamp_ns"), (e % 100).alias("acc_x"), *[F.lit(0.0).alias(f"{k}_{a}") for k in ("acc", "gyro") for a in "xyz" if (k, a) != ("acc", "x")], e.alias("_o"))
    out, soft = V.validate_imu(t, order=["_o"])
    return out.agg(F.count("*").alias("n_rows")).withColumn("n_high", F.lit(sum(int(x.split(" in ")[1].split()[0]) for x in soft)).cast("long"))


@query("SELECT event_id AS timestamp_ns, event_type, CAST(NULL AS VARCHAR) AS meta FROM events")
def legacy_events(s, d):
    t = table(s, d, "events").select(F.col("event_id").alias("timestamp_ns"), "event_type", F.lit(None).cast("string").alias("meta"), F.col("event_id").alias("_o"))
    return V.validate_events(t, order=["_o"]).select("timestamp_ns", "event_type", "meta")


@query("SELECT true AS ok, count(*) AS pairs, CAST(0 AS BIGINT) AS exceeds, CAST(1000 AS BIGINT) AS max_abs_delta FROM events")
def legacy_tables(s, d):
    """Units, tables and alignment at once; the second clock is a microsecond off."""
    e = F.col("event_id") * 1_000_000_000
    x = table(s, d, "events").orderBy("event_id")
    t = x.select(e.alias("timestamp_ns"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), F.lit(3.0).alias("speed_mps"))
    i = x.select((e + 1000).alias("timestamp_ns"), *[F.lit(0.0).alias(f"{k}_{a}") for k in ("acc", "gyro") for a in "xyz"])
    ok, rep, _ = V.validate_tables({"trajectory": t, "imu": i}, dict(V.UNITS))
    m = rep["alignment"]
    return s.createDataFrame([(ok, m["pairs"], m["exceeds"], m["max_abs_delta_us"])], "ok boolean, pairs long, exceeds long, max_abs_delta long")


@query("SELECT 'alt is absent' AS problem UNION ALL SELECT 'lat can''t be read as double in ' || count(*) FILTER (event_id % 5 = 0) || ' rows' FROM events UNION ALL SELECT 'lat is out of bounds in ' || count(*) FILTER (event_id % 5 = 0 OR event_id % 200 > 90) || ' rows' FROM events")
def schema_problems(s, d):
    e = F.col("event_id")
    t = table(s, d, "events").select(e.alias("timestamp_ns"), F.when(e % 5 == 0, F.lit("north")).otherwise((e % 200).cast("string")).alias("lat"), F.lit(1.0).alias("lon"), F.lit(1.0).cast("float").alias("speed_mps"))
    return s.createDataFrame([(x,) for x in V.validate_schema(t, "trajectory")], "problem string")


@query("SELECT count(*) AS n_rows, count(*) FILTER (event_id % 4 = 0) AS no_vehicle, count(*) FILTER (event_id % 100 > 90) AS lat_range, count(*) FILTER (event_id % 3 = 1) AS fix_type FROM events")
def nested_rules(s, d):
    e = F.col("event_id")
    t = table(s, d, "events").select(F.lit("2021-01-04T00:00:00Z").alias("timestamp"), F.when(e % 4 != 0, "v").alias("vehicle_id"), F.struct((e % 100).cast("double").alias("lat"), F.lit(5.0).alias("lon")).alias("position"), F.struct(F.when(e % 3 == 1, "4d").otherwise("3d").alias("fix_type")).alias("quality"))
    return V.validate_nested(t).select("n_rows", F.col("no_vehicle_id").alias("no_vehicle"), F.col("`range_position.lat`").alias("lat_range"), F.col("`value_quality.fix_type`").alias("fix_type"))


@query("SELECT 'mandatory' AS kind, 1 AS n UNION ALL SELECT 'layers', 1 UNION ALL SELECT 'types', 1 UNION ALL SELECT 'gyro', 1 UNION ALL SELECT 'resolve', 1 UNION ALL SELECT 'prefix', 1")
def column_findings(s, d):
    """Rules that names and types alone decide, on a frame that breaks each."""
    t = table(s, d, "records").select("ts", "lat", "lon", F.col("speed_mps").cast("double").alias("speed_mps"), "gx_rad_s", "trip_id", F.lit("x").alias("event"), F.lit(1).alias("odd"))
    err, warn = V.column_rules(t, "imu", "strict")
    marks = {"mandatory": "mandatory columns", "layers": "higher layers", "types": "types differ", "gyro": "gyro columns", "resolve": "neither a column nor inherited", "prefix": "x_ prefix"}
    return s.createDataFrame([(k, sum(m in e for e in [*err, *warn])) for k, m in marks.items()], "kind string, n int")


@query("SELECT count(*) AS n_rows, CAST(10 AS DOUBLE) AS rate_hz, round((count(*) - 1) / 10, 4) AS duration_s, CAST(0 AS INTEGER) AS n_errors FROM events")
def samples_verified(s, d):
    f = scratch(s)
    (f / "dataset.json").write_text(json.dumps({"column_aliases": {"lat": "y"}}))
    e = F.col("event_id")
    n = table(s, d, "events").agg(F.min("event_id")).first()[0]
    x = table(s, d, "events").orderBy("event_id").select(((e - n) * 100 + 1609718400000).alias("time_ms"), F.lit(45.0).alias("y"), (5 + (e % 7) * 1e-5).alias("lon"), F.lit(1.0).alias("v_mps"), *[F.lit(0.0).alias(f"imu_{k}{a}") for k in "ag" for a in "xyz"])
    sinks.write_parquet(x, f / "samples.parquet")
    from roadgrain.verify import verify

    v = verify(s, f)
    return s.createDataFrame([(v.facts["rows"], round(v.facts["rate_hz"], 4), round(v.facts["duration_s"], 4), len(v.errors))], "n_rows long, rate_hz double, duration_s double, n_errors int")


# Manifests.
_M = {
    "dataset_id": "test", "hardware": {"devices": [{"name": "unit"}]}, "sensors": {"gps": {"rate_hz": 1}, "gyroscope": {"rate_hz": 10}},
    "acc_periods": [{"start": "2021-01-04T00:00:00Z", "end": "2021-01-04T06:00:00Z", "frame": "partial", "residual_g": 0.1}, {"start": "2021-01-04T06:00:00Z", "end": "present", "frame": "compensated"}],
    "papers_using": [{"id": "p", "accept_acc_periods": ["partial"]}], "trip_carrier_states": [{"trip_id": "a", "carrier_state": "desk"}, {"trip_id": "b", "carrier_state": "mounted_idle"}],
    "config_history": [{"timestamp": "2021-01-04T00:00:00Z", "profile": "one"}, {"timestamp": "2021-01-04T08:00:00Z", "profile": "two"}], "volume": {"n_messages": 5},
}


@query("SELECT DISTINCT rec_id, coalesce(device_id, 'unit') AS device_id, trip_id FROM records")
def manifest_inherits(s, d):
    return M.inherit(table(s, d, "records"), _M).select("rec_id", "device_id", "trip_id").distinct()


@query("SELECT DISTINCT rec_id, CASE WHEN ts >= TIMESTAMPTZ '2021-01-04 00:00:00+00' AND ts <= TIMESTAMPTZ '2021-01-04 06:00:00+00' THEN 'partial' WHEN ts >= TIMESTAMPTZ '2021-01-04 06:00:00+00' THEN 'compensated' ELSE 'raw' END AS frame FROM records")
def manifest_frames(s, d):
    return table(s, d, "records").select("rec_id", M.acc_frame(_M, F.col("ts")).alias("frame")).distinct()


@query("SELECT DISTINCT rec_id FROM records WHERE ts >= TIMESTAMPTZ '2021-01-04 00:00:00+00' AND ts <= TIMESTAMPTZ '2021-01-04 06:00:00+00'")
def manifest_accepts(s, d):
    return M.accepted_rows(table(s, d, "records"), _M, "p").select("rec_id").distinct()


@query("SELECT count(*) AS n_rows, CAST(5 AS BIGINT) AS declared_rows, count(*) FILTER (device_id IS NOT NULL AND device_id <> 'unit') AS other_device, count(*) FILTER (trip_id IS NOT NULL AND trip_id NOT IN ('a', 'b')) AS other_trip, coalesce(bool_or(gx_rad_s IS NOT NULL), false) AS gyro, NOT coalesce(bool_or(ax_mps2 IS NOT NULL), false) AS imu FROM records")
def manifest_disagrees(s, d):
    r = table(s, d, "records").select("device_id", "trip_id", "lat", "lon", *S.cols("accel"), *S.cols("gyro"))
    return M.disagreements(r, _M).select("n_rows", "declared_rows", "other_device", "other_trip", F.col("sensor_gyro_as_declared").alias("gyro"), F.col("sensor_imu_as_declared").alias("imu"))


@query("SELECT * FROM (VALUES ('a', 'desk'), ('b', 'mounted_idle')) t(trip_id, carrier_state)")
def manifest_states(s, d):
    return M.carrier_states(s, _M).select("trip_id", "carrier_state")


@query("SELECT DISTINCT rec_id, CASE WHEN ts >= TIMESTAMPTZ '2021-01-04 08:00:00+00' THEN 'two' WHEN ts >= TIMESTAMPTZ '2021-01-04 00:00:00+00' THEN 'one' END AS profile FROM records")
def manifest_configs(s, d):
    return asof.step_value(once(s, d), M.config_history(s, _M).select("ts", "profile"), "ts").select("rec_id", "profile")


@query("SELECT epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS n_messages, count(DISTINCT trip_id) AS n_trips FROM records")
def manifest_emitted(s, d):
    m = M.emit("test", table(s, d, "records"), "imu", path=scratch(s) / "manifest.yaml")
    p, v = m["acc_periods"][0], m["volume"]
    one = s.createDataFrame([(p["start"], p["end"], v["n_messages"], v["n_trips"])], "a string, z string, n_messages long, n_trips long")
    return one.select(F.unix_micros(F.to_timestamp("a")).alias("first_us"), F.unix_micros(F.to_timestamp("z")).alias("last_us"), "n_messages", "n_trips")


@query("SELECT * FROM (VALUES ('absent', 1), ('profile', 1), ('residual', 1), ('burst', 1), ('state', 1), ('rate', 1), ('end', 1), ('devices', 1)) t(rule, n)")
def manifest_rules(s, d):
    """Each rule of a manifest, on one that breaks it."""
    bad = {
        "absent": ({"dataset_id": None}, "dataset_id is absent"), "profile": ({"profile": "best"}, "profile is"), "residual": ({"acc_periods": [{"start": "a", "end": "b", "frame": "partial"}]}, "residual_g"),
        "burst": ({"sensors": {"accelerometer": {"sampling_mode": "burst"}}}, "burst"), "state": ({"trip_carrier_states": [{"trip_id": "t", "carrier_state": "flying"}]}, "flying"), "rate": ({"sensors": {"gps": {"rate_hz": -1}}}, "rate_hz"),
        "end": ({"acc_periods": [{"start": "2021-01-01", "frame": "raw"}]}, "has no end"),
    }
    said = {k: M.check({"dataset_id": "x"} | m, compat=False) for k, (m, _) in bad.items()}
    rows = [(k, sum(text in x for x in [*said[k].errors, *said[k].warnings])) for k, (_, text) in bad.items()]
    rows.append(("devices", len(M.device_rule(["ts"], {"hardware": {"devices": ["a", "b"]}}, ["c.parquet"]))))
    return s.createDataFrame(rows, "rule string, n int")


@query("SELECT * FROM (VALUES ('one', CAST(10 AS BIGINT), 'gps,imu'), ('two', NULL, '')) t(dataset_id, n_rows, sensors)")
def dataset_index(s, d):
    p = scratch(s) / "index.yaml"
    p.write_text(yaml.safe_dump({"datasets": [{"id": "one", "rows": 10, "sensors": ["gps", "imu"]}, {"id": "two"}]}))
    return M.index(s, p).select("dataset_id", "n_rows", "sensors")


@query("SELECT * FROM (VALUES ('good', true), ('bad', false), ('gone', false)) t(name, ok)")
def file_digests(s, d):
    f = scratch(s)
    (f / "good").write_text("x")
    (f / "bad").write_text("y")
    (f / "SHA256SUMS").write_text("".join(f"{M.sha256(f / 'good')}  {n}\n" for n in ("good", "bad", "gone")))
    return s.createDataFrame(list(M.verify_sums(f).items()), "name string, ok boolean")
