import math

import pytest
from pyspark.sql import functions as F

from roadgrain.adapters import load
from roadgrain.adapters.sources import map_provider
from roadgrain.operators.introspect import sensor_profile


def test_unknown(spark):
    with pytest.raises(ValueError):
        load("none", spark, ".")


def aegis(tmp):
    iso = lambda i: f"2025-01-01T00:00:{i // 10:02d}.{i % 10}00000Z"
    (tmp / "accelerations.csv").write_text("trip_id,timestamp,x_value,y_value,z_value\n" + "".join(f"{t},{iso(i)},0.1,0,1\n" for t, n in (("1", 30), ("2", 12), ("x", 8)) for i in range(n)))
    (tmp / "positions.csv").write_text("trip_id,timestamp,latitude,longitude,altitude\n" + "".join(f"{t},{iso(i)},45{30 + i / 1000:.4f},-00530.0,200\n" for t in "12x" for i in range(0, 30, 5)))
    (tmp / "gyroscopes.csv").write_text("trip_id,timestamp,x_value,y_value,z_value\n" + "".join(f"1,{iso(i)},180,0,0\n" for i in range(0, 30, 2)))
    (tmp / "obdData.csv").write_text("trip_id,timestamp,obdPid,data\n" + "".join(f"1,{iso(i)},{p},36\n" for i in range(0, 30, 9) for p in ("0D", "0C")))
    (tmp / "trips.csv").write_text("trip_id,beaglebone_id\n1,bb1\nx,bbx\n")
    return str(tmp)


def test_aegis(spark, tmp_path):
    df = load("aegis", spark, aegis(tmp_path), top_n_trips=2, by_trip=True)
    rows = {r.trip_id: r for r in df.collect()}
    assert set(rows) == {"1", "2"} and rows["1"].device_id == "bb1" and rows["2"].device_id == "unknown"
    r = rows["1"]
    assert abs(r.ax_mps2 - 0.980665) < 1e-5 and abs(r.gx_rad_s - math.pi) < 1e-5 and abs(r.speed_obd_mps - 10) < 1e-5 and abs(r.lon + 5.5) < 1e-9
    assert sensor_profile(df) == "gps+imu+gyro+obd"
    assert load("aegis", spark, str(tmp_path), top_n_trips=None, with_gyro=False, with_obd=False).count() == 50
    tight = load("aegis", spark, str(tmp_path), top_n_trips=1, by_trip=True, tolerances_ms={"gps": 50})
    assert tight.count() == 6


def test_pvs(spark, tmp_path):
    for n in (10, 2):
        d = tmp_path / f"PVS {n}"
        d.mkdir()
        cols = [f"{s}_{a}_dashboard" for s in ("acc", "gyro", "mag") for a in "xyz"]
        (d / "dataset_gps_mpu_left.csv").write_text("timestamp," + ",".join(cols) + ",timestamp_gps,latitude,longitude,speed\n" + "".join(f"{1577218796 + i / 100:.2f},0,0,9.8,180,0,0,1,2,3,{i // 5},-27.7,-51.1,{70 if i else ''}\n" for i in range(20)))
        (d / "dataset_gps.csv").write_text("timestamp,elevation,hdop,satellites\n1577218796.0,900,0.9,8\n")
        (d / "dataset_labels.csv").write_text("asphalt_road,dirt_road\n" + "1,1\n1,0\n" + "0,0\n" * 18)
    df = load("pvs", spark, str(tmp_path), labels=True)
    assert df.count() == 40 and {r.trip_id for r in df.select("trip_id").distinct().collect()} == {"PVS_2", "PVS_10"}
    got = {r.road_surface: r.n for r in df.groupBy("road_surface").agg(F.count("*").alias("n")).collect()}
    assert got == {"dirt": 2, "asphalt": 2, "unknown": 36}
    a = df.agg(F.min("speed_mps").alias("a"), F.max("speed_mps").alias("z"), F.first("altitude_gps_m").alias("h"), F.first("n_satellites").alias("s")).first()
    assert (a.a, a.z, a.h, a.s) == (0.0, 50.0, 900.0, 8)
    assert load("pvs", spark, str(tmp_path), trip_idx=1).first().trip_id == "PVS_2"
    sparse = load("pvs", spark, str(tmp_path), trip_idx=1, sparse=True)
    assert sparse.count() == 20 and sparse.where("lat is not null").count() == 4
    with pytest.raises(FileNotFoundError):
        load("pvs", spark, str(tmp_path / "PVS 2"))


def test_stride(spark, tmp_path):
    for c, s in (("bus", "one"), ("car", "two")):
        d = tmp_path / c / s
        d.mkdir(parents=True)
        ns = lambda i: 1735689600000000000 + i * 10_000_000
        (d / "TotalAcceleration.csv").write_text("time,x,y,z\n" + "".join(f"{ns(i)},0,0,9.8\n" for i in range(30)))
        (d / "Location.csv").write_text("time,latitude,longitude,speed,bearing\n" + "".join(f"{ns(i)},45,5,-1,90\n" for i in (0, 20)))
        (d / "Gyroscope.csv").write_text("time,x,y,z\n" + f"{ns(3)},1,2,3\n")
    df = load("stride", spark, str(tmp_path))
    assert df.count() == 60 and df.select("trip_id").distinct().count() == 2
    r = df.first()
    assert (r.speed_mps, r.heading_deg, r.gy_rad_s) == (0.0, 90.0, 2.0)
    assert load("stride", spark, str(tmp_path), category="car", session_idx=0, with_gyro=False).count() == 30
    with pytest.raises(ValueError):
        load("stride", spark, str(tmp_path), category="none")


def test_uah_and_simulated(spark, tmp_path):
    d = tmp_path / "D1" / "trip-a"
    d.mkdir(parents=True)
    (d / "RAW_ACCELEROMETERS.txt").write_text("".join(f"{i / 10} 1 0.1 0 1 0 0 0 90 0\n" for i in range(25)))
    (d / "RAW_GPS.txt").write_text("".join(f" {i} 36 45.{i} 5 200 1 1 90 0 1 1 \n" for i in range(3)))
    df = load("uah-driveset", spark, str(tmp_path))
    assert df.count() == 25 and df.where("lat is not null").count() == 3
    r = df.orderBy("ts").first()
    assert abs(r.speed_mps - 10) < 1e-6 and abs(r.x_uah_roll_rad - math.pi / 2) < 1e-5 and r.trip_id == "trip-a"
    (tmp_path / "s.csv").write_text("timestamp,lat,lon,speed,acc_x,event\n2025-01-01T00:00:00Z,45,5,1.5,0.1,brake\n")
    r = load("simulated", spark, str(tmp_path / "s.csv")).first()
    assert r.speed_mps == 1.5 and r.x_sim_event == "brake" and r.ax_mps2 == 0.1


def test_providers(spark):
    df = spark.createDataFrame([("2025", 1.0, 2.0, 36.0, 9)], "dateTime string, latitude double, longitude double, speed double, other int")
    r = map_provider(df, "geotab").first()
    assert abs(r.speed_mps - 10) < 1e-9 and r.lat == 1.0 and r.other == 9
    with pytest.raises(ValueError):
        map_provider(df, "none")
