import warnings

import pytest
from pyspark.sql import functions as F

from roadgrain import schema as S
from roadgrain.errors import AlignmentNotice, FrameError, MeaningError, UnitError
from roadgrain.operators import introspect
from roadgrain.validate import check_alignment, check_increasing, check_units, validate, validate_events, validate_imu, validate_nested, validate_schema, validate_tables, validate_trajectory


def record(spark, gyro=False, n=50):
    df = spark.range(n).select(
        F.timestamp_micros(F.lit(1735689600000000) + F.col("id") * 100000).alias("ts"), F.when(F.col("id") % 10 == 0, 45.0 + F.col("id") * 1e-5).alias("lat"), F.when(F.col("id") % 10 == 0, 5.0).alias("lon"),
        F.when(F.col("id") % 10 == 0, 5.0).cast("float").alias("speed_mps"), F.lit(0.1).cast("float").alias("ax_mps2"), F.lit(0.1).cast("float").alias("ay_mps2"), F.lit(9.81).cast("float").alias("az_mps2"),
        F.lit("d").alias("device_id"), F.lit("t").alias("trip_id"), F.col("id"),
    )
    df = df.withColumns({c: F.lit(0.01).cast("float") for c in S.cols("gyro")}) if gyro else df
    return df.withColumnRenamed("id", "x_pos")


def test_profiles(spark):
    assert validate(record(spark), profile="imu").ok and validate(record(spark), profile="core").ok
    assert validate(record(spark, True)).profile == "full" and validate(record(spark)).profile == "imu"
    bad = validate(record(spark), profile="full")
    assert not bad.ok and "gx_rad_s" in bad.errors[0]


def test_partial_groups_and_names(spark):
    r = validate(record(spark).withColumn("gx_rad_s", F.lit(0.0).cast("float")).withColumn("mx_uT", F.lit(1.0).cast("float")), profile="imu")
    assert len([e for e in r.errors if "all or none" in e]) == 2
    assert validate(record(spark).withColumn("speedlimit", F.lit(1))).warnings
    assert not validate(record(spark).withColumn("x_any", F.lit(1))).warnings


@pytest.mark.parametrize("col,value,rule", [("heading_deg", 400.0, "heading_range"), ("speed_mps", -1.0, "speed_mps_negative"), ("lat", 95.0, "lat_range"), ("lon", -181.0, "lon_range")])
def test_ranges(spark, col, value, rule):
    r = validate(record(spark).withColumn(col, F.lit(value)), profile="imu")
    assert not r.ok and r.counts[rule] == 50


def test_order_basic_and_strict(spark):
    df = record(spark).withColumn("ts", F.when(F.col("x_pos") == 7, F.lit(1735689600600000)).otherwise(F.unix_micros("ts"))).withColumn("ts", F.timestamp_micros("ts"))
    assert validate(df, order=["x_pos"]).ok  # equal times are fine at basic
    strict = validate(df, "strict", order=["x_pos"])
    assert strict.counts["ts_order"] == 1
    back = record(spark).withColumn("ts", F.timestamp_micros(F.lit(1735689600000000) - F.col("x_pos")))
    assert validate(back, order=["x_pos"]).counts["ts_order"] == 49


def test_strict_rules(spark):
    r = validate(record(spark).withColumn("event", F.lit("x")).drop("device_id"), "strict")
    text = " ".join(r.errors)
    assert "higher layers" in text and "device_id" in text
    assert any("types differ" in e for e in validate(record(spark).withColumn("speed_mps", F.lit(1.0)), "strict").errors)
    assert validate(record(spark).withColumn("lat", F.lit(None).cast("double")), "strict").counts["no_fix"] == 1
    zero = record(spark).withColumns({c: F.lit(0.0).cast("float") for c in S.cols("gyro")})
    assert validate(zero, "strict", "imu").counts["gyro_zero_filled"] == 1
    assert validate(record(spark), "strict", by=["trip_id"], frame="raw").counts["gravity"] == 0
    assert validate(record(spark), "strict", by=["trip_id"], frame="compensated").counts["gravity"] == 1


def test_introspection(spark):
    df = record(spark, True)
    assert introspect.sensor_profile(df) == "gps+imu+gyro" and introspect.is_full_imu(df) and not introspect.is_gps_only(df)
    assert introspect.sensor_profile(df.select("ts")) == "empty" and introspect.detect_profile(df.select("ts")) == "core"
    assert introspect.has(df.withColumn("rpm", F.lit(1.0)), "obd") and not introspect.has(df, "magneto")
    assert introspect.is_gps_only(df.select("ts", "lat", "lon"))
    nulls = df.withColumns({c: F.lit(None).cast("float") for c in S.cols("gyro")})
    assert introspect.sensor_profile(nulls) == "gps+imu"


def traj(spark, ns=(1, 2, 3), lat=45.0, speed=1.0):
    return spark.createDataFrame([(n, lat, 5.0, None, speed) for n in ns], "timestamp_ns long, lat double, lon double, alt double, speed_mps double")


def imu(spark, ns=(1, 2, 3), acc=0.0):
    return spark.createDataFrame([(n, acc, 0.0, 9.8, 0.0, 0.0, 0.0) for n in ns], "timestamp_ns long, " + ", ".join(f"{s}_{a} double" for s in ("acc", "gyro") for a in "xyz"))


def test_legacy_tables(spark):
    assert validate_trajectory(traj(spark)).count() == 3
    for bad in (traj(spark, lat=95.0), traj(spark, ns=(1, 3, 2)), traj(spark, speed=-1.0), traj(spark, speed=float("nan"))):
        with pytest.raises(MeaningError):
            validate_trajectory(bad)
    with pytest.raises(FrameError):
        validate_trajectory(traj(spark).drop("lat"))
    assert validate_imu(imu(spark, acc=60.0))[1] and not validate_imu(imu(spark))[1]
    with pytest.raises(MeaningError):
        validate_events(spark.createDataFrame([(1, None)], "timestamp_ns long, event_type string"))
    with pytest.raises(UnitError):
        check_units({"speed": "km/h"})
    for absent in (None, {}, {"speed": "m/s", "gyro": "rad/s"}):
        with pytest.raises(UnitError):
            check_units(absent)
    check_units({"speed": " m/s ", "acceleration": "m/s^2", "gyro": "rad/s"})


def test_alignment_rules(spark):
    a, b = traj(spark, ns=(1_000_000, 2_000_000, 3_000_000)), imu(spark, ns=(10_000_000, 20_000_000, 30_000_000))
    with pytest.warns(AlignmentNotice):
        check_alignment(a, b, 1000)
    with pytest.raises(MeaningError):
        check_alignment(a, b, 1000, raise_error=True)
    with pytest.raises(MeaningError):
        check_alignment(a, b.limit(0))
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        ok, rep, out = validate_tables({"trajectory": a, "imu": a.select("timestamp_ns", *[F.lit(0.0).alias(c) for c in imu(spark).columns[1:]])}, {"speed": "m/s", "acceleration": "m/s^2", "gyro": "rad/s"})
    assert ok and rep["alignment"]["pairs"] == 3 and set(out) == {"trajectory", "imu"}
    assert not validate_tables({"trajectory": a}, {"speed": "kn"})[0]


def test_alignment_of_nanoseconds_in_ten_minutes(spark, monkeypatch):
    from roadgrain import validate as V

    seen, real = [], V.alignment_metrics
    monkeypatch.setattr(V, "alignment_metrics", lambda *a, **k: seen.append(real(*a, **k)) or seen[-1])
    second = 1_000_000_000
    m = V.check_alignment(traj(spark, ns=[k * second for k in range(50)]), imu(spark, ns=[k * second + 7 for k in range(50)]))
    assert (m["pairs"], m["max_abs_delta_us"], m["exceeds"]) == (50, 7, 0)
    assert "6.0E11" in seen[0]._jdf.queryExecution().toString()


def test_order_of_sorted_and_shuffled_files(spark, tmp_path):
    from roadgrain.operators import position as P

    t = imu(spark, ns=range(30_000, 0, -1)).coalesce(1)
    t.write.parquet(str(tmp_path / "back"))
    back = spark.read.parquet(str(tmp_path / "back"))
    assert validate_imu(back.orderBy("timestamp_ns"))[0].count() == 30_000  # a sorted frame's order is not the file's
    with pytest.raises(MeaningError):
        validate_imu(back)
    assert tuple(P.run_counts(P.positioned(back), "timestamp_ns", True).first()) == (0, 29_999, 0)
    # Rows that tasks read in another order than the files have them.
    back.orderBy("timestamp_ns").coalesce(1).write.parquet(str(tmp_path / "up"))
    up = spark.read.parquet(str(tmp_path / "up")).repartition(3)
    assert P.run_counts(P.positioned(up), "timestamp_ns", True).first().mixed
    assert validate_imu(up)[0].count() == 30_000
    odd = spark.read.parquet(str(tmp_path / "up")).withColumn("timestamp_ns", F.when(F.col("timestamp_ns") == 20_000, F.lit(19_999)).otherwise(F.col("timestamp_ns")))
    assert tuple(P.run_counts(P.positioned(odd), "timestamp_ns", True).first()) == (0, 1, 0) and P.run_counts(P.positioned(odd), "timestamp_ns").first().back == 0
    with pytest.raises(MeaningError, match="nulls"):
        check_increasing(odd.withColumn("timestamp_ns", F.nullif("timestamp_ns", F.lit(10_001))))
    check_increasing(odd.limit(0))


def test_named_schemas(spark):
    df = traj(spark)
    assert validate_schema(df, "trajectory") == []
    assert validate_schema(df, "trajectory", strict_types=True)
    assert any("absent" in x for x in validate_schema(df.drop("alt"), "trajectory"))
    assert any("no column" in x for x in validate_schema(df.withColumn("q", F.lit(1)), "trajectory", allow_extra=False))
    assert any("can't be read" in x for x in validate_schema(df.withColumn("lat", F.lit("north")), "trajectory"))
    assert any("bounds" in x for x in validate_schema(df.withColumn("lat", F.lit(None).cast("double")), "trajectory"))
    with pytest.raises(KeyError):
        validate_schema(df, "none")


def test_nested(spark):
    rows = spark.createDataFrame(
        [("2025-01-01T00:00:00Z", "v", (45.0, 5.0), ("3d",), None, 1), (None, "v", None, ("4d",), [("low",)], None), ("t", "v", (91.0, 5.0), None, [("worst",)], None)],
        "timestamp string, vehicle_id string, position struct<lat: double, lon: double>, quality struct<fix_type: string>, events array<struct<severity: string>>, other int",
    )
    r = validate_nested(rows).first()
    want = {"no_timestamp": 1, "no_vehicle_id": 0, "no_position.lat": 1, "range_position.lat": 1, "value_quality.fix_type": 1, "value_events.severity": 1, "unknown": 1, "n_rows": 3}
    assert {k: r[k] for k in want} == want
    assert validate_nested(rows.drop("position")).first()["no_position.lon"] == 3
    one = spark.read.schema(S.NESTED).json(spark.sparkContext.parallelize(['{"timestamp": "t", "vehicle_id": "v", "position": {"lat": 1, "lon": 2}, "context": {"weather": {"temp_c": "7"}}}']))
    assert validate_nested(one).first()["no_timestamp"] == 0


def test_order_over_blocks_and_files(spark, tmp_path, monkeypatch):
    from roadgrain.operators import position as P

    monkeypatch.setattr(P, "BLOCK", 8)
    monkeypatch.setattr(P.before, "__defaults__", (P.ORDER, None, 8))
    ts = list(range(100))
    ts[16], ts[40], ts[41] = 3, 39, 39  # the first row of a block goes back, and two inside one
    f = P.positioned(spark.createDataFrame([(t,) for t in ts], "t long").coalesce(1))
    want = [i for i in range(1, 100) if ts[i] < ts[i - 1]]
    assert sorted(r["_row"] for r in P.out_of_order(f, "t").collect()) == want
    assert P.out_of_order(f, "t", strict=True).count() == sum(ts[i] <= ts[i - 1] for i in range(1, 100))
    n = P.numbered(f, "n", block=8).select("_row", "n").collect()
    assert all(r["_row"] == r.n for r in n)
    assert "lit(0)" not in P.out_of_order(f, "t")._jdf.queryExecution().toString()
    # Files in the order of their names, whatever their sizes.
    for i, part in enumerate((range(5), range(5, 2000), range(2000, 2010))):
        spark.createDataFrame([(x,) for x in part], "t long").coalesce(1).write.parquet(str(tmp_path / f"d/{i}"))
    g = P.positioned(spark.read.parquet(*[str(tmp_path / f"d/{i}") for i in range(3)]))
    assert P.out_of_order(g, "t", strict=True).count() == 0


def test_gravity_per_period(spark):
    rows = [(i, 0.1, 0.0, 0.0, 9.81 if i < 50 else 0.2) for i in range(100)]
    df = spark.createDataFrame(rows, "s long, speed_mps float, ax_mps2 float, ay_mps2 float, az_mps2 float").selectExpr("timestamp_micros(s * 1000000) ts", "'t' trip_id", "*")
    from roadgrain.validate import gravity_by_period

    cut = "1970-01-01T00:00:49.5Z"
    got = {r.period: r.off for r in gravity_by_period(df, [(None, cut, "raw"), (cut, "present", "compensated")], ["trip_id"]).collect()}
    assert got == {0: False, 1: False}
    assert {r.period: r.off for r in gravity_by_period(df, [(None, "present", "raw")], ["trip_id"]).collect()} == {0: True}
    assert {r.period: r.off for r in gravity_by_period(df, [(None, cut, "raw", None), (cut, None, "partial", 0.02)], ["trip_id"]).collect()} == {0: False, 1: False}
