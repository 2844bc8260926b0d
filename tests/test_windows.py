import math

import pytest
from pyspark.sql import functions as F

from roadgrain.operators.windows import curvature_rate


def test_curvature_rate(spark):
    m, rows, x, y, heading = 111_195.0, [], 0.0, 0.0, 0.0
    for i in range(40):  # straight, then a circle of 50 m, a fix every 2 s
        rows.append(("t", i * 2_000_000, y / m, x / m))
        heading += 0.2 if i >= 20 else 0.0
        x, y = x + 10 * math.sin(heading), y + 10 * math.cos(heading)
    df = spark.createDataFrame(rows, "trip_id string, us long, lat double, lon double").selectExpr("trip_id", "timestamp_micros(us) ts", "lat", "lon")
    got = curvature_rate(df, ["trip_id"], ["ts"]).orderBy("ts").collect()
    k, rate = [r.curvature_1_m for r in got], [r.curvature_rate for r in got]
    assert k[0] is None and rate[0] is None and rate[1] is None
    assert all(rate[i] == pytest.approx((k[i] - k[i - 1]) / 2) for i in range(2, 39))
    assert abs(k[30]) == pytest.approx(1 / 50, rel=0.02) and rate[10] == pytest.approx(0, abs=1e-6) and rate[30] == pytest.approx(0, abs=1e-6)
    assert abs(sum(rate[18:24]) * 2) == pytest.approx(1 / 50, rel=0.02)


def test_no_way_to_a_fix_that_is_not_there(spark):
    from roadgrain.functions.geo import haversine_km, haversine_m
    from roadgrain.operators.aggregates import trip_distance

    df = spark.createDataFrame([(0, 1.0), (1, 1.1), (2, 1.2)], "ts long, lat double").selectExpr("timestamp_micros(ts) ts", "'t' trip_id", "lat", "0D lon")
    assert abs(trip_distance(df, ["trip_id"], ["ts"]).first().distance_km - 22.239) < 0.01
    n = F.lit(None).cast("double")
    r = df.select(haversine_m(n, n, F.col("lat"), F.col("lon")).alias("m"), haversine_km(n, n, F.col("lat"), F.col("lon")).alias("k"), haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("half")).first()
    assert r.m is None and r.k is None and abs(r.half - 20015.1) < 1
