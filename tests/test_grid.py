import math
import random

import numpy as np

from roadgrain.operators.grid import regular_grid

S = "rec_id long, trip_id string, us long, lat double, lon double"


def frame(spark, data):
    return spark.createDataFrame(data, S).selectExpr("rec_id", "trip_id", "timestamp_micros(us) ts", "lat", "lon", "1 as slot", "2 as t")


def brute(pts, slot):
    """Weighted least squares at the slot's middle."""
    mid = slot + 2.5
    u = [((us / 1e6 - mid) / 5, la) for us, la in pts if abs(us / 1e6 - mid) < 7.5]
    w = [1 - (t / 1.5) ** 2 for t, _ in u]
    if sum(w) < 0.5:
        return None
    x = np.array([[1, t] for t, _ in u])
    y = np.array([la for _, la in u])
    sw = np.sqrt(np.array(w))[:, None]
    return float(np.linalg.lstsq(x * sw, y * sw[:, 0], rcond=None)[0][0])


def test_equals_weighted_regression(spark):
    rng = random.Random(2)
    us, data = 1_600_000_003_000_000, []
    for i in range(150):
        us += int(rng.choice([0.4, 1.0, 2.2, 9.0, 31.0]) * 1e6)
        data.append((i, "a", us, 45 + i * 1e-4 + rng.random() * 1e-5, 5.0))
    got = {r.slot_start_s: r for r in regular_grid(frame(spark, data + data[:5])).collect()}
    secs = [d[2] // 5_000_000 * 5 for d in data]
    assert sorted(got) == list(range(min(secs), max(secs) + 5, 5))
    for s, r in got.items():
        assert r.n_readings == sum(x == s for x in secs)
        want = brute([(d[2], d[3]) for d in data], s)
        if want is not None and len({d[2] for d in data if abs(d[2] / 1e6 - s - 2.5) < 7.5}) > 1:
            assert math.isclose(r.lat, want, abs_tol=1e-6), s
        assert (r.state == "missing") == (r.n_readings == 0 and want is None)


def test_unlocated_and_empty(spark):
    data = [(1, "a", 10_000_000, 0.0, 0.0), (2, "a", 20_000_000, 91.0, 1.0), (3, "a", 30_000_000, None, 1.0), (4, "a", 40_000_000, float("nan"), 1.0), (5, "a", 52_000_000, 1.0, 1.0), (6, None, 60_000_000, 1.0, 1.0), (7, "a", None, 1.0, 1.0), (8, "b", -1, 0.0, 1.0)]
    got = {(r.trip_id, r.slot_start_s, r.n_readings) for r in regular_grid(frame(spark, data)).collect()}
    assert got == {("a", 50, 1), ("b", -5, 1)}
    assert regular_grid(frame(spark, data).limit(0)).count() == 0


def test_a_trip_over_the_date_line(spark):
    rows = [(i, "t", 1_000_000 * i, 10.0, 179.9995 + i * 1e-4 if i < 5 else -180.0005 + i * 1e-4) for i in range(12)]
    f = spark.createDataFrame(rows, "rec_id long, trip_id string, us long, lat double, lon double").selectExpr("rec_id", "trip_id", "timestamp_micros(us) ts", "lat", "lon")
    for r in regular_grid(f).collect():
        want = 179.9995 + (r.slot_start_s + 2.5) * 1e-4
        assert abs((r.lon - want + 180) % 360 - 180) < 1e-6 and -180 <= r.lon <= 180 and abs(r.lat - 10) < 1e-6
