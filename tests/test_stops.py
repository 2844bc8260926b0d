import math
import random

import pandas as pd

from roadgrain.operators import stops
from roadgrain.operators.stops import find_stops, stops_and_trips

S = "ping_id long, device_id string, us long, lat double, lon double"
T0 = 1_609_718_400_000_000


def frame(spark, rows):
    return spark.createDataFrame(rows, S).selectExpr("ping_id", "device_id", "timestamp_micros(us) ts", "lat", "lon", "null as h_accuracy_m", "'x' as kind", "1 as n")


class Walk:
    def __init__(self, seed, start_s=0):
        self.rng, self.rows, self.t, self.x, self.y, self.id = random.Random(seed), [], T0 + start_s * 1_000_000, 0.0, 0.0, 1
        self.truth = []

    def ping(self, dx=0.0, dy=0.0, located=True):
        r = self.rng
        self.rows.append((self.id, "d", self.t, 45 + (self.y + dy + r.gauss(0, 5)) / 111_195 if located else None, 5 + (self.x + dx + r.gauss(0, 5)) / 111_195 / math.cos(math.radians(45))))
        self.id += 1
        self.t += int(r.uniform(15, 40) * 1e6)

    def stop(self, n, stray=0.05, sleep=0.0):
        first = self.id - bool(self.truth)  # a drive's last ping is at the next place
        for i in range(n):
            if 0 < i < n - 1 and self.rng.random() < stray:
                self.ping(self.rng.uniform(2000, 9000), 3000)
            elif 0 < i < n - 1 and self.rng.random() < 0.05:
                self.ping(located=False)
            else:
                self.ping()
            if self.rng.random() < sleep:
                self.t += int(3e9)
        self.truth.append((first, self.id - 1))

    def drive(self, n, back=False):
        for i in range(n):
            k = -1 if back and i >= n / 2 else 1
            self.x, self.y = self.x + k * 400, self.y + k * 150
            self.ping()


def test_simulated_days(spark):
    w = Walk(7, start_s=80_000)
    for i in range(14):
        w.stop(30, sleep=0.05)
        w.drive(12, back=i % 3 == 0)
        if i % 4 == 0:  # a wait at a light is no stop
            for _ in range(4):
                w.ping()
            w.drive(5)
    w.stop(20)
    rows = w.rows + w.rows[10:20]
    random.Random(1).shuffle(rows)
    got = sorted((r.first_ping_id, r.last_ping_id) for r in find_stops(frame(spark, rows)).collect())
    assert got == w.truth
    seg = stops_and_trips(frame(spark, rows)).collect()
    trips = sorted((r.first_ping_id, r.last_ping_id) for r in seg if r.kind == "trip")
    assert trips == [(a[1], b[0]) for a, b in zip(w.truth, w.truth[1:])]
    assert all(1000 < r.distance_m < 20_000 and r.duration_s > 0 for r in seg if r.kind == "trip")


def test_no_stop_and_odd_rows(spark):
    w = Walk(3)
    w.drive(40)
    assert find_stops(frame(spark, w.rows)).count() == 0
    odd = [(1, None, T0, 1.0, 1.0), (2, "d", None, 1.0, 1.0), (3, "d", T0, 0.0, 0.0), (4, "d", T0, float("nan"), 1.0), (5, "d", T0, None, None), (6, "e", T0, 1.0, 1.0), (None, "e", T0, 1.0, 1.0)]
    assert stops_and_trips(frame(spark, odd)).count() == 0
    assert stops_and_trips(frame(spark, odd).limit(0)).count() == 0


def test_static_device_over_many_days(spark):
    rows = [(i, "d", T0 + i * 7_200_000_000, 45.0 + (i % 3) * 1e-5, 179.99999 if i % 2 else -179.99999) for i in range(60)]
    got = [(r.first_ping_id, r.last_ping_id) for r in find_stops(frame(spark, rows)).collect()]
    assert got == [(0, 59)]


def test_many_thrown_off_pings_do_not_end_a_stop(spark):
    w = Walk(5)
    far = lambda k: w.ping(2000 + 900 * (k % 7), 3000 - 4000 * (k % 2))
    for i in range(60):
        w.ping()
        if i % 4 == 1:  # fifteen single ones
            far(i)
    for i in range(3):  # a run that no dwell bridges
        far(i)
    for _ in range(40):
        w.ping()
    assert [(r.first_ping_id, r.last_ping_id) for r in find_stops(frame(spark, w.rows)).collect()] == [(1, w.id - 1)]


def test_travel_has_a_duration(monkeypatch):
    def item(t0, t1, lat, n, dwell=True):
        return ("d", t0 * 1_000_000, t1 * 1_000_000, t0, t1, lat, 5.0, lat, 5.0, lat, 5.0, n, 0, 0, 0.0, dwell)

    names = [c.split()[0] for c in stops.DWELL.split(", ")]

    def spans(way_s):
        # Off for four pings: 24 nats as pings thrown off, or 8 for a second stop and about 2 for the way, besides durations.
        items = [item(0, 1800, 45.0, 60), item(1860, 1800 + way_s - 60, 45.01, 4, False), item(1800 + way_s, 3600 + way_s, 45.0, 60)]
        return [(x[3], x[4]) for x in stops._decoder(60.0, 300.0, 1800.0)(pd.DataFrame(items, columns=names))]

    assert spans(900) == [(0, 1800), (2700, 4500)]
    monkeypatch.setattr(stops, "LONGEST", 60.0)
    assert spans(900) == [(0, 1800), (2700, 4500)]
    monkeypatch.setattr(stops, "TRAVEL_S", 1e9)  # a way this short is then no travel
    assert spans(900) == [(0, 4500)]


def test_cuts_of_a_history_change_nothing(spark, monkeypatch):
    w = Walk(11)
    for i in range(12):
        w.stop(40, sleep=0.02)
        w.drive(15)
        w.stop(150, sleep=0.03)  # hours long: sure dwells on most days
        w.t += 30_000_000_000
        w.drive(10)
    w.stop(30)
    f = frame(spark, w.rows)

    def segments():
        got = sorted((r.kind, r.first_ping_id, r.last_ping_id, r.duration_s, round(r.distance_m, 3), r.lat and round(r.lat, 6)) for r in stops_and_trips(f).collect())
        return got, sorted((r.first_ping_id, r.n_pings) for r in find_stops(f).collect())

    p = f.selectExpr("device_id", "unix_micros(ts) us", "ping_id", "lat", "lon").where("lat is not null").withColumn("day", stops.F.floor(stops.F.col("us") / stops.DAY_US))
    d = p.repartition("device_id", "day").sortWithinPartitions("device_id", "day", "us", "ping_id").mapInArrow(stops._first_pass(60.0, 2, 1_800_000_000), stops.ITEM)
    n = stops._pieces(d).select("piece").distinct().count()
    cut = segments()
    monkeypatch.setattr(stops, "CUT_N", 10**9)
    assert n > 4 and stops._pieces(d).select("piece").distinct().count() == 1
    assert segments() == cut
