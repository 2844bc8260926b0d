import random

from roadgrain.operators.spikes import BLOCK_US, LEVELS, candidates, decomposed, faults, readings

S = "rec_id long, trip_id string, device_id string, ts timestamp, ax_mps2 float, gx_rad_s float, speed_mps float"
T = "trip_id string, device_id string"


def rows(spark, data):
    df = spark.createDataFrame([(i, t, d, us, ax, gx, v) for i, t, d, us, ax, gx, v in data], S.replace("ts timestamp", "us long"))
    return df.selectExpr("rec_id", "trip_id", "device_id", "timestamp_micros(us) ts", "ax_mps2", "gx_rad_s", "speed_mps")


def sample(n=600, step=500_000):
    rng = random.Random(1)
    return [[i, "t", "d", i * step, rng.gauss(1, 0.3), rng.gauss(0, 0.02), 10 + rng.random()] for i in range(n)]


def found(df):
    return {(r.rec_id, r.field_name, tuple(r.fault)) for r in df.collect()}


def test_each_kind_of_fault(spark):
    data = sample()
    data[50][4] = 9.0
    for i in range(100, 130):  # a faulty plateau: no detail inside it
        data[i][4] = 20.0 + i / 100
    data[200][6], data[201][6], data[202][6] = -1.0, 60.0, 0.0
    for i in range(300, 309):
        data[i][5] = 0.0123
    for i in range(400, 407):  # seven are no run
        data[i][5] = 0.0077
    for i in range(450, 470):  # zeros are no sticking
        data[i][6] = 0.0
    got = found(faults(rows(spark, data), spark.createDataFrame([("t", "d")], T)))
    want = {(50, "ax_mps2", ("spike",)), (200, "speed_mps", ("impossible",)), (201, "speed_mps", ("impossible",))}
    want |= {(i, "ax_mps2", ("spike",)) for i in range(100, 130)} | {(i, "gx_rad_s", ("stuck",)) for i in range(300, 309)}
    assert got == want


def test_runs_over_block_borders_nulls_and_copies(spark):
    step = BLOCK_US // 4
    data = sample(60, step)
    for i in range(20, 32):  # twelve equal values over three blocks, nulls between
        data[i][5] = 0.5 if i % 2 else None
    data += [list(data[25])]
    data[40][2] = None
    got = {r for r in found(faults(rows(spark, data), spark.createDataFrame([("t", "d")], T))) if r[1] == "gx_rad_s" and "stuck" in r[2]}
    assert got == set()  # six values only
    for i in range(20, 36):
        data[i][5] = 0.5 if i % 2 else None
    got = {r[0] for r in found(faults(rows(spark, data), spark.createDataFrame([("t", "d")], T))) if r[1] == "gx_rad_s" and "stuck" in r[2]}
    assert got == {i for i in range(20, 36) if i % 2}


def test_empty_and_unknown_sources(spark):
    t = spark.createDataFrame([("t", "d")], T)
    assert faults(rows(spark, sample()).limit(0), t).count() == 0
    data = [[i, None, None, None if i == 3 else i, 1.0 + i % 3, float("nan"), None] for i in range(20)]
    assert faults(rows(spark, data), t.limit(0)).count() == 0


def test_copies_do_not_weigh_on_what_is_usual(spark):
    data = sample()
    data[50][4], data[60][5], data[201][6] = 9.0, -3.0, 60.0
    t = spark.createDataFrame([("t", "d")], T)
    want = {(50, "ax_mps2", ("spike",)), (60, "gx_rad_s", ("spike",)), (201, "speed_mps", ("impossible",))}
    assert found(faults(rows(spark, data), t)) == want
    for i in (10, 201):  # more than half of the device's rows are one record's copies, a usual or a faulty one
        assert found(faults(rows(spark, data + [list(data[i]) for _ in range(900)]), t)) == want


def test_a_reading_is_the_sum_of_its_coefficients(spark):
    data = sample(40)
    for i in (3, 4, 9):
        data[i][4] = None
    t = spark.createDataFrame([("t", "d")], T)
    x = decomposed(readings(rows(spark, data), t, ["ax_mps2", "gx_rad_s"]), ["ax_mps2", "gx_rad_s"]).collect()
    assert len(x) == 40
    for r in x:
        for f in ("ax_mps2", "gx_rad_s"):
            if r[f] is None:
                assert r[f"{f}_d1"] is None and r[f"{f}_c"] is None
            else:
                assert abs(sum(r[f"{f}_d{j}"] for j in range(1, LEVELS + 1)) + r[f"{f}_c"] - r[f]) < 1e-9


def test_candidates_are_few_and_hold_every_spike(spark):
    rng = random.Random(4)
    data = sample(3000)
    far = set()
    for i in range(0, 3000, 150):
        data[i][4] = 1 + rng.choice((-1, 1)) * rng.uniform(3.6, 30)
        far.add(i)
    for i in range(1000, 1040):  # a plateau has details at its ends only
        data[i][4] = 12 + i / 1000
        far.add(i)
    t = spark.createDataFrame([("t", "d")], T)
    values = sorted(r[4] for r in data)
    level, spread = values[1499], (values[2249] - values[749]) / 1.349
    want = {r[0] for r in data if abs(r[4] - level) > 10.05 * spread}
    got = {r[0] for r in found(faults(rows(spark, data), t)) if r[1] == "ax_mps2" and "spike" in r[2]}
    assert want <= got <= far
    c = {r.field_name: r for r in candidates(rows(spark, data), t).collect()}["ax_mps2"]
    assert c.n_spikes == len(got) <= c.n_candidates < 300 and c.n_readings == 3000


def test_slow_sources_have_impossible_speeds_too(spark):
    data = sample()
    rng = random.Random(5)
    for r in data:
        r[6] = 1 + 0.4 * rng.random()
    data[77][6] = 2.9
    got = {r[0] for r in found(faults(rows(spark, data), spark.createDataFrame([("t", "d")], T))) if r[1] == "speed_mps"}
    assert got == {77}
