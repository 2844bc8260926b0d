from pyspark.sql import functions as F

from roadgrain.operators.units import foreign_units, resolve_units

R = "reading_id long, provider_id string, device_id string, trip_id string, firmware string, ts timestamp, ax_mps2 string, gx_rad_s string, speed_obd_mps string, lat string, lon string, unit_note string"
U = "provider_id string, field_name string, firmware_from string, firmware_before string, unit_text string"


def frames(spark, rows, units):
    full = [(i, p, None, None, fw, None, ax, gx, sp, lat, None, note) for i, p, fw, ax, gx, sp, lat, note in rows]
    return spark.createDataFrame(full, R), spark.createDataFrame(units, U)


UNITS = [
    ("p", "ax_mps2", None, "1.10", "acc is sent in milli-g"), ("p", "ax_mps2", "1.10", None, "unit: g-force; see release notes"), ("p", "gx_rad_s", None, None, "°/s"),
    ("p", "speed_obd_mps", None, None, "spd is sent in km/hr"), ("p", "lat", None, None, "see data sheet"),
]


def test_order_of_sources_and_conversion(spark):
    rows = [
        (1, "p", "1.9", "1000", None, "36", "45.5", None),
        (2, "p", "1.10.3", "1", "180", "10 m/s", "4530.0000,S", None),
        (3, "p", "1.9", "3,2808399 [ft/s²]", None, "1e1 kn", "45°30'00.0\"N", "ax=g | spd=mph"),
        (4, "p", "1.9", "1", "60 rpm", "10", "455000000", '{"ax": "m/s2", "spd": "MPH"}'),
        (5, "p", "1.9", "−9.80665", None, None, "45.5°", "ACC: M/S2, GYRO: dps"),
    ]
    got = {(r.reading_id, r.field_name): r for r in resolve_units(*frames(spark, rows, UNITS)).collect()}
    want = {
        (1, "ax_mps2"): ("mg", 9.80665, "declared"), (2, "ax_mps2"): ("g", 9.80665, "declared"), (3, "ax_mps2"): ("ft_s2", 1.0, "value"), (4, "ax_mps2"): ("m_s2", 1.0, "note"), (5, "ax_mps2"): ("m_s2", -9.80665, "note"),
        (2, "gx_rad_s"): ("deg_s", 3.14159265, "declared"), (4, "gx_rad_s"): ("rev_min", 6.2831853, "value"), (1, "speed_obd_mps"): ("km_h", 10.0, "declared"), (2, "speed_obd_mps"): ("m_s", 10.0, "value"),
        (3, "speed_obd_mps"): ("knot", 5.14444, "value"), (4, "speed_obd_mps"): ("mph", 4.4704, "note"), (1, "lat"): ("deg", 45.5, "inferred"), (2, "lat"): ("ddmm", -45.5, "inferred"), (3, "lat"): ("dms", 45.5, "value"),
        (4, "lat"): ("e7", 45.5, "inferred"), (5, "lat"): ("deg", 45.5, "value"),
    }
    assert set(got) == set(want)
    for k, (unit, value, by) in want.items():
        assert (got[k].unit_code, got[k].told_by) == (unit, by), k
        assert abs(got[k].value - value) < 1e-4, k


def test_mixture_assigns_undeclared_units(spark):
    import random

    rng = random.Random(4)
    rows = []
    for i in range(400):  # told readings give the field's own scale
        rows.append((i, "told", "1", f"{rng.gauss(0, 1.0):.4f} m/s2", None, f"{rng.uniform(5, 25):.3f} m/s", None, None))
    for i in range(400, 700):
        rows.append((i, "mg", "2.1", f"{rng.gauss(0, 1.0) / 9.80665 * 1000:.3f}", None, None, None, None))
    for i in range(700, 1000):
        rows.append((i, "g", "2.1", f"{rng.gauss(0, 1.0) / 9.80665:.5f}", None, None, None, None))
    got = resolve_units(*frames(spark, rows, [("x", "lat", None, None, None)])).where("told_by = 'inferred'")
    share = {(r.g, r.unit_code): r.n for r in got.groupBy(F.when(F.col("reading_id") < 700, "mg").otherwise("g").alias("g"), "unit_code").agg(F.count("*").alias("n")).collect()}
    assert share.get(("mg", "mg"), 0) > 290 and share.get(("g", "g"), 0) > 270
    assert got.where("uncertain and posterior >= 0.9").count() == 0


def test_missing_repeated_and_extra(spark):
    rows = [(1, None, None, "", "n/a", "NaN", "--", None), (2, "p", "1.9", "abc", None, None, "null", ""), (3, "p", "1.9", "5", None, None, None, None), (3, "p", "1.9", "5", None, None, None, None), (4, "q", None, "0", None, None, None, None)]
    r, u = frames(spark, rows, UNITS)
    got = foreign_units(r.withColumn("value", F.lit(1)).withColumn("unit_code", F.lit("x")), u)
    assert [tuple(x) for x in got.collect()] == [(3, "ax_mps2", "mg")]
    assert foreign_units(r.limit(0), u).count() == 0 and foreign_units(r, u.limit(0)).count() >= 0


def test_parts_of_a_value():
    from roadgrain.operators.units import UNITS as NAMES
    from roadgrain.operators.units import declared_unit, possible, value_parts

    can = lambda raw, n: {u for k, u in enumerate(NAMES["lat"]) if possible(raw, n) >> k & 1}

    assert value_parts("ax_mps2", "1,5 m/s²") == (1.5, None, "m_s2", 0, False)
    assert value_parts("gx_rad_s", "−0.25 [°/s]") == (-0.25, None, "deg_s", 0, False)
    assert value_parts("gx_rad_s", "3 rps")[2] is None  # turns or radians: left to the mixture
    assert value_parts("speed_obd_mps", " 12 ") == (12.0, None, None, 0, False)
    for missing in ("", "n/a", "NaN", "--", None, "inf", "no number"):
        assert value_parts("ax_mps2", missing) is None
    n, d, unit, _, south = value_parts("lat", "12°30'36\" S")
    assert (n, unit, south) == (None, "dms", True) and abs(d - 12.51) < 1e-9
    assert value_parts("lat", "45d 30m 10s")[4] is False  # seconds, not south
    assert value_parts("lat", "48.5°")[2] == "deg"
    assert can("4830.5", 4830.5) == {"ddmm"} and can("4870.5", 4870.5) == set() and can("95.0", 95.0) == set() and can("485000000", 485e6) == {"e7"} and can("N 04.5", 4.5) == set() and can("-4", -4.0) == {"deg", "e7"}
    assert declared_unit("ax_mps2", "acc is sent in milli-g; see notes") == "mg" and declared_unit("lat", "see data sheet") is None
