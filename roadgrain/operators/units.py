"""Problem 1: one quantity written in many units and notations.

Where a unit is told, it is taken in this order: written in the value, told by the row's note, declared by the
provider for the row's firmware. Where none is told, log-scale mixtures whose components sit at known conversion
factors from the project's scale are fitted per (provider, field, declared firmware range) and each reading gets the
unit of highest posterior, with a flag where the posterior is weak.

Defined results: a missing mark ("", "n/a", "NaN", "null", "--", "?", null) gives no row; text without a number gives
no row; a zero cannot be scaled, so it takes the unit with the highest weight in its group; repeated rows count once;
a reading without provider or firmware has no declaration and is inferred; extra columns are ignored; empty tables
give no rows.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadgrain.session import arrow_batch, hashed

G0 = 9.80665

#: Unit code -> factor to the project's unit, by field; the first is the project's unit.
FACTORS = {
    "ax_mps2": {"m_s2": 1.0, "g": G0, "mg": G0 / 1000.0, "ft_s2": 0.3048},
    "gx_rad_s": {"rad_s": 1.0, "deg_s": np.pi / 180.0, "mdeg_s": np.pi / 180000.0, "rev_min": np.pi / 30.0},
    "speed_obd_mps": {"m_s": 1.0, "km_h": 1 / 3.6, "mph": 0.44704, "knot": 1852 / 3600},
    "lat": {"deg": 1.0, "ddmm": 0.01, "dms": 1.0, "e7": 1e-7},
}
#: Spellings of units after ``_spelling`` (lower case, no blanks, dots, carets, stars or brackets).
SPELLINGS = {
    "ax_mps2": {
        "m_s2": ["m/s2", "ms-2", "mps2", "m/sec2", "m/s/s", "metrespersecondsquared", "meterspersecondsquared"],
        "g": ["g", "g0", "gee", "gees", "gs", "g-force", "gforce", "standardgravities", "standardgravity", "gn"],
        "mg": ["mg", "millig", "milli-g", "milligs", "mgee", "milligee"],
        "ft_s2": ["ft/s2", "fps2", "feet/s2", "fts-2", "ft/sec2", "feetpersecondsquared", "ft/s/s"],
    },
    "gx_rad_s": {
        "rad_s": ["rad/s", "rads-1", "radianspersecond", "radians/s", "rad/sec"],
        "deg_s": ["deg/s", "dps", "°/s", "degs-1", "degreespersecond", "degrees/s", "deg/sec", "°s-1"],
        "mdeg_s": ["mdeg/s", "mdps", "m°/s", "millidegrees/s", "millidegreespersecond", "mdegs-1"],
        "rev_min": ["rpm", "rev/min", "r/min", "turnsperminute", "revolutionsperminute", "revmin-1"],
    },
    "speed_obd_mps": {
        "m_s": ["m/s", "mps", "ms-1", "metrespersecond", "meterspersecond", "m/sec"],
        "km_h": ["km/h", "kmh", "kph", "km/hr", "kmph", "kmh-1", "kilometresperhour", "kilometersperhour"],
        "mph": ["mph", "mi/h", "milesperhour", "mi/hr", "miles/h", "mih-1"],
        "knot": ["kn", "kt", "kts", "knot", "knots", "nauticalmilesperhour", "nmi/h"],
    },
    "lat": {
        "deg": ["deg", "dd", "decimaldegrees", "degrees(decimal)", "degrees", "°", "degreesdecimal"],
        "ddmm": ["ddmm", "ddmmmmmm", "nmea", "nmea0183", "degreesandminutespacked", "dmm"],
        "dms": ["dms", "degminsec", "sexagesimal", "degreesminutesseconds"],
        "e7": ["1e-7deg", "deg1e7", "dege7", "ten-millionthsofadegree", "e7", "degreese7", "1e7deg"],
    },
}
#: How notes call a field (lower case, blanks as one space).
FIELD_WORDS = {
    "ax_mps2": ["ax", "acc", "accel", "acceleration", "ax_mps2", "acc_x", "accelerometer"],
    "gx_rad_s": ["gx", "gyro", "rot", "angular rate", "gx_rad_s", "rotation", "gyroscope", "rate"],
    "speed_obd_mps": ["spd", "speed", "v_obd", "obd speed", "speed_obd_mps", "obd_speed", "v"],
    "lat": ["lat", "latitude", "coords", "pos", "position", "coordinates", "coord"],
}
MISSING = {"", "n/a", "na", "nan", "null", "none", "--", "-", "?", "nil"}
FIELDS = list(FACTORS)
#: Log10 bins of the histograms a mixture is fitted on: a bound on what one group can hold.
BIN = 0.02
NUMBER = r"[+-]?(?:\d+(?:[.,]\d*)?|[.,]\d+)(?:[eE][+-]?\d+)?"


#: Blanks and minus signs that sources use for the plain ones.
BLANKS, MINUS = "\u00a0\u2007\u2009\u202f", "\u2212\u2012\u2013"
#: Declarations that are read to the driver at most, and entries that a worker's memo of texts may hold.
MOST_DECLARED, MEMO = 100_000, 50_000
PARSED = "reading_id long, field_name string, raw_value string, num double, dms_value double, can int, south boolean, told string, told_by string, grp string"

CODES = {(f, w): u for f, us in SPELLINGS.items() for u, ws in us.items() for w in ws}
WORDS = {w: f for f, ws in FIELD_WORDS.items() for w in ws}
UNITS = {f: list(us) for f, us in FACTORS.items()}
_BLANKS = str.maketrans(BLANKS + MINUS, " " * len(BLANKS) + "-" * len(MINUS))
_PLAIN = str.maketrans("\u00b2\u207b\u00b9\u2212\u00ba\u2070", "2-1-\u00b00", " \t\n\r\f\v\u00a0\u2007\u2009\u202f[].\u00b7^*\"{}")
_QUOTES = str.maketrans("{}\"'", "    ")
_CLAUSES, _CLAUSE = re.compile(r"[;|,\n]"), re.compile(r"^\s*(.+?)\s*(?:=|:|\s[iI][nN]\s)\s*(.+?)\s*$")
_DECLARED = [re.compile(p, re.I) for p in (r"^(.*)$", r"^\s*unit\s*[:=]\s*([^;]*)", r"\b(?:sent|given|recorded|measured)\s+in\s+([^;]*)", r"\bin\s+([^;]*)")]
_VALUE, _LAT = re.compile(rf"\s*({NUMBER})\s*(.*)$"), re.compile(rf"\s*[NSns]?\s*({NUMBER})")
_DMS = re.compile(r"([NSEW]?)\s*([+-]?\d{1,3})\s*(?:°|d|\s)\s*(\d{1,2})\s*(?:['′’]|m|\s)\s*(\d{1,2}(?:[.,]\d+)?)\s*(?:\"|''|″|”|s)?\s*([NSEW]?)$", re.I)
_DEG = re.compile(r"\s*[NSns]?\s*[+-]?\d{1,2}(?:[.,]\d+)?\s*°\s*[NSns]?\s*$")
_DIGITS, _POINT = re.compile(r"\s*[NSns]?\s*[+-]?(\d+)"), re.compile(r"\d[.,]\d")
_BITS = {u: 1 << k for k, u in enumerate(FACTORS["lat"])}
_SPELLED: dict[tuple[str, str], str | None] = {}


def _spelled(text: str) -> str:
    """Lower case, without blanks, dots, carets, stars and brackets; superscripts as digits."""
    return text.lower().translate(_PLAIN)


class Told:
    """What notes and declarations say, remembered per text; and the parts of a value."""

    def __init__(self, declared: dict[tuple[str, str], list[tuple]]):
        self.declared = declared
        self.notes: dict[str, dict[str, str]] = {}
        self.versions: dict[tuple, tuple[str | None, str]] = {}

    def note(self, text: str | None) -> dict[str, str]:
        """Field -> unit of a row's note; a clause about another thing tells nothing."""
        got = self.notes.get(text) if text else {}
        if got is None:
            got = {}
            for clause in _CLAUSES.split(text.translate(_QUOTES)):
                m = _CLAUSE.match(clause)
                field = m and WORDS.get(" ".join(m.group(1).lower().split()))
                unit = field and CODES.get((field, _spelled(m.group(2))))
                if unit:
                    got.setdefault(field, unit)
            _keep(self.notes, text, got)
        return got

    def declaration(self, provider: str | None, field: str, firmware: str | None) -> tuple[str | None, str]:
        """Unit that holds for a firmware, and the group that readings of one declaration form."""
        key = (provider, field, firmware)
        got = self.versions.get(key)
        if got is None:
            fw = version(firmware)
            hit = next((d for d in self.declared.get((provider, field), ()) if (d[0] is None or (fw is not None and fw >= d[0])) and (d[1] is None or (fw is not None and fw < d[1]))), None)
            span = ("*", ".".join(map(str, (fw or ())[:2]))) if hit is None else tuple("" if v is None else ".".join(map(str, v)) for v in hit[:2])
            got = (hit and hit[2], "|".join((provider or "", field, *span)))
            _keep(self.versions, key, got)
        return got


def _keep(memo: dict, key, value) -> None:
    if len(memo) >= MEMO:
        memo.clear()
    memo[key] = value


def version(text: str | None) -> tuple[int, ...] | None:
    """Dotted number as a tuple of ints, so that 1.10 follows 1.9; a part that is no number counts as -1."""
    return None if text is None else tuple(int(p) if p.isdigit() else -1 for p in text.strip().split("."))


def declared_unit(field: str, text: str | None) -> str | None:
    """Unit that a declaration's text tells for a field, or None if it says nothing useful."""
    if text is None:
        return None
    for p in _DECLARED:
        m = p.search(text)
        unit = m and CODES.get((field, _spelled(m.group(1))))
        if unit:
            return unit
    return None


def possible(raw: str, n: float) -> int:
    """Which notations of a latitude a numeral can have, as bits in the order of FACTORS: by digits, point, least and most."""
    m, n, point = _DIGITS.match(raw), abs(n), _POINT.search(raw) is not None
    whole = m.group(1) if m else ""
    deg = n <= 90 and not (len(whole) > 1 and whole[0] == "0")
    ddmm = point and 3 <= len(whole) <= 4 and n <= 9000 and n % 100 < 60
    return deg * _BITS["deg"] | ddmm * _BITS["ddmm"] | (not point and n <= 9e8) * _BITS["e7"]


def spelled_unit(field: str, text: str) -> str | None:
    """Unit code of a spelling beside a value, remembered per text."""
    key = (field, text)
    got = _SPELLED.get(key, "")
    if got == "":
        got = CODES.get((field, _spelled(text)))
        _keep(_SPELLED, key, got)
    return got


def value_parts(field: str, text: str | None) -> tuple | None:
    """(number, degrees of a dms writing, unit in the value, units of a latitude that the digits allow, south), or None."""
    if text is None:
        return None
    raw = (text if text.isascii() else text.translate(_BLANKS)).strip(" ")
    if raw.lower() in MISSING:
        return None
    if field != "lat":
        try:  # a plain number, the most frequent writing
            if "_" not in raw:
                n = float(raw)
                return (n, None, None, 0, False) if abs(n) < 1e300 else None
        except ValueError:
            pass
        m = _VALUE.match(raw)
        if not m or not (n := _number(m.group(1))) < 1e300:
            return None
        return (n, None, spelled_unit(field, m.group(2)), 0, False) if n > -1e300 else None
    south = raw[:1] in "sS" or raw[-1:] in "sS"
    m = _DMS.match(raw)
    if m:
        south = "S" in (m.group(1) + m.group(5)).upper()
        d = abs(float(m.group(2))) + float(m.group(3)) / 60 + float(m.group(4).replace(",", ".")) / 3600
        return None, -d if m.group(2).startswith("-") else d, "dms", 0, south
    m = _LAT.match(raw)
    if not m or not abs(n := _number(m.group(1))) < 1e300:
        return None
    return n, None, "deg" if "°" in raw and _DEG.match(raw) else None, possible(raw, n), south


def _number(text: str) -> float:
    return float(text.replace(",", "."))


def _parser(declared: dict):
    def parse(batches):
        told, lat_units = Told(declared), UNITS["lat"]
        for b in batches:
            rows = []
            # Repeated rows of a batch are thinned out before the shuffle.
            for rid, provider, firmware, note, *values in dict.fromkeys(zip(*(c.to_pylist() for c in b.columns))):
                said = told.note(note)
                for f, text in zip(FIELDS, values):
                    v = value_parts(f, text)
                    if v is None:
                        continue
                    n, dms, unit, can, south = v
                    by, group = "value", None
                    if unit is None and (unit := said.get(f)):
                        by = "note"
                    if unit is None:
                        unit, group = told.declaration(provider, f, firmware)
                        by = "declared" if unit else "inferred"
                    # A notation that the digits rule out is not told.
                    if unit and f == "lat" and dms is None and not can >> lat_units.index(unit) & 1:
                        unit, by, group = None, "inferred", told.declaration(provider, f, firmware)[1]
                    rows.append((rid, f, text, n, dms, can, south, unit, by, None if unit else group))
            yield arrow_batch(PARSED, rows)

    return parse


def told_units(readings: DataFrame, units: DataFrame) -> DataFrame:
    """Long rows (one per present value) with the number, the unit told and by what; repeated rows once.

    The declarations (a fixed table of the providers' fields) are read to the driver, ``MOST_DECLARED`` of them at most.
    """
    rows = units.select("provider_id", "field_name", "firmware_from", "firmware_before", "unit_text").where("provider_id is not null and field_name is not null").distinct().limit(MOST_DECLARED + 1).collect()
    if len(rows) > MOST_DECLARED:
        raise ValueError(f"more than {MOST_DECLARED} declarations")
    declared: dict[tuple[str, str], list[tuple]] = {}
    for r in rows:
        declared.setdefault((r[0], r[1]), []).append((version(r[2]), version(r[3]), declared_unit(r[1], r[4])))
    for d in declared.values():  # of overlapping ones the later start holds
        d.sort(key=lambda x: (x[0] or (), x[1] or (), x[2] or ""), reverse=True)
    parsed = readings.select("reading_id", "provider_id", "firmware", "unit_note", *FIELDS).mapInArrow(_parser(declared), PARSED)
    # distinct() keeps all columns in the exchange: the fits and the assignment share it, so each value is parsed once.
    return hashed(parsed, "reading_id").distinct()


def _si(unit: Column) -> Column:
    """The value on the project's scale, for a unit column."""
    n = F.col("num")
    table = ", ".join(f"'{f}|{u}', {k!r}D" for f, us in FACTORS.items() for u, k in us.items() if u not in ("ddmm", "dms"))
    whole = F.floor(F.abs(n) / 100)
    packed = F.signum(n) * (whole + (F.abs(n) - whole * 100) / 60)
    linear = n * F.try_element_at(F.expr(f"map({table})"), F.concat("field_name", F.lit("|"), unit))
    v = F.when(F.col("dms_value").isNotNull(), F.col("dms_value")).when(unit == "ddmm", packed).otherwise(linear)
    return F.when(F.col("south"), -F.abs(v)).otherwise(v)


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    """EM over one group's histogram: weights of components at fixed offsets from the field's own scale.

    Components share the field's mean and spread (from readings with told units); only weights are free. A sparse
    prior (alpha 0.5) favours few units per group. Bounded: rows are log bins.
    """
    pdf = pdf[pdf["_group"].notna() & pdf["bin"].notna()]
    if not len(pdf):
        return pd.DataFrame(columns=["_g", "_f2", "units", "weight", "centre", "spread"], dtype=object)
    field = pdf["field_name"].iloc[0]
    units = [u for u in FACTORS[field] if u != "dms"]
    off = -np.log10([FACTORS[field][u] for u in units])
    x, n = pdf["bin"].to_numpy(float) * BIN, pdf["n"].to_numpy(float)
    mu, sd = pdf["mu"].iloc[0], pdf["sd"].iloc[0]
    if not np.isfinite(mu):  # nothing told anywhere: the project's unit is taken as the most frequent one
        mu = float(np.average(x, weights=n))
    sd = float(np.clip(sd if np.isfinite(sd) else 0.5, 0.1, 2.0))
    ll = -0.5 * ((x[:, None] - (mu + off)[None, :]) / sd) ** 2
    w = np.full(len(units), 1.0 / len(units))
    for _ in range(200):
        p = np.log(w)[None, :] + ll
        r = np.exp(p - p.max(1, keepdims=True))
        r /= r.sum(1, keepdims=True)
        new = np.maximum((n[:, None] * r).sum(0) - 0.5, 1e-6)
        new /= new.sum()
        done = np.abs(new - w).max() < 1e-7
        w = new
        if done:
            break
    return pd.DataFrame({"_g": pdf["_group"].iloc[0], "_f2": field, "units": [units], "weight": [w.tolist()], "centre": [(mu + off).tolist()], "spread": [sd]})


def resolve_units(readings: DataFrame, units: DataFrame, weak: float = 0.9) -> DataFrame:
    """(reading_id, field_name, raw_value, unit_code, value, told_by, posterior, uncertain), one row per value."""
    told = told_units(readings, units)
    # Log bins of told values on the project's scale (no group), of the others as they stand.
    known = F.col("told").isNotNull()
    log_bin = F.floor(F.log10(F.abs(F.when(known, _si(F.col("told"))).otherwise(F.col("num")))) / BIN)
    counts = told.groupBy(F.when(~known, F.col("grp")).alias("_group"), "field_name", log_bin.alias("bin")).agg(F.count("*").alias("n"))
    # No filters here: they would go below the exchange of the parsed values, which then could not be shared.
    x, n = F.col("bin") * BIN, F.when(F.col("_group").isNull() & F.col("bin").isNotNull(), F.col("n"))
    scale = counts.groupBy(F.col("field_name").alias("_f")).agg((F.sum(n * x) / F.sum(n)).alias("mu"), (F.sum(n * x * x) / F.sum(n)).alias("m2"))
    scale = scale.select("_f", "mu", F.sqrt(F.greatest(F.col("m2") - F.col("mu") ** 2, F.lit(0.0))).alias("sd"))
    # One row per field is broadcast: four at most.
    hist = counts.join(F.broadcast(scale), F.col("field_name").eqNullSafe(F.col("_f")), "left").drop("_f")
    fitted = hist.groupBy("_group", "field_name").applyInPandas(_fit, "_g string, _f2 string, units array<string>, weight array<double>, centre array<double>, spread double")
    j = told.join(fitted, ~known & (F.col("grp") == F.col("_g")) & (F.col("field_name") == F.col("_f2")), "left")
    log = F.log10(F.abs(F.col("num")))
    names = F.array(*[F.lit(u) for u in FACTORS["lat"]])
    possible = lambda u: F.getbit(F.col("can"), F.array_position(names, u).cast("int") - 1) == 1
    scores = F.transform(
        F.col("units"),
        lambda u, i: F.struct(
            (
                F.log(F.element_at("weight", i + 1))
                - F.when(F.col("num") == 0, 0.0).otherwise(0.5 * F.pow((log - F.element_at("centre", i + 1)) / F.col("spread"), 2))
                - F.when((F.col("field_name") == "lat") & ~possible(u), 1e6).otherwise(0.0)
            ).alias("s"),
            u.alias("u"),
        ),
    )
    j = j.withColumn("_scores", F.when(~known, scores)).withColumn("_best", F.array_max("_scores"))
    post = 1 / F.aggregate("_scores", F.lit(0.0), lambda a, s: a + F.exp(s["s"] - F.col("_best.s")))
    first = reduce(lambda c, f: c.when(F.col("field_name") == f, F.lit(UNITS[f][0])), FIELDS, F.when(F.lit(False), F.lit("")))
    j = j.withColumn("unit_code", F.coalesce("told", F.col("_best.u"), first)).withColumn("posterior", F.when(known, 1.0).otherwise(post))
    return j.select(
        "reading_id", "field_name", "raw_value", "unit_code", _si(F.col("unit_code")).alias("value"), "told_by",
        "posterior", (F.coalesce("posterior", F.lit(0.0)) < weak).alias("uncertain"),
    )


def foreign_units(readings: DataFrame, units: DataFrame) -> DataFrame:
    """(reading_id, field_name, unit_code) of values recorded in another unit than the project's."""
    own = [next(iter(FACTORS[f])) for f in FIELDS]
    return resolve_units(readings, units).where(~F.col("unit_code").isin(own)).select("reading_id", "field_name", "unit_code").distinct()
