"""Rule engine for records, legacy tables and datasets.

Rules on names and types are decided on the driver; every rule on data is one aggregate expression, and all of a
frame's expressions run in one ``agg``. Order rules add one windowed pass over the row's physical position, which the
caller names (``order``), since a DataFrame has no order of its own. Findings never raise; the legacy validators do.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadgrain import schema as S
from roadgrain.errors import AlignmentNotice, FrameError, MeaningError, UnitError
from roadgrain.functions.scalars import flatten_structs
from roadgrain.operators.aggregates import rest_norm
from roadgrain.operators.asof import BUCKET, alignment_metrics, interval_case
from roadgrain.operators.introspect import presence_exprs
from roadgrain.operators.position import ORDER, out_of_order, positioned, run_counts
from roadgrain.operators.windows import rest_flag

LEVELS = ("basic", "strict", "manifest", "full")
EXIT_OK, EXIT_INVALID, EXIT_MISSING, EXIT_USAGE, EXIT_INTERNAL = 0, 1, 2, 3, 4


@dataclass
class Report:
    """ok exactly if there are no errors."""

    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    profile: str | None = None
    level: str = "basic"
    counts: dict[str, int] = field(default_factory=dict)
    n_rows: int | None = None

    @property
    def ok(self) -> bool:
        return not self.errors

    def as_dict(self) -> dict:
        kinds = [{"rule": k, "count": v} for k, v in sorted(self.counts.items()) if v]
        return {"status": "pass" if self.ok else "fail", "level": self.level, "profile": self.profile, "records_checked": self.n_rows, "errors": self.errors, "warnings": self.warnings, "findings": kinds}


def data_rules(columns: list[str], level: str = "basic") -> dict[str, tuple[str, Column]]:
    """Rule id -> (severity, number of rows that break it), for the columns there are."""
    have, n = set(columns), F.count_if
    rules: dict[str, tuple[str, Column]] = {}
    if {"lat", "lon"} & have:
        for c, lim in (("lat", 90), ("lon", 180)):
            if c in have:
                rules[f"{c}_range"] = ("error", n((F.col(c) < -lim) | (F.col(c) > lim)))
    if "heading_deg" in have:
        rules["heading_range"] = ("error", n((F.col("heading_deg") < 0) | (F.col("heading_deg") >= 360)))
    for c in ("speed_mps", "speed_obd_mps"):
        if c in have:
            rules[f"{c}_negative"] = ("error", n(F.col(c) < 0))
    if level in ("strict", "full"):
        if {"lat", "lon"} <= have:
            rules["no_fix"] = ("error", F.when(n(F.col("lat").isNotNull() & F.col("lon").isNotNull()) == 0, 1).otherwise(0))
        if "speed_mps" in have:
            rules["speed_high"] = ("warning", n(F.col("speed_mps") > 70))
            rules["speed_impossible"] = ("warning", n(F.col("speed_mps") >= 100))
        for g in ("gyro", "magneto"):
            cs = [c for c in S.cols(g) if c in have]
            if cs:
                zero = F.bool_and(sum((F.when(F.col(c).isNull() | (F.col(c) == 0), 0).otherwise(1) for c in cs), F.lit(0)) == 0)
                some = F.bool_or(sum((F.when(F.col(c) == 0, 1).otherwise(0) for c in cs), F.lit(0)) > 0)
                rules[f"{g}_zero_filled"] = ("warning", F.when(zero & some, 1).otherwise(0))
    return rules


def column_rules(df: DataFrame, profile: str, level: str, inherited: set[str] = frozenset()) -> tuple[list[str], list[str]]:
    """Errors and warnings that names and types alone decide."""
    have, err, warn = set(df.columns), [], []
    missing = [f.name for f in S.schema_for_profile(profile) if f.name not in have]
    if missing:
        err.append(f"mandatory columns of profile {profile} are absent: {missing}")
    unknown = sorted(c for c in have if c not in S.KNOWN and not c.startswith("x_") and c not in S.EXCLUDED)
    if unknown:
        warn.append(f"columns outside the catalogue without the x_ prefix: {unknown}")
    for g in ("gyro", "magneto"):
        part = have & set(S.cols(g))
        if part and part != set(S.cols(g)):
            err.append(f"{g} columns come all or none; there are only {sorted(part)}")
    if level in ("strict", "full"):
        bad = sorted(have & set(S.EXCLUDED))
        if bad:
            err.append(f"columns of higher layers must not stand in a record: {bad}")
        types = dict(df.dtypes)
        wrong = [f"{c}: {types[c]}, not {S.KNOWN[c].dataType.simpleString()}" for c in df.columns if c in S.KNOWN and types[c] != S.KNOWN[c].dataType.simpleString()]
        if wrong:
            err.append(f"types differ from the catalogue: {wrong}")
        for c in ("device_id", "trip_id"):
            if c not in have and c not in inherited:
                err.append(f"{c} is neither a column nor inherited")
    return err, warn


def order_violations(df: DataFrame, col: str, order: list[str], by: list[str] | None = None, strict: bool = False) -> int:
    """Action: rows that go back in time (or stand still, if strict) in the given physical order."""
    return out_of_order(df, col, order, by, strict).count()


#: Mean norm that a frame promises at rest and its tolerance (m/s2); partial takes its residual.
GRAVITY = {"raw": (9.81, 1.0), "compensated": (0.0, 1.0), "partial": (None, 0.05 * 9.80665)}


def gravity_by_period(df: DataFrame, periods: list[tuple], by: list[str], ts: str = "ts") -> DataFrame:
    """(period, frame, rest_norm, n_rest, off): each period's mean norm at rest against what its frame promises.

    ``periods`` are (start, end, frame, residual_g); rows outside of all belong to period -1 of frame raw. A period
    without rows at rest has no row.
    """
    at = interval_case(F.col(ts), [(p[0], p[1], i) for i, p in enumerate(periods)], -1)
    x = rest_flag(df, by, ts).withColumn("period", at)
    g = rest_norm(x, ["period"])
    facts = [(-1, "raw", None), *((i, p[2] or "raw", p[3] if len(p) > 3 else None) for i, p in enumerate(periods))]
    pick = lambda f: reduce(lambda c, x: c.when(F.col("period") == x[0], F.lit(f(x))), facts[1:], F.when(F.col("period") == -1, F.lit(f(facts[0]))))
    target = pick(lambda x: float((x[2] or 0.0) * 9.80665) if x[1] == "partial" else GRAVITY[x[1]][0])
    off = F.abs(F.col("rest_norm") - target) > pick(lambda x: GRAVITY[x[1]][1])
    return g.where("rest_norm is not null").select("period", pick(lambda x: x[1]).alias("frame"), "rest_norm", "n_rest", off.alias("off"))


def validate(df: DataFrame, level: str = "basic", profile: str | None = None, order: list[str] | None = None, by: list[str] | None = None, inherited: set[str] = frozenset(), frame: str | None = None, residual_g: float | None = None, periods: list[tuple] | None = None) -> Report:
    """Action: one aggregation (and one windowed pass with ``order``); accumulates findings, never raises on data.

    Gravity is checked per period of ``periods``, or for one ``frame``, at level strict and above.
    """
    if level not in LEVELS:
        raise ValueError(f"no level {level!r}")
    rules = data_rules(df.columns, level)
    row = df.agg(F.count("*").alias("_n"), *[c.alias(f"p_{g}") for g, c in presence_exprs(df.columns).items()], *[c.alias(k) for k, (_, c) in rules.items()]).first()
    profile = profile or ("full" if row["p_gyro"] else "imu" if row["p_imu"] else "core")
    err, warn = column_rules(df, profile, level, inherited)
    rep = Report(err, warn, profile, level, n_rows=row["_n"])
    for k, (severity, _) in rules.items():
        rep.counts[k] = row[k] or 0
        if rep.counts[k]:
            (rep.errors if severity == "error" else rep.warnings).append(f"{k}: {rep.counts[k]} rows")
    if order and "ts" in df.columns:
        k = order_violations(df, "ts", order, by, strict=level in ("strict", "full"))
        rep.counts["ts_order"] = k
        if k:
            rep.errors.append(f"ts_order: {k} rows")
    periods = periods if periods is not None else [(None, None, frame, residual_g)] if frame else None
    if periods is not None and level in ("strict", "full") and profile in ("imu", "full") and {"ts", "speed_mps", "ax_mps2", "ay_mps2", "az_mps2"} <= set(df.columns):
        bad = [r for r in gravity_by_period(df, periods, by or []).collect() if r["off"]]
        rep.counts["gravity"] = len(bad)
        rep.errors += [f"gravity: the mean norm at rest {r['rest_norm']:.3f} doesn't fit frame {r['frame']} of period {r['period']}" for r in bad]
    return rep


def rule_counts(df: DataFrame, level: str = "strict", by: list[str] | None = None) -> DataFrame:
    """Lazy form of the data rules: one row (or one per key) with a count per rule."""
    rules = data_rules(df.columns, level)
    return (df.groupBy(*by) if by else df.groupBy()).agg(F.count("*").alias("n_rows"), *[c.cast("long").alias(k) for k, (_, c) in rules.items()])


# Legacy tables: raise on the first failure.


#: The units of the legacy tables.
UNITS = {"speed": "m/s", "acceleration": "m/s^2", "gyro": "rad/s"}


def check_units(units: dict[str, str] | None) -> None:
    """All three units must be named, and be these."""
    bad = {k: (units or {}).get(k) for k, v in UNITS.items() if str((units or {}).get(k)).strip() != v}
    if bad:
        raise UnitError(f"units must be {UNITS}; got {bad}")


def check_increasing(df: DataFrame, col: str = "timestamp_ns", order: list[str] | None = None) -> None:
    """The column is there, whole, of an integer type and strictly increasing in the physical order."""
    if col not in df.columns:
        raise MeaningError(f"no column {col}")
    if not isinstance(df.schema[col].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        raise MeaningError(f"{col} is no integer column")
    if order is None:
        df = positioned(df)
        nulls, back, mixed = run_counts(df, col, strict=True).first()
        if mixed and not nulls:
            back = order_violations(df, col, ORDER, strict=True)
    else:
        nulls = df.where(F.col(col).isNull()).limit(1).count()
        back = 0 if nulls else order_violations(df, col, order, strict=True)
    if nulls:
        raise MeaningError(f"{col} has nulls")
    if back:
        raise MeaningError(f"{col} is not strictly increasing")


def _legacy(df: DataFrame, name: str, order: list[str] | None, finite: dict[str, tuple[float | None, float | None]], soft: dict[str, float] | None = None) -> tuple[DataFrame, list[str]]:
    want = S.LEGACY[name]
    absent = [f.name for f in want if not f.nullable and f.name not in df.columns]
    if absent:
        raise FrameError(f"{name}: columns are absent: {absent}")
    use = [f for f in want if f.name in df.columns]
    cast = df.withColumns({f.name: F.col(f.name).try_cast(f.dataType.simpleString()) for f in use})
    checks = {f"{f.name} is null or unreadable": F.count_if(F.col(f.name).isNull()) for f in use if not f.nullable}
    for c, (lo, hi) in finite.items():
        if c in df.columns:
            x = F.col(c)
            bad = F.isnan(x) | (x == float("inf")) | (x == float("-inf"))
            bad = bad if lo is None else bad | (x < lo)
            checks[f"{c} is out of bounds"] = F.count_if(bad if hi is None else bad | (x > hi))
    for c, lim in (soft or {}).items():
        checks[f"~{c} is over {lim}"] = F.count_if(F.abs(c) > lim)
    row = cast.agg(*[e.alias(k) for k, e in checks.items()]).first()
    for k in checks:
        if row[k] and not k.startswith("~"):
            raise MeaningError(f"{name}: {k} in {row[k]} rows")
    check_increasing(cast, "timestamp_ns", order)
    return cast.select(*[f.name for f in use], *[c for c in df.columns if c not in {f.name for f in use}]), [f"{name}: {k[1:]} in {row[k]} rows" for k in checks if k.startswith("~") and row[k]]


def validate_trajectory(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Action: checked and coerced trajectory; raises on the first rule broken."""
    return _legacy(df, "trajectory", order, {"lat": (-90, 90), "lon": (-180, 180), "speed_mps": (0, None), "alt": (None, None)})[0]


def validate_imu(df: DataFrame, order: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Action: as above for the six axes; values over 50 m/s2 or 20 rad/s only warn."""
    axes = [f"{s}_{a}" for s in ("acc", "gyro") for a in "xyz"]
    return _legacy(df, "imu", order, {c: (None, None) for c in axes}, {c: 50.0 if c.startswith("acc") else 20.0 for c in axes})


def validate_events(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    return _legacy(df, "events", order, {})[0]


def check_alignment(left: DataFrame, right: DataFrame, tolerance_ns: int = 5_000_000, on: str = "timestamp_ns", raise_error: bool = False) -> dict:
    """Action: alignment metrics; no pairs raise, more than tolerated warns or raises."""
    m = alignment_metrics(left, right, on, tolerance_us=tolerance_ns, bucket_us=BUCKET * 1000).first().asDict()
    if not m["pairs"]:
        raise MeaningError("the tables have no pairs in time")
    if m["exceeds"]:
        text = f"{m['exceeds']} of {m['pairs']} pairs lie more than {tolerance_ns} ns apart"
        if raise_error:
            raise MeaningError(text)
        warnings.warn(text, AlignmentNotice, stacklevel=2)
    return m


def validate_tables(tables: dict[str, DataFrame], units: dict[str, str] | None = None, tolerance_ns: int = 5_000_000) -> tuple[bool, dict, dict[str, DataFrame]]:
    """Action: units, each table, then the alignment; (ok, report, coerced tables)."""
    rep, out = {"errors": [], "warnings": []}, {}
    try:
        check_units(units)
        for name, f in (("trajectory", validate_trajectory), ("imu", validate_imu), ("events", validate_events)):
            if name in tables:
                got = f(tables[name])
                out[name], more = got if isinstance(got, tuple) else (got, [])
                rep["warnings"] += more
        if {"trajectory", "imu"} <= set(out):
            with warnings.catch_warnings(record=True) as seen:
                warnings.simplefilter("always")
                rep["alignment"] = check_alignment(out["trajectory"], out["imu"], tolerance_ns)
            rep["warnings"] += [str(w.message) for w in seen]
    except (FrameError, MeaningError) as e:
        rep["errors"].append(str(e))
    return not rep["errors"], rep, out


def validate_schema(df: DataFrame, table: str, allow_extra: bool = True, strict_types: bool = False) -> list[str]:
    """Action: problems of a frame against a named table's whole schema; nullable fields must exist as well.

    Without strict types a column fits if every value can be read as the type. A null lat or lon is out of bounds here.
    """
    if table not in S.TABLES:
        raise KeyError(f"no table {table!r}")
    want, out, checks = S.TABLES[table], [], {}
    out += [f"{f.name} is absent" for f in want if f.name not in df.columns]
    if not allow_extra:
        out += [f"{c} is no column of {table}" for c in df.columns if c not in want.fieldNames()]
    types = dict(df.dtypes)
    for f in want:
        if f.name in types:
            to = f.dataType.simpleString()
            if types[f.name] != to and strict_types:
                out.append(f"{f.name} is {types[f.name]}, not {to}")
            elif types[f.name] != to:
                checks[f"{f.name} can't be read as {to}"] = F.count_if(F.col(f.name).isNotNull() & F.col(f.name).cast("string").try_cast(to).isNull())
    for c, lim in (("lat", 90), ("lon", 180)):
        if c in types and c in want.fieldNames():
            checks[f"{c} is out of bounds"] = F.count_if(~F.coalesce(F.col(c).try_cast("double").between(-lim, lim), F.lit(False)))
    if checks:
        row = df.agg(*[e.alias(k) for k, e in checks.items()]).first()
        out += [f"{k} in {row[k]} rows" for k in checks if row[k]]
    return out


def validate_nested(df: DataFrame) -> DataFrame:
    """Lazy: one row with a count per broken rule, over records flattened to dotted columns or still nested.

    Required leaves, bounds and allowed values come from the schema; a column that the schema doesn't know counts all
    its filled rows under ``unknown``. An absent optional field breaks nothing.
    """
    flat = flatten_structs(df)
    have, out = set(flat.columns), {}
    rows = F.count("*")
    for path in S.NESTED_REQUIRED:
        out[f"no_{path}"] = F.count_if(F.col(f"`{path}`").isNull()) if path in have else rows
    for path, (_, lo, hi, allowed) in S.NESTED_PATHS.items():
        if path not in have:
            continue
        c = F.col(f"`{path}`")
        if lo is not None or hi is not None:
            v = c.try_cast("double")
            out[f"range_{path}"] = F.count_if((v < lo if lo is not None else F.lit(False)) | (v > hi if hi is not None else F.lit(False)))
        if allowed:
            out[f"value_{path}"] = F.count_if(~c.isin(allowed))
    if "events" in have and "severity" in flat.schema["events"].simpleString():
        out["value_events.severity"] = F.count_if(F.exists("events", lambda e: e["severity"].isNotNull() & ~e["severity"].isin(S.SEVERITIES)))
    odd = [c for c in flat.columns if c not in S.NESTED_PATHS and c.split(".")[0] != "context"]
    out["unknown"] = F.sum(sum((F.col(f"`{c}`").isNotNull().cast("int") for c in odd), F.lit(0))) if odd else F.lit(0)
    return flat.agg(rows.alias("n_rows"), *[e.cast("long").alias(k) for k, e in out.items()])
