"""Manifests: reading, checking, inheritance and cross-checks. Driver-side, on files of a few kilobytes."""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from dataclasses import dataclass, field
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadgrain.operators.asof import interval_case

PROFILES = ("core", "imu", "full")
FRAMES = ("raw", "compensated", "partial")
CARRIERS = ("mounted_driving", "mounted_idle", "unplugged", "desk", "handheld", "unknown")
FORMATS = ("parquet", "csv", "json", "jsonl")


def normalise(x):
    """YAML dates as ISO text, at any depth."""
    if isinstance(x, dict):
        return {k: normalise(v) for k, v in x.items()}
    if isinstance(x, list):
        return [normalise(v) for v in x]
    if isinstance(x, dt.datetime):
        return (x if x.tzinfo else x.replace(tzinfo=dt.timezone.utc)).isoformat()
    return x.isoformat() if isinstance(x, dt.date) else x


def load_yaml(path: str | Path) -> dict:
    with open(path, encoding="utf-8") as f:
        return normalise(yaml.safe_load(f)) or {}


@dataclass
class ManifestReport:
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return not self.errors


def check(m: dict, compat: bool = True) -> ManifestReport:
    """Rules of a manifest. ``compat`` takes upper case ids, csv files and nulls as warnings, as shipped files have them."""
    r = ManifestReport()
    soft = r.warnings if compat else r.errors
    one_of = lambda k, v, allowed: v is None or v in allowed or r.errors.append(f"{k} is {v!r}, not one of {list(allowed)}")
    if not m.get("dataset_id"):
        r.errors.append("dataset_id is absent")
    elif not re.fullmatch(r"[a-z0-9][a-z0-9_-]*", str(m["dataset_id"])):
        (soft if re.fullmatch(r"[a-z0-9][a-z0-9_-]*", str(m["dataset_id"]).lower()) else r.errors).append("dataset_id is not lower case letters, digits, - and _")
    one_of("profile", m.get("profile"), PROFILES)
    version = m.get("schema_version")
    if version is None:
        soft.append("schema_version is absent")
    elif not re.fullmatch(r"[a-z]+-\d+(?:\.\d+)*", str(version)):
        r.errors.append("schema_version is no name and dotted number")
    if not m.get("source"):
        soft.append("source is absent")
    if m.get("country") is not None and len(str(m["country"])) != 2:
        r.errors.append("country is no two-letter code")
    periods = m.get("acc_periods") or []
    spans = []
    for i, p in enumerate(periods):
        for k in ("start", "end", "frame"):  # an open end is written as present
            if p.get(k) is None:
                soft.append(f"acc_periods[{i}] has no {k}")
        one_of(f"acc_periods[{i}].frame", p.get("frame"), FRAMES)
        if p.get("frame") == "partial" and p.get("residual_g") is None:
            r.errors.append(f"acc_periods[{i}] is partial but has no residual_g")
        if p.get("start") and p.get("end") not in (None, "present") and str(p["end"]) < str(p["start"]):
            r.errors.append(f"acc_periods[{i}] ends before it starts")
        spans.append((str(p.get("start") or ""), "9999" if p.get("end") in (None, "present") else str(p["end"])))
    spans.sort()
    if any(b[0] < a[1] for a, b in zip(spans, spans[1:])):
        r.warnings.append("acc_periods overlap; the first that holds wins")
    for i, s in enumerate(m["sensors"].values() if isinstance(m.get("sensors"), dict) else m.get("sensors") or []):
        if isinstance(s, dict) and "burst" in (s.get("sampling_mode"), s.get("mode")) and not (s.get("burst_size") and s.get("burst_rate_hz")):
            r.errors.append(f"sensor {i} is in burst mode without burst_size and burst_rate_hz")
        if isinstance(s, dict) and "rate_hz" in s and s["rate_hz"] is None:
            soft.append(f"sensor {i} has a null rate_hz")
        elif isinstance(s, dict) and "rate_hz" in s and not (isinstance(s["rate_hz"], (int, float)) and s["rate_hz"] > 0):
            r.errors.append(f"sensor {i} has a rate_hz that is no positive number")
    for i, t in enumerate(m.get("trip_carrier_states") or []):
        one_of(f"trip_carrier_states[{i}]", t.get("carrier_state"), CARRIERS)
        if not t.get("trip_id"):
            r.errors.append(f"trip_carrier_states[{i}] has no trip_id")
    for i, f in enumerate(m.get("data_files") or []):
        if not f.get("path"):
            r.errors.append(f"data_files[{i}] has no path")
        fmt = f.get("format", "parquet")
        if fmt not in FORMATS:
            r.errors.append(f"data_files[{i}] has the format {fmt!r}")
        elif fmt != "parquet":
            soft.append(f"data_files[{i}] is {fmt}, not parquet")
    period = m.get("period") or {}
    if period.get("start") and period.get("end") not in (None, "present") and str(period["end"]) < str(period["start"]):
        r.errors.append("period ends before it starts")
    return r


def validate_manifest(path: str | Path, compat: bool = True) -> ManifestReport:
    """Report of a manifest file; a missing or unreadable one is not ok."""
    try:
        m = load_yaml(path)
    except FileNotFoundError:
        return ManifestReport([f"no file {path}"])
    except yaml.YAMLError as e:
        return ManifestReport([f"no YAML: {str(e).splitlines()[0]}"])
    return check(m, compat) if isinstance(m, dict) else ManifestReport(["the manifest is no mapping"])


def validate_legacy(path: str | Path) -> tuple[bool, str]:
    """Legacy dataset.yaml: every table must exist (readability is Parquet's own magic bytes)."""
    r = validate_manifest(path)
    m = load_yaml(path) if Path(path).exists() else {}
    tables = m.get("tables") or {}
    for name, where in tables.items():
        p = Path(path).parent / (where if isinstance(where, str) else where.get("path", ""))
        if not p.exists():
            r.errors.append(f"table {name} has no file {p.name}")
        elif p.is_file() and p.read_bytes()[:4] not in (b"PAR1", b""):
            r.errors.append(f"table {name} is no Parquet file")
    return r.ok, "; ".join(r.errors) or f"{len(tables)} tables"


def validate_legacy_dict(path: str | Path) -> dict:
    ok, text = validate_legacy(path)
    return {"ok": ok, "message": text}


def _names(block) -> list[str]:
    return [str(x.get("name") or x.get("id") or x.get("device_id")) if isinstance(x, dict) else str(x) for x in block or []]


def devices(m: dict) -> list[str]:
    hw = m.get("hardware") or {}
    return _names(hw.get("devices")) if isinstance(hw, dict) else _names(hw)


def trip_names(m: dict) -> list[str]:
    """Trips that the manifest names, by their carrier states or a plain list."""
    return list(dict.fromkeys([str(t["trip_id"]) for t in m.get("trip_carrier_states") or [] if t.get("trip_id")] or _names(m.get("trips"))))


def config_history(spark: SparkSession, m: dict) -> DataFrame:
    """(ts, profile, changes): the configuration timeline, to be joined with ``operators.asof.step_value``."""
    rows = [(str(c.get("timestamp")), c.get("profile"), str(c.get("changes") or {})) for c in m.get("config_history") or []]
    return spark.createDataFrame(rows, "t string, profile string, changes string").select(F.try_to_timestamp("t").alias("ts"), "profile", "changes")


def profile(m: dict) -> str:
    return m.get("profile") or "imu"


def declared_sensors(m: dict) -> list[str]:
    s = m.get("sensors") or {}
    return sorted(k for k, v in s.items() if v not in (None, False) and not (isinstance(v, dict) and v.get("available") is False)) if isinstance(s, dict) else sorted(_names(s))


def has_declared_gyro(m: dict) -> bool:
    return any("gyro" in s for s in declared_sensors(m))


def acc_periods(m: dict, residual: bool = False) -> list[tuple]:
    """(start, end, frame) of each period, with its residual_g on demand."""
    return [(p.get("start"), p.get("end"), p.get("frame", "raw"), *([p.get("residual_g")] if residual else [])) for p in m.get("acc_periods") or []]


def acc_frame(m: dict, ts):
    """Column of the accelerometer frame at ts: the first period that holds it, raw by default."""
    return interval_case(ts, acc_periods(m), "raw")


def accepted_rows(df: DataFrame, m: dict, paper: str, ts: str = "ts") -> DataFrame:
    """Rows whose frame the named use accepts; without a list all rows."""
    use = next((p for p in m.get("papers_using") or [] if p.get("id") == paper or p.get("title") == paper), {})
    ok = use.get("accept_acc_periods")
    return df.where(acc_frame(m, F.col(ts)).isin(list(ok))) if ok else df


def inherit(df: DataFrame, m: dict) -> DataFrame:
    """device_id and trip_id: the row's, else the only device or trip of the manifest, else (trips) the file's name."""
    out, dev, trips = {}, devices(m), trip_names(m)
    base = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1)
    for c, names in (("device_id", dev), ("trip_id", trips)):
        have = F.col(c) if c in df.columns else F.lit(None).cast("string")
        if len(names) == 1:
            out[c] = F.coalesce(have, F.lit(names[0]))
        elif c == "trip_id":
            try:
                df.select("_metadata.file_name")
            except Exception:
                if c not in df.columns:
                    raise ValueError("trip_id can't be resolved") from None
                continue
            out[c] = F.coalesce(have, base)
        elif c not in df.columns:
            raise ValueError(f"{c} can't be resolved: the manifest names {len(names)}")
    return df.withColumns(out)


#: What a manifest calls the sensors whose groups a frame can be asked for.
SENSOR_GROUPS = {"gps": "gps", "gnss": "gps", "accelerometer": "imu", "accel": "imu", "imu": "imu", "gyroscope": "gyro", "gyro": "gyro", "magnetometer": "magneto", "magneto": "magneto", "obd": "obd", "io": "io"}


def declared_rows(m: dict) -> int | None:
    """Rows that the manifest declares: ``records``, or the volume's messages or rows."""
    v = m.get("volume") or {}
    return next((int(x) for x in (m.get("records"), v.get("n_messages"), v.get("rows"), v.get("n_rows")) if isinstance(x, (int, float))), None)


def disagreements(df: DataFrame, m: dict) -> DataFrame:
    """One row: rows whose own device or trip is not one the manifest names (the row wins, this is a warning), the rows
    there are and are declared, and per declared sensor whether the frame has it (null where nothing is declared)."""
    from roadgrain.operators.introspect import presence_exprs

    dev, trips, sensors = devices(m), trip_names(m), {SENSOR_GROUPS.get(s.lower()) for s in declared_sensors(m)} - {None}
    f = lambda c, names: F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(names)) if names and c in df.columns else F.lit(0)
    have = [(e if g in sensors else F.when(F.lit(not sensors), F.lit(None)).otherwise(~e)).alias(f"sensor_{g}_as_declared") for g, e in presence_exprs(df.columns).items()]
    n = declared_rows(m)
    return df.agg(F.count("*").alias("n_rows"), F.lit(n).cast("long").alias("declared_rows"), f("device_id", dev).alias("other_device"), f("trip_id", trips).alias("other_trip"), *have)


def device_rule(columns: list[str], m: dict, files: list[str]) -> list[str]:
    """With several devices the rows must tell theirs, or the files' names must begin with it."""
    dev = devices(m)
    if len(dev) < 2 or "device_id" in columns:
        return []
    odd = [f for f in files if not any(Path(f).name.startswith(f"{d}_") for d in dev)]
    return [f"{len(dev)} devices, but neither a device_id column nor <device>_ file names: {odd}"] if odd else []


def carrier_states(spark: SparkSession, m: dict) -> DataFrame:
    rows = [(t.get("trip_id"), t.get("carrier_state"), t.get("confidence")) for t in m.get("trip_carrier_states") or []]
    return spark.createDataFrame(rows, "trip_id string, carrier_state string, confidence string")


def emit(dataset_id: str, df: DataFrame, profile_name: str, frame: str = "raw", path: str | Path | None = None, data_path: str = "data.parquet") -> dict:
    """Action: a manifest whose period and acc_period are the frame's first and last time."""
    a = df.agg(F.min("ts").alias("a"), F.max("ts").alias("z"), F.count("*").alias("n"), F.countDistinct("trip_id").alias("t") if "trip_id" in df.columns else F.lit(0).alias("t")).first()
    iso = lambda x: None if x is None else x.replace(tzinfo=dt.timezone.utc).isoformat()
    m = {"dataset_id": dataset_id, "profile": profile_name, "period": {"start": iso(a["a"]), "end": iso(a["z"])}, "acc_periods": [{"start": iso(a["a"]), "end": iso(a["z"]), "frame": frame}], "volume": {"n_messages": a["n"], "n_trips": a["t"]}, "data_files": [{"path": data_path, "format": "parquet"}]}
    if path:
        Path(path).write_text(yaml.safe_dump(m, sort_keys=False), encoding="utf-8")
    return m


def index(spark: SparkSession, path: str | Path) -> DataFrame:
    """Catalogue of datasets as a small frame."""
    m = load_yaml(path)
    rows = [(str(d.get("id") or d.get("dataset_id") or d.get("slug")), d.get("rows"), d.get("trips"), ",".join(map(str, d.get("sensors") or []))) for d in m.get("datasets") or []]
    return spark.createDataFrame(rows, "dataset_id string, n_rows long, n_trips long, sensors string")


def sha256(path: str | Path) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def verify_sums(folder: str | Path, sums: str = "SHA256SUMS") -> dict[str, bool]:
    """File -> whether its digest is the listed one."""
    lines = (Path(folder) / sums).read_text().splitlines()
    pairs = [x.split(maxsplit=1) for x in lines if x.strip()]
    return {n.lstrip("*"): (Path(folder) / n.lstrip("*")).exists() and sha256(Path(folder) / n.lstrip("*")) == d for d, n in pairs}


def validate_dataset(spark: SparkSession, path: str | Path, level: str = "basic"):
    """Action: a dataset's manifest and data under the manifest's profile: (manifest report, data report or None, cross-check).

    What can't be read is an error of the manifest report, never an exception.
    """
    from roadgrain.operators.position import ORDER
    from roadgrain.sources.readers import manifest_files, read
    from roadgrain.validate import order_violations, validate

    p = Path(path)
    if p.is_dir():
        p = next((p / n for n in ("manifest.yaml", "dataset.yaml") if (p / n).exists()), p / "manifest.yaml")
    m = validate_manifest(p)
    if level == "manifest" or not p.exists():
        return m, None, None
    meta = load_yaml(p)
    try:
        files = [str(f) for f, _ in manifest_files(p)]
        df = read(spark, p, position=True)
    except (FileNotFoundError, ValueError) as e:
        m.errors.append(str(e))
        return m, None, None
    m.errors += device_rule(df.columns, meta, files)
    inherited = {c for c, names in (("device_id", devices(meta)), ("trip_id", trip_names(meta))) if len(names) == 1}
    by = ["trip_id"] if "trip_id" in df.columns else []
    plain = df.drop(*ORDER)
    # The order rule needs the rows' places, the others must not see them as columns.
    data = validate(plain, level, meta.get("profile"), inherited=inherited, by=by, periods=acc_periods(meta, True) if level in ("strict", "full") else None)
    if "ts" in df.columns:
        n = order_violations(df, "ts", ORDER, by, strict=level in ("strict", "full"))
        data.counts["ts_order"] = n
        if n:
            data.errors.append(f"ts_order: {n} rows")
    cross = None
    if level == "full":
        cross = disagreements(plain, meta).first().asDict()
        if cross["declared_rows"] is not None and cross["declared_rows"] != cross["n_rows"]:
            data.errors.append(f"{cross['n_rows']} rows, but {cross['declared_rows']} are declared")
        data.errors += [f"{k.split('_')[1]} is not as declared" for k, v in cross.items() if k.startswith("sensor_") and v is False]
    return m, data, cross
