"""Command line: validate, info, convert, adapt, export, check-tables, to-parquet, completeness, verify, query.

Exit codes: 0 valid, 1 invalid, 2 nothing to read, 3 wrong use, 4 unexpected failure.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from roadgrain import manifest as M
from roadgrain.operators.position import ORDER
from roadgrain.validate import EXIT_INTERNAL, EXIT_INVALID, EXIT_MISSING, EXIT_OK, EXIT_USAGE, LEVELS, order_violations, validate, validate_tables


def _say(a, data: dict) -> None:
    print(json.dumps(data, default=str, indent=None if a.json else 2))


def _report(a, r) -> None:
    d = r.as_dict()
    if a.fail_fast and not r.ok:
        d = {"status": "fail", "error": r.errors[0]}
    elif not a.verbose:
        d.pop("findings")
    _say(a, d)


def _validate(a, spark) -> int:
    where = next((x for x in (a.path, a.dataset, a.record) if x), None)
    if a.all:
        got = [_validate(argparse.Namespace(**(vars(a) | {"all": False, "path": str(f), "dataset": None})), spark) for f in sorted({*Path(where or ".").rglob("manifest.yaml"), *Path(where or ".").rglob("dataset.yaml")})]
        return max(got, default=EXIT_MISSING)
    if a.adapter:
        from roadgrain.adapters import load

        r = validate(load(a.adapter, spark(), where), a.level if a.level in ("basic", "strict") else "strict", a.profile)
        _report(a, r)
        return EXIT_OK if r.ok else EXIT_INVALID
    if a.schema:
        from roadgrain.sources.readers import read
        from roadgrain.validate import validate_schema

        bad = validate_schema(read(spark(), where), a.schema)
        _say(a, {"status": "fail" if bad else "pass", "errors": bad[:1] if a.fail_fast else bad})
        return EXIT_INVALID if bad else EXIT_OK
    if where is None:
        return EXIT_USAGE
    if Path(where).suffix in (".json", ".jsonl"):
        from roadgrain.sources.readers import read_jsonl
        from roadgrain.validate import validate_nested

        row = validate_nested(read_jsonl(spark(), where)).first().asDict()
        bad = {k: v for k, v in row.items() if k != "n_rows" and v}
        _say(a, {"status": "fail" if bad else "pass", "records_checked": row["n_rows"], "findings": bad})
        return EXIT_INVALID if bad else EXIT_OK
    p = Path(where)
    if p.is_dir():
        p = next((p / n for n in ("manifest.yaml", "dataset.yaml") if (p / n).exists()), p / "manifest.yaml")
    if not p.exists():
        _say(a, {"status": "missing", "path": str(p)})
        return EXIT_MISSING
    if p.suffix == ".parquet":
        from roadgrain.sources.readers import read

        level = a.level if a.level in ("basic", "strict") else "strict"
        df = read(spark(), p, position=True)
        r = validate(df.drop(*ORDER), level, a.profile)
        if "ts" in df.columns and (n := order_violations(df, "ts", ORDER, ["trip_id"] if "trip_id" in df.columns else [], level == "strict")):
            r.errors.append(f"ts_order: {n} rows")
        _report(a, r)
        return EXIT_OK if r.ok else EXIT_INVALID
    if a.manifest_only:
        m, data, cross = M.validate_manifest(p), None, None
    else:
        m, data, cross = M.validate_dataset(spark(), p, a.level)
    ok = m.ok and (data is None or data.ok)
    out = {"status": "pass" if ok else "fail", "manifest": {"ok": m.ok, "errors": m.errors, "warnings": m.warnings}}
    if a.fail_fast and not ok:
        _say(a, {"status": "fail", "error": (m.errors or data.errors)[0]})
        return EXIT_INVALID
    _say(a, out | ({"data": data.as_dict()} if data else {}) | ({"cross_check": cross} if cross else {}))
    return EXIT_OK if ok else EXIT_INVALID


def _info(a, spark) -> int:
    from roadgrain.sources.readers import Dataset

    if not Path(a.path).exists():
        return EXIT_MISSING
    print(Dataset.from_path(a.path).describe())
    return EXIT_OK


def _convert(a, spark) -> int:
    from roadgrain.adapters import load
    from roadgrain.operators.introspect import detect_profile
    from roadgrain.sources.readers import read_parquet
    from roadgrain.sources.sinks import write_trips, write_zstd

    df = load(a.adapter, spark(), a.path)
    out = Path(a.out)
    target = out / f"{a.adapter}.parquet"
    if a.per_trip:
        write_trips(df, target, out / "trips")
    else:
        write_zstd(df, target)
    got = read_parquet(spark(), target)
    M.emit(a.adapter.lower(), got, detect_profile(got), path=out / "manifest.yaml", data_path=target.name)
    r = validate(got)
    _say(a, r.as_dict())
    return EXIT_OK if r.ok else EXIT_INVALID


def _adapt(a, spark) -> int:
    """Raw files to one folder per trip and counts per sensor, with joins inside trips."""
    from roadgrain.adapters import load
    from roadgrain.sources.sinks import write_trips

    options = {
        "aegis": {"top_n_trips": None, "by_trip": True, "tolerances_ms": {"gyro": a.gyro_ms, "gps": a.gps_ms}, "least_rows": a.least_rows, "with_obd": False},
        "pvs": {"labels": True, "sparse": True, "placement": a.placement, "side": a.side},
    }.get(a.adapter, {})
    df = load(a.adapter, spark(), a.path, **options)
    if a.adapter == "aegis":  # this form leaves the speed to a later step
        from pyspark.sql import functions as F

        df = df.withColumn("speed_mps", F.lit(None).cast("float"))
    out = Path(a.out)
    n = write_trips(df, out / f"{a.adapter}.parquet", out / "trips").count()
    _say(a, {"adapter": a.adapter, "trips": n, "out": str(out)})
    return EXIT_OK if n else EXIT_MISSING


def _export(a, spark) -> int:
    from roadgrain.sources.sinks import export_tables

    print(export_tables(spark(), a.trajectory, a.imu, a.out, a.events, a.dataset_id))
    return EXIT_OK


def _check_tables(a, spark) -> int:
    from roadgrain.sources.readers import load_dataset

    if not Path(a.path).exists():
        return EXIT_MISSING
    ok, rep, _ = validate_tables(load_dataset(spark(), a.path), M.load_yaml(a.path).get("units"))
    _say(a, rep | {"ok": ok})
    return EXIT_OK if ok else EXIT_INVALID


def _to_parquet(a, spark) -> int:
    from roadgrain.sources.sinks import json_dir_to_parquet

    try:
        print(json_dir_to_parquet(spark(), a.path, a.out))
    except ValueError as e:
        print(e, file=sys.stderr)
        return EXIT_INVALID
    return EXIT_OK


def _completeness(a, spark) -> int:
    from roadgrain.operators.aggregates import CORE_FIELDS, completeness, completeness_score
    from roadgrain.sources.readers import read_json_dir

    df = read_json_dir(spark(), a.path)
    cov = {r["field"]: r["coverage"] for r in completeness(df, CORE_FIELDS).collect()}
    _say(a, {"score_pct": completeness_score(df, CORE_FIELDS).first()["score_pct"], "coverage": cov, "empty": [k for k, v in cov.items() if v == 0][:20]})
    return EXIT_OK


def _verify(a, spark) -> int:
    from roadgrain.verify import verify, verify_all

    got = verify_all(spark(), a.path, min_hz=a.min_hz, max_hz=a.max_hz, strict=a.strict) if a.all else [verify(spark(), a.path, a.min_hz, a.max_hz, a.strict)]
    for v in got:
        _say(a, {"folder": v.folder, "errors": v.errors, "warnings": v.warnings, **v.facts})
    return EXIT_MISSING if not got else max(v.code for v in got)


def _query(a, spark) -> int:
    from roadgrain.plans.registry import queries

    if a.name not in queries():
        print("\n".join(sorted(queries())))
        return EXIT_USAGE
    queries()[a.name](spark(), a.path).show(a.rows, truncate=False)
    return EXIT_OK


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="roadgrain")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name, f, *positional):
        s = sub.add_parser(name)
        for x in positional:
            s.add_argument(x)
        s.add_argument("--json", action="store_true")
        s.set_defaults(run=f)
        return s

    s = add("validate", _validate)
    s.add_argument("path", nargs="?")
    for x in ("--dataset", "--record", "--schema", "--adapter"):
        s.add_argument(x)
    for x in ("--all", "--fail-fast", "--verbose"):
        s.add_argument(x, action="store_true")
    s.add_argument("--level", choices=LEVELS, default="basic")
    s.add_argument("--profile")
    s.add_argument("--manifest-only", action="store_true")
    add("info", _info, "path")
    s = add("convert", _convert, "adapter", "path")
    s.add_argument("-o", "--out", required=True)
    s.add_argument("--per-trip", action="store_true")
    s = add("adapt", _adapt, "adapter", "path")
    s.add_argument("-o", "--out", required=True)
    s.add_argument("--gyro-ms", type=int, default=50)
    s.add_argument("--gps-ms", type=int, default=600)
    s.add_argument("--least-rows", type=int, default=10)
    s.add_argument("--placement", default="dashboard")
    s.add_argument("--side", default="left")
    s = add("export", _export, "trajectory", "imu")
    s.add_argument("--events")
    s.add_argument("--dataset-id", default="export")
    s.add_argument("-o", "--out", required=True)
    add("check-tables", _check_tables, "path")
    add("to-parquet", _to_parquet, "path").add_argument("-o", "--out", required=True)
    add("completeness", _completeness, "path")
    s = add("verify", _verify, "path")
    s.add_argument("--all", action="store_true")
    s.add_argument("--strict", action="store_true")
    s.add_argument("--min-hz", type=float, default=9.5)
    s.add_argument("--max-hz", type=float, default=10.5)
    add("query", _query, "name", "path").add_argument("--rows", type=int, default=20)
    return p


def main(argv: list[str] | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return EXIT_OK if e.code == 0 else EXIT_USAGE
    from roadgrain.session import get_session, ship

    try:
        return a.run(a, lambda: ship(get_session()))
    except FileNotFoundError as e:
        print(e, file=sys.stderr)
        return EXIT_MISSING
    except ValueError as e:
        print(e, file=sys.stderr)
        return EXIT_INVALID
    except Exception as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return EXIT_INTERNAL


if __name__ == "__main__":
    sys.exit(main())
