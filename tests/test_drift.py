import json

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from roadgrain.operators.drift import consistent_table, flatten, plain_version, schema_changes
from roadgrain.sources import table

FS = "file_id long, dataset_id string, file_no int, file_name string, version string, column_aliases string, generated_at_utc timestamp, vehicle_id string, trip_id string"


def brute(files, rows):
    """The definition of the changes, file by file, in plain Python."""
    alias, types = {}, {}
    for f in files:
        for k, v in (json.loads(f["column_aliases"]) if f["column_aliases"] else {}).items():
            for n in v if isinstance(v, list) else [v]:
                alias[n] = k
    for r in rows:
        for n, v in flatten(json.loads(r["payload"])):
            t = types.setdefault(r["file_id"], {}).setdefault(n, set())
            if v is not None:
                t.add("boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string")
    out, by = set(), {}
    for f in files:
        by.setdefault(f["dataset_id"], {})[f["file_no"]] = f
    for ds in by.values():
        prev = version = None
        for no in sorted(ds):
            f = ds[no]
            v = f["version"] and tuple(map(int, f["version"].strip().lower().lstrip("v").split(".")))
            v = v[:2] if v and len(v) == 3 and v[2] == 0 else v
            if prev is not None and v and version and v != version:
                out.add((f["file_id"], "version", "version"))
            version = v or version
            if prev is not None:
                a = {alias.get(n, n): (n, t) for n, t in types.get(f["file_id"], {}).items()}
                b = {alias.get(n, n): (n, t) for n, t in types.get(prev, {}).items()}
                for q in a.keys() | b.keys():
                    if q not in b:
                        out.add((f["file_id"], a[q][0], "added"))
                    elif q not in a:
                        out.add((f["file_id"], b[q][0], "removed"))
                    else:
                        if a[q][0] != b[q][0]:
                            out.add((f["file_id"], a[q][0], "renamed"))
                        if a[q][1] and b[q][1] and a[q][1] != b[q][1]:
                            out.add((f["file_id"], a[q][0], "retyped"))
            prev = f["file_id"]
    return out


def test_equals_brute_force(spark):
    d = "/root/testdata/sf0.01"
    files, rows = (pq.read_table(f"{d}/{t}.parquet").to_pylist() for t in ("dataset_v01_legacy", "legacy_rows"))
    got = schema_changes(table(spark, d, "dataset_v01_legacy"), table(spark, d, "legacy_rows")).collect()
    assert {(r.file_id, r.column_name, r.change_kind) for r in got} == brute(files, rows)


def test_versions(spark):
    v = ["0.1", " v0.1", "V0.1.0", "0.10", "0.2", "", None, "1"]
    got = [r.p for r in spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, v string").select("i", plain_version(F.col("v")).alias("p")).orderBy("i").collect()]
    assert got[0] == got[1] == got[2] and len({*got[2:5]}) == 3 and got[5] is None and got[6] is None


def test_odd_input(spark):
    files = spark.createDataFrame([(1, "d", 1, None, None, None, None, None, None), (2, "d", 2, None, "0.1", "not json", None, None, None), (2, "d", 2, None, "0.1", "not json", None, None, None), (3, "d", 5, None, None, '{"lat": ["x"]}', None, None, None)], FS)
    rows = spark.createDataFrame([(1, 1, '{"lat": 1.5, "a": {"b": null}}'), (1, 1, '{"lat": 1.5, "a": {"b": null}}'), (2, 1, "broken"), (2, 2, None), (2, 3, '{"x": "7", "a": {"b": true}}'), (3, 1, "[1]")], "file_id long, line_no int, payload string")
    got = {(r.file_id, r.column_name, r.change_kind) for r in schema_changes(files, rows).collect()}
    assert got == {(2, "x", "renamed"), (2, "x", "retyped"), (3, "x", "removed"), (3, "a.b", "removed")}
    t = {r.file_id: (r.lat, r["a.b"]) for r in consistent_table(files, rows).collect()}
    assert t == {1: (1.5, None), 2: (7.0, 1.0)}
    assert schema_changes(files.limit(0), rows).count() == 0 and schema_changes(files, rows.limit(0)).count() == 0


def test_one_wide_table_with_typed_branches(spark):
    files = spark.createDataFrame([(1, "d", 1, "a", "1", json.dumps({"speed": ["v", "spd"]}), None, None, None), (2, "d", 2, "b", "1", None, None, None, None)], FS)
    lines = [
        (1, 1, '{"v": 1.5, "timestamp": "2021-01-04T00:00:01Z", "on": true, "note": "x"}'), (1, 1, '{"v": 1.5, "timestamp": "2021-01-04T00:00:01Z", "on": true, "note": "x"}'), (1, 2, "no json"),
        (2, 1, '{"spd": "2.5", "timestamp": 1609718402000, "on": 0, "note": null, "tags": [1, "a"]}'), (2, None, None),
    ]
    t = consistent_table(files, spark.createDataFrame(lines, "file_id long, line_no int, payload string"))
    assert t.columns == ["file_id", "line_no", "note", "on", "on__boolean", "on__number", "speed", "speed__number", "speed__string", "tags", "timestamp", "timestamp__number", "timestamp__string"]
    got = {(r.file_id, r.line_no): r for r in t.collect()}
    assert len(got) == 2 and [got[k].speed for k in ((1, 1), (2, 1))] == [1.5, 2.5]
    assert (got[1, 1].on, got[2, 1].on, got[2, 1].on__boolean, got[1, 1].on__boolean) == (1.0, 0.0, None, True)
    assert [str(got[k].timestamp) for k in ((1, 1), (2, 1))] == ["2021-01-04 00:00:01", "2021-01-04 00:00:02"] and got[2, 1].tags == '[1, "a"]' and got[1, 1].note == "x"
    empty = consistent_table(files.limit(0), spark.createDataFrame([], "file_id long, line_no int, payload string"))
    assert empty.columns == ["file_id", "line_no"] and empty.count() == 0


def test_order_of_files_over_blocks(spark, monkeypatch):
    from roadgrain.operators import drift

    monkeypatch.setattr(drift, "FILES", 3)
    files = spark.createDataFrame([(i, "d" if i % 2 else None, i, f"{i}", None if i % 4 else f"{i}.0", None, None, None, None) for i in range(40)], FS)
    got = {r.file_id: (r.prev_id, r.next_id, r.v, r.prev_v) for r in drift._ordered(files).collect()}
    for i in range(40):
        own = [j for j in range(i % 2, i + 1, 2) if j % 4 == 0]
        before = [j for j in own if j < i]
        version = lambda js: drift_version(js[-1]) if js else None
        assert got[i] == (i - 2 if i > 1 else None, i + 2 if i < 38 else None, version(own), version(before))


def drift_version(n):
    return str(n)
