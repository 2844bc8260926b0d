import csv
import datetime as dt
import io
import json
import re

import pyarrow.parquet as pq

from roadgrain.operators import compaction
from roadgrain.operators.compaction import consolidate, copies, merge_fragments, output_files, write_consolidated
from roadgrain.sources import table

S = "fragment_id long, trip_id string, file_path string, n_bytes long, written_at timestamp, payload string"


def instant(x):
    x = str(x)
    if re.fullmatch(r"-?\d+", x):
        return int(x) * 1000
    t = dt.datetime.fromisoformat(x.replace("Z", "+00:00"))
    t = t if t.tzinfo else t.replace(tzinfo=dt.timezone.utc)
    return (t - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)


def brute(rows):
    seen, copies = {}, set()
    for r in sorted(rows, key=lambda r: r["fragment_id"]):
        p = r["payload"]
        if not p or not p.strip():
            continue
        trip = r["trip_id"] or re.search(r"trip_id=([^/]+)|([^/]+)__[^/]*$|([^/]+)/[^/]*$", r["file_path"]).group(0)
        trip = r["trip_id"] or next(g for g in (re.search(x, r["file_path"]) for x in (r"trip_id=([^/]+)", r"([^/]+)__[^/]*$", r"([^/]+)/[^/]*$")) if g).group(1)
        lines = p.split("\n")
        sep = ";" if ";" in lines[0] else ","
        for n, line in enumerate(lines, 1):
            try:
                if p.startswith("{"):
                    o = json.loads(line)
                    rec = (instant(o["ts"]), o["lat"], o["lon"], o.get("speed_mps"))
                else:
                    if n == 1:
                        head = line.split(sep)
                        continue
                    c = next(csv.reader(io.StringIO(line), delimiter=sep))
                    o = dict(zip(head, c, strict=True))
                    rec = (instant(o["ts"]), float(o["lat"]), float(o["lon"]), float(o["speed_mps"]) if o["speed_mps"] else None)
            except (ValueError, KeyError, StopIteration):
                continue
            key = (trip, *rec)
            if key in seen:
                copies.add((r["fragment_id"], n))
            seen.setdefault(key, (r["fragment_id"], n))
    return len(seen), copies


def test_equals_brute_force(spark):
    d = "/root/testdata/sf0.01"
    n, copies = brute(pq.read_table(f"{d}/trip_fragments.parquet").to_pylist())
    got = merge_fragments(table(spark, d, "trip_fragments")).collect()
    assert {(r.fragment_id, r.line_no) for r in got if r.is_copy} == copies
    assert sum(not r.is_copy for r in got) == n


def test_writings_of_one_record(spark):
    j = '{"ts": "2021-01-04T00:00:01.500000Z", "lat": 1.50, "lon": -0.0, "speed_mps": null}\n\n{"ts": "2021-01-'
    rows = [
        (3, "t", "x/t/p.jsonl", 1, None, j),
        (1, None, "landing/trip_id=t/day=1/p.csv", 1, None, "ts;lat;lon;speed_mps\n2021-01-04 00:00:01.5;1.5;0;\r\n\n1609718401500;1.5;0.0;\n2021-01-04T00;1.5"),
        (1, None, "landing/trip_id=t/day=1/p.csv", 1, None, "ts;lat;lon;speed_mps\n2021-01-04 00:00:01.5;1.5;0;\r\n\n1609718401500;1.5;0.0;\n2021-01-04T00;1.5"),
        (2, None, "landing/2021/01/04/t__p.csv", 1, None, "lat,lon,ts,speed_mps\n1.5,0.0,2021-01-04T01:00:01.5+01:00,"),
        (4, "t", "a/t/b", 0, None, ""), (5, "t", None, None, None, None), (6, None, None, 1, None, '{"ts": 1, "lat": 2, "lon": 3}'),
    ]
    f = spark.createDataFrame(rows, S)
    got = {(r.fragment_id, r.line_no): (r.trip_id, r.us, r.is_copy) for r in merge_fragments(f).collect()}
    us = 1609718401500000
    assert got == {(1, 2): ("t", us, False), (1, 4): ("t", us, True), (2, 2): ("t", us, True), (3, 1): ("t", us, True), (6, 1): (None, 1000, False)}
    assert merge_fragments(f.limit(0)).count() == 0


def test_hot_record_and_written_files(spark, tmp_path):
    line = '{"ts": 1609718401500, "lat": 1, "lon": 2}\n'
    rows = [(i, f"t{i % 3}", "a/t/b", 1, None, line * 20 + "\n".join(f'{{"ts": {1609718402000 + i * 50_000 + j}, "lat": {j / 7}, "lon": 2}}' for j in range(40))) for i in range(100)]
    f = spark.createDataFrame(rows, S)
    assert len(consolidate(f).collect()) == 3 + 100 * 40
    c = {(r.fragment_id, r.line_no) for r in copies(f).collect()}
    assert c == {(i, n) for i in range(100) for n in range(1, 21)} - {(0, 1), (1, 1), (2, 1)}
    meta = write_consolidated(f, f"file://{tmp_path}/out", target_bytes=20_000).collect()
    files = {p.name: pq.read_table(p) for p in (tmp_path / "out").glob("part-*.parquet")}
    assert {m.out_file for m in meta} == set(files) and len(files) > 1
    assert sum(m.n_records for m in meta) == sum(t.num_rows for t in files.values()) == 4003
    for m in meta:
        got = [x for x in files[m.out_file].to_pylist() if x["trip_id"] == m.trip_id]
        us = [x["us"] for x in got]
        assert len(got) == m.n_records and (tmp_path / "out" / m.out_file).stat().st_size == m.file_bytes
        utc = lambda t: (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
        assert (min(us), max(us)) == (utc(m.first_ts), utc(m.last_ts))
    assert len({(x["trip_id"], x["us"], x["lat"]) for t in files.values() for x in t.to_pylist()}) == 4003
    assert output_files(f.limit(0)).count() == 0


def test_one_rule_for_both_formats(spark):
    rows = [(1, "t", "a/t/b", 1, None, '{"ts": 1000, "lat": null, "lon": 2}\n{"ts": 1000, "lat": "1.5", "lon": 2}'), (2, "t", "a/t/b", 1, None, "ts,lat,lon,speed_mps\n1000,,2,\n1000,1.5,2,\n1000,NaN,2,\n1000,1_0,2,")]
    got = {(r.fragment_id, r.line_no): r.is_copy for r in merge_fragments(spark.createDataFrame(rows, S)).collect()}
    assert got == {(1, 2): False, (2, 3): True}


def test_merge_opens_runs_as_they_begin(monkeypatch):
    runs = [("t", 0, 10 * k, [10 * k + j for j in range(0, 40, 3)], *([[0.0] * 14] * 3), [k] * 14, list(range(14)), False) for k in range(50)]
    opened, most = [0], [0]
    unpack = compaction._unpack

    def counted(p):
        opened[0] += 1
        most[0] = max(most[0], opened[0])
        yield from unpack(p)
        opened[0] -= 1

    monkeypatch.setattr(compaction, "_unpack", counted)
    got = [x[0] for x in compaction._merged(iter(runs))]
    assert got == sorted(got) and len(got) == 50 * 14 and most[0] < 8


def test_missing_ids_and_paths(spark):
    line = '{"ts": 1000, "lat": 1, "lon": 2}'
    rows = [(None, "t", None, None, None, line), (7, " ", "x/t/p.jsonl", None, None, line + "\n" + line), (None, None, None, None, None, line), (8, "t", None, None, None, "   \n ")]
    got = sorted(((r.trip_id or "", r.fragment_id or -1, r.line_no, r.is_copy) for r in merge_fragments(spark.createDataFrame(rows, S)).collect()))
    assert got == [("", -1, 1, False), ("t", -1, 1, True), ("t", 7, 1, False), ("t", 7, 2, True)]
