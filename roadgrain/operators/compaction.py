"""Problem 5: a landing zone of tiny files becomes few well-sized ones, each record once.

Sorted-run consolidation in two merge passes. Every small file is a run that is sorted already (one that isn't is sorted
first). The first pass merges the runs that lie in one batch of files, the second merges what came of the batches, per
key range of (trip, ``RANGE_US`` of time); both are k-way merges on a heap. Equal records are neighbours in a merged
stream, ordered by (fragment_id, line_no), and all but the first are marked as copies there. The merged stream is rolled
into Parquet files by the bytes written, and range metadata tell which trips and times each file holds. The method's
"preserve duplicates" yields to the statement in TESTDATA.md: equal records are written once.

Defined results: a record has a readable instant and a lat and lon that are finite numbers, in JSON and CSV alike; header,
blank and broken-off lines (no JSON object, or another number of cells than the header) are no records; a null or empty
payload gives none; trip_id is read from file_path where it is null or blank, and a record of neither has the trip null;
a speed that is missing or no finite number equals null, and -0.0 equals 0.0; repeated fragment rows count once; a missing
fragment_id comes after all others; empty tables give no rows.

Skew: the first pass leaves one of a batch's equal records for the shuffle, so a record that is a third of all rows meets
as one row per batch; a trip is spread over its time. The second pass opens a run when the merge reaches its first key,
so only the runs that overlap at an instant are held.
"""

from __future__ import annotations

import csv
import json
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from datetime import datetime
from heapq import heappop, heappush, merge

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadgrain.session import arrow_batch, hashed

TARGET_BYTES = 128 << 20
#: Time that a key range spans.
RANGE_US = 600_000_000
#: Records of the merged stream that are put into an Arrow batch or a row group at once.
BATCH = 20_000
#: Stands for a missing speed where records are compared: no record holds it.
NONE = -math.inf
#: Stands for a missing fragment_id, which comes after all others.
NO_ID = (1 << 63) - 1
RECORD = "trip_id string, us long, lat double, lon double, speed_mps double, fragment_id long, line_no int, is_copy boolean"
PIECE = "trip_id string, slot long, first_us long, us array<long>, lat array<double>, lon array<double>, speed_mps array<double>, fragment_id array<long>, line_no array<int>, is_copy boolean"
RANGES = "out_file string, trip_id string, n_records long, first_us long, last_us long, file_records long, file_bytes long"

PATHS = [re.compile(p) for p in (r"(?:^|/)trip_id=([^/]+)", r"([^/]+?)__[^/]*$", r"([^/]+)/[^/]*$")]
MILLIS, INSTANT = re.compile(r"-?\d+").fullmatch, re.compile(r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}").match


def trip_of_path(path: str | None) -> str | None:
    """The trip in a landing path: a trip_id= folder, the part before ``__`` of the name, or the last folder."""
    return next((m.group(1) for m in (p.search(path or "") for p in PATHS) if m), None)


def instant_us(x) -> int | None:
    """Epoch microseconds of a written instant: whole numbers are epoch milliseconds, offset-less times are UTC."""
    if isinstance(x, bool) or x is None:
        return None
    t = str(x).strip()
    if MILLIS(t):
        n = int(t) * 1000
        return n if abs(n) < 1 << 62 else None
    if not INSTANT(t):
        return None
    try:
        d = datetime.fromisoformat(t)
    except ValueError:
        return None
    us = ((d.toordinal() - 719_163) * 86_400 + d.hour * 3600 + d.minute * 60 + d.second) * 1_000_000 + d.microsecond
    off = d.utcoffset()
    return us if off is None else us - (off.days * 86_400 + off.seconds) * 1_000_000 - off.microseconds


def number(x) -> float | None:
    """A finite number, also of a text; -0.0 is 0.0."""
    if x is None or isinstance(x, bool):
        return None
    try:
        v = float(x)
    except (TypeError, ValueError, OverflowError):
        return None
    return v + 0.0 if math.isfinite(v) and not (isinstance(x, str) and "_" in x) else None


def records_of(payload: str | None, fragment_id: int) -> list[tuple]:
    """(us, lat, lon, speed, fragment_id, line_no) of a file's records, in order of their lines."""
    if not payload or payload.isspace():
        return []
    out, lines = [], payload.split("\n")
    if payload.lstrip().startswith("{"):
        for n, line in enumerate(lines, 1):
            try:
                o = json.loads(line)
            except ValueError:
                continue
            if isinstance(o, dict):
                us, lat, lon = instant_us(o["ts"] if o.get("ts") is not None else o.get("timestamp")), number(o.get("lat")), number(o.get("lon"))
                if us is not None and lat is not None and lon is not None:
                    v = number(o.get("speed_mps"))
                    out.append((us, lat, lon, NONE if v is None else v, fragment_id, n))
        return out
    head = next(x for x in lines if x.strip()).strip()
    sep = next((s for s in (";", "\t") if s in head), ",")
    names = [x.strip().strip('"') for x in head.split(sep)]
    at = {x: names.index(x) for x in ("ts", "timestamp", "lat", "lon", "speed_mps") if x in names}
    when, a, b, c = at.get("ts", at.get("timestamp")), at.get("lat"), at.get("lon"), at.get("speed_mps")
    if when is None or a is None or b is None:
        return []
    for n, line in enumerate(lines, 1):
        line = line.rstrip()
        cells = next(csv.reader([line], delimiter=sep), []) if '"' in line else line.split(sep)
        if len(cells) == len(names):
            us, lat, lon = instant_us(cells[when]), number(cells[a]), number(cells[b])
            if us is not None and lat is not None and lon is not None:
                v = number(cells[c]) if c is not None else None
                out.append((us, lat, lon, NONE if v is None else v, fragment_id, n))
    return out


def _told(stream: Iterator[tuple]) -> Iterator[tuple[tuple, bool]]:
    """Records of a merged stream with whether each is a copy of the one before; a line that comes again is left out."""
    last = None
    for x in stream:
        if last is not None and x[:4] == last[:4]:
            if x[4:] != last[4:]:
                yield x, True
                last = x
        else:
            yield x, False
            last = x


def _columns(xs: list[tuple]) -> list[list]:
    us, lat, lon, speed, fragment, line = (list(c) for c in zip(*xs)) if xs else ([], [], [], [], [], [])
    return [us, lat, lon, [None if v == NONE else v for v in speed], fragment, line]


def _first_pass(batches):
    """Files of a batch to merged pieces, one per key range, and the copies that this merge has found."""
    for b in batches:
        runs: dict[str | None, list[list[tuple]]] = defaultdict(list)
        for fragment_id, trip, path, payload in zip(*(b.column(c).to_pylist() for c in ("fragment_id", "trip_id", "file_path", "payload"))):
            run = records_of(payload, NO_ID if fragment_id is None else fragment_id)
            if run:
                if any(p > q for p, q in zip(run, run[1:])):
                    run.sort()
                runs[trip if trip and trip.strip() else trip_of_path(path)].append(run)
        rows = []
        for trip, of_trip in runs.items():
            pieces: dict[tuple[int, bool], list[tuple]] = defaultdict(list)
            for x, copy in _told(merge(*of_trip)):
                pieces[x[0] // RANGE_US, copy].append(x)
            rows += [(trip, slot, xs[0][0], *_columns(xs), copy) for (slot, copy), xs in pieces.items()]
        if rows:
            yield arrow_batch(PIECE, rows)


def _unpack(p: tuple) -> Iterator[tuple]:
    return ((us, lat, lon, NONE if v is None else v, f, n) for us, lat, lon, v, f, n in zip(*p[3:9]))


def _merged(pieces: Iterator[tuple]) -> Iterator[tuple]:
    """K-way merge of one key range's pieces, which come by their first key; each is opened when the merge reaches it."""
    heap: list[tuple] = []
    coming = next(pieces, None)
    n = 0
    while heap or coming is not None:
        while coming is not None and (not heap or coming[2] <= heap[0][0][0]):
            it = _unpack(coming)
            heappush(heap, (next(it), n, it))
            n += 1
            coming = next(pieces, None)
        x, k, it = heappop(heap)
        yield x
        nxt = next(it, None)
        if nxt is not None:
            heappush(heap, (nxt, k, it))


def _second_pass(batches):
    """Pieces sorted by (trip, slot, first_us) to the merged stream of records, copies marked."""
    rows: list[tuple] = []

    def flush():
        out = arrow_batch(RECORD, rows)
        rows.clear()
        return out

    stream = (p for b in batches for p in zip(*(c.to_pylist() for c in b.columns)))
    p = next(stream, None)
    while p is not None:
        key = p[:2]
        box = [p]

        def of_key():
            while box[0] is not None and box[0][:2] == key:
                q, box[0] = box[0], next(stream, None)
                if q[9]:
                    rows.extend((q[0], us, lat, lon, v, None if f == NO_ID else f, n, True) for us, lat, lon, v, f, n in zip(*q[3:9]))
                else:
                    yield q

        for x, copy in _told(_merged(of_key())):
            rows.append((key[0], x[0], x[1], x[2], None if x[3] == NONE else x[3], None if x[4] == NO_ID else x[4], x[5], copy))
            if len(rows) >= BATCH:
                yield flush()
        p = box[0]
    if rows:
        yield flush()


def merge_fragments(fragments: DataFrame) -> DataFrame:
    """All records (trip_id, us, lat, lon, speed_mps, fragment_id, line_no, is_copy), merged per key range.

    Records that are not copies come in key order within a range. A copy may come twice if its fragment row does.
    """
    f = fragments.select("fragment_id", "trip_id", "file_path", "payload").where("payload is not null")
    pieces = f.mapInArrow(_first_pass, PIECE)
    # Only parsed pieces are shuffled, never payloads.
    return hashed(pieces, "trip_id", "slot").sortWithinPartitions("trip_id", "slot", "first_us").mapInArrow(_second_pass, RECORD)


def copies(fragments: DataFrame) -> DataFrame:
    """(fragment_id, line_no) of the copies that must not be written again."""
    return merge_fragments(fragments).where("is_copy").select("fragment_id", "line_no").distinct()


def consolidate(fragments: DataFrame) -> DataFrame:
    """The records once each, in key order within their ranges."""
    return merge_fragments(fragments).where("not is_copy").drop("is_copy")


def _roller(target: int, folder: str | None):
    """Rolls a partition's merged stream into Parquet files by the bytes written; gives the files' range metadata."""

    def roll(batches):
        import pyarrow as pa
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        fs, base = pafs.FileSystem.from_uri(folder) if folder else (None, "")
        sink = writer = name = None
        seen: dict[str | None, list[int]] = {}

        def close():
            writer.close()
            size = sink.tell() if fs else sink.getvalue().size
            if fs:
                sink.close()
                # An attempt that is run again writes the same file; only whole files get their name.
                fs.move(f"{base}/.{name}.{TaskContext.get().attemptNumber()}", f"{base}/{name}")
            total = sum(v[0] for v in seen.values())
            rows = [(name, t, k, a, z, total, size) for t, (k, a, z) in seen.items()]
            seen.clear()
            return arrow_batch(RANGES, rows)

        for b in batches:
            if not b.num_rows:
                continue
            if writer is None:
                name = f"part-{part:06d}-{n:04d}.parquet"
                n += 1
                sink = fs.open_output_stream(f"{base}/.{name}.{TaskContext.get().attemptNumber()}") if fs else pa.BufferOutputStream()
                writer = pq.ParquetWriter(sink, b.schema, compression="zstd")
            writer.write_batch(b)
            for t, us in zip(b.column("trip_id").to_pylist(), b.column("us").to_pylist()):
                s = seen.get(t)
                if s is None:
                    seen[t] = [1, us, us]
                else:
                    s[0] += 1
                    s[1], s[2] = min(s[1], us), max(s[2], us)
            if sink.tell() >= target:
                yield close()
                writer = None
        if writer is not None:
            yield close()

    return roll


def output_files(fragments: DataFrame, target_bytes: int = TARGET_BYTES, folder: str | None = None) -> DataFrame:
    """Range metadata of the consolidated files: one row per file and trip in it, with its records and time range.

    With ``folder`` (a URI or absolute path that all executors share) running the plan writes the files there, else their
    sizes are taken in memory. A file is closed when its bytes have passed the target.
    """
    kept = consolidate(fragments).select("trip_id", "us", "lat", "lon", "speed_mps")
    m = kept.mapInArrow(_roller(target_bytes, folder), RANGES)
    return m.select("out_file", "trip_id", "n_records", F.timestamp_micros("first_us").alias("first_ts"), F.timestamp_micros("last_us").alias("last_ts"), "file_records", "file_bytes")


def write_consolidated(fragments: DataFrame, folder: str, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Action: writes the files and, beside them, the range metadata (``_ranges``), which it returns.

    Files that the metadata don't name are of failed attempts.
    """
    import pyarrow.fs as pafs

    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    output_files(fragments, target_bytes, folder).write.mode("overwrite").parquet(f"{folder}/_ranges")
    return fragments.sparkSession.read.parquet(f"{folder}/_ranges")
