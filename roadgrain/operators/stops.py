"""Problem 7: stops and trips from location pings.

Two passes. The first, per device and day, turns pings into dwells (successive pings within ``radius`` of one place,
bridging a few stray ones) and moves (the pings between), each with the sums the decoder needs. The second decodes
dwells and moves with a hidden semi-Markov model of two states, stop and travel, each with an explicit duration
distribution: a stop has a hard least duration and a log-normal beyond it, a travel a log-normal from the end of one stop
to the start of the next (before the first and after the last stop its duration is unknown and free), both up to a most
dear duration; pings off the place cost an outlier penalty inside a stop, or leaving, moving and coming back; the cheaper
explanation wins. A way that no vehicle could have driven, as to a ping thrown far off, is dear to travel. Silence costs
nothing if the device is then still there. A travel is split at silences longer than ``gap_s``: the parts' ways are
added up, and the silence adds none.

Defined results: repeated ping_ids count once; pings without ping_id, device or ts are dropped; unlocated pings (null, NaN, out
of range, both 0) neither start nor end anything; equal ts are ordered by ping_id; a device that never stops for
``least_s`` has no stops and no trips; pings before the first and after the last stop are no trip; empty tables give
no rows.

Skew: the first pass is bounded by a day of one device. For the second a device's history is cut into pieces at the first
sure dwell of each day (``CUT_S``, ``CUT_N``), which is part of a stop in both pieces; its parts are joined afterwards.
Pieces are spread by (device, piece), so a hot device is decoded in as many tasks as it has such days. Repeated pings are
thinned out before the first shuffle.
"""

from __future__ import annotations

import math
from heapq import heappop, heappush

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadgrain.operators.grid import located
from roadgrain.session import arrow_batch, hashed, sorted_groups, thinned

DAY_US = 86_400_000_000
#: Rows of an Arrow batch that a pass gives.
BATCH = 10_000
EARTH_M = 6_371_000.0
DWELL = (
    "device_id string, t0 long, t1 long, id0 long, id1 long, lat double, lon double, lat0 double, lon0 double, lat1 double, lon1 double, "
    "n long, n_off long, steep long, path_m double, dwell boolean"
)
ITEM = DWELL + ", day long"
STOPS = "device_id string, start_us long, end_us long, first_ping_id long, last_ping_id long, lat double, lon double, n_pings long, next_path_m double"
SPAN = STOPS + ", from_cut boolean, to_cut boolean"
#: Costs of the decoder, in nats.
OFF, ENTER, STEEP, TOP_MPS, STILL_S = 6.0, 8.0, 6.0, 70.0, 15.0
#: Durations: the medians of a stop and a travel, the common sigma, and the most nats that a duration may cost.
STOP_S, TRAVEL_S, SIGMA, LONGEST = 1800.0, 900.0, 2.0, 6.0
#: A dwell this long with this many pings is part of a stop whatever lies around it: taking it for travel costs
#: CUT_S / STILL_S nats and for pings thrown off OFF * CUT_N, both more than any other stop and travel could save.
CUT_S, CUT_N = 3600.0, 10


def metres(lat0, lon0, lat1, lon1):
    """Great-circle distance of scalars or arrays of degrees."""
    a, b = np.radians(lat0), np.radians(lat1)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(np.subtract(lon1, lon0)) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.minimum(1.0, np.sqrt(h)))


def _dwell_maker(radius: float, bridge: int, gap_us: int):
    """Items of one day of a device, whose pings come in order, as tuples of ITEM."""

    def dwells(day: dict) -> list[tuple]:
        us, pid, lat, lon = (day[c] for c in ("us", "ping_id", "lat", "lon"))
        n = len(us)
        ky = np.pi / 180 * EARTH_M
        x, y = (np.mod(lon - lon[0] + 180, 360) - 180) * ky * np.cos(np.radians(lat)), (lat - lat[0]) * ky
        dus = np.diff(us)
        step = metres(lat[:-1], lon[:-1], lat[1:], lon[1:])
        fast = step / np.maximum(dus / 1e6, 1.0) > TOP_MPS
        # Sums over the legs before each ping: those faster than any vehicle, and the ways that count.
        n_fast = np.append(0, np.cumsum(fast))
        ways = np.append(0.0, np.cumsum(step * (dus <= gap_us) * ~fast))
        xs, ys, far = x.tolist(), y.tolist(), radius * radius
        groups: list[list[int]] = []
        i = 0
        while i < n:
            got, last, j = [i], i, i + 1
            sx, sy, k = xs[i], ys[i], 1
            # The place is the running mean; up to ``bridge`` stray pings may lie between its pings.
            while j < n and j - last <= bridge + 1:
                dx, dy = xs[j] - sx / k, ys[j] - sy / k
                if dx * dx + dy * dy <= far:
                    got.append(j)
                    sx, sy, last, k = sx + xs[j], sy + ys[j], j, k + 1
                j += 1
            # A place of two pings needs them adjacent or long apart, else moving pings would pair by chance.
            if k >= 2:
                groups.append(got)
                i = last + 1
            else:
                i += 1
        # Items as (first, last, pings at the place or None); pings of no place make moves, single at the day's edges.
        items: list[tuple[int, int, list[int] | None]] = []
        at = 0
        for g in [*groups, None]:
            end = g[0] if g else n
            if end > at:
                cuts = sorted({at, end, *(q for q in (1, 2, n - 2, n - 1) if at < q < end)})
                items += [(a, b - 1, None) for a, b in zip(cuts, cuts[1:])]
            if g:
                items.append((g[0], g[-1], g))
                at = g[-1] + 1
        a, z = (np.array([t[k] for t in items]) for k in (0, 1))
        size = z - a + 1
        dwell = np.array([t[2] is not None for t in items])
        sums = lambda v: np.append(0.0, np.cumsum(v))
        mean = lambda v: v[0] + (sums(v - v[0])[z + 1] - sums(v - v[0])[a]) / size
        la, lo = mean(lat), mean(lon)
        own = size.copy()
        for m, (_, _, g) in enumerate(items):
            if g is not None:
                la[m], lo[m], own[m] = _median([lat[q] for q in g]), _median([lon[q] for q in g]), len(g)
        dev, date = day["device_id"][0], int(day["day"][0])
        off, steep, path = size - own, np.where(dwell, 0, n_fast[z] - n_fast[a]), np.where(dwell, 0.0, ways[z] - ways[a])
        cols = (us[a], us[z], pid[a], pid[z], la, lo, lat[a], lon[a], lat[z], lon[z], own, off, steep, path, dwell)
        return [(dev, *row, date) for row in zip(*(c.tolist() for c in cols))]

    return dwells


def _median(v: list[float]) -> float:
    v = sorted(v)
    k = len(v) // 2
    return float(v[k]) if len(v) % 2 else float((v[k - 1] + v[k]) / 2)


def _metres(lat0: float, lon0: float, lat1: float, lon1: float) -> float:
    """``metres`` of scalars, without numpy's cost a call."""
    a, b = math.radians(lat0), math.radians(lat1)
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lon1 - lon0) / 2) ** 2
    return 2 * EARTH_M * math.asin(min(1.0, math.sqrt(h)))


def _duration(s: float, median: float) -> float:
    """Cost of a stay or a travel of s seconds: log-normal, LONGEST at most."""
    return min(0.5 * (math.log(max(s, 1.0) / median) / SIGMA) ** 2, LONGEST)


def _decoder(radius: float, least_s: float, gap_s: float):
    """Stops of one piece of a device, whose items come in order, as tuples of STOPS; takes a frame or a dict of columns."""

    def decode(x) -> list[tuple]:
        v = {c.split()[0]: np.asarray(x[c.split()[0]]) for c in DWELL.split(", ")}
        r = {c: a.tolist() for c, a in v.items()}
        n = len(r["t0"])
        # Legs between items: length, seconds, and whether a vehicle could have driven them.
        leg = np.append(0.0, metres(v["lat1"][:-1], v["lon1"][:-1], v["lat0"][1:], v["lon0"][1:]))
        wait = np.append(0.0, (v["t0"][1:] - v["t1"][:-1]) / 1e6)
        steep = leg / np.maximum(wait, 1.0) > TOP_MPS
        # upto[i]: cost of travelling over all items before i. begun[i]: start of the stop that ends before i; before[i]: end of the stop before one from i.
        cost = 0.5 * v["n"] + STEEP * v["steep"]
        cost = cost + np.where(v["dwell"].astype(bool), (v["t1"] - v["t0"]) / 1e6 / STILL_S, 0.0)  # standing still is dear to travel
        cost[1:] += (STEEP * steep + (leg <= radius) * np.maximum(wait, 1.0) / STILL_S)[1:]
        upto = [0.0, *np.cumsum(cost).tolist()]
        begun, before = [0] * (n + 1), [0] * n
        # The stops' ends that a travel may still come from, by cost less upto: none that another undercuts by LONGEST.
        ends: list[tuple[float, int]] = []
        least_end = 0.0
        lats, lons, weights, dwell = r["lat"], r["lon"], r["n"], r["dwell"]
        border = [d or k <= 2 for d, k in zip(dwell, weights)]
        near = [radius * (1.0 if d or k == 1 else 0.5) for d, k in zip(dwell, weights)]
        near_deg = math.degrees(radius / EARTH_M) * 1.001  # further north or south is further away, without asking for more
        inside = [OFF * k for k in r["n_off"]]
        outside = [OFF * (k + d) for d, k in zip(dwell, weights)]
        # Open stops wait in a heap by what they cost so far. That never falls, so one is carried on over the items it has
        # not seen only while it could still be the cheapest, and none is given up.
        waiting: list[tuple] = []
        for b in range(n):
            # An end as dear as this can as well be travelled through: the next travel's duration costs LONGEST at most.
            least, start = upto[b + 1] + least_end + LONGEST, None
            if border[b]:
                here = upto[b]
                for low, e in ends:
                    cost = low + upto[b] + _duration((r["t0"][b] - r["t1"][e - 1]) / 1e6, TRAVEL_S)
                    if cost < here:
                        here, before[b] = cost, e
                heappush(waiting, (here + ENTER + inside[b], b, b, True, lats[b], lons[b], weights[b]))
            seen = []
            while waiting and waiting[0][0] < least:
                so_far, a, at, edge, lat, lon, weight = heappop(waiting)
                while at < b and so_far < least:
                    at += 1
                    edge = border[at] and abs(lats[at] - lat) <= near_deg and _metres(lat, lon, lats[at], lons[at]) <= near[at]
                    so_far += inside[at] if edge else outside[at]
                    if edge and dwell[at]:
                        w = weight + weights[at]
                        lat, lon, weight = (lat * weight + lats[at] * weights[at]) / w, (lon * weight + lons[at] * weights[at]) / w, w
                seen.append((so_far, a, at, edge, lat, lon, weight))
                span = (r["t1"][b] - r["t0"][a]) / 1e6
                if at == b and edge and span >= least_s:
                    cost = so_far + _duration(span, STOP_S)
                    if cost < least:
                        least, start = cost, a
            for x in seen:
                heappush(waiting, x)
            if start is not None and (low := least - upto[b + 1]) < 0:  # else travelling all along is cheaper
                begun[b + 1], least_end = start, min(least_end, low)
                ends = [x for x in (*ends, (low, b + 1)) if x[0] < least_end + LONGEST]
        spans, i = [], min(ends)[1] if ends else 0
        while i > 0:
            spans.append((begun[i], i - 1))
            i = before[begun[i]]
        spans.reverse()
        # A way is split at long silences and at legs that nothing can have driven: these add nothing to its length.
        counted = np.cumsum(np.where((wait <= gap_s) & ~steep, leg, 0.0))
        moved = np.append(0.0, np.cumsum(v["path_m"]))
        out = []
        for k, (a, b) in enumerate(spans):
            c = spans[k + 1][0] if k + 1 < len(spans) else None
            way = None if c is None else float(counted[c] - counted[b] + moved[c] - moved[b + 1])
            keep = [i for i in range(a, b + 1) if r["dwell"][i]] or [a]
            w = sum(r["n"][i] for i in keep)
            out.append((r["device_id"][0], r["t0"][a], r["t1"][b], r["id0"][a], r["id1"][b], sum(r["lat"][i] * r["n"][i] for i in keep) / w, sum(r["lon"][i] * r["n"][i] for i in keep) / w, w, way))
        return out

    return decode


def _first_pass(radius: float, bridge: int, gap_us: int):
    make = _dwell_maker(radius, bridge, gap_us)

    def run(batches):
        rows: list[tuple] = []
        for day in sorted_groups(batches, "device_id", "day"):
            # Copies of a ping lie side by side.
            once = np.append(True, (np.diff(day["ping_id"]) != 0) | (np.diff(day["us"]) != 0))
            rows += make(day if once.all() else {c: v[once] for c, v in day.items()})
            if len(rows) >= BATCH:
                yield arrow_batch(ITEM, rows)
                rows = []
        yield arrow_batch(ITEM, rows)

    return run


def _second_pass(radius: float, least_s: float, gap_s: float):
    decode = _decoder(radius, least_s, gap_s)

    def run(batches):
        rows: list[tuple] = []
        for piece in sorted_groups(batches, "device_id", "piece"):
            # The cut dwells are a piece's first and last item: the stops that hold them go on in the piece beyond.
            d = {c: v[0] for c, v in piece.items()}
            tail_us = piece["t1"][-1] if piece["tail"][-1] else None
            for stop in decode(piece):
                dev, a, z, id0, id1, lat, lon, n, way = stop
                from_cut = bool(d["head"]) and a == d["t0"]
                if from_cut:  # the part before counts the cut dwell
                    rest = n - int(d["n"])
                    if rest:
                        lat, lon = (lat * n - d["lat"] * d["n"]) / rest, (lon * n - d["lon"] * d["n"]) / rest
                    n = rest
                rows.append((dev, a, z, id0, id1, float(lat), float(lon), n, way, from_cut, z == tail_us))
            if len(rows) >= BATCH:
                yield arrow_batch(SPAN, rows)
                rows = []
        yield arrow_batch(SPAN, rows)

    return run


def _pieces(items: DataFrame) -> DataFrame:
    """Items with their piece: a device's history is cut at the first sure dwell of each day, which belongs to both pieces.

    Only the days' cuts meet per device (one row a day), not the items.
    """
    sure = F.col("dwell") & (F.col("t1") - F.col("t0") >= int(CUT_S * 1e6)) & (F.col("n") >= CUT_N)
    days = items.groupBy("device_id", "day").agg(F.min(F.when(sure, F.col("t0"))).alias("cut"))
    w = Window.partitionBy("device_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("earlier", F.last("cut", ignorenulls=True).over(w)).withColumnsRenamed({"device_id": "_dev", "day": "_day"})
    x = items.join(days, (F.col("device_id") == F.col("_dev")) & (F.col("day") == F.col("_day")))
    none = F.lit(-(1 << 62)).cast("long")
    own = F.coalesce(F.when(F.col("t0") >= F.col("cut"), F.col("cut")), F.col("earlier"), none)
    ends = F.coalesce(F.col("t0") == F.col("cut"), F.lit(False)) & sure
    first = F.struct(own.alias("piece"), ends.alias("head"), F.lit(False).alias("tail"))
    again = F.when(ends, F.struct(F.coalesce("earlier", none).alias("piece"), F.lit(False).alias("head"), F.lit(True).alias("tail")))
    x = x.withColumn("p", F.explode(F.array_compact(F.array(first, again))))
    return x.select(*[c.split()[0] for c in DWELL.split(", ")], "p.piece", "p.head", "p.tail")


def find_stops(pings: DataFrame, radius: float = 60.0, least_s: float = 300.0, gap_s: float = 1800.0, bridge: int = 2) -> DataFrame:
    """(device_id, start_us, end_us, first_ping_id, last_ping_id, lat, lon, n_pings, next_path_m), one row per stop."""
    p = located(pings.where("device_id is not null and ts is not null and ping_id is not null").select("ping_id", "device_id", "ts", "lat", "lon"))
    p = p.select("device_id", F.unix_micros("ts").alias("us"), "ping_id", "lat", "lon").withColumn("day", F.floor(F.col("us") / DAY_US))
    p = hashed(thinned(p), "device_id", "day").sortWithinPartitions("device_id", "day", "us", "ping_id")
    d = p.mapInArrow(_first_pass(radius, bridge, int(gap_s * 1e6)), ITEM)
    # distinct() behind the exchange keeps all columns in it, so that the days' cuts share it with the items.
    d = _pieces(hashed(d, "device_id", "day").distinct())
    s = hashed(d, "device_id", "piece").sortWithinPartitions("device_id", "piece", "t0", "id0").mapInArrow(_second_pass(radius, least_s, gap_s), SPAN)
    # Stops that go on over a cut are one: the cut dwell is the end of the one part and the start of the next.
    w = Window.partitionBy("device_id").orderBy("start_us", "end_us", "from_cut", "first_ping_id")
    goes_on = F.col("from_cut") & F.coalesce(F.lag("to_cut").over(w), F.lit(False))
    s = s.withColumn("stop_no", F.sum(F.when(goes_on, 0).otherwise(1)).over(w))
    mean = lambda c: (F.sum(F.col(c) * F.col("n_pings")) / F.sum("n_pings")).alias(c)
    return s.groupBy("device_id", "stop_no").agg(
        F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.min_by("first_ping_id", F.struct("start_us", "end_us")).alias("first_ping_id"), F.max_by("last_ping_id", F.struct("end_us", "start_us", "from_cut")).alias("last_ping_id"),
        mean("lat"), mean("lon"), F.sum("n_pings").alias("n_pings"), F.max_by("next_path_m", F.struct("end_us", "start_us", "from_cut")).alias("next_path_m"),
    ).drop("stop_no")


def stops_and_trips(pings: DataFrame, **kw) -> DataFrame:
    """Stops and the trips between them: kind, device, first and last ping, start, end, duration_s and distance_m."""
    s = find_stops(pings, **kw)
    w = Window.partitionBy("device_id").orderBy("start_us", "first_ping_id")
    s = s.withColumn("n_start", F.lead("start_us").over(w)).withColumn("n_id", F.lead("first_ping_id").over(w))
    stop = F.struct(F.lit("stop").alias("kind"), F.col("first_ping_id").alias("a"), F.col("last_ping_id").alias("b"), F.col("start_us").alias("s"), F.col("end_us").alias("e"), F.lit(0.0).alias("d"))
    trip = F.struct(F.lit("trip").alias("kind"), F.col("last_ping_id").alias("a"), F.col("n_id").alias("b"), F.col("end_us").alias("s"), F.col("n_start").alias("e"), F.col("next_path_m").alias("d"))
    x = s.select("device_id", "lat", "lon", F.explode(F.array(stop, trip)).alias("x")).where("x.b is not null")
    return x.select(
        F.col("x.kind").alias("kind"), "device_id", F.col("x.a").alias("first_ping_id"), F.col("x.b").alias("last_ping_id"), F.timestamp_micros("x.s").alias("start_ts"), F.timestamp_micros("x.e").alias("end_ts"),
        ((F.col("x.e") - F.col("x.s")) / 1e6).alias("duration_s"), F.col("x.d").alias("distance_m"), F.when(F.col("x.kind") == "stop", F.col("lat")).alias("lat"), F.when(F.col("x.kind") == "stop", F.col("lon")).alias("lon"),
    )
