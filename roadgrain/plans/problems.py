"""Queries of the general training-data problems, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadgrain.operators.compaction import consolidate, copies, output_files
from roadgrain.operators.drift import consistent_table, file_schemas, schema_changes
from roadgrain.operators.grid import regular_grid
from roadgrain.operators.spikes import candidates, faults
from roadgrain.operators.stops import stops_and_trips
from roadgrain.operators.units import foreign_units, resolve_units
from roadgrain.sources import table

#: A demonstration size for the landing zone of the test tables; production files use the operator's default.
SMALL_TARGET = 1 << 20


def p1_found(s: SparkSession, d: str) -> DataFrame:
    return foreign_units(table(s, d, "provider_readings"), table(s, d, "provider_units"))


def p1_values(s: SparkSession, d: str) -> DataFrame:
    return resolve_units(table(s, d, "provider_readings"), table(s, d, "provider_units"))


def p2_found(s: SparkSession, d: str) -> DataFrame:
    c = schema_changes(table(s, d, "dataset_v01_legacy"), table(s, d, "legacy_rows"))
    return c.select("file_id", "column_name", "change_kind").distinct()


def p2_changes(s: SparkSession, d: str) -> DataFrame:
    return schema_changes(table(s, d, "dataset_v01_legacy"), table(s, d, "legacy_rows"))


def p2_schemas(s: SparkSession, d: str) -> DataFrame:
    return file_schemas(table(s, d, "legacy_rows"))


def p2_table(s: SparkSession, d: str) -> DataFrame:
    return consistent_table(table(s, d, "dataset_v01_legacy"), table(s, d, "legacy_rows"))


def p3_found(s: SparkSession, d: str) -> DataFrame:
    return faults(table(s, d, "records"), table(s, d, "trips")).select("rec_id", "field_name")


def p3_faults(s: SparkSession, d: str) -> DataFrame:
    return faults(table(s, d, "records"), table(s, d, "trips")).withColumn("fault", F.array_join("fault", "+"))


def p3_candidates(s: SparkSession, d: str) -> DataFrame:
    return candidates(table(s, d, "records"), table(s, d, "trips"))


def p4_found(s: SparkSession, d: str) -> DataFrame:
    return regular_grid(table(s, d, "records")).where("n_readings = 0").select("trip_id", "slot_start_s")


def p4_series(s: SparkSession, d: str) -> DataFrame:
    return regular_grid(table(s, d, "records"))


def p4_fit(s: SparkSession, d: str) -> DataFrame:
    g = regular_grid(table(s, d, "records"))
    return g.select("trip_id", "slot_start_s", "n_readings", F.round("support", 4).alias("support"), F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), "state")


def p5_found(s: SparkSession, d: str) -> DataFrame:
    return copies(table(s, d, "trip_fragments"))


def p5_files(s: SparkSession, d: str) -> DataFrame:
    return output_files(table(s, d, "trip_fragments"), SMALL_TARGET)


def p5_records(s: SparkSession, d: str) -> DataFrame:
    return consolidate(table(s, d, "trip_fragments"))


def p7_found(s: SparkSession, d: str) -> DataFrame:
    return stops_and_trips(table(s, d, "pings")).select("kind", "device_id", "first_ping_id", "last_ping_id")


def p7_segments(s: SparkSession, d: str) -> DataFrame:
    return stops_and_trips(table(s, d, "pings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (p1_found, p1_values, p2_found, p2_changes, p2_schemas, p2_table, p3_found, p3_faults, p3_candidates, p4_found, p4_series, p4_fit, p5_found, p5_files, p5_records, p7_found, p7_segments)
    return {f.__name__: f for f in own}


_FAULTS = """
WITH dev AS (SELECT trip_id AS t, min(device_id) AS d FROM trips GROUP BY 1),
r AS (SELECT DISTINCT rec_id, trip_id, coalesce(device_id, dev.d) AS source, epoch_us(ts) AS us, ax_mps2, gx_rad_s, speed_mps
      FROM records LEFT JOIN dev ON trip_id = dev.t),
l AS (SELECT rec_id, trip_id, source, us, 'ax_mps2' AS f, CAST(ax_mps2 AS DOUBLE) AS v FROM r WHERE ax_mps2 IS NOT NULL
      UNION ALL SELECT rec_id, trip_id, source, us, 'gx_rad_s', CAST(gx_rad_s AS DOUBLE) FROM r WHERE gx_rad_s IS NOT NULL
      UNION ALL SELECT rec_id, trip_id, source, us, 'speed_mps', CAST(speed_mps AS DOUBLE) FROM r WHERE speed_mps IS NOT NULL),
u AS (SELECT source, f, quantile_cont(v, 0.5) AS level, (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.349 AS spread
      FROM l WHERE f <> 'speed_mps' GROUP BY 1, 2),
o AS (SELECT source, v, lag(v) OVER w AS below, row_number() OVER w - 1 AS n_below, count(*) OVER (PARTITION BY source) AS n
      FROM l WHERE f = 'speed_mps' AND v >= 0 WINDOW w AS (PARTITION BY source ORDER BY v)),
c AS (SELECT source, min(v) AS ceiling FROM o WHERE v > 2 * below AND below > 0 AND n_below > n - n_below GROUP BY 1),
s AS (SELECT *, CASE WHEN lag(v) OVER w = v THEN 0 ELSE 1 END AS b FROM l WINDOW w AS (PARTITION BY trip_id, f ORDER BY us, rec_id)),
g AS (SELECT *, sum(b) OVER (PARTITION BY trip_id, f ORDER BY us, rec_id) AS run FROM s),
n AS (SELECT *, count(*) OVER (PARTITION BY trip_id, f, run) AS len FROM g)
SELECT rec_id, n.f AS field_name FROM n
LEFT JOIN u ON n.source IS NOT DISTINCT FROM u.source AND n.f = u.f
LEFT JOIN c ON n.source IS NOT DISTINCT FROM c.source AND n.f = 'speed_mps'
WHERE abs(v - level) > 10 * spread OR (len >= 8 AND v <> 0) OR (n.f = 'speed_mps' AND (v < 0 OR v >= ceiling))
"""

_EMPTY_SLOTS = """
WITH l AS (SELECT DISTINCT trip_id, CAST(floor(epoch_us(ts) / 5000000.0) AS BIGINT) AS slot FROM records
           WHERE trip_id IS NOT NULL AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0)
             AND NOT isnan(lat) AND NOT isnan(lon)),
e AS (SELECT trip_id, unnest(generate_series(min(slot), max(slot))) AS slot FROM l GROUP BY 1)
SELECT trip_id, slot * 5 AS slot_start_s FROM e ANTI JOIN l USING (trip_id, slot)
"""

#: The regression by its definition: every reading weighted for every slot beside it.
_FIT = """
WITH l AS (SELECT DISTINCT rec_id, trip_id, CAST(floor(epoch_us(ts) / 5000000.0) AS BIGINT) AS slot, epoch_us(ts) / 5000000.0 AS x, lat, lon FROM records
           WHERE trip_id IS NOT NULL AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0) AND NOT isnan(lat) AND NOT isnan(lon)),
e AS (SELECT trip_id, unnest(generate_series(min(slot), max(slot))) AS slot FROM l GROUP BY 1),
p AS (SELECT e.trip_id, e.slot, l.slot = e.slot AS own, l.x - e.slot - 0.5 AS t, 1 - pow((l.x - e.slot - 0.5) / 1.5, 2) AS w, lat, lon
      FROM e LEFT JOIN l ON e.trip_id = l.trip_id AND l.slot BETWEEN e.slot - 1 AND e.slot + 1),
f AS (SELECT trip_id, slot, count(*) FILTER (own) AS n, coalesce(sum(w), 0) AS w0, sum(w * t) AS w1, sum(w * t * t) AS w2, sum(w * lat) AS a0, sum(w * t * lat) AS a1, sum(w * lon) AS o0, sum(w * t * lon) AS o1 FROM p GROUP BY 1, 2)
SELECT trip_id, slot * 5 AS slot_start_s, n AS n_readings, round(w0, 4) AS support,
  CASE WHEN w0 >= 0.5 OR n > 0 THEN round(CASE WHEN w0 * w2 - w1 * w1 > 1e-6 * w0 THEN (w2 * a0 - w1 * a1) / (w0 * w2 - w1 * w1) ELSE a0 / w0 END, 4) END AS lat,
  CASE WHEN w0 >= 0.5 OR n > 0 THEN round(CASE WHEN w0 * w2 - w1 * w1 > 1e-6 * w0 THEN (w2 * o0 - w1 * o1) / (w0 * w2 - w1 * w1) ELSE o0 / w0 END, 4) END AS lon,
  CASE WHEN n > 0 THEN 'observed' WHEN w0 >= 0.5 THEN 'filled' ELSE 'missing' END AS state FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {"p3_found": _FAULTS, "p4_found": _EMPTY_SLOTS, "p4_fit": _FIT}
