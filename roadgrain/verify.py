"""End-to-end verification of a legacy samples folder: columns, order, rate, ranges, flags, distance."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from roadgrain.functions.geo import haversine_km
from roadgrain.operators.frame import event_defaults, resolve_aliases
from roadgrain.operators.position import before, numbered, positioned
from roadgrain.sources.readers import read_samples, sample_folders

#: Columns that a samples folder must have (after aliases), the event columns and their defaults, and the recommended one.
REQUIRED = ["timestamp", "lat", "lon", "speed", "acc_x", "acc_y", "acc_z", "gyro_x", "gyro_y", "gyro_z"]
FLAGS = ["event_infra", "event_behavior", "event_context"]
RECOMMENDED = ["altitude_m"]


@dataclass
class Verdict:
    folder: str
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    facts: dict = field(default_factory=dict)

    @property
    def code(self) -> int:
        return 1 if self.errors else 0


def verify(spark: SparkSession, folder: str | Path, min_hz: float = 9.5, max_hz: float = 10.5, strict: bool = False, prefer: str = "csv") -> Verdict:
    """Action: one pass over the rows with the row before each, in blocks; a second one where the distance takes every k-th row."""
    v = Verdict(str(folder))
    try:
        meta, df = read_samples(spark, folder, prefer)
    except FileNotFoundError as e:
        v.errors.append(str(e))
        return v
    df = event_defaults(resolve_aliases(positioned(df), meta.get("column_aliases") or {}), [], ["event"])
    df = df.withColumns({c: F.lit(0) for c in FLAGS if c not in df.columns})
    absent = [c for c in REQUIRED if c not in df.columns]
    if absent:
        v.errors.append(f"columns are absent: {absent}")
        return v
    for c in RECOMMENDED:
        if c not in df.columns:
            (v.errors if strict else v.warnings).append(f"the recommended column {c} is absent")
    num = [c for c in (*REQUIRED[1:], *FLAGS, "altitude_m") if c in df.columns]
    df = df.withColumns({c: F.col(c).try_cast("double") for c in num})
    x = before(df, ["timestamp", "lat", "lon"])
    x = x.withColumn("_dt", (F.unix_micros("timestamp") - F.unix_micros(F.col("_prev.timestamp"))) / 1e6)
    a = x.agg(
        F.count("*").alias("n"), F.count_if(F.col("timestamp").isNull()).alias("no_ts"), F.count_if(F.col("_dt") < 0).alias("back"), F.median("_dt").alias("dt"),
        F.min("timestamp").alias("a"), F.max("timestamp").alias("z"),
        F.count_if(~F.col("lat").between(-90, 90)).alias("lat"), F.count_if(~F.col("lon").between(-180, 180)).alias("lon"), F.count_if(F.col("speed") < 0).alias("neg"), F.count_if(F.col("speed") > 70).alias("fast"),
        *[F.count_if(~F.col(c).isin(0.0, 1.0)).alias(f"flag_{c}") for c in FLAGS],
        *([F.count_if(~F.col("altitude_m").between(-500, 9000)).alias("alt")] if "altitude_m" in df.columns else []),
    ).first()
    hz = 1 / a["dt"] if a["dt"] else None
    for k, text in (("no_ts", "rows without a readable time"), ("back", "rows go back in time"), ("lat", "latitudes out of range"), ("lon", "longitudes out of range"), ("neg", "negative speeds")):
        if a[k]:
            v.errors.append(f"{a[k]} {text}")
    if hz is None or not min_hz <= hz <= max_hz:
        v.errors.append(f"the rate is {hz and round(hz, 3)} Hz, outside {min_hz} to {max_hz}")
    if a["fast"]:
        v.warnings.append(f"{a['fast']} speeds over 70 m/s")
    for c in FLAGS:
        if a[f"flag_{c}"]:
            v.warnings.append(f"{a[f'flag_{c}']} values of {c} are no flags")
    if "alt" in a.asDict() and a["alt"]:
        (v.errors if strict else v.warnings).append(f"{a['alt']} altitudes out of range")
    if isinstance(meta.get("records"), int) and meta["records"] != a["n"]:
        v.errors.append(f"{a['n']} rows, but {meta['records']} are declared")
    step = max(1, round(1 / (hz or 10)))  # about one row a second where rows are rarer than that
    if step > 1:
        x = before(numbered(df, "_n").where(F.col("_n") % step == 0), ["lat", "lon"])
    d = x.agg(F.sum(haversine_km(F.col("_prev.lat"), F.col("_prev.lon"), F.col("lat"), F.col("lon")))).first()[0]
    v.facts = {"rows": a["n"], "rate_hz": hz, "distance_km": d, "duration_s": (a["z"] - a["a"]).total_seconds() if a["a"] else None}
    return v


def verify_all(spark: SparkSession, root: str | Path, **kw) -> list[Verdict]:
    return [verify(spark, f, **kw) for f in sample_folders(root)]
