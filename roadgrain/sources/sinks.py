"""Writers: Parquet, CSV, JSON lines, per-trip files and the legacy three-table export."""

from __future__ import annotations

from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadgrain import schema as S
from roadgrain.functions.scalars import ts_to_ns


def write_parquet(df: DataFrame, path: str | Path, compression: str = "snappy", partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    w = df.write.mode(mode).option("compression", compression)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(str(path))


def write_zstd(df: DataFrame, path: str | Path, **kw) -> None:
    write_parquet(df, path, "zstd", **kw)


#: Text of an instant: to the microsecond, which is what the engine keeps.
STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def write_csv(df: DataFrame, path: str | Path, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("timestampFormat", STAMP).csv(str(path))


def write_jsonl(df: DataFrame, path: str | Path, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("timestampFormat", STAMP).json(str(path))


def write_trips(df: DataFrame, path: str | Path, manifest: str | Path | None = None) -> DataFrame:
    """Action: one folder per trip, rows of a trip together, and counts per sensor as JSON lines (``manifest``, a folder).

    Returns the counts lazily: one row per trip, which nothing collects.
    """
    from roadgrain.operators.aggregates import sensor_counts

    have = df.withColumns({c: F.lit(None).cast("double") for c in ("lat", "ax_mps2", "gx_rad_s", "speed_obd_mps") if c not in df.columns})
    write_zstd(df.repartition("trip_id"), path, partition_by=["trip_id"])
    counts = sensor_counts(have, ["trip_id"])
    if manifest:
        write_jsonl(counts, manifest)
    return counts


def export_tables(spark: SparkSession, trajectory: str, imu: str, out: str | Path, events: str | None = None, dataset_id: str = "export", freq_hz: float | None = None) -> Path:
    """Action: simulator CSVs to the legacy trio and a dataset.yaml; without events the table is empty, not absent."""
    from roadgrain.sources.readers import read_csv

    out = Path(out)
    out.mkdir(parents=True, exist_ok=True)
    ns = lambda df: df if "timestamp_ns" in df.columns else df.withColumn("timestamp_ns", F.coalesce(F.col("timestamp").try_cast("long"), ts_to_ns(F.try_to_timestamp("timestamp"))))
    frames = {}
    t = ns(read_csv(spark, trajectory, ts=None)).withColumnsRenamed({"speed": "speed_mps"})
    frames["trajectory"] = t if "alt" in t.columns else t.withColumn("alt", F.lit(None))
    frames["imu"] = ns(read_csv(spark, imu, ts=None))
    if events:
        e = ns(read_csv(spark, events, ts=None))
        frames["events"] = e.withColumns({c: F.lit(None).cast("string") for c in ("severity", "meta") if c not in e.columns})
    else:
        frames["events"] = spark.createDataFrame([], S.LEGACY["events"])
    for name, df in frames.items():
        write_zstd(df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in S.LEGACY[name]]), out / f"{name}.parquet")
    m = {"dataset_id": dataset_id, "frequency_hz": freq_hz, "units": {"speed": "m/s", "acceleration": "m/s^2", "gyro": "rad/s"}, "tables": {n: f"{n}.parquet" for n in frames}}
    (out / "dataset.yaml").write_text(yaml.safe_dump({k: v for k, v in m.items() if v is not None}, sort_keys=False))
    return out / "dataset.yaml"


def json_dir_to_parquet(spark: SparkSession, folder: str | Path, out: str | Path) -> int:
    """Action: every JSON document of a folder to one Parquet set; the first invalid record aborts."""
    from roadgrain.sources.readers import RecordSet, read_json_dir

    df = read_json_dir(spark, folder)
    if bad := RecordSet(df).validate():
        raise ValueError(f"fields are absent: {bad}")
    need = [c for c in ("timestamp", "vehicle_id") if c in df.columns]
    worst = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in need], F.count("*").alias("_n")).first()
    if any(worst[c] for c in need):
        raise ValueError(f"records lack {[c for c in need if worst[c]]}")
    write_parquet(df, out)
    return worst["_n"]
