"""Readers: files, manifests, nested JSON, legacy tables and dataset folders. All lazy but for driver-side discovery."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadgrain.functions.scalars import epoch_to_ts, flatten_structs, nan_to_null
from roadgrain.manifest import check, load_yaml
from roadgrain.operators.frame import union_frames
from roadgrain.operators.position import positioned


def utc_ts(df: DataFrame, col: str = "ts", keep_ns: bool = False) -> DataFrame:
    """A clock column as a UTC instant: nanosecond integers, zone-less times (taken as UTC) or ISO text."""
    if col not in df.columns:
        return df
    kind = dict(df.dtypes)[col]
    if kind == "bigint":
        out = df.withColumn(f"{col}_ns", F.col(col)) if keep_ns else df
        return out.withColumn(col, epoch_to_ts(F.col(col), "ns"))
    if kind == "timestamp_ntz":
        return df.withColumn(col, F.timestamp_micros(F.timestampdiff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(col))))
    return df.withColumn(col, F.try_to_timestamp(col)) if kind == "string" else df


def read_parquet(spark: SparkSession, path, columns: list[str] | None = None, ts: str = "ts", keep_ns: bool = False) -> DataFrame:
    """Parquet with NaN as null and the clock in UTC; columns are pruned at the scan."""
    df = spark.read.parquet(*([str(path)] if isinstance(path, (str, Path)) else [str(p) for p in path]))
    if columns:
        df = df.select(*columns)
    return nan_to_null(utc_ts(df, ts, keep_ns))


def read_csv(spark: SparkSession, path, schema: T.StructType | str | None = None, ts: str | None = "timestamp", sep: str = ",", header: bool = True) -> DataFrame:
    """CSV under an explicit schema (all text without one, never inferred); an unreadable clock is null."""
    paths = [str(path)] if isinstance(path, (str, Path)) else [str(p) for p in path]
    r = spark.read.option("header", header).option("sep", sep).option("enforceSchema", False)
    df = (r.schema(schema) if schema is not None else r).csv(paths)
    return utc_ts(nan_to_null(df), ts) if ts else nan_to_null(df)


def read_jsonl(spark: SparkSession, path, schema: T.StructType | None = None) -> DataFrame:
    """JSON lines as flat dotted columns; arrays stay arrays."""
    paths = [str(path)] if isinstance(path, (str, Path)) else [str(p) for p in path]
    r = spark.read
    return flatten_structs((r.schema(schema) if schema is not None else r).json(paths))


def read_json_dir(spark: SparkSession, folder: str | Path, schema: T.StructType | None = None) -> DataFrame:
    """All *.json (whole documents) and *.jsonl of a folder, in one frame."""
    one, many = (sorted(Path(folder).glob(g)) for g in ("*.json", "*.jsonl"))
    parts = []
    if one:
        r = spark.read.option("multiLine", True)
        parts.append((r.schema(schema) if schema else r).json([str(p) for p in one]))
    if many:
        parts.append((spark.read.schema(schema) if schema else spark.read).json([str(p) for p in many]))
    if not parts:
        raise FileNotFoundError(f"no JSON files in {folder}")
    return flatten_structs(union_frames(parts))


def read_columns_text(spark: SparkSession, path, names: list[str]) -> DataFrame:
    """Header-less, blank-separated text with positional names; short lines give nulls. Adds row position and file."""
    paths = [str(path)] if isinstance(path, (str, Path)) else [str(p) for p in path]
    t = spark.read.text(paths).select(F.split(F.trim("value"), r"\s+").alias("c"), F.monotonically_increasing_id().alias("row_no"), F.input_file_name().alias("file"))
    return t.where(F.col("c")[0] != "").select(*[F.try_element_at("c", F.lit(i + 1)).try_cast("double").alias(n) for i, n in enumerate(names)], "row_no", "file")


def manifest_files(path: str | Path) -> list[tuple[Path, str]]:
    """(file, format) of a manifest: its data files that exist, else its tables, else the folder's Parquet files."""
    path = Path(path)
    m = load_yaml(path)
    listed = [(path.parent / f["path"], f.get("format", "parquet")) for f in m.get("data_files") or [] if f.get("path")]
    found = [(p, fmt) for p, fmt in listed if p.exists() and fmt == "parquet"]
    if not found:
        tables = m.get("tables") or {}
        found = [(p, "parquet") for p in (path.parent / (v if isinstance(v, str) else v.get("path", "")) for v in tables.values()) if p.exists() and p.is_file() or p.is_dir() and p != path.parent]
    if not found:
        found = [(p, "parquet") for p in sorted(path.parent.glob("*.parquet"))]
    if not found:
        raise FileNotFoundError(f"no data files for {path}")
    return found


def read(spark: SparkSession, path: str | Path, position: bool = False) -> DataFrame:
    """A manifest's data or a Parquet file, by suffix; with ``position`` the rows' places in the files as well."""
    p = Path(path)
    if p.suffix in (".yaml", ".yml"):
        return union_frames([_placed(spark, f, n, position) for n, (f, _) in enumerate(manifest_files(p))])
    if p.suffix == ".parquet":
        return _placed(spark, p, 0, position)
    raise ValueError(f"can't read {p.suffix or 'a path without suffix'}")


def _placed(spark: SparkSession, path: Path, n: int, position: bool) -> DataFrame:
    return nan_to_null(utc_ts(positioned(spark.read.parquet(str(path)), n))) if position else read_parquet(spark, path)


class Dataset:
    """A checked manifest with its tables, each read lazily and pruned to the columns asked for."""

    def __init__(self, path: Path, meta: dict):
        self.path, self.meta = path, meta

    @classmethod
    def from_manifest(cls, path: str | Path) -> Dataset:
        m = load_yaml(path)
        r = check(m)
        if not r.ok:
            raise ValueError("; ".join(r.errors))
        return cls(Path(path), m)

    @classmethod
    def from_path(cls, path: str | Path) -> Dataset:
        """A manifest, or the manifest of a folder."""
        p = Path(path)
        if p.is_dir():
            p = next((p / n for n in ("manifest.yaml", "dataset.yaml", "manifest.yml") if (p / n).exists()), p / "manifest.yaml")
        return cls.from_manifest(p)

    @property
    def tables(self) -> dict[str, Path]:
        t = self.meta.get("tables") or {}
        return {k: self.path.parent / (v if isinstance(v, str) else v["path"]) for k, v in t.items()}

    def table_path(self, name: str) -> Path:
        if name not in self.tables:
            raise KeyError(f"the manifest declares no table {name!r}")
        return self.tables[name]

    def read(self, spark: SparkSession, name: str, columns: list[str] | None = None) -> DataFrame:
        return read_parquet(spark, self.table_path(name), columns, ts="timestamp")

    def validate_all(self, spark: SparkSession, schemas: dict[str, str] | None = None, **kw) -> dict[str, list[str]]:
        """Action: problems of each table against the schema of its name (``schemas`` names others)."""
        from roadgrain.validate import validate_schema

        names = {"imu": "imu_legacy"} | (schemas or {})
        return {n: validate_schema(self.read(spark, n), names.get(n, n), **kw) for n in self.tables}

    def summary(self, spark: SparkSession) -> dict[str, dict]:
        """Action: per table rows, columns and time span; an unreadable one has an empty entry."""
        out = {}
        for name in self.tables:
            try:
                df = self.read(spark, name)
                t = next((c for c in ("timestamp", "ts") if c in df.columns), None)
                a = df.agg(F.count("*").alias("rows"), *([F.min(t).alias("a"), F.max(t).alias("z")] if t else [])).first()
                out[name] = {"rows": a["rows"], "columns": len(df.columns)} | ({"time_min": a["a"] and a["a"].isoformat(), "time_max": a["z"] and a["z"].isoformat()} if t else {})
            except Exception:
                out[name] = {}
        return out

    def describe(self) -> str:
        """Text of the id and per table rows and columns, from Parquet footers only."""
        import pyarrow.parquet as pq

        hz = self.meta.get("frequency_hz")
        lines = [f"dataset {self.meta.get('dataset_id')}" + (f", {hz} Hz" if hz else "")]
        for name, p in self.tables.items():
            try:
                files = [p] if p.is_file() else sorted(p.glob("*.parquet"))
                heads = [pq.ParquetFile(f) for f in files]
                lines.append(f"{name}: {sum(h.metadata.num_rows for h in heads)} rows, {len(heads[0].schema_arrow.names)} columns" if heads else f"{name}: absent")
            except Exception:
                lines.append(f"{name}: unreadable")
        return "\n".join(lines)


def load_dataset(spark: SparkSession, manifest: str | Path) -> dict[str, DataFrame]:
    """Every declared table, lazily; a missing manifest or table raises."""
    if not Path(manifest).exists():
        raise FileNotFoundError(str(manifest))
    d = Dataset(Path(manifest), load_yaml(manifest))
    for p in d.tables.values():
        if not p.exists():
            raise FileNotFoundError(str(p))
    return {name: d.read(spark, name) for name in d.tables}


def read_table(spark: SparkSession, manifest: str | Path, name: str) -> DataFrame:
    return Dataset(Path(manifest), load_yaml(manifest)).read(spark, name)


def sample_folders(root: str | Path) -> list[Path]:
    """Every folder under root that holds a dataset.json."""
    return sorted(p.parent for p in Path(root).rglob("dataset.json"))


def read_samples(spark: SparkSession, folder: str | Path, prefer: str = "csv") -> tuple[dict, DataFrame]:
    """A legacy samples folder: its metadata, and samples in the preferred format or the other one."""
    folder = Path(folder)
    meta = json.loads((folder / "dataset.json").read_text())
    for fmt in (prefer, "parquet" if prefer == "csv" else "csv"):
        p = folder / f"samples.{fmt}"
        if p.exists():
            return meta, read_csv(spark, p, ts=None) if fmt == "csv" else read_parquet(spark, p)
    raise FileNotFoundError(f"no samples in {folder}")


class RecordSet:
    """Fluent wrapper of a frame of records: filters, mapping, context, checks, completeness and writers."""

    def __init__(self, df: DataFrame, schema: T.StructType | None = None):
        self.df, self.schema = df, schema

    @classmethod
    def load(cls, spark, path):
        """By suffix: JSON lines, Parquet, or a manifest's data."""
        kind = Path(path).suffix
        return cls.from_jsonl(spark, path) if kind in (".jsonl", ".json") else cls.from_parquet(spark, path) if kind == ".parquet" else cls.from_dataset(spark, path)

    @classmethod
    def from_dataset(cls, spark, path):
        p = Path(path)
        return cls(read(spark, p if p.suffix in (".yaml", ".yml") else Dataset.from_path(p).path))

    @classmethod
    def from_jsonl(cls, spark, path):
        return cls(read_jsonl(spark, path))

    @classmethod
    def from_parquet(cls, spark, path):
        return cls(read_parquet(spark, path, ts="timestamp"))

    @classmethod
    def from_dataframe(cls, df):
        if not hasattr(df, "sparkSession"):
            raise TypeError("a Spark DataFrame is needed")
        return cls(df)

    @classmethod
    def from_records(cls, spark, records: list[dict], schema=None):
        return cls(flatten_structs(spark.createDataFrame(records, schema)))

    def with_schema(self, schema: T.StructType) -> RecordSet:
        self.schema = schema
        return self

    def filter_time(self, start=None, end=None) -> RecordSet:
        from roadgrain.operators.frame import filter_time

        return RecordSet(filter_time(self.df, start, end, "timestamp"), self.schema)

    def select_fields(self, fields) -> RecordSet:
        from roadgrain.operators.frame import select_fields

        return RecordSet(select_fields(self.df, fields), self.schema)

    def map_provider(self, mapping) -> RecordSet:
        return RecordSet(self.df.withColumnsRenamed(mapping), self.schema)

    def add_context(self, name, values) -> RecordSet:
        from roadgrain.operators.frame import add_context

        return RecordSet(add_context(self.df, name, values), self.schema)

    def validate(self) -> list[str]:
        """Absent required fields of the schema set before (all of timestamp, vehicle_id and position without one)."""
        need = [f.name for f in self.schema if not f.nullable] if self.schema else ["timestamp", "vehicle_id", "position.lat", "position.lon"]
        return [c for c in need if c not in self.df.columns and not any(x.startswith(c + ".") for x in self.df.columns)]

    def summary(self, fields: list[str] | None = None) -> dict:
        """Action: rows, sorted columns, time span and completeness."""
        from roadgrain.operators.aggregates import CORE_FIELDS, completeness_score

        t = "timestamp" if "timestamp" in self.df.columns else None
        a = self.df.agg(F.count("*").alias("n"), *([F.min(t).alias("a"), F.max(t).alias("z")] if t else [])).first()
        return {"rows": a["n"], "columns": sorted(self.df.columns), "time_min": a["a"] if t else None, "time_max": a["z"] if t else None, "score_pct": completeness_score(self.df, fields or CORE_FIELDS).first()["score_pct"]}

    def to_parquet(self, path, validate_before: bool = False) -> None:
        from roadgrain.sources.sinks import write_parquet

        if validate_before and (bad := self.validate()):
            raise ValueError(f"fields are absent: {bad}")
        write_parquet(self.df, path)

    def to_jsonl(self, path) -> None:
        from roadgrain.sources.sinks import write_jsonl

        write_jsonl(self.df, path)
