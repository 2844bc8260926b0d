"""Session factory, partitioning by the size of the input, and helpers for Arrow batches in workers."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings an engine session needs for right results (not tuning).
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.legacy.parquet.nanosAsLong": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def get_session(app: str = "roadgrain", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC clock, nanosecond Parquet columns as bigint and AQE on.

    ``conf`` keys are Spark settings with dots written as double underscores. The master is only
    set when given, so on a cluster spark-submit decides it.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**REQUIRED, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def scratch(spark: SparkSession) -> Path:
    """A new folder for written tables, below the shared folder that the session names in spark.checkpoint.dir.

    Only where that is unset and the master is local (tests) a temporary folder is made.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        return Path(tempfile.mkdtemp(prefix="roadgrain-"))
    folder = Path(shared.removeprefix("file://").removeprefix("file:")) / f"roadgrain-{uuid.uuid4().hex}"
    folder.mkdir(parents=True)
    return folder


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's code to the executors' Python workers, once per application."""
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_roadgrain_shipped", False):
        return spark
    root = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="roadgrain-code-")) / "roadgrain.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    sc.addPyFile(str(out))
    sc._roadgrain_shipped = True
    return spark


#: Bytes of input per part of a shuffle by key.
PART_BYTES = 128 << 20


def parts(df: DataFrame, part_bytes: int = PART_BYTES) -> int:
    """Parts for a shuffle of a frame: spark.sql.shuffle.partitions, or more where its inputs need more of ``part_bytes``.

    Only the sizes that the optimiser knows of the scans are looked at (unknown ones count as nothing); no job runs.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(x for x in sizes if x < 1 << 60)
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), known // part_bytes)


def hashed(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partitioning by keys into ``parts`` parts, which grow with the input and are not merged for being small.

    For expensive work per row or group behind the shuffle, where bytes say little about the work.
    """
    return df.repartition(parts(df), *keys)


def thinned(df: DataFrame) -> DataFrame:
    """The rows without repetitions inside an Arrow batch, so that a row sent again and again is thinned out before a shuffle.

    Whole rows are compared; what is left of repetitions is for a ``distinct`` behind the shuffle.
    """

    def once(batches):
        import pyarrow as pa

        for b in batches:
            t = pa.Table.from_batches([b])
            few = t.group_by(t.column_names, use_threads=False).aggregate([])
            yield from (few if few.num_rows < t.num_rows else t).select(t.column_names).to_batches()

    return df.mapInArrow(once, df.schema)


def arrow_batch(ddl: str, rows: list[tuple]):
    """Rows as an Arrow batch of a flat DDL schema (long, int, double, string, boolean and arrays of these); for workers."""
    import pyarrow as pa

    plain = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    kind = lambda t: pa.list_(plain[t[6:-1]]) if t.startswith("array<") else plain[t]
    fields = [(n, kind(t)) for n, t in (c.split(" ") for c in ddl.split(", "))]
    cols = zip(*rows) if rows else ([] for _ in fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields)], names=[n for n, _ in fields])


def sorted_groups(batches, *keys: str):
    """Groups of rows that come sorted by keys, as dicts of numpy columns; for workers, where groups are many and small."""
    import numpy as np

    held: list[dict] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = {n: c.to_numpy(zero_copy_only=False) for n, c in zip(b.schema.names, b.columns)}
        new = np.zeros(b.num_rows, bool)
        for k in keys:
            new[1:] |= cols[k][1:] != cols[k][:-1]
        new[0] = bool(held) and any(held[-1][k][-1] != cols[k][0] for k in keys)
        at = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for n, (a, z) in enumerate(zip(at, at[1:])):
            if n and held:
                yield _joined(held)
                held = []
            if z > a:
                held.append({c: v[a:z] for c, v in cols.items()})
    if held:
        yield _joined(held)


def _joined(held: list[dict]) -> dict:
    import numpy as np

    return held[0] if len(held) == 1 else {c: np.concatenate([h[c] for h in held]) for c in held[0]}
