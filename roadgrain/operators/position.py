"""Rows in their physical order, without a window over a whole table: blocks of rows, and the blocks' ends joined.

A DataFrame has no order of its own; ``positioned`` takes the one of the files. Windows run inside blocks of ``BLOCK``
positions; only one row per block meets over the whole table (or key).
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16
#: The order that ``positioned`` adds: file, start of the split, place.
ORDER = ["_file", "_start", "_row"]


def _sorted(df: DataFrame) -> bool:
    """Whether a sort stands over the frame's only source, so that its rows no longer come as the files have them."""
    p = df._jdf.queryExecution().analyzed()
    while p.nodeName() != "Sort":
        if p.children().size() != 1:
            return False
        p = p.children().apply(0)
    return True


def positioned(df: DataFrame, file_no: int = 0) -> DataFrame:
    """Adds ORDER: the file (``file_no`` first, then its path) and the row's place in it.

    For a frame that is no scan of files, or a sorted one, the place is that of Spark's partitions, which keep the order of their making.
    """
    path = F.concat(F.lpad(F.lit(str(file_no)), 8, "0"), F.lit("/"), F.col("_metadata.file_path"))
    mid = F.monotonically_increasing_id()
    files = [] if _sorted(df) else [(path, F.lit(0).cast("long"), F.col("_metadata.row_index")), (path, F.col("_metadata.file_block_start"), mid)]
    for file, start, row in (*files, (F.lit(f"{file_no:08d}"), F.lit(0).cast("long"), mid)):
        try:
            return df.select("*", file.alias("_file"), start.alias("_start"), row.alias("_row"))
        except AnalysisException:
            continue
    raise AssertionError


def _parts(df: DataFrame, order: list[str], by: list[str], block: int) -> tuple[DataFrame, list[str]]:
    return df.withColumn("_b", F.floor(F.col(order[-1]) / block)), [*by, *order[:-1], "_b"]


def _back(x: DataFrame, ends: DataFrame, part: list[str]) -> DataFrame:
    e = ends.withColumnsRenamed({c: f"_e{c}" for c in part})
    j = x.join(e, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_e{c}")) for c in part]), "left")
    return j.drop(*[f"_e{c}" for c in part])


def before(df: DataFrame, cols: list[str], order: list[str] = ORDER, by: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """Adds ``_prev``: a struct of ``cols`` of the row before in the order, whose last column is a number; null on the first."""
    by = by or []
    x, part = _parts(df, order, by, block)
    last = order[-1]
    ends = x.groupBy(*part).agg(F.max_by(F.struct(*cols), last).alias("_tail"))
    d = (Window.partitionBy(*by) if by else Window).orderBy(*order[:-1], "_b")
    ends = ends.select(*part, F.lag("_tail").over(d).alias("_before"))
    x = x.withColumn("_in", F.lag(F.struct(*cols)).over(Window.partitionBy(*part).orderBy(last)))
    return _back(x, ends, part).withColumn("_prev", F.coalesce("_in", "_before")).drop("_in", "_before", "_b")


def numbered(df: DataFrame, out: str, order: list[str] = ORDER, by: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """Adds the row's number in the order, from 0."""
    by = by or []
    x, part = _parts(df, order, by, block)
    d = (Window.partitionBy(*by) if by else Window).orderBy(*order[:-1], "_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = x.groupBy(*part).agg(F.count("*").alias("_n")).select(*part, F.coalesce(F.sum("_n").over(d), F.lit(0)).alias("_before"))
    x = x.withColumn(out, F.row_number().over(Window.partitionBy(*part).orderBy(order[-1])) - 1)
    return _back(x, ends, part).withColumn(out, F.col(out) + F.col("_before")).drop("_before", "_b")


def out_of_order(df: DataFrame, col: str, order: list[str] = ORDER, by: list[str] | None = None, strict: bool = False) -> DataFrame:
    """Rows that go back (or stand still, if strict) against the row before them in the order."""
    x = before(df, [col], order, by)
    p = F.col("_prev")[col]
    return x.where(F.col(col) <= p if strict else F.col(col) < p).drop("_prev")


def runs(df: DataFrame, col: str, strict: bool = False) -> DataFrame:
    """Runs of rows of a ``positioned`` frame as its tasks read them, without a shuffle of the rows.

    One row per run in an Arrow batch, with its places (``_row`` to ``_to``), first and last value of the integer ``col``,
    and how many rows in it go back (or stand still, if strict) or have none.
    """

    def summed(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            if not b.num_rows:
                continue
            file, start, row, v = b.columns
            gone = np.asarray(v.is_null().to_numpy(zero_copy_only=False), np.int64)
            s, r, v = (c.to_numpy() for c in (start, row, v.fill_null(0)))
            new = np.ones(len(r), bool)
            new[1:] = (s[1:] != s[:-1]) | (r[1:] <= r[:-1]) | pc.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False)
            back = np.zeros(len(r), np.int64)
            back[1:] = ~new[1:] & (v[1:] <= v[:-1] if strict else v[1:] < v[:-1])
            at = np.flatnonzero(new)
            to = np.append(at[1:], len(r)) - 1
            sums = (np.add.reduceat(x, at) for x in (back, gone))
            yield pa.RecordBatch.from_arrays([file.take(pa.array(at)), *(pa.array(x) for x in (s[at], r[at], r[to], v[at], v[to], *sums))], names=["_file", "_start", "_row", "_to", "first", "last", "back", "nulls"])

    x = df.select(*ORDER, F.col(col).cast("long").alias("v"))
    return x.mapInArrow(summed, "_file string, _start long, _row long, _to long, first long, last long, back long, nulls long")


def run_counts(df: DataFrame, col: str, strict: bool = False) -> DataFrame:
    """One row over the runs: nulls, rows that go back, and runs that begin inside another (then the rows' places don't follow their reading, and ``back`` says nothing)."""
    w = Window.orderBy(*ORDER)
    prev = lambda c: F.lag(c).over(w)
    x = runs(df, col, strict).select(
        "nulls", "back", (F.col("first") <= prev("last") if strict else F.col("first") < prev("last")).alias("_cut"),
        ((prev("_file") == F.col("_file")) & (prev("_start") == F.col("_start")) & (F.col("_row") <= prev("_to"))).alias("_mixed"),
    )
    return x.agg(F.coalesce(F.sum("nulls"), F.lit(0)).alias("nulls"), (F.coalesce(F.sum("back"), F.lit(0)) + F.count_if("_cut")).alias("back"), F.count_if("_mixed").alias("mixed"))
