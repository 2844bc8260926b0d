"""Nearest, backward and forward as-of joins without a cross product.

Both sides are stacked and ordered once by time; each left row sees the last right row before it and the first after it
through window functions, so the cost is one shuffle by the keys and one sort. Semantics: the whole right row is taken
(its nulls stay), of two equally near rows the earlier wins; of right rows at one instant the last is the backward and
the first the forward candidate; left rows are kept; a tolerance is inclusive; null times match nothing.

Skew: with ``bucket_us`` the partition is (keys, time bucket) and each bucket gets the nearest right rows of the buckets
around it as carries, so neither a hot key nor a join without keys lies in one task; results are the same. A join without
keys is always bucketed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Time (in the unit of the clock column) that a bucket of a join without keys spans.
BUCKET = 600_000_000


def asof_join(
    left: DataFrame, right: DataFrame, on: str = "ts", by: list[str] | None = None, tolerance_us: int | None = None, direction: str = "nearest",
    suffix: str = "_r", order: str | None = None, bucket_us: int | None = None,
) -> DataFrame:
    """Left columns, then the right columns (renamed with ``suffix`` where they clash) and ``delta_us``."""
    if direction not in ("nearest", "backward", "forward"):
        raise ValueError(f"no direction {direction!r}")
    by = by or []
    bucket_us = bucket_us or (None if by else BUCKET)
    us = F.unix_micros(on) if dict(left.dtypes)[on].startswith("timestamp") else F.col(on)
    rus = F.unix_micros(on) if dict(right.dtypes)[on].startswith("timestamp") else F.col(on)
    ord_ = F.col(order).cast("long") if order else F.lit(0).cast("long")
    r = right.where(F.col(on).isNotNull()).select(*by, rus.alias("_us"), F.lit(0).alias("_side"), ord_.alias("_ord"), F.struct(*[F.col(c) for c in right.columns]).alias("_r"))
    keep = F.struct(*[F.col(c) for c in left.columns])
    lf = left.select(*by, us.alias("_us"), F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_ord"), keep.alias("_l"))
    keys = list(by)
    both = r.withColumn("_l", F.lit(None).cast(lf.schema["_l"].dataType)).unionByName(lf.withColumn("_r", F.lit(None).cast(r.schema["_r"].dataType)))
    both = both.withColumn("_c", F.when(F.col("_side") == 0, F.struct("_us", F.col("_r").alias("row"))))
    if bucket_us:
        both = both.withColumn("_b", F.floor(F.col("_us") / bucket_us))
        edges = both.groupBy(*by, "_b").agg(
            F.max(F.when(F.col("_side") == 0, F.struct("_us", "_ord"))).alias("_hi"), F.min(F.when(F.col("_side") == 0, F.struct("_us", "_ord"))).alias("_lo"),
            F.max_by("_c", F.when(F.col("_side") == 0, F.struct("_us", "_ord"))).alias("_hc"), F.min_by("_c", F.when(F.col("_side") == 0, F.struct("_us", "_ord"))).alias("_lc"),
        )
        edges = _around(edges, by, "_hc", "_lc")
        cond = F.col("x._b").eqNullSafe(F.col("e._b"))
        for c in by:
            cond = cond & F.col(f"x.{c}").eqNullSafe(F.col(f"e.{c}"))
        both = both.alias("x").join(edges.alias("e"), cond, "left").select("x.*", "e._before", "e._after")
        keys = [*by, "_b"]
    part = Window.partitionBy(*keys)
    back = part.orderBy(F.asc("_us"), F.asc("_side"), F.asc("_ord")).rowsBetween(Window.unboundedPreceding, 0)
    # Seen from the end of time: rights at the left's instant come before it, the first duplicate last.
    fwd = part.orderBy(F.desc("_us"), F.asc("_side"), F.desc("_ord")).rowsBetween(Window.unboundedPreceding, 0)
    x = both.withColumn("_p", F.last("_c", ignorenulls=True).over(back)).withColumn("_n", F.last("_c", ignorenulls=True).over(fwd)).where("_side = 1")
    if bucket_us:
        x = x.withColumn("_p", F.coalesce("_p", "_before")).withColumn("_n", F.coalesce("_n", "_after"))
    d0, d1 = F.col("_us") - F.col("_p._us"), F.col("_n._us") - F.col("_us")
    near = F.when(F.col("_p").isNotNull() & (F.col("_n").isNull() | (d0 <= d1)), F.col("_p")).otherwise(F.col("_n"))
    hit = {"nearest": near, "backward": F.col("_p"), "forward": F.col("_n")}[direction]
    x = x.withColumn("_h", F.when(F.col("_us").isNotNull(), hit))
    delta = F.col("_h._us") - F.col("_us")
    if tolerance_us is not None:
        x = x.withColumn("_h", F.when(F.abs(delta) <= tolerance_us, F.col("_h")))
    taken = set(left.columns)
    out = [F.col(f"_l.{c}").alias(c) for c in left.columns]
    out += [F.col(f"_h.row.{c}").alias(c if c not in taken else c + suffix) for c in right.columns if c not in by]
    return x.select(*out, (F.col("_h._us") - F.col("_us")).alias("delta_us"))


def _around(edges: DataFrame, by: list[str], last: str, first: str) -> DataFrame:
    """(by, _b, _before, _after): the ``last`` of the nearest bucket before that has one, the ``first`` of the nearest after.

    Both frames begin where their order begins: one that reaches to its end is read anew for every row.
    """
    w = Window.partitionBy(*by) if by else Window
    earlier, later = (w.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("_b"), F.desc("_b")))
    return edges.select(*by, "_b", F.last(last, True).over(earlier).alias("_before"), F.last(first, True).over(later).alias("_after"))


def alignment_metrics(left: DataFrame, right: DataFrame, on: str = "ts", by: list[str] | None = None, tolerance_us: int = 5_000, bucket_us: int | None = None) -> DataFrame:
    """One row: pairs, max_abs_delta_us, within_ratio and exceeds (strictly over the tolerance) of the nearest join.

    Only times are needed, so a bucket gets the right times around it as rows of its own and nothing is joined.
    """
    by = by or []
    bucket_us = bucket_us or (None if by else BUCKET)

    def side(df: DataFrame, is_left: bool) -> DataFrame:
        us = F.unix_micros(on) if dict(df.dtypes)[on].startswith("timestamp") else F.col(on)
        return df.where(F.col(on).isNotNull()).select(*by, us.alias("_us"), F.lit(is_left).alias("_left"))

    both, keys = side(left, True).unionByName(side(right, False)), by
    rus = F.when(~F.col("_left"), F.col("_us"))
    if bucket_us:
        both, keys = both.withColumn("_b", F.floor(F.col("_us") / bucket_us)), [*by, "_b"]
        ends = _around(both.groupBy(*keys).agg(F.max(rus).alias("_hi"), F.min(rus).alias("_lo")), by, "_hi", "_lo")
        ends = ends.select(*keys, F.explode(F.array("_before", "_after")).alias("_us"))
        both = both.unionByName(ends.where("_us is not null").withColumn("_left", F.lit(False)))
    w = Window.partitionBy(*keys).orderBy("_us", "_left")
    x = both.withColumn("_r", rus).withColumn("_p", F.max("_r").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.expr("lead(_r) IGNORE NULLS").over(w)).where("_left")
    d = F.col("_d")
    return x.select(F.least(F.col("_us") - F.col("_p"), F.col("_n") - F.col("_us")).alias("_d")).where("_d is not null").agg(
        F.count("*").alias("pairs"), F.max(d).alias("max_abs_delta_us"), F.avg((d <= tolerance_us).cast("double")).alias("within_ratio"), F.count_if(d > tolerance_us).alias("exceeds")
    )


def interval_tag(df: DataFrame, periods: DataFrame, ts: str, value: str, default, by: list[str], start: str = "start_ts", end: str = "end_ts", order: str = "ord", out: str | None = None) -> DataFrame:
    """Adds the value of the first closed interval (by ``order``) of the row's keys that holds ts; an open end is null.

    Periods are folded to one array per key, so rows never multiply.
    """
    arr = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(start).alias("s"), F.col(end).alias("e"), F.col(value).alias("v"))))
    folded = periods.groupBy(*by).agg(arr.alias("_periods")).select(*[F.col(c).alias(f"_k_{c}") for c in by], "_periods")
    cond = reduce(lambda p, q: p & q, [F.col(c) == F.col(f"_k_{c}") for c in by])
    j = df.join(folded, cond, "left").drop(*[f"_k_{c}" for c in by])
    none = F.filter("_periods", lambda p: (p["s"].isNull() | (F.col(ts) >= p["s"])) & (p["e"].isNull() | (F.col(ts) <= p["e"])))
    return j.withColumn(out or value, F.coalesce(F.try_element_at(none, F.lit(1))["v"], F.lit(default))).drop("_periods")


def interval_case(ts: Column, periods: list[tuple], default) -> Column:
    """The same for a manifest's own list of (start, end, value): a CASE of a few branches, no join.

    Starts and ends are ISO text, instants or null; the end ``present`` is open.
    """
    out = F.when(F.lit(False), F.lit(default))
    for start, end, value in periods:
        lo = F.lit(True) if start is None else ts >= F.lit(start).cast("timestamp")
        hi = F.lit(True) if end in (None, "present") else ts <= F.lit(end).cast("timestamp")
        out = out.when(lo & hi, F.lit(value))
    return out.otherwise(F.lit(default))


def step_value(df: DataFrame, changes: DataFrame, on: str = "ts", by: list[str] | None = None) -> DataFrame:
    """Configuration in force at each row: the last change at or before it."""
    return asof_join(df, changes, on, by, direction="backward").drop("delta_us")


def positional_join(left: DataFrame, right: DataFrame, left_pos: str, right_pos: str, factor: int = 1, how: str = "left", by: list[str] | None = None) -> DataFrame:
    """Row ``k * factor`` of the left meets row k of the right, by explicit row numbers (inside ``by``)."""
    by = by or []
    r = right.withColumn("_at", F.col(right_pos) * factor).drop(*[c for c in right.columns if c in left.columns and c not in by]).withColumnsRenamed({c: f"_by_{c}" for c in by})
    cond = reduce(lambda a, b: a & b, [F.col(left_pos) == F.col("_at"), *[F.col(c) == F.col(f"_by_{c}") for c in by]])
    return left.join(r, cond, how).drop("_at", *[f"_by_{c}" for c in by])


def lookup(df: DataFrame, dim: DataFrame, key: str, value: str, default, valid: str | None = None) -> DataFrame:
    """Dimension value by key with a default; keys that fail the ``valid`` pattern get the default."""
    d = dim.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min(value).alias("_v"))
    j = df.join(d, F.col(key) == F.col("_k"), "left")
    v = F.coalesce("_v", F.lit(default))
    if valid:
        v = F.when(F.coalesce(F.col(key).rlike(valid), F.lit(False)), v).otherwise(F.lit(default))
    return j.withColumn(value, v).drop("_k", "_v")
