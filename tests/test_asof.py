import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from roadgrain.operators.asof import alignment_metrics, asof_join, interval_case, interval_tag, lookup


def pandas_asof(left, right, tol, direction):
    parts = []
    for k, g in left.groupby("k"):
        r = right[right.k == k].sort_values("ts", kind="stable")
        parts.append(pd.merge_asof(g.sort_values("ts", kind="stable"), r.drop(columns="k"), on="ts", direction=direction, tolerance=tol))
    return {(int(x.lid)): (None if pd.isna(x.rid) else int(x.rid)) for p in parts for x in p.itertuples()}


@pytest.mark.parametrize("seed,tol,direction,bucket", [(1, None, "nearest", None), (2, 3, "nearest", None), (3, None, "nearest", 10), (4, 2, "nearest", 7), (5, None, "backward", 10), (6, None, "forward", 9), (7, 4, "backward", None)])
def test_equals_pandas(spark, seed, tol, direction, bucket):
    rng = random.Random(seed)
    left = pd.DataFrame([(i, rng.choice("ab"), rng.randint(0, 100)) for i in range(80)], columns=["lid", "k", "ts"])
    right = pd.DataFrame([(i, rng.choice("abc"), t) for i, t in enumerate(rng.sample(range(100), 40))], columns=["rid", "k", "ts"])
    got = asof_join(spark.createDataFrame(left), spark.createDataFrame(right), "ts", ["k"], tol, direction, bucket_us=bucket)
    assert {r.lid: r.rid for r in got.collect()} == pandas_asof(left, right, tol, direction)


def test_duplicates_ties_nulls(spark):
    left = spark.createDataFrame([(1, 10), (2, 15), (3, None)], "lid int, ts long")
    right = spark.createDataFrame([(1, 10, "a"), (2, 10, "b"), (3, 20, None), (4, 20, "d")], "o int, ts long, v string")
    got = {r.lid: (r.o, r.v) for r in asof_join(left, right, "ts", order="o").collect()}
    assert got == {1: (2, "b"), 2: (2, "b"), 3: (None, None)}
    fwd = {r.lid: (r.o, r.v) for r in asof_join(left, right, "ts", order="o", direction="forward").collect()}
    assert fwd == {1: (1, "a"), 2: (3, None), 3: (None, None)}
    none = asof_join(left, right.limit(0), "ts").collect()
    assert len(none) == 3 and all(r.o is None for r in none)


def test_partitioning_changes_nothing(spark):
    left = spark.range(200).select(F.col("id").alias("lid"), (F.col("id") * 37 % 101).alias("ts"))
    right = spark.range(50).select(F.col("id").alias("rid"), (F.col("id") * 13 % 97).alias("ts"))
    one = sorted(asof_join(left, right, "ts").collect())
    assert sorted(asof_join(left.repartition(7), right.repartition(3), "ts").collect()) == one
    assert sorted(asof_join(left, right, "ts", bucket_us=11).collect()) == one


def test_alignment(spark):
    left = spark.createDataFrame([(0,), (10,), (100,)], "ts long")
    m = alignment_metrics(left, spark.createDataFrame([(1,), (12,)], "ts long"), tolerance_us=5).first()
    assert (m.pairs, m.max_abs_delta_us, m.exceeds) == (3, 88, 1) and abs(m.within_ratio - 2 / 3) < 1e-9
    assert alignment_metrics(left, spark.createDataFrame([], "ts long")).first().pairs == 0


@pytest.mark.parametrize("by,bucket", [([], 7), ([], 1), ([], None), (["k"], None), (["k"], 7)])
def test_alignment_equals_nearest_join(spark, by, bucket):
    rng = random.Random(5)
    side = lambda n, span: spark.createDataFrame([(rng.choice(["a", "b", None]), rng.choice([None, *range(-span, span)])) for _ in range(n)], "k string, ts long")
    left, right = side(90, 200), side(25, 150)
    d = [abs(r.delta_us) for r in asof_join(left.select(*by, "ts"), right.select(*by, "ts"), "ts", by).collect() if r.delta_us is not None]
    m = alignment_metrics(left, right, "ts", by, 5, bucket).first()
    assert (m.pairs, m.max_abs_delta_us, m.exceeds) == (len(d), max(d), sum(x > 5 for x in d)) and abs(m.within_ratio - sum(x <= 5 for x in d) / len(d)) < 1e-9


def test_many_buckets_take_linear_time(spark):
    # A window that reaches to the end of its order is read anew for every bucket.
    left, right = (spark.range(20).select((F.col("id") * 10 + k).alias("ts")) for k in (0, 1))
    for x in (asof_join(left, right, "ts", bucket_us=10), alignment_metrics(left, right, bucket_us=10)):
        assert "unboundedfollowing" not in x._jdf.queryExecution().toString().lower()


def test_intervals(spark):
    df = spark.createDataFrame([("a", t) for t in (0, 5, 10, 15, 30)] + [("z", 5)], "k string, t int")
    p = spark.createDataFrame([("a", 5, 10, "x", 1), ("a", 8, 20, "y", 2), ("a", 25, None, "z", 3)], "k string, s int, e int, frame string, ord int")
    got = [r.frame for r in interval_tag(df, p, "t", "frame", "raw", ["k"], "s", "e").orderBy("k", "t").collect()]
    assert got == ["raw", "x", "x", "y", "z", "raw"]
    c = interval_case(F.col("ts"), [("2025-01-01T00:00:00Z", "2025-01-02T00:00:00Z", "partial"), ("2025-01-01T12:00:00Z", "present", "raw2")], "raw")
    t = spark.createDataFrame([("2024-01-01",), ("2025-01-02",), ("2026-01-01",)], "s string").select(F.col("s").cast("timestamp").alias("ts")).select(c.alias("f"))
    assert [r.f for r in t.collect()] == ["raw", "partial", "raw2"]


def test_lookup(spark):
    df = spark.createDataFrame([("1",), ("2",), ("x",), (None,)], "k string")
    dim = spark.createDataFrame([("1", "d1"), ("x", "dx")], "k string, dev string")
    assert {r.k: r.dev for r in lookup(df, dim, "k", "dev", "unknown", r"^\d+$").collect()} == {"1": "d1", "2": "unknown", "x": "unknown", None: "unknown"}
