import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadgrain.llm.nearest import HIGH, XFastTrie, nearest_in_time


def test_trie_neighbours():
    rng = np.random.default_rng(0)
    for n, span in ((1, 8), (5, 16), (300, 1 << 14), (2000, 1 << 30)):
        keys = np.unique(rng.integers(0, span, n))
        q = np.unique(np.concatenate([rng.integers(0, span, 500), keys, keys + 1]))
        pred, succ = XFastTrie(keys, 31).neighbours(q)
        at = np.searchsorted(keys, q, side="right")
        assert (pred == at - 1).all() and (succ == np.where(at < len(keys), at, -1)).all()


def brute(points, records, tol):
    out = {}
    for pid, e, t in points:
        c = sorted((abs(t - rt), rt, rid) for rid, re, rt in records if re == e and e is not None and t is not None and rt is not None and abs(t - rt) <= tol)
        if c:
            out[pid] = c[0][2]
    return out


def frames(spark, points, records):
    ts = lambda df: df.withColumn("ts", F.timestamp_micros("us"))
    p = ts(spark.createDataFrame(points, "obd_id long, trip_id string, us long")).withColumn("high", F.lit("x"))
    return p, ts(spark.createDataFrame(records, "rec_id long, trip_id string, us long")).withColumn("obd_id", F.lit(-1))


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    edge = 5 << HIGH  # group borders are where rows could go astray
    records = [(i, rng.choice("ab"), edge + rng.randint(-2_000_000, 2_000_000)) for i in range(120)]
    points = [(i, rng.choice(["a", "b", "c", None]), edge + rng.randint(-2_000_000, 2_000_000)) for i in range(150)] + [(900, "a", None)]
    got = {r.point_id: r.match_id for r in nearest_in_time(*frames(spark, points, records), "obd_id", "rec_id", "trip_id", tolerance_us=30_000).collect()}
    assert got == brute(points, records, 30_000)


def test_ties_copies_and_empty(spark):
    records = [(1, "a", 1000), (2, "a", 3000), (2, "a", 3000), (9, "a", -5000), (7, "b", 3000), (8, "b", 3000)]
    points = [(1, "a", 2000), (1, "a", 2000), (2, "a", -4900), (3, "a", 900_000), (4, "b", 3000), (5, None, 3000)]
    p, r = frames(spark, points, records)
    run = lambda **k: sorted((x.point_id, x.match_id) for x in nearest_in_time(p, r, "obd_id", "rec_id", "trip_id", **k).collect())
    assert run() == [(1, 1), (2, 9), (4, 7)]
    assert run(tolerance_us=1000) == [(1, 1), (2, 9), (4, 7)] and run(tolerance_us=999) == [(2, 9), (4, 7)]
    kept = {x.point_id: x.match_id for x in nearest_in_time(p, r, "obd_id", "rec_id", "trip_id", keep_unmatched=True).collect()}
    assert kept == {1: 1, 2: 9, 3: None, 4: 7}
    assert nearest_in_time(p.limit(0), r, "obd_id", "rec_id", "trip_id").count() == 0
    assert nearest_in_time(p, r.limit(0), "obd_id", "rec_id", "trip_id").count() == 0


def test_hot_entity_in_many_batches(spark):
    n = 30_000
    r = spark.range(n).select(F.col("id").alias("rec_id"), F.lit("hot").alias("trip_id"), F.timestamp_micros(F.col("id") * 500_000).alias("ts"))
    p = spark.range(n).select(F.col("id").alias("obd_id"), F.lit("hot").alias("trip_id"), F.timestamp_micros(F.col("id") * 500_000 + 260_000).alias("ts"))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "777")
    try:
        got = nearest_in_time(p, r, "obd_id", "rec_id", "trip_id").agg(F.count("*").alias("n"), F.count_if(F.col("match_id") == F.least(F.col("point_id") + 1, F.lit(n - 1))).alias("k")).first()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert (got.n, got.k) == (n, n)
