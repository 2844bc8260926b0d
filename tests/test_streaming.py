from pyspark.sql import functions as F

from roadgrain.streaming import live


def test_streams(spark, tmp_path):
    src = spark.range(600).select((F.col("id") % 590).alias("rec_id"), F.timestamp_micros((F.col("id") % 590 + 1_600_000_020) * 1_000_000).alias("ts"), F.lit("t").alias("trip_id"), F.lit("d").alias("device_id"), F.lit(2.0).alias("speed_mps"))
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: live.record_stream(spark, tmp_path / "in", src.schema)
    stream = live.first_sendings(read())
    assert stream.isStreaming
    q = live.write_batches(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 590
    for n, f in enumerate((live.minute_rollup, live.sliding_rollup, live.trip_sessions)):
        q = f(read()).writeStream.outputMode("complete" if n < 2 else "append").format("memory").queryName(f"s{n}").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"c{n}")).start()
        q.awaitTermination(120)
    got = spark.sql("select n_rows from s0 order by minute").collect()
    assert len(got) == 10 and got[0].n_rows == 70
