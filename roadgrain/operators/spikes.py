"""Problem 3: spikes, stuck values and impossible readings, per source.

Every series (one field of one trip) is decomposed by the undecimated Haar transform: detail j of a reading is half its
difference from the reading 2^(j-1) places before in the smooth of level j-1, so a reading is the sum of its details and
its last smooth. The coefficients decide which readings are looked at:

* spikes: each level's coefficients have their own robust scale per source. A level's threshold is its share, by scale,
  of ``k`` usual spreads. Coefficients that all stay within
  their thresholds add up to less than ``k`` spreads, so the readings with one beyond are a complete candidate set, and
  only for these is the exact distance taken;
* sticking: a run of zero details at the finest level is a run of equal values;
* bounds: a speed is impossible below zero, or beyond twice the source's reach.

Defined results: repeated rows count once, in the usual level, spread and reach as well; null and NaN values are skipped;
a reading without device takes its trip's device, and one without either belongs to the source null, which is judged as
one; readings without trip_id form one series per device; a source of zero spread flags every value off its level; ties
in ts are ordered by rec_id, readings without ts come first; empty tables give no rows.

Skew: series are cut into blocks of ``BLOCK_US``, so no task holds a whole hot trip; runs are joined again over the
blocks' ends only. Copies are thinned out before the shuffle. Sources meet in mergeable sketches and bounded histograms.
The records are read and shuffled once; statistics, block ends and the verdicts all start from that exchange.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadgrain.session import hashed, thinned

BLOCK_US = 600_000_000
LEVELS = 3
#: Speed bins: 16 to an octave, so that a gap of a factor of two always lies between bins.
OCTAVE = 16
#: Share of a source's readings that lie within its reach: impossible ones are fewer than the rest.
MOST = 0.75
CELL = "partition by series, block order by us, rec_id"


def readings(records: DataFrame, trips: DataFrame, fields: list[str]) -> DataFrame:
    """Rows (series, block, us, rec_id, source, fields), each once, partitioned by (series, block).

    ``series`` and ``source`` are the trip and the device with a letter before them, never null.
    """
    dev = trips.select(F.col("trip_id").alias("_t"), F.col("device_id").alias("_d")).where("_t is not null").groupBy("_t").agg(F.min("_d").alias("_d"))
    r = records.select("rec_id", "trip_id", "device_id", F.unix_micros("ts").alias("us"), *[F.col(f).cast("float").alias(f) for f in fields])
    r = r.join(dev, F.col("trip_id") == F.col("_t"), "left")
    source = F.coalesce(F.concat(F.lit("d"), F.coalesce("device_id", "_d")), F.lit("-"))
    series = F.coalesce(F.concat(F.lit("t"), F.col("trip_id")), source)
    block = F.coalesce(F.floor(F.col("us") / BLOCK_US), F.lit(-(1 << 40)).cast("long"))
    rows = r.select(series.alias("series"), block.alias("block"), "us", "rec_id", source.alias("source"), *[F.when(~F.isnan(f), F.col(f)).alias(f) for f in fields])
    # distinct() behind the exchange keeps all columns in it, so that every use of these rows shares one shuffle.
    return hashed(thinned(rows), "series", "block").distinct()


def _over(text: str) -> Column:
    return F.expr(f"{text} over ({CELL})")


def decomposed(rows: DataFrame, fields: list[str], levels: int = LEVELS) -> DataFrame:
    """Adds per field: ``_d1`` .. details, ``_c`` last smooth, ``_p`` place among the block's values, ``_i`` place in its run."""
    x = rows.withColumns({f"{f}_c0": F.col(f).cast("double") for f in fields})
    # Level by level; every level's windows have one partitioning and order, so the rows are sorted once.
    x = x.withColumns({f"{f}_b": _over(f"lag({f}_c0, 1) ignore nulls") for f in fields} | {f"{f}_p": _over(f"count({f}_c0)") for f in fields})
    for j in range(levels):
        step = {f"{f}_c{j + 1}": F.when(F.col(f"{f}_c{j}").isNotNull(), (F.col(f"{f}_c{j}") + F.coalesce(f"{f}_b", f"{f}_c{j}")) / 2) for f in fields}
        x = x.withColumns(step).withColumns({f"{f}_d{j + 1}": F.col(f"{f}_c{j}") - F.col(f"{f}_c{j + 1}") for f in fields})
        if j == 0:  # a value whose finest detail is not zero, or the block's first, opens a run
            x = x.withColumns({f"{f}_s": F.when(F.col(f"{f}_c0").isNotNull() & (F.col(f"{f}_b").isNull() | (F.col(f"{f}_d1") != 0)), F.col(f"{f}_p")) for f in fields})
        more = {f"{f}_b": _over(f"lag({f}_c{j + 1}, {2 ** (j + 1)}) ignore nulls") for f in fields} if j + 1 < levels else {}
        if j == 0:
            more |= {f"{f}_s": _over(f"max({f}_s)") for f in fields}
        x = x.withColumns(more) if more else x
    return x.withColumns({f"{f}_c": F.col(f"{f}_c{levels}") for f in fields} | {f"{f}_i": F.when(F.col(f"{f}_c0").isNotNull(), F.col(f"{f}_p") - F.col(f"{f}_s") + 1) for f in fields})


def usual(x: DataFrame, fields: list[str], k: float, levels: int = LEVELS) -> DataFrame:
    """(source, field_name, level, spread, limits): the usual level and spread, and the threshold of each coefficient.

    The scale of a level's details is the square of their mean root, which a few far ones hardly move; that of the last
    smooth is the spread of the values.
    """
    cols = ["value", *[f"d{j}" for j in range(1, levels + 1)]]
    at = lambda f: ", ".join([f"`{f}_c0`", *[f"`{f}_d{j}`" for j in range(1, levels + 1)]])
    long = x.select("source", F.expr(f"stack({len(fields)}, " + ", ".join(f"'{f}', {at(f)}" for f in fields) + f") as (field_name, {', '.join(cols)})"))
    q = F.percentile_approx("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 2000)
    g = long.groupBy("source", "field_name").agg(q.alias("q"), F.array(*[F.pow(F.avg(F.sqrt(F.abs(f"d{j}"))), F.lit(2)) for j in range(1, levels + 1)]).alias("own")).where("q is not null")
    g = g.select("source", "field_name", F.col("q")[1].alias("level"), ((F.col("q")[2] - F.col("q")[0]) / 1.349).alias("spread"), "own")
    g = g.withColumn("own", F.concat("own", F.array("spread"))).withColumn("total", F.aggregate("own", F.lit(0.0), lambda a, b: a + b))
    share = F.transform("own", lambda s: F.when(F.col("total") > 0, s / F.col("total")).otherwise(1.0 / (levels + 1)) * F.col("spread") * k)
    return g.select("source", "field_name", "level", "spread", share.alias("limits"))


def reach(rows: DataFrame, speed: str, factor: float, most: float = MOST) -> DataFrame:
    """(source, ceiling): the lowest speed that is more than ``factor`` times the one below it, above ``most`` of the readings.

    Works on a histogram of bounded size per source, whose exact least and greatest values decide the gap.
    """
    v = F.col(speed).cast("double")
    b = F.when(v > 0, F.floor(F.log2(v) * OCTAVE)).otherwise(F.lit(-1_000_000).cast("long"))
    # The sign is judged inside the aggregates: a filter would go below the exchange, which then could not be shared.
    ok = F.when(v >= 0, v)
    bins = rows.groupBy("source", b.alias("b")).agg(F.min(ok).alias("lo"), F.max(ok).alias("hi"), F.count(ok).alias("n")).where("n > 0")
    up, all_ = Window.partitionBy("source").orderBy("b"), Window.partitionBy("source")
    below = F.sum("n").over(up.rowsBetween(Window.unboundedPreceding, -1))
    g = bins.withColumn("prev", F.lag("hi").over(up)).withColumn("share", below / F.sum("n").over(all_))
    return g.where((F.col("prev") > 0) & (F.col("lo") > factor * F.col("prev")) & (F.col("share") >= most)).groupBy("source").agg(F.min("lo").alias("ceiling"))


def _block_notes(x: DataFrame, fields: list[str], run: int, per: DataFrame) -> DataFrame:
    """One row per (series, block) with what its readings need to know from elsewhere, so that they never move again.

    ``<field>_runs``: places of the block where runs of ``run`` values or more start, those over its borders included;
    ``known``: a map from the block's sources to their row of ``per``.
    """

    def ends(f: str) -> Column:
        at = F.when(F.col(f"{f}_i").isNotNull(), F.col(f"{f}_p"))
        first = F.max(F.when(F.col(f"{f}_i") == F.col(f"{f}_p"), F.col(f"{f}_i")))
        return F.struct(F.count(f"{f}_c0").alias("all"), first.alias("n0"), F.min_by(f"{f}_c0", at).alias("v0"), F.max_by(f"{f}_i", at).alias("n1"), F.max_by(f"{f}_c0", at).alias("v1"))

    def piece(f: str, at: Column, n: Column, v: Column, head: Column, tail: Column, source: Column = F.lit(None)) -> Column:
        return F.struct(F.lit(f).alias("f"), at.cast("long").alias("at"), n.cast("long").alias("n"), v.cast("double").alias("v"), head.alias("head"), tail.alias("tail"), source.cast("string").alias("s"))

    yes, no, none, todo = F.lit(True), F.lit(False), F.lit(None), []
    inner = lambda f: F.transform(f"{f}_in", lambda a: piece(f + "+", a, F.lit(run), none, no, no))
    for f in fields:
        some, one = F.col(f"{f}.all") > 0, F.col(f"{f}.n0") == F.col(f"{f}.all")
        first = piece(f, F.lit(1), F.col(f"{f}.n0"), F.col(f"{f}.v0"), yes, one)
        last = piece(f, F.col(f"{f}.all") - F.col(f"{f}.n1") + 1, F.col(f"{f}.n1"), F.col(f"{f}.v1"), no, yes)
        todo += [F.array_compact(F.array(F.when(some, first), F.when(some & ~one, last))), inner(f)]
    todo.append(F.transform("sources", lambda s: piece("", none, F.lit(run), none, no, no, s)))
    starts = [F.collect_set(F.when(F.col(f"{f}_i") == run, F.col(f"{f}_p") - run + 1)).alias(f"{f}_in") for f in fields]
    b = x.groupBy("series", "block").agg(*[ends(f).alias(f) for f in fields], *starts, F.collect_set("source").alias("sources"))
    e = b.select("series", "block", F.explode(F.concat(*todo)).alias("x")).select("series", "block", "x.*")
    # Runs over borders: the last of a block and the first of the next one with the same value are one.
    w = Window.partitionBy("series", "f").orderBy("block", "at")
    goes_on = F.col("head") & F.lag("tail").over(w) & (F.lag("v").over(w) == F.col("v"))
    e = e.withColumn("island", F.sum(F.when(goes_on, 0).otherwise(1)).over(w))
    e = e.withColumn("total", F.sum("n").over(Window.partitionBy("series", "f", "island"))).where(F.col("total") >= run)
    e = e.join(per.withColumnRenamed("source", "_s"), F.col("s") == F.col("_s"), "left")
    k = F.when(F.col("_s").isNotNull(), F.struct("_s", F.struct(*[c for c in per.columns if c != "source"])))
    return e.groupBy("series", "block").agg(*[F.collect_set(F.when(F.col("f").isin(f, f + "+"), F.col("at"))).alias(f"{f}_runs") for f in fields], F.map_from_entries(F.collect_list(k)).alias("known"))


def faults(
    records: DataFrame, trips: DataFrame, fields: tuple[str, ...] = ("ax_mps2", "gx_rad_s", "speed_mps"), speed: str = "speed_mps", k: float = 10.0, run: int = 8, factor: float = 2.0, most: float = MOST
) -> DataFrame:
    """(rec_id, field_name, value, fault): fault is an array of spike, stuck and impossible."""
    x = _judged(records, trips, list(fields), speed, k, run, factor, most)
    return x.select("rec_id", "field_name", "value", "fault").where(F.size("fault") > 0)


def candidates(records: DataFrame, trips: DataFrame, fields: tuple[str, ...] = ("ax_mps2", "gx_rad_s"), k: float = 10.0) -> DataFrame:
    """(field_name, n_readings, n_candidates, n_spikes): what the wavelet's thresholds leave for the exact distance."""
    x = _judged(records, trips, list(fields), "", k, 8, 2.0, MOST)
    return x.groupBy("field_name").agg(F.count("*").alias("n_readings"), F.count_if("candidate").alias("n_candidates"), F.count_if(F.array_contains("fault", "spike")).alias("n_spikes"))


def _judged(records: DataFrame, trips: DataFrame, fields: list[str], speed: str, k: float, run: int, factor: float, most: float) -> DataFrame:
    sensors = [f for f in fields if f != speed]
    rows = readings(records, trips, fields)
    x = decomposed(rows, fields)
    per = usual(x, sensors, k).select("source", *[F.when(F.col("field_name") == f, F.struct("level", "spread", "limits")).alias(f) for f in sensors])
    if speed in fields:
        per = per.unionByName(reach(rows, speed, factor, most), allowMissingColumns=True)
    per = per.groupBy("source").agg(*[F.first(c, ignorenulls=True).alias(c) for c in per.columns if c != "source"])
    notes = _block_notes(x, fields, run, per).withColumnsRenamed({"series": "_s2", "block": "_b2"})
    x = x.join(notes, (F.col("series") == F.col("_s2")) & (F.col("block") == F.col("_b2")), "left").withColumn("u", F.try_element_at("known", F.col("source")))
    told, no = [], F.lit(False)
    for f in fields:
        v, i = F.col(f"{f}_c0"), F.col(f"{f}_i")
        in_run = F.array_contains(f"{f}_runs", F.col(f"{f}_p") - i + 1)
        kinds, looked = [F.when((v != 0) & F.coalesce(in_run, no), F.lit("stuck"))], no
        if f == speed:
            kinds.append(F.when((v < 0) | (v >= F.col("u.ceiling")), F.lit("impossible")))
        else:
            u = F.col("u")[f]
            terms = [*[F.abs(f"{f}_d{j}") for j in range(1, LEVELS + 1)], F.abs(F.col(f"{f}_c") - u["level"])]
            looked = F.coalesce(reduce(lambda a, b: a | b, [t > u["limits"][n] for n, t in enumerate(terms)]), no)
            kinds.insert(0, F.when(looked & (F.abs(v - u["level"]) > k * u["spread"]), F.lit("spike")))
        told.append(F.struct(F.lit(f).alias("field_name"), v.alias("value"), looked.alias("candidate"), F.array_compact(F.array(*kinds)).alias("fault")))
    return x.select("rec_id", F.explode(F.filter(F.array(*told), lambda t: t["value"].isNotNull())).alias("t")).select("rec_id", "t.*")
