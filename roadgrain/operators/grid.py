"""Problem 4: irregular readings onto a regular grid.

Local linear regression with a compact (Epanechnikov) kernel, evaluated at the middle of every slot from the slot
itself and its two neighbours. The kernel is a polynomial whose support is exactly these three slots, so a slot's power
sums are all that is needed: readings shrink to moments before they meet, each slot's moments are sent to the three
grid times they bear on, and no task ever holds a trip.

Defined results: a reading counts if lat and lon are numbers within +-90 and +-180 and not both 0; repeated rec_ids
count once; readings without trip_id or ts have no series; several readings at one instant are averaged by the fit; a
trip with one reading has one slot; a trip may cross the date line; a slot whose kernel sees fewer than ``least`` effective readings has no estimate and
is marked missing; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadgrain.session import hashed, thinned

SLOT_S = 5
#: Slots to a piece of a trip's grid, so that a long trip is spread over tasks.
PIECE = 4096


def located(df: DataFrame) -> DataFrame:
    ok = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & ~((F.col("lat") == 0) & (F.col("lon") == 0))
    return df.where(ok & ~F.isnan("lat") & ~F.isnan("lon"))


def slot_rows(records: DataFrame, slot_s: int = SLOT_S) -> DataFrame:
    """Located readings (trip_id, slot, rec_id, us, lat, lon), repeated ones once, partitioned by (trip_id, slot)."""
    us = F.unix_micros("ts")
    r = located(records.select("rec_id", "trip_id", "ts", "lat", "lon").where("trip_id is not null and ts is not null"))
    r = r.select("trip_id", F.floor(us / (slot_s * 1_000_000)).alias("slot"), "rec_id", us.alias("us"), "lat", "lon")
    # distinct() behind the exchange keeps all columns in it: the grid's ends and the moments share one scan and shuffle.
    return hashed(thinned(r), "trip_id", "slot").distinct()


def slot_moments(rows: DataFrame, slot_s: int = SLOT_S) -> DataFrame:
    """Per (trip_id, slot): power sums of time (from the slot's middle, in slots), with position, and of western readings."""
    r = rows.withColumn("t", F.col("us") / F.lit(slot_s * 1e6) - F.col("slot") - 0.5).withColumn("west", (F.col("lon") < 0).cast("double"))
    s = [F.sum(F.pow("t", F.lit(p))).alias(f"s{p}") for p in range(1, 5)]
    y = [F.sum(F.pow("t", F.lit(p)) * F.col(c)).alias(f"{c}{p}") for c in ("lat", "lon", "west") for p in range(4)]
    return r.groupBy("trip_id", "slot").agg(F.count("*").cast("double").alias("s0"), *s, *y, F.max(F.abs("lon")).alias("far"))


def regular_grid(records: DataFrame, slot_s: int = SLOT_S, least: float = 0.5) -> DataFrame:
    """(trip_id, slot_start_s, n_readings, support, lat, lon, state), every slot from a trip's first to its last."""
    rows = slot_rows(records, slot_s)
    m = slot_moments(rows, slot_s)
    # The count keeps the distinct rows below least and greatest, which the optimiser would drop, and so the shared exchange.
    ends = rows.groupBy("trip_id").agg(F.min("slot").alias("a"), F.max("slot").alias("z"), F.count("*").alias("n")).where("n > 0")
    pieces = ends.select("trip_id", "a", "z", F.explode(F.sequence(F.floor(F.col("a") / PIECE), F.floor(F.col("z") / PIECE))).alias("p"))
    grid = pieces.select("trip_id", F.explode(F.sequence(F.greatest("a", F.col("p") * PIECE), F.least("z", F.col("p") * PIECE + PIECE - 1))).alias("slot"))
    # Moments about the middle of the slot d away: t' = t - d. Kernel 1 - (t'/h)^2 with h = 1.5 slots.
    h2 = 1.5**2
    choose = {1: (1, 1), 2: (1, 2, 1), 3: (1, 3, 3, 1), 4: (1, 4, 6, 4, 1), 0: (1,)}
    sends = []
    for d in (-1, 0, 1):
        shifted = lambda base, p, d=d: sum((choose[p][i] * float((-d) ** (p - i)) * F.col(f"{base}{i}") for i in range(p + 1)), F.lit(0.0))
        kernel = lambda base, p, f=shifted: f(base, p) - f(base, p + 2) / h2
        w = [kernel("s", p).alias(f"w{p}") for p in range(3)]
        z = [kernel(c, p).alias(f"{c}{p}") for c in ("lat", "lon", "west") for p in range(2)]
        sends.append(F.struct((F.col("slot") + d).alias("slot"), F.when(F.lit(d == 0), F.col("s0")).otherwise(0.0).alias("own"), *w, *z, "far"))
    near = m.select("trip_id", F.explode(F.array(*sends)).alias("x")).select("trip_id", "x.*")
    names = ["own", "w0", "w1", "w2", "lat0", "lat1", "lon0", "lon1", "west0", "west1"]
    near = grid.select("trip_id", "slot", *[F.lit(0.0).alias(c) for c in [*names, "far"]], F.lit(1).alias("_g")).unionByName(near.withColumn("_g", F.lit(0)))
    g = near.groupBy("trip_id", "slot").agg(*[F.sum(c).alias(c) for c in names], F.max("far").alias("far"), F.max("_g").alias("_g")).where("_g = 1")
    # Far from Greenwich longitudes are fitted on 0 to 360, so that they run on over the date line, and turned back.
    g = g.withColumns({f"east{p}": F.col(f"lon{p}") + 360 * F.col(f"west{p}") for p in range(2)})
    det = F.col("w0") * F.col("w2") - F.col("w1") * F.col("w1")
    fit = lambda c: F.when(det > 1e-6 * F.col("w0"), (F.col("w2") * F.col(f"{c}0") - F.col("w1") * F.col(f"{c}1")) / det).otherwise(F.try_divide(F.col(f"{c}0"), F.col("w0")))
    enough = F.col("w0") >= least
    state = F.when(F.col("own") > 0, F.lit("observed")).when(enough, F.lit("filled")).otherwise(F.lit("missing"))
    return g.select(
        "trip_id", (F.col("slot") * slot_s).cast("long").alias("slot_start_s"), F.col("own").cast("long").alias("n_readings"), F.col("w0").alias("support"),
        F.when(enough | (F.col("own") > 0), fit("lat")).alias("lat"), F.when(enough | (F.col("own") > 0), F.when(F.col("far") > 90, F.pmod(fit("east") + 180, F.lit(360.0)) - 180).otherwise(fit("lon"))).alias("lon"), state.alias("state"),
    )
