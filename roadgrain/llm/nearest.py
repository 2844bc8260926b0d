"""Problem 6: records of two tables paired by nearest time for the same entity.

An x-fast trie per entity: for each length of a timestamp's bit prefix a hash table from prefix to the first and last
leaf below it. A query finds its longest stored prefix by binary search over the lengths (one hash probe each), and
from that node its predecessor and successor; the nearer one within the tolerance wins, of two equally near the
earlier. Tables are built over batches of whole (entity, high prefix) groups, so all probes are vectorised.

Defined results: points or records without entity or ts match nothing; repeated rows count once; of several records at
one instant the smallest id is taken; no candidate gives no row (or a null with ``keep_unmatched``); extra and
clashing column names are ignored, only the named columns are read; empty tables give no rows.

Skew: the key is (entity, the timestamp's prefix of ``HIGH`` bits up), so a hot entity is spread over its time; records
near a border are sent to both sides, so each point meets all its candidates in one group. Repeated rows are thinned out
before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadgrain.session import hashed, thinned

#: Low bits that one trie spans: 2^28 us are 268 seconds of one entity.
HIGH = 28


class XFastTrie:
    """Over sorted distinct non-negative keys; every method is vectorised over queries."""

    def __init__(self, keys: np.ndarray, bits: int):
        self.keys, self.bits = keys, bits
        self.tables: list[pd.Index] = []  # by shift: the hash table of the prefixes at that level
        self.first: list[np.ndarray] = []
        self.last: list[np.ndarray] = []
        for shift in range(bits + 1):
            p = keys >> shift
            at = np.flatnonzero(np.append(True, p[1:] != p[:-1])) if len(p) else np.zeros(0, int)
            self.tables.append(pd.Index(p[at]))
            self.first.append(at)
            self.last.append(np.append(at[1:], len(p)) - 1)

    def neighbours(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the predecessor (<= q) and the successor (> q) of each query, -1 where there is none."""
        n = len(q)
        lo, hi = np.zeros(n, int), np.full(n, self.bits)  # the least shift at which the prefix is stored lies in [lo, hi]
        node = np.full(n, -1)
        root = self.tables[self.bits].get_indexer(q >> self.bits)
        node[:] = root
        lo[root < 0] = hi[root < 0]
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) // 2
            for shift in np.unique(mid):
                i = open_[mid == shift]
                hit = self.tables[shift].get_indexer(q[i] >> shift)
                found = hit >= 0
                hi[i[found]], node[i[found]] = shift, hit[found]
                lo[i[~found]] = shift + 1
        pred, succ = np.full(n, -1), np.full(n, -1)
        size = len(self.keys)
        for shift in np.unique(hi):
            i = np.flatnonzero((hi == shift) & (node >= 0))
            a, z = self.first[shift][node[i]], self.last[shift][node[i]]
            if shift == 0:
                pred[i], succ[i] = a, a + 1
            else:
                # Below the longest stored prefix the query's next bit is absent: all leaves lie on one side.
                right = ((q[i] >> (shift - 1)) & 1) == 1
                pred[i] = np.where(right, z, a - 1)
                succ[i] = np.where(right, z + 1, a)
        succ[succ >= size] = -1
        return pred, succ


def _match(tolerance: int, keep_unmatched: bool):
    def solve(b: pd.DataFrame) -> pd.DataFrame:
        # Dense numbers for the groups go above the low bits, so one trie holds each group's own subtree.
        high = b["high"].to_numpy()
        code = pd.factorize((pd.factorize(b["entity"])[0].astype("int64") << 36) + (high - high.min()))[0].astype("int64")
        base = high << HIGH
        # A copy from a neighbouring group lies outside the span by at most the tolerance.
        key = (code << (HIGH + 2)) + (b["us"].to_numpy() - base) + (1 << HIGH)
        side = b["side"].to_numpy()
        ids, us = b["id"].to_numpy(), b["us"].to_numpy()
        r, p = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        r = r[np.lexsort((ids[r], key[r]))]
        r = r[np.append(True, key[r][1:] != key[r][:-1])] if len(r) else r
        p = p[np.lexsort((key[p], ids[p]))]
        p = p[np.append(True, (ids[p][1:] != ids[p][:-1]) | (key[p][1:] != key[p][:-1]))] if len(p) else p
        pick = np.full(len(p), -1)
        if len(r) and len(p):
            pred, succ = XFastTrie(key[r], HIGH + 2).neighbours(key[p])
            far = np.iinfo("int64").max
            same = lambda j: (j >= 0) & (code[r][np.maximum(j, 0)] == code[p])
            d0 = np.where(same(pred), us[p] - us[r][np.maximum(pred, 0)], far)
            d1 = np.where(same(succ), us[r][np.maximum(succ, 0)] - us[p], far)
            pick = np.where((d0 <= d1) & (d0 <= tolerance), pred, np.where(d1 <= tolerance, succ, -1))
        got = pick >= 0
        out = pd.DataFrame({"point_id": ids[p], "match_id": pd.array(np.where(got, ids[r][np.maximum(pick, 0)] if len(r) else 0, 0), dtype="Int64"), "delta_us": pd.array(np.where(got, us[r][np.maximum(pick, 0)] - us[p] if len(r) else 0, 0), dtype="Int64")})
        out.loc[~got, ["match_id", "delta_us"]] = pd.NA
        return out if keep_unmatched else out[got]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            if not len(b):
                continue
            # Rows come sorted by group: all but the last group of what has come are complete.
            last = (b["entity"].to_numpy() == b["entity"].iloc[-1]) & (b["high"].to_numpy() == b["high"].iloc[-1])
            cut = len(b) - int(np.argmin(last[::-1])) if not last.all() else 0
            if cut == 0 and held and (held[-1]["entity"].iloc[-1], held[-1]["high"].iloc[-1]) != (b["entity"].iloc[0], b["high"].iloc[0]):
                yield solve(pd.concat(held))
                held = []
            if cut:
                yield solve(pd.concat([*held, b.iloc[:cut]]))
                held = []
            held.append(b.iloc[cut:])
        if held:
            yield solve(pd.concat(held))

    return run


def nearest_in_time(
    points: DataFrame, records: DataFrame, point_id: str, record_id: str, entity: str, ts: str = "ts", tolerance_us: int = 400_000, keep_unmatched: bool = False
) -> DataFrame:
    """(point_id, match_id, delta_us): each point and the nearest record of its entity within the tolerance."""
    if not 0 <= tolerance_us < 1 << HIGH:
        raise ValueError(f"the tolerance must be under {1 << HIGH} us")
    us = F.unix_micros(ts)
    high = lambda c: F.shiftright(c, HIGH)
    cols = lambda df, id_, side: df.where(F.col(entity).isNotNull() & F.col(ts).isNotNull() & F.col(id_).isNotNull()).select(F.col(entity).alias("entity"), us.alias("us"), F.col(id_).cast("long").alias("id"), F.lit(side).cast("byte").alias("side"))
    # A record within the tolerance of a border also stands in the group beyond it.
    spread = F.array_distinct(F.array(high(F.col("us")), high(F.col("us") - tolerance_us), high(F.col("us") + tolerance_us)))
    r = cols(records, record_id, 0).withColumn("high", F.explode(spread))
    p = cols(points, point_id, 1).withColumn("high", high(F.col("us")))
    both = hashed(thinned(r.unionByName(p)), "entity", "high").sortWithinPartitions("entity", "high")
    return both.mapInPandas(_match(tolerance_us, keep_unmatched), "point_id long, match_id long, delta_us long")
