"""Queries of the problems tagged llm, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from roadgrain.llm.bpe import encode_corpus
from roadgrain.llm.leak import find_leaks
from roadgrain.llm.nearest import nearest_in_time
from roadgrain.llm.pieces import oversized, split_documents
from roadgrain.sources import table


def _nearest(s: SparkSession, d: str) -> DataFrame:
    return nearest_in_time(table(s, d, "obd_points"), table(s, d, "records"), "obd_id", "rec_id", "trip_id")


def p6_found(s: SparkSession, d: str) -> DataFrame:
    return _nearest(s, d).selectExpr("point_id as obd_id", "match_id as rec_id")


def p6_offsets(s: SparkSession, d: str) -> DataFrame:
    return _nearest(s, d).selectExpr("point_id as obd_id", "match_id as rec_id", "delta_us")


def p8_ids(s: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(s, d, "documents"))


def p9_found(s: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(s, d, "documents"), table(s, d, "eval_items")).where("carried >= 0.6").select("doc_id", "item_id").distinct()


def p9_coverage(s: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(s, d, "documents"), table(s, d, "eval_items"))


def p10_found(s: SparkSession, d: str) -> DataFrame:
    return oversized(table(s, d, "documents"))


def p10_pieces(s: SparkSession, d: str) -> DataFrame:
    return split_documents(table(s, d, "documents")).select("doc_id", "piece_no", "n_pieces", "first_token", "n_tokens", "overlap", "cut", "text", "cut_bytes")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p6_found, p6_offsets, p8_ids, p9_found, p9_coverage, p10_found, p10_pieces)}


_NEAR = """
WITH r AS (SELECT trip_id, epoch_us(ts) AS us, min(rec_id) AS rec_id FROM records WHERE trip_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2),
p AS (SELECT DISTINCT obd_id, trip_id, epoch_us(ts) AS us FROM obd_points WHERE trip_id IS NOT NULL AND ts IS NOT NULL),
c AS (SELECT p.obd_id, r.rec_id, r.us - p.us AS delta_us,
        row_number() OVER (PARTITION BY p.obd_id ORDER BY abs(r.us - p.us), r.us) AS k
      FROM p JOIN r ON p.trip_id = r.trip_id AND r.us BETWEEN p.us - 400000 AND p.us + 400000)
"""


def oracle_sql() -> dict[str, str]:
    return {"p6_found": _NEAR + "SELECT obd_id, rec_id FROM c WHERE k = 1", "p6_offsets": _NEAR + "SELECT obd_id, rec_id, delta_us FROM c WHERE k = 1"}
