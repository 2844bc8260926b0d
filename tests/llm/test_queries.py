import pytest

from roadgrain.llm import queries as q
from tests.oracle import compare, connect


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query(spark, data, name):
    df = q.queries()[name](spark, data)
    if name in q.oracle_sql():
        compare(df, connect(data), q.oracle_sql()[name])
    else:
        assert df.count() > 0


def test_columns_of_the_found_queries(spark, data):
    want = {"p6_found": ["obd_id", "rec_id"], "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id"]}
    assert {k: q.queries()[k](spark, data).columns for k in want} == want
