"""The registered queries run on the smallest tables and equal their SQL where they have one."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import SF, connect, same  # noqa: E402

from tarnstone.llm import queries as Q  # noqa: E402

QUERIES, SQL = Q.queries(), Q.oracle_sql()
COLUMNS = {
    "p1_found": [("lo_id", "bigint"), ("hi_id", "bigint")],
    "p2_found": [("memory_key", "string"), ("field", "string"), ("from_id", "bigint")],
    "p3_found": [("meeting_id", "bigint"), ("turn_no", "int"), ("person_id", "bigint")],
    "p4_found": [("memory_id", "bigint"), ("group_id", "bigint")],
    "p5_found": [("lo_id", "bigint"), ("hi_id", "bigint")],
    "p6_found": [("item_kind", "string"), ("item_id", "bigint"), ("cut_kind", "string")],
    "p7_found": [("coll", "string"), ("lo_id", "bigint"), ("hi_id", "bigint")],
    "p8_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
    "p9_found": [("doc_id", "bigint"), ("item_id", "bigint")],
    "p10_found": [("doc_id", "bigint")],
}


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in SQL:
        same(spark, QUERIES, SQL, name, con)
        return
    df = QUERIES[name](spark, SF)
    assert df.count() == df.distinct().count()
    if name in COLUMNS:
        assert df.dtypes == COLUMNS[name]
