import pytest

from quillon import llm
from tests.oracle import DATA, connect, same

QUERIES, ORACLE = llm.queries(), llm.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, name):
    same(spark, con, QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() >= 0


def test_columns_are_as_stated(spark):
    want = {
        "p1_found": [("tbl", "string"), ("a_id", "bigint"), ("b_id", "bigint")],
        "p2_found": [("run_id", "string"), ("measure", "string")],
        "p3_found": [("feature_id", "bigint"), ("image_id", "string"), ("token_idx", "int")],
        "p4_found": [("tbl", "string"), ("item_id", "bigint"), ("cluster_id", "bigint")],
        "p5_found": [("row_id", "bigint"), ("group_id", "bigint")],
        "p6_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
        "p7_found": [("item_id", "bigint"), ("doc_id", "bigint")],
        "p8_found": [("doc_id", "bigint"), ("pii_type", "string"), ("mention", "string")],
    }
    for name, columns in want.items():
        assert QUERIES[name](spark, DATA).dtypes == columns, name
