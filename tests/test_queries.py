import pytest

from quillon import plans
from tests.oracle import DATA, connect, same

QUERIES, ORACLE = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, name):
    same(spark, con, QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() >= 0


def test_entry_has_all_units(spark):
    import __spark_entry__ as entry

    rows = {r.code: r for r in entry.entry(spark).collect()}
    assert sorted(rows) == list(range(12))
    assert all(r.dead == (r.hits == 0) for r in rows.values()) and rows[11].dead


def test_core_does_not_import_llm():
    import re
    from pathlib import Path

    package = Path(plans.__file__).parent.parent
    for source in package.rglob("*.py"):
        if "llm" not in source.relative_to(package).parts:
            assert not re.search(r"\bllm\b", source.read_text()), source
