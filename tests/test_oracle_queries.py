"""Every query with an SQL oracle matches DuckDB on the smallest driver tables."""

import pytest

from __spark_entry__ import oracle_sql, queries
from tests.conftest import SF_SMALL
from tests.oracle import compare, duck

ORACLE = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, con, name):
    problems, *_ = compare(spark, con, name, queries()[name], ORACLE[name], SF_SMALL)
    assert not problems, problems


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(queries())


def test_entry_runs(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert df.columns[:2] == ["c_mktsegment", "seg_code"]
    assert df.count() >= 0
