"""Corpus queries that SQL can express give the same rows as DuckDB."""

import pytest

from driftlog.llm.oracle import ORACLE_SQL
from driftlog.llm.queries import QUERIES
from tests.oracle_check import connect, differences


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, con, sf_dir, name):
    difference, _, _ = differences(spark, con, QUERIES[name], ORACLE_SQL[name], sf_dir)
    assert not difference
