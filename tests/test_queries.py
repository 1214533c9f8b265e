"""Every query with SQL gives the same rows as DuckDB."""

import pytest

from driftlog.oracle import ORACLE_SQL
from driftlog.queries import QUERIES
from tests.oracle_check import connect, differences


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, con, sf_dir, name):
    difference, _, _ = differences(spark, con, QUERIES[name], ORACLE_SQL[name], sf_dir)
    assert not difference


def test_every_oracle_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_the_key_filter_reaches_the_scan(spark, tmp_path):
    from driftlog.operators import lww

    spark.range(1000).selectExpr("id AS seq", "concat('k', id % 10) AS key", "'put' AS op", "'v' AS value").write.parquet(str(tmp_path / "w"))
    df = lww.point_get(spark.read.parquet(str(tmp_path / "w")), "k3")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key,k3)" in plan
    assert df.collect()[0]["found"]
