"""Every registered query against its SQL on the smallest tables."""

from pathlib import Path

import pytest

from crosscheck.compare import oracle_connection, oracle_rows, spark_rows
from crosscheck.oracle import ORACLE
from crosscheck.queries import QUERIES

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(SF)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, connection, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    columns, rows = spark_rows(df)
    expected_columns, expected = oracle_rows(connection, ORACLE[name])
    assert columns == expected_columns
    assert rows == expected
    assert rows, "the query must return something to compare"
