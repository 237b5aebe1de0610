"""Every registered query of the library against its SQL on the same tables."""

import pytest

import __spark_entry__ as driver
from checks.compare import connect, differences
from checks.oracle import ORACLE
from checks.queries import QUERIES


@pytest.fixture(scope="module")
def connection():
    return connect("/root/testdata/sf0.001")


def test_every_query_has_its_sql():
    assert QUERIES.keys() == ORACLE.keys()
    assert QUERIES.items() <= driver.queries().items()
    assert ORACLE.items() <= driver.oracle_sql().items()


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_as_sql(spark, connection, small, name):
    assert differences(QUERIES[name](spark, small), connection, ORACLE[name]) == []


def test_entry(spark, connection):
    report = driver.entry(spark)
    rows = report.collect()
    assert rows == sorted(rows, key=lambda r: (r.group_name, r.position))
    assert differences(report, connection, ORACLE["group_report"]) == []
