"""Run every query and its SQL side by side:  python -m checks.compare [folder] [name ...]"""

from __future__ import annotations

import sys
import tempfile
import time

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from checks.oracle import ORACLE
from checks.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# Column types the two engines must agree on.
SQL_TYPES = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
    "boolean": "BOOLEAN", "date": "DATE",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def local_session(cpus: str = "8") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("orebed")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="orebed-checks-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def _sorted_rows(table: pa.Table) -> list[tuple]:
    table = table.select(sorted(table.column_names))
    return sorted(zip(*(column.to_pylist() for column in table.columns)), key=repr)


def differences(actual: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs between a Spark result and a SQL result; row order does not count."""
    expected = connection.sql(sql)
    spark_types = {f.name: SQL_TYPES[f.dataType.simpleString()] for f in actual.schema.fields}
    sql_types = dict(zip(expected.columns, map(str, expected.types)))
    if spark_types != sql_types:
        odd = set(spark_types.items()) ^ set(sql_types.items())
        return [f"columns or types differ: {sorted(odd)}"]
    left, right = _sorted_rows(actual.toArrow()), _sorted_rows(expected.to_arrow_table())
    if len(left) != len(right):
        return [f"{len(left)} rows, expected {len(right)}"]
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    return [f"{len(bad)} rows differ, first: {bad[0]}"] if bad else []


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, connection = local_session(), connect(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    for name in names:
        start = time.time()
        try:
            problems = differences(QUERIES[name](spark, sf_dir), connection, ORACLE[name])
        except Exception as error:  # keep going: one report over all queries
            problems = [f"{type(error).__name__}: {str(error)[:300]}"]
        failed += bool(problems)
        print(f"{name:28} {time.time() - start:6.2f}s  {problems or 'ok'}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
