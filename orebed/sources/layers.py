"""Layer files and the published tables over them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PRESENT = "ok"
MISSING = "missing"
EXTRA = "extra"
WRONG_TYPE = "wrong type"
WRONG_ORDER = "wrong order"

# Of tables published together, see ``snapshot.py``.
POINTER = "published"
RUN = "run"
STORAGE, RUNS = "orebed.storage", "orebed.runs"


class ContractError(ValueError):
    """Files do not fit the contract of the table they are published as."""


def write_layer(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write a layer folder. Each run writes a folder of its own, so a reader of the
    former state is never disturbed and nothing is overwritten while it is read."""
    writer = df.write.mode("overwrite").option("compression", "snappy")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def read_layer(spark: SparkSession, path: str, contract: StructType) -> DataFrame:
    return spark.read.schema(contract).parquet(path)


def cluster(df: DataFrame, by: Sequence[str], sort: Sequence[str] = ()) -> DataFrame:
    """Bring rows of a key together and sort each file, for writing.

    A rebalance rather than a range sort of the whole table: it needs no sampling job, and
    adaptive execution splits the partition of a large key instead of leaving it whole.
    """
    clustered = df.hint("rebalance", *[F.col(c) for c in by])
    return clustered.sortWithinPartitions(*sort) if sort else clustered


def in_order(df: DataFrame, sort: Sequence[str]) -> DataFrame:
    """Sort a table for writing: every file holds a range of the sort order, so that readers
    can skip files by their bounds. The last columns should tell rows of a large group apart."""
    return df.repartitionByRange(*[F.col(c) for c in sort]).sortWithinPartitions(*sort)


def overwrite_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replace only the partitions ``df`` has rows for; all others stay."""
    (
        cluster(df, partition_by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "snappy")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def contract_differences(
    actual: StructType, declared: StructType
) -> list[tuple[int, str, str | None, str | None, str]]:
    """(position, column, declared type, actual type, status) for every column of either.

    Order is judged among the columns both sides have, so that one missing column is one
    difference.
    """
    have = {f.name: f.dataType.simpleString() for f in actual.fields}
    want = {f.name: f.dataType.simpleString() for f in declared.fields}
    shared_want = [c for c in want if c in have]
    shared_have = [c for c in have if c in want]
    in_place = dict(zip(shared_want, shared_have))
    rows = []
    for position, (column, kind) in enumerate(want.items(), start=1):
        if column not in have:
            status = MISSING
        elif have[column] != kind:
            status = WRONG_TYPE
        elif in_place[column] != column:
            status = WRONG_ORDER
        else:
            status = PRESENT
        rows.append((position, column, kind, have.get(column), status))
    extra = [c for c in have if c not in want]
    for position, column in enumerate(extra, start=len(want) + 1):
        rows.append((position, column, None, have[column], EXTRA))
    return rows


def stored_schema(spark: SparkSession, path: str) -> StructType:
    """The schema of all files of a folder together."""
    try:
        return spark.read.option("mergeSchema", True).parquet(path).schema
    except (PySparkException, Py4JJavaError) as error:
        if "CANNOT_MERGE_SCHEMA" not in str(error):
            raise
        raise ContractError(f"{path} has files of different types: {error}") from error


def check_contract(
    spark: SparkSession, path: str, declared: StructType, partition_by: Sequence[str] = ()
) -> None:
    """Compare the files' own schema with the contract; fail once, with all differences.
    Columns of ``partition_by`` are in folder names, not in files.

    A declared schema hides such differences from a reader (a missing column reads as NULL)
    or shows them only while the query runs, hence the check before publishing. The footers
    of all files are read, by a distributed job; files that disagree on a type are an error.
    """
    stored = stored_schema(spark, path)
    inside, wanted = (
        StructType([f for f in schema.fields if f.name not in partition_by])
        for schema in (stored, declared)
    )
    rows = contract_differences(inside, wanted)
    bad = [f"{column}: {status}" for _, column, _, _, status in rows if status != PRESENT]
    if bad:
        raise ContractError(f"{path} does not fit its contract: {', '.join(bad)}")


def publish(
    spark: SparkSession,
    table: str,
    path: str,
    contract: StructType,
    partition_by: Sequence[str] = (),
) -> None:
    """Make ``table`` show the files at ``path`` under ``contract``.

    A table that already has the contract is pointed at the new folder in one step, so a
    reader sees the former state or the new one. Columns of ``partition_by`` are those of the
    folder names; they come last.
    """
    contract = partitioned(contract, partition_by)
    check_contract(spark, path, contract, partition_by)
    point(spark, table, path, contract, partition_by)


def partitioned(contract: StructType, partition_by: Sequence[str]) -> StructType:
    """``contract`` in the order that a partitioned folder is read in."""
    inside = [f for f in contract.fields if f.name not in partition_by]
    return StructType([*inside, *(contract[name] for name in partition_by)])


def point(
    spark: SparkSession, table: str, path: str, contract: StructType,
    partition_by: Sequence[str] = (),
) -> None:
    """The step of ``publish`` that changes the table, for files whose contract is checked."""
    location = path.replace("'", "\\'")
    by = [c.name for c in spark.catalog.listColumns(table) if c.isPartition] if (
        spark.catalog.tableExists(table)
    ) else None
    if by is not None:
        if by == list(partition_by) == [] and spark.table(table).schema == contract:
            spark.sql(f"ALTER TABLE {table} SET LOCATION '{location}'")
            spark.sql(f"REFRESH TABLE {table}")
            return
        # Partitions of a former folder are known by their own paths, so such a table is
        # made anew, as is one of another contract or with other partitions.
        spark.sql(f"DROP TABLE {table}")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in contract.fields)
    partitions = f"PARTITIONED BY ({', '.join(partition_by)})" if partition_by else ""
    spark.sql(
        f"CREATE TABLE {table} ({columns}) USING PARQUET {partitions} LOCATION '{location}'"
    )
    if partition_by:
        spark.catalog.recoverPartitions(table)


def described_location(spark: SparkSession, table: str) -> str:
    """The location of a table, as the catalog has it."""
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {table}")
    return described.where(F.col("col_name") == "Location").first()["data_type"]


def location_of(spark: SparkSession, table: str) -> str:
    """The folder of a table's files; of a table published with others, the run it shows."""
    storage = view_storage(spark, table)
    if storage is None:
        return described_location(spark, table)
    _, run = pointer_rows(spark, table.rsplit(".", 1)[0])[storage]
    return f"{described_location(spark, storage)}/{RUN}={run}"


def view_storage(spark: SparkSession, table: str) -> str | None:
    """The storage table that a table published with others is a view of, if it is one."""
    return properties(spark, table).get(STORAGE) if spark.catalog.tableExists(table) else None


def properties(spark: SparkSession, table: str) -> dict[str, str]:
    rows = spark.sql(f"SHOW TBLPROPERTIES {table}").collect()
    return {r["key"]: r["value"] for r in rows}


def pointer_rows(spark: SparkSession, database: str) -> dict[str, tuple[str, str]]:
    """By storage table, the table that shows it and the run it shows."""
    pointer = f"{database}.{POINTER}"
    if not spark.catalog.tableExists(pointer):
        return {}
    return {r["storage"]: (r["table_name"], r["run"]) for r in spark.table(pointer).collect()}


def column_profile(df: DataFrame) -> DataFrame:
    """(column_name, non_null) for every column, in one pass."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column_name", "non_null")


def contract_report(
    spark: SparkSession, tables: Mapping[str, tuple[str, StructType]]
) -> DataFrame:
    """One row per (table, column): declared type, type in the files, status, non-NULL values.

    ``tables`` maps a label to the catalog table and its contract.
    """
    parts = []
    for label, (table, declared) in tables.items():
        df = spark.table(table)
        rows = contract_differences(stored_schema(spark, location_of(spark, table)), declared)
        verdicts = spark.createDataFrame(
            rows,
            "position int, column_name string, declared string, actual string, status string",
        )
        joined = verdicts.join(column_profile(df), "column_name", "left")
        parts.append(joined.withColumn("table_name", F.lit(label)))
    return reduce(DataFrame.unionByName, parts).select(
        "table_name", "position", "column_name", "declared", "actual", "status", "non_null"
    )
