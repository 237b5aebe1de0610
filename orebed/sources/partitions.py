"""Tables whose partitions are folders of their own, replaced by pointing at new ones.

Rows are never written into a folder that is read. New rows of a partition go to a fresh
folder; when all are written, the table is given the folder's name as pending, in one step,
and then its partitions are pointed there one by one. A writer that dies before that step has
changed nothing; one that dies after it has left a note of what is still to be pointed at,
and whoever writes next (or calls ``finish_pending``) does that first.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from orebed.sources.layers import cluster, location_of, partitioned, properties

PENDING = "orebed.pending"
_SLOT = "_slot"


def quoted(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def create_partitioned(
    spark: SparkSession, table: str, schema: StructType, partition_by: Sequence[str], root: str
) -> None:
    """An empty table below ``root``; the columns of ``partition_by`` come last."""
    schema = partitioned(schema, partition_by)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    by = ", ".join(f"`{name}`" for name in partition_by)
    spark.sql(
        f"CREATE TABLE {table} ({columns}) USING PARQUET PARTITIONED BY ({by}) "
        f"LOCATION {quoted(root)}"
    )


def partition_columns(spark: SparkSession, table: str) -> list[str]:
    return [c.name for c in spark.catalog.listColumns(table) if c.isPartition]


def same_partition(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    """Whether rows are of one partition; NULL is a partition like others."""
    condition = F.lit(True)
    for name in columns:
        condition = condition & left[name].eqNullSafe(right[name])
    return condition


def rows_of_partitions(rows: DataFrame, touched: Sequence[Row], columns: Sequence[str]) -> DataFrame:
    """The rows of the partitions listed, NULL ones included. Folders of others are pruned by
    the values of each column; which of the rest are meant is settled by a join."""
    for name in columns:
        values = {row[name] for row in touched}
        wanted = F.col(name).isin([v for v in values if v is not None])
        rows = rows.where((wanted | F.col(name).isNull()) if None in values else wanted)
    if len(columns) == 1:
        return rows
    schema = StructType([rows.schema[name] for name in columns])
    listed = rows.sparkSession.createDataFrame([tuple(r) for r in touched], schema)
    return rows.join(listed, same_partition(rows, listed, columns), "left_semi")


def replace_partitions(spark: SparkSession, table: str, rows: DataFrame, touched: DataFrame) -> None:
    """Make ``rows`` the whole content of the partitions that ``touched`` names (one row each);
    all others stay as they are. Each of ``touched`` must have a row. The list of partitions is
    held on the driver, as the catalog's own is."""
    finish_pending(spark, table)
    by = partition_columns(spark, table)
    listed = touched.select(*by).distinct().collect()
    if not listed:
        return
    kinds = StructType([rows.schema[name] for name in by])
    slots = spark.createDataFrame(
        [(*row, slot) for slot, row in enumerate(listed)], kinds.add(_SLOT, IntegerType())
    )
    placed = rows.join(slots, same_partition(rows, slots, by)).select(
        *(rows[c] for c in rows.columns if c not in by), _SLOT
    )
    folder = f"{location_of(spark, table)}/put-{uuid.uuid4().hex}"
    writer = cluster(placed, [_SLOT]).write.option("compression", "snappy")
    writer.partitionBy(_SLOT).parquet(f"{folder}/rows")
    # As text, which is how the catalog names partitions.
    names = [F.col(name).cast("string").alias(name) for name in by]
    slots.select(*names, _SLOT).coalesce(1).write.parquet(f"{folder}/slots")
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{PENDING}' = {quoted(folder)})")
    finish_pending(spark, table)


def finish_pending(spark: SparkSession, table: str) -> bool:
    """Point a table's partitions at the folder that is pending, if one is: also what a writer
    that died left undone. Doing it again changes nothing. Whether there was one."""
    folder = properties(spark, table).get(PENDING)
    if folder is None:
        return False
    by = partition_columns(spark, table)
    there = listed_partitions(spark, table)
    added, moved = [], []
    for row in spark.read.parquet(f"{folder}/slots").orderBy(_SLOT).collect():
        values = [(name, row[name]) for name in by]
        spec = ", ".join(f"`{n}` = {'NULL' if v is None else quoted(v)}" for n, v in values)
        known = tuple(v for _, v in values) in there
        (moved if known else added).append((spec, f"{folder}/rows/{_SLOT}={row[_SLOT]}"))
    # New ones in groups, so that no statement becomes endless.
    for start in range(0, len(added), 100):
        listed = (f"PARTITION ({s}) LOCATION {quoted(p)}" for s, p in added[start : start + 100])
        spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS {' '.join(listed)}")
    for spec, location in moved:
        point_partition(spark, table, spec, location)
    spark.sql(f"ALTER TABLE {table} UNSET TBLPROPERTIES ('{PENDING}')")
    spark.sql(f"REFRESH TABLE {table}")
    return True


def listed_partitions(spark: SparkSession, table: str) -> set[tuple[str | None, ...]]:
    """The values of the partitions that a table has, as text."""

    def value(part: str) -> str | None:
        text = unquote(part.split("=", 1)[1])
        return None if text == "__HIVE_DEFAULT_PARTITION__" else text

    rows = spark.sql(f"SHOW PARTITIONS {table}").collect()
    return {tuple(value(part) for part in row[0].split("/")) for row in rows}


def point_partition(spark: SparkSession, table: str, spec: str, location: str) -> None:
    spark.sql(f"ALTER TABLE {table} PARTITION ({spec}) SET LOCATION {quoted(location)}")
