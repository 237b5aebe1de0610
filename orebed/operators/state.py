"""State tables stored by key, so that a merge moves the updates only.

A state is a table with one row per key, written in buckets by key and sorted within them. A
merge joins bucket with bucket: the updates are shuffled to the state's buckets, the state stays
where it is. The result is a new folder with the same buckets, which the table is then pointed
at in one step.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orebed.operators.merge import merge_by_join
from orebed.session import materialize
from orebed.sources.partitions import quoted


class MissingKey(ValueError):
    """A key of a state is NULL."""


def _no_null(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    missing = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    if not rows.where(missing).isEmpty():
        raise MissingKey(f"rows without {' or '.join(keys)}")
    return rows


def buckets_of(spark: SparkSession, table: str) -> int:
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {table}")
    found = described.where(F.col("col_name") == "Num Buckets").first()
    return int(found["data_type"])


def write_buckets(rows: DataFrame, path: str, keys: Sequence[str], buckets: int) -> None:
    """Write rows in buckets. The files need no table of their own; the writer wants one."""
    spark = rows.sparkSession
    name = f"orebed_buckets_{uuid.uuid4().hex}"
    writer = rows.write.bucketBy(buckets, *keys).sortBy(*keys).option("compression", "snappy")
    writer.option("path", path).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")


def create_state(
    spark: SparkSession, table: str, schema: StructType, keys: Sequence[str], buckets: int, path: str
) -> None:
    """An empty state at ``path``. ``buckets`` should make them a few hundred MB each when the
    state has grown; it cannot be changed without writing the state again."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    by = ", ".join(f"`{k}`" for k in keys)
    spark.sql(
        f"CREATE TABLE {table} ({columns}) USING PARQUET CLUSTERED BY ({by}) SORTED BY ({by}) "
        f"INTO {buckets} BUCKETS LOCATION {quoted(path)}"
    )


def merged_state(
    spark: SparkSession, table: str, updates: DataFrame, keys: Sequence[str], order_by: Sequence[str]
) -> DataFrame:
    """What the state will be: no row of it is shuffled or aggregated."""
    state = spark.table(table)
    updates = _no_null(updates.select(*state.columns), keys)
    buckets = buckets_of(spark, table)
    return merge_by_join(state, updates, keys, order_by, buckets, null_safe=False)


def merge_into_state(
    spark: SparkSession, table: str, updates: DataFrame, keys: Sequence[str],
    order_by: Sequence[str], path: str,
) -> None:
    """Merge ``updates`` into a state and point it at the result, in the new folder ``path``.

    The latest row of a key in ``order_by`` wins, NULLs counting as least; of equals the update.
    A row whose key is NULL is refused: nothing could ever replace it. Until the last step,
    which is one, readers see the old state.
    """
    updates = materialize(updates, "updates")
    merged = merged_state(spark, table, updates, keys, order_by)
    write_buckets(merged, path, keys, buckets_of(spark, table))
    spark.sql(f"ALTER TABLE {table} SET LOCATION {quoted(path)}")
    spark.sql(f"REFRESH TABLE {table}")

