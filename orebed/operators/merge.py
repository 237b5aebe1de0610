"""Incremental loads: merge on key and consolidation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orebed.session import materialize
from orebed.sources.partitions import (
    finish_pending,
    partition_columns,
    replace_partitions,
    rows_of_partitions,
)


def latest_per_key(rows: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The row of each key that is greatest in ``order_by``.

    An aggregate rather than a ranking window: every task keeps one row per key before the
    shuffle, so a key that holds much of the table costs no more than any other.
    """
    others = [c for c in rows.columns if c not in keys]
    newest = F.max_by(F.struct(*others), F.struct(*order_by)).alias("newest")
    picked = rows.groupBy(*keys).agg(newest).select(*keys, "newest.*")
    return picked.select(*rows.columns)


def merge_latest(
    current: DataFrame, updates: DataFrame, keys: Sequence[str], order_by: Sequence[str]
) -> DataFrame:
    """Merge ``updates`` into ``current``: the latest row of each key wins. The result is a
    new table state; plain Parquet has no in-place merge."""
    return latest_per_key(current.unionByName(updates), keys, order_by)


#: Most updates of one task's share of keys that are held in memory for a join; more are sorted.
HELD_UPDATES = 1_000_000


def merge_by_join(
    state: DataFrame, updates: DataFrame, keys: Sequence[str], order_by: Sequence[str],
    parts: int, null_safe: bool = True,
) -> DataFrame:
    """Merge ``updates`` into ``state``, which has one row per key: an update replaces a row that
    is not greater in ``order_by``. Updates are reduced to one per key; the state is neither
    sorted nor aggregated for this. ``parts`` is how many tasks share the keys. Without
    ``null_safe``, no key may be NULL."""
    newest = materialize(latest_per_key(updates, keys, order_by), "newest")
    # Keys are different here, so they spread evenly.
    held = "shuffle_hash" if newest.count() <= HELD_UPDATES * parts else "merge"
    new = newest.select(
        F.struct(*state.columns).alias("_new"), *(F.col(k).alias(f"_n_{k}") for k in keys)
    ).hint(held)
    old = state.select(F.struct(*state.columns).alias("_old"), *keys)
    condition = F.lit(True)
    for k in keys:
        one, other = F.col(k), F.col(f"_n_{k}")
        condition = condition & (one.eqNullSafe(other) if null_safe else one == other)

    def order(row: str) -> Column:
        return F.struct(*(F.col(row)[c].alias(c) for c in order_by))

    is_newer = F.col("_old").isNull() | (
        F.col("_new").isNotNull() & (order("_new") >= order("_old"))
    )
    picked = F.when(is_newer, F.col("_new")).otherwise(F.col("_old"))
    return old.join(new, condition, "full_outer").select(picked.alias("_row")).select("_row.*")


def merge_into_partitions(
    spark: SparkSession, table: str, updates: DataFrame, keys: Sequence[str], order_by: Sequence[str]
) -> None:
    """Merge ``updates`` into a partitioned table with one row per key, rewriting only partitions
    they fall into, NULL ones included; all others keep their files. A key must always fall into
    the same partition.

    Rows go to fresh folders that the partitions are then pointed at, so whoever reads meanwhile
    reads what was there, and a merge that dies leaves the old rows, or the new ones once
    ``finish_pending`` has been called. ``order_by`` should be a total order of a key's rows, else
    ties are settled arbitrarily.
    """
    finish_pending(spark, table)
    by = partition_columns(spark, table)
    stored = spark.table(table)
    updates = materialize(updates.select(*stored.columns), "updates")
    touched = materialize(updates.select(*by).distinct(), "touched")
    current = rows_of_partitions(stored, touched.collect(), by)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    merged = merge_by_join(current, updates, keys, order_by, parts)
    replace_partitions(spark, table, merged.select(*stored.columns), touched)


def consolidate(frames: Mapping[object, DataFrame], tag: str) -> DataFrame:
    """Union tables of one shape, each row tagged with the name of its table."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in frames.items()]
    return reduce(DataFrame.unionByName, tagged)
