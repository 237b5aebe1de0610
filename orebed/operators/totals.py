"""Stored running totals that follow changes.

The sums of all rows with one group and order key are cut into slices along their order. Each
slice is a partition of a table, with the running sum within the slice beside every sum; what
a group adds up to in a slice is stored apart, in a second level of the same table. A total is
the sum within its slice and what the group's earlier slices add up to, which follows from the
second level alone. So a change writes the slices it falls into again and no others, whatever
stands behind them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from orebed.operators.running import EXACT, SLICE_KEYS
from orebed.session import materialize
from orebed.sources.partitions import (
    create_partitioned,
    finish_pending,
    replace_partitions,
    rows_of_partitions,
)

SUMS, HEADS = 0, 1
_OWN, _ROWS, _WITHIN = "_own", "_rows", "_within"
_PLACE = ["_slice", "_level"]


def _same(left: DataFrame, right: DataFrame, names: Sequence[str], prefix: str) -> Column:
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(right[prefix + name])
    return condition


def _sums(rows: DataFrame, value: Column, group: Sequence[str], key: str, sign: int) -> DataFrame:
    """One row per group and key: sum and number of rows."""
    kind = rows.select(value).schema.fields[0].dataType
    exact = value.cast(EXACT) if isinstance(kind, DoubleType | FloatType) else value
    wide = (exact * F.lit(sign)).cast("decimal(38,10)")
    return rows.groupBy(*group, key).agg(
        F.sum(wide).alias(_OWN), (F.count(F.lit(1)) * F.lit(sign)).alias(_ROWS)
    )


def _levels(sums: DataFrame, group: Sequence[str], key: str) -> DataFrame:
    """Both levels of the slices in ``sums`` (group, key, own, rows, slice)."""
    along = Window.partitionBy("_slice", *group).orderBy(F.col(key).asc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    own = F.coalesce(_OWN, F.lit(0)).cast("decimal(38,10)")
    lower = sums.select(
        *group, key, F.col(_OWN).cast("decimal(38,10)").alias(_OWN),
        F.col(_ROWS).cast("bigint").alias(_ROWS),
        F.sum(own).over(along).cast("decimal(38,10)").alias(_WITHIN),
        "_slice", F.lit(SUMS).alias("_level"),
    )
    # A head's key is the first of its group in the slice; NULL keys come first.
    first = F.when(F.max(F.col(key).isNull()), F.lit(None)).otherwise(F.min(key))
    heads = sums.groupBy("_slice", *group).agg(
        first.cast(sums.schema[key].dataType).alias(key),
        F.sum(own).cast("decimal(38,10)").alias(_OWN), F.sum(_ROWS).cast("bigint").alias(_ROWS),
    )
    upper = heads.withColumn(_WITHIN, F.lit(0).cast("decimal(38,10)")).withColumn(
        "_level", F.lit(HEADS)
    )
    return lower.unionByName(upper)


def build_totals(
    spark: SparkSession, table: str, rows: DataFrame, value: Column, group: Sequence[str],
    key: str, root: str, slices: int | None = None,
) -> None:
    """Store the running totals of ``value`` over ``group`` along ``key`` as a table below
    ``root``. NULL groups and keys count as in ``running_total``, as do fractional values."""
    sums = materialize(_sums(rows, value, group, key, 1), "sums")
    slices = slices or max(1, -(-sums.count() // SLICE_KEYS))
    order = [F.col(c).asc() for c in (*group, key)]
    # Which partition a sum falls into is used more than once, so it is written down.
    cut = sums.repartitionByRange(slices, *order).withColumn("_slice", F.spark_partition_id())
    levels = materialize(_levels(materialize(cut, "slices"), group, key), "levels")
    create_partitioned(spark, table, levels.schema, _PLACE, root)
    replace_partitions(spark, table, levels, levels.select(*_PLACE))


def _placed(changes: DataFrame, heads: DataFrame, group: Sequence[str], key: str) -> DataFrame:
    """Changes with the slice each falls into: the last of its group that begins at or before
    the key, else the group's first; the last slice of all for a new group."""
    lows = heads.groupBy(*group).agg(
        F.sort_array(F.collect_list(F.struct(F.col(key).alias("low"), "_slice"))).alias("_lows")
    )
    lows = lows.select(*(F.col(c).alias(f"_g_{c}") for c in group), "_lows")
    joined = changes.join(lows, _same(changes, lows, group, "_g_"), "left")
    before = F.filter("_lows", lambda x: x["low"].isNull() | (x["low"] <= F.col(key)))
    last = heads.agg(F.max("_slice")).scalar()
    place = F.coalesce(
        F.try_element_at(before, F.lit(-1))["_slice"],
        F.try_element_at(F.col("_lows"), F.lit(1))["_slice"], last, F.lit(0),
    )
    return joined.select(*changes.columns, place.alias("_slice"))


def _divided(sums: DataFrame, group: Sequence[str], key: str, first_free: int) -> DataFrame:
    """Slices that have grown to more than twice their size, cut into several. The slices
    touched are counted on the driver, one number each."""
    counted = sums.groupBy("_slice").count().where(F.col("count") > 2 * SLICE_KEYS).collect()
    if not counted:
        return sums
    spans, free = [], first_free
    for row in counted:
        parts = -(-row["count"] // SLICE_KEYS)
        spans.append((row["_slice"], free))
        free += parts
    spread = sums.sparkSession.createDataFrame(spans, "_from int, _free int")
    order = [F.col(c).asc() for c in (*group, key)]
    number = F.row_number().over(Window.partitionBy("_slice").orderBy(*order)) - 1
    part = F.floor(number / SLICE_KEYS).cast("int")
    joined = sums.withColumn("_part", part).join(
        spread, F.col("_slice") == F.col("_from"), "left"
    )
    moved = F.when(
        F.col("_free").isNotNull() & (F.col("_part") > 0), F.col("_free") + F.col("_part")
    ).otherwise(F.col("_slice"))
    return joined.withColumn("_slice", moved).drop("_part", "_from", "_free")


def update_totals(
    spark: SparkSession, table: str, value: Column, group: Sequence[str], key: str,
    added: DataFrame | None = None, removed: DataFrame | None = None,
) -> list[int]:
    """Let the stored totals follow rows that were added or removed. Returns the slices written
    again; the files of all others stay. ``removed`` rows must have been counted before."""
    finish_pending(spark, table)
    parts = [(added, 1), (removed, -1)]
    changes = [_sums(rows, value, group, key, sign) for rows, sign in parts if rows is not None]
    if not changes:
        return []
    both = changes[0] if len(changes) == 1 else changes[0].unionByName(changes[1])
    stored = spark.table(table)
    heads = stored.where(F.col("_level") == HEADS)
    placed = materialize(_placed(both, heads, group, key), "changes")
    touched = placed.select("_slice").distinct().collect()
    if not touched:
        return []
    current = rows_of_partitions(stored.where(F.col("_level") == SUMS), touched, ["_slice"])
    columns = [*group, key, _OWN, _ROWS, "_slice"]
    sums = current.select(*columns).unionByName(placed.select(*columns)).groupBy(
        "_slice", *group, key
    )
    # A sum whose rows are all gone stays as one of no rows, so that no slice is ever empty.
    summed = sums.agg(F.sum(_OWN).alias(_OWN), F.sum(_ROWS).alias(_ROWS))
    free = heads.agg(F.max("_slice")).first()[0] or 0
    divided = _divided(materialize(summed, "changed-sums"), group, key, free + 1)
    levels = materialize(_levels(divided, group, key), "levels").select(*stored.columns)
    replace_partitions(spark, table, levels, levels.select(*_PLACE))
    return sorted(row["_slice"] for row in touched)


def read_totals(spark: SparkSession, table: str, group: Sequence[str], key: str, out: str) -> DataFrame:
    """(group, key, rows, own, ``out``): of each group and key the number of rows, their sum and
    the running total. Heads are few: one for each group and slice that meet."""
    stored = spark.table(table)
    before = Window.partitionBy(*group).orderBy(F.col(key).asc(), "_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    heads = stored.where(F.col("_level") == HEADS).select(
        *(F.col(c).alias(f"_h_{c}") for c in group), F.col("_slice").alias("_h_slice"),
        F.sum(_OWN).over(before).alias("_carried"),
    )
    sums = stored.where((F.col("_level") == SUMS) & (F.col(_ROWS) > 0))
    joined = sums.join(
        heads, _same(sums, heads, group, "_h_") & (F.col("_slice") == F.col("_h_slice"))
    )
    total = F.col(_WITHIN) + F.coalesce("_carried", F.lit(0))
    return joined.select(
        *group, key, F.col(_ROWS).alias("rows"), F.col(_OWN).cast("double").alias("own"),
        total.cast("double").alias(out),
    )
