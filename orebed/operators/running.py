"""Running totals and ranks over groups of any size.

A plain window would put each group on one task, so one large group would decide the run
time of the job. Here rows that tie on the order key are summed first (a frame by value
gives all of them the same total anyway). The sums are cut into slices along the sort order,
each totalled by its own task, with what earlier slices add up to entering as a first row.
Those carried sums are running totals themselves, of the few groups that several slices
share, and are found in the same way. No task ever has to hold a whole large group.

Fractional values are added as decimals, so that totals do not depend on the order of
addition, hence not on how many slices there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from orebed.session import materialize

#: Sums in a slice, on average.
SLICE_KEYS = 100_000
#: What fractional values are added as; sums have ten more digits before the point.
EXACT = "decimal(28,10)"


def _same_keys(left: DataFrame, right: DataFrame, names: Sequence[str], prefix: str) -> Column:
    """Null-safe equality of ``left.name`` and ``right.<prefix>name`` for all names."""
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(right[prefix + name])
    return condition


def _renamed(df: DataFrame, names: Sequence[str], prefix: str) -> DataFrame:
    return df.withColumnsRenamed({name: prefix + name for name in names})


def _accumulated(
    sums: DataFrame, partition_by: Sequence[str], order: Column, slices: int | None = None,
    last: int = Window.currentRow,
) -> DataFrame:
    """``sums``, one row per (group, order key) with ``_own``, and ``_total``: the sum of
    ``_own`` over the group up to and including the row, or the one before if ``last`` is -1."""
    slices = slices or max(1, -(-sums.count() // SLICE_KEYS))
    ranged = sums.repartitionByRange(slices, *(F.col(c).asc() for c in partition_by), order)
    # A range exchange samples its input, so a second evaluation may cut elsewhere.
    # The cut is used twice below and therefore written down first.
    sliced = ranged.withColumn("_slice", F.spark_partition_id())
    keyed = sliced.withColumn("_is_key", F.lit(True))
    if slices > 1:
        sliced = materialize(sliced, "slices")
        carried = _carried(sliced, partition_by).withColumn("_is_key", F.lit(False))
        keyed = sliced.withColumn("_is_key", F.lit(True))
        keyed = keyed.unionByName(carried, allowMissingColumns=True)
    # The slice comes first: its number sorts by radix, text would be compared.
    so_far = (
        Window.partitionBy("_slice", *partition_by)
        .orderBy("_is_key", order)
        .rowsBetween(Window.unboundedPreceding, last)
    )
    totalled = keyed.withColumn("_total", F.sum("_own").over(so_far))
    return totalled.where("_is_key").drop("_slice", "_is_key")


def _carried(sliced: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """(group, slice, ``_own``): the sum of the group's earlier slices, for groups in several
    slices. Those are at most one less than there are slices."""
    parts = sliced.groupBy(*partition_by, "_slice").agg(F.sum("_own").alias("_own"))
    spans = _renamed(
        parts.groupBy(*partition_by).agg(F.count(F.lit(1)).alias("_parts")), partition_by, "_g_"
    )
    shared = parts.join(spans, _same_keys(parts, spans, partition_by, "_g_")).where("_parts > 1")
    shared = shared.select(*partition_by, F.col("_slice").alias("_at"), "_own")
    shared = materialize(shared, "carried")
    totals = _accumulated(shared, partition_by, F.col("_at").asc(), last=-1)
    return totals.select(
        *partition_by, F.col("_at").alias("_slice"), F.col("_total").alias("_own")
    )


def _totals_per_key(
    rows: DataFrame,
    value: Column,
    partition_by: Sequence[str],
    order_by: str,
    descending: bool,
    slices: int | None,
) -> DataFrame:
    """One row per (group, order key): ``_own``, the sum of its rows, and ``_total``, the
    sum of all rows of the group up to and including it."""
    order = F.col(order_by).desc() if descending else F.col(order_by).asc()
    own = rows.groupBy(*partition_by, order_by).agg(F.sum(value).alias("_own"))
    totals = _accumulated(materialize(own, "sums"), partition_by, order, slices)
    # Written down so that the join back to the rows is planned on its true size: a
    # broadcast when it is small, a sort-merge join that splits hot keys when it is not.
    return materialize(totals, "totals")


def _attach(
    rows: DataFrame, totals: DataFrame, keys: Sequence[str], result: Column, out: str
) -> DataFrame:
    """All rows, with their key's result."""
    totals = _renamed(totals.select(*keys, result.alias(out)), keys, "_t_")
    joined = rows.join(totals, _same_keys(rows, totals, keys, "_t_"), "left")
    return joined.drop(*(f"_t_{name}" for name in keys))


def running_total(
    rows: DataFrame,
    value: Column,
    partition_by: Sequence[str],
    order_by: str,
    out: str,
    *,
    descending: bool = False,
    slices: int | None = None,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the group, from its start to this row's order
    key, ties included. NULL keys form one group and sort first (last when descending).

    Fractional values count to ten decimal places; one that is no number, or too large for
    ``EXACT``, is an error. ``rows`` is evaluated twice, so it should be a table rather than
    a long plan. ``slices`` forces that many slices, which does not change the result.
    """
    kind = rows.select(value).schema.fields[0].dataType
    fractional = isinstance(kind, DoubleType | FloatType)
    exact = value.cast(EXACT) if fractional else value
    totals = _totals_per_key(rows, exact, partition_by, order_by, descending, slices)
    total = F.col("_total").cast("double") if fractional else F.col("_total")
    return _attach(rows, totals, [*partition_by, order_by], total, out)


def rank_within(
    rows: DataFrame,
    partition_by: Sequence[str],
    order_by: str,
    out: str,
    *,
    descending: bool = False,
    slices: int | None = None,
) -> DataFrame:
    """Add ``out``: one more than the number of rows of the group that sort before this
    row, so ties share a rank and leave a gap behind them."""
    totals = _totals_per_key(rows, F.lit(1), partition_by, order_by, descending, slices)
    rank = F.col("_total") - F.col("_own") + F.lit(1)
    return _attach(rows, totals, [*partition_by, order_by], rank, out)
