"""Running totals against a plain window, on small tables with large groups."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from orebed.operators import running
from orebed.operators.running import rank_within, running_total


@pytest.fixture(scope="module")
def rows(spark):
    """A group with most rows, a key with a third of them, NULLs everywhere."""
    pick = random.Random(7)
    data = []
    for i in range(3000):
        group = pick.choice(["hot"] * 6 + ["b", "c", None])
        position = "5" if pick.random() < 0.33 else pick.choice([None, *map(str, range(400))])
        data.append((i, group, position, pick.choice([None, 1.0, 2.0, 7.0, -3.0])))
    return spark.createDataFrame(data, "id int, grp string, pos string, pts double")


def by_id(df, column):
    return {r.id: r[column] for r in df.select("id", column).collect()}


def plain(rows, order, descending=False):
    window = Window.partitionBy("grp").orderBy(
        F.col(order).desc() if descending else F.col(order).asc()
    )
    frame = window.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select("id", F.sum("pts").over(frame).alias("total"), F.rank().over(window).alias("rk"))


@pytest.mark.parametrize(
    "slices,numeric,descending",
    [(None, False, False), (None, True, True), (1, True, False), (5, False, True),
     (5, True, False), (40, False, False)],
)
def test_equals_plain_window(rows, slices, numeric, descending):
    if numeric:
        rows = rows.withColumn("pos", F.col("pos").try_cast("bigint"))
    expected = plain(rows, "pos", descending)
    kept = {"descending": descending, "slices": slices}
    totals = running_total(rows, F.col("pts"), ["grp"], "pos", "total", **kept)
    assert totals.columns == [*rows.columns, "total"]
    assert by_id(totals, "total") == by_id(expected, "total")
    ranks = rank_within(rows, ["grp"], "pos", "rk", **kept)
    assert by_id(ranks, "rk") == by_id(expected, "rk")


def test_slices_follow_the_number_of_sums(rows, monkeypatch):
    """Few sums in a slice, so that the carried sums are cut into slices again."""
    monkeypatch.setattr(running, "SLICE_KEYS", 4)
    totals = running_total(rows, F.col("pts"), ["grp"], "pos", "total")
    assert by_id(totals, "total") == by_id(plain(rows, "pos"), "total")


@pytest.mark.parametrize("slices", [1, 5, 40])
def test_fractions_do_not_depend_on_slices(rows, slices):
    tenths = rows.withColumn("pts", F.col("id") * 0.1 + F.when(F.col("id") % 5 == 0, 1e7).otherwise(0.3))
    totals = by_id(running_total(tenths, F.col("pts"), ["grp"], "pos", "total", slices=slices), "total")
    exact = tenths.withColumn("pts", F.col("pts").cast("decimal(28,10)"))
    assert totals == {i: float(v) for i, v in by_id(plain(exact, "pos"), "total").items()}


def test_whole_table_as_one_group(rows):
    totals = running_total(rows, F.col("pts"), [], "pos", "total", slices=6)
    frame = Window.orderBy("pos").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    expected = rows.select("id", F.sum("pts").over(frame).alias("total"))
    assert by_id(totals, "total") == by_id(expected, "total")


def test_several_group_columns(rows):
    rows = rows.withColumn("half", F.col("id") < 1500)
    totals = running_total(rows, F.col("pts"), ["half", "grp"], "pos", "total", slices=4)
    frame = (
        Window.partitionBy("half", "grp")
        .orderBy("pos")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    expected = rows.select("id", F.sum("pts").over(frame).alias("total"))
    assert by_id(totals, "total") == by_id(expected, "total")


def test_last_total_is_the_group_sum(rows):
    totals = running_total(rows, F.col("pts"), ["grp"], "pos", "total", slices=5)
    last = totals.groupBy("grp").agg(F.max_by("total", F.coalesce("pos", F.lit(""))).alias("s"))
    sums = rows.groupBy("grp").agg(F.sum("pts").alias("s"))
    assert sorted(last.collect(), key=str) == sorted(sums.collect(), key=str)


def test_no_slice_holds_a_large_group(rows):
    """The hot group is cut into slices of similar size."""
    captured = {}
    original = running.materialize

    def spy(df, label):
        captured[label] = original(df, label)
        return captured[label]

    running.materialize = spy
    try:
        running_total(rows, F.col("pts"), ["grp"], "pos", "total", slices=10)
    finally:
        running.materialize = original
    sizes = [r["count"] for r in captured["slices"].groupBy("_slice").count().collect()]
    assert len(sizes) >= 8 and max(sizes) <= 3 * sum(sizes) / len(sizes)


def test_join_back_splits_a_hot_key(spark, rows):
    """Without a broadcast the rows of the hot key are divided among tasks."""
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {key: spark.conf.get(key) for key in changed}
    try:
        for key, value in changed.items():
            spark.conf.set(key, value)
        totals = running_total(rows.repartition(8), F.col("pts"), ["grp"], "pos", "total", slices=5)
        result = by_id(totals, "total")
        collected = totals.select("id", "total")
        collected.collect()
        plan = collected._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin(skew=true)" in plan
        assert result == by_id(plain(rows, "pos"), "total")
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_few_totals_are_broadcast(rows):
    totals = running_total(rows, F.col("pts"), ["grp"], "pos", "total")
    plan = totals._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
