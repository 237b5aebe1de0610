"""Stored running totals after changes, against totals computed anew."""

import random

import pytest
from pyspark.sql import functions as F

from orebed.operators import totals
from orebed.operators.totals import build_totals, read_totals, update_totals
from orebed.session import new_workspace

KIND = "g string, h string, k int, v double"
GROUP = ["g", "h"]


@pytest.fixture
def table(spark):
    name = "db_" + new_workspace(spark, "x").rsplit("-", 1)[1]
    spark.sql(f"CREATE DATABASE {name} LOCATION '{new_workspace(spark, 'tables')}'")
    return f"{name}.totals"


def frame(spark, rows):
    return spark.createDataFrame(rows, KIND)


def plain(rows):
    """(group, key): rows, own sum, running total."""
    sums = {}
    for g, h, k, v in rows:
        n, own = sums.get((g, h, k), (0, None))
        sums[g, h, k] = (n + 1, own if v is None else (own or 0) + v)
    place = lambda k: (k is not None, k or 0)
    return {
        (g, h, k): (n, own, sum(
            o or 0 for (a, b, c), (_, o) in sums.items() if (a, b) == (g, h) and place(c) <= place(k)
        ))
        for (g, h, k), (n, own) in sums.items()
    }


def stored(spark, table):
    found = read_totals(spark, table, GROUP, "k", "total").collect()
    return {(r.g, r.h, r.k): (r.rows, r.own, r.total) for r in found}


def files(spark, table):
    found = spark.table(table).select("_slice", F.col("_metadata.file_path")).distinct().collect()
    out = {}
    for r in found:
        out.setdefault(r[0], set()).add(r[1])
    return out


def some(seed, n):
    rng = random.Random(seed)
    groups = [("a", "x"), ("a", "x"), ("a", "x"), ("a", None), (None, "y"), ("b", "y")]
    return [
        (*rng.choice(groups), rng.choice([None, *range(60)]), rng.choice([0.25, 1.0, -2.5, 3.0, 7.75]))
        for _ in range(n)
    ]


@pytest.mark.parametrize("slices", [1, 7])
def test_totals_follow_changes(spark, table, slices):
    rows = some(1, 300)
    build_totals(spark, table, frame(spark, rows), F.col("v"), GROUP, "k", new_workspace(spark, "t"), slices)
    assert stored(spark, table) == plain(rows)
    more = some(2, 40) + [("new", "z", 5, 1.5), ("a", "x", -9, 2.0), ("b", "y", 999, 4.0)]
    gone = rows[::7]
    update_totals(spark, table, F.col("v"), GROUP, "k", added=frame(spark, more), removed=frame(spark, gone))
    left = [r for i, r in enumerate(rows) if i % 7] + more
    assert stored(spark, table) == plain(left)
    update_totals(spark, table, F.col("v"), GROUP, "k", removed=frame(spark, left))
    assert stored(spark, table) == {}


def test_only_the_slices_of_a_change_are_written(spark, table):
    rows = [("a", "x", k, 1.0) for k in range(1000)] + [("b", "x", k, 1.0) for k in range(1000)]
    build_totals(spark, table, frame(spark, rows), F.col("v"), GROUP, "k", new_workspace(spark, "t"), 20)
    before = files(spark, table)
    assert len(before) >= 15
    change = [("a", "x", 500, 10.0), ("a", "x", 500, 1.0)]
    written = update_totals(spark, table, F.col("v"), GROUP, "k", added=frame(spark, change))
    after = files(spark, table)
    assert len(written) == 1
    assert {s: f for s, f in after.items() if s not in written} == {
        s: f for s, f in before.items() if s not in written
    }
    assert not after[written[0]] & before[written[0]]
    # All totals behind the change moved, though nothing behind it was written.
    assert stored(spark, table) == plain(rows + change)


def test_a_slice_that_grows_is_divided(spark, table, monkeypatch):
    rows = [("a", "x", 10 * k, 1.0) for k in range(20)]
    build_totals(spark, table, frame(spark, rows), F.col("v"), GROUP, "k", new_workspace(spark, "t"), 2)
    monkeypatch.setattr(totals, "SLICE_KEYS", 15)
    more = [("a", "x", k, 0.5) for k in range(100)]
    update_totals(spark, table, F.col("v"), GROUP, "k", added=frame(spark, more))
    assert len(files(spark, table)) > 5
    assert stored(spark, table) == plain(rows + more)
    again = [("a", "x", 55, 2.0)]
    assert len(update_totals(spark, table, F.col("v"), GROUP, "k", added=frame(spark, again))) == 1
    assert stored(spark, table) == plain(rows + more + again)


def test_nothing_to_do(spark, table):
    build_totals(spark, table, frame(spark, []), F.col("v"), GROUP, "k", new_workspace(spark, "t"))
    assert stored(spark, table) == {}
    assert update_totals(spark, table, F.col("v"), GROUP, "k") == []
    assert update_totals(spark, table, F.col("v"), GROUP, "k", added=frame(spark, [])) == []
    update_totals(spark, table, F.col("v"), GROUP, "k", added=frame(spark, [("a", "x", 1, 2.0), ("a", "x", 1, None)]))
    assert stored(spark, table) == {("a", "x", 1): (2, 2.0, 2.0)}
