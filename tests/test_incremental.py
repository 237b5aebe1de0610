"""Partitions switched, states kept in buckets, streams that keep the latest version."""

import json

import pytest
from pyspark.sql import functions as F

from orebed.operators import merge
from orebed.operators.merge import merge_into_partitions
from orebed.operators.quality import QualityError
from orebed.operators.state import MissingKey, create_state, merge_into_state, merged_state
from orebed.session import new_workspace
from orebed.sources import partitions
from orebed.sources.layers import location_of
from orebed.sources.partitions import create_partitioned, finish_pending, replace_partitions
from orebed.specs import TEAMS
from orebed.streaming.upsert import (
    LANDED_AT,
    batch_writer,
    last_batch,
    read_dead_letters,
    state_schema,
    stream_lines,
    upsert_available,
)

KIND = "k bigint, v bigint, p string, d int"


@pytest.fixture
def database(spark):
    name = "db_" + new_workspace(spark, "x").rsplit("-", 1)[1]
    spark.sql(f"CREATE DATABASE {name} LOCATION '{new_workspace(spark, 'tables')}'")
    return name


def rows(spark, name):
    return sorted(map(tuple, spark.table(name).collect()), key=repr)


@pytest.fixture
def partitioned(spark, database):
    """(1, NULL partition), (2, NULL), (3, p), (4, "a/b'c")."""
    first = spark.createDataFrame(
        [(1, 1, None, 1), (2, 1, None, 1), (3, 1, "p", 1), (4, 1, "a/b'c", None)], KIND
    )
    name, root = f"{database}.t", new_workspace(spark, "partitioned")
    create_partitioned(spark, name, first.schema, ["p", "d"], root)
    replace_partitions(spark, name, first, first.select("p", "d"))
    return name


def places(spark, name):
    found = spark.table(name).select("p", F.col("_metadata.file_path")).distinct().collect()
    return {(r[0], r[1]) for r in found}


FIRST = [(1, 1, None, 1), (2, 1, None, 1), (3, 1, "p", 1), (4, 1, "a/b'c", None)]


def test_merge_keeps_rows_of_the_null_partition(spark, partitioned):
    before = places(spark, partitioned)
    update = spark.createDataFrame([(2, 5, None, 1), (9, 1, "new", 2), (4, 0, "a/b'c", None)], KIND)
    merge_into_partitions(spark, partitioned, update, ["k", "p", "d"], ["v"])
    expected = [(1, 1, None, 1), (2, 5, None, 1), (3, 1, "p", 1), (4, 1, "a/b'c", None), (9, 1, "new", 2)]
    assert rows(spark, partitioned) == sorted(expected, key=repr)
    # Partitions without updates keep their files.
    kept = {place for place in before if place[0] == "p"}
    assert kept and kept <= places(spark, partitioned)


def test_no_updates_change_nothing(spark, partitioned):
    before = places(spark, partitioned)
    merge_into_partitions(spark, partitioned, spark.createDataFrame([], KIND), ["k"], ["v"])
    assert places(spark, partitioned) == before and rows(spark, partitioned) == FIRST


class Killed(RuntimeError):
    pass


def test_a_merge_killed_before_the_switch_leaves_the_old_rows(spark, partitioned, monkeypatch):
    def die(*_):
        raise Killed

    update = spark.createDataFrame([(2, 5, None, 1), (3, 5, "p", 1)], KIND)
    # All is written, nothing is pointed at: the note is the step that fails.
    real = spark.sql
    monkeypatch.setattr(
        type(spark), "sql",
        lambda self, text, *a, **k: die() if "SET TBLPROPERTIES" in text else real(text, *a, **k),
    )
    with pytest.raises(Killed):
        merge_into_partitions(spark, partitioned, update, ["k", "p", "d"], ["v"])
    monkeypatch.undo()
    assert rows(spark, partitioned) == FIRST
    assert finish_pending(spark, partitioned) is False
    merge_into_partitions(spark, partitioned, update, ["k", "p", "d"], ["v"])
    assert rows(spark, partitioned)[1:3] == [(2, 5, None, 1), (3, 5, "p", 1)]


def test_a_merge_killed_between_two_partitions_is_finished_later(spark, partitioned, monkeypatch):
    update = spark.createDataFrame([(2, 5, None, 1), (3, 5, "p", 1)], KIND)
    real, seen = partitions.point_partition, []

    def second_dies(*args):
        seen.append(args)
        if len(seen) == 2:
            raise Killed
        real(*args)

    monkeypatch.setattr(partitions, "point_partition", second_dies)
    with pytest.raises(Killed):
        merge_into_partitions(spark, partitioned, update, ["k", "p", "d"], ["v"])
    monkeypatch.undo()
    assert finish_pending(spark, partitioned) is True
    expected = [(1, 1, None, 1), (2, 5, None, 1), (3, 5, "p", 1), (4, 1, "a/b'c", None)]
    assert rows(spark, partitioned) == expected
    assert finish_pending(spark, partitioned) is False


STATE = "k bigint, g string, v bigint, note string"


@pytest.fixture
def state(spark, database):
    name = f"{database}.s"
    schema = spark.createDataFrame([], STATE).schema
    create_state(spark, name, schema, ["k", "g"], 4, new_workspace(spark, "state"))
    return name


def merged(spark, name, changes):
    frame = spark.createDataFrame(changes, STATE)
    merge_into_state(spark, name, frame, ["k", "g"], ["v"], new_workspace(spark, "state"))
    return rows(spark, name)


def test_state_keeps_the_latest(spark, state):
    first = [(i, "x", 1, "a") for i in range(50)]
    assert merged(spark, state, first + [(3, "x", 0, "old")]) == sorted(first, key=repr)
    got = merged(spark, state, [(1, "x", 2, "b"), (2, "x", 0, "late"), (3, "x", None, "none"), (99, "y", 1, "c")])
    assert (1, "x", 2, "b") in got and (2, "x", 1, "a") in got and (3, "x", 1, "a") in got
    assert (99, "y", 1, "c") in got and len(got) == 51
    assert merged(spark, state, []) == got


def test_state_refuses_rows_without_a_key(spark, state):
    merged(spark, state, [(1, "x", 1, "a")])
    with pytest.raises(MissingKey, match="without k or g"):
        merged(spark, state, [(None, "x", 1, "a")])
    assert rows(spark, state) == [(1, "x", 1, "a")]


@pytest.mark.parametrize("held", [0, 10**9])
def test_no_row_of_the_state_is_shuffled(spark, state, monkeypatch, held):
    """Updates held in memory or sorted: either way the state is scanned by bucket and no
    exchange or sorting aggregate stands above its scan."""
    merged(spark, state, [(i, "x", 1, "a") for i in range(100)])
    monkeypatch.setattr(merge, "HELD_UPDATES", held)
    update = spark.createDataFrame([(5, "x", 9, "b")], STATE)
    plan = merged_state(spark, state, update, ["k", "g"], ["v"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    join = "ShuffledHashJoin" if held else "SortMergeJoin"
    assert join in text and "SelectedBucketsCount: 4 out of 4" in text
    lines = text.split("\n")
    at = next(i for i, line in enumerate(lines) if "Bucketed: true" in line)
    depth = [len(line) - len(line.lstrip(" :+-*()0123456789")) for line in lines]
    above, level = [], depth[at]
    for i in range(at - 1, -1, -1):
        if depth[i] < level:
            above.append(lines[i])
            level = depth[i]
    assert above and not any("Exchange" in a or "Aggregate" in a for a in above), above
    assert plan.where("v = 9").count() == 1


def payload(*teams):
    return json.dumps({"teams": [{"idTeam": i, "strTeam": n} for i, n in teams]})


@pytest.fixture
def stream(spark, database):
    """A state, and a function that lands lines and runs the stream over them."""
    root, name = new_workspace(spark, "stream"), f"{database}.teams"
    create_state(spark, name, state_schema(TEAMS), ["team_id"], 2, f"{root}/empty")

    def run(lines=(), share=1.0):
        if lines:
            frame = spark.createDataFrame([(line,) for line in lines], "value string")
            frame.coalesce(1).write.mode("append").text(f"{root}/in")
        query = upsert_available(
            stream_lines(spark, TEAMS, f"{root}/in"), TEAMS, name, ["team_id"], [LANDED_AT],
            root, f"{root}/progress", share,
        )
        query.awaitTermination()
        spark.sql(f"REFRESH TABLE {name}")
        return {r.team_id: r.team_name for r in spark.table(name).collect()}

    return root, name, run


def test_the_last_version_wins(spark, stream):
    root, name, run = stream
    assert run([payload(("1", "a"), ("2", "b"))]) == {"1": "a", "2": "b"}
    assert run([payload(("2", "c"))]) == {"1": "a", "2": "c"}
    assert run() == {"1": "a", "2": "c"}
    assert last_batch(spark, name, f"{root}/progress") == 1


def test_a_batch_that_runs_twice_changes_nothing(spark, stream):
    root, name, run = stream
    run([payload(("1", "a"))])
    place = location_of(spark, name)
    write = batch_writer(TEAMS, name, ["team_id"], [LANDED_AT], root, f"{root}/progress", 1.0)
    again = spark.read.schema("teams array<struct<idTeam: string>>").json(f"{root}/in")
    write(again, 0)
    assert location_of(spark, name) == place and run() == {"1": "a"}


def test_dead_letters_and_the_stop(spark, stream):
    root, name, run = stream
    good = payload(("1", "a"))
    assert run([good, '{"teams": [{', '{"message": "x"}', payload((None, "no id"), ("3", "c"))]) == {
        "1": "a", "3": "c",
    }
    letters = sorted((r.reason, r.batch) for r in read_dead_letters(spark, root).collect())
    assert letters == [("broken line", 0), ("line without array", 0), ("row without key", 0)]
    texts = {r.reason: r.line for r in read_dead_letters(spark, root).collect()}
    assert texts["broken line"] == '{"teams": [{' and '"no id"' in texts["row without key"]
    with pytest.raises(Exception, match="1 of 2 lines are broken"):
        run([payload(("1", "z")), "{"], share=0.4)
    spark.sql(f"REFRESH TABLE {name}")
    assert {r.team_name for r in spark.table(name).collect()} == {"a", "c"}
    # The batch is still to be done, and its letters are written once.
    assert run(share=0.5) == {"1": "z", "3": "c"}
    assert read_dead_letters(spark, root).where("batch = 1").count() == 1
    assert issubclass(QualityError, ValueError)
