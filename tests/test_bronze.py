import json
import random

import pytest
from pyspark.sql import functions as F

from orebed.fixtures import payload_batches
from orebed.operators.flatten import flatten, has_array
from orebed.session import new_workspace
from orebed.sources.bronze import (
    has_files,
    keep_non_empty,
    keep_payloads,
    land_lines,
    land_payloads,
    land_rows,
    missing_inputs,
    payload_rows,
    read_bronze,
    to_lines,
)
from orebed.specs import SOURCE_FILE, STRICT, TEAMS, entity

KEPT = [
    '{"teams":[{"idTeam":"1"}]}',
    '{"message":"x"}',
    '{"teams":null,"n":1}',
    '{"s":"0"}',
    '{"s":"false"}',
    '{"s":"[]"}',
    '{"s":"null"}',
    '{"b":true}',
    '{"n":-0.5}',
    '{"o":{"z":null}}',
    '{"teams":"No data"}',
    '{"teams":[null]}',
]
DROPPED = [
    '{"teams":[]}',
    '{"teams":null}',
    '{"n":0}',
    '{"n":0.0}',
    '{"n":-0.0e3}',
    '{"s":""}',
    '{"b":false}',
    "{}",
    '{"o":{}}',
    '{"teams":[],"n":0,"s":"","b":false,"o":{},"z":null}',
    "[1]",
    '"text"',
    "5",
    "null",
    "broken{",
    '{"teams":[{"idTeam":"1"}',
    "",
]


@pytest.mark.parametrize("line,kept", [(x, True) for x in KEPT] + [(x, False) for x in DROPPED])
def test_python_truth_is_the_model(line, kept):
    """The two lists above, against what any(...) over the values says."""
    try:
        payload = json.loads(line)
        expected = isinstance(payload, dict) and any(payload.values())
    except ValueError:
        expected = False
    assert expected == kept


def test_keep_payloads(spark):
    lines = spark.createDataFrame([(x,) for x in [*KEPT, *DROPPED, None]], "value string")
    assert [r.value for r in keep_payloads(lines).collect()] == KEPT


def test_keep_non_empty_columns(spark):
    df = spark.createDataFrame(
        [(1, ["a"], None), (2, [], []), (3, None, None), (4, [], [None])],
        "id int, a array<string>, b array<string>",
    ).drop("id")
    assert keep_non_empty(df).count() == 2


def teams(spark, rows):
    """Team rows from (id, name) pairs."""
    missing = F.lit(None).cast("string")
    df = spark.createDataFrame(rows, "team_id string, team_name string")
    return df.select(*[F.col(c) if c in df.columns else missing.alias(c) for c in TEAMS.columns])


def test_round_trip_keeps_text_and_nulls(spark):
    names = ["Côte d'Ivoire", "日本", 'quo"te', "line\nbreak", "back\\slash", "", None]
    path = new_workspace(spark, "test")
    land_rows(teams(spark, [(str(i), n) for i, n in enumerate(names)]), TEAMS, path)
    flat = flatten(read_bronze(spark, TEAMS, path), TEAMS)
    assert flat.columns == TEAMS.columns
    assert {r.team_id: r.team_name for r in flat.collect()} == {
        str(i): n for i, n in enumerate(names)
    }
    text = "".join(r.value for r in spark.read.text(path).collect())
    assert "Côte d'Ivoire" in text and "日本" in text


def test_explode_rules(spark):
    """NULL and empty arrays give nothing, a NULL element a row of NULLs, a missing field
    a NULL, a field of another type its text."""
    path = new_workspace(spark, "test")
    lines = [
        '{"teams":null}', '{"teams":[]}', '{"other":1}', '{"teams":"No data"}', "broken{", "5",
        '{"teams":[null,{"idTeam":"1"},{"idTeam":2,"strTeam":"b","unknown":9}]}',
    ]
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    bronze = read_bronze(spark, TEAMS, path)
    rows = flatten(bronze, TEAMS).select("team_id", "team_name").collect()
    assert sorted(map(tuple, rows), key=str) == [("1", None), ("2", "b"), (None, None)]


def test_guard(spark):
    def bronze(*lines):
        path = new_workspace(spark, "test")
        spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
        return read_bronze(spark, TEAMS, path)

    assert not has_array(bronze('{"message":"x"}', '{"teams":null}', "broken{"), TEAMS)
    assert has_array(bronze('{"message":"x"}', '{"teams":[]}'), TEAMS)


def test_land_lines_filters(spark):
    path = new_workspace(spark, "test")
    land_lines(spark.createDataFrame([(x,) for x in [*KEPT, *DROPPED]], "value string"), path)
    assert sorted(r.value for r in spark.read.text(path).collect()) == sorted(KEPT)


def test_land_payloads_filters(spark):
    path = new_workspace(spark, "test")
    rows = teams(spark, [("1", "a"), ("2", "b")])
    one = payload_rows(rows, TEAMS)
    empty = one.select(F.when(F.lit(False), F.col("teams")).alias("teams"))
    land_payloads(one.unionAll(empty).unionAll(one.select(F.slice("teams", 1, 0).alias("teams"))), path)
    assert spark.read.text(path).count() == 2


def test_landing_replaces(spark):
    path = new_workspace(spark, "test")
    for name in ("first", "second"):
        land_rows(teams(spark, [("1", name)]), TEAMS, path)
    assert [r.team_name for r in flatten(read_bronze(spark, TEAMS, path), TEAMS).collect()] == ["second"]


def test_few_columns_read_few_fields(spark):
    path = new_workspace(spark, "test")
    land_payloads(payload_rows(teams(spark, [("1", "a")]), TEAMS), path)
    bronze = read_bronze(spark, TEAMS, path, ["team_name"])
    assert bronze.schema["teams"].dataType.elementType.names == ["strTeam"]
    assert flatten(bronze, TEAMS, columns=["team_name"]).collect()[0].team_name == "a"
    with pytest.raises(ValueError, match="no column"):
        TEAMS.raw_schema(["nonsense"])


def test_strict_types_and_lineage(spark):
    path = new_workspace(spark, "test")
    lines = [json.dumps({"teams": [{"idTeam": "1", "intFormedYear": y}]}) for y in ("1900", "x", " 7 ")]
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    flat = flatten(read_bronze(spark, TEAMS, path), TEAMS, STRICT)
    rows = flat.collect()
    assert sorted(str(r.team_founded) for r in rows) == ["1900", "7", "None"]
    assert all(path in r[SOURCE_FILE] for r in rows)
    with pytest.raises(ValueError, match="mode"):
        flatten(read_bronze(spark, TEAMS, path), TEAMS, "loose")


def test_batches_are_whole_and_bounded(spark):
    """No row is lost, no line is longer than asked for, copies or not, and none is moved."""
    rows = spark.range(0, 2000, 1, 3).select(
        F.when(F.col("id") < 700, 0).otherwise(F.col("id")).alias("k"),
        F.when(F.col("id") % 7 > 0, "x").alias("v"),
        F.lit(0.5).alias("d"),
    )
    batches = payload_batches(rows, "items", per_line=50)
    sizes = [r[0] for r in batches.select(F.size("items")).collect()]
    assert sum(sizes) == 2000 and max(sizes) == 50 and len(sizes) <= 40 + 3
    back = batches.select(F.explode("items").alias("i")).select("i.*")
    assert back.exceptAll(rows).isEmpty() and rows.exceptAll(back).isEmpty()
    assert "Exchange" not in batches._jdf.queryExecution().executedPlan().toString()
    assert payload_batches(rows.limit(0), "items").count() == 0


def test_missing_inputs(spark):
    there, absent = new_workspace(spark, "test"), new_workspace(spark, "test")
    to_lines(payload_rows(teams(spark, [("1", "a")]), TEAMS)).write.text(there)
    assert missing_inputs(spark, [there, absent]) == [absent]
    assert not has_files(spark, there, "*.parquet")


def test_random_payloads_against_python(spark):
    pick = random.Random(11)

    def value(depth=0):
        kinds = ["", "0", "x", "null", "é\"\\", 0, 0.0, -0.0, 7, -1.5, True, False, None, [], {}]
        if depth < 2 and pick.random() < 0.3:
            return pick.choice([[value(depth + 1)], {"k": value(depth + 1)}])
        return pick.choice(kinds)

    def document():
        if pick.random() < 0.1:
            return value()
        empty = ["", 0, 0.0, False, None, [], {}]
        some = [pick.choice(empty) if pick.random() < 0.7 else value() for _ in range(3)]
        return {name: v for name, v in zip("abc", some) if pick.random() < 0.8}

    documents = [document() for _ in range(600)]
    lines = [(i, json.dumps(d, ensure_ascii=pick.random() < 0.5)) for i, d in enumerate(documents)]
    kept = keep_payloads(spark.createDataFrame(lines, "id int, value string"))
    expected = [i for i, d in enumerate(documents) if isinstance(d, dict) and any(d.values())]
    assert sorted(r.id for r in kept.select("id").collect()) == expected
    assert 100 < len(expected) < 500


def test_an_entity_of_ones_own(spark):
    players = entity(
        "players", "player", "idPlayer player_id string\nintNumber shirt bigint",
        "player_id shirt", "", "player_id",
    )
    path = new_workspace(spark, "test")
    rows = spark.createDataFrame([("p1", "9"), ("p2", "x")], "player_id string, shirt string")
    land_rows(rows, players, path)
    flat = flatten(read_bronze(spark, players, path), players, STRICT).drop(SOURCE_FILE)
    assert sorted(map(tuple, flat.collect())) == [("p1", 9), ("p2", None)]
    assert players.gold_contract(STRICT).simpleString() == (
        "struct<player_id:string,shirt:bigint,gold_loaded_at:timestamp>"
    )
