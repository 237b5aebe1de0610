"""Value rules of the gold layer on hand-made rows, ANSI mode on."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from orebed.functions.metrics import goal_metrics, outcome, ratio
from orebed.operators.flatten import stamp
from orebed.plans.gold import gold_matches, gold_standings, gold_teams
from orebed.specs import LOADED_AT, MATCHES, STANDINGS, STRICT, TEAMS

TS = datetime(2026, 1, 1)


def silver(spark, spec, mode="compat", **columns):
    """Rows of an entity from some of its columns; the others are NULL."""
    contract = spec.silver_contract(mode)
    count = len(next(iter(columns.values())))
    rows = [tuple(columns.get(c, [None] * count)[i] for c in contract.names) for i in range(count)]
    return spark.createDataFrame(rows, contract)


def test_session_is_ansi(spark):
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def matches(spark, *scores, mode="compat"):
    home, away = zip(*scores)
    ids = [str(i) for i in range(len(scores))]
    df = silver(spark, MATCHES, mode, match_id=ids, home_score=home, away_score=away)
    return gold_matches(df, mode, TS).orderBy("match_id").collect()


def test_text_scores_compare_as_text(spark):
    assert matches(spark, ("10", "9"))[0].result == "Away Win"
    assert matches(spark, (10, 9), mode=STRICT)[0].result == "Home Win"


def test_unplayed_fixture(spark):
    row = matches(spark, (None, "1"))[0]
    assert (row.result, row.home_score, row.away_score) == ("Draw", "0", "1")
    assert (row.total_goals, row.home_goal_diff, row.away_goal_diff) == (None, None, None)
    strict = matches(spark, (None, 1), mode=STRICT)[0]
    assert (strict.result, strict.home_score, strict.away_score) == (None, 0, 1)


@pytest.mark.parametrize("text,total", [("", None), ("x", None), (" 4 ", 6.0), ("0", 2.0)])
def test_arithmetic_on_text(spark, text, total):
    row = matches(spark, (text, "2"))[0]
    assert row.total_goals == total
    assert row.home_score == text
    if total is not None:
        assert row.home_goal_diff == -row.away_goal_diff


def test_all_outcomes(spark):
    rows = matches(spark, ("2", "1"), ("1", "2"), ("1", "1"), (None, None))
    assert [r.result for r in rows] == ["Home Win", "Away Win", "Draw", "Draw"]
    rows = matches(spark, (2, 1), (1, 2), (1, 1), (None, None), mode=STRICT)
    assert [r.result for r in rows] == ["Home Win", "Away Win", "Draw", None]


def test_division_by_zero_is_null(spark):
    df = silver(
        spark, STANDINGS, standing_id=["a", "b"], group_name=["g", "g"], position=["1", "2"],
        points=["3", "0"], played_games=["0", "0"], won=["1", "0"],
    )
    for row in gold_standings(df, TS).collect():
        assert row.points_per_game is None and row.win_percentage is None


@pytest.mark.parametrize(
    "value,digits,expected",
    [("2.345", 2, 2.35), ("0.125", 2, 0.13), ("-0.125", 2, -0.13), ("1.005", 2, 1.01),
     ("33.35", 1, 33.4)],
)
def test_rounding_is_half_up_on_decimal_text(spark, value, digits, expected):
    df = spark.createDataFrame([(value, "1")], "a string, b string")
    assert df.select(ratio(F.col("a"), F.col("b"), digits)).first()[0] == expected


def test_percentage_divides_first(spark):
    df = spark.createDataFrame([("1", "3"), ("23", "40")], "a string, b string")
    rows = df.select(ratio(F.col("a"), F.col("b"), 1, scale=100)).collect()
    assert [r[0] for r in rows] == [33.3, 57.5]
    assert df.select(ratio(F.col("a"), F.col("b"), 2)).collect()[1][0] == 0.58


def standings(spark, group, position, points, mode="compat"):
    ids = [str(i) for i in range(len(group))]
    df = silver(
        spark, STANDINGS, mode, standing_id=ids, group_name=group, position=position, points=points
    )
    rows = gold_standings(df, TS).collect()
    return [r.running_total_points for r in sorted(rows, key=lambda r: int(r.standing_id))]


def test_tied_positions_share_the_total(spark):
    assert standings(spark, ["g"] * 3, ["1", "2", "2"], ["9", "6", "5"]) == [9, 20, 20]


def test_positions_order_as_text_with_null_first(spark):
    positions, points = [None, "1", "10", "2", "2"], ["4", "9", "1", "6", "5"]
    assert standings(spark, ["g"] * 5, positions, points) == [4, 13, 14, 25, 25]
    typed = [None, 1, 10, 2, 2], [4, 9, 1, 6, 5]
    assert standings(spark, ["g"] * 5, *typed, mode=STRICT) == [4, 13, 25, 24, 24]


def test_null_group_is_one_group(spark):
    assert standings(spark, [None, None], [None, "1"], ["2", "7"]) == [2, 9]


def test_points_that_are_no_number(spark):
    totals = standings(spark, ["g"] * 4, ["1", "2", "3", "4"], ["x", None, "3", ""])
    assert totals == [None, None, 3, 3]


def test_distinct_before_stamp(spark):
    df = silver(spark, TEAMS, team_id=["1", "1", "2"], team_name=["a", "a", "b"])
    gold = gold_teams(df)
    assert gold.count() == 2
    assert gold.select(LOADED_AT).distinct().count() == 1


def test_given_stamp_is_used(spark):
    assert spark.range(1).select(stamp(TS)).first()[0] == TS


def test_gold_columns_follow_the_contract(spark):
    from orebed.sources.layers import contract_differences

    for mode in ("compat", "strict"):
        built = {
            TEAMS: gold_teams(silver(spark, TEAMS, mode, team_id=["1"]), TS),
            MATCHES: gold_matches(silver(spark, MATCHES, mode, match_id=["1"]), mode, TS),
            STANDINGS: gold_standings(silver(spark, STANDINGS, mode, standing_id=["1"]), TS),
        }
        for spec, df in built.items():
            rows = contract_differences(df.schema, spec.gold_contract(mode))
            assert {status for *_, status in rows} == {"ok"}


def test_metrics_reject_nothing(spark):
    df = spark.createDataFrame([("1e400", "-1")], "a string, b string")
    row = df.select(
        *[c.alias(n) for n, c in goal_metrics(F.col("a"), F.col("b")).items()],
        outcome(F.col("a"), F.col("b"), unknown_is_draw=True).alias("result"),
    ).first()
    assert row.total_goals == float("inf") and row.result == "Home Win"


def test_whole_numbers_with_a_zero_fraction(spark):
    from orebed.functions.metrics import whole

    values = ["4", "4.0", " 4 ", "-3.000", "4.5", "x", "", None, "1e2", "9223372036854775807"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    found = {r.i: r.n for r in df.select("i", whole(F.col("v")).alias("n")).collect()}
    assert [found[i] for i in range(len(values))] == [
        4, 4, 4, -3, None, None, None, None, 100, 9223372036854775807
    ]
