"""Sizes known from the test tables at sf0.01."""

import pytest
from pyspark.sql import functions as F

from checks.queries import QUERIES


@pytest.fixture(scope="module")
def run(spark):
    done = {}

    def run(name):
        if name not in done:
            done[name] = QUERIES[name](spark, "/root/testdata/sf0.01").cache()
        return done[name]

    return run


@pytest.mark.parametrize(
    "name,rows",
    [
        ("bronze_roundtrip", 60_000),
        ("explode_drops_empty", 2 * 4_933),
        ("silver_teams", 15_000),
        ("silver_standings", 1_500),
        ("silver_matches", 14_743),
        ("gold_teams", 1_500),
        ("group_report", 1_500),
        ("contract_report", 106),
        ("latest_finished", 20),
        ("team_performance", 10),
        ("merge_latest_events", 750),
        ("stream_dedup", 10_000),
    ],
)
def test_rows(run, name, rows):
    assert run(name).count() == rows


def labels(df):
    return {r.result: r["count"] for r in df.groupBy("result").count().collect()}


def test_outcomes(run):
    assert labels(run("gold_matches")) == {"Home Win": 5_521, "Away Win": 5_438, "Draw": 3_784}
    assert labels(run("gold_matches_strict")) == {
        "Home Win": 6_346, "Away Win": 4_613, "Draw": 99, None: 3_685
    }


def test_metrics_are_null_exactly_without_scores(run):
    typed, text = run("silver_matches_strict"), run("gold_matches")
    missing = typed.where("home_score IS NULL OR away_score IS NULL")
    assert missing.count() == 3_685
    assert text.join(missing, "match_id", "left_semi").where("total_goals IS NOT NULL").isEmpty()
    assert text.where("total_goals IS NULL").count() == 3_685
    assert text.where("home_goal_diff <> -away_goal_diff").isEmpty()


def test_standings(run):
    text, typed = run("gold_standings"), run("gold_standings_strict")
    assert text.select("group_name").distinct().count() == 25
    assert text.select("group_name", "position").distinct().count() == 546
    both = text.select("standing_id", F.col("running_total_points").alias("t")).join(
        typed.select("standing_id", "running_total_points"), "standing_id"
    )
    assert both.where("t <> running_total_points").count() == 1_464
    group_sum = F.sum(F.col("points").cast("double"))
    sums = text.groupBy("group_name").agg(
        F.max("running_total_points").alias("last"), group_sum.alias("total")
    )
    assert sums.where("last <> total").isEmpty()


def test_teams_that_have_not_played(run):
    early = run("gold_standings_early")
    assert early.where("played_games = '0'").count() == 723
    assert early.where("points_per_game IS NULL").count() == 723


def test_payload_choice(run):
    assert run("payload_guard_silver").count() == run("payload_guard").where("has_array").count()
    assert run("payload_guard").where("NOT has_array").count() > 0


def test_rerun(run):
    rows = {r.table_name: r for r in run("medallion_rerun").collect()}
    for name, size in {"teams": 1_500, "standings": 1_500, "matches": 14_743}.items():
        gold = rows[f"gold_{name}"]
        assert (gold.rows_first, gold.rows_second, gold.rows_after_failure) == (size,) * 3
    assert all(r.rows_changed == 0 for r in rows.values())


def test_restated_year(run):
    by_year = run("partition_overwrite").groupBy("order_year").agg(
        F.count_if(F.col("o_orderstatus") == "R").alias("restated"), F.count(F.lit(1)).alias("n")
    )
    rows = {r.order_year: (r.restated, r.n) for r in by_year.collect()}
    assert len(rows) == 7 and sum(n for _, n in rows.values()) == 15_000
    assert all((restated == n) == (year == 1997) for year, (restated, n) in rows.items())
