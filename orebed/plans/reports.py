"""The reports published over the gold tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: status of a finished fixture.
FINISHED = "FT"


def latest_finished(matches: DataFrame, limit: int = 20) -> DataFrame:
    """The latest finished fixtures. The key breaks ties between fixtures of a day."""
    return (
        matches.where(F.col("match_status") == FINISHED)
        .orderBy(F.col("match_date").desc(), F.col("match_id"))
        .limit(limit)
        .select(
            "match_id", "match_date", "home_team_name", "away_team_name",
            "home_score", "away_score", "total_goals", "result",
        )
    )


def group_report(standings: DataFrame) -> DataFrame:
    """All standings by group and position. The key makes the order total and lets the
    sort divide rows that share a position; copies of a row are divided by their number.
    ``standings`` should be a stored table, where a task that runs again finds its rows in
    the same order and so numbers them alike."""
    numbered = standings.withColumn("copy", F.monotonically_increasing_id())
    return numbered.orderBy("group_name", "position", "standing_id", "copy").select(
        "group_name", "position", "team_name", "points",
        "running_total_points", "points_per_game",
    )


def team_performance(teams: DataFrame, standings: DataFrame, limit: int = 10) -> DataFrame:
    """The best placed teams: profiles left joined to their standings. Every task of the
    join keeps its own best rows, and adaptive execution divides a team with very many
    standings. ``standings`` should be a stored gold table: of that, only the columns of the
    report are read, and no running total is computed again.
    """
    result_order = ["final_rank", "team_id", "standing_id"]
    measures = standings.select(
        "team_id",
        "standing_id",
        F.col("played_games").alias("total_matches"),
        F.col("won").alias("total_wins"),
        "win_percentage",
        F.col("position").alias("final_rank"),
    )
    return (
        teams.select("team_id", "team_name")
        .join(measures, "team_id", "left")
        .orderBy(*result_order)
        .limit(limit)
        .select(
            "team_id", "team_name", "total_matches", "total_wins", "win_percentage", "final_rank"
        )
    )
