"""Column expressions of the gold layer, safe under ANSI mode.

Inputs may be text or numbers: arithmetic goes through ``num``, so text that is no number
counts as NULL instead of failing the job. Comparisons use the columns as they are, which
makes them textual on text columns and numeric on numeric ones.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Outcome labels.
HOME_WIN = "Home Win"
AWAY_WIN = "Away Win"
DRAW = "Draw"


def num(value: Column) -> Column:
    return value.try_cast("double")


def whole(value: Column) -> Column:
    """Text as an integer: also one with a fraction of zero, such as "4.0". Anything else,
    text that is no number or has another fraction, is NULL."""
    exact = value.try_cast("decimal(38,18)")
    return F.when(exact == F.floor(exact), F.floor(exact).try_cast("bigint"))


def ratio(part: Column, whole: Column, digits: int, scale: int = 1) -> Column:
    """``part / whole * scale`` rounded half up; NULL when ``whole`` is zero."""
    quotient = F.try_divide(num(part), num(whole))
    return F.round(quotient if scale == 1 else quotient * F.lit(scale), digits)


def outcome(home: Column, away: Column, unknown_is_draw: bool) -> Column:
    """Label a fixture by its two scores.

    A missing score makes every comparison unknown. With ``unknown_is_draw`` such a
    fixture still gets the draw label, otherwise it gets none.
    """
    label = F.when(home > away, F.lit(HOME_WIN)).when(home < away, F.lit(AWAY_WIN))
    if unknown_is_draw:
        return label.otherwise(F.lit(DRAW))
    return label.when(home == away, F.lit(DRAW))


def goal_metrics(home: Column, away: Column) -> dict[str, Column]:
    """Total and both differences; NULL unless both scores are numbers."""
    return {
        "total_goals": num(home) + num(away),
        "home_goal_diff": num(home) - num(away),
        "away_goal_diff": num(away) - num(home),
    }


def per_game_metrics() -> dict[str, Column]:
    """The ratios of a standings row."""
    played = F.col("played_games")
    return {
        "points_per_game": ratio(F.col("points"), played, 2),
        "win_percentage": ratio(F.col("won"), played, 1, scale=100),
        "goals_scored_per_game": ratio(F.col("goals_for"), played, 2),
        "goals_conceded_per_game": ratio(F.col("goals_against"), played, 2),
    }
