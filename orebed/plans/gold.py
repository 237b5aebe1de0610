"""Silver to gold: pure DataFrame functions, one per entity.

``compat`` takes the text columns as they are: scores compare and positions sort as text,
and an unplayed fixture counts as a draw. ``strict`` expects typed silver, compares and
sorts numbers, and leaves an unplayed fixture without a label.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orebed.functions.metrics import goal_metrics, num, outcome, per_game_metrics
from orebed.operators.flatten import stamp
from orebed.operators.running import running_total
from orebed.specs import COMPAT, LOADED_AT, MATCHES, STANDINGS, TEAMS, check_mode


def gold_teams(
    silver: DataFrame, batch_ts: datetime | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """Distinct team profiles, per league and season or whatever ``keep`` names. Stamped after
    the distinct, so that the stamp is no grouping key."""
    rows = silver.select(*TEAMS.gold_columns, *keep).distinct()
    return rows.select(*TEAMS.gold_columns, stamp(batch_ts).alias(LOADED_AT), *keep)


def gold_matches(
    silver: DataFrame, mode: str = COMPAT, batch_ts: datetime | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Fixtures with outcome and goal metrics. Shown scores default to zero; outcome and
    metrics are derived from the scores before that default."""
    zero = F.lit("0") if check_mode(mode) == COMPAT else F.lit(0).cast("bigint")
    home, away = F.col("home_score"), F.col("away_score")
    shown = {"home_score": F.coalesce(home, zero), "away_score": F.coalesce(away, zero)}
    derived = {"result": outcome(home, away, unknown_is_draw=mode == COMPAT)}
    derived |= goal_metrics(home, away)
    return silver.select(
        *[shown.get(c, F.col(c)).alias(c) for c in MATCHES.gold_columns],
        *[expression.alias(name) for name, expression in derived.items()],
        stamp(batch_ts).alias(LOADED_AT),
        *keep,
    )


def gold_standings(
    silver: DataFrame,
    batch_ts: datetime | None = None,
    group_by: Sequence[str] = ("group_name",),
) -> DataFrame:
    """Standings with per-game ratios and the group's running total of points. The totals
    are computed when this is called; ``silver`` should be a stored table.

    Position sorts by its type, so text and typed silver give text and numeric order.
    ``group_by`` names what a group is; columns beyond the contract come first.
    """
    extra = [c for c in group_by if c not in STANDINGS.columns]
    rows = silver.select(*extra, *STANDINGS.gold_columns)
    totalled = running_total(
        rows, num(F.col("points")), group_by, "position", "running_total_points"
    )
    metrics = per_game_metrics() | {"running_total_points": F.col("running_total_points")}
    return totalled.select(
        *extra,
        *STANDINGS.gold_columns,
        *[metrics[name].alias(name) for name, _ in STANDINGS.gold_metrics],
        stamp(batch_ts).alias(LOADED_AT),
    )
