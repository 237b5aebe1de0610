"""SQL counterparts of the registered queries, for DuckDB over the same tables.

``profiles``, ``contests``, ``standings`` and so on restate the test-table adapters in SQL.
Ratios are rounded through their shortest decimal text, because DuckDB rounds a double by
its binary value and so differs on decimal ties.
"""

from __future__ import annotations

from checks.queries import EARLY
from orebed.specs import INGESTED_AT, LOADED_AT, MATCHES, STANDINGS, TEAMS

MICROS = "'%Y-%m-%d %H:%M:%S.%f'"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(cte.strip() for cte in ctes) + "\n"


def _null_text(*names: str) -> str:
    return ", ".join(f"CAST(NULL AS VARCHAR) AS {name}" for name in names)


PROFILES = f"""
profiles AS (
    SELECT CAST(c_custkey AS VARCHAR) AS team_id, c_name AS team_name,
           c_mktsegment AS team_short_name, c_mktsegment AS team_stadium,
           n_name AS team_country, r_name AS team_location,
           {_null_text("team_founded", "team_colour_1", "team_colour_2", "team_website",
                       "team_logo", "team_badge")}
    FROM orders
    JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey
)"""

CONTESTS = f"""
contests AS (
    SELECT CAST(o_orderkey AS VARCHAR) AS match_id,
           strftime(any_value(o_orderdate), '%Y-%m-%d') AS match_date,
           CASE any_value(o_orderstatus)
               WHEN 'F' THEN 'FT' WHEN 'O' THEN 'NS' WHEN 'P' THEN 'LIVE' END AS match_status,
           CAST(CAST(sum(l_quantity) FILTER (l_linenumber % 2 = 1) AS BIGINT) AS VARCHAR)
               AS home_score,
           CAST(CAST(sum(l_quantity) FILTER (l_linenumber % 2 = 0) AS BIGINT) AS VARCHAR)
               AS away_score,
           CAST(any_value(o_custkey) AS VARCHAR) AS home_team_id,
           CAST((any_value(o_custkey) + 1) % (SELECT count(*) FROM customer) AS VARCHAR)
               AS away_team_id,
           {_null_text("match_name", "match_utc_timestamp", "match_time_utc", "venue_name",
                       "venue_country", "match_round", "home_team_name", "away_team_name",
                       "home_team_badge", "away_team_badge", "match_thumbnail",
                       "match_poster", "match_video_url")}
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey
    GROUP BY o_orderkey
)"""


def _standings(name: str, order_filter: str = "TRUE") -> str:
    return f"""
{name}_records AS (
    SELECT n_name, c_custkey, any_value(c_name) AS c_name, count(o_orderkey) AS played,
           count(*) FILTER (o_orderstatus = 'F') AS won,
           count(*) FILTER (o_orderstatus = 'P') AS drawn,
           count(*) FILTER (o_orderstatus = 'O') AS lost
    FROM customer
    JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN orders ON o_custkey = c_custkey AND {order_filter}
    GROUP BY n_name, c_custkey
),
{name} AS (
    SELECT n_name || '-' || CAST(c_custkey AS VARCHAR) AS standing_id,
           CAST(rank() OVER (PARTITION BY n_name ORDER BY 3 * won + drawn DESC) AS VARCHAR)
               AS position,
           CAST(c_custkey AS VARCHAR) AS team_id, c_name AS team_name, n_name AS group_name,
           CAST(played AS VARCHAR) AS played_games, CAST(won AS VARCHAR) AS won,
           CAST(drawn AS VARCHAR) AS drawn, CAST(lost AS VARCHAR) AS lost,
           CAST(2 * won + drawn AS VARCHAR) AS goals_for,
           CAST(2 * lost + drawn AS VARCHAR) AS goals_against,
           CAST(2 * won - 2 * lost AS VARCHAR) AS goal_difference,
           CAST(3 * won + drawn AS VARCHAR) AS points,
           {_null_text("team_badge", "recent_form")}
    FROM {name}_records
)"""


STANDING_ROWS = _standings("standings")
STANDING_ROWS_EARLY = _standings("standings", f"o_orderdate < TIMESTAMP '{EARLY}'")

SEASON_ROWS = f"""
records AS (
    SELECT CAST(year(o_orderdate) AS INTEGER) AS season, n_name, c_custkey,
           any_value(c_name) AS c_name, count(*) AS played,
           count(*) FILTER (o_orderstatus = 'F') AS won,
           count(*) FILTER (o_orderstatus = 'P') AS drawn,
           count(*) FILTER (o_orderstatus = 'O') AS lost
    FROM customer
    JOIN nation ON c_nationkey = n_nationkey
    JOIN orders ON o_custkey = c_custkey
    GROUP BY ALL
),
standings AS (
    SELECT season, n_name || '-' || CAST(c_custkey AS VARCHAR) AS standing_id,
           CAST(rank() OVER (PARTITION BY season, n_name ORDER BY 3 * won + drawn DESC)
               AS VARCHAR) AS position,
           CAST(c_custkey AS VARCHAR) AS team_id, c_name AS team_name, n_name AS group_name,
           CAST(played AS VARCHAR) AS played_games, CAST(won AS VARCHAR) AS won,
           CAST(drawn AS VARCHAR) AS drawn, CAST(lost AS VARCHAR) AS lost,
           CAST(2 * won + drawn AS VARCHAR) AS goals_for,
           CAST(2 * lost + drawn AS VARCHAR) AS goals_against,
           CAST(2 * won - 2 * lost AS VARCHAR) AS goal_difference,
           CAST(3 * won + drawn AS VARCHAR) AS points,
           {_null_text("team_badge", "recent_form")}
    FROM records
)"""


def _rounded(expression: str, digits: int) -> str:
    decimal = f"CAST(CAST({expression} AS VARCHAR) AS DECIMAL(38, 18))"
    return f"CAST(round({decimal}, {digits}) AS DOUBLE)"


def _number(text: str) -> str:
    return f"TRY_CAST({text} AS DOUBLE)"


def _quotient(part: str, whole: str) -> str:
    return f"{_number(part)} / nullif({_number(whole)}, 0)"


def _running(value: str, group: str, order: str) -> str:
    return (
        f"sum({value}) OVER (PARTITION BY {group} ORDER BY {order} NULLS FIRST "
        "RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    )


def _gold_standings(base: str, group: str = "group_name", order: str = "position") -> str:
    return f"""
    SELECT {base},
           {_rounded(_quotient("points", "played_games"), 2)} AS points_per_game,
           {_rounded(_quotient("won", "played_games") + " * 100", 1)} AS win_percentage,
           {_rounded(_quotient("goals_for", "played_games"), 2)} AS goals_scored_per_game,
           {_rounded(_quotient("goals_against", "played_games"), 2)} AS goals_conceded_per_game,
           CAST({_running(_number("points"), group, order)} AS DOUBLE) AS running_total_points
    FROM standings"""


STANDING_BASE = ", ".join(STANDINGS.gold_columns)
STANDING_BASE_TYPED = ", ".join(
    f"TRY_CAST({f.column} AS BIGINT) AS {f.column}" if f.strict_type == "bigint" else f.column
    for f in STANDINGS.fields
)
GOLD_STANDINGS = _gold_standings(STANDING_BASE)
GOLD_STANDINGS_TYPED = _gold_standings(
    STANDING_BASE_TYPED, order="CAST(standings.position AS BIGINT)"
)

MATCH_METRICS = f"""
    {_number("home_score")} + {_number("away_score")} AS total_goals,
    {_number("home_score")} - {_number("away_score")} AS home_goal_diff,
    {_number("away_score")} - {_number("home_score")} AS away_goal_diff"""

def _landed_lines(spec, rows: str, name: str, key: str) -> str:
    """The text of every row's payload line, by its digest."""
    fields = ", ".join(f"""'"{f.raw}":"' || {f.column} || '"'""" for f in spec.fields)
    line = f"""'{{"{spec.array}":[{{' || concat_ws(',', {fields}) || '}}]}}'"""
    return f"""
        SELECT '{name}' AS entity, {key} AS id, sha256({line}) AS line_sha256,
               count(*) AS lines, true AS traced
        FROM {rows} GROUP BY ALL"""


GOLD_MATCHES = f"""
    SELECT match_id, match_date, match_time_utc, match_status, venue_name, venue_country,
           match_round, home_team_id, home_team_name, coalesce(home_score, '0') AS home_score,
           away_team_id, away_team_name, coalesce(away_score, '0') AS away_score,
           home_team_badge, away_team_badge,
           CASE WHEN home_score > away_score THEN 'Home Win'
                WHEN home_score < away_score THEN 'Away Win' ELSE 'Draw' END AS result,
           {MATCH_METRICS}
    FROM contests"""

GOLD_MATCHES_STRICT = f"""
    SELECT match_id, match_date, match_time_utc, match_status,
           venue_name, venue_country, TRY_CAST(match_round AS BIGINT) AS match_round,
           home_team_id, home_team_name,
           coalesce(TRY_CAST(home_score AS BIGINT), 0) AS home_score,
           away_team_id, away_team_name,
           coalesce(TRY_CAST(away_score AS BIGINT), 0) AS away_score,
           home_team_badge, away_team_badge,
           CASE WHEN CAST(home_score AS BIGINT) > CAST(away_score AS BIGINT) THEN 'Home Win'
                WHEN CAST(home_score AS BIGINT) < CAST(away_score AS BIGINT) THEN 'Away Win'
                WHEN CAST(home_score AS BIGINT) = CAST(away_score AS BIGINT) THEN 'Draw'
           END AS result,
           {MATCH_METRICS}
    FROM contests"""

GOLD_TEAMS_TYPED = "SELECT DISTINCT team_id, team_name FROM profiles"
GOLD_TEAMS = f"SELECT DISTINCT {', '.join(TEAMS.gold_columns)} FROM profiles"

TEXT_METRICS = f"""
WITH scored AS (
    SELECT l_orderkey, l_linenumber, l_partkey,
           CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F'
                    THEN ' ' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ' '
                WHEN l_returnflag <> 'R' THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)
                WHEN l_linestatus = 'F' THEN 'x' END AS home,
           CASE WHEN l_returnflag = 'R' THEN ''
                WHEN l_linestatus = 'O' THEN CAST(l_linenumber AS VARCHAR) ELSE '0' END AS away
    FROM lineitem
)
SELECT *, {_number("home")} + {_number("away")} AS total_goals,
       {_number("home")} - {_number("away")} AS home_goal_diff,
       {_number("away")} - {_number("home")} AS away_goal_diff,
       CASE WHEN home > away THEN 'Home Win' WHEN home < away THEN 'Away Win'
            ELSE 'Draw' END AS result,
       CASE WHEN {_number("home")} > {_number("away")} THEN 'Home Win'
            WHEN {_number("home")} < {_number("away")} THEN 'Away Win'
            WHEN {_number("home")} = {_number("away")} THEN 'Draw' END AS result_if_known,
       {_rounded(_quotient("home", "away"), 2)} AS share,
       {_rounded(_quotient("away", "home") + " * 100", 1)} AS share_percent
FROM scored"""

MIXED = """
mixed AS (
    SELECT c_custkey, c_name,
           '{"idTeam":"' || c_custkey || '","strTeam":"' || c_name || '"}' AS team,
           CASE c_mktsegment
               WHEN 'AUTOMOBILE' THEN '{"teams":[' || team || ']}'
               WHEN 'BUILDING' THEN
                   CASE WHEN c_acctbal < 0 THEN '{"teams":[]}' ELSE '{"teams":null}' END
               WHEN 'FURNITURE' THEN
                   CASE WHEN c_acctbal < 0 THEN '{"teams":"No data"}'
                   ELSE '{"message":"no such id","code":0,"id":"' || c_name || '"}' END
               WHEN 'HOUSEHOLD' THEN
                   CASE WHEN c_acctbal < 0 THEN CAST(c_custkey AS VARCHAR)
                   ELSE '[' || team || ']' END
               WHEN 'MACHINERY' THEN
                   CASE WHEN c_acctbal < 0 THEN '{"teams":[' || team
                   ELSE '{"teams":{},"count":0,"error":"","more":false}' END
           END AS line
    FROM customer
),
parsed AS (
    SELECT c_custkey, c_name, CASE WHEN json_valid(line) THEN CAST(line AS JSON) END AS doc
    FROM mixed
),
landed AS (
    SELECT *, json_type(doc, '$.teams') = 'ARRAY' AS is_array
    FROM parsed
    WHERE json_type(doc) = 'OBJECT'
      AND len(list_filter(json_keys(doc), lambda k: CAST(json_extract(doc, '$.' || k) AS VARCHAR)
              NOT IN ('null', 'false', '""', '[]', '{}', '0'))) > 0
)"""

# Columns and types that the published tables are to have.
CONTRACTS = {
    "silver_teams": """
        team_id string, team_name string, team_short_name string, team_founded string,
        team_colour_1 string, team_colour_2 string, team_stadium string, team_location string,
        team_website string, team_logo string, team_badge string, team_country string,
        ingested_at timestamp
    """,
    "gold_teams": """
        team_id string, team_name string, team_short_name string, team_founded string,
        team_country string, team_stadium string, team_location string, team_badge string,
        team_logo string, gold_loaded_at timestamp
    """,
    "silver_standings": """
        standing_id string, position string, team_id string, team_name string, team_badge
        string, played_games string, won string, drawn string, lost string, goals_for string,
        goals_against string, goal_difference string, points string, recent_form string,
        group_name string, ingested_at timestamp
    """,
    "gold_standings": """
        standing_id string, position string, team_id string, team_name string, team_badge
        string, group_name string, played_games string, won string, drawn string, lost string,
        goals_for string, goals_against string, goal_difference string, points string,
        recent_form string, points_per_game double, win_percentage double, goals_scored_per_game
        double, goals_conceded_per_game double, running_total_points double, gold_loaded_at
        timestamp
    """,
    "silver_matches": """
        match_id string, match_name string, match_date string, match_utc_timestamp string,
        match_time_utc string, match_status string, venue_name string, venue_country string,
        match_round string, home_team_id string, home_team_name string, home_score string,
        away_team_id string, away_team_name string, away_score string, home_team_badge string,
        away_team_badge string, match_thumbnail string, match_poster string, match_video_url
        string, ingested_at timestamp
    """,
    "gold_matches": """
        match_id string, match_date string, match_time_utc string, match_status string,
        venue_name string, venue_country string, match_round string, home_team_id string,
        home_team_name string, home_score string, away_team_id string, away_team_name string,
        away_score string, home_team_badge string, away_team_badge string, result string,
        total_goals double, home_goal_diff double, away_goal_diff double, gold_loaded_at
        timestamp
    """,
}

# Values per column of the published tables: all columns of a table in one pass.
_STAMPED = {
    "silver_teams": ("SELECT *, 1 AS {} FROM profiles", INGESTED_AT),
    "silver_standings": ("SELECT *, 1 AS {} FROM standings", INGESTED_AT),
    "silver_matches": ("SELECT *, 1 AS {} FROM contests", INGESTED_AT),
    "gold_teams": (f"SELECT *, 1 AS {{}} FROM ({GOLD_TEAMS})", LOADED_AT),
    "gold_standings": (f"SELECT *, 1 AS {{}} FROM ({GOLD_STANDINGS})", LOADED_AT),
    "gold_matches": (f"SELECT *, 1 AS {{}} FROM ({GOLD_MATCHES})", LOADED_AT),
}


def _contract_rows() -> str:
    parts = []
    for label, (source, stamp_column) in _STAMPED.items():
        fields = [field.split() for field in CONTRACTS[label].split(",")]
        counted = source.format(stamp_column)
        columns = ", ".join(f"count({name}) AS {name}" for name, _ in fields)
        declared = ", ".join(
            f"({position}, '{name}', '{kind}')"
            for position, (name, kind) in enumerate(fields, start=1)
        )
        parts.append(f"""
    SELECT '{label}' AS table_name, CAST(position AS INTEGER) AS position, column_name,
           declared, declared AS actual, 'ok' AS status, non_null
    FROM (UNPIVOT (SELECT {columns} FROM ({counted})) ON COLUMNS(*)
          INTO NAME column_name VALUE non_null)
    JOIN (VALUES {declared}) AS v(position, column_name, declared) USING (column_name)""")
    odd = (
        (1, "standing_id", "'string'", "NULL", "missing", "NULL"),
        (2, "position", "'string'", "'bigint'", "wrong type", "count(position)"),
        (3, "team_id", "'string'", "'string'", "wrong order", "count(team_id)"),
        (4, "team_name", "'string'", "'string'", "wrong order", "count(team_name)"),
        (5, "points", "NULL", "'string'", "extra", "count(points)"),
    )
    for position, column, declared, actual, status, count in odd:
        parts.append(f"""
    SELECT 'odd', {position}, '{column}', {declared}, {actual}, '{status}', {count} FROM standings
    {"LIMIT 1" if count == "NULL" else ""}""")
    return "\nUNION ALL\n".join(f"({part})" for part in parts)


def _quality_rows() -> str:
    layers = [
        ("teams", "profiles", TEAMS.required, ()),
        ("standings", "standings", STANDINGS.required, ()),
        ("matches", "contests", MATCHES.required, ()),
        ("matches_abandoned", "(SELECT * FROM contests WHERE match_status = 'ABANDONED')",
         MATCHES.required, ()),
        ("standings_no_points", "standings", STANDINGS.required, ("points",)),
    ]
    parts = [
        "SELECT 'matches_absent' AS entity, 'files' AS check_name, 0 AS observed, "
        "'no files' AS problem",
        "SELECT 'standings_torn', 'files', 1, 'files of different types'",
    ]
    for name, source, required, absent in layers:
        parts.append(f"SELECT '{name}', 'files', 1, NULL")
        parts.append(
            f"SELECT '{name}', 'rows', count(*), if(count(*) = 0, 'no rows', NULL) FROM {source}"
        )
        for column in required:
            counted = f"count({column}), if(count({column}) = 0, 'no values', NULL)"
            if column in absent:
                counted = "0, 'no such column'"
            parts.append(f"SELECT '{name}', 'column {column}', {counted} FROM {source}")
            if column in absent:
                parts[-1] += " LIMIT 1"
    return " UNION ALL ".join(f"({part})" for part in parts)


def _rerun_rows() -> str:
    sources = {
        "silver_teams": "profiles",
        "silver_standings": "standings",
        "silver_matches": "contests",
        "gold_teams": f"({GOLD_TEAMS})",
        "gold_standings": "standings",
        "gold_matches": "contests",
    }
    return " UNION ALL ".join(
        f"SELECT '{label}' AS table_name, count(*) AS rows_first, count(*) AS rows_second, "
        "CAST(0 AS BIGINT) AS rows_changed, count(*) AS rows_after_failure, FALSE AS moved "
        f"FROM {source}"
        for label, source in sources.items()
    )


ORACLE = {
    "bronze_roundtrip": f"""
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
               l_discount, l_tax, l_returnflag, l_linestatus, strftime(l_shipdate, {MICROS}) AS l_shipdate
        FROM lineitem""",
    "explode_drops_empty": """
        SELECT CAST(o_orderkey AS VARCHAR) AS order_key, 'placed' AS step
        FROM orders WHERE o_orderstatus = 'F'
        UNION ALL
        SELECT CASE WHEN o_orderpriority <> '1-URGENT' THEN CAST(o_orderkey AS VARCHAR) END,
               CASE WHEN o_orderpriority <> '1-URGENT' THEN 'finished' END
        FROM orders WHERE o_orderstatus = 'F'""",
    "payload_guard": _with(MIXED) + """
        SELECT c_custkey, coalesce(is_array, FALSE) AS has_array,
               CASE WHEN is_array THEN CAST(json_array_length(doc, '$.teams') AS BIGINT)
                    ELSE CAST(0 AS BIGINT) END AS elements
        FROM landed""",
    "payload_guard_silver": _with(MIXED) + """
        SELECT CAST(c_custkey AS VARCHAR) AS team_id, c_name AS team_name
        FROM landed WHERE is_array""",
    "silver_teams": _with(PROFILES) + "SELECT * FROM profiles",
    "silver_standings": _with(STANDING_ROWS) + "SELECT * FROM standings",
    "silver_matches": _with(CONTESTS) + "SELECT * FROM contests",
    "silver_matches_strict": _with(CONTESTS) + """
        SELECT match_id, match_date, match_status, home_team_id,
               CAST(home_score AS BIGINT) AS home_score, away_team_id,
               CAST(away_score AS BIGINT) AS away_score, TRUE AS traced
        FROM contests""",
    "gold_teams": _with(PROFILES) + GOLD_TEAMS,
    "gold_matches": _with(CONTESTS) + GOLD_MATCHES,
    "gold_matches_strict": _with(CONTESTS) + GOLD_MATCHES_STRICT,
    "gold_standings": _with(STANDING_ROWS) + GOLD_STANDINGS,
    "gold_standings_strict": _with(STANDING_ROWS)
    + _gold_standings(STANDING_BASE_TYPED, order="CAST(standings.position AS BIGINT)"),
    "gold_standings_early": _with(STANDING_ROWS_EARLY) + GOLD_STANDINGS,
    "text_metrics": TEXT_METRICS,
    "running_total_text_order": _with(STANDING_ROWS) + f"""
        SELECT standing_id, group_name, position, points,
               {_running(_number("points"), "group_name", "position")} AS running_total
        FROM standings""",
    "running_total_range": _with(STANDING_ROWS) + f"""
        SELECT standing_id, group_name, CAST(position AS BIGINT) AS position, points,
               {_running(_number("points"), "group_name", "CAST(standings.position AS BIGINT)")}
                   AS running_total
        FROM standings""",
    "running_total_skewsafe": f"""
        SELECT l_returnflag, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS shipped, l_orderkey,
               l_linenumber, l_partkey, l_quantity,
               {_running("l_quantity", "l_returnflag", "CAST(l_shipdate AS DATE)")}
                   AS running_quantity
        FROM lineitem""",
    "latest_finished": _with(CONTESTS) + f"""
        SELECT match_id, match_date, home_team_name, away_team_name, home_score, away_score,
               total_goals, result
        FROM ({GOLD_MATCHES})
        WHERE match_status = 'FT' ORDER BY match_date DESC, match_id LIMIT 20""",
    "finished_in_year": _with(CONTESTS) + f"""
        SELECT match_id, match_date, CAST(left(match_date, 4) AS INTEGER) AS match_year,
               home_score, away_score, result
        FROM ({GOLD_MATCHES}) WHERE match_status = 'FT' AND left(match_date, 4) = '1997'""",
    "group_report": _with(STANDING_ROWS) + f"""
        SELECT group_name, position, team_name, points, running_total_points, points_per_game
        FROM ({GOLD_STANDINGS}) ORDER BY group_name, position, standing_id""",
    "team_performance": _with(PROFILES, STANDING_ROWS) + f"""
        SELECT t.team_id, t.team_name, s.played_games AS total_matches, s.won AS total_wins,
               s.win_percentage, s.position AS final_rank
        FROM ({GOLD_TEAMS}) t LEFT JOIN ({GOLD_STANDINGS}) s USING (team_id)
        ORDER BY s.position NULLS FIRST, t.team_id NULLS FIRST, s.standing_id NULLS FIRST
        LIMIT 10""",
    "quality_report": _with(PROFILES, STANDING_ROWS, CONTESTS) + f"""
        SELECT entity, check_name, CAST(observed AS BIGINT) AS observed,
               problem IS NULL AS passed, problem
        FROM ({_quality_rows()})""",
    "contract_report": _with(PROFILES, STANDING_ROWS, CONTESTS) + _contract_rows(),
    "medallion_rerun": _with(PROFILES, STANDING_ROWS, CONTESTS) + _rerun_rows(),
    "merge_latest_events": f"""
        SELECT event_id, strftime(ts, {MICROS}) AS ts, user_id, event_type, value, props
        FROM events
        QUALIFY row_number() OVER (
            PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""",
    "merge_into_partitions": f"""
        SELECT event_id, strftime(ts, {MICROS}) AS ts, user_id, kind AS event_type, value, props
        FROM (SELECT *, CASE WHEN user_id % 10 <> 0 THEN event_type END AS kind FROM events)
        WHERE ts < TIMESTAMP '2024-01-16' OR kind = 'click' OR kind IS NULL
        QUALIFY row_number() OVER (
            PARTITION BY user_id, kind ORDER BY ts DESC, event_id DESC) = 1""",
    "running_total_incremental": """
        SELECT l_returnflag, CAST(shipped AS VARCHAR) AS shipped, rows, own,
               sum(own) OVER (PARTITION BY l_returnflag ORDER BY shipped) AS running_quantity
        FROM (
            SELECT l_returnflag, CAST(l_shipdate AS DATE) AS shipped, count(*) AS rows,
                   sum(l_quantity) AS own
            FROM lineitem WHERE day(l_shipdate) <> 15 GROUP BY ALL
        )""",
    "split_matches": _with(CONTESTS) + "SELECT *, true AS short FROM contests",
    "gold_lineage": _with(PROFILES, STANDING_ROWS, CONTESTS) + " UNION ALL ".join(
        (
            _landed_lines(TEAMS, "profiles", "teams", "team_id"),
            _landed_lines(STANDINGS, "standings", "standings", "standing_id"),
            _landed_lines(MATCHES, "contests", "matches", "match_id"),
        )
    ),
    "refresh_published_matches": _with(CONTESTS)
    + f"SELECT *, left(match_date, 4) AS season FROM ({GOLD_MATCHES})",
    "gold_file_order": _with(STANDING_ROWS) + """
        SELECT count(*) AS rows, CAST(0 AS BIGINT) AS unsorted, CAST(0 AS BIGINT) AS overlapping
        FROM standings""",
    "merge_into_state": f"""
        SELECT event_id, strftime(ts, {MICROS}) AS ts, user_id, event_type, value, props
        FROM events
        QUALIFY row_number() OVER (
            PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""",
    "stream_latest_matches": _with(CONTESTS) + """
        SELECT * EXCLUDE (id) REPLACE (
            CASE WHEN id % 3 = 0 THEN match_status WHEN id % 2 = 0 THEN 'HT' ELSE 'NS' END
                AS match_status,
            CASE WHEN id % 3 = 0 OR id % 2 = 0 THEN home_score END AS home_score,
            CASE WHEN id % 3 = 0 THEN away_score END AS away_score
        )
        FROM (SELECT *, CAST(match_id AS BIGINT) AS id FROM contests)""",
    "stream_dead_letters": """
        SELECT CASE c_mktsegment WHEN 'MACHINERY' THEN 'broken line'
                   WHEN 'BUILDING' THEN 'line without array'
                   WHEN 'HOUSEHOLD' THEN 'row without key' ELSE 'kept' END AS reason,
               CASE c_mktsegment WHEN 'BUILDING' THEN NULL WHEN 'MACHINERY' THEN
                   nullif(regexp_extract(
                       left('{"teams":[{"idTeam":"' || c_custkey || '","strTeam":"x"}]}', 20),
                       '"(?:idTeam|strTeam)":"([0-9]+)', 1), '')
               ELSE CAST(c_custkey AS VARCHAR) END AS team_id
        FROM customer""",
    "partition_overwrite": """
        SELECT o_orderkey, o_custkey, CAST(year(o_orderdate) AS INTEGER) AS order_year,
               CASE WHEN year(o_orderdate) = 1997 THEN 'R' ELSE o_orderstatus END AS o_orderstatus
        FROM orders""",
    "consolidate_seasons": _with(SEASON_ROWS)
    + _gold_standings(
        "league, season, " + STANDING_BASE, group="league, season, group_name"
    ).replace("FROM standings", "FROM (SELECT *, CAST(CAST(team_id AS BIGINT) % 2 AS VARCHAR) "
              "AS league FROM standings) AS standings"),
    "latest_finished_in_season": _with(CONTESTS) + f"""
        SELECT match_id, match_date, home_team_name, away_team_name, home_score, away_score,
               total_goals, result
        FROM ({GOLD_MATCHES})
        WHERE match_status = 'FT' AND left(match_date, 4) = '1997'
            AND CAST(home_team_id AS BIGINT) % 2 = 1
        ORDER BY match_date DESC, match_id LIMIT 20""",
    "stream_dedup": f"""
        SELECT event_id, strftime(ts, {MICROS}) AS ts, user_id, event_type, value, props
        FROM events""",
    "stream_silver_matches": _with(CONTESTS) + """
        SELECT * FROM contests WHERE match_status <> 'LIVE'
        UNION ALL BY NAME
        SELECT DISTINCT * REPLACE (CAST(NULL AS VARCHAR) AS match_id)
        FROM contests WHERE match_status = 'LIVE'""",
    "team_performance_strict": _with(PROFILES, STANDING_ROWS) + f"""
        SELECT t.team_id, t.team_name, s.played_games AS total_matches, s.won AS total_wins,
               s.win_percentage, s.position AS final_rank
        FROM ({GOLD_TEAMS_TYPED}) t LEFT JOIN ({GOLD_STANDINGS_TYPED}) s USING (team_id)
        ORDER BY s.position NULLS FIRST, t.team_id NULLS FIRST, s.standing_id NULLS FIRST
        LIMIT 10""",
    "group_report_strict": _with(STANDING_ROWS) + f"""
        SELECT group_name, position, team_name, points, running_total_points, points_per_game
        FROM ({GOLD_STANDINGS_TYPED}) ORDER BY group_name, position, standing_id""",
    "bronze_counts": """
        WITH customers AS (SELECT c_mktsegment AS segment FROM customer),
        counts AS (
            SELECT count(*) AS lines,
                   count(*) FILTER (segment = 'MACHINERY') AS broken,
                   count(*) FILTER (segment = 'BUILDING') AS without_array,
                   count(*) FILTER (segment = 'FURNITURE') AS lost,
                   count(*) FILTER (segment IN ('AUTOMOBILE', 'FURNITURE', 'HOUSEHOLD')) AS kept
            FROM customers
        )
        SELECT 'lines' AS check_name, lines AS observed FROM counts
        UNION ALL SELECT 'broken lines', broken FROM counts
        UNION ALL SELECT 'lines without array', without_array FROM counts
        UNION ALL SELECT 'lost values', lost FROM counts
        UNION ALL SELECT 'rows', kept FROM counts
        UNION ALL SELECT 'column team_id', kept FROM counts
        UNION ALL SELECT 'column team_name', 0 FROM counts
        UNION ALL SELECT 'years', kept - lost FROM counts""",
}
