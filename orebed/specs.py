"""Entities, their columns and the contracts of their tables.

An entity is declared once, as text; read schemas, projections, table contracts and
required columns all follow from that declaration.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql.types import (
    ArrayType,
    DateType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
    TimestampType,
)

COMPAT = "compat"
STRICT = "strict"

INGESTED_AT = "ingested_at"
LOADED_AT = "gold_loaded_at"
SOURCE_FILE = "source_file"

TYPES = {
    "string": StringType(),
    "bigint": LongType(),
    "double": DoubleType(),
    "date": DateType(),
    "timestamp": TimestampType(),
    "timestamp_ntz": TimestampNTZType(),
}

# Payload field, column, and the type the column has in strict mode.
TEAM_FIELDS = """
idTeam            team_id              string
strTeam           team_name            string
strTeamShort      team_short_name      string
intFormedYear     team_founded         bigint
strColour1        team_colour_1        string
strColour2        team_colour_2        string
strStadium        team_stadium         string
strLocation       team_location        string
strWebsite        team_website         string
strLogo           team_logo            string
strBadge          team_badge           string
strCountry        team_country         string
"""

STANDING_FIELDS = """
idStanding        standing_id          string
intRank           position             bigint
idTeam            team_id              string
strTeam           team_name            string
strBadge          team_badge           string
intPlayed         played_games         bigint
intWin            won                  bigint
intDraw           drawn                bigint
intLoss           lost                 bigint
intGoalsFor       goals_for            bigint
intGoalsAgainst   goals_against        bigint
intGoalDifference goal_difference      bigint
intPoints         points               bigint
strForm           recent_form          string
strDescription    group_name           string
"""

MATCH_FIELDS = """
idEvent           match_id             string
strEvent          match_name           string
dateEvent         match_date           date
strTimestamp      match_utc_timestamp  timestamp_ntz
strTime           match_time_utc       string
strStatus         match_status         string
strVenue          venue_name           string
strCountry        venue_country        string
intRound          match_round          bigint
idHomeTeam        home_team_id         string
strHomeTeam       home_team_name       string
intHomeScore      home_score           bigint
idAwayTeam        away_team_id         string
strAwayTeam       away_team_name       string
intAwayScore      away_score           bigint
strHomeTeamBadge  home_team_badge      string
strAwayTeamBadge  away_team_badge      string
strThumb          match_thumbnail      string
strPoster         match_poster         string
strVideo          match_video_url      string
"""

# Gold columns taken over from silver, in contract order.
GOLD_TEAM_COLUMNS = """
team_id team_name team_short_name team_founded team_country
team_stadium team_location team_badge team_logo
"""

GOLD_STANDING_COLUMNS = """
standing_id position team_id team_name team_badge group_name played_games won drawn lost
goals_for goals_against goal_difference points recent_form
"""

GOLD_MATCH_COLUMNS = """
match_id match_date match_time_utc match_status venue_name venue_country match_round
home_team_id home_team_name home_score away_team_id away_team_name away_score
home_team_badge away_team_badge
"""

# Derived gold columns, in contract order.
STANDING_METRICS = """
points_per_game          double
win_percentage           double
goals_scored_per_game    double
goals_conceded_per_game  double
running_total_points     double
"""

MATCH_METRICS = """
result                   string
total_goals              double
home_goal_diff           double
away_goal_diff           double
"""


def check_mode(mode: str) -> str:
    if mode not in (COMPAT, STRICT):
        raise ValueError(f"mode must be {COMPAT!r} or {STRICT!r}, got {mode!r}")
    return mode


@dataclass(frozen=True)
class Field:
    """One payload field and the column it becomes."""

    raw: str
    column: str
    strict_type: str

    def type_in(self, mode: str) -> str:
        return self.strict_type if mode == STRICT else "string"


def _lines(text: str) -> list[list[str]]:
    return [line.split() for line in text.strip().splitlines()]


def _contract(columns: Iterable[tuple[str, str]]) -> StructType:
    return StructType([StructField(name, TYPES[kind]) for name, kind in columns])


@dataclass(frozen=True)
class EntitySpec:
    """Everything the layers need to know about one entity."""

    name: str
    array: str
    fields: tuple[Field, ...]
    gold_columns: tuple[str, ...]
    gold_metrics: tuple[tuple[str, str], ...]
    required: tuple[str, ...]

    @property
    def columns(self) -> list[str]:
        return [f.column for f in self.fields]

    def pick(self, columns: Iterable[str] | None = None) -> list[Field]:
        """The fields behind ``columns``, in declaration order; all of them by default."""
        if columns is None:
            return list(self.fields)
        wanted = set(columns)
        unknown = wanted - set(self.columns)
        if unknown:
            raise ValueError(f"{self.name} has no column {sorted(unknown)}")
        return [f for f in self.fields if f.column in wanted]

    def raw_schema(self, columns: Iterable[str] | None = None) -> StructType:
        """Read schema of the payload. JSON scans prune nothing after an explode by
        themselves, so callers that need few columns ask for few fields here."""
        element = StructType([StructField(f.raw, StringType()) for f in self.pick(columns)])
        return StructType([StructField(self.array, ArrayType(element))])

    def silver_contract(self, mode: str = COMPAT) -> StructType:
        columns = [(f.column, f.type_in(check_mode(mode))) for f in self.fields]
        columns.append((INGESTED_AT, "timestamp"))
        if mode == STRICT:
            columns.append((SOURCE_FILE, "string"))
        return _contract(columns)

    def gold_contract(self, mode: str = COMPAT) -> StructType:
        types = {f.column: f.type_in(check_mode(mode)) for f in self.fields}
        base = [(c, types[c]) for c in self.gold_columns]
        return _contract([*base, *self.gold_metrics, (LOADED_AT, "timestamp")])


def entity(
    name: str, array: str, fields: str, gold_columns: str, gold_metrics: str, required: str
) -> EntitySpec:
    """Declare an entity from its text tables."""
    return EntitySpec(
        name=name,
        array=array,
        fields=tuple(Field(*line) for line in _lines(fields)),
        gold_columns=tuple(gold_columns.split()),
        gold_metrics=tuple((column, kind) for column, kind in _lines(gold_metrics)),
        required=tuple(required.split()),
    )


TEAMS = entity(
    "teams", "teams", TEAM_FIELDS, GOLD_TEAM_COLUMNS, "", "team_id team_name"
)
STANDINGS = entity(
    "standings", "table", STANDING_FIELDS, GOLD_STANDING_COLUMNS, STANDING_METRICS,
    "standing_id team_id points",
)
MATCHES = entity(
    "matches", "events", MATCH_FIELDS, GOLD_MATCH_COLUMNS, MATCH_METRICS,
    "match_id home_team_id away_team_id",
)

ENTITIES = {spec.name: spec for spec in (TEAMS, STANDINGS, MATCHES)}


@dataclass(frozen=True)
class Layout:
    """Where the layers live: plain URIs under one root, one folder per run."""

    root: str

    def bronze(self, entity_name: str, **folders: str) -> str:
        """An entity's payloads; those of one ``league`` and ``season``, in that order, if given.
        A run over the folder above takes all of them."""
        below = "".join(f"/{name}={value}" for name, value in folders.items())
        return f"{self.root}/bronze/{entity_name}{below}"

    def runs(self, layer: str, entity_name: str) -> str:
        return f"{self.root}/{layer}/{entity_name}"

    def layer(self, layer: str, entity_name: str, run_id: str) -> str:
        return f"{self.runs(layer, entity_name)}/run={run_id}"


def contract_to_dict(contract: StructType) -> dict:
    """A contract as plain data that ``json.dumps`` accepts."""
    return contract.jsonValue()


def contract_from_dict(data: dict) -> StructType:
    return StructType.fromJson(data)
