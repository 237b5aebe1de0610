"""Registered queries: (spark, folder of test tables) -> DataFrame."""

from __future__ import annotations

import json
from datetime import datetime
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orebed import fixtures
from orebed.fixtures import payload_batches, table
from orebed.functions.metrics import goal_metrics, num, outcome, ratio, whole
from orebed.operators.flatten import flatten, has_array
from orebed.operators.merge import consolidate, latest_per_key, merge_latest
from orebed.operators.merge import merge_into_partitions as merge_partitions
from orebed.operators.quality import QualityError
from orebed.operators.quality import quality_report as build_quality_report
from orebed.operators.running import running_total
from orebed.operators.state import create_state
from orebed.operators.state import merge_into_state as merge_state
from orebed.operators.totals import build_totals, read_totals, update_totals
from orebed.plans import reports
from orebed.plans.gold import gold_matches as build_gold_matches
from orebed.plans.gold import gold_standings as build_gold_standings
from orebed.plans.gold import gold_teams as build_gold_teams
from orebed.plans.incremental import refresh_from_stream
from orebed.plans.lineage import trace
from orebed.plans.medallion import bronze_to_silver, run_medallion
from orebed.session import materialize, new_workspace, side_by_side
from orebed.sources.bronze import (
    keep_payloads,
    land_lines,
    land_payloads,
    land_rows,
    payload_rows,
    read_bronze,
    to_lines,
)
from orebed.sources.layers import (
    POINTER,
    cluster,
    location_of,
    overwrite_partitions,
    point,
    publish,
    read_layer,
    write_layer,
)
from orebed.sources.layers import contract_report as build_contract_report
from orebed.sources.partitions import create_partitioned, replace_partitions
from orebed.specs import (
    ENTITIES,
    LOADED_AT,
    MATCHES,
    SOURCE_FILE,
    STANDINGS,
    STRICT,
    TEAMS,
    EntitySpec,
    Layout,
    contract_from_dict,
    contract_to_dict,
)
from orebed.sources.split import split_payloads
from orebed.streaming.dedupe import (
    append_available,
    dedupe_stream,
    stream_bronze,
    stream_layer,
)
from orebed.streaming.upsert import (
    LANDED_AT,
    read_dead_letters,
    state_schema,
    stream_lines,
    upsert_available,
)

BATCH_TS = datetime(2026, 1, 1)
EARLY = "1995-07-01"
MICROS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _through_bronze(spark: SparkSession, rows: DataFrame, spec: EntitySpec) -> DataFrame:
    """Land rows as payloads and open the bronze folder."""
    path = new_workspace(spark, f"bronze-{spec.name}")
    land_payloads(fixtures.payloads(rows, spec), path)
    return read_bronze(spark, spec, path)


# Bronze


def bronze_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items into payload arrays, to JSON lines, back, exploded and cast."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", F.date_format("l_shipdate", MICROS).alias("l_shipdate"),
    )
    path = new_workspace(spark, "bronze-lines")
    land_payloads(payload_batches(lines, "lines"), path)
    element = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in lines.schema.fields)
    bronze = spark.read.schema(f"lines ARRAY<STRUCT<{element}>>").json(path)
    return bronze.select(F.explode("lines").alias("line")).select("line.*")


def explode_drops_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One payload per order: two steps if finished, the second NULL if urgent; an empty
    array if open; no array otherwise. Only array elements become rows."""
    status = F.col("o_orderstatus")
    step = "struct<order_key: string, step: string>"

    def reached(name: str) -> Column:
        return F.struct(
            F.col("o_orderkey").cast("string").alias("order_key"), F.lit(name).alias("step")
        )

    finished = F.when(F.col("o_orderpriority") != "1-URGENT", reached("finished"))
    steps = (
        F.when(status == "F", F.array(reached("placed"), finished))
        .when(status == "O", F.array().cast(f"array<{step}>"))
        .alias("steps")
    )
    lines = to_lines(table(spark, sf_dir, "orders").select(steps))
    # Written without the payload filter: the explode itself has to drop these.
    path = new_workspace(spark, "bronze-steps")
    lines.write.text(path)
    bronze = spark.read.schema(f"steps ARRAY<{step}>").json(path)
    return bronze.select(F.explode("steps").alias("s")).select("s.order_key", "s.step")


def _mixed_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line per customer; the kind of payload follows segment and balance."""
    in_debt = F.col("c_acctbal") < 0
    team = F.format_string(
        '{"idTeam":"%d","strTeam":"%s"}', F.col("c_custkey"), F.col("c_name")
    )
    by_segment = {
        "AUTOMOBILE": F.concat(F.lit('{"teams":['), team, F.lit("]}")),
        "BUILDING": F.when(in_debt, F.lit('{"teams":[]}')).otherwise(F.lit('{"teams":null}')),
        "FURNITURE": F.when(in_debt, F.lit('{"teams":"No data"}')).otherwise(
            F.concat(F.lit('{"message":"no such id","code":0,"id":"'), F.col("c_name"), F.lit('"}'))
        ),
        "HOUSEHOLD": F.when(in_debt, F.col("c_custkey").cast("string")).otherwise(
            F.concat(F.lit("["), team, F.lit("]"))
        ),
        "MACHINERY": F.when(in_debt, F.concat(F.lit('{"teams":['), team)).otherwise(
            F.lit('{"teams":{},"count":0,"error":"","more":false}')
        ),
    }
    line = F.lit(None).cast("string")
    for segment, payload in by_segment.items():
        line = F.when(F.col("c_mktsegment") == segment, payload).otherwise(line)
    return table(spark, sf_dir, "customer").select("c_custkey", line.alias("value"))


def payload_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which payloads are landed, and how many rows each gives once flattened."""
    lines = _mixed_payloads(spark, sf_dir)
    kept = keep_payloads(lines)
    parsed = kept.select(
        "c_custkey", F.from_json("value", TEAMS.raw_schema()).alias("payload")
    ).select("c_custkey", "payload.*")
    array = F.col(TEAMS.array)
    return parsed.select(
        "c_custkey",
        array.isNotNull().alias("has_array"),
        F.coalesce(F.size(array), F.lit(0)).cast("bigint").alias("elements"),
    )


def payload_guard_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines landed, guarded and flattened: only proper payloads give rows."""
    path = new_workspace(spark, "bronze-mixed")
    land_lines(_mixed_payloads(spark, sf_dir), path)
    bronze = read_bronze(spark, TEAMS, path, columns=["team_id", "team_name"])
    if not has_array(bronze, TEAMS):
        raise ValueError("no payload with the array")
    return flatten(bronze, TEAMS, columns=["team_id", "team_name"])


# Silver


def silver_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten(_through_bronze(spark, fixtures.profiles(spark, sf_dir), TEAMS), TEAMS)


def silver_standings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.standings(spark, sf_dir)
    return flatten(_through_bronze(spark, rows, STANDINGS), STANDINGS)


def silver_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten(_through_bronze(spark, fixtures.contests(spark, sf_dir), MATCHES), MATCHES)


def silver_matches_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed columns, and whether each row names the bronze file it came from."""
    path = new_workspace(spark, "bronze-matches")
    land_rows(fixtures.contests(spark, sf_dir), MATCHES, path)
    flat = flatten(read_bronze(spark, MATCHES, path), MATCHES, STRICT)
    return flat.select(
        "match_id", F.col("match_date").cast("string").alias("match_date"), "match_status",
        "home_team_id", "home_score", "away_team_id", "away_score",
        F.col(SOURCE_FILE).contains(path).alias("traced"),
    )


def split_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match payloads landed as lines as long as a task's batch of rows, cut into lines of 50
    and flattened; with each row, whether its line is that short."""
    root = new_workspace(spark, "split")
    rows = fixtures.contests(spark, sf_dir)
    land_payloads(fixtures.payloads(rows, MATCHES, per_line=1_000_000), f"{root}/long")
    split_payloads(spark, f"{root}/long", f"{root}/short", MATCHES.array, per_line=50)
    bronze = read_bronze(spark, MATCHES, f"{root}/short")
    short = bronze.select(MATCHES.array, (F.size(MATCHES.array) <= 50).alias("short"))
    return flatten(short, MATCHES, keep=["short"])


# Gold


def gold_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_gold_teams(fixtures.profiles(spark, sf_dir)).drop(LOADED_AT)


def gold_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_gold_matches(fixtures.contests(spark, sf_dir)).drop(LOADED_AT)


def _typed(df: DataFrame, spec: EntitySpec) -> DataFrame:
    """Silver text columns as strict silver has them."""
    return df.select(
        *[c for c in df.columns if c not in spec.columns],
        *[
            (whole(F.col(f.column)) if f.strict_type == "bigint" else F.col(f.column).try_cast(f.strict_type))
            .alias(f.column)
            for f in spec.fields
        ],
    )


def gold_matches_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    silver = _typed(fixtures.contests(spark, sf_dir), MATCHES)
    gold = build_gold_matches(silver, STRICT).drop(LOADED_AT)
    return gold.withColumn("match_date", F.col("match_date").cast("string"))


def _silver_standings_table(
    spark: SparkSession, sf_dir: str, before: str | None = None
) -> DataFrame:
    return materialize(fixtures.standings(spark, sf_dir, before), "silver-standings")


def gold_standings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_gold_standings(_silver_standings_table(spark, sf_dir)).drop(LOADED_AT)


def gold_standings_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    silver = _typed(_silver_standings_table(spark, sf_dir), STANDINGS)
    return build_gold_standings(silver).drop(LOADED_AT)


def gold_standings_early(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Early in the season half of the teams have not played: their ratios are NULL."""
    return build_gold_standings(_silver_standings_table(spark, sf_dir, EARLY)).drop(LOADED_AT)


def text_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome, arithmetic and ratios on text that is padded, empty, no number or NULL."""
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    quantity = F.col("l_quantity").cast("bigint").cast("string")
    line = F.col("l_linenumber").cast("string")
    home = F.when((flag == "A") & (status == "F"), F.concat(F.lit(" "), quantity, F.lit(" "))).when(
        flag != "R", quantity
    ).when(status == "F", F.lit("x"))
    away = F.when(flag == "R", F.lit("")).when(status == "O", line).otherwise(F.lit("0"))
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", home.alias("home"), away.alias("away")
    )
    home, away = F.col("home"), F.col("away")
    metrics = goal_metrics(home, away) | {
        "result": outcome(home, away, unknown_is_draw=True),
        "result_if_known": outcome(num(home), num(away), unknown_is_draw=False),
        "share": ratio(home, away, 2),
        "share_percent": ratio(away, home, 1, scale=100),
    }
    return rows.select("*", *[expression.alias(name) for name, expression in metrics.items()])


# Running totals


def _standing_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _silver_standings_table(spark, sf_dir).select(
        "standing_id", "group_name", "position", "points"
    )


def running_total_text_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _standing_points(spark, sf_dir)
    return running_total(
        rows, num(F.col("points")), ["group_name"], "position", "running_total"
    )


def running_total_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _standing_points(spark, sf_dir).withColumn(
        "position", F.col("position").try_cast("bigint")
    )
    return running_total(
        rows, num(F.col("points")), ["group_name"], "position", "running_total"
    )


def running_total_skewsafe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three groups hold all line items."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", F.to_date("l_shipdate").alias("shipped"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
    )
    totalled = running_total(
        rows, F.col("l_quantity"), ["l_returnflag"], "shipped", "running_quantity"
    )
    return totalled.withColumn("shipped", F.col("shipped").cast("string"))


def running_total_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals stored from the line items shipped before 1998, then brought up to date: those
    shipped later are added, in two steps, and one day of each month is taken away."""
    shipped = F.to_date("l_shipdate")
    rows = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", shipped.alias("shipped"), "l_quantity"
    )
    group, key, value = ["l_returnflag"], "shipped", F.col("l_quantity")
    root = new_workspace(spark, "totals")
    name = f"{_database(spark, Layout(root))}.totals"
    is_early = F.col("shipped") < F.lit("1998-01-01").cast("date")
    build_totals(spark, name, rows.where(is_early), value, group, key, f"{root}/totals", 24)
    late, odd = rows.where(~is_early), F.dayofmonth("shipped") % 2 == 1
    update_totals(spark, name, value, group, key, added=late.where(odd))
    gone = rows.where((F.dayofmonth("shipped") == 15) & (is_early | odd))
    update_totals(spark, name, value, group, key, added=late.where(~odd), removed=gone)
    totals = read_totals(spark, name, group, key, "running_quantity")
    return totals.withColumn("shipped", F.col("shipped").cast("string"))


# Reports


def latest_finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.latest_finished(build_gold_matches(fixtures.contests(spark, sf_dir)))


def finished_in_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished fixtures of a year, from gold matches published by year: the folders of other
    years are not opened."""
    gold = build_gold_matches(fixtures.contests(spark, sf_dir)).drop(LOADED_AT)
    gold = gold.withColumn("match_year", F.substring("match_date", 1, 4).cast("int"))
    root = new_workspace(spark, "matches-by-year")
    overwrite_partitions(gold, f"{root}/matches", ["match_year"])
    database = _database(spark, Layout(root))
    publish(spark, f"{database}.matches", f"{root}/matches", gold.schema, ["match_year"])
    rows = spark.table(f"{database}.matches").where("match_year = 1997")
    return rows.where(F.col("match_status") == reports.FINISHED).select(
        "match_id", "match_date", "match_year", "home_score", "away_score", "result"
    )


def _seasons_run(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """One run over two leagues and all seasons: gold table by entity. Leagues are teams with
    even and odd numbers; a season is a year, team profiles are all of one."""
    layout = Layout(new_workspace(spark, "seasons"))
    league = {
        "teams": "team_id", "standings": "team_id", "matches": "home_team_id",
    }
    season = {
        "teams": F.lit("1997"), "standings": F.col("season").cast("string"),
        "matches": F.substring("match_date", 1, 4),
    }
    sources = {
        "teams": fixtures.profiles, "standings": fixtures.standings_by_season,
        "matches": fixtures.contests,
    }

    def land_one(name: str) -> None:
        rows = sources[name](spark, sf_dir).withColumns(
            {
                "season": season[name],
                "league": (F.col(league[name]).cast("bigint") % 2).cast("string"),
            }
        )
        land_rows(rows, ENTITIES[name], layout.bronze(name), ["league", "season"])

    side_by_side(spark, {name: partial(land_one, name) for name in sources})
    database = _database(spark, layout)
    run = run_medallion(
        spark, layout, database, batch_ts=BATCH_TS, partition_by=["league", "season"]
    )
    return dict(run.gold)


def latest_finished_in_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest finished fixtures of one league and season, of a table that has all of them."""
    matches = spark.table(_seasons_run(spark, sf_dir)["matches"])
    return reports.latest_finished(matches.where("league = '1' AND season = '1997'"))


def group_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standings from payloads to the sorted report, silver and gold written in between."""
    silver = materialize(silver_standings(spark, sf_dir), "silver-standings")
    gold = materialize(build_gold_standings(silver), "gold-standings")
    return reports.group_report(gold)


def team_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = build_gold_standings(_silver_standings_table(spark, sf_dir))
    return reports.team_performance(
        build_gold_teams(fixtures.profiles(spark, sf_dir)), materialize(gold, "gold-standings")
    )


def _strict_gold(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Gold teams and standings from payloads, all typed."""
    rows = {TEAMS: fixtures.profiles(spark, sf_dir), STANDINGS: fixtures.standings(spark, sf_dir)}
    teams, standings = (
        materialize(flatten(_through_bronze(spark, df, spec), spec, STRICT), f"strict-{spec.name}")
        for spec, df in rows.items()
    )
    return build_gold_teams(teams), materialize(build_gold_standings(standings), "gold-standings")


def team_performance_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks sort as numbers: 2 before 10."""
    return reports.team_performance(*_strict_gold(spark, sf_dir))


def group_report_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.group_report(_strict_gold(spark, sf_dir)[1])


def bronze_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run counts while it reads: lines, broken ones, ones without the array, and
    values that no number holds. Of the customers' team payloads one segment is cut short,
    one lacks the array, one has years that are none, and one years such as "1950.0"."""
    segment, key = F.col("c_mktsegment"), F.col("c_custkey").cast("string")
    year = F.when(segment == "FURNITURE", F.lit("long ago")).when(
        segment == "HOUSEHOLD", F.lit("1950.0")
    ).otherwise(F.lit("1950"))
    whole_line = F.format_string('{"teams":[{"idTeam":"%s","intFormedYear":"%s"}]}', key, year)
    line = (
        F.when(segment == "MACHINERY", F.substring(whole_line, 1, 20))
        .when(segment == "BUILDING", F.format_string('{"message":"%s"}', key))
        .otherwise(whole_line)
    )
    path = new_workspace(spark, "bronze-counted")
    table(spark, sf_dir, "customer").select(line.alias("value")).write.text(f"{path}/bronze")
    counts = bronze_to_silver(spark, TEAMS, f"{path}/bronze", f"{path}/silver", STRICT)
    names = [*counts]
    read = read_layer(spark, f"{path}/silver", TEAMS.silver_contract(STRICT))
    years = read.agg(F.count("team_founded")).first()[0]
    rows = [(name, counts[name]) for name in names] + [("years", years)]
    return spark.createDataFrame(rows, "check_name string, observed bigint")


# Gate, contracts, whole run


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three good layers, one without rows, one without a required column, one absent."""
    root = new_workspace(spark, "quality")

    def write_teams() -> None:
        write_layer(fixtures.profiles(spark, sf_dir), f"{root}/teams")

    def write_standings() -> None:
        rows = fixtures.standings(spark, sf_dir)
        write_layer(rows, f"{root}/standings")
        write_layer(rows.drop("points"), f"{root}/standings_no_points")
        for kind in ("string", "bigint"):
            part = rows.withColumn("points", F.col("points").cast(kind))
            write_layer(part, f"{root}/standings_torn/{kind}")

    def write_matches() -> None:
        rows = fixtures.contests(spark, sf_dir)
        write_layer(rows, f"{root}/matches")
        stored = read_layer(spark, f"{root}/matches", rows.schema)
        abandoned = stored.where(F.col("match_status") == "ABANDONED")
        write_layer(abandoned, f"{root}/matches_abandoned")

    writes = {"teams": write_teams, "standings": write_standings, "matches": write_matches}
    side_by_side(spark, writes)
    names = ["teams", "standings", "standings_no_points", "matches", "matches_abandoned"]
    layers = {name: (f"{root}/{name}", ENTITIES[name.split("_")[0]].required) for name in names}
    layers["matches_absent"] = (f"{root}/matches_absent", MATCHES.required)
    layers["standings_torn"] = (f"{root}/standings_torn/*", STANDINGS.required)
    return build_quality_report(spark, layers)


def _bronze_layout(spark: SparkSession, sf_dir: str) -> Layout:
    layout = Layout(new_workspace(spark, "medallion"))
    sources = {
        "teams": fixtures.profiles,
        "standings": fixtures.standings,
        "matches": fixtures.contests,
    }

    def land_one(name: str) -> None:
        land_rows(sources[name](spark, sf_dir), ENTITIES[name], layout.bronze(name))

    side_by_side(spark, {name: partial(land_one, name) for name in sources})
    return layout


def _database(spark: SparkSession, layout: Layout) -> str:
    name = "run_" + layout.root.rsplit("-", 1)[1]
    spark.sql(f"CREATE DATABASE {name} LOCATION '{layout.root}/tables'")
    return name


def gold_file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the published gold standings lie in their files: rows, rows that come before the one
    ahead of them in their file, and files whose range begins before another one's end."""
    layout = _bronze_layout(spark, sf_dir)
    run = run_medallion(spark, layout, _database(spark, layout), batch_ts=BATCH_TS)
    stored = spark.read.parquet(location_of(spark, run.gold["standings"]))
    rows = stored.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"),
        F.struct("group_name", "position", "standing_id").alias("place"),
    )
    former = F.lag("place").over(Window.partitionBy("file").orderBy("at"))
    files = rows.withColumn("unsorted", former > F.col("place")).groupBy("file").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("unsorted").alias("unsorted"),
        F.min("place").alias("low"), F.max("place").alias("high"),
    )
    # One row per file.
    ahead = F.max("high").over(Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1))
    return files.withColumn("overlaps", ahead >= F.col("low")).agg(
        F.sum("rows").alias("rows"), F.sum("unsorted").alias("unsorted"),
        F.count_if("overlaps").alias("overlapping"),
    )


def gold_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every different row of the three gold tables of a run, the landed lines it came from:
    their text's digest and their number."""
    layout = _bronze_layout(spark, sf_dir)
    database = _database(spark, layout)
    run = run_medallion(spark, layout, database, batch_ts=BATCH_TS, with_lineage=True)
    ids = {"teams": "team_id", "standings": "standing_id", "matches": "match_id"}
    parts = []
    for name, spec in ENTITIES.items():
        lines = spark.table(f"{database}.lineage_{name}")
        traced = trace(spark.table(run.gold[name]), lines, spec)
        here = F.col(SOURCE_FILE).contains(layout.bronze(name))
        counted = traced.groupBy(F.col(ids[name]).alias("id"), "line_sha256").agg(
            F.count(F.lit(1)).alias("lines"), F.min(here).alias("traced")
        )
        parts.append(counted.select(F.lit(name).alias("entity"), "*"))
    return reduce(DataFrame.unionByName, parts)


def contract_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of the six published tables against its contract, and those of a table
    over files that lack a column, have one more, one of another type and two in wrong order."""
    layout = _bronze_layout(spark, sf_dir)
    database = _database(spark, layout)
    run = run_medallion(spark, layout, database, batch_ts=BATCH_TS)
    tables = {}
    for name, spec in ENTITIES.items():
        tables[f"silver_{name}"] = (run.silver[name], _stored(spec.silver_contract()))
        tables[f"gold_{name}"] = (run.gold[name], _stored(spec.gold_contract()))
    odd = spark.table(run.silver["standings"]).select(
        F.col("position").cast("bigint"), "team_name", "team_id", "points"
    )
    write_layer(odd, f"{layout.root}/odd")
    point(spark, f"{database}.odd", f"{layout.root}/odd", odd.schema)
    declared = STANDINGS.silver_contract()
    names = ("standing_id", "position", "team_id", "team_name")
    tables["odd"] = (f"{database}.odd", StructType([declared[n] for n in names]))
    return build_contract_report(spark, tables)


def _stored(contract: StructType) -> StructType:
    """A contract as it comes back from JSON text."""
    return contract_from_dict(json.loads(json.dumps(contract_to_dict(contract))))


def medallion_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole run twice over the same payloads, then once over payloads the gate must
    refuse. Per table: its rows after each of the three, and the rows that only one of the
    first two states has."""
    layout = _bronze_layout(spark, sf_dir)
    database = _database(spark, layout)

    def published() -> dict[str, str]:
        run = run_medallion(spark, layout, database, batch_ts=BATCH_TS)
        tables = {f"silver_{name}": t for name, t in run.silver.items()}
        return tables | {f"gold_{name}": t for name, t in run.gold.items()}

    def files(tables: dict[str, str]) -> dict[str, DataFrame]:
        """The files of this state, which stay when the table moves on to the next."""
        return {label: spark.read.parquet(location_of(spark, t)) for label, t in tables.items()}

    first = files(published())
    tables = published()
    second = files(tables)
    places = {label: location_of(spark, t) for label, t in tables.items()}
    _land_without_points(spark, sf_dir, layout.bronze("standings"))
    try:
        published()
    except QualityError:
        pass
    else:
        raise AssertionError("the gate let standings without points pass")

    parts = []
    for label, before in first.items():
        both = consolidate({"first": before, "second": second[label]}, "state")
        # One pass per table: equal rows meet in one group, whichever run they are from.
        columns = [c for c in both.columns if c != "state"]
        in_first, in_second = (F.count_if(F.col("state") == s) for s in ("first", "second"))
        groups = both.groupBy(*columns).agg(in_first.alias("a"), in_second.alias("b"))
        after_failure = spark.table(tables[label]).agg(F.count(F.lit(1))).scalar()
        parts.append(
            groups.agg(
                F.sum("a").alias("rows_first"),
                F.sum("b").alias("rows_second"),
                F.sum(F.abs(F.col("a") - F.col("b"))).alias("rows_changed"),
            ).select(
                F.lit(label).alias("table_name"), "rows_first", "rows_second", "rows_changed",
                after_failure.alias("rows_after_failure"),
                F.lit(location_of(spark, tables[label]) != places[label]).alias("moved"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def _land_without_points(spark: SparkSession, sf_dir: str, path: str) -> None:
    rows = fixtures.standings(spark, sf_dir)
    land_rows(rows.withColumn("points", F.lit(None).cast("string")), STANDINGS, path)


# Growing sources


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def merge_latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest event per user and type: the state of the first half month, then merged with
    the events after it."""
    events = _events(spark, sf_dir)
    is_early = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    keys, order = ["user_id", "event_type"], ["ts", "event_id"]
    current = latest_per_key(events.where(is_early), keys, order)
    merged = merge_latest(current, events.where(~is_early), keys, order)
    return merged.withColumn("ts", F.date_format("ts", MICROS))


def merge_into_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of the first half month, by type, then the later clicks and events without a
    type merged in: no other type's folder is written again. A tenth of the users' events have
    no type."""
    typed = F.when(F.col("user_id") % 10 != 0, F.col("event_type"))
    events = _events(spark, sf_dir).withColumn("event_type", typed)
    is_early = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    keys, order = ["user_id", "event_type"], ["ts", "event_id"]
    columns = [c for c in events.columns if c != "event_type"]
    events = events.select(*columns, "event_type")
    root = new_workspace(spark, "events-by-type")
    name = f"{_database(spark, Layout(root))}.events"
    create_partitioned(spark, name, events.schema, ["event_type"], f"{root}/events")
    early = materialize(latest_per_key(events.where(is_early), keys, order), "early")
    replace_partitions(spark, name, early, early.select("event_type"))
    late = ~is_early & (F.col("event_type").isNull() | (F.col("event_type") == "click"))
    merge_partitions(spark, name, events.where(late), keys, order)
    return spark.table(name).withColumn("ts", F.date_format("ts", MICROS))


def merge_into_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest event per user and type in a bucketed state: days of odd and even number in turn,
    each merged into what the one before left."""
    events = _events(spark, sf_dir)
    keys, order = ["user_id", "event_type"], ["ts", "event_id"]
    root = new_workspace(spark, "event-state")
    name = f"{_database(spark, Layout(root))}.state"
    create_state(spark, name, events.schema, keys, 16, f"{root}/state-0")
    for part in (0, 1, 2):
        days = events.where(F.dayofmonth("ts") % 3 == part)
        merge_state(spark, name, days, keys, order, f"{root}/state-{part + 1}")
    return spark.table(name).withColumn("ts", F.date_format("ts", MICROS))


def partition_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by year; the partition of one year is restated, the others stay."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", F.year("o_orderdate").alias("order_year")
    )
    path = new_workspace(spark, "orders-by-year")
    overwrite_partitions(orders, path, ["order_year"])
    restated = orders.where(F.col("order_year") == 1997).withColumn("o_orderstatus", F.lit("R"))
    overwrite_partitions(restated, path, ["order_year"])
    return spark.read.schema(orders.schema).parquet(path)


def consolidate_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold standings of all leagues and seasons, published as one table by one run, totalled
    per league, season and group."""
    gold = spark.table(_seasons_run(spark, sf_dir)["standings"]).drop(LOADED_AT)
    return gold.withColumn("season", F.col("season").cast("int"))


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event delivered twice, read as a stream, kept once."""
    root = new_workspace(spark, "stream")
    events = _events(spark, sf_dir)
    events.unionAll(events).write.parquet(f"{root}/in")
    stream = stream_layer(spark, f"{root}/in", events.schema)
    unique = dedupe_stream(stream, "event_id", F.col("ts").cast("timestamp"), "40 days")
    append_available(unique, f"{root}/out", f"{root}/progress").awaitTermination()
    rows = spark.read.schema(events.schema).parquet(f"{root}/out")
    return rows.withColumn("ts", F.date_format("ts", MICROS))


def stream_silver_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match payloads landed twice, streamed into flat rows, each match kept once. Matches
    under way have no id yet; of those, rows that agree in everything are copies."""
    root = new_workspace(spark, "stream-matches")
    under_way = F.col("match_status") == "LIVE"
    matches = fixtures.contests(spark, sf_dir).withColumn(
        "match_id", F.when(~under_way, F.col("match_id"))
    )
    land_rows(matches.unionAll(matches), MATCHES, f"{root}/in")
    stream = stream_bronze(spark, MATCHES, f"{root}/in")
    played_on = F.col("match_date").try_cast("timestamp")
    unique = dedupe_stream(stream, "match_id", played_on, "3000 days")
    append_available(unique, f"{root}/out", f"{root}/progress").awaitTermination()
    contract = StructType(MATCHES.silver_contract().fields[: len(MATCHES.fields)])
    return read_layer(spark, f"{root}/out", contract)


def _land_more(rows: DataFrame, spec: EntitySpec, path: str) -> None:
    """One payload per row beside those that lie there already."""
    to_lines(payload_rows(rows, spec)).write.mode("append").text(path)


def stream_latest_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every match before it is played, half of them at half time, a third of all after the
    end, in three deliveries; the stream keeps the last version of each."""
    root = new_workspace(spark, "stream-latest")
    name = f"{_database(spark, Layout(root))}.matches"
    create_state(spark, name, state_schema(MATCHES), ["match_id"], 8, f"{root}/empty")
    played = fixtures.contests(spark, sf_dir)
    nothing = F.lit(None).cast("string")
    number = F.col("match_id").cast("bigint")
    versions = [
        played.withColumns(
            {"match_status": F.lit("NS"), "home_score": nothing, "away_score": nothing}
        ),
        played.withColumns({"match_status": F.lit("HT"), "away_score": nothing}).where(
            number % 2 == 0
        ),
        played.where(number % 3 == 0),
    ]
    for rows in versions:
        _land_more(rows, MATCHES, f"{root}/in")
        lines = stream_lines(spark, MATCHES, f"{root}/in")
        query = upsert_available(
            lines, MATCHES, name, ["match_id"], [LANDED_AT], root, f"{root}/progress"
        )
        query.awaitTermination()
    spark.sql(f"REFRESH TABLE {name}")
    return spark.table(name).drop(LANDED_AT)


def refresh_published_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of all seasons published by one run, those of 1997 before they are played; then
    1997 is played and a stream brings the tables up to date, one season written again."""
    layout = Layout(new_workspace(spark, "refreshed"))
    by, season = ["season"], F.substring("match_date", 1, 4)
    played = fixtures.contests(spark, sf_dir).withColumn("season", season)
    nothing, before = F.lit(None).cast("string"), F.col("season") == "1997"
    unplayed = played.withColumns(
        {
            "match_status": F.when(before, "NS").otherwise(F.col("match_status")),
            "home_score": F.when(before, nothing).otherwise(F.col("home_score")),
            "away_score": F.when(before, nothing).otherwise(F.col("away_score")),
        }
    )
    rows = {
        "teams": fixtures.profiles(spark, sf_dir).withColumn("season", F.lit("1997")),
        "standings": fixtures.standings(spark, sf_dir).withColumn("season", F.lit("1997")),
        "matches": unplayed,
    }
    land = {
        name: partial(land_rows, df, ENTITIES[name], layout.bronze(name), by)
        for name, df in rows.items()
    }
    side_by_side(spark, land)
    database = _database(spark, layout)
    run = run_medallion(spark, layout, database, partition_by=by)
    lines = to_lines(payload_rows(played.where(before), MATCHES, by), by)
    lines.write.mode("append").partitionBy(*by).text(layout.bronze("matches"))
    query = refresh_from_stream(
        spark, layout, database, MATCHES, ["match_id"], by, f"{layout.root}/progress"
    )
    query.awaitTermination()
    spark.sql(f"REFRESH TABLE {database}.{POINTER}")
    return spark.table(run.gold["matches"]).drop(LOADED_AT)


def stream_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of the customers' team payloads in a stream: one segment is cut short, one
    lacks the array, one has teams without an id."""
    segment, key = F.col("c_mktsegment"), F.col("c_custkey").cast("string")
    whole_line = F.format_string('{"teams":[{"idTeam":"%s","strTeam":"x"}]}', key)
    line = (
        F.when(segment == "MACHINERY", F.substring(whole_line, 1, 20))
        .when(segment == "BUILDING", F.format_string('{"message":"%s"}', key))
        .when(segment == "HOUSEHOLD", F.format_string('{"teams":[{"strTeam":"%s"}]}', key))
        .otherwise(whole_line)
    )
    root = new_workspace(spark, "stream-letters")
    name = f"{_database(spark, Layout(root))}.teams"
    create_state(spark, name, state_schema(TEAMS), ["team_id"], 4, f"{root}/empty")
    table(spark, sf_dir, "customer").select(line.alias("value")).write.text(f"{root}/in")
    lines = stream_lines(spark, TEAMS, f"{root}/in")
    query = upsert_available(lines, TEAMS, name, ["team_id"], [LANDED_AT], root, f"{root}/progress")
    query.awaitTermination()
    spark.sql(f"REFRESH TABLE {name}")
    kept = spark.table(name).select(F.lit("kept").alias("reason"), "team_id")
    letters = read_dead_letters(spark, root)
    # What a letter says: the customer's number, wherever its kind of line has it.
    number = F.regexp_extract("line", '"(?:idTeam|strTeam)":"([0-9]+)', 1)
    left = letters.select("reason", F.when(number != "", number).alias("team_id"))
    return kept.unionByName(left)


QUERIES = {
    query.__name__: query
    for query in (
        bronze_roundtrip,
        explode_drops_empty,
        payload_guard,
        payload_guard_silver,
        silver_teams,
        silver_standings,
        silver_matches,
        silver_matches_strict,
        split_matches,
        gold_teams,
        gold_matches,
        gold_matches_strict,
        gold_standings,
        gold_standings_strict,
        gold_standings_early,
        text_metrics,
        running_total_text_order,
        running_total_range,
        running_total_skewsafe,
        running_total_incremental,
        latest_finished,
        finished_in_year,
        latest_finished_in_season,
        group_report,
        team_performance,
        team_performance_strict,
        group_report_strict,
        bronze_counts,
        quality_report,
        gold_file_order,
        gold_lineage,
        contract_report,
        medallion_rerun,
        merge_latest_events,
        merge_into_partitions,
        merge_into_state,
        partition_overwrite,
        consolidate_seasons,
        stream_dedup,
        stream_silver_matches,
        stream_latest_matches,
        refresh_published_matches,
        stream_dead_letters,
    )
}
