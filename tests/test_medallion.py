from datetime import datetime

import pytest
from pyspark.sql import functions as F

from orebed import fixtures
from orebed.operators.quality import QualityError
from orebed.plans import reports
from orebed.plans.medallion import run_medallion
from orebed.session import new_workspace
from orebed.sources.bronze import land_rows
from orebed.sources.layers import location_of
from orebed.specs import ENTITIES, MATCHES, SOURCE_FILE, STANDINGS, STRICT, Layout

TS = datetime(2026, 1, 1)
BUILDERS = {"teams": fixtures.profiles, "standings": fixtures.standings, "matches": fixtures.contests}


@pytest.fixture(scope="module")
def sources(spark):
    """Silver-shaped rows per entity."""
    return {n: build(spark, "/root/testdata/sf0.001") for n, build in BUILDERS.items()}


@pytest.fixture
def layout(spark, sources):
    layout = Layout(new_workspace(spark, "medallion"))
    for name, rows in sources.items():
        land_rows(rows, ENTITIES[name], layout.bronze(name))
    return layout


@pytest.fixture
def database(spark, layout):
    name = "run_" + layout.root.rsplit("-", 1)[1]
    spark.sql(f"CREATE DATABASE {name} LOCATION '{layout.root}/tables'")
    return name


def state(spark, run):
    return {t: sorted(spark.table(t).collect(), key=str) for t in [*run.silver.values(), *run.gold.values()]}


def test_run_and_rerun(spark, layout, database, sources):
    first = run_medallion(spark, layout, database, batch_ts=TS)
    tables = state(spark, first)
    second = run_medallion(spark, layout, database, batch_ts=TS)
    assert first.run_id != second.run_id and second.skipped == ()
    assert state(spark, second) == tables
    sizes = {t.split(".")[1]: len(rows) for t, rows in tables.items()}
    assert sizes["silver_teams"] == sources["teams"].count()
    assert sizes["gold_teams"] == sources["teams"].distinct().count()
    assert sizes["gold_standings"] == sizes["silver_standings"] == sources["standings"].count()
    assert sizes["gold_matches"] == sizes["silver_matches"] == sources["matches"].count()
    for name, spec in ENTITIES.items():
        assert spark.table(first.silver[name]).schema == spec.silver_contract()
        assert spark.table(first.gold[name]).schema == spec.gold_contract()


def test_strict_run(spark, layout, database):
    run = run_medallion(spark, layout, database, mode=STRICT, batch_ts=TS)
    for name, spec in ENTITIES.items():
        silver = spark.table(run.silver[name])
        assert silver.schema == spec.silver_contract(STRICT)
        assert silver.where(f"{SOURCE_FILE} IS NULL").isEmpty()
        assert spark.table(run.gold[name]).schema == spec.gold_contract(STRICT)
    unplayed = spark.table(run.gold["matches"]).where("result IS NULL")
    assert not unplayed.isEmpty() and unplayed.where("total_goals IS NOT NULL").isEmpty()


def test_missing_input_stops_at_once(spark, database):
    empty = Layout(new_workspace(spark, "medallion"))
    with pytest.raises(QualityError, match="no input"):
        run_medallion(spark, empty, database)
    assert spark.catalog.listTables(database) == []


def test_skipped_entity_keeps_its_silver(spark, layout, database, caplog):
    first = run_medallion(spark, layout, database, batch_ts=TS)
    before = state(spark, first)
    text = spark.createDataFrame([('{"message":"no such id"}',)], "value string")
    text.write.mode("overwrite").text(layout.bronze("teams"))
    second = run_medallion(spark, layout, database, batch_ts=TS)
    assert second.skipped == ("teams",)
    assert "teams skipped" in caplog.text
    assert state(spark, second) == before


def test_skipped_entity_without_silver_fails(spark, layout, database):
    text = spark.createDataFrame([('{"message":"no such id"}',)], "value string")
    text.write.mode("overwrite").text(layout.bronze("matches"))
    with pytest.raises(QualityError, match="matches: files"):
        run_medallion(spark, layout, database)
    assert spark.catalog.listTables(database) == []


def test_bad_silver_changes_no_table(spark, layout, database, sources):
    first = run_medallion(spark, layout, database, batch_ts=TS)
    before = state(spark, first)
    no_points = sources["standings"].drop("points").selectExpr("*", "cast(NULL AS STRING) AS points")
    land_rows(no_points, STANDINGS, layout.bronze("standings"))
    empty = spark.createDataFrame([('{"teams":[]}',)], "value string")
    empty.write.mode("overwrite").text(layout.bronze("teams"))
    with pytest.raises(QualityError) as error:
        run_medallion(spark, layout, database, batch_ts=datetime(2027, 1, 1))
    assert "standings: column points" in str(error.value)
    assert "teams: rows" in str(error.value)
    assert state(spark, first) == before


def test_mode_switch_over_a_kept_table_changes_no_table(spark, layout, database):
    """A strict run whose matches are skipped may not stand beside compat matches."""
    first = run_medallion(spark, layout, database, batch_ts=TS)
    before = state(spark, first)
    places = {t: location_of(spark, t) for t in before}
    text = spark.createDataFrame([('{"message":"no such id"}',)], "value string")
    text.write.mode("overwrite").text(layout.bronze("matches"))
    with pytest.raises(QualityError, match="matches: the kept table has another contract"):
        run_medallion(spark, layout, database, mode=STRICT, batch_ts=TS)
    assert state(spark, first) == before
    assert {t: location_of(spark, t) for t in before} == places


def test_a_skipped_entity_keeps_its_gold_stamp(spark, layout, database):
    run_medallion(spark, layout, database, batch_ts=TS)
    text = spark.createDataFrame([('{"message":"no such id"}',)], "value string")
    text.write.mode("overwrite").text(layout.bronze("teams"))
    second = run_medallion(spark, layout, database, batch_ts=datetime(2027, 1, 1))
    stamps = {n: spark.table(t).agg({"gold_loaded_at": "max"}).first()[0].year for n, t in second.gold.items()}
    assert stamps == {"teams": 2026, "standings": 2027, "matches": 2027}


def test_broken_lines_fail_the_gate_beyond_a_share(spark, layout, database):
    lines = spark.read.text(layout.bronze("teams")).limit(99).collect()
    broken = spark.createDataFrame([*[(r.value,) for r in lines], ('{"teams":[{',)], "value string")
    broken.coalesce(1).write.mode("overwrite").text(layout.bronze("teams"))
    with pytest.raises(QualityError, match="teams: 1 of 100 lines are broken"):
        run_medallion(spark, layout, database, broken_share=0.001)
    run = run_medallion(spark, layout, database, broken_share=0.01)
    assert (run.counts["teams"]["lines"], run.counts["teams"]["broken lines"]) == (100, 1)


def test_files_of_gold_standings_hold_ranges(spark, layout, database):
    run = run_medallion(spark, layout, database, batch_ts=TS)
    spans = sorted(
        (tuple(r.low), tuple(r.high))
        for r in spark.read.parquet(location_of(spark, run.gold["standings"])).selectExpr(
            "_metadata.file_path AS file", "struct(group_name, position, standing_id) AS place"
        ).groupBy("file").agg(F.min("place").alias("low"), F.max("place").alias("high")).collect()
    )
    assert spans and all(high < low for (_, high), (low, _) in zip(spans, spans[1:]))


def test_report_sql_on_published_tables(spark, layout, database):
    """The report queries as text, and the functions that stand for them."""
    run = run_medallion(spark, layout, database, batch_ts=TS)
    gold = {name: spark.table(table) for name, table in run.gold.items()}
    finished = spark.sql(f"""
        SELECT match_id, match_date, home_team_name, away_team_name, home_score, away_score,
               total_goals, result
        FROM {run.gold["matches"]} WHERE match_status = 'FT'
        ORDER BY match_date DESC, match_id LIMIT 20""")
    assert finished.collect() == reports.latest_finished(gold["matches"]).collect()
    groups = spark.sql(f"""
        SELECT group_name, position, team_name, points, running_total_points, points_per_game
        FROM {run.gold["standings"]} ORDER BY group_name, position, standing_id""")
    assert groups.collect() == reports.group_report(gold["standings"]).collect()
    teams = spark.sql(f"""
        SELECT t.team_id, t.team_name, s.played_games AS total_matches, s.won AS total_wins,
               s.win_percentage, s.position AS final_rank
        FROM {run.gold["teams"]} t LEFT JOIN {run.gold["standings"]} s ON t.team_id = s.team_id
        ORDER BY final_rank, t.team_id, s.standing_id LIMIT 10""")
    assert teams.collect() == reports.team_performance(gold["teams"], gold["standings"]).collect()


def test_report_plans(spark, layout, database):
    run = run_medallion(spark, layout, database, batch_ts=TS)
    gold = {name: spark.table(table) for name, table in run.gold.items()}

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    finished = plan(reports.latest_finished(gold["matches"]))
    assert "EqualTo(match_status,FT)" in finished
    assert "TakeOrderedAndProject" in finished and "Exchange" not in finished
    assert "home_team_badge" not in finished
    performance = plan(reports.team_performance(gold["teams"], gold["standings"]))
    assert "Window" not in performance and "running_total_points" not in performance
    assert "TakeOrderedAndProject" in performance


def test_flatten_and_matches_need_no_shuffle(spark, layout):
    from orebed.operators.flatten import flatten
    from orebed.plans.gold import gold_matches
    from orebed.sources.bronze import read_bronze

    silver = flatten(read_bronze(spark, MATCHES, layout.bronze("matches")), MATCHES)
    plan = gold_matches(silver, batch_ts=TS)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert "*(1) Generate explode" in plan and "*(1) Filter ((size(events" in plan


def test_performance_with_many_standings_per_team(spark):
    """A hot team's standings are compared with those of all others."""
    teams = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "team_id string, team_name string")
    rows = [(str(i % 2 + 1), f"s{i:03}", "1", "0", float(i), f"{i % 7}") for i in range(200)]
    standings = spark.createDataFrame(
        rows, "team_id string, standing_id string, played_games string, won string, "
        "win_percentage double, position string"
    )
    result = reports.team_performance(teams, standings, limit=5)
    full = (
        teams.join(standings, "team_id", "left")
        .orderBy("position", "team_id", "standing_id").limit(5)
        .selectExpr("team_id", "team_name", "played_games", "won", "win_percentage", "position")
    )
    assert [tuple(r) for r in result.collect()] == [tuple(r) for r in full.collect()]


def test_seasons_consolidate_at_gold(spark):
    """Gold of each season put together equals gold of all seasons grouped by season."""
    from orebed.operators.merge import consolidate
    from orebed.plans.gold import gold_standings
    from orebed.session import materialize

    rows = materialize(fixtures.standings_by_season(spark, "/root/testdata/sf0.001"), "test")
    years = [r.season for r in rows.select("season").distinct().collect()]
    per_season = {
        year: gold_standings(rows.where(f"season = {year}").drop("season"), TS) for year in years
    }
    apart = consolidate(per_season, "season")
    together = gold_standings(rows, TS, group_by=("season", "group_name")).select(*apart.columns)
    assert len(years) == 7
    assert apart.exceptAll(together).isEmpty() and together.exceptAll(apart).isEmpty()


def test_layout_per_league_and_season():
    layout = Layout("/data")
    assert layout.bronze("teams", league="7", season="2026") == "/data/bronze/teams/league=7/season=2026"
    assert layout.layer("gold", "teams", "r1") == "/data/gold/teams/run=r1"


def test_group_report_divides_copies(spark):
    """One row copied many times is sorted by several tasks; the order still holds."""
    from pyspark.sql import functions as F

    from orebed.session import materialize

    rows = spark.range(0, 6000, 1, 4).select(
        F.when(F.col("id") % 3 > 0, "g").otherwise("h").alias("group_name"),
        F.when(F.col("id") % 3 > 0, "1").otherwise((F.col("id") % 50).cast("string")).alias("position"),
        F.when(F.col("id") % 3 > 0, "same").otherwise(F.col("id").cast("string")).alias("standing_id"),
        F.lit("t").alias("team_name"), F.lit("3").alias("points"),
        F.lit(1.0).alias("running_total_points"), F.lit(1.0).alias("points_per_game"),
    )
    changed = {
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {key: spark.conf.get(key) for key in changed}
    try:
        for key, value in changed.items():
            spark.conf.set(key, value)
        report = reports.group_report(materialize(rows, "test"))
        with_task = report.withColumn("task", F.spark_partition_id()).collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    keys = [(r.group_name, r.position) for r in with_task]
    assert len(keys) == 6000 and keys == sorted(keys)
    assert len({r.task for r in with_task if r.group_name == "g"}) >= 4
