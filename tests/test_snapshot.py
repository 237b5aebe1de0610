"""All tables of a run published by one step; leagues and seasons; folders of former runs."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from orebed import fixtures
from orebed.plans import reports
from orebed.plans.medallion import run_medallion
from orebed.plans.retire import reachable, retirable, retire, table_places
from orebed.session import materialize, new_workspace
from orebed.sources import snapshot
from orebed.sources.bronze import land_rows
from orebed.sources.layers import location_of, pointer_rows
from orebed.sources.snapshot import Part, publish_together
from orebed.specs import ENTITIES, STRICT, Layout

SMALL = "/root/testdata/sf0.001"
TS, LATER = datetime(2026, 1, 1), datetime(2027, 1, 1)
BUILDERS = {"teams": fixtures.profiles, "standings": fixtures.standings, "matches": fixtures.contests}


@pytest.fixture(scope="module")
def sources(spark):
    return {n: materialize(build(spark, SMALL).limit(60), "few") for n, build in BUILDERS.items()}


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


def places(spark, run):
    return {t: location_of(spark, t) for t in [*run.silver.values(), *run.gold.values()]}


def stamps(spark, run):
    out = {}
    for layer, column in ((run.silver, "ingested_at"), (run.gold, "gold_loaded_at")):
        out |= {t: {r[0].year for r in spark.table(t).select(column).distinct().collect()} for t in layer.values()}
    return out


class Killed(RuntimeError):
    pass


def test_a_failure_leaves_six_old_tables(spark, layout, database, monkeypatch):
    """Whichever of the steps before the switch fails, at the fourth table."""
    first = run_medallion(spark, layout, database, batch_ts=TS)
    before = places(spark, first)
    for step in ("_add_run", "switch"):
        calls = []
        real = getattr(snapshot, step)

        def fourth_dies(*args):
            calls.append(args)
            if len(calls) == 4 or step == "switch":
                raise Killed
            return real(*args)

        monkeypatch.setattr(snapshot, step, fourth_dies)
        with pytest.raises(Killed):
            run_medallion(spark, layout, database, batch_ts=LATER)
        monkeypatch.undo()
        assert places(spark, first) == before
    assert set(map(frozenset, stamps(spark, first).values())) == {frozenset({2026})}
    second = run_medallion(spark, layout, database, batch_ts=LATER)
    assert set(map(frozenset, stamps(spark, second).values())) == {frozenset({2027})}
    assert all(second.run_id in place for place in places(spark, second).values())


def test_a_failure_after_the_switch_leaves_six_new_tables(spark, layout, database, monkeypatch):
    first = run_medallion(spark, layout, database, batch_ts=TS)
    real = snapshot.switch

    def dies_after(*args):
        real(*args)
        raise Killed

    monkeypatch.setattr(snapshot, "switch", dies_after)
    with pytest.raises(Killed):
        run_medallion(spark, layout, database, batch_ts=LATER)
    monkeypatch.undo()
    assert set(map(frozenset, stamps(spark, first).values())) == {frozenset({2027})}


def test_another_mode_is_another_contract(spark, layout, database):
    first = run_medallion(spark, layout, database, batch_ts=TS)
    rows = {t: spark.table(t).count() for t in first.gold.values()}
    strict = run_medallion(spark, layout, database, mode=STRICT, batch_ts=LATER)
    for name, spec in ENTITIES.items():
        assert spark.table(strict.gold[name]).schema == spec.gold_contract(STRICT)
    assert {t: spark.table(t).count() for t in strict.gold.values()} == rows
    assert len(pointer_rows(spark, database)) == 6
    again = run_medallion(spark, layout, database, batch_ts=TS)
    assert spark.table(again.gold["matches"]).schema == ENTITIES["matches"].gold_contract()


def test_only_the_run_shown_is_read(spark, layout, database):
    for ts in (TS, LATER):
        run = run_medallion(spark, layout, database, batch_ts=ts)
    table = spark.table(run.gold["matches"])
    table.collect()
    read = table.inputFiles()
    shown = spark.read.parquet(location_of(spark, run.gold["matches"]))
    assert len(read) >= len(shown.inputFiles())
    plan = table._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert "PartitionFilters: [isnotnull(run" in text and "Subquery" in text
    assert table.count() == shown.count()


def test_a_table_published_plain_before_becomes_a_view(spark, database, layout):
    from orebed.sources.layers import publish, write_layer

    frame = spark.createDataFrame([("a", 1)], "x string, n bigint")
    write_layer(frame, f"{layout.root}/plain")
    publish(spark, f"{database}.t", f"{layout.root}/plain", frame.schema)
    write_layer(frame.withColumn("n", F.lit(2).cast("bigint")), f"{layout.root}/gold/t/run=a%b")
    part = Part(f"{layout.root}/gold/t", "r2", frame.schema)
    write_layer(frame.withColumn("n", F.lit(3).cast("bigint")), part.path)
    publish_together(spark, database, layout.root, {"t": part})
    assert [tuple(r) for r in spark.table(f"{database}.t").collect()] == [("a", 3)]


def season_rows(spark, name):
    rows = {"teams": fixtures.profiles, "standings": fixtures.standings_by_season, "matches": fixtures.contests}
    season = {
        "teams": F.lit("1997"), "standings": F.col("season").cast("string"),
        "matches": F.substring("match_date", 1, 4),
    }
    key = "home_team_id" if name == "matches" else "team_id"
    league = (F.col(key).cast("bigint") % 2).cast("string")
    return rows[name](spark, SMALL).withColumns({"season": season[name], "league": league})


BY = ["league", "season"]


@pytest.fixture
def leagues(spark):
    layout = Layout(new_workspace(spark, "leagues"))
    for name, spec in ENTITIES.items():
        land_rows(season_rows(spark, name), spec, layout.bronze(name), BY)
    name = "run_" + layout.root.rsplit("-", 1)[1]
    spark.sql(f"CREATE DATABASE {name} LOCATION '{layout.root}/tables'")
    return layout, name


def test_all_leagues_and_seasons_in_one_run(spark, leagues):
    layout, database = leagues
    run = run_medallion(spark, layout, database, mode=STRICT, batch_ts=TS, partition_by=BY)
    for name, spec in ENTITIES.items():
        rows = season_rows(spark, name)
        silver, gold = spark.table(run.silver[name]), spark.table(run.gold[name])
        assert silver.columns == [*spec.silver_contract(STRICT).names, *BY]
        assert gold.columns == [*spec.gold_contract(STRICT).names, *BY]
        counts = {tuple(r) for r in rows.groupBy(*BY).count().collect()}
        assert {tuple(r) for r in silver.groupBy(*BY).count().collect()} == counts
    # One season alone gives what the run over all has for it.
    alone = Layout(new_workspace(spark, "alone"))
    for name, spec in ENTITIES.items():
        part = season_rows(spark, name).where("league = '1' AND season = '1997'").drop(*BY)
        land_rows(part, spec, alone.bronze(name))
    single = "run_" + alone.root.rsplit("-", 1)[1]
    spark.sql(f"CREATE DATABASE {single} LOCATION '{alone.root}/tables'")
    one = run_medallion(spark, alone, single, mode=STRICT, batch_ts=TS)
    for name in ENTITIES:
        own = spark.table(one.gold[name])
        same = spark.table(run.gold[name]).where("league = '1' AND season = '1997'").drop(*BY)
        assert own.count() and own.exceptAll(same).isEmpty() and same.exceptAll(own).isEmpty()


def test_a_report_on_one_season_reads_that_season(spark, leagues):
    layout, database = leagues
    run = run_medallion(spark, layout, database, batch_ts=TS, partition_by=BY)
    matches = spark.table(run.gold["matches"]).where("league = '1' AND season = '1997'")
    report = reports.latest_finished(matches)
    assert report.count() > 0
    text = report._jdf.queryExecution().executedPlan().toString()
    at = next(line for line in text.split("\n") if "PartitionFilters" in line and "season" in line)
    # League and season are settled before a file is listed, the run by the pointer.
    assert "isnotnull(season" in at and "isnotnull(league" in at and "Subquery" in at
    read = {r[0] for r in matches.select(F.input_file_name()).distinct().collect()}
    assert read and all("/league=1/season=1997/" in f and run.run_id in f for f in read)


def test_retired_folders_are_never_shown_ones(spark, layout, database):
    """A run whose teams are skipped: their tables still show the run before."""
    first = run_medallion(spark, layout, database, batch_ts=TS)
    text = spark.createDataFrame([('{"message":"no such id"}',)], "value string")
    second = run_medallion(spark, layout, database, batch_ts=LATER)
    text.write.mode("overwrite").text(layout.bronze("teams"))
    third = run_medallion(spark, layout, database, batch_ts=LATER)
    assert third.skipped == ("teams",)
    shown = places(spark, third)
    rows = {t: spark.table(t).count() for t in shown}
    assert retirable(spark, layout, 3600, [database]) == []
    listed = retirable(spark, layout, 0)
    assert not {f.split(":")[-1] for f in listed} & {p.split(":")[-1] for p in shown.values()}
    runs = [f for f in listed if "/run=" in f]
    # Six of the first run, four of the second, and the folder that the skipped silver left.
    assert sum(first.run_id in f for f in runs) == 6
    assert sum(second.run_id in f for f in runs) == 4
    assert sum(third.run_id in f for f in runs) == 1
    assert len(listed) - len(runs) == 2
    assert retire(spark, layout, listed, [database]) == listed
    assert {t: spark.table(t).count() for t in shown} == rows
    assert retirable(spark, layout, 0, [database]) == []
    assert len(set(reachable(spark, table_places(spark, [database])))) >= 7


def test_a_folder_shown_meanwhile_is_kept(spark, layout, database):
    first = run_medallion(spark, layout, database, batch_ts=TS)
    run_medallion(spark, layout, database, batch_ts=LATER)
    listed = retirable(spark, layout, 0, [database])
    parts = {
        f"gold_{n}": Part(layout.runs("gold", n), first.run_id, s.gold_contract())
        for n, s in ENTITIES.items()
    }
    publish_together(spark, database, layout.root, parts)
    gone = retire(spark, layout, listed, [database])
    assert not any(f"/gold/{n}/run={first.run_id}" in f for f in gone for n in ENTITIES)
    assert spark.table(first.gold["teams"]).agg(F.max("gold_loaded_at")).first()[0].year == 2026
