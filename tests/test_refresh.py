"""Published tables brought up to date partition by partition."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from orebed import fixtures
from orebed.operators.quality import QualityError
from orebed.plans.incremental import refresh, refresh_from_stream, shown_run
from orebed.plans.medallion import run_medallion
from orebed.plans.retire import retirable, retire
from orebed.session import materialize, new_workspace
from orebed.sources import snapshot
from orebed.sources.bronze import land_rows, payload_rows, to_lines
from orebed.specs import ENTITIES, INGESTED_AT, MATCHES, Layout

SMALL, BY = "/root/testdata/sf0.001", ["season"]
TS, LATER = datetime(2026, 1, 1), datetime(2027, 1, 1)


@pytest.fixture(scope="module")
def sources(spark):
    contests = fixtures.contests(spark, SMALL).withColumn("season", F.substring("match_date", 1, 4))
    few = {"teams": fixtures.profiles(spark, SMALL).limit(20), "standings": fixtures.standings(spark, SMALL).limit(20)}
    few = {n: rows.withColumn("season", F.lit("1997")) for n, rows in few.items()}
    return {n: materialize(rows, "few") for n, rows in (few | {"matches": contests}).items()}


@pytest.fixture
def published(spark, sources):
    layout = Layout(new_workspace(spark, "seasons"))
    for name, rows in sources.items():
        land_rows(rows, ENTITIES[name], layout.bronze(name), BY)
    database = "run_" + layout.root.rsplit("-", 1)[1]
    spark.sql(f"CREATE DATABASE {database} LOCATION '{layout.root}/tables'")
    run = run_medallion(spark, layout, database, batch_ts=TS, partition_by=BY)
    return layout, database, run


def files(spark, table):
    found = spark.table(table).select("season", F.input_file_name()).distinct().collect()
    out = {}
    for season, name in found:
        out.setdefault(season, set()).add(name)
    return out


def scores(spark, table):
    return {r.match_id: (r.season, r.home_score, r.result) for r in spark.table(table).collect()}


def changes(sources, season="1997"):
    """Ten matches of a season end 99 to 0, and there is a new one."""
    some = sources["matches"].where(f"season = '{season}'").orderBy("match_id").limit(10)
    ended = some.withColumns({"home_score": F.lit("99"), "away_score": F.lit("0")})
    new = some.limit(1).withColumns({"match_id": F.lit(f"new-{season}"), "home_score": F.lit("7"), "away_score": F.lit("1")})
    return materialize(ended.unionByName(new).withColumn(INGESTED_AT, F.lit(LATER)), "changes")


def test_a_refresh_is_what_a_whole_run_would_give(spark, sources, published):
    layout, database, run = published
    gold, silver = run.gold["matches"], run.silver["matches"]
    before, others = scores(spark, gold), files(spark, gold)
    changed = changes(sources)
    touched = refresh(spark, layout, database, MATCHES, changed, ["match_id"], BY, batch_ts=LATER)
    assert [r.season for r in touched] == ["1997"]
    after, now = scores(spark, gold), files(spark, gold)
    assert {s: f for s, f in now.items() if s != "1997"} == {s: f for s, f in others.items() if s != "1997"}
    assert not now["1997"] & others["1997"] and len(others) > 3
    expected = dict(before)
    for r in changed.collect():
        label = "Home Win"
        expected[r.match_id] = ("1997", r.home_score, label)
    assert after == expected
    assert spark.table(silver).count() == len(expected)
    # Other tables did not move, and an older version changes nothing.
    old = changed.withColumns({INGESTED_AT: F.lit(datetime(2020, 1, 1)), "home_score": F.lit("5")})
    refresh(spark, layout, database, MATCHES, old, ["match_id"], BY, batch_ts=LATER)
    assert scores(spark, gold) == expected
    assert refresh(spark, layout, database, MATCHES, changed.limit(0), ["match_id"], BY) == []


def test_shared_folders_are_not_retired(spark, sources, published):
    layout, database, run = published
    gold = run.gold["matches"]
    for season in ("1997", "1996"):
        refresh(spark, layout, database, MATCHES, changes(sources, season), ["match_id"], BY)
    expected = scores(spark, gold)
    listed = retirable(spark, layout, 0, [database])
    # The first run is still shown for all other seasons, the first refresh for 1997.
    assert not any("/matches/run=" in f for f in listed)
    retire(spark, layout, listed, [database])
    assert scores(spark, gold) == expected
    run_medallion(spark, layout, database, batch_ts=TS, partition_by=BY)
    listed = retirable(spark, layout, 0, [database])
    assert sum("/gold/matches/run=" in f for f in listed) == 3
    retire(spark, layout, listed, [database])
    assert len(scores(spark, gold)) == sources["matches"].count()


def test_failures_change_nothing(spark, sources, published, monkeypatch):
    layout, database, run = published
    gold = run.gold["matches"]
    before = scores(spark, gold)
    bad = changes(sources, "1998").withColumn("season", F.lit("2050")).withColumn("home_team_id", F.lit(None).cast("string"))
    with pytest.raises(QualityError, match="home_team_id"):
        refresh(spark, layout, database, MATCHES, bad, ["match_id"], BY)

    def die(*_):
        raise RuntimeError("killed")

    monkeypatch.setattr(snapshot, "switch", die)
    with pytest.raises(RuntimeError, match="killed"):
        refresh(spark, layout, database, MATCHES, changes(sources), ["match_id"], BY)
    monkeypatch.undo()
    assert scores(spark, gold) == before


def test_a_stream_feeds_the_published_tables(spark, sources, published):
    layout, database, run = published
    gold, path = run.gold["matches"], layout.bronze("matches")
    progress = f"{layout.root}/progress"

    def stream():
        refresh_from_stream(spark, layout, database, MATCHES, ["match_id"], BY, progress).awaitTermination()
        spark.sql(f"REFRESH TABLE {database}.published")
        return shown_run(spark, database, "gold_matches")

    first = stream()
    assert first.startswith("stream-") and len(scores(spark, gold)) == sources["matches"].count()
    rows = changes(sources).drop(INGESTED_AT)
    lines = to_lines(payload_rows(rows, MATCHES, BY), BY)
    lines.write.mode("append").partitionBy("season").text(path)
    second = stream()
    assert second > first
    after = scores(spark, gold)
    assert after["new-1997"] == ("1997", "7", "Home Win")
    ended = {r.match_id for r in rows.where("home_score = '99'").collect()}
    assert len(ended) == 10 and all(after[m] == ("1997", "99", "Home Win") for m in ended)
    assert stream() == second
