"""Every gold row with the landed lines it came from."""

import hashlib
import json

import pytest

from orebed.operators.flatten import flatten
from orebed.plans.gold import gold_matches, gold_teams
from orebed.plans.lineage import LINEAGE, lineage, trace
from orebed.session import new_workspace
from orebed.sources.bronze import read_bronze
from orebed.specs import COMPAT, MATCHES, STRICT, TEAMS


def landed(spark, texts, below=""):
    path = new_workspace(spark, "bronze")
    spark.createDataFrame([(t,) for t in texts], "value string").write.text(f"{path}{below}")
    return path


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("mode", [COMPAT, STRICT])
def test_matches_name_their_lines(spark, mode):
    one = json.dumps({"events": [{"idEvent": "1", "intHomeScore": "2"}, None, {"idEvent": "2", "intHomeScore": "x"}]})
    copy = json.dumps({"n": 1, "events": [{"idEvent": "2", "intHomeScore": "x"}]})
    texts = [one, copy, '{"events": [', '{"events": null}', '{"events": []}']
    path = landed(spark, texts)
    silver = flatten(read_bronze(spark, MATCHES, path), MATCHES, mode)
    lines = lineage(spark, MATCHES, path, mode)
    assert lines.schema.names == LINEAGE.names
    assert [f.dataType for f in lines.schema] == [f.dataType for f in LINEAGE]
    rows = trace(gold_matches(silver, mode), lines, MATCHES).collect()
    found = {(r.match_id, r.line_sha256, r.element_place) for r in rows}
    assert found == {
        ("1", digest(one), 0), (None, digest(one), 1), ("2", digest(one), 2), ("2", digest(copy), 0),
    }
    assert all(path in r.source_file and r.source_block == 0 for r in rows)
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_a_distinct_team_has_all_its_lines_of_its_season(spark):
    texts = [json.dumps({"teams": [{"idTeam": "1", "strTeam": "é", "strWebsite": str(i)}]}) for i in range(3)]
    path = landed(spark, texts, "/league=4429/season=2026")
    spark.createDataFrame([(texts[0],)], "value string").write.text(f"{path}/league=4429/season=2022")
    by = ["league", "season"]
    silver = flatten(read_bronze(spark, TEAMS, path, partition_by=by), TEAMS, keep=by)
    gold = gold_teams(silver, keep=by)
    assert gold.count() == 2
    rows = trace(gold, lineage(spark, TEAMS, path, partition_by=by), TEAMS, by).collect()
    found = {(r.season, r.line_sha256) for r in rows}
    assert found == {("2022", digest(texts[0])), *(("2026", digest(t)) for t in texts)}
    assert {r.league for r in rows} == {"4429"}


def test_different_rows_and_their_lines_meet_by_one_shuffle(spark):
    """Only the key of a gold row moves, and what the caller takes of it."""
    one = json.dumps({"events": [{"idEvent": "1", "strHomeTeam": "a"}, {"idEvent": "1", "strHomeTeam": "a"}]})
    path = landed(spark, [one])
    gold = gold_matches(flatten(read_bronze(spark, MATCHES, path), MATCHES))
    rows = trace(gold, lineage(spark, MATCHES, path), MATCHES)
    assert rows.count() == 2
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = trace(gold, lineage(spark, MATCHES, path), MATCHES).select("match_id", "line_sha256")
        text = plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning") == 2
    assert "Exchange hashpartitioning(_key" in text
