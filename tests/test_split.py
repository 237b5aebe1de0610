"""Long payloads cut by many tasks, against the plain reader."""

import json
import random

import pytest
from pyspark.sql import functions as F

from orebed.session import new_workspace
from orebed.sources.split import SplitError, _beginnings, _summaries, _texts, split_payloads

SCHEMA = "events array<struct<id: string, name: string, deep: string>>"


@pytest.fixture
def pieces(spark):
    """Files are read in pieces of 1,500 bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "1500b")
    spark.conf.set(names[1], "1b")
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def land(spark, texts):
    path = new_workspace(spark, "payloads")
    # One file each: the plain reader takes one payload from a file that has line ends within.
    apart = spark.sparkContext.parallelize([(t,) for t in texts], len(texts))
    spark.createDataFrame(apart, "value string").write.text(path)
    return path


def element(rng, i):
    name = "".join(rng.choice(['"', "\\", ",", "[", "]", "{", "}", "é", "x", ":", " ", '","', "events"]) for _ in range(rng.randint(0, 40)))
    out = {"id": str(i), "name": name}
    if rng.random() < 0.5:
        out["deep"] = json.dumps({"events": [1, {"events": [name]}]})
    if rng.random() < 0.3:
        out["more"] = {"events": [{"id": "not me"}], "a,b": [[], {}]}
    return out


def rows(spark, path, **options):
    read = spark.read.options(**options).schema(SCHEMA).json(path)
    found = read.select(F.explode("events").alias("e")).select("e.*")
    return sorted(map(tuple, found.collect()), key=repr)


@pytest.mark.parametrize("indent", [None, 1])
def test_same_rows_as_the_plain_reader(spark, pieces, indent):
    rng = random.Random(1)
    payloads = [
        {"count": 3, "x": [{"id": "no"}], "events": [element(rng, i) for i in range(n)], "é": "[{"}
        for n in (200, 0, 1, 37)
    ]
    payloads += [{"events": None}, {"events": "No data"}, {"events": {"id": ["x"]}}, {"y": 1}, {"events": [None, {"id": "last"}]}]
    path = land(spark, [json.dumps(p, indent=indent, ensure_ascii=i % 2 == 0) for i, p in enumerate(payloads)])
    expected = rows(spark, path, multiLine=indent is not None)
    assert len(expected) > 230
    out = new_workspace(spark, "split")
    split_payloads(spark, path, out, "events", per_line=7)
    assert rows(spark, out) == expected
    lines = spark.read.text(out)
    assert lines.count() >= len(expected) // 7
    sizes = spark.read.schema(SCHEMA).json(out).agg(F.max(F.size("events"))).first()[0]
    assert sizes <= 7


def test_one_line_is_read_by_many_tasks(spark, pieces):
    rng = random.Random(2)
    path = land(spark, [json.dumps({"events": [element(rng, i) for i in range(400)]})])
    texts = _texts(spark, path)
    begins = _beginnings(_summaries(texts))
    # As many pieces as the file has, each begun in the state that the ones before left.
    assert len(begins) > 30
    assert texts.rdd.getNumPartitions() >= 8
    assert any(s.inside for s in begins.values()) and any(len(s.open) > 2 for s in begins.values())


def test_one_element_longer_than_pieces(spark, pieces):
    long = {"id": "1", "name": ",".join("abc" for _ in range(1000)), "deep": "z"}
    path = land(spark, [json.dumps({"events": [{"id": "0"}, long, {"id": "2"}]})])
    out = new_workspace(spark, "split")
    split_payloads(spark, path, out, "events")
    assert rows(spark, out) == rows(spark, path)


def test_several_payloads_in_a_file(spark, pieces):
    path = new_workspace(spark, "payloads")
    lines = [json.dumps({"events": [{"id": f"{i}-{j}"} for j in range(i % 9)]}) for i in range(80)]
    spark.createDataFrame([(t,) for t in lines], "value string").coalesce(1).write.text(path)
    out = new_workspace(spark, "split")
    split_payloads(spark, path, out, "events")
    assert rows(spark, out) == rows(spark, path)


@pytest.mark.parametrize("text", ['{"events":[{"id":"1"}', '{"events":[]}]', '{"events":["x}', "[" * 3000])
def test_broken_payloads_fail_before_anything_is_written(spark, pieces, text):
    path, out = land(spark, [text]), new_workspace(spark, "split")
    with pytest.raises(SplitError):
        split_payloads(spark, path, out, "events")


def test_nothing(spark):
    path = land(spark, [""])
    out = new_workspace(spark, "split")
    split_payloads(spark, path, out, "events")
    assert rows(spark, out) == []
