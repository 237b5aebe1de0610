import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from orebed.operators.merge import (
    consolidate,
    latest_per_key,
    merge_latest,
)
from orebed.session import materialize, new_workspace, shared_root, side_by_side
from orebed.sources.layers import (
    ContractError,
    check_contract,
    cluster,
    column_profile,
    contract_differences,
    contract_report,
    overwrite_partitions,
    publish,
    read_layer,
    write_layer,
)
from orebed.sources.storage import has_files
from orebed.specs import ENTITIES, contract_from_dict, contract_to_dict


def contract(**types):
    kinds = {"s": StringType(), "n": LongType()}
    return StructType([StructField(name, kinds[kind]) for name, kind in types.items()])


def test_contract_sizes():
    sizes = {
        name: (len(spec.silver_contract()), len(spec.gold_contract()))
        for name, spec in ENTITIES.items()
    }
    assert sizes == {"teams": (13, 10), "standings": (16, 21), "matches": (21, 20)}


@pytest.mark.parametrize("mode", ["compat", "strict"])
@pytest.mark.parametrize("name", list(ENTITIES))
def test_contract_as_plain_data(name, mode):
    for declared in (ENTITIES[name].silver_contract(mode), ENTITIES[name].gold_contract(mode)):
        assert contract_from_dict(json.loads(json.dumps(contract_to_dict(declared)))) == declared
        assert all(f.nullable for f in declared.fields)


def test_differences():
    declared = contract(a="s", b="n", c="s")

    def found(actual):
        return {c: status for _, c, _, _, status in contract_differences(actual, declared)}

    assert set(found(declared).values()) == {"ok"}
    assert found(contract(a="s", c="s")) == {"a": "ok", "b": "missing", "c": "ok"}
    assert found(contract(a="s", b="s", c="s"))["b"] == "wrong type"
    assert found(contract(b="n", a="s", c="s")) == {"a": "wrong order", "b": "wrong order", "c": "ok"}
    assert found(contract(a="s", b="n", c="s", d="n"))["d"] == "extra"


@pytest.fixture
def database(spark):
    name = "db_" + new_workspace(spark, "x").rsplit("-", 1)[1]
    spark.sql(f"CREATE DATABASE {name} LOCATION '{new_workspace(spark, 'tables')}'")
    return name


def layer(spark, rows, declared):
    path = new_workspace(spark, "layer")
    write_layer(spark.createDataFrame(rows, declared), path)
    return path


def test_layer_files_are_snappy_parquet(spark):
    path = layer(spark, [("a", 1)], contract(a="s", b="n"))
    files = spark.read.format("binaryFile").load(path).select("path").collect()
    assert files and all(f.path.endswith(".snappy.parquet") for f in files)


def test_publish_and_repoint(spark, database):
    declared, table = contract(a="s", b="n"), f"{database}.t"
    first = layer(spark, [("a", 1)], declared)
    publish(spark, table, first, declared)
    assert spark.table(table).schema == declared
    assert spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where(
        "col_name = 'Type' AND data_type = 'EXTERNAL'"
    ).count() == 1
    publish(spark, table, layer(spark, [("b", 2), ("c", 3)], declared), declared)
    assert sorted(r.a for r in spark.table(table).collect()) == ["b", "c"]
    # The former files are still there, for readers that are on them.
    assert read_layer(spark, first, declared).count() == 1
    wider = contract(a="s", b="n", c="s")
    publish(spark, table, layer(spark, [("d", 4, "x")], wider), wider)
    assert spark.table(table).columns == ["a", "b", "c"]


def test_publish_partitioned_then_plain_and_back(spark, database):
    """The same columns in folders or in files: the table always shows the last ones published."""
    declared, table = contract(a="s", b="n"), f"{database}.t"
    for number, by in enumerate([(), ("b",), (), ("b",), ("b",)]):
        path = new_workspace(spark, "layer")
        write_layer(spark.createDataFrame([("x", number)], declared), path, by)
        publish(spark, table, path, declared, by)
        assert [tuple(r) for r in spark.table(table).collect()] == [("x", number)]


def test_has_files_looks_below_and_not_at_hidden_ones(spark):
    path = new_workspace(spark, "files")
    assert not has_files(spark, path) and not has_files(spark, f"{path}/*")
    frame = spark.createDataFrame([("x", 1), ("y", 2)], contract(a="s", b="n"))
    write_layer(frame.where("b < 0"), f"{path}/none")
    write_layer(frame, f"{path}/some", ["b"])
    assert has_files(spark, f"{path}/some", "*.parquet") and has_files(spark, f"{path}/s*")
    assert not has_files(spark, f"{path}/some", "*.json")


def test_publish_refuses_files_that_do_not_fit(spark, database):
    declared, table = contract(a="s", b="n"), f"{database}.t"
    publish(spark, table, layer(spark, [("a", 1)], declared), declared)
    bad = layer(spark, [("z",)], contract(b="s"))
    with pytest.raises(ContractError, match="a: missing.*b: wrong type"):
        publish(spark, table, bad, declared)
    assert [r.a for r in spark.table(table).collect()] == ["a"]
    check_contract(spark, layer(spark, [], declared), declared)


def test_files_that_disagree_are_refused(spark, database):
    """One file's footer fits the contract; those of the others do not."""
    declared, table = contract(a="s", b="n"), f"{database}.t"
    path = new_workspace(spark, "mixed")
    for rows, kind in (([("a", 1)], "a string, b bigint"), ([("a", "x")], "a string, b string")):
        spark.createDataFrame(rows, kind).write.mode("append").parquet(path)
    with pytest.raises(ContractError, match="different types"):
        publish(spark, table, path, declared)
    path = new_workspace(spark, "mixed")
    for rows, kind in (([("a", 1)], "a string, b bigint"), ([("a", 1, 2)], "a string, b bigint, c int")):
        spark.createDataFrame(rows, kind).write.mode("append").parquet(path)
    with pytest.raises(ContractError, match="c: extra"):
        publish(spark, table, path, declared)


def test_partitioned_tables(spark, database):
    declared, table = contract(d="s", n="n"), f"{database}.t"
    for day in ("a", "b"):
        path = new_workspace(spark, "days")
        rows = spark.createDataFrame([(day, 1), ("c", 2)], declared)
        write_layer(rows, path, partition_by=["d"])
        publish(spark, table, path, declared, partition_by=["d"])
        assert spark.table(table).columns == ["n", "d"]
        assert sorted(r.d for r in spark.table(table).collect()) == [day, "c"]
    one = spark.table(table).where("d = 'c'")
    assert "PartitionFilters: [isnotnull(d" in one._jdf.queryExecution().toString()


def test_contract_report(spark, database):
    declared, table = contract(a="s", b="n"), f"{database}.t"
    publish(spark, table, layer(spark, [("a", 1), (None, 2)], declared), declared)
    asked = contract(a="s", b="s", c="n")
    rows = contract_report(spark, {"t": (table, asked)}).orderBy("position").collect()
    assert [tuple(r) for r in rows] == [
        ("t", 1, "a", "string", "string", "ok", 1),
        ("t", 2, "b", "string", "bigint", "wrong type", 2),
        ("t", 3, "c", "bigint", None, "missing", None),
    ]


def test_column_profile(spark):
    df = spark.createDataFrame([(None, "x"), (1, "y")], "n int, s string")
    assert {tuple(r) for r in column_profile(df).collect()} == {("n", 1), ("s", 2)}


def test_overwrite_partitions(spark):
    path = new_workspace(spark, "parts")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "n int, d string")
    overwrite_partitions(rows, path, ["d"])
    overwrite_partitions(spark.createDataFrame([(9, "b")], "n int, d string"), path, ["d"])
    stored = spark.read.schema("n int, d string").parquet(path)
    assert sorted(map(tuple, stored.collect())) == [(1, "a"), (9, "b")]
    one_day = stored.where("d = 'a'")
    assert "PartitionFilters: [isnotnull(d" in one_day._jdf.queryExecution().toString()


def test_cluster_splits_a_hot_group(spark):
    """Adaptive execution divides the partition of a large group; each part is sorted."""
    rows = spark.range(0, 40000, 1, 8).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("g"),
        F.reverse(F.sha1(F.col("id").cast("string"))).alias("v"),
    )
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200KB")
    try:
        parts = materialize(
            cluster(rows, ["g"], ["g", "v"]).withColumn("part", F.spark_partition_id()), "test"
        )
        hot = parts.where("g = 'hot'").groupBy("part").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert len(hot) > 1
    assert parts.count() == 40000


def test_latest_per_key(spark):
    rows = spark.createDataFrame(
        [("a", 1, 1, "old"), ("a", 2, 1, "tie"), ("a", 2, 2, "new"), (None, 1, 1, "n"), ("b", 1, 1, None)],
        "k string, ts int, seq int, v string",
    )
    latest = latest_per_key(rows, ["k"], ["ts", "seq"])
    assert latest.columns == rows.columns
    assert {r.k: r.v for r in latest.collect()} == {"a": "new", None: "n", "b": None}


def test_merge_latest(spark):
    schema = "k string, ts int, v string"
    current = spark.createDataFrame([("a", 1, "a1"), ("b", 5, "b5")], schema)
    updates = spark.createDataFrame([("b", 4, "late"), ("a", 2, "a2"), ("c", 1, "c1")], schema)
    merged = merge_latest(current, updates.select("v", "k", "ts"), ["k"], ["ts"])
    assert sorted(map(tuple, merged.collect())) == [("a", 2, "a2"), ("b", 5, "b5"), ("c", 1, "c1")]
    again = merge_latest(merged, updates, ["k"], ["ts"])
    assert sorted(again.collect()) == sorted(merged.collect())


def test_merge_combines_before_the_shuffle(spark):
    plan = latest_per_key(
        spark.createDataFrame([("a", 1, "x")], "k string, ts int, v string"), ["k"], ["ts"]
    )._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_max_by") > plan.index("Exchange hashpartitioning")


def test_consolidate(spark):
    frames = {2025: spark.range(2), 2026: spark.range(3)}
    both = consolidate(frames, "season")
    assert sorted(map(tuple, both.groupBy("season").count().collect())) == [(2025, 2), (2026, 3)]


def test_workspaces_are_fresh_and_shared(spark):
    first, second = new_workspace(spark, "x"), new_workspace(spark, "x")
    assert first != second
    assert first.startswith(shared_root(spark)) and second.startswith(shared_root(spark))


def test_side_by_side(spark):
    tasks = {n: (lambda n=n: spark.range(n).count()) for n in (1, 2, 3)}
    assert side_by_side(spark, tasks) == {1: 1, 2: 2, 3: 3}

    def fail():
        raise KeyError("no")

    with pytest.raises(KeyError):
        side_by_side(spark, {"a": fail, "b": lambda: 1})
