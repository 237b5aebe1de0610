import pytest

from orebed.operators.quality import (
    QualityError,
    failed_checks,
    layer_checks,
    observe_checks,
    quality_report,
    require,
)
from orebed.session import new_workspace
from orebed.sources.layers import write_layer


def layer(spark, rows, schema="id string, name string"):
    path = new_workspace(spark, "layer")
    write_layer(spark.createDataFrame(rows, schema), path)
    return path


def checks(spark, path, required=("id", "name")):
    return {
        r.check_name: (r.observed, r.passed, r.problem)
        for r in layer_checks(spark, "e", path, required).collect()
    }


def test_good_layer(spark):
    assert checks(spark, layer(spark, [("1", "a"), ("2", None)])) == {
        "files": (1, True, None),
        "rows": (2, True, None),
        "column id": (2, True, None),
        "column name": (1, True, None),
    }


def test_no_files(spark):
    assert checks(spark, new_workspace(spark, "absent")) == {"files": (0, False, "no files")}


def test_no_rows(spark):
    found = checks(spark, layer(spark, []))
    assert found["files"][1] and found["rows"] == (0, False, "no rows")


def test_missing_and_empty_columns(spark):
    found = checks(spark, layer(spark, [("1", None)]), ("id", "name", "points"))
    assert found["column name"] == (0, False, "no values")
    assert found["column points"] == (0, False, "no such column")


def test_empty_first_file_does_not_matter(spark):
    path = new_workspace(spark, "layer")
    rows = spark.range(0, 80, 1, 8).selectExpr("cast(id as string) id", "cast(id as string) name")
    write_layer(rows.where("cast(id as int) >= 70"), path)
    assert checks(spark, path)["rows"] == (10, True, None)


def test_all_failures_in_one_error(spark):
    report = quality_report(
        spark,
        {
            "good": (layer(spark, [("1", "a")]), ["id"]),
            "empty": (layer(spark, []), ["id"]),
            "absent": (new_workspace(spark, "absent"), ["id"]),
        },
    )
    failures = failed_checks(report)
    assert failures == ["absent: files: no files", "empty: column id: no values", "empty: rows: no rows"]
    with pytest.raises(QualityError) as error:
        require(failures)
    assert all(failure in str(error.value) for failure in failures)
    require([])


def test_observed_by_the_write(spark):
    df = spark.createDataFrame([("1", None), ("2", "b")], "id string, name string")
    observed, observation = observe_checks(df, ["id", "name"])
    write_layer(observed, new_workspace(spark, "layer"))
    assert observation.get == {"rows": 2, "column id": 2, "column name": 1}


def test_reads_required_columns_only(spark):
    path = layer(spark, [("1", "a", "b")], "id string, name string, wide string")
    plan = layer_checks(spark, "e", path, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:string>" in plan
