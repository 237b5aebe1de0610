"""The gate between silver and gold."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from orebed.sources.layers import ContractError, stored_schema
from orebed.sources.storage import has_files

FILES = "files"
ROWS = "rows"
REPORT_SCHEMA = "entity string, check_name string, observed bigint, passed boolean, problem string"

NO_FILES = "no files"
FILES_DIFFER = "files of different types"
NO_ROWS = "no rows"
NO_VALUES = "no values"
NO_COLUMN = "no such column"


class QualityError(ValueError):
    """At least one check failed; the message names all that did."""


def _column_check(column: str) -> str:
    return f"column {column}"


def checked(required: Sequence[str]) -> list[str]:
    """Names of the counts that must not be zero."""
    return [ROWS, *map(_column_check, required)]


def _counts(columns: Sequence[str]) -> list:
    return [
        F.count(F.lit(1)).alias(ROWS),
        *[F.count(F.col(c)).alias(_column_check(c)) for c in columns],
    ]


def layer_checks(
    spark: SparkSession, entity: str, path: str, required: Sequence[str]
) -> DataFrame:
    """(entity, check_name, observed, passed, problem) for one layer folder.

    Counts the whole layer in one pass that reads the required columns only. A required
    column must exist in some file and hold a value in at least one row. Without files, or
    if files disagree on a type, nothing else can be said, so that is the only row then.
    """
    if not has_files(spark, path, "*.parquet"):
        return spark.createDataFrame([(entity, FILES, 0, False, NO_FILES)], REPORT_SCHEMA)
    try:
        schema = stored_schema(spark, path)
    except ContractError:
        return spark.createDataFrame([(entity, FILES, 1, False, FILES_DIFFER)], REPORT_SCHEMA)
    layer = spark.read.schema(schema).parquet(path)
    present = [c for c in required if c in layer.columns]
    counts = layer.agg(*_counts(present))
    measured = counts.unpivot([], counts.columns, "check_name", "observed")
    passed = F.col("observed") > 0
    problem = F.when(F.col("check_name") == ROWS, NO_ROWS).otherwise(NO_VALUES)
    rows = measured.select(
        F.lit(entity).alias("entity"), "check_name", "observed",
        passed.alias("passed"), F.when(~passed, problem).alias("problem"),
    )
    absent = [c for c in required if c not in present]
    fixed = [(entity, FILES, 1, True, None)]
    fixed += [(entity, _column_check(c), 0, False, NO_COLUMN) for c in absent]
    return spark.createDataFrame(fixed, REPORT_SCHEMA).unionByName(rows)


def quality_report(
    spark: SparkSession, layers: Mapping[str, tuple[str, Sequence[str]]]
) -> DataFrame:
    """The checks of several layers; ``layers`` maps entity to (path, required columns)."""
    parts = [layer_checks(spark, name, *layer) for name, layer in layers.items()]
    return reduce(DataFrame.unionByName, parts)


def observe_checks(df: DataFrame, required: Sequence[str]) -> tuple[DataFrame, Observation]:
    """Let the write of ``df`` measure the checks, so that the gate needs no second scan."""
    observation = Observation()
    return df.observe(observation, *_counts(required)), observation


def table_checks(df: DataFrame, required: Sequence[str]) -> dict[str, int]:
    """The same counts of a table that is there already."""
    return df.agg(*_counts(required)).first().asDict()


def failed_checks(report: DataFrame) -> list[str]:
    """Names of failed checks, one line each. A report has a handful of rows per entity."""
    failed = report.where(~F.col("passed")).orderBy("entity", "check_name")
    return [f"{row.entity}: {row.check_name}: {row.problem}" for row in failed.collect()]


def require(failures: Sequence[str]) -> None:
    """Fail once, naming every failed check."""
    if failures:
        raise QualityError(f"quality gate failed: {'; '.join(failures)}")
