"""Raw payloads: filtering, landing and reading line-delimited JSON."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from orebed.sources.storage import has_files
from orebed.specs import EntitySpec

# JSON text of the values that count as empty; zero has many spellings.
EMPTY_JSON = ["null", "false", '""', "[]", "{}"]
ZERO_JSON = r"^-?0(\.0*)?([eE][+-]?[0-9]+)?$"


# What is counted of the lines of a bronze folder.
LINES = "lines"
BROKEN = "broken lines"
WITHOUT_ARRAY = "lines without array"


def keep_payloads(lines: DataFrame, column: str = "value") -> DataFrame:
    """Keep the lines that are JSON objects with at least one non-empty top-level value.

    Broken text, scalars and lists are no payload and drop out as well. Values are looked
    at as plain text first, which settles nearly every line. Text cannot tell the number 0
    from the string "0", so lines with nothing clearer are parsed again with types.
    """
    plain = F.map_values(F.from_json(column, "map<string,string>"))
    typed = F.map_values(F.from_json(column, "map<string,variant>"))

    def clearly_something(value: Column) -> Column:
        return ~(value.isin("", *EMPTY_JSON) | value.rlike(ZERO_JSON))

    def something(value: Column) -> Column:
        text = F.to_json(value)
        return ~(text.isin(EMPTY_JSON) | text.rlike(ZERO_JSON))

    return lines.where(
        F.coalesce(F.exists(plain, clearly_something), F.lit(False)) | F.exists(typed, something)
    )


def keep_non_empty(payloads: DataFrame) -> DataFrame:
    """The same choice for payloads that are still columns, all of them arrays: keep those
    with an element in any."""
    filled = [F.coalesce(F.size(c) > 0, F.lit(False)) for c in payloads.columns]
    return payloads.where(reduce(Column.__or__, filled))


def payload_rows(
    rows: DataFrame, spec: EntitySpec, partition_by: Sequence[str] = ()
) -> DataFrame:
    """Rows in silver shape as payloads of one element each: no shuffle, and files that
    any number of tasks can split. Columns of ``partition_by`` stay beside the payload."""
    element = F.struct(*[F.col(f.column).alias(f.raw) for f in spec.fields])
    return rows.select(F.array(element).alias(spec.array), *partition_by)


def to_lines(payloads: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """One JSON document per row, in a column ``value``, beside columns of ``partition_by``."""
    fields = [c for c in payloads.columns if c not in partition_by]
    return payloads.select(F.to_json(F.struct(*fields)).alias("value"), *partition_by)


def land_lines(lines: DataFrame, path: str) -> None:
    """Write the lines worth keeping as a bronze folder, replacing what is there."""
    keep_payloads(lines).select("value").write.mode("overwrite").text(path)


def land_rows(
    rows: DataFrame, spec: EntitySpec, path: str, partition_by: Sequence[str] = ()
) -> None:
    """Write rows in silver shape as a bronze folder, one payload each; none is empty. With
    ``partition_by``, one folder for each league, season or whatever the columns hold."""
    lines = to_lines(payload_rows(rows, spec, partition_by), partition_by)
    writer = lines.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).text(path)


def land_payloads(payloads: DataFrame, path: str) -> None:
    """Write payloads worth keeping as a bronze folder. The choice is made before the JSON
    text exists, which is cheaper than to parse that text again."""
    to_lines(keep_non_empty(payloads)).write.mode("overwrite").text(path)


def read_bronze(
    spark: SparkSession,
    spec: EntitySpec,
    path: str,
    columns: Iterable[str] | None = None,
    broken: str | None = None,
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Read a bronze folder with the entity's schema: no inference pass, stable types.
    Lines of another shape read as a NULL array; a column ``broken``, if named, then holds
    the text of those that are no such JSON at all. ``partition_by`` names the folders below
    ``path`` (``league=...``), which become text columns; a filter on one opens its folders only."""
    schema = spec.raw_schema(columns)
    schema = StructType([*schema.fields, *(StructField(c, StringType()) for c in partition_by)])
    if broken is None:
        return spark.read.schema(schema).json(path)
    schema = StructType([*schema.fields, StructField(broken, StringType())])
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", broken).json(path)


def observe_lines(
    bronze: DataFrame, spec: EntitySpec, broken: str, keep: bool = False
) -> tuple[DataFrame, Observation]:
    """Let whatever reads ``bronze`` count its lines, those that are broken, and those that
    are not but lack the entity's array. The column ``broken`` goes unless ``keep`` is set."""
    array, text = F.col(spec.array), F.col(broken)
    observation = Observation()
    counted = bronze.observe(
        observation,
        F.count(F.lit(1)).alias(LINES),
        F.count(text).alias(BROKEN),
        F.count_if(array.isNull() & text.isNull()).alias(WITHOUT_ARRAY),
    )
    return (counted if keep else counted.drop(broken)), observation


def missing_inputs(spark: SparkSession, paths: Iterable[str]) -> list[str]:
    """The paths that hold no file yet."""
    return [path for path in paths if not has_files(spark, path)]
