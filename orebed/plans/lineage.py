"""Which landed line every gold row came from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from orebed.operators.flatten import flatten
from orebed.plans.gold import gold_matches
from orebed.specs import COMPAT, MATCHES, EntitySpec

GOLD_KEY = "gold_key"
LINE = ("line_sha256", "source_file", "source_block", "element_place")
LINEAGE = StructType(
    [
        StructField(name, kind)
        for name, kind in zip(
            (GOLD_KEY, *LINE), (StringType(), StringType(), StringType(), LongType(), IntegerType())
        )
    ]
)


def gold_key(spec: EntitySpec, partition_by: Sequence[str] = ()) -> Column:
    """A digest of what a gold row took over from silver: equal rows share it."""
    columns = F.struct(*spec.gold_columns, *partition_by)
    return F.sha2(F.to_json(columns, {"ignoreNullFields": "false"}), 256).alias(GOLD_KEY)


def lineage(
    spark: SparkSession, spec: EntitySpec, bronze_path: str, mode: str = COMPAT,
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """(gold_key, line_sha256, source_file, source_block, element_place) of every element landed:
    the digest of its line's text, the file, where in the file the part begins that was read
    together with it, and its place in the line's array. One more read of the bronze folder, as
    text; no shuffle."""
    folders = [StructField(name, StringType()) for name in partition_by]
    text = spark.read.schema(StructType([StructField("value", StringType()), *folders]))
    lines = text.text(bronze_path).select(
        F.from_json("value", spec.raw_schema()).alias("payload"),
        F.sha2("value", 256).alias(LINE[0]), F.col("_metadata.file_path").alias(LINE[1]),
        F.col("_metadata.file_block_start").alias(LINE[2]), *partition_by,
    )
    elements = lines.select(
        F.posexplode(F.col("payload")[spec.array]).alias(LINE[3], "element"), *LINE[:3],
        *partition_by,
    )
    one = elements.withColumn(spec.array, F.array("element"))
    # The same projection that silver has, beside the line; then what gold makes of it.
    rows = flatten(one, spec, mode, keep=[*LINE, *partition_by], traced=False)
    if spec.name == MATCHES.name:
        rows = gold_matches(rows, mode, keep=[*LINE, *partition_by])
    return rows.select(gold_key(spec, partition_by), *LINE)


def trace(
    gold: DataFrame, lines: DataFrame, spec: EntitySpec, partition_by: Sequence[str] = ()
) -> DataFrame:
    """Each different row of ``gold`` with each line it came from: its columns and those of
    ``lines``. A row that was landed several times has several lines."""
    columns = [*spec.gold_columns, *partition_by]
    # Half as many bytes to move as the key's text. One shuffle by it serves both the choice of
    # different rows and the join, and takes no column along that the caller has no use for.
    key = F.unhex(GOLD_KEY).alias("_key")
    rows = gold.select(*columns, gold_key(spec, partition_by)).select(*columns, key)
    landed = lines.select(key, *LINE)
    return rows.dropDuplicates(["_key"]).join(landed, "_key").drop("_key")
