"""Growing sources: read new files as a stream and drop repeated deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from orebed.specs import EntitySpec


def stream_layer(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """New Parquet files of a folder, with ``delivery``: a number fixed by where a row is
    stored, hence different for copies of a row and equal when a task runs again."""
    place = F.xxhash64("_metadata.file_path", "_metadata.row_index")
    return spark.readStream.schema(schema).parquet(path).withColumn("delivery", place)


def stream_bronze(spark: SparkSession, spec: EntitySpec, path: str) -> DataFrame:
    """New payload files of a bronze folder as flat rows. JSON numbers no rows, so
    ``delivery`` follows from the part of a file that was read together."""
    place = F.xxhash64("_metadata.file_path", "_metadata.file_block_start")
    payloads = spark.readStream.schema(spec.raw_schema()).json(path)
    return (
        payloads.select(place.alias("delivery"), F.explode(spec.array).alias("element"))
        .select("delivery", *[F.col(f"element.{f.raw}").alias(f.column) for f in spec.fields])
    )


def dedupe_stream(
    stream: DataFrame, key: str, event_time: Column, delay: str, spread: int | None = None
) -> DataFrame:
    """One row per ``key`` among rows that arrive within ``delay`` of each other.

    A streaming shuffle cannot combine before it moves rows, so copies of a hot key are
    first dropped on ``spread`` places at once (by default four per shuffle partition, which
    evens out how they hash); at most that many reach the second step. A key without copies
    costs one entry of state in each step, whatever the spread. Rows without an event time
    are compared with the rows of their own batch only. Rows without a key are copies of each
    other only if they agree in all columns.
    """
    if spread is None:
        spread = 4 * int(stream.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = [c for c in stream.columns if c != "delivery"]
    part = F.pmod(F.col("delivery"), F.lit(spread))
    return (
        stream.withColumn("_event_time", event_time)
        .withColumn("_part", part)
        .withColumn("_keyless", F.when(F.col(key).isNull(), F.xxhash64(*values)))
        .drop("delivery")
        .withWatermark("_event_time", delay)
        .dropDuplicatesWithinWatermark([key, "_keyless", "_part"])
        .dropDuplicatesWithinWatermark([key, "_keyless"])
        .drop("_event_time", "_part", "_keyless")
    )


def append_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append all that is there now to a Parquet folder, exactly once, and stop."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
