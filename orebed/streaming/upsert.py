"""A stream of payloads kept as a table of the latest version of every row.

Each micro-batch is merged into a bucketed state. The state's folder carries the number of the
batch that made it, so the step that shows a batch's rows also says that the batch is done: one
that runs again after a failure finds its number there and changes nothing.

Lines that are no such payload, lack the array, or hold rows without a key go to a folder of
dead letters, one folder per batch, with the reason; they are counted while the batch is read,
and too many broken ones stop the stream before the state changes.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import (
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

from orebed.operators.quality import QualityError
from orebed.operators.state import merge_into_state
from orebed.session import materialize
from orebed.sources.bronze import BROKEN, LINES, observe_lines
from orebed.sources.layers import location_of
from orebed.specs import EntitySpec

#: When a payload landed: the time its file was written.
LANDED_AT = "landed_at"
NO_PAYLOAD, NO_ARRAY, NO_KEY = "broken line", "line without array", "row without key"
DEAD = StructType([StructField(c, StringType()) for c in ("reason", "line", "source_file")])

_BROKEN, _FILE = "_broken", "_file"


def stream_lines(
    spark: SparkSession, spec: EntitySpec, path: str, files_per_batch: int | None = None
) -> DataFrame:
    """New payload files of a bronze folder: the array, the text of lines that are no such
    payload, file and landing time. ``files_per_batch`` limits what one batch admits."""
    schema = StructType([*spec.raw_schema().fields, StructField(_BROKEN, StringType())])
    reader = spark.readStream.schema(schema).option("columnNameOfCorruptRecord", _BROKEN)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path).select(
        spec.array, _BROKEN, F.col("_metadata.file_path").alias(_FILE),
        F.col("_metadata.file_modification_time").alias(LANDED_AT),
    )


def rows_of(spec: EntitySpec, lines: DataFrame) -> DataFrame:
    """One row per element, with the time it landed."""
    elements = lines.select(F.explode(spec.array).alias("element"), _FILE, LANDED_AT)
    fields = [F.col(f"element.{f.raw}").alias(f.column) for f in spec.fields]
    return elements.select(*fields, LANDED_AT, _FILE)


def state_schema(spec: EntitySpec) -> StructType:
    text = [StructField(name, StringType()) for name in spec.columns]
    return StructType(text).add(LANDED_AT, TimestampType())


def _missing(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))


def _dead_letters(spec: EntitySpec, lines: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    broken = lines.where(F.col(_BROKEN).isNotNull()).select(
        F.lit(NO_PAYLOAD).alias("reason"), F.col(_BROKEN).alias("line"), F.col(_FILE).alias("source_file")
    )
    silent = lines.where(F.col(_BROKEN).isNull() & F.col(spec.array).isNull()).select(
        F.lit(NO_ARRAY).alias("reason"), F.lit(None).cast("string").alias("line"),
        F.col(_FILE).alias("source_file"),
    )
    element = F.to_json(F.struct(*(F.col(f.column).alias(f.raw) for f in spec.fields)))
    keyless = rows.where(_missing(keys)).select(
        F.lit(NO_KEY).alias("reason"), element.alias("line"), F.col(_FILE).alias("source_file")
    )
    return broken.unionByName(silent).unionByName(keyless)


def stream_name(checkpoint: str) -> str:
    """A stream is known by its checkpoint; batches are numbered within it."""
    return f"{zlib.crc32(checkpoint.encode()):08x}"


def last_batch(spark: SparkSession, table: str, checkpoint: str) -> int:
    """The last batch of this stream that the state holds, or -1."""
    *_, stream, batch = location_of(spark, table).rsplit("/", 2)
    if stream != f"stream={stream_name(checkpoint)}":
        return -1
    return int(batch.removeprefix("batch=").split("-")[0])


def batch_writer(
    spec: EntitySpec, table: str, keys: Sequence[str], order_by: Sequence[str], root: str,
    checkpoint: str, broken_share: float,
) -> Callable[[DataFrame, int], None]:
    """What is done with a batch of lines; see ``upsert_available``."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        spark.sql(f"REFRESH TABLE {table}")
        if number <= last_batch(spark, table, checkpoint):
            return
        counted, observation = observe_lines(batch, spec, _BROKEN, keep=True)
        lines = materialize(counted, "stream-lines")
        counts = observation.get
        rows = rows_of(spec, lines)
        place = f"stream={stream_name(checkpoint)}/batch={number}"
        # A batch that runs again writes the same folder again.
        letters = _dead_letters(spec, lines, rows, keys)
        letters.write.mode("overwrite").parquet(f"{root}/dead/{place}")
        if counts[BROKEN] > broken_share * counts[LINES]:
            raise QualityError(f"{counts[BROKEN]} of {counts[LINES]} lines are broken")
        known = rows.where(~_missing(keys)).drop(_FILE)
        merge_into_state(
            spark, table, known, keys, order_by, f"{root}/state/{place}-{uuid.uuid4().hex}"
        )

    return write


def upsert_available(
    lines: DataFrame, spec: EntitySpec, table: str, keys: Sequence[str], order_by: Sequence[str],
    root: str, checkpoint: str, broken_share: float = 1.0,
) -> StreamingQuery:
    """Merge all lines that are there now into the state ``table`` and stop. The latest row of a
    key in ``order_by`` wins, whichever batch it comes in. Dead letters go below ``root``. A
    batch with more than ``broken_share`` of broken lines fails, its letters written, the state
    as it was; it is tried again by the next start."""
    write = batch_writer(spec, table, keys, order_by, root, checkpoint, broken_share)
    return (
        lines.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_dead_letters(spark: SparkSession, root: str) -> DataFrame:
    """(reason, line, source_file, stream, batch) of all batches."""
    schema = StructType(DEAD.fields).add("stream", StringType()).add("batch", LongType())
    return spark.read.schema(schema).parquet(f"{root}/dead")
