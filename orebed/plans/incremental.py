"""Published tables brought up to date by changed rows, partition by partition.

A refresh is a run that has folders of its own for the leagues and seasons that changed, and
shares those of all others with the run before it. All its tables change by the same one step
as those of a whole run.
"""

from __future__ import annotations

import logging
import uuid
import zlib
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from orebed.operators.flatten import flatten
from orebed.operators.merge import merge_by_join
from orebed.operators.quality import checked, observe_checks, require
from orebed.plans.medallion import silver_to_gold, with_folders
from orebed.session import materialize
from orebed.sources.layers import (
    POINTER,
    pointer_rows,
    read_layer,
    view_storage,
    write_layer,
)
from orebed.sources.partitions import rows_of_partitions
from orebed.sources.snapshot import Part, partition_locations, publish_together
from orebed.specs import COMPAT, INGESTED_AT, EntitySpec, Layout

log = logging.getLogger(__name__)


def _shared(
    spark: SparkSession, table: str, touched: Sequence[Row], partition_by: Sequence[str]
) -> dict[tuple[str | None, ...], str]:
    """Folders of the partitions that a table shows now and that stay as they are."""
    storage = view_storage(spark, table)
    _, run = pointer_rows(spark, table.rsplit(".", 1)[0])[storage]
    gone = {tuple(row[c] for c in partition_by) for row in touched}
    there = partition_locations(spark, storage, run)
    return {values: place for values, place in there.items() if values not in gone}


def refresh(
    spark: SparkSession, layout: Layout, database: str, spec: EntitySpec, changed: DataFrame,
    keys: Sequence[str], partition_by: Sequence[str], mode: str = COMPAT,
    batch_ts: datetime | None = None, run_id: str | None = None,
) -> list[Row]:
    """Bring the published silver and gold tables of an entity up to date with ``changed`` rows
    (silver columns and those of ``partition_by``), as a whole run over old and changed payloads
    would, but for keeping one row per key: the latest by load time. Returns the partitions
    written; the files of all others stay and are shared.

    The tables are those of a ``run_medallion`` with the same ``partition_by``, which must have
    one row per key (``keys``, never in two partitions) and may have any number of partitions.
    A partition that fails the gate changes nothing, and neither does a failure.
    """
    run_id = run_id or uuid.uuid4().hex
    silver_table, gold_table = (f"{database}.{layer}_{spec.name}" for layer in ("silver", "gold"))
    contract = with_folders(spec.silver_contract(mode), partition_by)
    changed = materialize(changed.select(*contract.names), "changed")
    touched = changed.select(*partition_by).distinct().collect()
    if not touched:
        return []
    stored = spark.table(silver_table)
    if stored.schema != contract:
        raise ValueError(f"{silver_table} has another contract")
    parts = {
        f"{layer}_{spec.name}": Part(
            layout.runs(layer, spec.name), run_id, with_folders(own, partition_by),
            tuple(partition_by), _shared(spark, f"{database}.{layer}_{spec.name}", touched, partition_by),
        )
        for layer, own in (("silver", spec.silver_contract(mode)), ("gold", spec.gold_contract(mode)))
    }
    silver, gold = parts[f"silver_{spec.name}"], parts[f"gold_{spec.name}"]
    current = rows_of_partitions(stored, touched, partition_by)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    merged = merge_by_join(current, changed, keys, [INGESTED_AT], tasks)
    observed, counts = observe_checks(merged.select(*contract.names), spec.required)
    write_layer(observed, silver.path, partition_by)
    found = counts.get
    require([f"{spec.name}: {check}" for check in checked(spec.required) if found[check] == 0])
    rows = {spec.name: read_layer(spark, silver.path, silver.columns)}
    # Only the entity's own table is built.
    build = silver_to_gold(_only(rows), mode, batch_ts, partition_by)[spec.name]
    write_layer(build().select(*gold.columns.names), gold.path, partition_by)
    publish_together(spark, database, layout.root, parts)
    log.info("%s: %d partitions written", gold_table, len(touched))
    return touched


class _only(dict):
    """Silver of one entity; the others are not looked at."""

    def __missing__(self, key: str) -> None:
        return None


def _stream_run(checkpoint: str, number: int) -> str:
    return f"stream-{zlib.crc32(checkpoint.encode()):08x}-{number:010d}"


def shown_run(spark: SparkSession, database: str, table: str) -> str:
    return pointer_rows(spark, database)[view_storage(spark, f"{database}.{table}")][1]


def refresh_from_stream(
    spark: SparkSession, layout: Layout, database: str, spec: EntitySpec, keys: Sequence[str],
    partition_by: Sequence[str], checkpoint: str, files_per_batch: int | None = None,
) -> StreamingQuery:
    """Refresh the published tables with all payloads that have landed since the last time.

    The run shown after a batch is named after it, so the step that shows its rows says that it
    is done: a batch that runs again changes nothing. Rows without a key are left out.
    """
    folders = [StructField(name, StringType()) for name in partition_by]
    schema = StructType([*spec.raw_schema().fields, *folders])
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # Load time is when a payload landed, so that of two in one batch the later one counts.
    landed = F.col("_metadata.file_modification_time").alias(INGESTED_AT)
    lines = reader.json(layout.bronze(spec.name)).select(spec.array, *partition_by, landed)

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        run = _stream_run(checkpoint, number)
        session.sql(f"REFRESH TABLE {database}.{POINTER}")
        shown = shown_run(session, database, f"gold_{spec.name}")
        if shown.startswith(run[: run.rindex("-")]) and shown >= run:
            return
        rows = flatten(batch, spec, keep=[INGESTED_AT, *partition_by])
        known = rows.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
        refresh(session, layout, database, spec, known, keys, partition_by, run_id=run)

    return (
        lines.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
