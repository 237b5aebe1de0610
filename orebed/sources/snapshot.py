"""Tables published together, by one switch.

Each table is a view over a storage table whose partitions are runs. A small table, the
pointer, has one row per storage table: the run that its view shows. A run first adds its
folders as partitions, which no view shows yet, and then replaces the pointer's rows by giving
it a new folder, in one step. Whatever fails before that step leaves all tables as they were.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orebed.sources.layers import (
    POINTER,
    RUN,
    RUNS,
    STORAGE,
    check_contract,
    partitioned,
    pointer_rows,
    view_storage,
)
from orebed.sources.partitions import listed_partitions, partition_columns, quoted

POINTER_SCHEMA = "table_name string, storage string, run string"


@dataclass(frozen=True)
class Part:
    """One table of a snapshot: its files are in ``<root>/run=<run>``, but for partitions that
    are ``shared`` with former runs: their values as text, and where they are."""

    root: str
    run: str
    contract: StructType
    partition_by: Sequence[str] = field(default=())
    shared: Mapping[tuple[str | None, ...], str] = field(default_factory=dict)

    @property
    def path(self) -> str:
        return f"{self.root}/{RUN}={self.run}"

    @property
    def columns(self) -> StructType:
        return partitioned(self.contract, self.partition_by)


def storage_name(table: str, part: Part) -> str:
    """Tables of another contract are stored apart, as their files cannot be read together."""
    described = json.dumps([part.columns.jsonValue(), list(part.partition_by), part.root])
    return f"{table}_runs_{zlib.crc32(described.encode()):08x}"


def _create_storage(spark: SparkSession, storage: str, part: Part) -> None:
    if spark.catalog.tableExists(storage):
        return
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in part.columns.fields)
    by = ", ".join([f"`{RUN}`", *(f"`{c}`" for c in part.partition_by)])
    spark.sql(
        f"CREATE TABLE {storage} ({columns}, `{RUN}` string) USING PARQUET "
        f"PARTITIONED BY ({by}) LOCATION {quoted(part.root)} "
        f"TBLPROPERTIES ({quoted(RUNS)} = 'true')"
    )


def _add_run(spark: SparkSession, storage: str, part: Part) -> None:
    """Add a run's folders as partitions of the storage table."""
    if part.partition_by:
        files = spark.read.schema(part.columns).parquet(part.path)
        names = [F.col(c).cast("string").alias(c) for c in part.partition_by]
        found = files.select(*names).distinct().collect()
        own = [tuple(r[c] for c in part.partition_by) for r in found]
        specs = [f"PARTITION ({_spec(part, values)})" for values in own]
        specs += [
            f"PARTITION ({_spec(part, values)}) LOCATION {quoted(place)}"
            for values, place in part.shared.items()
        ]
    else:
        specs = [f"PARTITION ({_spec(part, ())})"]
    # In groups, so that no statement becomes endless.
    for start in range(0, len(specs), 100):
        listed = " ".join(specs[start : start + 100])
        spark.sql(f"ALTER TABLE {storage} ADD IF NOT EXISTS {listed}")


def _spec(part: Part, values: Sequence[str | None]) -> str:
    named = zip((RUN, *part.partition_by), (part.run, *values))
    return ", ".join(f"`{n}` = {'NULL' if v is None else quoted(v)}" for n, v in named)


def partition_locations(
    spark: SparkSession, storage: str, run: str
) -> dict[tuple[str | None, ...], str]:
    """Where the partitions of a run are, by their values as text; one of no values for a table
    that has runs only."""
    out = {}
    names = partition_columns(spark, storage)
    for values in listed_partitions(spark, storage):
        named = dict(zip(names, values))
        if named[RUN] != run:
            continue
        spec = ", ".join(
            f"`{n}` = {'NULL' if v is None else quoted(v)}" for n, v in named.items()
        )
        rows = spark.sql(f"DESCRIBE TABLE EXTENDED {storage} PARTITION ({spec})").collect()
        # The table's own location is named as well, behind the partition's.
        place = next(r["data_type"] for r in rows if r["col_name"] == "Location")
        out[tuple(v for n, v in named.items() if n != RUN)] = place
    return out


def switch(spark: SparkSession, database: str, root: str, shown: Mapping[str, tuple[str, str]]) -> None:
    """Replace the pointer's rows by ``shown``: the one step that readers see."""
    pointer = f"{database}.{POINTER}"
    path = f"{root}/{POINTER}/{uuid.uuid4().hex}"
    rows = [(table, storage, run) for storage, (table, run) in shown.items()]
    spark.createDataFrame(rows, POINTER_SCHEMA).coalesce(1).write.parquet(path)
    if spark.catalog.tableExists(pointer):
        spark.sql(f"ALTER TABLE {pointer} SET LOCATION {quoted(path)}")
        spark.sql(f"REFRESH TABLE {pointer}")
    else:
        spark.sql(f"CREATE TABLE {pointer} ({POINTER_SCHEMA}) USING PARQUET LOCATION {quoted(path)}")


def _create_view(spark: SparkSession, database: str, table: str, storage: str, part: Part) -> None:
    columns = ", ".join(f"`{c}`" for c in part.columns.names)
    if spark.catalog.tableExists(table) and view_storage(spark, table) is None:
        # Published as a plain table before; its files stay.
        spark.sql(f"DROP TABLE {table}")
    spark.sql(
        f"CREATE OR REPLACE VIEW {table} TBLPROPERTIES ({quoted(STORAGE)} = {quoted(storage)}) AS "
        f"SELECT {columns} FROM {storage} WHERE `{RUN}` = "
        f"(SELECT run FROM {database}.{POINTER} WHERE storage = {quoted(storage)})"
    )


def publish_together(
    spark: SparkSession, database: str, root: str, parts: Mapping[str, Part]
) -> None:
    """Make every table of ``parts`` (by name within ``database``) show its run, all at once.

    Contracts of all files are checked first. Tables that are not in ``parts`` keep what they
    show. The step is one for all tables whose contract is that of the last time; a table of a
    new contract is a new view as well, and follows after the step, each on its own, showing its
    former state until then.
    """
    for part in parts.values():
        check_contract(spark, part.path, part.columns, part.partition_by)
    storages = {name: storage_name(f"{database}.{name}", part) for name, part in parts.items()}
    for name, part in parts.items():
        _create_storage(spark, storages[name], part)
        _add_run(spark, storages[name], part)
    before = pointer_rows(spark, database)
    views = {name: view_storage(spark, f"{database}.{name}") for name in parts}
    shown = dict(before) | {storages[n]: (n, part.run) for n, part in parts.items()}
    switch(spark, database, root, shown)
    changed = [name for name in parts if views[name] != storages[name]]
    for name in changed:
        _create_view(spark, database, f"{database}.{name}", storages[name], parts[name])
    for name in parts:
        spark.catalog.refreshTable(storages[name])
    stale = {s: row for s, row in shown.items() if row[0] in parts and s not in storages.values()}
    if stale:
        # Rows of former contracts are nobody's any more.
        switch(spark, database, root, {s: row for s, row in shown.items() if s not in stale})
