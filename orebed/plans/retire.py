"""Folders of former runs: which ones nothing shows any more, and their removal."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession

from orebed.sources.layers import POINTER, RUN, RUNS, pointer_rows
from orebed.sources.partitions import quoted
from orebed.sources.snapshot import partition_locations
from orebed.sources.storage import delete_folder, folders, same_place, written_at
from orebed.specs import ENTITIES, Layout

LAYERS = ("silver", "gold", "lineage")


@dataclass(frozen=True)
class Place:
    """Where a table's files are; of a storage table of runs, where the runs are."""

    table: str
    location: str
    holds_runs: bool


def table_places(spark: SparkSession, databases: Sequence[str] | None = None) -> list[Place]:
    """All tables of the catalog that have files of their own, or those of some databases."""
    if databases is None:
        databases = [row["namespace"] for row in spark.sql("SHOW DATABASES").collect()]
    found = []
    for database in databases:
        for row in spark.sql(f"SHOW TABLES IN {database}").where("NOT isTemporary").collect():
            name = f"{database}.{row['tableName']}"
            described = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()
            facts = {r["col_name"]: r["data_type"] for r in described}
            if facts.get("Type") != "VIEW":
                holds_runs = RUNS in facts.get("Table Properties", "")
                found.append(Place(name, facts["Location"], holds_runs))
    return found


def reachable(spark: SparkSession, places: Sequence[Place]) -> list[str]:
    """The folders that any table shows: of tables published together the runs that the pointers
    name, of all others their location."""
    shown: dict[str, tuple[str, str]] = {}
    for database in {place.table.rsplit(".", 1)[0] for place in places}:
        shown |= pointer_rows(spark, database)
    held = [place.location for place in places if not place.holds_runs]
    for place in places:
        if place.holds_runs and place.table in shown:
            run = shown[place.table][1]
            held.append(f"{place.location}/{RUN}={run}")
            # Partitions that it shares with former runs lie in their folders.
            held += partition_locations(spark, place.table, run).values()
    return held


def retirable(
    spark: SparkSession, layout: Layout, min_age_s: float, databases: Sequence[str] | None = None
) -> list[str]:
    """The run folders of ``layout`` that no table shows and that nobody has written to for
    ``min_age_s`` seconds: long enough for readers of a former state to be done, and longer
    than any run takes, as a run's own folders are not shown before it ends. Nothing is changed.
    ``databases`` names all that may show folders of ``layout``, if that is known."""
    held = reachable(spark, table_places(spark, databases))
    newest = (time.time() - min_age_s) * 1000
    candidates = [
        folder
        for layer in LAYERS
        for entity in ENTITIES
        for folder in folders(spark, layout.runs(layer, entity))
        if folder.rsplit("/", 1)[-1].startswith(f"{RUN}=")
    ]
    candidates += folders(spark, f"{layout.root}/{POINTER}")
    return [
        folder
        for folder in candidates
        if not any(same_place(place, folder) for place in held)
        and written_at(spark, folder) < newest
    ]


def retire(
    spark: SparkSession, layout: Layout, listed: Sequence[str],
    databases: Sequence[str] | None = None,
) -> list[str]:
    """Remove folders that ``retirable`` listed: out of the storage tables first, then off the
    disk. Each is looked at again, and kept if something shows it by now. Returns those removed."""
    storages = [place for place in table_places(spark, databases) if place.holds_runs]
    still = set(retirable(spark, layout, 0, databases))
    gone = [folder for folder in listed if folder in still]
    for folder in gone:
        parent, _, name = folder.rpartition("/")
        for storage in storages:
            if name.startswith(f"{RUN}=") and same_place(storage.location, parent):
                run = quoted(name.removeprefix(f"{RUN}="))
                spark.sql(f"ALTER TABLE {storage.table} DROP IF EXISTS PARTITION (`{RUN}` = {run})")
        delete_folder(spark, folder)
    return gone
