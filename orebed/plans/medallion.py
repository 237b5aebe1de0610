"""The whole run: bronze to silver, gate, silver tables, gold, gold tables."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime
from functools import partial

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from orebed.operators.flatten import flatten, stamp
from orebed.operators.quality import FILES, checked, observe_checks, require, table_checks
from orebed.plans.gold import gold_matches, gold_standings, gold_teams
from orebed.plans.lineage import LINEAGE, lineage
from orebed.session import side_by_side
from orebed.sources.bronze import (
    BROKEN,
    LINES,
    WITHOUT_ARRAY,
    missing_inputs,
    observe_lines,
    read_bronze,
)
from orebed.sources.layers import in_order, read_layer, write_layer
from orebed.sources.snapshot import Part, publish_together
from orebed.specs import COMPAT, ENTITIES, INGESTED_AT, EntitySpec, Layout, check_mode

log = logging.getLogger(__name__)

#: Most broken lines of an entity's payloads, as a share of all.
BROKEN_SHARE = 0.01
LOST_VALUES = "lost values"


@dataclass(frozen=True)
class Run:
    """What a run published: table name per layer and entity, the entities skipped, and what
    was counted of the others."""

    run_id: str
    silver: Mapping[str, str]
    gold: Mapping[str, str]
    skipped: tuple[str, ...] = field(default=())
    counts: Mapping[str, Mapping[str, int]] = field(default_factory=dict)


def with_folders(contract: StructType, partition_by: Sequence[str]) -> StructType:
    """A contract with the columns of the bronze folders behind its own."""
    folders = [StructField(name, StringType()) for name in partition_by]
    return StructType([*contract.fields, *folders])


def bronze_to_silver(
    spark: SparkSession, spec: EntitySpec, bronze_path: str, silver_path: str,
    mode: str = COMPAT, batch_ts: datetime | None = None, partition_by: Sequence[str] = (),
) -> dict[str, int] | None:
    """Write one entity's silver folder and return what was counted meanwhile: the checks of
    the gate, the lines read, and values lost by their type.

    Returns None when no payload carries the entity's array; the folder then holds no row and
    is not to be used.
    """
    bronze = read_bronze(spark, spec, bronze_path, broken="_broken", partition_by=partition_by)
    lines, seen = observe_lines(bronze, spec, "_broken")
    flat = flatten(lines, spec, mode, failed="_failed", keep=partition_by)
    flat = flat.withColumn(INGESTED_AT, stamp(batch_ts))
    lost = Observation()
    flat = flat.observe(lost, F.coalesce(F.sum("_failed"), F.lit(0)).alias(LOST_VALUES))
    ordered = flat.select(*with_folders(spec.silver_contract(mode), partition_by).names)
    observed, observation = observe_checks(ordered, spec.required)
    write_layer(observed, silver_path, partition_by)
    counts = observation.get | seen.get | lost.get
    if counts[LINES] == counts[BROKEN] + counts[WITHOUT_ARRAY]:
        log.warning("no payload has the array %r: %s skipped", spec.array, spec.name)
        return None
    return counts


def silver_to_gold(
    silver: Mapping[str, DataFrame], mode: str = COMPAT, batch_ts: datetime | None = None,
    partition_by: Sequence[str] = (),
) -> dict[str, Callable[[], DataFrame]]:
    """How to build each gold table. Groups of standings are those of one league and season,
    if ``partition_by`` names such folders."""
    order = [*partition_by, "group_name", "position", "standing_id"]
    groups = [*partition_by, "group_name"]
    return {
        "teams": lambda: gold_teams(silver["teams"], batch_ts, partition_by),
        "standings": lambda: in_order(
            gold_standings(silver["standings"], batch_ts, groups), order
        ),
        "matches": lambda: gold_matches(silver["matches"], mode, batch_ts, partition_by),
    }


def _gate(
    spark: SparkSession, spec: EntitySpec, counts: Mapping[str, int] | None, table: str,
    contract: StructType, broken_share: float,
) -> list[str]:
    """What is wrong with an entity's silver: as just written, or, if it was skipped, as its
    table still stands. A kept table has to pass the same checks, under the same contract."""
    if counts is None:
        if not spark.catalog.tableExists(table):
            return [f"{spec.name}: {FILES}"]
        kept = spark.table(table)
        if kept.schema != contract:
            return [f"{spec.name}: the kept table has another contract"]
        counts = table_checks(kept, spec.required)
    wrong = [check for check in checked(spec.required) if counts[check] == 0]
    if counts.get(BROKEN, 0) > broken_share * counts.get(LINES, 0):
        wrong.append(f"{counts[BROKEN]} of {counts[LINES]} lines are broken")
    return [f"{spec.name}: {what}" for what in wrong]


def _write_gold(
    build: Callable[[], DataFrame], path: str, contract: StructType, partition_by: Sequence[str]
) -> None:
    write_layer(build().select(*contract.names), path, partition_by)


def _write_lineage(
    spark: SparkSession, spec: EntitySpec, bronze_path: str, path: str, mode: str,
    partition_by: Sequence[str],
) -> None:
    write_layer(lineage(spark, spec, bronze_path, mode, partition_by), path)


def run_medallion(
    spark: SparkSession,
    layout: Layout,
    database: str,
    mode: str = COMPAT,
    batch_ts: datetime | None = None,
    broken_share: float = BROKEN_SHARE,
    partition_by: Sequence[str] = (),
    with_lineage: bool = False,
) -> Run:
    """Run all layers over the bronze folders of ``layout`` and publish their tables.

    The entities of a layer are built side by side. All folders are written and all checks
    and contracts looked at before any table changes, and all tables change in one step, so a
    run that fails anywhere leaves every table as it was. An entity whose payloads lack its
    array is skipped: its tables of the last run stay, if they pass the gate under this run's
    mode. More than ``broken_share`` of broken lines fail an entity.

    ``partition_by`` names the folders between an entity's bronze folder and its files, such as
    league and season: one run takes all of them, and every table is partitioned by them, so
    that a report on one season reads that season.

    With ``with_lineage``, which reads bronze once more, there is a table ``lineage_<entity>``
    for every gold table, from the keys of its rows to the lines they came from.
    """
    check_mode(mode)
    run_id = uuid.uuid4().hex
    bronze = {name: layout.bronze(name) for name in ENTITIES}
    require([f"no input at {path}" for path in missing_inputs(spark, bronze.values())])

    def published(layer: str, contract: Callable[[EntitySpec], StructType]) -> dict[str, Part]:
        return {
            name: Part(
                layout.runs(layer, name), run_id, with_folders(contract(spec), partition_by),
                tuple(partition_by),
            )
            for name, spec in ENTITIES.items()
        }

    silver_parts = published("silver", lambda spec: spec.silver_contract(mode))
    gold_parts = published("gold", lambda spec: spec.gold_contract(mode))
    silver_tables = {name: f"{database}.silver_{name}" for name in ENTITIES}
    counts = side_by_side(
        spark,
        {
            name: partial(
                bronze_to_silver, spark, spec, bronze[name], silver_parts[name].path, mode,
                batch_ts, partition_by,
            )
            for name, spec in ENTITIES.items()
        },
    )
    written = [name for name in ENTITIES if counts[name] is not None]
    require(
        [
            failure
            for name, spec in ENTITIES.items()
            for failure in _gate(
                spark, spec, counts[name], silver_tables[name], silver_parts[name].columns,
                broken_share,
            )
        ]
    )

    silver = {
        name: read_layer(spark, part.path, part.columns)
        if name in written
        else spark.table(silver_tables[name])
        for name, part in silver_parts.items()
    }
    gold_tables = {name: f"{database}.gold_{name}" for name in ENTITIES}
    # The gold of a skipped entity is still that of its silver, stamp included.
    stale = [
        name for name in ENTITIES
        if name in written
        or not spark.catalog.tableExists(gold_tables[name])
        or spark.table(gold_tables[name]).schema != gold_parts[name].columns
    ]
    side_by_side(
        spark,
        {
            name: partial(
                _write_gold, build, gold_parts[name].path, gold_parts[name].columns, partition_by
            )
            for name, build in silver_to_gold(silver, mode, batch_ts, partition_by).items()
            if name in stale
        },
    )
    lines = {
        name: Part(layout.runs("lineage", name), run_id, LINEAGE)
        for name in written if with_lineage
    }
    side_by_side(
        spark,
        {name: partial(_write_lineage, spark, ENTITIES[name], bronze[name], part.path, mode,
                       partition_by)
         for name, part in lines.items()},
    )
    parts = {f"silver_{name}": silver_parts[name] for name in written}
    parts |= {f"gold_{name}": gold_parts[name] for name in stale}
    parts |= {f"lineage_{name}": part for name, part in lines.items()}
    publish_together(spark, database, layout.root, parts)
    skipped = tuple(name for name in ENTITIES if name not in written)
    return Run(run_id, silver_tables, gold_tables, skipped, {n: counts[n] for n in written})
