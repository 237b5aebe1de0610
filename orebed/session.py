"""Shared scratch space of a session."""

from __future__ import annotations

import functools
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

Result = TypeVar("Result")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    Only a local session without the setting gets a folder of its own; on a cluster a
    machine-local folder would lose data with its machine, so that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return _local_folder(spark.sparkContext.applicationId)


@functools.cache
def _local_folder(application_id: str) -> str:
    return tempfile.mkdtemp(prefix=f"orebed-{application_id}-")


def new_workspace(spark: SparkSession, label: str) -> str:
    """A fresh folder path under the shared root; nothing is ever written twice to one.
    All of an application's folders lie in one, which may go when the application is gone."""
    application = spark.sparkContext.applicationId
    return f"{shared_root(spark)}/orebed/{application}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors, fixes values that depend on
    physical placement, and gives the planner a true size for choosing join strategies.
    """
    spark = df.sparkSession
    path = new_workspace(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver has it from: Spark's own
    file server hands it to every executor, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="orebed-")) / "orebed.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def side_by_side(
    spark: SparkSession, tasks: Mapping[str, Callable[[], Result]]
) -> dict[str, Result]:
    """Submit independent jobs at the same time, so that cores one of them leaves idle work
    on the others. Waits for all; the first failure is raised."""
    if not tasks:
        return {}
    inherit = inheritable_thread_target(spark)
    with ThreadPoolExecutor(max_workers=len(tasks)) as pool:
        running = {name: pool.submit(inherit(task)) for name, task in tasks.items()}
    return {name: job.result() for name, job in running.items()}
