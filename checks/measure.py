"""Two comparisons behind design choices:  python -m checks.measure [folder]

How bronze is read (inferred or given schema), and how a running total with large groups
is computed (plain window or in two steps).
"""

from __future__ import annotations

import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from checks.compare import local_session
from orebed import fixtures
from orebed.operators.flatten import flatten
from orebed.operators.running import running_total
from orebed.session import new_workspace
from orebed.sources.bronze import land_rows, read_bronze
from orebed.specs import MATCHES


def best_of(runs: int, build: Callable[[], DataFrame]) -> float:
    seconds = []
    for _ in range(runs):
        start = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        seconds.append(time.perf_counter() - start)
    return round(min(seconds), 2)


def measure(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    path = new_workspace(spark, "measure")
    land_rows(fixtures.contests(spark, sf_dir), MATCHES, path)
    lines = fixtures.table(spark, sf_dir, "lineitem")

    def plain() -> DataFrame:
        window = Window.partitionBy("l_returnflag").orderBy("l_shipdate")
        frame = window.rangeBetween(Window.unboundedPreceding, Window.currentRow)
        return lines.withColumn("total", F.sum("l_quantity").over(frame))

    def in_two_steps() -> DataFrame:
        value = F.col("l_quantity")
        return running_total(lines, value, ["l_returnflag"], "l_shipdate", "total")

    given = flatten(read_bronze(spark, MATCHES, path), MATCHES).columns
    few = ["match_id", "home_score", "away_score"]
    return {
        "bronze, inferred schema": best_of(
            5, lambda: spark.read.json(path).select(F.explode("events").alias("e")).select("e.*")
        ),
        f"bronze, given schema, {len(given)} columns": best_of(
            5, lambda: flatten(read_bronze(spark, MATCHES, path), MATCHES)
        ),
        f"bronze, given schema, {len(few)} columns": best_of(
            5, lambda: flatten(read_bronze(spark, MATCHES, path, few), MATCHES, columns=few)
        ),
        "running total, plain window": best_of(5, plain),
        "running total, two steps": best_of(5, in_two_steps),
    }


if __name__ == "__main__":
    session = local_session()
    session.sparkContext.setLogLevel("ERROR")
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    for label, seconds in measure(session, folder).items():
        print(f"{label:36} {seconds:6.2f}s")
