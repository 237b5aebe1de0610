"""Connected components of a graph that is far larger than one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orebed.session import materialize


def _lowest(pairs: DataFrame) -> DataFrame:
    """(a, b) with the lowest neighbour of ``a``, or ``a`` itself, as ``_low``."""
    low = pairs.groupBy("a").agg(F.least("a", F.min("b")).alias("_low"))
    return pairs.join(low, "a")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _lowest(both).where("b > a").select(F.col("b").alias("a"), F.col("_low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    near = _lowest(down)
    return near.select(F.col("b").alias("a"), F.col("_low").alias("b")).union(
        near.select("a", F.col("_low").alias("b"))
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for every node of an edge ``a``-``b`` the lowest node it can reach.

    Rounds of large and small stars, their number logarithmic in the longest path; each
    writes its edges to the shared folder. Loops and repeated edges do no harm, and no
    edges give no rows; NULL ends are dropped. ``a`` and ``b`` are of one orderable type.
    """
    edges = materialize(edges.select("a", "b").where("a <> b").distinct(), "edges")
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 2**40)).first()
        if now == before or now[0] == 0:
            break
        before = now
        step = _small_star(_large_star(edges)).where("a <> b").distinct()
        edges = materialize(step, "edges")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
