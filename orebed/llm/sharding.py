"""Shards whose mixture of strata is that of the whole table.

Every stratum is shuffled by a seeded hash. Row r of a stratum of n rows stands at the
fraction (2r + 1) / 2n of it; rows of all strata sorted by that fraction are interleaved in
proportion, and equal cuts of that order are the shards. Ranks come from windows over
buckets of the hash, of bounded size whatever the size of a stratum, plus the number of
rows in earlier buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orebed.session import materialize

BUCKET_ROWS = 5_000


def _numbered(rows: DataFrame, group: str | None, bucket: str, order: Sequence[str]) -> DataFrame:
    """Add ``_rank``, from 0 within ``group``, by bucket and then by ``order``; with a
    group, also its size ``_size``."""
    keys = [group, bucket] if group else [bucket]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(group) if group else Window.partitionBy()
    earlier = whole.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys,
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_rows").over(whole).alias("_size"),
    )
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return (
        rows.withColumn("_row", inside)
        .join(offsets, keys)
        .withColumn("_rank", F.col("_before") + F.col("_row") - 1)
        .drop("_row", "_before")
    )


def interleave(
    rows: DataFrame,
    strata: Sequence[str],
    shards: int,
    *,
    seed: int = 0,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """``rows`` with ``shard``, from 0, and ``slot``, gapless from 0 within the shard.

    Sizes of shards differ by one row at most; so do, for each stratum, the rows that a
    shard has and those due to it by its share, up to rounding at both cuts.

    The order depends on ``seed`` and the values of a row only, so it does not change with
    partitioning or when lost work is done again. NULLs in ``strata`` form a stratum, NULLs
    elsewhere are values like others; repeated rows each get a place of their own; an empty
    table stays empty. All columns must be orderable. Columns ``shard`` and ``slot`` of the
    input are replaced; names that start with an underscore are used inside. Both shuffles
    carry all columns, so pass what identifies and describes a row rather than its text.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    rows = rows.drop("shard", "slot")
    columns = rows.columns
    total = rows.count()
    buckets = max(1, -(-total // bucket_rows))
    keyed = rows.withColumns({
        "_stratum": F.to_json(F.struct(*strata), {"ignoreNullFields": "false"}),
        "_hash": F.xxhash64(F.lit(seed), *columns),
    }).withColumn("_bucket", F.pmod(F.shiftright("_hash", 20), F.lit(buckets)))
    order = ["_hash", *columns]
    ranked = materialize(_numbered(keyed, "_stratum", "_bucket", order), "strata")
    spread = ranked.withColumns({
        "_fraction": (2 * F.col("_rank") + 1) / (2 * F.col("_size")),
        "_bucket": F.expr(f"(2 * _rank + 1) * {buckets} div (2 * _size)"),
    }).drop("_rank", "_size")
    placed = _numbered(spread, None, "_bucket", ["_fraction", *order])
    return (
        placed.withColumn("shard", F.expr(f"((_rank + 1) * {shards} - 1) div {max(total, 1)}"))
        .withColumn("slot", F.expr(f"_rank - (shard * {total}) div {shards}"))
        .select(*columns, F.col("shard").cast("int").alias("shard"), "slot")
    )
