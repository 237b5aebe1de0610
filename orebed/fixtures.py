"""Adapters from the test tables to the entities' silver shape.

Text columns come from whole numbers only; text of fractions differs between engines.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from orebed.operators.running import rank_within
from orebed.session import materialize
from orebed.specs import MATCHES, STANDINGS, TEAMS, EntitySpec

# Order status to fixture status.
STATUS = {"F": "FT", "O": "NS", "P": "LIVE"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def _whole_text(value: Column) -> Column:
    return value.cast("bigint").cast("string")


def _shaped(df: DataFrame, spec: EntitySpec, values: dict[str, Column], *extra: str) -> DataFrame:
    """All columns of the entity as text, NULL where ``values`` has none."""
    missing = F.lit(None).cast("string")
    return df.select(*extra, *[values.get(c, missing).alias(c) for c in spec.columns])


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Team rows: the customer of every order, so rows repeat."""
    places = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    customers = table(spark, sf_dir, "customer").join(
        places, F.col("c_nationkey") == F.col("n_nationkey")
    )
    joined = table(spark, sf_dir, "orders").join(
        customers, F.col("o_custkey") == F.col("c_custkey")
    )
    values = {
        "team_id": _text("c_custkey"),
        "team_name": F.col("c_name"),
        "team_short_name": F.col("c_mktsegment"),
        "team_stadium": F.col("c_mktsegment"),
        "team_country": F.col("n_name"),
        "team_location": F.col("r_name"),
    }
    return _shaped(joined, TEAMS, values)


def contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match rows: an order with lines, scored by the quantities of its odd and even lines."""

    def score(odd: bool) -> Column:
        is_odd = F.col("l_linenumber") % 2 == 1
        return F.sum(F.when(is_odd if odd else ~is_odd, F.col("l_quantity")))

    lines = table(spark, sf_dir, "lineitem")
    scores = lines.groupBy("l_orderkey").agg(
        score(odd=True).alias("home"), score(odd=False).alias("away")
    )
    customers = table(spark, sf_dir, "customer").agg(F.count(F.lit(1))).scalar()
    joined = table(spark, sf_dir, "orders").join(
        scores, F.col("o_orderkey") == F.col("l_orderkey")
    )
    status = F.col("o_orderstatus")
    match_status = F.when(status == "F", STATUS["F"]).when(status == "O", STATUS["O"])
    values = {
        "match_id": _text("o_orderkey"),
        "match_date": F.date_format("o_orderdate", "yyyy-MM-dd"),
        "match_status": match_status.when(status == "P", STATUS["P"]),
        "home_score": _whole_text(F.col("home")),
        "away_score": _whole_text(F.col("away")),
        "home_team_id": _text("o_custkey"),
        "away_team_id": _whole_text((F.col("o_custkey") + 1) % customers),
    }
    return _shaped(joined, MATCHES, values)


def _season_records(orders: DataFrame, *by: str) -> DataFrame:
    """Played, won, drawn and lost of every customer."""

    def with_status(status: str) -> Column:
        return F.count_if(F.col("o_orderstatus") == status)

    return orders.groupBy("o_custkey", *by).agg(
        F.count(F.lit(1)).alias("played"),
        with_status("F").alias("won"),
        with_status("P").alias("drawn"),
        with_status("O").alias("lost"),
    )


def _standing_rows(entries: DataFrame, *by: str) -> DataFrame:
    """Standings of customers with a record each, ranked by points within nation."""
    for count in ("played", "won", "drawn", "lost"):
        entries = entries.withColumn(count, F.coalesce(F.col(count), F.lit(0).cast("bigint")))
    won, drawn, lost = F.col("won"), F.col("drawn"), F.col("lost")
    scored = entries.select(
        *by, "n_name", "c_custkey", "c_name", "played", "won", "drawn", "lost",
        (3 * won + drawn).alias("total_points"),
        (2 * won + drawn).alias("scored"),
        (2 * lost + drawn).alias("conceded"),
    )
    ranked = rank_within(
        materialize(scored, "records"), [*by, "n_name"], "total_points", "place", descending=True
    )
    values = {
        "standing_id": F.concat_ws("-", "n_name", _text("c_custkey")),
        "group_name": F.col("n_name"),
        "team_id": _text("c_custkey"),
        "team_name": F.col("c_name"),
        "position": _text("place"),
        "played_games": _text("played"),
        "won": _text("won"),
        "drawn": _text("drawn"),
        "lost": _text("lost"),
        "goals_for": _text("scored"),
        "goals_against": _text("conceded"),
        "goal_difference": _whole_text(F.col("scored") - F.col("conceded")),
        "points": _text("total_points"),
    }
    return _shaped(ranked, STANDINGS, values, *by)


def _customers_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )


def standings(spark: SparkSession, sf_dir: str, before: str | None = None) -> DataFrame:
    """Standing rows: one per customer, grouped by nation; ``before`` keeps early orders."""
    orders = table(spark, sf_dir, "orders")
    if before is not None:
        orders = orders.where(F.col("o_orderdate") < F.lit(before).cast("timestamp_ntz"))
    entries = _customers_by_nation(spark, sf_dir).join(
        _season_records(orders), F.col("c_custkey") == F.col("o_custkey"), "left"
    )
    return _standing_rows(entries)


def standings_by_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standing rows of every order year, for the customers that ordered in it."""
    orders = table(spark, sf_dir, "orders").withColumn("season", F.year("o_orderdate"))
    entries = _customers_by_nation(spark, sf_dir).join(
        _season_records(orders, "season"), F.col("c_custkey") == F.col("o_custkey")
    )
    return _standing_rows(entries, "season")


def payload_batches(rows: DataFrame, array: str, per_line: int = 500) -> DataFrame:
    """Rows as payloads of at most ``per_line`` elements each.

    Grouping rows in SQL would shuffle all of them, to no end: which rows share a line does
    not matter. So each task cuts its own rows into lines, a column batch at a time.
    """
    schema = StructType([StructField(array, ArrayType(rows.schema))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = [*range(0, batch.num_rows, per_line), batch.num_rows]
            lines = pa.ListArray.from_arrays(starts, batch.to_struct_array())
            yield pa.RecordBatch.from_arrays([lines], [array])

    return rows.mapInArrow(cut, schema)


def payloads(rows: DataFrame, spec: EntitySpec, per_line: int = 500) -> DataFrame:
    """Rows in silver shape as payloads of many elements each."""
    elements = rows.select(*[F.col(f.column).alias(f.raw) for f in spec.fields])
    return payload_batches(elements, spec.array, per_line)
