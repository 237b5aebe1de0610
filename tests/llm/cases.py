"""Small tables with everything that may be odd about a row."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars int, score string, "
    "shard string, slot int, overlaps int, n_lines int, removed string, spans int, "
    "length string, node bigint, sequence_id string"
)
#: Columns that operators add, with values of their own.
CLASHING = ("clash", "s", -1, 7, 5, "r", 3, "l", 9, "q")


def prose(seed: int, words: int, stem: str = "w") -> str:
    rng = random.Random(seed)
    return " ".join(f"{stem}{rng.randrange(5000)}" for _ in range(words))


def odd_rows() -> list[tuple]:
    long_text = "\n".join(prose(k, 60, "long") for k in range(200))
    shared = prose(99, 70, "shared")
    rows = [
        (1, prose(1, 80), "en", "a"),
        (1, prose(1, 80), "en", "a"),  # repeated row
        (2, prose(1, 80), "en", "b"),  # copy
        (3, None, "en", "a"),
        (4, "", None, None),
        (5, " \n\t\n", "fr", "a"),
        (6, "one two", "en", None),
        (7, long_text, "en", "a"),
        (8, prose(8, 30) + "\n" + shared, "fr", "b"),
        (9, prose(9, 30) + "\n" + shared + "\n" + prose(10, 20), "fr", "b"),
        (None, prose(11, 40), "de", "a"),
        (None, prose(12, 40), None, "a"),
        (10, "ünïcode ßtraße 日本語 🙂 mail a.b@c.de, " + "x" * 5000, "de", "c"),
        (11, "123 456 ... !!", "de", "c"),
        (12, "ends with newline\n", "en", "c"),
    ]
    return [(*row, len(row[1] or ""), *CLASHING) for row in rows]


def odd(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def texts(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def documents(spark: SparkSession, folder: str) -> tuple[DataFrame, dict[int, str]]:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return docs, {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
