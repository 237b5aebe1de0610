"""Documents to packed sequences: language, shared lines, near copies, benchmark passages,
packing. Every stage reads what the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebed.llm.decontamination import decontaminate
from orebed.llm.language_id import UNDETERMINED, predict
from orebed.llm.line_dedup import remove_shared_passages
from orebed.llm.near_duplicates import keep_one_of_each
from orebed.llm.queries import language_model, packed, table
from orebed.session import materialize, ship_package

#: A text is rejected if no language is as likely as all others together.
LEAST_SCORE = 0.5


def _aside(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all columns but doc_id and text under other names, so that none meets
    one that an operator adds, and a function that gives them their names back. All are
    renamed at once, so that the input may have these names too."""
    hidden = {c: f"kept_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}

    def back(out: DataFrame) -> DataFrame:
        return out.select(*(F.col(hidden.get(c, c)).alias(c) for c in docs.columns))

    named = (F.col("`" + c.replace("`", "``") + "`").alias(hidden.get(c, c)) for c in docs.columns)
    return docs.select(*named), back


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; NULL texts and texts without a letter go."""
    ship_package(spark)
    rows, back = _aside(docs)
    judged = predict(rows, language_model(docs))
    return back(judged.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE)))


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier one has; those left empty by that go."""
    ship_package(spark)
    rows, back = _aside(docs)
    cleaned = remove_shared_passages(rows)
    touched = F.size("removed") > 0
    left = cleaned.where(~touched | (F.trim("text") != "") | F.col("text").isNull())
    result = back(left)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        result = result.withColumn(
            "n_chars", F.coalesce(F.char_length("text").cast(kind), F.col("n_chars"))
        )
    return result


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies."""
    ship_package(spark)
    rows, back = _aside(docs)
    return back(keep_one_of_each(rows))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    rows, back = _aside(docs)
    return back(decontaminate(rows, table(spark, sf_dir, "benchmark")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    ship_package(spark)
    return packed(docs)


STAGES = [
    ("language", language),
    ("shared_lines", shared_lines),
    ("near_copies", near_copies),
    ("benchmark_passages", benchmark_passages),
    ("packing", packing),
]

#: Models, sketches and tokens are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
