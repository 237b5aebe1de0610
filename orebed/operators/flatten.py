"""Bronze to silver: one flat row per array element."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orebed.functions.metrics import whole
from orebed.specs import COMPAT, SOURCE_FILE, STRICT, EntitySpec, Field, check_mode


def stamp(batch_ts: datetime | None = None) -> Column:
    """The load time of a batch: one constant per query, or the time given."""
    return F.current_timestamp() if batch_ts is None else F.lit(batch_ts)


def has_array(bronze: DataFrame, spec: EntitySpec) -> bool:
    """Whether any payload carries the entity's array. Stops at the first that does."""
    return not bronze.where(F.col(spec.array).isNotNull()).select(F.lit(1)).isEmpty()


def _column(field: Field, mode: str) -> Column:
    value = F.col(f"element.{field.raw}")
    if mode == STRICT and field.strict_type != "string":
        whole_number = field.strict_type == "bigint"
        value = whole(value) if whole_number else value.try_cast(field.strict_type)
    return value.alias(field.column)


def _failed(fields: Iterable[Field]) -> Column:
    """How many values of a row have text that their type cannot hold."""
    failed = F.lit(0)
    for field in fields:
        if field.strict_type != "string":
            typed = _column(field, STRICT)
            lost = F.col(f"element.{field.raw}").isNotNull() & typed.isNull()
            failed = failed + lost.cast("int")
    return failed


def flatten(
    bronze: DataFrame,
    spec: EntitySpec,
    mode: str = COMPAT,
    columns: Iterable[str] | None = None,
    failed: str | None = None,
    keep: Sequence[str] = (),
    traced: bool = True,
) -> DataFrame:
    """Explode the entity's array and project its fields under their column names.

    Payloads whose array is NULL or empty give no row; a NULL element gives a row of
    NULLs. Strict mode types the columns and keeps the file each row came from; a column
    ``failed``, if named, counts the values of a row that got lost by that. Columns of
    ``keep``, those of the payload's folder, go along with every row. Without ``traced``, strict
    rows do not keep their file.
    """
    check_mode(mode)
    picked = spec.pick(columns)
    fields = [_column(f, mode) for f in picked]
    if failed is not None:
        fields.append((_failed(picked) if mode == STRICT else F.lit(0)).alias(failed))
    if mode == COMPAT or not traced:
        return bronze.select(F.explode(spec.array).alias("element"), *keep).select(*fields, *keep)
    return bronze.select(
        F.col("_metadata.file_path").alias(SOURCE_FILE), F.explode(spec.array).alias("element"),
        *keep,
    ).select(*fields, SOURCE_FILE, *keep)
