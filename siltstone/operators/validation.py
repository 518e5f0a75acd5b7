"""Cleaning and validating whole frames, and splitting them into valid and rejected rows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DataType,
    DecimalType,
    IntegralType,
    StringType,
    TimestampNTZType,
    TimestampType,
)

from siltstone.functions import rules as R
from siltstone.functions import text as X
from siltstone.functions.values import RATE_TYPE, column

ERRORS = "_validation_errors"

_KINDS: Mapping[str, tuple[type[DataType], ...]] = {
    "string": (StringType,),
    "integer": (IntegralType,),
    "boolean": (BooleanType,),
    "datetime": (TimestampType, TimestampNTZType),
    "decimal": (DecimalType,),
}


def columns_of_type(df: DataFrame, *kinds: str) -> list[str]:
    """Names of the columns of each kind, kinds in the order asked, columns in schema order.

    Matches by type class: a decimal of any precision is a decimal, either timestamp a datetime.
    """
    return [f.name for kind in kinds for f in df.schema.fields if isinstance(f.dataType, _KINDS[kind])]


def clean_strings(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Clean the listed string columns; by default all but lineage (``_``-prefixed) ones.

    All columns are cleaned in one projection, so Spark ships them to Python in one batch.
    """
    if columns is None:
        columns = [c for c in columns_of_type(df, "string") if not c.startswith("_")]
    return df.withColumns({c: X.clean(column(c)) for c in columns if c in df.columns})


def blank_strings_to_null(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Space-only strings become NULL."""
    columns = columns_of_type(df, "string") if columns is None else columns
    return df.withColumns({c: X.blank_to_null(column(c)) for c in columns if c in df.columns})


def check_types(df: DataFrame, rule_set: R.RuleSet) -> None:
    """Raise when a column's type is not of the kind its rules declare under ``type``."""
    wrong = {
        f.name: rule_set[f.name]["type"]
        for f in df.schema.fields
        if "type" in rule_set.get(f.name, {}) and not isinstance(f.dataType, _KINDS[rule_set[f.name]["type"]])
    }
    if wrong:
        raise TypeError(f"columns not of their declared type: {wrong}")


# What a declared type reads text as.
_READ_AS = {"integer": "int", "boolean": "boolean", "datetime": "timestamp", "decimal": RATE_TYPE}


def cast_types(
    df: DataFrame, rule_set: R.RuleSet, columns: Iterable[str] | None = None, read_as: Mapping[str, str] | None = None
) -> DataFrame:
    """Columns that were landed as text, read as the ``type`` their rules declare, row by row.

    Text that is none becomes NULL, and ``_validation_errors`` says so, after errors found earlier. So a required column is reported
    by a later ``validate`` as missing too. Columns that are not text, or declared as ``string``, stay as they are. ``read_as`` gives the
    SQL type for a kind, such as another decimal. NULL, and text of spaces only, is no value and breaks no type.
    """
    kinds = {**_READ_AS, **(read_as or {})}
    order = list(rule_set) if columns is None else list(columns)
    texts = columns_of_type(df, "string")
    wanted = {c: rule_set[c]["type"] for c in order if c in texts and rule_set.get(c, {}).get("type", "string") != "string"}
    unknown = {c: kind for c, kind in wanted.items() if kind not in kinds}
    if unknown:
        raise ValueError(f"unknown types: {unknown}")
    made = {c: F.trim(column(c)).try_cast(kinds[kind]) for c, kind in wanted.items()}
    wrong = [
        F.when((F.trim(column(c)) != "") & made[c].isNull(), F.lit(R.TYPE_MESSAGE.format(column=c, value=wanted[c]))) for c in wanted]
    if not wanted:
        return df if ERRORS in df.columns else df.withColumn(ERRORS, F.lit(""))
    earlier = [F.when(F.col(ERRORS) != "", F.col(ERRORS))] if ERRORS in df.columns else []
    # Both in one projection, which reads the texts for the messages before they are replaced.
    return df.withColumns({ERRORS: F.concat_ws(R.BETWEEN_COLUMNS, *earlier, *wrong), **made})


def validate(
    df: DataFrame, rule_set: R.RuleSet, columns: Iterable[str] | None = None, check_format: bool = False
) -> DataFrame:
    """Add ``_validation_errors`` (``""`` when valid), keeping errors an earlier call found.

    ``columns`` sets the reporting order and may name absent columns; they are ignored.
    One projection, however many rules.
    """
    order = list(rule_set) if columns is None else list(columns)
    checked = [
        R.error_or_null(c, rule_set[c], df.schema[c].dataType, check_format)
        for c in order
        if c in df.columns and rule_set.get(c)
    ]
    parts = [e for e in checked if e is not None]
    if ERRORS in df.columns:
        parts.insert(0, F.when(F.col(ERRORS) != "", F.col(ERRORS)))
    return df.withColumn(ERRORS, F.concat_ws(R.BETWEEN_COLUMNS, *parts) if parts else F.lit(""))


def split_quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows without the error column, rejected rows with it): disjoint and complete."""
    return df.filter(F.col(ERRORS) == "").drop(ERRORS), df.filter(F.col(ERRORS) != "")


def quarantine_counts(df: DataFrame) -> DataFrame:
    """One row with the input, valid and rejected counts, from one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("n_input"),
        F.count_if(F.col(ERRORS) == "").alias("n_valid"),
        F.count_if(F.col(ERRORS) != "").alias("n_rejected"),
    )
