"""Parsing, keys and literals shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, TimestampNTZType, TimestampType

# Formats and tokens other systems compare against.
PAYLOAD_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ssX"
PAYLOAD_WALL_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"
BATCH_ID_FORMAT = "yyyyMMdd_HHmmss"
DATE_KEY_FORMATS = {"minute": "yyyyMMddHHmm", "hour": "yyyyMMddHH", "day": "yyyyMMdd"}
RATE_TYPE = "decimal(20,10)"
SURROGATE_SEPARATOR = "-"
SURROGATE_NULL = "_dbt_utils_surrogate_key_null_"


def column(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def parse_time(text: Column, ntz: bool = False) -> Column:
    """``2026-05-11T11:29:37Z`` as a moment, whatever the session's zone (``ntz``: as UTC's wall clock); NULL stays NULL, other
    text raises under ANSI."""
    parsed = F.to_timestamp_ntz if ntz else F.to_timestamp
    fmt = F.lit(PAYLOAD_WALL_FORMAT) if ntz else PAYLOAD_TIME_FORMAT
    return parsed(text, fmt)


def try_parse_time(text: Column, ntz: bool = False) -> Column:
    """Like ``parse_time``, with NULL for text that is no such time."""
    moment = F.try_to_timestamp(text, F.lit(PAYLOAD_TIME_FORMAT))
    if not ntz:
        return moment
    # From the moment's seconds: its wall clock in the session's zone may stand for two moments.
    since = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.unix_seconds(moment).cast("decimal(18,6)"))
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + since


def try_exact_decimal(value: Column, decimal_type: str = RATE_TYPE) -> Column:
    """Like ``exact_decimal``, with NULL for text that is no such number."""
    return value.cast("string").try_cast(decimal_type)


def exact_decimal(value: Column, decimal_type: str = RATE_TYPE) -> Column:
    """The number as written, not its binary approximation; too many integer digits raise."""
    return value.cast("string").cast(decimal_type)


def batch_id(ingested_at: Column) -> Column:
    return F.date_format(ingested_at, BATCH_ID_FORMAT)


def truncate_time(ts: Column, grain: str, data_type: DataType | None = None) -> Column:
    """``date_trunc`` that keeps the input's type (Spark's own returns TIMESTAMP for NTZ input)."""
    truncated = F.date_trunc(grain, ts)
    return truncated.cast(data_type) if isinstance(data_type, TimestampNTZType) else truncated


def date_key(ts: Column, grain: str = "minute") -> Column:
    """Integer key such as 202605111129 for a timestamp."""
    return F.date_format(ts, DATE_KEY_FORMATS[grain]).cast("bigint")


def surrogate_key(*columns: str | Column) -> Column:
    """md5 over the columns' text, NULL spelled with a token of its own."""
    parts = [c if isinstance(c, Column) else column(c) for c in columns]
    text = [F.coalesce(c.cast("string"), F.lit(SURROGATE_NULL)) for c in parts]
    return F.md5(F.concat_ws(SURROGATE_SEPARATOR, *text))


def max_literal(df: DataFrame, name: str) -> Column | None:
    """The largest value of a column as a foldable literal, or None when there is none.

    One aggregate job that brings back one value. A literal, unlike a joined-in maximum, prunes
    partitions and Parquet row groups when it is compared with a scanned column.
    """
    data_type = df.schema[name].dataType
    top = F.max(column(name))
    if isinstance(data_type, TimestampType):  # exact under any session time zone
        micros = df.agg(F.unix_micros(top)).first()[0]
        return None if micros is None else F.timestamp_micros(F.lit(micros))
    text = df.agg(top.cast("string")).first()[0]
    return None if text is None else F.lit(text).cast(data_type)
