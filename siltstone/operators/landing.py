"""Landing semi-structured payloads under an explicit schema, with lineage."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

from siltstone.functions import values as V
from siltstone.functions.values import column

CORRUPT, RESCUED = "_corrupt", "_rescued"
LINEAGE = ("_ingested_at", "_source_file", "_batch_id")


def explode_records(df: DataFrame, payload: str, schema: StructType, field: str = "response", rescue: bool = False) -> DataFrame:
    """One row per element of the record list held in a JSON text column.

    An unreadable payload is not lost: it becomes one row whose ``_corrupt`` holds its text, as does an empty or NULL one and a document
    without the list. A payload whose list is declared null or empty yields no row. With ``rescue``, ``_rescued`` holds as
    JSON what a record says beyond the schema, NULL if nothing.
    """
    envelope = StructType([StructField(field, ArrayType(schema)), StructField(CORRUPT, StringType())])
    text = column(payload)
    read = df.withColumns({
        "_read": F.from_json(text, envelope, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}), "_text": text})
    records, corrupt = F.col("_read")[field], F.col("_read")[CORRUPT]
    # Only a document without a list is looked at again: it may declare that there is none.
    declared = F.coalesce(F.array_contains(F.json_object_keys("_text"), field), F.lit(False))
    broken = F.coalesce(corrupt, F.when(records.isNull() & ~declared, F.coalesce("_text", F.lit(""))))
    found = read.withColumns({"_broken": broken, "_list": records})
    if rescue:
        maps = F.from_json("_text", StructType([StructField(field, ArrayType(MapType(StringType(), StringType())))]))[field]
        beyond = F.transform(maps, lambda m: F.map_filter(m, lambda k, _: ~k.isin(*schema.names)))
        found = found.withColumn("_beyond", F.transform(beyond, lambda m: F.when(F.size(m) > 0, F.to_json(m))))
    kept = [column(c) for c in df.columns if c != payload]
    listed = F.arrays_zip("_list", "_beyond") if rescue else F.transform("_list", lambda r: F.struct(r.alias("_list")))
    nothing = F.array(F.struct(F.lit(None).cast(schema).alias("_list"), *([F.lit(None).cast("string").alias("_beyond")] if rescue else [])))
    exploded = found.select(*kept, F.col("_broken"), F.explode(F.when(F.col("_broken").isNotNull(), nothing).otherwise(listed)).alias("_one"))
    extra = [F.col("_one._beyond").alias(RESCUED)] if rescue else []
    return exploded.select(*kept, *[F.col("_one._list")[f.name].alias(f.name) for f in schema.fields], F.col("_broken").alias(CORRUPT), *extra)


def land_records(
    spark: SparkSession, path: str | list[str], schema: StructType, field: str = "response", multi_line: bool = False, rescue: bool = False
) -> DataFrame:
    """Like ``explode_records`` over payload files, one document a line (blank lines hold none) or, with ``multi_line``, a file. Lines of a file
    are split across tasks, one document is not."""
    read = spark.read.text(path, wholetext=multi_line)
    read = read.select(F.col("value").alias("_payload"))
    return explode_records(read if multi_line else read.filter(F.trim("_payload") != ""), "_payload", schema, field, rescue)


def explode_map(
    df: DataFrame,
    entries: str,
    key: str,
    value: str,
    value_type: str = V.RATE_TYPE,
) -> DataFrame:
    """One row per entry of a map column of number texts; a null or empty map yields no row.

    A null value is kept, for the ``required`` rule to reject.
    """
    kept = [c for c in df.columns if c != entries]
    # The outer form, less its rows without a key: for a plain explode Spark infers a filter on the
    # map and pushes it below the parsing, which then runs twice.
    rows = df.select(*[column(c) for c in kept], F.explode_outer(column(entries)).alias(key, value))
    return rows.filter(column(key).isNotNull()).withColumn(value, V.exact_decimal(column(value), value_type))


def land_map_payload(
    df: DataFrame,
    payload: str,
    base: str = "curr_base",
    key: str = "currency",
    value: str = "rate",
    time: str = "rate_date",
    value_type: str = V.RATE_TYPE,
    ntz: bool = False,
    rescue: bool = False,
) -> DataFrame:
    """Rows (base, key, value, time, ``_corrupt``) from ``{"response": {"date", "base", "rates": {code: number}}}``.

    A payload that declares itself empty, with ``rates`` a null, ``[]`` or ``{}``, yields no row; a missing
    date stays NULL. Numbers become decimals by way of their shortest text, so 1.08 is 1.0800000000.

    Nothing unreadable is lost, and nothing unreadable stops a run. A payload that is no such document – cut short, an error message,
    empty or NULL – becomes one row whose ``_corrupt`` holds its text. A number or date that is none, or an empty code, becomes NULL, and
    ``_corrupt`` holds what stood there, as ``rate: n/a``. See ``split_corrupt``. With ``rescue``, ``_rescued`` holds as JSON
    what a document says beyond these fields (``response`` fields under their path), NULL if nothing.
    """
    rates = MapType(StringType(), StringType())
    body = StructType(
        [StructField("date", StringType()), StructField("base", StringType()), StructField("rates", rates)]
    )
    envelope = StructType([StructField("response", body), StructField(CORRUPT, StringType())])
    kept = [c for c in df.columns if c != payload]
    text = column(payload)
    read = df.select(
        *[column(c) for c in kept],
        F.from_json(text, envelope, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("_read"),
        text.alias("_text"),
    )
    # A document read in full says what it holds. Only texts that failed, or that came without rates, are looked at again: an empty list
    # is no map, and rates may be missing or declared null, but only a whole document with the field declares itself empty.
    failed = F.col("_read").isNull() | F.col("_read")[CORRUPT].isNotNull()
    given = F.col("_read")["response"]["rates"]
    whole = F.get_json_object("_text", "$").isNotNull()
    fields = F.json_object_keys(F.get_json_object("_text", "$.response"))
    declared = whole & F.coalesce(F.array_contains(fields, "rates"), F.lit(False))
    listed = F.coalesce(F.get_json_object("_text", "$.response.rates"), F.lit(""))
    empty = declared & F.when(failed, listed == "[]").otherwise(True)
    broken = F.when((failed | given.isNull()) & ~F.coalesce(empty, F.lit(False)), F.coalesce("_text", F.lit("")))
    body_of = lambda name: F.when(~failed, F.col("_read")["response"][name])
    rescued = [
        _beyond(F.col("_text"), ["response"], "", _beyond_map(F.get_json_object("_text", "$.response"), ["date", "base", "rates"], "response."))
        .alias(RESCUED)
    ] if rescue else []
    flat = read.select(
        *[column(c) for c in kept], body_of("base").alias(base), body_of("date").alias("_date"), broken.alias("_broken"),
        F.when(broken.isNotNull(), F.create_map(F.lit(""), F.lit(None).cast("string"))).otherwise(body_of("rates")).alias("_rates"),
        *rescued,
    )
    extra = [RESCUED] if rescue else []
    # The outer form for the reason given in ``explode_map``.
    entries = flat.select(
        *[column(c) for c in [*kept, base]], "_date", "_broken", *extra, F.explode_outer("_rates").alias("_key", "_value")
    ).filter(F.col("_key").isNotNull())
    number, moment = V.try_exact_decimal(F.col("_value"), value_type), V.try_parse_time(F.col("_date"), ntz)
    unread = lambda name, raw, made: F.when(raw.isNotNull() & made.isNull(), F.concat(F.lit(f"{name}: "), raw))
    code = F.when(F.col("_broken").isNull() & (F.col("_key") != ""), F.col("_key"))
    no_code = F.when(F.col("_broken").isNull(), unread(key, F.col("_key"), code))
    wrong = F.concat_ws(", ", no_code, unread(value, F.col("_value"), number), unread(time, F.col("_date"), moment))
    return entries.select(
        *[column(c) for c in [*kept, base]], code.alias(key), number.alias(value),
        moment.alias(time), F.coalesce("_broken", F.when(wrong != "", wrong)).alias(CORRUPT), *extra,
    )


def _beyond_map(text: Column, known: Sequence[str], path: str) -> Column:
    """Fields of a JSON object that are not ``known``, as a map of their texts under their path; empty for anything else."""
    none = F.create_map().cast("map<string,string>")
    fields = F.coalesce(F.from_json(text, MapType(StringType(), StringType())), none)
    return F.transform_keys(F.map_filter(fields, lambda k, _: ~k.isin(*known)), lambda k, _: F.concat(F.lit(path), k))


def _beyond(text: Column, known: Sequence[str], path: str, *more: Column) -> Column:
    """What an object, and ``more`` maps taken from it, hold beyond the known fields, as JSON; NULL if nothing."""
    found = F.map_concat(_beyond_map(text, known, path), *more)
    return F.when(F.size(found) > 0, F.to_json(found))


def split_corrupt(landed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows read in full, without ``_corrupt``; rows something of which could not be read, with it)."""
    bad = column(CORRUPT).isNotNull()
    return landed.filter(~bad).drop(CORRUPT), landed.filter(bad)


def add_lineage(df: DataFrame, source: str | Column, ingested_at: datetime | str | Column) -> DataFrame:
    """Add ``_ingested_at``, ``_source_file`` and ``_batch_id``; the batch id is the time, spelled out.

    The time is an argument: a rerun of a batch gets the lineage of that batch.
    """
    moment = ingested_at if isinstance(ingested_at, Column) else F.lit(ingested_at).cast("timestamp")
    origin = source if isinstance(source, Column) else F.lit(source)
    return df.withColumns({"_ingested_at": moment, "_source_file": origin, "_batch_id": V.batch_id(moment)})
