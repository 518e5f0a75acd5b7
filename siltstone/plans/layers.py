"""The operators put together: landed rows to valid and rejected ones, and on to a star schema."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import timedelta
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.rules import RuleSet
from siltstone.functions.text import pad_code
from siltstone.functions.values import column
from siltstone.operators import batches as B
from siltstone.operators import incremental as I
from siltstone.operators import star as S
from siltstone.operators import validation as V
from siltstone.sinks import tables as K
from siltstone.sinks.staging import stage
from siltstone.sources.layers import find_layer


def annotate_dimension(
    landed: DataFrame, rules: RuleSet, padded: Sequence[str] = (), width: int = 3, check_format: bool = False
) -> DataFrame:
    """Clean strings, pad codes, read text as the types the rules declare, then check integers, booleans and strings, in this order."""
    cleaned = V.clean_strings(landed)
    cleaned = cleaned.withColumns({c: pad_code(column(c), width) for c in padded})
    cleaned = V.cast_types(cleaned, rules)
    return V.validate(cleaned, rules, V.columns_of_type(cleaned, "integer", "boolean", "string"), check_format)


def annotate_fact(
    landed: DataFrame,
    reference: DataFrame,
    mapping: Mapping[str, str],
    rules: RuleSet,
    batch_col: str = "_ingested_at",
    check_format: bool = False,
) -> DataFrame:
    """Latest batch, known codes only, clean strings, read text as the types the rules declare, then check times, decimals and strings.

    Batch and codes are chosen first: both shrink the rows before any reaches Python.
    """
    known = B.keep_known(B.latest_batch(landed, batch_col), reference, mapping)
    cleaned = V.cast_types(V.clean_strings(known), rules)
    return V.validate(cleaned, rules, V.columns_of_type(cleaned, "datetime", "decimal", "string"), check_format)


def silver_dimension(
    landed: DataFrame, rules: RuleSet, padded: Sequence[str] = (), width: int = 3, check_format: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) rows of a dimension."""
    return V.split_quarantine(annotate_dimension(landed, rules, padded, width, check_format))


def silver_fact(
    landed: DataFrame,
    reference: DataFrame,
    mapping: Mapping[str, str],
    rules: RuleSet,
    unique: Sequence[str],
    batch_col: str = "_ingested_at",
    check_format: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(valid rows, one per key; rejected rows, all copies)."""
    valid, rejected = V.split_quarantine(annotate_fact(landed, reference, mapping, rules, batch_col, check_format))
    return B.dedupe_by_key(valid, unique), rejected


def _with_versions(
    ts: str, measures: Sequence[str], histories: Sequence[S.AsOfRole]
) -> tuple[Callable[[DataFrame], DataFrame] | None, list[str]]:
    """What adds to rows what each history says at their time, and the measures with those columns."""
    if not histories:
        return None, list(measures)
    return (lambda rows: S.asof_star_join(rows, ts, *histories)), [*measures, *[name for role in histories for name in role.outputs]]


@dataclass(frozen=True)
class Star:
    """A date dimension and the fact that refers to it."""

    dim_date: DataFrame
    fact: DataFrame


def build_star(
    staged: DataFrame,
    ts: str,
    keys: Sequence[str],
    measures: Sequence[str],
    previous: Star | None = None,
    grain: str = "minute",
    full_refresh: bool = False,
    strict: bool = True,
    lookback: timedelta = timedelta(0),
    histories: Sequence[S.AsOfRole] = (),
) -> Star:
    """Dates first, then the fact that looks them up; on top of ``previous`` unless refreshed in full.

    Rows up to ``lookback`` late are loaded too (see ``incremental_filter``). The fact stores what each of
    ``histories`` gives for the version valid at a row's time, such as its surrogate key.
    """
    old_dates, old_fact = (previous.dim_date, previous.fact) if previous is not None else (None, None)
    dates = I.incremental_date_dimension(staged, ts, old_dates, grain, full_refresh, lookback)
    enrich, measures = _with_versions(ts, measures, histories)
    fact = I.incremental_fact(
        staged, dates, old_fact, ts, list(keys), measures, grain, full_refresh, strict, lookback, enrich
    )
    return Star(dates, fact)


def load_star(
    spark: SparkSession,
    staged: DataFrame,
    dim_path: str,
    fact_path: str,
    ts: str,
    keys: Sequence[str],
    measures: Sequence[str],
    grain: str = "minute",
    full_refresh: bool = False,
    lookback: timedelta = timedelta(0),
    histories: Sequence[S.AsOfRole] = (),
) -> Star:
    """Bring the stored star up to date (see ``build_star``); both tables are kept by day.

    A load writes the days its rows fall on and reads no others, apart from the high-water marks.
    Read time and disk use follow the batch and ``lookback`` (see ``incremental_filter``), not the table.
    """
    put = lambda path, old, fresh, unique: _put(spark, path, None if full_refresh else old, fresh, unique, grain)
    old_dates, old_fact = find_layer(spark, dim_path), find_layer(spark, fact_path)
    before = None if old_dates is None else old_dates.drop("day")
    dates = put(dim_path, old_dates, I.fresh_dates(staged, ts, before, grain, full_refresh, lookback), ["date_key"])
    before = None if old_fact is None else old_fact.drop("day")
    enrich, measures = _with_versions(ts, measures, histories)
    fresh = I.fresh_facts(staged, dates, before, ts, list(keys), measures, grain, full_refresh, lookback=lookback, enrich=enrich)
    return Star(dates, put(fact_path, old_fact, fresh, ["date_key", *keys]))


def _put(
    spark: SparkSession, path: str, before: DataFrame | None, fresh: DataFrame, unique: list[str], grain: str, **upsert: Any
) -> DataFrame:
    """Fresh rows into a table kept by day, which is returned without its day; the table anew without one ``before``."""
    fresh = fresh.withColumn("day", F.floor(F.col("date_key") / F.lit({"minute": 10_000, "hour": 100, "day": 1}[grain])).cast("int"))
    if before is None:
        K.write_layer(fresh, path, "overwrite", ["day"], unique)
    else:
        K.upsert_partitions(spark, path, fresh, unique, "day", strict=False, **upsert)
    return spark.read.schema(fresh.schema).parquet(path).drop("day")


def load_batches(
    spark: SparkSession,
    landed: DataFrame,
    dim_path: str,
    fact_path: str,
    ledger_path: str,
    ts: str,
    keys: Sequence[str],
    measures: Sequence[str],
    grain: str = "minute",
    batch_col: str = "_batch_id",
    histories: Sequence[S.AsOfRole] = (),
) -> Star:
    """Bring the stored star up to date with every landed batch that the stored ledger does not hold, however late it is.

    Unlike ``load_star`` there is no high-water mark: batches may arrive in any order, and ``landed`` need hold none that is loaded
    already. Facts keep the moment they were read from, so that of two rows of a key and minute the later stays, whichever batch
    came first: any order of batches gives the same star. A load reads the missing batches and the days they touch. The ledger is written
    last; a load that broke off before is done again and replaces its own rows.
    """
    moment = f"_{ts}"
    fresh = I.unloaded(landed, find_layer(spark, ledger_path), batch_col)
    fresh = stage(fresh.select(column(batch_col), column(ts), *[column(c) for c in [*keys, *measures]]), "batches")
    dates = stage(I.date_dimension(fresh, ts, grain), "dates")
    old_dates, old_fact = find_layer(spark, dim_path), find_layer(spark, fact_path)
    stored_dates = _put(spark, dim_path, old_dates, dates, ["date_key"], grain)
    enrich, measures = _with_versions(ts, measures, histories)
    rows = I.fact_rows(enrich(fresh) if enrich else fresh, dates, ts, list(keys), measures, grain, True, moment)
    fact = _put(
        spark, fact_path, old_fact, rows, ["date_key", *keys], grain, latest=True, order_by=[column(moment).desc_nulls_last()])
    K.write_layer(I.batch_entries(fresh, batch_col), ledger_path, "append", rebalance=True)
    return Star(stored_dates, fact.drop(moment))
