"""High-water marks, delete-and-insert upserts, and the incremental date dimension and fact."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.values import column, date_key, max_literal, truncate_time
from siltstone.operators.batches import dedupe_by_key


def incremental_filter(
    df: DataFrame,
    ts: str,
    target: DataFrame | None,
    target_ts: str,
    full_refresh: bool = False,
    lookback: timedelta = timedelta(0),
) -> DataFrame:
    """Rows later than the target's high-water mark less ``lookback``.

    All rows when there is no target, on a full refresh, and when the target is empty (a comparison
    with a NULL mark would keep nothing, for good). Without a ``lookback``, rows at or before the mark
    are never revisited; with one, rows that arrive up to that much late are loaded, and the upsert
    replaces what it meets again. ``df`` must then still hold the rows loaded within that time.
    """
    if target is None or full_refresh:
        return df
    mark = max_literal(target, target_ts)
    return df if mark is None else df.filter(column(ts) > mark - F.lit(lookback))


def unloaded(landed: DataFrame, ledger: DataFrame | None, batch_col: str = "_batch_id") -> DataFrame:
    """Rows of the batches that the ledger does not hold, whatever their time, so that nothing is too late to load.

    The batch ids are compared first, one row per batch; a scalar subquery gathers the missing ones (no more than batches to load) and
    prunes a table partitioned by batch to them. Rows without a batch id cannot be recorded and are returned every time.
    """
    if ledger is None:
        return landed
    batch = column(batch_col)
    held = ledger.select(batch.alias("_held")).distinct()
    missing = landed.select(batch.alias("_batch")).distinct().join(held, F.col("_batch") == F.col("_held"), "left_anti")
    return landed.filter(batch.isNull() | F.array_contains(missing.agg(F.collect_set("_batch")).scalar(), batch))


def batch_entries(loaded: DataFrame, batch_col: str = "_batch_id") -> DataFrame:
    """What a ledger records of loaded rows: each batch and its number of rows."""
    batch = column(batch_col)
    return loaded.filter(batch.isNotNull()).groupBy(batch.alias(batch_col)).agg(F.count(F.lit(1)).alias("n_rows"))


def upsert_latest(target: DataFrame | None, new: DataFrame, keys: list[str], order_by: Iterable[Column]) -> DataFrame:
    """Of target and new rows one per key, the first by ``order_by``: the result does not depend on which came first."""
    both = new if target is None else target.unionByName(new.select(*target.columns))
    return dedupe_by_key(both, keys, order_by)


def upsert_delete_insert(
    target: DataFrame | None,
    new: DataFrame,
    keys: list[str],
    strict: bool = True,
    order_by: Iterable[Column] = (),
) -> DataFrame:
    """Target rows whose key is not in ``new``, and all of ``new``.

    ``strict`` first reduces ``new`` to one row per key (see ``dedupe_by_key``); without it repeated
    keys inside one batch all land. A NULL in a key equals nothing, so such rows are only added.
    """
    if strict:
        new = dedupe_by_key(new, keys, order_by)
    if target is None:
        return new
    incoming = new.select(*[column(k).alias(f"_n_{k}") for k in keys])
    if not strict:  # repeated keys meet the target once
        incoming = incoming.distinct()
    same = [column(k) == column(f"_n_{k}") for k in keys]
    return target.join(incoming, same, "left_anti").unionByName(new.select(*target.columns))


def date_dimension(df: DataFrame, ts: str, grain: str = "minute") -> DataFrame:
    """Distinct (date_key, date) of a timestamp column; the key is formatted once per distinct date."""
    dates = df.select(truncate_time(column(ts), grain, df.schema[ts].dataType).alias("date")).distinct()
    return dates.select(date_key(F.col("date"), grain).alias("date_key"), "date")


def fresh_dates(
    source: DataFrame,
    ts: str,
    target: DataFrame | None,
    grain: str = "minute",
    full_refresh: bool = False,
    lookback: timedelta = timedelta(0),
) -> DataFrame:
    """The dates a load adds: those of the source rows above the dimension's high-water mark less ``lookback``."""
    return date_dimension(incremental_filter(source, ts, target, "date", full_refresh, lookback), ts, grain)


def incremental_date_dimension(
    source: DataFrame,
    ts: str,
    target: DataFrame | None,
    grain: str = "minute",
    full_refresh: bool = False,
    lookback: timedelta = timedelta(0),
) -> DataFrame:
    """The date dimension after a load."""
    fresh = fresh_dates(source, ts, target, grain, full_refresh, lookback)
    return upsert_delete_insert(None if full_refresh else target, fresh, ["date_key"], strict=False)


def lookup_dim(fact: DataFrame, dim: DataFrame, on: dict[str, str], columns: list[str]) -> DataFrame:
    """Left-join columns of a dimension; a fact without a member gets NULL there."""
    renamed = dim.select(*[column(d).alias(f"_d_{d}") for d in on.values()], *[column(c) for c in columns])
    same = [column(f) == column(f"_d_{d}") for f, d in on.items()]
    return fact.join(renamed, same, "left").drop(*[f"_d_{d}" for d in on.values()])


def fact_cutoff(fact: DataFrame, dates: DataFrame) -> DataFrame:
    """The latest date the fact refers to, as a one-row frame (NULL for an empty fact).

    The fact is reduced to its distinct date keys before the join.
    """
    used = fact.select(F.col("date_key").alias("_used")).distinct()
    return dates.join(used, F.col("date_key") == F.col("_used"), "left_semi").agg(F.max("date").alias("cutoff"))


def fact_rows(
    source: DataFrame, dates: DataFrame, ts: str, keys: list[str], measures: list[str], grain: str, strict: bool,
    moment: str | None = None,
) -> DataFrame:
    """(date_key, keys…, measures…) of the source rows; a date missing from the dimension gives a NULL key. ``moment`` names a column to keep
    the rows' time in.

    ``strict`` keeps one row per keys and date, the latest. That comes before the lookup, which then
    meets fewer rows and, being last, may have its hot dates split by adaptive execution.
    """
    date = truncate_time(column(ts), grain, source.schema[ts].dataType)
    rows = source.select(*[column(c) for c in [*keys, *measures]], column(ts).alias("_ts"), date.alias("_date"))
    if strict:
        rows = dedupe_by_key(rows, ["_date", *keys], [F.col("_ts").desc_nulls_last()])
    found = lookup_dim(rows, dates, {"_date": "date"}, ["date_key"])
    kept = [F.col("_ts").alias(moment)] if moment else []
    return found.select("date_key", *[column(c) for c in [*keys, *measures]], *kept)


def fresh_facts(
    source: DataFrame,
    dates: DataFrame,
    target: DataFrame | None,
    ts: str,
    keys: list[str],
    measures: list[str],
    grain: str = "minute",
    full_refresh: bool = False,
    strict: bool = True,
    lookback: timedelta = timedelta(0),
    enrich: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The facts (date_key, keys…, measures…) a load adds: those of the source rows above the cutoff.

    ``enrich`` adds columns to the rows that are loaded, and only to those.


    The cutoff is lowered by ``lookback`` (see ``incremental_filter``). Two source rows of one key in one
    minute give one fact row, the later; ``strict=False`` keeps both. Above the cutoff only dates from the
    cutoff on can match, so the dimension is cut to them.
    """
    known = target is not None and not full_refresh
    mark = max_literal(fact_cutoff(target, dates), "cutoff") if known else None
    if mark is not None:
        mark = mark - F.lit(lookback)
        source = source.filter(column(ts) > mark)
        dates = dates.filter(F.col("date") >= F.date_trunc(grain, mark).cast(dates.schema["date"].dataType))
    if enrich is not None:
        source = enrich(source)
    return fact_rows(source, dates, ts, keys, measures, grain, strict)


def incremental_fact(
    source: DataFrame,
    dates: DataFrame,
    target: DataFrame | None,
    ts: str,
    keys: list[str],
    measures: list[str],
    grain: str = "minute",
    full_refresh: bool = False,
    strict: bool = True,
    lookback: timedelta = timedelta(0),
    enrich: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The fact after a load (see ``fresh_facts``)."""
    fresh = fresh_facts(source, dates, target, ts, keys, measures, grain, full_refresh, strict, lookback, enrich)
    return upsert_delete_insert(None if full_refresh else target, fresh, ["date_key", *keys], strict=False)
