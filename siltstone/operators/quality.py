"""Checks on finished tables. A check returns the rows that fail it; an empty result passes.

Values are counted before they are joined or shuffled, so a value shared by a third of the rows
arrives as one row per map task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.values import column

_KINDS = ("not_null", "unique", "relationships", "primary_key", "foreign_key")


def _names(columns: str | Sequence[str]) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def dq_not_null(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    """Rows with a NULL in any of the columns."""
    return df.filter(reduce(or_, [column(c).isNull() for c in _names(columns)]))


def dq_unique(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    """Values that occur more than once, with their count; NULLs are not values."""
    names = _names(columns)
    present = df.filter(reduce(and_, [column(c).isNotNull() for c in names]))
    counted = present.groupBy(*[column(c) for c in names]).agg(F.count(F.lit(1)).alias("n_records"))
    return counted.filter(F.col("n_records") > 1)


def dq_primary_key(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    """Keys that are repeated or hold a NULL, with their count."""
    names = _names(columns)
    counted = df.groupBy(*[column(c) for c in names]).agg(F.count(F.lit(1)).alias("n_records"))
    return counted.filter((F.col("n_records") > 1) | reduce(or_, [column(c).isNull() for c in names]))


def dq_relationships(
    child: DataFrame, columns: str | Sequence[str], parent: DataFrame, parent_columns: str | Sequence[str]
) -> DataFrame:
    """Child values that the parent lacks, with their count; NULLs refer to nothing."""
    names, parents = _names(columns), _names(parent_columns)
    present = child.filter(reduce(and_, [column(c).isNotNull() for c in names]))
    counted = present.groupBy(*[column(c) for c in names]).agg(F.count(F.lit(1)).alias("n_records"))
    known = parent.select(*[column(p).alias(f"_p{i}") for i, p in enumerate(parents)]).distinct()
    same = reduce(and_, [column(c) == F.col(f"_p{i}") for i, c in enumerate(names)])
    return counted.join(known, same, "left_anti")


def dq_foreign_key(
    child: DataFrame, columns: str | Sequence[str], parent: DataFrame, parent_columns: str | Sequence[str]
) -> DataFrame:
    """Whole child rows that refer to no parent row.

    Only the orphaned values meet the child again, and those are few unless the data is broken.
    """
    names = _names(columns)
    orphans = dq_relationships(child, columns, parent, parent_columns)
    orphans = orphans.select(*[column(c).alias(f"_o{i}") for i, c in enumerate(names)])
    same = reduce(and_, [column(c) == F.col(f"_o{i}") for i, c in enumerate(names)])
    return child.join(orphans, same, "left_semi")


@dataclass(frozen=True)
class Check:
    """A declared check: kind, table, column(s), and for references the parent's."""

    kind: str
    table: str
    columns: str | Sequence[str]
    parent: str | None = None
    parent_columns: str | Sequence[str] | None = None

    def __post_init__(self) -> None:
        if self.kind not in _KINDS:
            raise ValueError(f"unknown check {self.kind!r}; known: {_KINDS}")

    @property
    def key_set(self) -> tuple[str, tuple[str, ...]]:
        return self.table, tuple(_names(self.columns))

    @property
    def parent_set(self) -> tuple[str, tuple[str, ...]]:
        return self.parent, tuple(_names(self.parent_columns))

    @property
    def label(self) -> str:
        return ",".join(_names(self.columns))


def dq_suite(tables: Mapping[str, DataFrame], checks: Sequence[Check]) -> DataFrame:
    """(test, table, column, failures), one row per check, 0 failures included.

    A not_null check over several columns gives one row per column.

    ``failures`` counts failing rows for not_null, failing values for the others. All not_null checks of one table share one pass over the
    columns they name. All other checks are planned by key set, which is a table with columns: sets that references tie together are counted
    in one shuffle of their values, each set read once and combined before it is shuffled, however many checks it serves as unique, primary
    key, child or parent.
    """
    parts = [_null_failures(table, tables[table], checks) for table in dict.fromkeys(c.table for c in checks if c.kind == "not_null")]
    parts += [_key_failures(tables, sets, [c for c in checks if c.kind != "not_null" and c.key_set in sets]) for sets in _tied(checks)]
    return reduce(DataFrame.unionByName, parts)


def _reported(counts: DataFrame, rows: Sequence[tuple[str, str, str]]) -> DataFrame:
    """One row per (test, table, column) from one row of failures ``_0``, ``_1`` …"""
    told = F.array(*[
        F.struct(F.lit(test).alias("test"), F.lit(table).alias("table"), F.lit(name).alias("column"), F.col(f"_{i}").alias("failures"))
        for i, (test, table, name) in enumerate(rows)])
    return counts.select(F.explode(told).alias("_c")).select("_c.*")


def _null_failures(table: str, df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    names = list(dict.fromkeys(n for c in checks if c.kind == "not_null" and c.table == table for n in _names(c.columns)))
    nulls = df.agg(*[F.count_if(column(n).isNull()).alias(f"_{i}") for i, n in enumerate(names)])
    return _reported(nulls, [("not_null", table, n) for n in names])


_KeySet = tuple[str, tuple[str, ...]]


def _tied(checks: Sequence[Check]) -> list[list[_KeySet]]:
    """Key sets in groups that references tie together, each group counted as a whole."""
    groups: list[list[_KeySet]] = []
    for check in checks:
        if check.kind == "not_null":
            continue
        own = [check.key_set, *([check.parent_set] if check.parent else [])]
        met = [g for g in groups if any(k in g for k in own)]
        groups = [g for g in groups if g not in met] + [list(dict.fromkeys([k for g in met for k in g] + own))]
    return groups


def _key_failures(tables: Mapping[str, DataFrame], sets: Sequence[_KeySet], checks: Sequence[Check]) -> DataFrame:
    keys = [f"_k{i}" for i in range(len(sets[0][1]))]
    values = [
        tables[table].select(*[column(n).alias(k) for n, k in zip(names, keys, strict=True)], F.lit(number).alias("_set"))
        for number, (table, names) in enumerate(sets)]
    counted = reduce(DataFrame.unionByName, values).groupBy(*keys).agg(
        *[F.count_if(F.col("_set") == number).alias(f"_n{number}") for number in range(len(sets))])
    whole = reduce(and_, [F.col(k).isNotNull() for k in keys])
    n = lambda key_set: F.col(f"_n{sets.index(key_set)}")

    def failing(check: Check) -> Column:
        times = n(check.key_set)
        if check.kind == "unique":
            return whole & (times > 1)
        if check.kind == "primary_key":
            return (times > 1) | ((times > 0) & ~whole)
        return whole & (times > 0) & (n(check.parent_set) == 0)

    failures = counted.agg(*[F.count_if(failing(c)).alias(f"_{i}") for i, c in enumerate(checks)])
    return _reported(failures, [(c.kind, c.table, c.label) for c in checks])
