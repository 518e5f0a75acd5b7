"""Reading a star schema back."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.values import column
from siltstone.operators.history import FROM, version_surrogate, versions_at


@dataclass(frozen=True)
class Role:
    """A dimension in one of its roles: fact column, dimension key, and ``{output: dim column}``."""

    dim: DataFrame
    fact_key: str
    dim_key: str
    columns: Mapping[str, str]
    how: str = "inner"


def star_join(fact: DataFrame, *roles: Role) -> DataFrame:
    """The fact with columns of each role; the same dimension may take part several times.

    Every role joins the fact, so give a dimension that has roles of its own ready joined (a customer with
    its nation): the fact then meets one dimension less.
    """
    for i, role in enumerate(roles):
        key = f"_role{i}"
        picked = role.dim.select(
            column(role.dim_key).alias(key), *[column(c).alias(name) for name, c in role.columns.items()]
        )
        fact = fact.join(picked, column(role.fact_key) == F.col(key), role.how).drop(key)
    return fact


@dataclass(frozen=True)
class AsOfRole:
    """A history in one of its roles: ``{fact column: history key}``, ``{output: history column}``, and the output
    that holds the surrogate key of the version, if wanted."""

    history: DataFrame
    on: Mapping[str, str]
    columns: Mapping[str, str]
    surrogate: str | None = None
    how: str = "left"

    @property
    def outputs(self) -> list[str]:
        return [*self.columns, *([self.surrogate] if self.surrogate else [])]


def asof_star_join(fact: DataFrame, ts: str, *roles: AsOfRole) -> DataFrame:
    """The fact with columns of the versions valid at ``ts``, one for each role; one history may take part several times.

    Intervals are half-open, so no row is multiplied. Under ``how="left"`` a fact without a version gets NULL. Versions are found for all
    roles in one ordered pass (see ``versions_at``); attributes beyond the start and the surrogate are fetched by key and start, an
    equality that shuffles or broadcasts like any lookup.
    """
    if not roles:
        return fact
    found = versions_at(fact, ts, [(role.history, role.on) for role in roles])
    outputs = [name for role in roles for name in role.outputs]
    for i, role in enumerate(roles):
        since = f"_from{i}"
        if role.how == "inner":
            found = found.filter(F.col(since).isNotNull())
        if role.surrogate:
            found = found.withColumn(role.surrogate, version_surrogate(role.history, role.on, since))
        late = {name: c for name, c in role.columns.items() if c != FROM}
        found = found.withColumns({name: F.col(since) for name, c in role.columns.items() if c == FROM})
        if late:
            keys = {f: f"_asof_{n}" for n, f in enumerate(role.on)}
            versions = role.history.select(
                *[column(d).alias(keys[f]) for f, d in role.on.items()], column(FROM).alias("_since"),
                *[column(c).alias(name) for name, c in late.items()])
            same = F.col(since) == F.col("_since")
            for f, k in keys.items():
                same = same & (column(f) == F.col(k))
            found = found.join(versions, same, "left").drop("_since", *keys.values())
    return found.select(*[column(c) for c in [*fact.columns, *outputs]])


def read_fact(fact: DataFrame, dates: DataFrame) -> DataFrame:
    """The fact with the date spelled out in place of its key."""
    kept = [c for c in fact.columns if c != "date_key"]
    return star_join(fact, Role(dates, "date_key", "date_key", {"date": "date"})).select(
        "date", *[column(c) for c in kept]
    )


def preview(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first ``n`` rows; by ``order``, then by every column, so that it is always the same ``n``."""
    return df.orderBy(*order, *[column(c) for c in df.columns]).limit(n)
