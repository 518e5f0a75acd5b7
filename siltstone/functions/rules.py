"""Declarative column rules compiled to Catalyst expressions.

A rule set is a plain dict, ``{column: {rule: value}}``. Each violated rule yields one message;
messages of one column are joined with ``", "``, columns with ``"; "``, a valid row has ``""``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, TimestampNTZType

from siltstone.functions.values import column

RuleSet = Mapping[str, Mapping[str, Any]]

# Message texts, in the order in which a column's rules are reported.
MESSAGES = {
    "required": "{column} is required",
    "min": "{column} below min {value}",
    "max": "{column} above max {value}",
    "min_date": '{column} must be later than "{value}"',
    "max_rate_value": "{column} must be less than {value}",
    "min_rate_value": "{column} must be more than {value}",
    "length": "{column} must be {value} characters long",
    "format": "{column} does not match {value}",
}
# Of a value that is not of the type declared for it; the wording is this library's own.
TYPE_MESSAGE = "{column} is not of type {value}"
WITHIN_COLUMN = ", "
BETWEEN_COLUMNS = "; "
# Rules that a falsy value (False, 0, "") switches off; for the others only None does.
OFF_WHEN_FALSY = ("required", "min_date", "length", "format")
# Keys a rule set may carry that describe a column without checking its rows.
DESCRIPTIVE = ("type",)


def _as_moment(value: Any, data_type: DataType | None) -> Column:
    moment = "timestamp_ntz" if isinstance(data_type, TimestampNTZType) else "timestamp"
    return F.lit(value).cast(moment)


# How each rule is violated; a NULL value violates nothing but ``required``.
_VIOLATED: dict[str, Callable[[Column, Any, DataType | None], Column]] = {
    "required": lambda c, v, t: c.isNull(),
    "min": lambda c, v, t: c < v,
    "max": lambda c, v, t: c > v,
    "min_date": lambda c, v, t: c < _as_moment(v, t),
    "max_rate_value": lambda c, v, t: c > v,
    "min_rate_value": lambda c, v, t: c < v,
    "length": lambda c, v, t: F.length(c) != v,
    "format": lambda c, v, t: ~c.rlike(rf"\A(?:{v})\z"),
}


@dataclass(frozen=True)
class Violation:
    """One active rule on one column: when it is broken and what it then says."""

    when: Column
    message: Column


def violations(
    name: str, rules: Mapping[str, Any], data_type: DataType | None = None, check_format: bool = False
) -> list[Violation]:
    """The active rules of a column in reporting order; a rule name nobody knows raises."""
    unknown = set(rules) - set(MESSAGES) - set(DESCRIPTIVE)
    if unknown:
        raise ValueError(f"unknown rules for column {name!r}: {sorted(unknown)}")
    found = []
    for rule, text in MESSAGES.items():
        value = rules.get(rule)
        off = not value if rule in OFF_WHEN_FALSY else value is None
        if off or (rule == "format" and not check_format):
            continue
        message = F.lit(text.format(column=name, value=value))
        found.append(Violation(_VIOLATED[rule](column(name), value, data_type), message))
    return found


def error_column(
    name: str, rules: Mapping[str, Any], data_type: DataType | None = None, check_format: bool = False
) -> Column | None:
    """All messages of one column as one string, ``""`` when valid; None if no rule is active."""
    found = error_or_null(name, rules, data_type, check_format)
    return None if found is None else F.coalesce(found, F.lit(""))


def error_or_null(
    name: str, rules: Mapping[str, Any], data_type: DataType | None = None, check_format: bool = False
) -> Column | None:
    """Like ``error_column`` but NULL when valid: clean rows build no strings at all."""
    found = violations(name, rules, data_type, check_format)
    if not found:
        return None
    any_broken = reduce(or_, [v.when for v in found])
    return F.when(any_broken, F.concat_ws(WITHIN_COLUMN, *[F.when(v.when, v.message) for v in found]))
