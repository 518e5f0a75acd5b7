"""String normalisation as column expressions.

Entities and NFKC have no built-in form, so cleaning is one Arrow UDF for the whole column. It was
measured against the same rules split between built-in functions and a UDF for the rows that need
it: the split was slower for field values, unique or repeated, and for long texts alike.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from siltstone.functions import cleaning

# The rules travel with the UDF, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(cleaning)

# Declared non-deterministic to be evaluated once. Otherwise a filter on a cleaned column, or on errors
# found in it, is pushed below the cleaning (and below earlier joins) together with a second copy of it.
_clean_batch = F.arrow_udf(cleaning.clean_values, StringType()).asNondeterministic()


def clean(value: Column) -> Column:
    """Cleaned form of a string column (see ``cleaning.clean_text`` for the rules).

    Filters written after it stay after it, so put those that shrink the input before it.
    """
    return _clean_batch(value)


def blank_to_null(value: Column) -> Column:
    """NULL for values made of spaces only, the value itself otherwise."""
    return F.when(F.trim(value) != "", value)


def pad_code(value: Column, width: int = 3, fill: str = "0", truncate: bool = False) -> Column:
    """Left-pad a code and leave longer ones whole; ``truncate`` cuts them as ``lpad`` does, so that distinct codes may merge."""
    padded = F.lpad(value, width, fill)
    return padded if truncate else F.when(F.length(value) < width, padded).otherwise(value)
