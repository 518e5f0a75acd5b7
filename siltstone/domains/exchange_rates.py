"""Exchange rates as one configuration of the operators: schemas, rules, keys."""

from __future__ import annotations

from pyspark.sql.types import StructType

from siltstone.operators.quality import Check

# Landed schemas.
CURRENCIES_SCHEMA = (
    StructType()
    .add("id", "integer")
    .add("name", "string")
    .add("short_code", "string")
    .add("code", "string")
    .add("precision", "integer")
    .add("subunit", "integer")
    .add("symbol", "string")
    .add("symbol_first", "boolean")
    .add("decimal_mark", "string")
    .add("thousands_separator", "string")
)
RATES_SCHEMA = (
    StructType()
    .add("curr_base", "string")
    .add("currency", "string")
    .add("rate_date", "timestamp")
    .add("rate", "decimal(20,10)")
)
LINEAGE_SCHEMA = (
    StructType().add("_ingested_at", "timestamp").add("_source_file", "string").add("_batch_id", "string")
)

# Column order in which landed rates are written.
RATES_LANDED = ("curr_base", "currency", "rate", "rate_date", "_ingested_at", "_source_file", "_batch_id")

# Validation rules.
RATES_RULES = {
    "curr_base": {"type": "string", "required": True, "length": 3},
    "currency": {"type": "string", "required": True, "length": 3},
    "rate_date": {"type": "datetime", "required": True, "min_date": "2019-01-01"},
    "rate": {"type": "decimal", "required": True, "max_rate_value": 100000000, "min_rate_value": 0.000001},
}
CURRENCIES_RULES = {
    "id": {"type": "integer", "required": True, "min": 1},
    "name": {"type": "string", "required": True},
    "short_code": {"type": "string", "required": True, "length": 3},
    "code": {"type": "string", "required": True, "length": 3},
    "precision": {"type": "integer", "required": True, "min": 0, "max": 3},
    "subunit": {"type": "integer", "required": True, "min": 1, "max": 1000},
    "symbol": {"type": "string", "required": True},
    "symbol_first": {"type": "boolean", "required": True},
    "decimal_mark": {"type": "string", "required": True, "length": 1, "format": "[.,]"},
    "thousands_separator": {"type": "string", "required": False, "length": 1, "format": "[.,]"},
}

# Keys, and the columns whose change makes a new version.
RATES_KEY = ("curr_base", "currency", "rate_date")
FACT_KEY = ("curr_base", "currency")
CURRENCY_KEY = "short_code"
CURRENCY_CHECK_COLS = (
    "name", "code", "precision", "subunit", "symbol", "symbol_first", "decimal_mark", "thousands_separator",
)
# The dimension's columns.
DIM_CURRENCIES = {
    "currency_key": "short_code",
    "name": "name",
    "code": "code",
    "precision": "precision",
    "subunit": "subunit",
    "symbol": "symbol",
    "symbol_first": "symbol_first",
    "decimal_mark": "decimal_mark",
    "thousands_separator": "thousands_separator",
}

# Columns that must be filled, and declared checks. Uniqueness of the dimension is on the version, since a key may have several.
_STAGED_CURRENCY_COLUMNS = (
    "id", "name", "short_code", "code", "precision", "subunit", "symbol", "symbol_first", "decimal_mark",
)
_DIM_COLUMNS = (
    "currency_key", "name", "code", "precision", "subunit", "symbol", "symbol_first", "decimal_mark",
    "valid_from", "is_current",
)

CHECKS = (
    *[Check("not_null", "currencies", c) for c in _STAGED_CURRENCY_COLUMNS],
    Check("unique", "currencies", "short_code"),
    Check("unique", "currencies", "code"),
    Check("primary_key", "currencies", "short_code"),
    *[Check("not_null", "rates", c) for c in RATES_KEY],
    Check("primary_key", "rates", RATES_KEY),
    Check("foreign_key", "rates", "curr_base", "currencies", "short_code"),
    Check("foreign_key", "rates", "currency", "currencies", "short_code"),
    *[Check("not_null", "dim_currencies", c) for c in _DIM_COLUMNS],
    Check("unique", "dim_currencies", ("currency_key", "valid_from")),
    Check("not_null", "dim_date", ("date_key", "date")),
    Check("unique", "dim_date", "date_key"),
    Check("not_null", "fact_rates", ("curr_base", "currency", "date_key")),
    Check("relationships", "fact_rates", "curr_base", "dim_currencies", "currency_key"),
    Check("relationships", "fact_rates", "currency", "dim_currencies", "currency_key"),
    Check("relationships", "fact_rates", "date_key", "dim_date", "date_key"),
)
