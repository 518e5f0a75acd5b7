from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from siltstone.domains import exchange_rates as fx
from siltstone.functions import rules as R
from siltstone.operators import validation as VAL
from siltstone.sources.rulesets import load_rules


def errors(spark, name, kind, values, rules, **options):
    df = spark.createDataFrame([(v,) for v in values], f"{name} {kind}")
    return [r[0] for r in df.select(R.error_column(name, rules, df.schema[name].dataType, **options)).collect()]


@pytest.mark.parametrize("name, kind, rules, values, want", [
    ("title", "string", {"required": True}, ["Dune", None], ["", "title is required"]),
    ("title", "string", {"required": False, "length": 4}, [None, "Emma"], ["", ""]),
    ("pages", "int", {"min": 40}, [None, 41, 40, 39], ["", "", "", "pages below min 40"]),
    ("floor", "int", {"min": -3}, [-4, -3], ["floor below min -3", ""]),
    ("floor", "int", {"max": 12}, [12, 13], ["", "floor above max 12"]),
    ("isbn", "string", {"length": 5}, ["1234", "12345", "ÄÖÜßé", "123456"],
     ["isbn must be 5 characters long", "", "", "isbn must be 5 characters long"]),
    ("isbn", "string", {"length": 0, "required": True}, ["any length"], [""]),
    ("floor", "int", {"min": -3, "max": 12}, [7, 90, -8], ["", "floor above max 12", "floor below min -3"]),
    ("printed", "timestamp", {"min_date": "1987-06-05"}, [datetime(1987, 6, 5), None, datetime(1987, 6, 4, 23)],
     ["", "", 'printed must be later than "1987-06-05"']),
    ("printed", "timestamp_ntz", {"min_date": "1987-06-05"}, [datetime(1987, 6, 5), datetime(1987, 6, 4, 23, 59, 59)],
     ["", 'printed must be later than "1987-06-05"']),
    ("price", "double", {"max_rate_value": 75}, [75.0, 75.5], ["", "price must be less than 75"]),
    ("price", "double", {"min_rate_value": 2}, [1.5, 2.0], ["price must be more than 2", ""]),
    ("rate", "decimal(20,10)", fx.RATES_RULES["rate"],
     [Decimal("100000000.0000000001"), Decimal("0.0000009999"), None, Decimal("100000000"), Decimal("0.000001")],
     ["rate must be less than 100000000", "rate must be more than 1e-06", "rate is required", "", ""]),
    ("n", "int", {"min": 30, "max": 20, "max_rate_value": 22}, [25],
     ["n below min 30, n above max 20, n must be less than 22"]),
])
def test_messages(spark, name, kind, rules, values, want):
    assert errors(spark, name, kind, values, rules) == want


def test_no_active_rule():
    assert R.violations("title", {}) == []
    assert R.error_column("title", {"type": "string", "required": False, "format": "x"}) is None


def test_format_is_opt_in(spark):
    rule = {"format": "[.,]"}
    df = spark.createDataFrame([(".",), ("..",), (None,), (".\n",)], "m string")
    assert [r[0] for r in df.select(R.error_column("m", rule, check_format=True)).collect()] == ["", "m does not match [.,]", "", "m does not match [.,]"]


def test_unknown_rule_raises():
    with pytest.raises(ValueError, match="lenght"):
        R.violations("isbn", {"lenght": 5})


def test_errors_of_later_calls_are_added(spark):
    df = spark.createDataFrame([("99", 3), ("12345", 300), ("99", 300)], "isbn string, pages int")
    first = VAL.validate(df, {"isbn": {"length": 5}})
    second = VAL.validate(first, {"pages": {"min": 40}}, ["pages", "shelf"])
    assert [r[VAL.ERRORS] for r in second.collect()] == [
        "isbn must be 5 characters long; pages below min 40", "", "isbn must be 5 characters long"]


def test_errors_column_is_there_without_rules_or_rows(spark):
    df = spark.createDataFrame([(300,)], "pages int")
    assert VAL.validate(df, {"shelf": {"min": 1}}).first()[VAL.ERRORS] == ""
    assert VAL.validate(df.filter("false"), {"pages": {"min": 40}}).columns == ["pages", VAL.ERRORS]


def test_split_is_disjoint_and_complete(spark):
    df = VAL.validate(spark.range(100).select(F.col("id").cast("int").alias("n")), {"n": {"min": 10, "max": 60}})
    valid, rejected = VAL.split_quarantine(df)
    assert valid.columns == ["n"] and rejected.columns == ["n", VAL.ERRORS]
    assert (valid.count(), rejected.count()) == (51, 49)
    assert VAL.quarantine_counts(df).first() == (100, 51, 49)


def test_types(spark):
    df = spark.createDataFrame(
        [(1, 2, "x", True, datetime(2024, 1, 1), datetime(2024, 1, 1), Decimal(1))],
        "i int, l bigint, s string, b boolean, t timestamp, n timestamp_ntz, d decimal(20,10)")
    assert VAL.columns_of_type(df, "decimal", "datetime") == ["d", "t", "n"]
    assert VAL.columns_of_type(df, "integer", "boolean", "string") == ["i", "l", "b", "s"]
    VAL.check_types(df, {"d": {"type": "decimal"}, "n": {"type": "datetime"}})
    with pytest.raises(TypeError):
        VAL.check_types(df, {"d": {"type": "string"}})


def test_load_rules():
    loaded = load_rules('{"validation": {"rates": {"columns": {"rate": {"min_rate_value": 0.000001}}}}}')
    assert loaded == {"rates": {"rate": {"min_rate_value": 1e-06}}}
    for text in ("", "{}"):
        with pytest.raises(ValueError):
            load_rules(text)
    with pytest.raises(ValueError):
        load_rules('{"validation": {"rates": {"columns": {"rate": {"minimum": 1}}}}}')


def test_load_rules_from_yaml(tmp_path):
    pytest.importorskip("yaml")
    from siltstone.sources.rulesets import read_rules

    file = tmp_path / "rules.yml"
    file.write_text("validation:\n  rates:\n    columns:\n      rate:\n        required: true\n        min_rate_value: 0.000001\n")
    assert read_rules(str(file)) == {"rates": {"rate": {"required": True, "min_rate_value": 1e-06}}}
    file.write_text("")
    with pytest.raises(ValueError):
        read_rules(str(file))


def test_types_are_read_row_by_row(spark):
    rules = {
        "id": {"type": "integer", "required": True, "min": 1}, "rate": {"type": "decimal", "max_rate_value": 10},
        "at": {"type": "datetime"}, "flag": {"type": "boolean"}, "name": {"type": "string", "required": True}, "n": {"type": "integer"}}
    data = [
        ("1", "1.5", "2024-01-02 03:04:05", "true", "a", 1), ("x", "12", "soon", "maybe", None, 2), (" 7 ", " ", "", None, "b", None),
        (None, "1e2", "2024-13-01", "0", "c", 3), ("99999999999", "n/a", None, "no", "d", 4)]
    df = spark.createDataFrame(data, "id string, rate string, at string, flag string, name string, n int")
    read = VAL.cast_types(df, rules)
    assert dict(read.dtypes) | {VAL.ERRORS: "string"} == {
        "id": "int", "rate": "decimal(20,10)", "at": "timestamp", "flag": "boolean", "name": "string", "n": "int", VAL.ERRORS: "string"}
    assert [r.id for r in read.collect()] == [1, None, 7, None, None]
    found = [r[VAL.ERRORS] for r in VAL.validate(read, rules).collect()]
    assert found == [
        "", "id is not of type integer; at is not of type datetime; flag is not of type boolean; id is required; rate must be less than 10; name is required",
        "", "at is not of type datetime; id is required; rate must be less than 10",
        "id is not of type integer; rate is not of type decimal; id is required"]


def test_types_keep_earlier_errors_and_refuse_unknown_ones(spark):
    df = spark.createDataFrame([("x", "was"), ("1", "")], f"id string, {VAL.ERRORS} string")
    read = VAL.cast_types(df, {"id": {"type": "integer"}})
    assert [r[VAL.ERRORS] for r in read.collect()] == ["was; id is not of type integer", ""]
    assert VAL.cast_types(df, {"id": {"type": "string"}}) is df
    assert VAL.cast_types(df.drop(VAL.ERRORS), {}).columns == ["id", VAL.ERRORS]
    assert VAL.cast_types(df, {"id": {"type": "decimal"}}, read_as={"decimal": "decimal(5,2)"}).schema["id"].dataType.simpleString() == "decimal(5,2)"
    with pytest.raises(ValueError, match="unknown types"):
        VAL.cast_types(df, {"id": {"type": "money"}})
