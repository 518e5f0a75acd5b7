import json
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from siltstone.domains import exchange_rates as fx
from siltstone.functions import values as V
from siltstone.operators import landing as L
from frames import rows


def payload(date='"2026-05-11T11:29:37Z"', rates='{"USD": 1.23456789015, "JPY": null}'):
    return '{"response": {"date": %s, "base": "EUR", "rates": %s}}' % (date, rates)


def test_map_payload(spark):
    df = spark.createDataFrame([(payload(),), (payload(rates="[]"),), (payload(rates="{}"),), (payload(rates="null"),)], "p string")
    when = datetime(2026, 5, 11, 11, 29, 37)
    assert rows(L.land_map_payload(df, "p", ntz=True)) == [
        ("EUR", "JPY", None, when, None), ("EUR", "USD", Decimal("1.2345678902"), when, None)]
    assert L.land_map_payload(df, "p").schema["rate"].dataType.simpleString() == "decimal(20,10)"


def test_map_payload_without_date_and_with_tiny_and_large_numbers(spark):
    df = spark.createDataFrame([(payload("null", '{"A": 0.00000000005, "B": 1e-7, "C": 9999999999.5}'),)], "p string")
    assert [(r.currency, r.rate, r.rate_date) for r in L.land_map_payload(df, "p").orderBy("currency").collect()] == [
        ("A", Decimal("0.0000000001"), None), ("B", Decimal("0.0000001"), None), ("C", Decimal("9999999999.5"), None)]


def test_too_many_integer_digits_raise_or_are_reported(spark):
    df = spark.createDataFrame([(payload(rates='{"A": 12345678901, "B": 2}'), {"A": "12345678901"})], "p string, m map<string,string>")
    with pytest.raises(PySparkException):
        L.explode_map(df, "m", "k", "v").collect()
    assert rows(L.land_map_payload(df, "p", ntz=True).select("currency", "rate", L.CORRUPT)) == [
        ("A", None, "rate: 12345678901"), ("B", Decimal("2"), None)]


def test_no_payload_is_lost(spark):
    broken = [payload()[:-5], payload(rates='"oops"'), payload(rates="[1]"), payload(rates="[]")[:-1], "5", "no json"]
    df = spark.createDataFrame(list(enumerate([*broken, payload(rates="[]"), payload(), payload(date='"soon"', rates='{"A": "n/a", "B": 1}')])), "n int, p string")
    good, bad = L.split_corrupt(L.land_map_payload(df, "p", ntz=True))
    assert good.columns == ["n", "curr_base", "currency", "rate", "rate_date"] and {r.n for r in good.collect()} == {7}
    got = rows(bad)
    assert got[: len(broken)] == [(i, None, None, None, None, text) for i, text in enumerate(broken)]
    assert got[len(broken) :] == [
        (8, "EUR", "A", None, None, "rate: n/a, rate_date: soon"), (8, "EUR", "B", Decimal("1"), None, "rate_date: soon")]


def test_payloads_are_parsed_once(spark):
    df = spark.range(3).select(F.concat(F.lit(payload()), F.col("id").cast("string")).alias("p"))
    landed = L.land_map_payload(df, "p")
    for frame in (landed, *L.split_corrupt(landed)):
        assert frame._jdf.queryExecution().executedPlan().toString().count("from_json") == 1


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Europe/Berlin"])
def test_payload_times_do_not_follow_the_session(spark, zone):
    moments = ["2026-05-11T11:29:37Z", "2024-10-27T00:30:00Z", "2024-10-27T01:30:00Z", "2024-03-10T07:30:00Z", "1969-12-31T23:59:59Z"]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(payload(date=f'"{m}"', rates='{"A": 1}'),) for m in moments], "p string")
        walls = sorted(r.rate_date for r in L.land_map_payload(df, "p", ntz=True).collect())
        seconds = sorted(r[0] for r in L.land_map_payload(df, "p").select(F.unix_seconds("rate_date")).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    wanted = sorted(datetime.strptime(m, "%Y-%m-%dT%H:%M:%SZ") for m in moments)
    assert walls == wanted and seconds == [int((w - datetime(1970, 1, 1)).total_seconds()) for w in wanted]


RECORDS = '{"response": [{"id": 1, "name": "Euro", "short_code": "EUR", "symbol_first": true}, {"id": 2, "name": null}]}'


def test_records_keep_corrupt_payloads(spark):
    df = spark.createDataFrame([(1, RECORDS), (2, "{broken"), (3, '{"response": []}'), (4, '{"response": null}')], "n int, p string")
    got = L.explode_records(df, "p", fx.CURRENCIES_SCHEMA)
    assert got.columns == ["n", *fx.CURRENCIES_SCHEMA.names, L.CORRUPT]
    assert rows(got.select("n", "id", "short_code", "symbol_first", L.CORRUPT)) == [
        (1, 1, "EUR", True, None), (1, 2, None, None, None), (2, None, None, None, "{broken")]


def test_no_document_is_lost(spark):
    """Rows in are rows landed, rows corrupt, and documents that declare themselves empty."""
    kinds = {
        "rows": ['{"response": {"date": "2026-05-11T11:29:37Z", "base": "EUR", "rates": {"USD": 1.5}}}', '{"response": {"rates": {"USD": 2}}}'],
        "empty": ['{"response": {"rates": []}}', '{"response": {"rates": {}}}', '{"response": {"rates": null}}', '{"response": {"base": "EUR", "rates": [ ]}}'],
        "corrupt": ['{"error": "quota"}', "", "  ", None, "[]", "{}", '{"response": {}}', '{"response": null}', '{"response": []}', "42", '"x"', "{cut", '{"response": {"rates": "n/a"}}', '{"response": {"base": "EUR"}}', "null"],
    }
    data = [(kind, i, t) for kind, texts in kinds.items() for i, t in enumerate(texts)]
    landed = L.land_map_payload(spark.createDataFrame(data, "kind string, i int, p string"), "p", ntz=True)
    good, bad = L.split_corrupt(landed)
    assert sorted((r.kind, r.i) for r in good.collect()) == [("rows", 0), ("rows", 1)]
    found = {(r.kind, r.i): r[L.CORRUPT] for r in bad.collect()}
    assert found == {("corrupt", i): t or "" for i, t in enumerate(kinds["corrupt"])} and len(found) == bad.count()


def test_fields_beyond_the_schema_are_rescued(spark):
    texts = [
        '{"response": {"date": null, "base": "EUR", "rates": {"USD": 1.5}, "note": "x", "more": {"a": [1]}}, "version": 2}',
        '{"response": {"base": "EUR", "rates": {"USD": 1.5, "": 2}}}', '{"error": {"code": 7}}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, p string")
    got = L.land_map_payload(df, "p", rescue=True)
    assert got.columns == ["i", "curr_base", "currency", "rate", "rate_date", L.CORRUPT, L.RESCUED]
    assert sorted((r.i, r.currency or "", r[L.CORRUPT], json.loads(r[L.RESCUED] or "null")) for r in got.collect()) == [
        (0, "USD", None, {"version": "2", "response.note": "x", "response.more": '{"a":[1]}'}),
        (1, "", "currency: ", None), (1, "USD", None, None), (2, "", texts[2], {"error": '{"code":7}'})]


def test_records_rescue_and_report(spark):
    schema = fx.CURRENCIES_SCHEMA
    texts = ['{"response": [{"id": 1, "extra": true}, {"id": 2}, {"extra": {"a": 1}}]}', '{"error": "quota"}', "", None, "[1]", '{"response": []}', '{"response": null}']
    got = L.explode_records(spark.createDataFrame(list(enumerate(texts)), "n int, p string"), "p", schema, rescue=True)
    assert got.columns == ["n", *schema.names, L.CORRUPT, L.RESCUED]
    assert rows(got.select("n", "id", L.CORRUPT, L.RESCUED)) == sorted([
        (0, 1, None, '{"extra":"true"}'), (0, 2, None, None), (0, None, None, '{"extra":"{\\"a\\":1}"}'),
        (1, None, texts[1], None), (2, None, "", None), (3, None, "", None), (4, None, "[1]", None)], key=str)


def test_land_whole_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n"response": [\n{"id": 1},\n{"id": 2}]\n}\n')
    (tmp_path / "b.json").write_text('{"error":\n"quota"}')
    got = L.land_records(spark, str(tmp_path), fx.CURRENCIES_SCHEMA, multi_line=True)
    assert rows(got.select("id", L.CORRUPT)) == sorted([(1, None), (2, None), (None, '{"error":\n"quota"}')], key=str)


def test_land_records_from_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(RECORDS + "\n\n{broken\n")
    got = L.land_records(spark, str(tmp_path), fx.CURRENCIES_SCHEMA)
    assert rows(got.select("id", L.CORRUPT)) == [(1, None), (2, None), (None, "{broken")]


def test_lineage(spark):
    df = L.add_lineage(spark.range(2), "events", "2026-05-11 11:29:37")
    assert df.columns == ["id", *L.LINEAGE]
    assert [tuple(r)[2:] for r in df.collect()] == [("events", "20260511_112937")] * 2
    assert df.select("_ingested_at").distinct().count() == 1


def test_time_and_keys(spark):
    df = spark.createDataFrame([("2026-05-11T11:29:37Z",), (None,)], "t string")
    parsed = df.select(V.parse_time(F.col("t"), ntz=True).alias("t"))
    assert [r.t for r in parsed.collect()] == [datetime(2026, 5, 11, 11, 29, 37), None]
    keys = parsed.select(V.date_key(F.col("t")), V.date_key(F.col("t"), "day")).first()
    assert tuple(keys) == (202605111129, 20260511)
    with pytest.raises(PySparkException):
        spark.createDataFrame([("11/05/2026",)], "t string").select(V.parse_time(F.col("t"))).collect()


def test_surrogate_key_tells_null_from_text(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), (None, "a")], "x string, y string")
    assert df.select(V.surrogate_key("x", "y")).distinct().count() == 3


def test_max_literal(spark):
    df = spark.createDataFrame([(1, datetime(2024, 3, 31, 1, 30, 0, 123456), Decimal("1.50"), "b")], "i int, t timestamp, d decimal(5,2), s string")
    for name in df.columns:
        mark = V.max_literal(df, name)
        assert df.filter(F.col(name) == mark).count() == 1 and df.filter(F.col(name) > mark).count() == 0
        assert V.max_literal(df.filter("false"), name) is None
