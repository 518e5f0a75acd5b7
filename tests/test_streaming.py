from siltstone.domains import exchange_rates as fx
from siltstone.operators import batches as B
from siltstone.operators import landing as L
from siltstone.streaming.landing import land_new_files
from frames import rows


def test_each_file_lands_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    text = '{"response": {"date": "2026-05-11T11:29:37Z", "base": "%s", "rates": {"USD": 1.5, "JPY": 2}}}\n'

    def run():
        land_new_files(spark, str(tmp_path / "in"), str(tmp_path / "bronze"), str(tmp_path / "progress"),
                       lambda df: L.land_map_payload(df, "payload"), fx.RATES_LANDED, ["curr_base"]).awaitTermination()
        df = spark.read.parquet(str(tmp_path / "bronze"))
        return rows(df.select("curr_base", "currency")), df

    (tmp_path / "in" / "a.json").write_text(text % "EUR")
    first, df = run()
    assert first == [("EUR", "JPY"), ("EUR", "USD")] and set(df.columns) == {*fx.RATES_LANDED, L.CORRUPT}
    assert df.select("_source_file").distinct().first()[0].endswith("a.json")
    assert run()[0] == first
    (tmp_path / "in" / "b.json").write_text(text % "GBP" + '{"response": {"rates": []}}\n')
    both, df = run()
    assert both == [*first, ("GBP", "JPY"), ("GBP", "USD")]
    assert rows(B.latest_batch(df).select("curr_base").distinct()) == [("GBP",)]


def test_all_micro_batches_of_a_run_are_one_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(5):
        (tmp_path / "in" / f"{i}.json").write_text('{"response": {"date": "2026-05-11T11:29:37Z", "base": "B%d", "rates": {"USD": 1.5}}}\n' % i)
    land_new_files(spark, str(tmp_path / "in"), str(tmp_path / "bronze"), str(tmp_path / "progress"),
                   lambda df: L.land_map_payload(df, "payload"), fx.RATES_LANDED, files_per_batch=2).awaitTermination()
    assert B.latest_batch(spark.read.parquet(str(tmp_path / "bronze"))).count() == 5


def test_whole_files_land_and_bad_ones_do_not_stop_the_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def run():
        land_new_files(spark, str(tmp_path / "in"), str(tmp_path / "bronze"), str(tmp_path / "progress"),
                       lambda df: L.land_map_payload(df, "payload"), ["currency", "rate"], whole_files=True).awaitTermination()
        return rows(spark.read.parquet(str(tmp_path / "bronze")).select("currency", L.CORRUPT))

    (tmp_path / "in" / "bad.json").write_text('{"response": {"base": "EUR",\n "rates": {"USD"')
    (tmp_path / "in" / "odd.json").write_text('{"response": {"base": "EUR", "date": "soon", "rates": {"CHF": "n/a"}}}')
    first = run()
    assert [r[0] for r in first if r[0]] == ["CHF"] and sum(r[0] is None for r in first) == 1 and all(r[1] for r in first)
    (tmp_path / "in" / "good.json").write_text('{\n "response": {\n  "date": "2026-05-11T11:29:37Z", "base": "EUR",\n  "rates": {"USD": 1.5}\n }\n}\n')
    assert ("USD", None) in run()
