from datetime import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siltstone.domains import exchange_rates as fx
from siltstone.operators import landing as L
from siltstone.operators import validation as VAL
from siltstone.plans import layers as P
from siltstone.sinks import staging, tables as K
from siltstone.sources import layers as SRC
from frames import rows

CURRENCY = {"id": 1, "name": " Euro&nbsp;", "short_code": "EUR", "code": "8", "precision": 2, "subunit": 100, "symbol": "€",
            "symbol_first": True, "decimal_mark": ",", "thousands_separator": "."}


def currencies(spark, *changes):
    return spark.createDataFrame([tuple({**CURRENCY, **c}.values()) for c in changes], fx.CURRENCIES_SCHEMA)


def test_dimension_recipe(spark):
    landed = currencies(spark, {}, {"id": 0, "precision": 4, "symbol_first": None, "symbol": " "}, {"code": "123", "thousands_separator": " "},
                        {"code": "1234"},
                        {"id": None, "short_code": "EURO", "decimal_mark": ",,", "thousands_separator": ".."})
    valid, rejected = P.silver_dimension(landed, fx.CURRENCIES_RULES, ["code"])
    assert rows(valid.select("name", "code", "thousands_separator")) == [("Euro", "008", "."), ("Euro", "123", None)]
    assert rows(rejected.select(VAL.ERRORS)) == sorted([
        ("code must be 3 characters long",),
        ("id below min 1; precision above max 3; symbol_first is required; symbol is required",),
        ("id is required; short_code must be 3 characters long; decimal_mark must be 1 characters long; "
         "thousands_separator must be 1 characters long",)], key=str)


def test_fact_recipe(spark):
    old, new = datetime(2024, 1, 1), datetime(2024, 1, 2)
    data = [("EUR", "USD", "1.1", old, old), ("EUR", "USD", "1.2", new, new), ("EUR", "USD", "1.3", new, new), ("EUR", "XAU", "9", new, new),
            ("USD", "EUR", "-1", new, new), ("USD", "EUR", None, None, new), ("USD", "EUR", None, None, new)]
    rates = spark.createDataFrame(data, "curr_base string, currency string, rate string, rate_date timestamp, _ingested_at timestamp")
    rates = rates.withColumn("rate", F.col("rate").cast("decimal(20,10)"))
    known = spark.createDataFrame([("EUR",), ("USD",), ("USD",)], "short_code string")
    valid, rejected = P.silver_fact(rates, known, {"curr_base": "short_code", "currency": "short_code"}, fx.RATES_RULES, fx.RATES_KEY)
    assert [str(r.rate) for r in valid.collect()] == ["1.3000000000"]
    assert rows(rejected.select(VAL.ERRORS)) == sorted(
        [("rate must be more than 1e-06",)] + [("rate_date is required; rate is required",)] * 2, key=str)


def test_write_split_and_rerun(spark, tmp_path):
    df = spark.range(100).select(F.col("id").cast("int").alias("n"), (F.col("id") % 10).alias("k"), F.lit("b1").alias("_batch_id"))
    valid, out = str(tmp_path / "valid"), str(tmp_path / "out")
    for _ in range(2):
        counts = K.write_split(VAL.validate(df, {"n": {"min": 10}}), valid, out, unique=["k"])
        assert counts == {"n_input": 100, "n_rejected": 10, "n_valid": 90}
        assert spark.read.parquet(valid).count() == 10
        assert spark.read.parquet(out).count() == 10
    K.write_split(VAL.validate(df.withColumn("_batch_id", F.lit("b2")), {"n": {"min": 95}}), valid, out)
    assert rows(spark.read.parquet(out).groupBy("_batch_id").count()) == [("b1", 10), ("b2", 95)]
    K.write_split(VAL.validate(df.withColumn("_batch_id", F.lit("b3")), {"n": {"min": 0}}), valid, out)
    assert spark.read.parquet(out).count() == 105 and spark.read.parquet(valid).count() == 100


def test_write_layer_files(spark, tmp_path):
    df = spark.range(1000, numPartitions=8).withColumn("p", F.col("id") % 3)
    K.write_layer(df, str(tmp_path / "one"), rebalance=True)
    assert len(list((tmp_path / "one").glob("*.parquet"))) == 1
    K.write_layer(df, str(tmp_path / "parts"), partition_by=["p"], sort_by=["id"])
    assert [len(list(d.glob("*.parquet"))) for d in sorted((tmp_path / "parts").glob("p=*"))] == [1, 1, 1]
    K.write_layer(df, str(tmp_path / "parts"), "append", ["p"])
    assert spark.read.parquet(str(tmp_path / "parts")).count() == 2000


def test_read_optional(spark, tmp_path):
    schema = StructType().add("n", "integer")
    assert SRC.read_optional(spark, str(tmp_path / "absent"), schema).schema == schema
    spark.range(3).select(F.col("id").cast("int").alias("n")).write.parquet(str(tmp_path / "there"))
    assert SRC.read_optional(spark, str(tmp_path / "there"), schema).count() == 3
    with pytest.raises(AnalysisException):
        SRC.read_layer(spark, str(tmp_path / "absent"))


def test_registered_and_staged_tables(spark, tmp_path):
    df = L.add_lineage(currencies(spark, {}), "api", "2024-01-01 00:00:00")
    path = SRC.layer_path(str(tmp_path) + "/", "bronze", "currencies")
    assert path == f"{tmp_path}/bronze/currencies"
    K.write_layer(df, path)
    schema = StructType(fx.CURRENCIES_SCHEMA.fields + fx.LINEAGE_SCHEMA.fields)
    assert SRC.register_layer(spark, "bronze_currencies", path, schema).columns == schema.names
    assert spark.sql("SELECT short_code FROM bronze_currencies").first()[0] == "EUR"
    K.load_stage(df.withColumn("id", F.lit(7)).select(*reversed(df.columns)), "bronze_currencies")
    assert spark.table("bronze_currencies").first().id == 7
    built = K.materialize_table(df.select("id", "name"), "dim_currencies", str(tmp_path / "dim"))
    assert K.materialize_table(built.select("id").withColumn("z", F.lit(1)).limit(0), "dim_other", str(tmp_path / "o")).columns == ["id", "z"]
    assert built.columns == ["id", "name"]


def test_staging_uses_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    assert staging.staging_path(spark, "x").startswith(shared)
    staged = staging.stage(spark.range(5).withColumn("odd", F.col("id") % 2 == 1), "s", ["odd"])
    assert staged.filter("odd").count() == 2 and staged.schema["odd"].dataType.simpleString() == "boolean"


def test_counts_ride_along(spark, tmp_path):
    df, seen = K.layer_counts(spark.range(10), "counted", largest=F.max("id"))
    K.write_layer(df, str(tmp_path / "t"))
    assert seen.get == {"rows": 10, "largest": 9}


class Recorder:
    """Stands in for a writer, to see what a JDBC load asks of it."""

    def __init__(self):
        self.asked = {}

    def mode(self, mode):
        self.asked["mode"] = mode
        return self

    def option(self, name, value):
        self.asked[name] = value
        return self

    def jdbc(self, url, table, properties):
        self.asked.update(url=url, table=table, properties=properties)


def test_jdbc_load_keeps_the_definition():
    class Frame:
        write = Recorder()

    K.load_stage(Frame, "public.rates_stage", "jdbc:postgresql://db/x", {"user": "u"})
    assert Frame.write.asked == {"mode": "overwrite", "truncate": "true", "batchsize": 10_000,
                                 "url": "jdbc:postgresql://db/x", "table": "public.rates_stage", "properties": {"user": "u"}}


def test_a_rerun_without_rejects_empties_its_batches(spark, tmp_path):
    valid, bad = str(tmp_path / "valid"), str(tmp_path / "bad")

    def run(*found):
        annotated = spark.createDataFrame(found, f"n int, _batch_id string, {VAL.ERRORS} string")
        K.write_split(annotated, valid, bad)
        return rows(spark.read.parquet(bad).select("n", "_batch_id"))

    assert run((1, "b 1", "wrong"), (2, "b 2", "wrong")) == [(1, "b 1"), (2, "b 2")]
    assert run((1, "b 1", ""), (3, "b 3", "wrong")) == [(2, "b 2"), (3, "b 3")]
    assert run((2, "b 2", ""), (3, "b 3", "")) == []


def test_first_load_of_an_empty_batch(spark, tmp_path):
    staged = spark.createDataFrame([], "ts timestamp_ntz, k string, v double")
    dim, fact = str(tmp_path / "dim"), str(tmp_path / "fact")
    star = P.load_star(spark, staged, dim, fact, "ts", ["k"], ["v"])
    assert (star.dim_date.count(), star.fact.count()) == (0, 0)
    one = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 10:00:00' AS ts, 'a' AS k, 1D AS v")
    assert P.load_star(spark, one, dim, fact, "ts", ["k"], ["v"]).fact.count() == 1
