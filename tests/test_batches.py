from datetime import datetime

from pyspark.sql import functions as F

from siltstone.operators import batches as B
from frames import rows


def test_latest_batch(spark):
    df = spark.createDataFrame([(1, datetime(2024, 1, 1)), (2, datetime(2024, 1, 2)), (3, datetime(2024, 1, 2)), (4, None)], "n int, _ingested_at timestamp")
    assert rows(B.latest_batch(df).select("n")) == [(2,), (3,)]
    assert B.latest_batch(df.filter("n = 4")).count() == 0
    assert B.latest_batch(df.filter("false")).count() == 0


def test_latest_batch_is_pushed_into_the_scan(spark, small):
    events = spark.read.parquet(f"{small}/events.parquet")
    plan = B.latest_batch(events, "ts")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(ts,ScalarSubquery" in plan


def test_dedupe_is_total_and_keeps_null_keys_as_one_group(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), (None, 1, "p"), (None, 1, "q"), ("b", None, None)], "k string, n int, s string")
    want = [("a", 2, "z"), ("b", None, None), (None, 1, "q")]
    for parts in (1, 5):
        assert rows(B.dedupe_by_key(df.repartition(parts), ["k"], [F.col("n").desc_nulls_last()])) == sorted(want, key=str)
    assert rows(B.dedupe_by_key(df, ["k"], [F.col("n").asc()]).filter("k = 'a'")) == [("a", 1, "x")]


def test_dedupe_combines_before_the_shuffle(spark):
    """A key holding every row leaves one row per map task for the shuffle."""
    df = spark.range(20000, numPartitions=4).select((F.col("id") % 1).alias("k"), "id")
    unique = B.dedupe_by_key(df, ["k"], [F.col("id").desc()])
    plan = unique._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.rindex("WindowGroupLimit") > plan.index("Exchange")
    assert unique.collect() == [(0, 19999)]


def test_keep_known_never_fans_out(spark):
    ref = spark.createDataFrame([("EUR",), ("EUR",), ("USD",), (None,)], "short_code string")
    df = spark.createDataFrame([("EUR", "USD"), ("EUR", "XAU"), ("BTC", "USD"), (None, "USD"), ("USD", "USD")], "base string, quote string")
    assert rows(B.keep_known(df, ref, {"base": "short_code", "quote": "short_code"})) == [("EUR", "USD"), ("USD", "USD")]
    assert B.keep_known(df, ref.filter("false"), {"base": "short_code"}).count() == 0
