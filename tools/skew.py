"""Time the shuffling operators on a replicated table, evenly spread and with one key in a third of all rows.

python tools/skew.py [copies] – orders at sf0.1 times ``copies``; broadcasts are off, as for big tables.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from siltstone.operators import batches as B  # noqa: E402
from siltstone.operators import history as H  # noqa: E402
from siltstone.operators import incremental as I  # noqa: E402
from siltstone.operators import quality as Q  # noqa: E402
from siltstone.sinks.staging import stage  # noqa: E402


def replicated(spark: SparkSession, copies: int, hot: bool) -> DataFrame:
    """Order states at distinct moments; hot: customer 0 has every third of them."""
    orders = spark.read.parquet("/root/testdata/sf0.1/orders.parquet")
    many = orders.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    seed = F.xxhash64("o_orderkey", "copy")
    key = F.pmod(seed, F.lit(15000 * copies))
    if hot:
        key = F.when(F.pmod(F.shiftright(seed, 7), F.lit(3)) == 0, F.lit(0)).otherwise(key)
    moment = F.expr("timestamp_ntz '2020-01-01'") + F.make_dt_interval(secs=F.pmod(F.shiftright(seed, 20), F.lit(94608000)).cast("decimal(18,6)"))
    return many.select(key.alias("key"), moment.alias("at"), "o_orderstatus", "o_orderpriority", "o_totalprice")


def main(copies: int) -> None:
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "64")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g")
        .config("spark.sql.autoBroadcastJoinThreshold", "-1")
        .config("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "16MB")
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8MB").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    for hot in (False, True):
        states = stage(replicated(spark, copies, hot).repartition(16), "states")
        n = states.count()
        rank = [F.col("at").desc()]
        versions = stage(H.scd2_replay(states, "key", ["o_orderstatus"], "at"), "versions").withColumnRenamed("key", "k")
        runs = {
            "dedupe_by_key": lambda: B.dedupe_by_key(states, ["key"], rank),
            "keep_known": lambda: B.keep_known(states, states.select("key"), {"key": "key"}),
            "dq_primary_key": lambda: Q.dq_primary_key(states, ["key"]),
            "date_dimension": lambda: I.date_dimension(states, "at"),
            "upsert": lambda: I.upsert_delete_insert(states, states.filter("o_orderpriority = '1-URGENT'"), ["key", "at"]),
            "scd2_replay": lambda: H.scd2_replay(states, "key", ["o_orderstatus"], "at"),
            "asof_merge_join": lambda: H.asof_merge_join(states, versions.drop("o_orderpriority", "o_totalprice"), {"key": "k"}, "at"),
        }
        for name, run in runs.items():
            begun = time.perf_counter()
            run().write.format("noop").mode("overwrite").save()
            print(f"{'hot ' if hot else 'even'} {n} rows {name}: {time.perf_counter() - begun:.1f} s", flush=True)
    spark.stop()


if __name__ == "__main__":
    main(int(sys.argv[1]) if len(sys.argv) > 1 else 20)
