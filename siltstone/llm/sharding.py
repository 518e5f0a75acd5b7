"""Operator 7: contiguous shards of near equal bytes, from prefix sums of per-partition totals.

Rows are laid out once in range order and written with the number of their partition. A running sum inside each
partition plus the totals of those before it places every row in the whole; equal targets cut it. Nothing but one
total per partition meets in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import staged, table

SHARDS = 8


def running(df: DataFrame, order: list[str], size: str) -> DataFrame:
    """``df`` with ``after`` (sum of ``size`` up to and with the row), ``place`` (from 0) and ``whole`` (sum of all), in
    the order of ``order``. Equal rows are told apart by where they were read, so that no run of ties is one task's."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = staged(
        df.withColumn("tie", F.monotonically_increasing_id())
        .repartitionByRange(parts, *order, "tie").withColumn("part", F.spark_partition_id()), "ranges")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = laid.groupBy("part").agg(F.sum(size).alias("sum"), F.count("*").alias("rows"))
    offsets = totals.select(
        "part", F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("sum_before"),
        F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("rows_before"),
        F.sum("sum").over(Window.partitionBy()).alias("whole"))
    within = Window.partitionBy("part").orderBy(*order, "tie")
    return (
        laid.withColumn("after", F.sum(size).over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("place", F.row_number().over(within))
        .join(offsets, "part")
        .withColumn("after", F.col("after") + F.col("sum_before"))
        .withColumn("place", F.col("place") + F.col("rows_before") - 1)
        .drop("part", "tie", "sum_before", "rows_before"))


def balanced(df: DataFrame, order: list[str], size: str, shards: int = SHARDS) -> DataFrame:
    """``df`` with ``shard`` and ``slot`` (gapless from 0 in each shard). A row goes where the middle of its bytes lies, so
    a shard is off its target by half a row at each end. Nulls in ``order`` come first; equal rows are interchangeable;
    an empty table gives none. ``size`` must be positive. The result has no other columns than ``df`` and these two,
    so ``df`` should bring only what is needed under names other than theirs."""
    placed = running(df, order, size).withColumn(
        "shard", F.expr(f"CAST((2 * after - `{size}`) * {shards} DIV (2 * whole) AS INT)"))
    starts = placed.groupBy(F.col("shard").alias("of")).agg(F.min("place").alias("begin"))
    return (
        placed.join(starts, placed["shard"] == starts["of"])
        .withColumn("slot", F.col("place") - F.col("begin"))
        .drop("of", "begin", "place", "after", "whole"))


def op7_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in doc_id order in shards 0 to 7 of near equal bytes. A null text counts as an empty one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"))
    return balanced(docs, ["doc_id", "text_crc32", "size"], "size").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
