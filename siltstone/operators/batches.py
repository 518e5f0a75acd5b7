"""Choosing rows: the latest batch, one row per key, known codes only."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.values import column


def latest_batch(df: DataFrame, order_col: str = "_ingested_at") -> DataFrame:
    """Rows holding the largest value of a column; none if it is NULL throughout.

    The maximum is a scalar subquery: Spark runs it first and pushes the value into the scan, so
    a table partitioned or sorted by the batch column reads one batch.
    """
    newest = df.agg(F.max(column(order_col))).scalar()
    return df.filter(column(order_col) == newest)


def dedupe_by_key(df: DataFrame, keys: Iterable[str], order_by: Iterable[Column] = ()) -> DataFrame:
    """Exactly one row per key: the first by ``order_by``, remaining ties by all other columns.

    Keys that are NULL form one group. Spark keeps at most one row per key in each map task before
    the shuffle (WindowGroupLimit), so a key holding a third of the table costs no more than others.
    """
    keys = list(keys)
    ties = [column(c).desc_nulls_last() for c in df.columns if c not in keys]
    order = Window.partitionBy(*[column(k) for k in keys]).orderBy(*order_by, *ties)
    return df.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") == 1).drop("_rank")


def keep_known(df: DataFrame, reference: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rows whose every mapped column occurs in the reference column named for it.

    Semi-joins: duplicate reference rows never multiply rows and NULL never matches. Spark
    broadcasts the list when its measured size is below ``spark.sql.autoBroadcastJoinThreshold``;
    beyond that it sorts and merges, and adaptive execution splits hot keys. The list is reduced to
    distinct codes before it is shuffled, since only the checked side can be split.
    """
    for name, ref_name in mapping.items():
        known = reference.select(column(ref_name).alias("_known")).distinct()
        df = df.join(known, column(name) == F.col("_known"), "left_semi")
    return df
