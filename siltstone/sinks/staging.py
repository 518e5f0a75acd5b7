"""Tables written aside: to cut lineage, to read a result twice, to replace a table it came from.

They live in the folder the cluster names in ``spark.checkpoint.dir`` or, where that is unset, below the warehouse: both are
shared, so they outlive any executor.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def staging_root(spark: SparkSession) -> str:
    """The shared folder for staged tables."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def staging_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used yet."""
    return f"{staging_root(spark)}/siltstone/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """The frame, written once and read back."""
    path = staging_path(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
