"""Reading layer tables, optional ones included, and taking stock of them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def layer_path(root: str, layer: str, table: str) -> str:
    """Where a table lives below a root: any URI Spark can read."""
    return f"{root.rstrip('/')}/{layer}/{table}"


def read_layer(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | None = None, recursive: bool = False
) -> DataFrame:
    """A layer table; ``fmt="delta"`` where that package is on the cluster.

    ``recursive`` takes every file below the path, without reading folder names as columns.
    """
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.load(path)


def find_layer(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | None = None, recursive: bool = False
) -> DataFrame | None:
    """A layer table, or None if its path does not exist or holds no data file and no schema is given."""
    try:
        return read_layer(spark, path, fmt, schema, recursive)
    except AnalysisException as problem:
        if problem.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def read_optional(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet") -> DataFrame:
    """A layer table that may not exist yet: an absent path reads as no rows of the declared schema."""
    found = find_layer(spark, path, fmt, schema)
    return spark.createDataFrame([], schema) if found is None else found


def register_layer(spark: SparkSession, name: str, path: str, schema: StructType, fmt: str = "parquet") -> DataFrame:
    """Register files at a path as an external table with a declared schema."""
    spark.catalog.createTable(name, path=path, source=fmt, schema=schema)
    return spark.table(name)
