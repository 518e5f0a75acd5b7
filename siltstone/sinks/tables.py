"""Writing layers, quarantine tables, staging tables and upserts."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from datetime import datetime
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from siltstone.functions.values import column
from siltstone.operators.batches import dedupe_by_key
from siltstone.operators.history import TO, scd2_snapshot, scd2_splice
from siltstone.operators.incremental import upsert_delete_insert, upsert_latest
from siltstone.operators.validation import ERRORS
from siltstone.sinks.staging import stage
from siltstone.sources.layers import find_layer

# Fixed value: rows per JDBC round trip.
JDBC_BATCH_SIZE = 10_000

_CLOSED, _OPEN = "closed_at", "open"


def write_layer(
    df: DataFrame,
    path: str,
    mode: str = "overwrite",
    partition_by: Sequence[str] = (),
    sort_by: Sequence[str] = (),
    fmt: str = "parquet",
    replace_partitions: bool = False,
    rebalance: bool | None = None,
) -> None:
    """Write a layer table; a failed write raises.

    A partitioned table is rebalanced first, which costs a shuffle and saves a file per task and
    partition value: adaptive execution merges small shuffle partitions (a value becomes one file) and
    splits big ones (a value holding a third of the rows becomes many files, not one task). Set
    ``rebalance`` for a small unpartitioned table that should be one file. ``sort_by`` orders rows
    inside each file, so that min/max statistics let readers skip. ``replace_partitions`` overwrites
    only the partitions ``df`` holds.
    """
    if rebalance or (rebalance is None and partition_by):
        df = df.hint("rebalance", *[column(c) for c in partition_by])
    if sort_by:
        df = df.sortWithinPartitions(*partition_by, *sort_by)
    writer = df.write.format(fmt).mode(mode).partitionBy(*partition_by)
    if replace_partitions:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.save(path)


def write_quarantine(rejected: DataFrame, path: str, batch_col: str = "_batch_id", fmt: str = "parquet") -> None:
    """Add rejected rows, one partition per batch; rerunning a batch replaces its own rows.

    Without rejected rows no partition is touched.
    """
    write_layer(rejected, path, "overwrite", [batch_col], fmt=fmt, replace_partitions=True)


def _clear_batches(staged: DataFrame, path: str, batch_col: str, fmt: str) -> None:
    """Empty the quarantine of batches that were seen and rejected nothing, where it still holds rows of an earlier run of theirs: the
    list has no more values than stored partitions that the run makes stale, and mostly none."""
    batch = column(batch_col)
    stored = find_layer(staged.sparkSession, path, fmt)
    if stored is None:
        return
    clean = staged.groupBy(batch.alias("batch")).agg(F.bool_or("_rejected").alias("rejected")).filter("NOT rejected").select("batch")
    held = stored.select(batch.cast(staged.schema[batch_col].dataType).alias("held")).distinct()
    stale = clean.join(held, F.col("batch").eqNullSafe(F.col("held")), "left_semi")
    _empty_partitions(staged.drop("_rejected"), path, batch_col, [r["batch"] for r in stale.collect()], fmt)


def _empty_partitions(like: DataFrame, path: str, name: str, values: Iterable[Any], fmt: str = "parquet") -> None:
    """Replace stored partitions by none of their rows, which a dynamic overwrite without rows leaves as they are."""
    spark = like.sparkSession
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    for value in values:
        part = f"{path.rstrip('/')}/{escape(name, None if value is None else str(value))}"
        if find_layer(spark, part, fmt) is not None:
            like.filter("false").drop(name).write.format(fmt).mode("overwrite").save(part)


def write_split(
    annotated: DataFrame,
    valid_path: str,
    quarantine_path: str,
    partition_by: Sequence[str] = (),
    unique: Sequence[str] = (),
    batch_col: str = "_batch_id",
    fmt: str = "parquet",
) -> Mapping[str, int]:
    """Write valid rows (replacing the table) and rejected rows (per batch) from one evaluation.

    The annotated rows are staged once, so that neither sink repeats the cleaning and a lost executor
    costs nothing; each sink then scans the staged rows for its verdict, which was faster than
    sorting them into two partitions. ``unique`` keys are deduplicated among valid rows only. Returns
    the counts, observed while staging.
    """
    counts = Observation("split")
    bad = F.col(ERRORS) != ""
    seen = annotated.withColumn("_rejected", bad).observe(
        counts, F.count(F.lit(1)).alias("n_input"), F.count_if(bad).alias("n_rejected")
    )
    staged = stage(seen, "split")
    # The quarantine first: a run that breaks off between the two leaves rejected rows kept and the valid table of the run before.
    write_quarantine(staged.filter("_rejected").drop("_rejected"), quarantine_path, batch_col, fmt)
    _clear_batches(staged, quarantine_path, batch_col, fmt)
    valid = staged.filter(~F.col("_rejected")).drop("_rejected", ERRORS)
    if unique:
        valid = dedupe_by_key(valid, list(unique))
    write_layer(valid, valid_path, "overwrite", partition_by, fmt=fmt)
    found = counts.get
    return {**found, "n_valid": found["n_input"] - found["n_rejected"]}


def touched_partitions(target: DataFrame, new: DataFrame, partition_col: str) -> DataFrame:
    """Rows of ``target`` in the partitions that ``new`` has rows in; only those are read.

    A scalar subquery gathers the touched values, of which there are no more than partitions to be written.
    """
    part = column(partition_col)
    touched = new.agg(F.collect_set(part)).scalar()
    no_value = new.agg(F.bool_or(part.isNull())).scalar()
    return target.filter(F.when(part.isNull(), no_value).otherwise(F.array_contains(touched, part)))


def holding_partitions(target: DataFrame, new: DataFrame, keys: Sequence[str], partition_col: str) -> DataFrame:
    """Values of ``partition_col`` in which ``target`` holds a key of ``new``.

    Reads the keys alone, and of them only files and row groups whose statistics reach the keys' span, a scalar subquery."""
    near = target
    for k in keys:
        low, high = (new.agg(f(column(k))).scalar() for f in (F.min, F.max))
        near = near.filter((column(k) >= low) & (column(k) <= high))
    wanted = new.select(*[column(k).alias(f"_n_{k}") for k in keys]).distinct()
    same = [column(k) == column(f"_n_{k}") for k in keys]
    return near.select(*[column(k) for k in keys], column(partition_col)).join(wanted, same, "left_semi").select(column(partition_col)).distinct()


def upsert_partitions(
    spark: SparkSession,
    path: str,
    new: DataFrame,
    keys: Sequence[str],
    partition_col: str,
    strict: bool = True,
    order_by: Iterable[Column] = (),
    moving: bool = False,
    latest: bool = False,
) -> None:
    """Delete-and-insert ``new`` into a partitioned Parquet table, rewriting only partitions it touches.

    ``partition_col`` must follow from the key (a day from a date key), so that a key cannot sit in another partition; with ``moving`` it
    need not: partitions that hold a key of ``new`` are found first and rewritten too, and a row whose partition changed moves.
    ``latest`` keeps, of stored and new rows of a key, the first by ``order_by`` instead of the new one. The merged rows are staged, then
    swapped in. The table is never read and overwritten in one plan.
    """
    new = stage(new, "upsert-new")
    # Partition values read back from folder names take the type the new rows give them.
    target = spark.read.parquet(path).withColumn(partition_col, column(partition_col).cast(new.schema[partition_col].dataType))
    touched = new.select(column(partition_col))
    if moving:
        touched = stage(touched.unionByName(holding_partitions(target, new, keys, partition_col)).distinct(), "upsert-touched")
    affected = touched_partitions(target, touched, partition_col)
    if latest:
        merged = upsert_latest(affected, new, list(keys), order_by)
    else:
        merged = upsert_delete_insert(affected, new, list(keys), strict, order_by)
    merged = stage(merged, "upsert-merged")
    write_layer(merged, path, "overwrite", [partition_col], list(keys), replace_partitions=True)
    if moving:  # a partition that all rows have left
        left = touched.join(merged.select(column(partition_col).alias("_p")).distinct(), column(partition_col).eqNullSafe(F.col("_p")), "left_anti")
        _empty_partitions(merged, path, partition_col, [r[0] for r in left.distinct().collect()])


def count_keys(spark: SparkSession, path: str, batch: DataFrame, keys: Sequence[str], buckets: int = 256) -> DataFrame:
    """Add a batch to the stored number of rows per key, and return (keys, ``n_records``) of the keys the batch holds.

    The counts are kept by a hash of the key and sorted by it, so a load reads and rewrites only the buckets its keys fall in; the table
    they count is not read. ``n_records`` over 1, or a NULL in a key, breaks a primary key. Adding a batch twice counts it twice.
    """
    names = [column(k) for k in keys]
    bucket = F.pmod(F.xxhash64(*names), F.lit(buckets)).cast("int")
    new = stage(batch.groupBy(*names).agg(F.count(F.lit(1)).alias("n_records")).withColumn("_bucket", bucket), "keys-new")
    stored = find_layer(spark, path)
    merged = new.withColumn("_met", F.lit(True))
    if stored is not None:
        near = touched_partitions(stored, new, "_bucket").withColumn("_met", F.lit(False))
        merged = merged.unionByName(near.select(*merged.columns)).groupBy(*names, "_bucket").agg(
            F.sum("n_records").alias("n_records"), F.bool_or("_met").alias("_met"))
    merged = stage(merged, "keys-merged")
    write_layer(merged.drop("_met"), path, "overwrite", ["_bucket"], list(keys), replace_partitions=True)
    return merged.filter("_met").select(*names, "n_records")


def unknown_keys(met: DataFrame, keys: Sequence[str], stored_parent: DataFrame, parent_keys: Sequence[str], buckets: int = 256) -> DataFrame:
    """Of the keys a batch holds (see ``count_keys``), those that a parent's stored counts lack; only the buckets they fall in are read."""
    names = [column(k) for k in keys]
    types = [stored_parent.schema[p].dataType for p in parent_keys]
    asked = met.filter(reduce(and_, [n.isNotNull() for n in names])).withColumn(
        "_bucket", F.pmod(F.xxhash64(*[n.cast(t) for n, t in zip(names, types)]), F.lit(buckets)).cast("int"))
    near = touched_partitions(stored_parent, asked, "_bucket").select(*[column(p).alias(f"_p{i}") for i, p in enumerate(parent_keys)])
    return asked.join(near, [n == F.col(f"_p{i}") for i, n in enumerate(names)], "left_anti").drop("_bucket")


def _closing_label(at: Column) -> Column:
    return F.date_format(at, "yyyyMMdd'T'HHmmss.SSSSSS")


def save_snapshot(
    spark: SparkSession,
    path: str,
    source: DataFrame,
    key: str | Sequence[str],
    check_cols: Sequence[str],
    as_of: str | datetime,
    **options: Any,
) -> DataFrame:
    """Take a snapshot (see ``scd2_snapshot``) into a stored history, which is returned.

    The history is kept in one partition of open versions and one per closing time, so a snapshot
    reads and rewrites only the open versions and those closed at its own time; the past is not touched.
    """
    keys = [key] if isinstance(key, str) else list(key)
    stored = _stored_history(spark, path)
    own = _closing_label(F.lit(as_of).cast("timestamp_ntz"))
    if stored is not None:
        stored = stored.filter((F.col(_CLOSED) == _OPEN) | (F.col(_CLOSED) == own)).drop(_CLOSED)
    taken = scd2_snapshot(stored, source, keys, list(check_cols), as_of, **options)
    taken = stage(taken.withColumn(_CLOSED, F.coalesce(_closing_label(F.col(TO)), F.lit(_OPEN))), "snapshot")
    write_layer(taken, path, "overwrite", [_CLOSED], keys, replace_partitions=True)
    read = spark.range(1).select(F.explode(F.array(F.lit(_OPEN), own)).alias("label"))
    gone = read.join(taken.select(column(_CLOSED).alias("label")).distinct(), "label", "left_anti")
    _empty_partitions(taken, path, _CLOSED, [r["label"] for r in gone.collect()])
    return _stored_history(spark, path).drop(_CLOSED)


def splice_snapshot(
    spark: SparkSession,
    path: str,
    taken_path: str,
    source: DataFrame,
    key: str | Sequence[str],
    check_cols: Sequence[str],
    as_of: str | datetime,
    hard_deletes: str = "ignore",
    time_type: DataType | None = None,
) -> DataFrame:
    """Take a snapshot of any age (see ``scd2_splice``) into a stored history, which is returned; ``taken_path`` keeps the moments taken.

    The history is laid out as by ``save_snapshot``. Only versions that were open at the snapshot's time or opened later are read and
    written again; the moment is added last, so a run that broke off is done again.
    """
    keys = [key] if isinstance(key, str) else list(key)
    stored, taken = _stored_history(spark, path), find_layer(spark, taken_path)
    label = _closing_label(F.lit(as_of).cast("timestamp_ntz"))
    if stored is None or taken is None:
        touched, after = None, scd2_snapshot(None, source, keys, list(check_cols), as_of, time_type=time_type)
    else:
        touched = stored.filter((F.col(_CLOSED) == _OPEN) | (F.col(_CLOSED) >= label))  # labels sort as times do
        after = scd2_splice(touched.drop(_CLOSED), taken, source, keys, list(check_cols), as_of, hard_deletes)
    after = stage(after.withColumn(_CLOSED, F.coalesce(_closing_label(F.col(TO)), F.lit(_OPEN))), "splice")
    # Labels whose versions all moved to others: no more than snapshots taken since.
    gone = [] if touched is None else [
        r[0] for r in touched.select(_CLOSED).distinct().join(after.select(column(_CLOSED).alias("kept")).distinct(), F.col(_CLOSED) == F.col("kept"), "left_anti").collect()]
    write_layer(after, path, "overwrite", [_CLOSED], keys, replace_partitions=True)
    _empty_partitions(after, path, _CLOSED, gone)
    at = spark.range(1).select(F.lit(as_of).cast("timestamp_ntz").alias("at"))
    write_layer(at if taken is None else at.join(taken, "at", "left_anti"), taken_path, "append")
    return _stored_history(spark, path).drop(_CLOSED)


def _stored_history(spark: SparkSession, path: str) -> DataFrame | None:
    found = find_layer(spark, path)
    return None if found is None else found.withColumn(_CLOSED, F.col(_CLOSED).cast("string"))


def materialize_table(df: DataFrame, name: str, path: str | None = None, fmt: str = "parquet") -> DataFrame:
    """Drop and rebuild a catalogue table."""
    df.write.format(fmt).mode("overwrite").saveAsTable(name, path=path)
    return df.sparkSession.table(name)


def load_stage(
    df: DataFrame,
    table: str,
    jdbc_url: str | None = None,
    properties: Mapping[str, str] | None = None,
    batch_size: int = JDBC_BATCH_SIZE,
) -> None:
    """Replace the rows of an existing table, keeping its definition: over JDBC, or in the catalogue."""
    if jdbc_url is None:
        known = df.sparkSession.table(table).columns
        df.select(*[column(c) for c in known]).write.insertInto(table, overwrite=True)
        return
    writer = df.write.mode("overwrite").option("truncate", "true").option("batchsize", batch_size)
    writer.jdbc(jdbc_url, table, properties=dict(properties or {}))


def layer_counts(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """The frame with row count and ``metrics`` observed by whatever action writes it."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[m.alias(n) for n, m in metrics.items()]), seen
