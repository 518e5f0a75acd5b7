"""Neighbouring rows of a key in order, without putting a hot key into one task.

A window partitioned by key hands every row of a key to one task, which serves as long as no key has far more rows than others. Keys are
counted first. Those with more rows than half a task's share are dealt to ranges of (key, order, tie) of about equal size: a hot key
fills many ranges. Their windows run per (key, range), a range to a task. A key goes on from one range to the next only as the last of
the one and the first of the other, so all that must cross is one row per range. Keys and order must not be NULL.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from siltstone.functions.values import column
from siltstone.sinks.staging import stage

RANGE = "_range"

# Rows up to which no key is hot, whatever the number of tasks.
_FEW = 1_000


def _all(names: Sequence[str]) -> list[Column]:
    return [column(n) for n in names]


@dataclass(frozen=True)
class Ordered:
    """Rows whose keys are whole (``n`` is 0), or numbered by range, as written, and how many numbers there are."""

    table: DataFrame
    keys: tuple[str, ...]
    n: int = 0

    @property
    def rows(self) -> DataFrame:
        """All rows; every range in a task of its own, which windows by (key, range) take as it is."""
        return self.deal(self.table)

    def deal(self, rows: DataFrame) -> DataFrame:
        """Rows chosen from the table, dealt like it."""
        return rows.repartitionById(self.n, column(RANGE)) if self.n else rows

    def window(self, order: Sequence[str]):
        return Window.partitionBy(*_all([*self.keys, *([RANGE] if self.n else [])])).orderBy(*_all(order))

    def spanning(self, rows: DataFrame) -> DataFrame:
        """Rows of the keys that go on from the range before; there is one such key in a range at most."""
        key = F.struct(*_all(self.keys))
        ends = self.table.groupBy(RANGE).agg(F.min(key).alias("_first"), F.max(key).alias("_last"))
        before = F.lag("_last").over(Window.orderBy(RANGE))
        going_on = ends.withColumn("_before", before).filter("_first = _before").select(RANGE, "_first.*")
        return rows.join(F.broadcast(going_on), [RANGE, *self.keys], "left_semi")


def _hot_keys(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, int] | None:
    """Keys with more rows than half a task's share, and the number of ranges of that size their rows fill; None if there are none.

    The keys are counted with a partial aggregate. With P tasks there can be no more than 2 P such keys, and only those come back."""
    spark = df.sparkSession
    most, total = 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), Observation("rows")
    counted = df.groupBy(*_all(keys)).agg(F.count(F.lit(1)).alias("_rows")).observe(total, F.sum("_rows").alias("total"))
    top = counted.filter(F.col("_rows") > _FEW).orderBy(F.col("_rows").desc()).limit(most).collect()
    share = max((total.get["total"] or 0) / most, _FEW)
    hot = [r for r in top if r["_rows"] > share]
    if not hot:
        return None
    schema = df.select(*_all(keys)).schema
    return spark.createDataFrame([tuple(r)[:-1] for r in hot], schema), int(sum(r["_rows"] for r in hot) // share) + 1


def in_order(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], work: Callable[[Ordered], DataFrame], tie: Sequence[str] = (),
    counted: DataFrame | None = None,
) -> DataFrame:
    """What ``work`` makes of ``df``, done for hot keys by range and for all others by key.

    Rows equal in keys, order and ``tie`` share a range, so name a ``tie`` where many rows of a key may fall on one moment. ``counted`` are rows
    with the same keys to count instead, where they are quicker to come by. Rows of hot keys are written, numbered, before the work: a range is
    found by sampling, and read twice, it must be the same.
    """
    found = _hot_keys(df if counted is None else counted, keys)
    if found is None:
        return work(Ordered(df, tuple(keys)))
    hot, n = found
    last = Observation("ranges")
    some = df.join(F.broadcast(hot), list(keys), "left_semi")
    dealt = some.repartitionByRange(n, *_all([*keys, *order, *tie])).withColumn(RANGE, F.spark_partition_id())
    written = stage(dealt.observe(last, F.max(RANGE).alias("last")), "ranged")
    ranged = Ordered(written, tuple(keys), (last.get["last"] or 0) + 1)
    others = df.join(F.broadcast(hot), list(keys), "left_anti")
    return work(Ordered(others, tuple(keys))).unionByName(work(ranged).drop(RANGE))


def _crossing(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, step: int) -> DataFrame:
    """(range, keys, value): for each range the last non-NULL ``value`` of all ranges before it, or the first of all ranges after it, with its key.

    One row per range, so ordering them in one task and broadcasting them is bounded by the number of ranges. For what lies before, ``rows``
    must have rows of every range."""
    place = F.when(value.isNotNull(), F.struct(*_all([*keys, *order])))
    entry = F.struct(*[column(k).alias(f"_c{i}") for i, k in enumerate(keys)], value.alias("_crossed"))
    edge = (F.max_by if step < 0 else F.min_by)(entry, place)
    edges = rows.groupBy(column(RANGE).alias("_c_range")).agg(edge.alias("_edge"))
    along = Window.orderBy("_c_range")
    if step < 0:
        passed = F.last("_edge", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
        return edges.withColumn("_edge", passed).filter("_edge IS NOT NULL").select("_c_range", "_edge.*")
    # An edge is what comes next for every range back to that of the edge before it.
    edges = edges.filter("_edge IS NOT NULL")
    since = F.coalesce(F.lag("_c_range").over(along), F.lit(0))
    return edges.withColumn("_since", since).filter("_c_range > 0").select(
        F.explode(F.sequence("_since", F.col("_c_range") - 1)).alias("_c_range"), "_edge.*")


def _with_crossing(rows: DataFrame, keys: Sequence[str], crossing: DataFrame) -> DataFrame:
    same = column(RANGE) == F.col("_c_range")
    for i, k in enumerate(keys):
        same = same & (column(k) == F.col(f"_c{i}"))
    return rows.join(F.broadcast(crossing), same, "left").drop("_c_range", *[f"_c{i}" for i in range(len(keys))])


def neighbour(
    part: Ordered, rows: DataFrame, order: Sequence[str], value: Column, name: str, step: int, edges: DataFrame | None = None
) -> DataFrame:
    """Add ``value`` (never NULL) of the previous (``step=-1``) or next (``step=1``) row of the same key.

    ``rows`` are chosen from those of ``part``, and (keys, order) is unique. What crosses from range to range is taken from ``edges``: by default
    from all of the table, which is right for the previous row of any rows and for the next one of all; for the next one of
    some, from rows that hold at least these of ``spanning`` keys.
    """
    look = F.lag if step < 0 else F.lead
    here = part.window(order)
    if not part.n:
        return rows.withColumn(name, look(value).over(here))
    at_edge = look(F.lit(True)).over(here).isNull()
    inside = rows.withColumns({"_inside": look(value).over(here), "_at_edge": at_edge})
    crossed = _with_crossing(inside, part.keys, _crossing(part.table if edges is None else edges, part.keys, order, value, step))
    return crossed.withColumn(name, F.when(F.col("_at_edge"), F.col("_crossed")).otherwise(F.col("_inside"))).drop("_inside", "_at_edge", "_crossed")


def last_known(part: Ordered, order: Sequence[str], value: str, name: str) -> DataFrame:
    """Add the latest non-NULL ``value`` at or before each row of the same key.

    ``order`` must put a value that applies from a moment on ahead of the rows of that moment.
    """
    upto = part.window(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = F.last(column(value), ignorenulls=True).over(upto)
    if not part.n:
        return part.rows.withColumn(name, latest)
    inside = part.rows.withColumn("_inside", latest)
    crossed = _with_crossing(inside, part.keys, _crossing(part.table, part.keys, order, column(value), -1))
    return crossed.withColumn(name, F.coalesce("_inside", "_crossed")).drop("_inside", "_crossed")
