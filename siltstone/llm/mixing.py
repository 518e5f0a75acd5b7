"""Operator 9: sources mixed to target weights, by capped water-filling.

Sources share the whole by weight; one that would be read more than ``epochs`` times stops there and the rest share
what it leaves, until none is above. A source is then read whole times, and once more in part: documents fall into 4096
seeded buckets, and buckets are taken in order up to the part that is due. Only one row per source and bucket is ever
gathered, so a hot source is added up where it lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import WORD, fresh, staged, table
from siltstone.llm.sharding import running

EPOCHS, WEIGHTS, SEED = 3, (1, 2, 3), 7
#: Three hexadecimal digits of a digest.
_BUCKETS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_key(doc_id: Column, text: Column) -> Column:
    """What a document is drawn by: its id and its text, so that documents without an id, or that share one, are drawn apart."""
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def bucket(key: Column, seed: int) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")


def targets(sizes: DataFrame, epochs: int = EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from rows of source and size. Sources take the weights in turn in code-point order,
    null last. The level rises until no uncapped source is above its cap; every round adds up one row per source."""
    names = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = running(names.withColumn("last", F.col("source").isNull()), ["last", "source"], "source_size")
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    rated = staged(placed.select(
        "source", "source_size", turn.cast("long").alias("weight"), (F.lit(epochs) * F.col("source_size")).alias("cap"),
        "whole"), "sources")
    level = None
    while True:
        capped = F.lit(False) if level is None else F.col("cap") < F.col("weight") * F.lit(level)
        spent, open_weight, whole = rated.agg(
            F.sum(F.when(capped, F.col("cap"))), F.sum(F.when(~capped, F.col("weight"))), F.first("whole")).first()
        now = ((whole or 0) - (spent or 0)) / open_weight if open_weight else 0.0
        if now == level or not open_weight:
            break
        level = now
    share = F.col("weight") * F.lit(float(level or 0.0))
    return rated.select(
        "source", "source_size",
        F.when(F.col("cap") < share, F.col("cap").cast("double")).otherwise(share).alias("target"))


def rates(sizes: DataFrame, seed: int = SEED, epochs: int = EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target, times, cut) from rows of source, key and size: a document is read ``times`` times, and
    once more if its bucket is at most ``cut``."""
    goals = targets(sizes, epochs, weights)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goals = staged(goals.withColumn("times", times.cast("long")), "goals")
    filled = (
        sizes.groupBy("source", bucket(F.col("key"), seed).alias("bucket")).agg(F.sum("size").alias("held"))
        .withColumn("after", F.sum("held").over(
            Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))))
    due = F.col("target") - F.col("times") * F.col("source_size")
    cuts = (
        filled.withColumnRenamed("source", "from")
        .join(goals, F.col("from").eqNullSafe(F.col("source")))
        .where((due > 0) & (F.col("after") - F.col("held") / 2 <= due))
        .groupBy("from").agg(F.max("bucket").alias("cut")))
    return staged(
        goals.join(cuts, F.col("from").eqNullSafe(F.col("source")), "left")
        .select("source", "source_size", "target", "times", F.coalesce("cut", F.lit(-1)).alias("cut")), "rates")


def _taken(sizes: DataFrame, seed: int, epochs: int, weights: tuple[int, ...]) -> DataFrame:
    plan = rates(sizes, seed, epochs, weights).withColumnRenamed("source", "of_source")
    extra = (bucket(F.col("key"), seed) <= F.col("cut")).cast("long")
    return sizes.join(plan, F.col("source").eqNullSafe(F.col("of_source"))).withColumn("copies", F.col("times") + extra)


def mixed(docs: DataFrame, seed: int = SEED, epochs: int = EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``docs`` with every row repeated as often as the mix reads it: columns, names and order of columns stay.

    Size is the number of words; a null text has none. Documents without words are read with their source and weigh
    nothing; in a corpus without a word none is taken. Rows equal in id and text share a bucket and stay together; other rows that share an
    id, or have none, are drawn apart. A null source is a source."""
    row = fresh("row", docs.columns)
    sizes = docs.select(
        F.struct(*docs.columns).alias(row), F.col("source"), mix_key(F.col("doc_id"), F.col("text")).alias("key"),
        word_count(F.col("text")).alias("size"))
    plan = rates(sizes.select("source", "key", "size"), seed, epochs, weights).withColumnRenamed("source", "of_source")
    copies = F.col("times") + (bucket(F.col("key"), seed) <= F.col("cut")).cast("long")
    return (
        sizes.join(plan, F.col("source").eqNullSafe(F.col("of_source")))
        .withColumn("copies", copies).where("copies > 0")
        .select(row, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select(f"{row}.*"))


def op9_capped_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document; see ``mixed`` for nulls, empty texts and repeated rows."""
    sizes = table(spark, sf_dir, "documents").select(
        "source", F.col("doc_id").cast("long").alias("doc_id"), mix_key(F.col("doc_id"), F.col("text")).alias("key"),
        word_count(F.col("text")).alias("size"))
    return _taken(staged(sizes, "sizes"), SEED, EPOCHS, WEIGHTS).select(
        "doc_id", "size", "source_size", "target",
        (F.col("copies") * F.col("size")).alias("taken"))


#: The same in DuckDB's SQL: the level from running sums over sources by rising cap per weight.
OP9_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 3) AS INTEGER) AS bucket
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 AS weight
  FROM d GROUP BY source),
r AS (
  SELECT *, 3 * source_size AS cap, (sum(source_size) OVER ()) AS whole, (sum(weight) OVER ()) AS weights,
    coalesce(sum(3 * source_size) OVER w, 0) AS caps_before, coalesce(sum(weight) OVER w, 0) AS weights_before
  FROM s WINDOW w AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, cap * (weights - weights_before) < weight * (whole - caps_before) AS capped FROM r),
l AS (
  SELECT CAST(any_value(whole) - coalesce(sum(cap) FILTER (capped), 0) AS DOUBLE) / CAST(sum(weight) FILTER (NOT capped) AS DOUBLE) AS level
  FROM c),
t AS (SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE weight * level END AS target FROM c, l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS times FROM t),
f AS (
  SELECT source, bucket, sum(size) AS held, sum(sum(size)) OVER (PARTITION BY source ORDER BY bucket) AS after
  FROM d GROUP BY source, bucket),
k AS (
  SELECT g.source, max(bucket) AS cut FROM f JOIN g ON f.source IS NOT DISTINCT FROM g.source
  WHERE target - times * source_size > 0 AND after - held / 2.0 <= target - times * source_size GROUP BY g.source)
SELECT d.doc_id, d.size, g.source_size, g.target,
  CAST(d.size * (g.times + CASE WHEN d.bucket <= coalesce(k.cut, -1) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN k ON d.source IS NOT DISTINCT FROM k.source
"""
