"""What the operators share: staged tables, components of links, a fixed-size filter, words."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these bytes (``[^\x20\x09-\x0D]+``); ``bytes.split()`` cuts at the same six.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


#: Spark's setting to drop a query's shuffle files when it ends.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scope:
    """Tables staged within a ``passing``."""

    def __init__(self, outer: Scope | None) -> None:
        self._outer, self._made = outer, []

    def add(self, df: DataFrame, path: str) -> None:
        self._made.append((df, path))

    def keep(self, df: DataFrame) -> DataFrame:
        """``df``, a table staged within, which is left to what is around."""
        for made in [x for x in self._made if x[0] is df]:
            self._made.remove(made)
            if self._outer:
                self._outer.add(*made)
        return df

    def drop(self) -> None:
        for df, path in self._made:
            spark = df.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


_SCOPE: ContextVar[Scope | None] = ContextVar("scope", default=None)


@contextmanager
def passing() -> Iterator[Scope]:
    """Drops the tables that are staged within, at its end, but for those kept. What is read later must not rest on them."""
    scope = Scope(_SCOPE.get())
    token = _SCOPE.set(scope)
    try:
        yield scope
    finally:
        _SCOPE.reset(token)
        scope.drop()


def staged(df: DataFrame, label: str, codec: str | None = None, by: str | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage, and a lost executor costs no more
    than a reread. ``codec`` compresses in another way than the session's; ``by`` puts the rows of each value into a folder. The folder is the session's ``spark.checkpoint.dir``, or the warehouse where that is unset.
    What was shuffled for it is dropped at once, not when the driver next collects garbage, as nothing reads it again."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{root.rstrip('/')}/siltstone-llm/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_DROP_SHUFFLES, "false")
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path, partitionBy=by, compression=codec)
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)
    made = spark.read.schema(df.schema).parquet(path)
    if scope := _SCOPE.get():
        scope.add(made, path)
    return made


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, underscored until no column of ``taken`` has it."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def texts(batch: pa.RecordBatch, column: str = "text", step: int = 256) -> Iterator[tuple[int, str]]:
    """Row number and text ('' for null), decoded a few rows at a time."""
    values = batch.column(batch.schema.names.index(column))
    for begin in range(0, len(values), step):
        for i, text in enumerate(values.slice(begin, step).to_pylist(), begin):
            yield i, text or ""


_LINKS_PER_TASK = 100_000


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each linked node can reach. Nodes without a link are absent.

    Alternating large and small stars: every round is two aggregations and two joins on the links alone, so a node
    with many links is pre-aggregated where it lies, and the join on it can be split. Rounds grow with the logarithm
    of the longest chain; each is staged, the last one changes nothing, and it alone stays."""
    with passing() as scope:
        edges = staged(
            links.where(F.col(a) != F.col(b))
            .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
        most, state = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), None
        while True:
            now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if now == state:
                break
            state = now
            tasks = min(most, state[0] // _LINKS_PER_TASK + 1)  # few links are not worth many small files
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).coalesce(tasks)
            large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
            large = large.unionByName(least.where("u != m").select("u", F.col("m").alias("v"))).coalesce(tasks)
            low = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
            small = (
                large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                .unionByName(low.select("u", F.col("m").alias("v")))
                .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
            edges = staged(small.coalesce(tasks), "links")
        scope.keep(edges)
    down = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return down.unionByName(down.select(F.col("component").alias("node"), "component").distinct())


#: Bits of one entry of Spark's bitmap functions, and entries of a filter: 1 MB however many keys it stands for.
_ENTRY_BITS, _ENTRIES = 32768, 256


def key_filter(keys: DataFrame, column: str) -> np.ndarray:
    """A bit per hashed key: 8 M bits, 1 MB, whatever the number of keys. Where keys crowd it lets more rows through;
    what passes is joined with the keys all the same, so it only saves work."""
    bit = F.pmod(F.col(column), F.lit(_ENTRY_BITS * _ENTRIES))
    rows = (
        keys.select(bit.alias("bit"))
        .groupBy((F.col("bit") / _ENTRY_BITS).cast("int").alias("entry"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.pmod(F.col("bit"), F.lit(_ENTRY_BITS)) + 1)).alias("bits"))
        .collect())
    out = np.zeros((_ENTRIES, _ENTRY_BITS // 8), np.uint8)
    for row in rows:
        out[row["entry"]] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which int64 keys may be among those of ``key_filter``."""
    at = keys % (_ENTRY_BITS * _ENTRIES)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def crc_of_id(column: str | Column = "doc_id") -> Column:
    """Unsigned CRC-32 of an id's decimal text."""
    return F.crc32(F.col(column).cast("string").cast("binary") if isinstance(column, str) else column)


def byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}
