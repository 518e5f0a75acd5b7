"""Operator 5: near copies by MinHash, with sequential Bayesian verification.

Texts of equal words are one class. Signatures of classes are banded; in every bucket two pivots meet all members, and,
once what that links is known, only members outside a bucket's largest component meet the rest, in bounded
blocks. A pair is compared a batch of hashes at a time and dropped as soon as the posterior chance of a similarity at
the threshold falls below the chosen miss probability; whatever survives is checked on full sets. No group of
copies is ever spelled out in pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import components, staged, table, texts

WORDS, PERCENT = 5, 75
#: 32 bands of 4 miss a pair at the threshold with a chance of 5e-6.
HASHES, BANDS, BATCH, MISS = 128, 32, 16, 1e-5
#: Members outside the largest component, and members they meet, in one block, and the shingles of either.
_FEW, _MANY, _FEW_SHINGLES, _MANY_SHINGLES = 256, 4096, 400_000, 1_600_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ROWS = HASHES // BANDS


def shingles(words: list[bytes]) -> np.ndarray:
    """Distinct 64-bit hashes of runs of five words, ascending; fewer words are one run."""
    if not words:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - WORDS + 1)
    out = hashed[:n].copy()
    for i in range(1, min(WORDS, len(words))):
        out = ((out ^ (out >> np.uint64(31))) * _MIX) + hashed[i : i + n]
    out ^= out >> np.uint64(29)
    return np.unique(out * _MIX)


def folded(text: str) -> list[bytes]:
    """Words with A-Z in lower case."""
    return text.encode().lower().split()


@lru_cache(maxsize=1)
def _family() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(5)
    return draw.integers(0, 1 << 32, HASHES, np.uint32), draw.integers(0, 1 << 32, HASHES, np.uint32) | np.uint32(1)


def signatures(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """One row of 16-bit minima for each set; sets follow each other in ``values``."""
    folded32 = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(begins), HASHES), np.uint16)
    for k, (x, a) in enumerate(zip(*_family(), strict=True)):
        hashed = (folded32 ^ x) * a
        hashed ^= hashed >> np.uint32(15)
        out[:, k] = np.minimum.reduceat(hashed, begins).astype(np.uint16)
    return out


@lru_cache(maxsize=1)
def fewest() -> np.ndarray:
    """Equal hashes a pair needs after each batch: with a flat prior and k of m equal, the similarity is at the threshold or
    above with the chance that a binomial of m + 1 draws gives k at most."""
    out = []
    for m in range(BATCH, HASHES + 1, BATCH):
        chance, k, t = 0.0, -1, PERCENT / 100
        while chance < MISS:
            k += 1
            chance += math.comb(m + 1, k) * t**k * (1 - t) ** (m + 1 - k)
        out.append(k)
    return np.array(out)


def survive(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of two signature matrices may be similar enough."""
    alive, equal = np.arange(len(a)), np.zeros(len(a), np.int64)
    for i, least in enumerate(fewest()):
        cut = slice(i * BATCH, (i + 1) * BATCH)
        equal[alive] += (a[alive, cut] == b[alive, cut]).sum(1)
        alive = alive[equal[alive] >= least]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two full sets are similar enough."""
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u2").reshape(-1, HASHES)


def _marked(docs: DataFrame) -> DataFrame:
    """(doc_id, h1, h2, n_shingles, signature) of every row with an id and a word."""
    names = ["doc_id", "h1", "h2", "n_shingles", "signature"]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            sets = [r[3] for r in rows]
            sizes = np.array([len(s) for s in sets], np.int64)
            made = signatures(np.concatenate(sets), np.cumsum(sizes) - sizes) if rows else []
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()),
                 pa.array(sizes), pa.array([s.tobytes() for s in made], pa.binary())], names=names)

        for batch in batches:
            ids, rows, held = batch.column(0).to_pylist(), [], 0
            for i, text in texts(batch):
                words = folded(text)
                if words and ids[i] is not None:
                    key = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words)), "<i8").tolist()
                    rows.append((ids[i], *key, shingles(words)))
                    held += len(rows[-1][3])
                if held > 100_000:
                    yield out(rows)
                    rows, held = [], 0
            yield out(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        mark, "doc_id long, h1 long, h2 long, n_shingles long, signature binary")


def _banded(nodes: DataFrame) -> DataFrame:
    """(band, key, node) for each band of each class."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i8")  # four 16-bit minima are one key
            band = np.tile(np.arange(BANDS, dtype=np.int32), len(batch))
            yield pa.RecordBatch.from_arrays(
                [pa.array(band), pa.array(made), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], names=["band", "key", "node"])

    return nodes.select("node", "signature").mapInArrow(split, "band int, key long, node long")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose full sets are similar enough."""

    @F.pandas_udf("boolean")
    def close(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([similar(np.frombuffer(a, "<i8"), np.frombuffer(b, "<i8")) for a, b in zip(x, y, strict=True)], dtype=bool)

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    return pairs.join(left, "a").join(right, "b").where(close("of_a", "of_b")).select("a", "b")


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles) of the classes named in ``nodes`` (node, h1)."""

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, keys = [], []
            for _, text in texts(batch):
                words = folded(text)
                keys.append(int(np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words)), "<i8")[0]))
                found.append(shingles(words).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.int64()), pa.array(found, pa.binary())], names=["node", "h1", "shingles"])

    wanted = nodes.select(F.col("node").alias("doc_id"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi")
    made = rows.mapInArrow(full, "node long, h1 long, shingles binary")
    return made.join(nodes.select("node", "h1"), ["node", "h1"], "left_semi").dropDuplicates(["node"])


def _met(members: DataFrame, signed: DataFrame) -> DataFrame:
    """Candidates (a, b) that stay after comparing signatures: in each bucket, two pivots with every member."""

    @F.pandas_udf("boolean")
    def likely(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(survive(_matrix(x), _matrix(y)))

    star = members.select("node", F.explode(F.array("first", "second")).alias("pivot")).where("node != pivot")
    pairs = star.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    left = signed.select(F.col("node").alias("a"), F.col("signature").alias("of_a"))
    right = signed.select(F.col("node").alias("b"), F.col("signature").alias("of_b"))
    return pairs.join(left, "a").join(right, "b").where(likely("of_a", "of_b")).select("a", "b")


def _rest(members: DataFrame, signed: DataFrame, sets: DataFrame, parts: DataFrame) -> DataFrame:
    """Links (a, b) the pivots left open: members outside a bucket's largest component with members of other components.

    They meet in blocks bounded by the sizes of their sets, and are compared and verified there; a block names links that join what
    it has not yet seen joined, so never more than it has members."""
    named = (
        members.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
        .join(sets.select("node", "shingles", (F.length("shingles") / 8).alias("weight")), "node"))
    sizes = named.groupBy("band", "key", "part").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))
    buckets = (
        sizes.groupBy("band", "key")
        .agg(F.max_by(F.struct("part", "n", "weight"), F.struct("n", "part")).alias("main"), F.sum("n").alias("all"), F.sum("weight").alias("weighs"))
        .where("all > 3 AND main.n < all")
        .select(
            "band", "key", F.col("main.part").alias("main"),
            F.ceil(F.greatest((F.col("all") - F.col("main.n")) / _FEW, (F.col("weighs") - F.col("main.weight")) / _FEW_SHINGLES)).alias("few_blocks"),
            F.ceil(F.greatest(F.col("all") / _MANY, F.col("weighs") / _MANY_SHINGLES)).alias("many_blocks")))
    open_ = (
        named.join(buckets, ["band", "key"]).where("node != first AND node != second")
        .withColumn("few", F.col("part") != F.col("main")).join(signed, "node"))
    mine = F.pmod(F.xxhash64("node"), F.col("few_blocks"))
    other = F.pmod(F.xxhash64("node", F.lit(1)), F.col("many_blocks"))
    every_few = F.sequence(F.lit(0).cast("long"), F.col("few_blocks") - 1)
    every_many = F.sequence(F.lit(0).cast("long"), F.col("many_blocks") - 1)
    kept = ["band", "key", "node", "part", "signature", "shingles"]
    dealt = (
        open_.select(*kept, F.lit(False).alias("few"), other.alias("y"), F.explode(every_few).alias("x"))
        .unionByName(open_.where("few").select(*kept, "few", mine.alias("x"), F.explode(every_many).alias("y"))))

    def block(group: pd.DataFrame) -> pd.DataFrame:
        few, many = group[group["few"]], group[~group["few"]]
        out: list[tuple[int, int]] = []
        if len(few) and len(many):
            band, theirs = int(group["band"].iloc[0]), _matrix(many["signature"])
            nodes, labels = many["node"].to_numpy(), many["part"].to_numpy().copy()
            sets_of = [np.frombuffer(x, "<i8") for x in many["shingles"]]
            joined: dict[int, int] = {}
            for node, label, mark, raw in zip(few["node"], few["part"], _matrix(few["signature"]), few["shingles"], strict=True):
                own = np.frombuffer(raw, "<i8")
                while label in joined:
                    label = joined[label]
                at = np.flatnonzero(labels != label)
                at = at[survive(theirs[at], np.broadcast_to(mark, (len(at), HASHES)))]
                same = theirs[at] == mark
                first = same.reshape(-1, BANDS, _ROWS).all(2).argmax(1) == band  # a pair that shares several buckets is met in the first
                at, same = at[first], same[first].sum(1)
                for i in at[np.argsort(-same, kind="stable")].tolist():
                    if labels[i] != label and similar(own, sets_of[i]):
                        out.append((min(node, nodes[i]), max(node, nodes[i])))
                        joined[label] = int(labels[i])
                        labels[labels == label] = labels[i]
                        label = int(labels[i])
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return dealt.groupBy("band", "key", "x", "y").applyInPandas(block, "a long, b long").distinct()


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    A null or wordless text has no shingles and is linked with nothing. Equal texts are linked, whatever their number.
    Rows that repeat a doc_id are one document: they share its component and are kept or not together; if their texts
    differ, the one with the smaller hash is compared. A null doc_id takes no part: its component is null, and it is
    kept. An empty table gives none."""
    marked = staged(_marked(docs), "signatures")
    classes = (
        marked.groupBy("h1", "h2").agg(F.min("doc_id").alias("node"), F.min("signature").alias("signature")))
    nodes = staged(classes, "classes")
    smaller = F.struct("h1", "h2")
    single = nodes.groupBy("node").agg(F.min_by("h1", smaller).alias("h1"))
    banded = staged(_banded(nodes).distinct(), "bands")
    salted = F.xxhash64("band", "key", "node")
    pivots = (
        banded.groupBy("band", "key")
        .agg(F.count("*").alias("n"), F.min_by("node", salted).alias("first"), F.max_by("node", salted).alias("second"))
        .where("n > 1").drop("n"))
    members = staged(banded.join(pivots, ["band", "key"]), "buckets")
    found = members.select("node").distinct()
    signed = staged(nodes.join(found, "node", "left_semi").groupBy("node").agg(F.min_by("signature", smaller).alias("signature")), "candidates")
    sets = staged(_sets(docs, single.join(found, "node", "left_semi")), "sets")
    links = staged(_verified(_met(members, signed), sets), "links")
    rest = staged(_rest(members, signed, sets, components(links)), "rest")
    parts = components(links.unionByName(rest))
    of_class = classes.select("h1", "h2", "node").join(parts, "node", "left").select("h1", "h2", F.coalesce("component", "node").alias("component_id"))
    linked = marked.select("doc_id", "h1", "h2", "n_shingles").join(of_class, ["h1", "h2"]).select("doc_id", "n_shingles", "component_id")
    one = linked.groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.min("n_shingles").alias("n_shingles"))
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    return every.join(one, "doc_id", "left").select(
        "doc_id", F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, columns as they are."""
    gone = near_copies(docs).where("NOT kept").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def op5_bayes_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))
