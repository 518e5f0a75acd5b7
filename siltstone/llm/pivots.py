"""Operator 2: near-duplicate vectors by a pivot-permutation index.

Pivots are vectors of the table that lie apart. Each vector is described by its nearest pivots in order and entered
in the inverted list of each; two vectors that share enough pivots are candidates, met in the list of the smallest pivot
they share and verified there by cosine in double precision. Equal vectors are one entry with a count. Long lists are dealt
into pairs of blocks, and a block passes on one row per vector, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import components, staged, table

COSINE = 0.95
#: Nearest pivots that describe a vector, how many of them candidates share, pivots by the square root of the number of vectors,
#: the least number, the largest cosine between pivots, and entries in a block of a list.
NEAREST, SHARED, PIVOTS_PER_ROOT, LEAST_PIVOTS, APART, BLOCK = 8, 2, 2.0, 48, 0.8, 2048


def _vectors(df: DataFrame, id_: str, vector: str) -> DataFrame:
    """(vec_id, v): finite, non-zero vectors as bytes of doubles' or floats' own width."""
    single = df.schema[vector].dataType.elementType.typeName() == "float"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i is None or not v or None in v:
                    continue
                a = np.array(v, "<f4" if single else "<f8")
                if np.isfinite(a).all() and a.any():
                    ids.append(i)
                    out.append(a.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "v"])

    return df.select(F.col(id_).cast("long"), F.col(vector)).mapInArrow(pack, "vec_id long, v binary")


def _units(values: list[bytes], kind: str) -> np.ndarray:
    """Rows of length 1 in double precision."""
    rows = np.frombuffer(b"".join(values), kind).astype(float).reshape(len(values), -1)
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _pivots(classes: DataFrame, kind: str) -> list[np.ndarray]:
    """Pivots of each dimension that occurs: of the vectors first by hash (four candidates a pivot), those that lie apart. Their number
    grows with the root of the number of vectors."""
    out = []
    for row in classes.groupBy(F.length("v").alias("bytes")).agg(F.count("*").alias("n")).orderBy("bytes").collect():
        wanted = max(LEAST_PIVOTS, math.ceil(PIVOTS_PER_ROOT * math.sqrt(row["n"])))
        drawn = (
            classes.where(F.length("v") == row["bytes"]).select("v", F.xxhash64("v").alias("key")).orderBy("key", "v").limit(4 * wanted).collect())
        units, kept = _units([bytes(r["v"]) for r in drawn], kind), []
        for i in range(len(units)):
            if len(kept) < wanted and (not kept or (units[kept] @ units[i]).max() < APART):
                kept.append(i)
        out.append(units[kept])
    return out


def _listed(classes: DataFrame, pivots: list[np.ndarray], kind: str) -> DataFrame:
    """(pivot, node, copies, nearest, v): an entry of each vector in the list of each of its nearest pivots."""
    by_width = {p.shape[1] * np.dtype(kind).itemsize: p for p in pivots}
    first = dict(zip(by_width, np.cumsum([0, *(len(p) for p in pivots)]).tolist(), strict=False))

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(2).to_pylist()
            for width, of in by_width.items():
                at = [i for i, v in enumerate(values) if len(v) == width]
                if not at:
                    continue
                k = min(NEAREST, len(of))
                near = np.argsort(-(_units([values[i] for i in at], kind) @ of.T), axis=1, kind="stable")[:, :k].astype("<i4") + np.int32(first[width])
                again = np.repeat(at, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(near.ravel().astype(np.int32)), batch.column(0).take(pa.array(again)), batch.column(1).take(pa.array(again)),
                     pa.array([n.tobytes() for n in np.repeat(near, k, axis=0)], pa.binary()), batch.column(2).take(pa.array(again))],
                    names=["pivot", "node", "copies", "nearest", "v"])

    return classes.select("node", "copies", "v").mapInArrow(enter, "pivot int, node long, copies long, nearest binary, v binary")


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position reachable from each of ``n`` by the links (a, b)."""
    out = np.arange(n)
    while True:
        before = out.copy()
        low = np.minimum(out[a], out[b])
        np.minimum.at(out, a, low)
        np.minimum.at(out, b, low)
        out = out[out]
        if (out == before).all():
            return out


def _linked(listed: DataFrame, kind: str, cosine: float) -> DataFrame:
    """(node, root, links): for each block and vector that a link reaches there, a vector of its component and the number of vectors
    linked with it."""
    sizes = listed.groupBy("pivot").agg(F.count("*").alias("n")).select("pivot", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = (
        listed.join(sizes, "pivot").withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .withColumn("x", F.least("mine", "other")).withColumn("y", F.greatest("mine", "other")).drop("other", "blocks"))

    def block(group: pd.DataFrame) -> pd.DataFrame:
        x, y, pivot = int(group["x"].iloc[0]), int(group["y"].iloc[0]), int(group["pivot"].iloc[0])
        units = _units(list(group["v"]), kind)
        near = np.frombuffer(b"".join(group["nearest"]), "<i4").reshape(len(group), -1)
        side, copies = group["mine"].to_numpy() == x, group["copies"].to_numpy()
        rows, columns = np.flatnonzero(side), np.flatnonzero(~side) if x != y else np.flatnonzero(side)
        links, pairs = np.zeros(len(group), np.int64), []
        for begin in range(0, len(rows), 256):
            part = rows[begin : begin + 256]
            i, j = np.nonzero(units[part] @ units[columns].T >= cosine)
            a, b = part[i], columns[j]
            if x == y:
                a, b = a[part[i] < columns[j]], b[part[i] < columns[j]]
            for at in range(0, len(a), 65536):
                p, q = a[at : at + 65536], b[at : at + 65536]
                common = (near[p][:, :, None] == near[q][:, None, :]).any(2)
                least = np.where(common, near[p], np.iinfo(np.int32).max).min(1)
                ok = (common.sum(1) >= min(SHARED, near.shape[1])) & (least == pivot)
                p, q = p[ok], q[ok]
                np.add.at(links, p, copies[q])
                np.add.at(links, q, copies[p])
                pairs.append((p, q))
        a, b = (np.concatenate(s) for s in zip(*pairs, strict=True)) if pairs else (np.empty(0, int),) * 2
        at = np.flatnonzero(links)
        nodes = group["node"].to_numpy()
        return pd.DataFrame({"node": nodes[at], "root": nodes[roots(len(group), a, b)[at]], "links": links[at]})

    return dealt.groupBy("pivot", "x", "y").applyInPandas(block, "node long, root long, links long")


def near_vectors(df: DataFrame, id_: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors that are null, empty, zero or hold a null or a non-finite component are linked with nothing, as are vectors of
    different length with each other. Copies are links of each other. Rows that repeat an id are a vector each. A row
    without an id takes no part: its component is null and it is kept. An empty table gives none."""
    kind = "<f4" if df.schema[vector].dataType.elementType.typeName() == "float" else "<f8"
    vectors = staged(_vectors(df, id_, vector), "vectors")
    classes = staged(
        vectors.groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id()), "classes")
    found = staged(_linked(_listed(classes, _pivots(classes, kind), kind), kind, cosine), "found")
    parts = components(found, "node", "root")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = (
        classes.join(links, "node", "left").join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")))
    smallest = named.groupBy("part").agg(F.min("least").alias("component_id"))
    by_vector = named.join(smallest, "part").select(
        "v", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    good = vectors.join(by_vector, "v").select("vec_id", "n_links", "component_id")
    usable = vectors.groupBy("vec_id").agg(F.count("*").alias("good"))
    every = df.select(F.col(id_).cast("long").alias("vec_id"))
    rest = every.groupBy("vec_id").agg(F.count("*").alias("all")).join(usable, "vec_id", "left").where(F.col("all") > F.coalesce("good", F.lit(0)))
    alone = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                        F.explode(F.sequence(F.lit(1).cast("long"), F.col("all") - F.coalesce("good", F.lit(0)))).alias("copy")).drop("copy")
    return good.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op2_pivot_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
