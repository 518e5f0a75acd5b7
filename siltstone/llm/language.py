"""Operator 6: language identification by nearest centroid.

A text is a vector of hashed byte n-grams, weighted by TF-IDF and normalised. Each language has several centroids, found by
clustering a bounded sample of its labelled texts; a text takes the language of the centroid nearest by cosine and is
marked as rejected where that centroid is farther than it was for the texts it was learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import crc_of_id, table, texts

#: Features, longest n-gram in bytes, texts per language that centroids are learned from, centroids per language, and the share of
#: those texts that may lie beyond the distance of rejection.
FEATURES, LONGEST, SAMPLE, CENTROIDS, BEYOND = 4096, 3, 400, 4, 0.005
#: ASCII letters and all bytes of other characters stay; the rest counts as a space.
_LETTERS = np.where(np.array([chr(i).isalpha() or i > 127 for i in range(256)]), np.arange(256), 32).astype(np.uint32)


def frequencies(text: str) -> np.ndarray:
    """How often each hashed n-gram occurs in the lower-cased words of a text."""
    raw = _LETTERS[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)]
    raw = raw[np.append(True, (raw[1:] != 32) | (raw[:-1] != 32))]
    out, key = np.zeros(FEATURES), np.zeros(len(raw), np.uint32)
    for n in range(1, LONGEST + 1):
        key = key[: len(raw) - n + 1] * np.uint32(257) + raw[n - 1 :] + np.uint32(1)
        out += np.bincount((key * np.uint32(2654435761)) >> np.uint32(20), minlength=FEATURES)
    return out


def vector(text: str, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(frequencies(text)) * idf
    return v / max(np.linalg.norm(v), 1e-12)


def is_text(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass(frozen=True)
class Centroids:
    idf: np.ndarray
    languages: list[str]
    matrix: np.ndarray
    limits: np.ndarray


def _document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each feature occurs, over all of them; the last entry counts the texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(FEATURES + 1, np.int64)
        for batch in batches:
            for _, text in texts(batch):
                held[:-1] += frequencies(text) > 0
                held[-1] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1, dtype=np.int32)), pa.array(held)], names=["f", "n"])

    out = np.zeros(FEATURES + 1, np.int64)
    for r in docs.select("text").mapInArrow(count, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).collect():
        out[r["f"]] = r["n"]
    return out[:-1], int(out[-1])


def clustered(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from far-apart starts; fewer centroids where points coincide."""
    centres = points[:1]
    while len(centres) < min(k, len(points)):
        near = (points @ centres.T).max(1)
        if near.min() > 1 - 1e-9:
            break
        centres = np.vstack([centres, points[near.argmin()]])
    for _ in range(rounds):
        of = (points @ centres.T).argmax(1)
        sums = np.array([points[of == i].sum(0) if (of == i).any() else centres[i] for i in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def learn(labelled: DataFrame, sample: int = SAMPLE) -> Centroids:
    """Centroids from rows with text and lang. Document frequencies cover all rows; centroids are learned from the ``sample`` texts
    of each language that come first by hash, copies once. What comes to the driver is the centroids."""
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    counts, n = _document_frequencies(rows)
    idf = np.log((1 + n) / (1 + counts)) + 1
    keyed = rows.withColumn("key", F.xxhash64("text", "lang"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    chosen = keyed.select("lang", "key").distinct().withColumn("rank", rank).where(F.col("rank") <= sample).select("key")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [(i, vector(text, idf)) for i, text in texts(batch) if is_text(text)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).take(pa.array([i for i, _ in keep], pa.int32())), batch.column(2).take(pa.array([i for i, _ in keep], pa.int32())),
                 pa.array([v.astype("<f4").tobytes() for _, v in keep], pa.binary())], names=["lang", "key", "v"])

    points = (
        keyed.join(chosen, "key", "left_semi").select("text", "lang", "key").mapInArrow(vectors, "lang string, key long, v binary")
        .dropDuplicates(["key"]))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("key")
        data = np.array([np.frombuffer(v, "<f4") for v in group["v"]], float)
        centres = clustered(data, CENTROIDS)
        limit = float(np.quantile((data @ centres.T).max(1), BEYOND))
        return pd.DataFrame({"lang": group["lang"].iloc[0], "v": [c.astype("<f4").tobytes() for c in centres], "limit": limit})

    found = points.groupBy("lang").applyInPandas(fit, "lang string, v binary, limit double").collect()
    found.sort(key=lambda r: (r["lang"], bytes(r["v"])))
    return Centroids(
        idf, [r["lang"] for r in found], np.array([np.frombuffer(r["v"], "<f4") for r in found], float).reshape(-1, FEATURES),
        np.array([r["limit"] for r in found]))


def predicted(docs: DataFrame, model: Centroids) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row. ``und`` with score 0 for a null text or one without a letter, and for all
    if nothing was learned; ties go to the first language by name; repeated rows get the same. ``score`` is the cosine."""

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, text in texts(batch):
                if not model.languages or not is_text(text):
                    out.append(("und", 0.0, True))
                    continue
                near = model.matrix @ vector(text, model.idf)
                i = int(near.argmax())
                out.append((model.languages[i], float(min(max(near[i], 0), 1)), bool(near[i] < model.limits[i])))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.bool_())],
                names=["doc_id", "lang_pred", "score", "rejected"])

    schema = "doc_id long, lang_pred string, score double, rejected boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(guess, schema)


def op6_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from documents whose id's CRC-32 modulo 3 is not 1; a null id has no such number and is held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_of_id() % 3 == 1, F.lit(True))
    model = learn(docs.where(~held_out))
    return predicted(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
