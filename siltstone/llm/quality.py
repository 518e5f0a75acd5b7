"""Operator 4: quality rules by distribution divergence.

A document's histogram of character classes and of common words is held against references learned from the labelled
documents of each language. A document is turned away if it is far, by Jensen-Shannon distance, from every
language; short documents are not judged by histograms too coarse to say anything.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import BLANKS, staged, table, texts

#: Contract values of the base rules.
SYMBOLS, MIN_WORDS, MAX_REPEATED_PERCENT = "#*$%&|<>", 50, 50
#: Parameters of the method: common words per language, guards, and the largest distances that pass.
COMMON_WORDS, MIN_CHARS_JUDGED, MIN_WORDS_JUDGED, MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 64, 200, 50, 0.25, 0.48
#: Distinct words a task counts before it passes them on.
_HELD_WORDS = 300_000

CLASSES = ("lower", "upper", "other letter", "digit", "blank", "mark", "symbol", "other")


@lru_cache(maxsize=1)
def class_of_code() -> np.ndarray:
    """Number in CLASSES of every code point."""
    out = np.full(0x110000, CLASSES.index("other"), np.uint8)
    names = {"Ll": "lower", "Lu": "upper", "L": "other letter", "M": "other letter", "N": "digit", "Z": "blank", "P": "mark", "S": "symbol"}
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))
        name = names.get(kind) or names.get(kind[0])
        if name:
            out[code] = CLASSES.index(name)
    out[[ord(c) for c in BLANKS]] = CLASSES.index("blank")
    out[[ord(c) for c in SYMBOLS]] = CLASSES.index("symbol")
    return out


@dataclass(frozen=True)
class References:
    """Per language: share of each class, its common words, and the share of each and of all other words."""

    languages: list[str]
    classes: np.ndarray
    words: list[list[bytes]]
    shares: list[np.ndarray]


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance, 0 to 1, of two histograms that each add up to 1."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(parts / 2, 0)))


def _classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return np.bincount(class_of_code()[codes], minlength=len(CLASSES))


def _counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n): words of labelled documents; classes come as words that hold a blank, which no word does."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[tuple[str, bytes]] = Counter()

        def out() -> pa.RecordBatch:
            keys = list(held)
            rows = pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1].decode() for k in keys], pa.string()),
                 pa.array(list(held.values()), pa.int64())], names=["lang", "word", "n"])
            held.clear()
            return rows

        for batch in batches:
            langs = batch.column(1).to_pylist()
            for i, text in texts(batch):
                for word, n in Counter(text.encode().split()).items():
                    held[langs[i], word] += n
                for name, n in zip(CLASSES, _classes(text).tolist(), strict=True):
                    held[langs[i], b" " + name.encode()] += n
                if len(held) > _HELD_WORDS:
                    yield out()
        yield out()

    labelled = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    return labelled.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def references(docs: DataFrame, common: int = COMMON_WORDS) -> References:
    """Learned from every labelled document; what comes back is ``common`` words and the classes of each language."""
    counts = staged(_counts(docs), "word-counts")
    classes = counts.where("word LIKE ' %'")
    words = counts.where("word NOT LIKE ' %'")
    totals = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top: dict[str, list] = {}
    for r in words.withColumn("rank", rank).where(F.col("rank") <= common).orderBy("lang", "rank").collect():
        top.setdefault(r["lang"], []).append((r["word"].encode(), r["n"]))
    by_class = {(r["lang"], r["word"][1:]): r["n"] for r in classes.collect()}
    languages = sorted(top)
    shares = []
    for lang in languages:
        n = np.array([x[1] for x in top[lang]], float)
        shares.append(np.append(n, totals[lang] - n.sum()) / totals[lang])
    matrix = np.array([[by_class.get((lang, c), 0) for c in CLASSES] for lang in languages], float).reshape(-1, len(CLASSES))
    return References(languages, matrix / matrix.sum(1, keepdims=True), [[w for w, _ in top[lang]] for lang in languages], shares)


def repeated_words(number: np.ndarray, distinct: int) -> int:
    """Words covered by three-word windows found twice or more; ``number`` stands for the words."""
    if len(number) < 3:
        return 0
    pair = number[:-1] * distinct + number[1:]
    if distinct >= 1 << 20:  # three numbers would not fit 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair[:-1] * distinct + number[2:]
    in_order = np.sort(key)
    twice = in_order[1:][in_order[1:] == in_order[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(key, twice)
    covered = np.zeros(len(number), bool)
    for shift in range(3):
        covered[shift : shift + len(hit)] |= hit
    return int(covered.sum())


def measure(text: str, refs: References) -> dict:
    """All measures and the verdict of one whole text."""
    numbers: dict[bytes, int] = {}
    number = np.array([numbers.setdefault(w, len(numbers)) for w in text.encode().split()], np.int64)
    n_words = len(number)
    lines, duplicates = set(), 0
    for line in text.split("\n"):
        if line in lines:
            duplicates += 1
        elif line.strip(BLANKS):
            lines.add(line)
    n_repeat = repeated_words(number, max(len(numbers), 1))
    failed = n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEATED_PERCENT * n_words
    nearest, by_class, by_word = None, None, None
    if len(text) >= MIN_CHARS_JUDGED and refs.languages:
        shares = _classes(text) / len(text)
        far = [distance(shares, q) for q in refs.classes]
        by_class = min(far)
        nearest = refs.languages[int(np.argmin(far))]
        if n_words >= MIN_WORDS_JUDGED:
            held = np.bincount(number, minlength=len(numbers))
            far = []
            for words, q in zip(refs.words, refs.shares, strict=True):
                n = np.array([held[numbers[w]] if w in numbers else 0 for w in words], float)
                far.append(distance(np.append(n, n_words - n.sum()) / n_words, q))
            by_word = min(far)
            nearest = refs.languages[int(np.argmin(far))]
    strange = (by_class or 0) > MAX_CLASS_DISTANCE or (by_word or 0) > MAX_WORD_DISTANCE
    return {
        "n_words": n_words, "word_chars": len(text) - sum(map(text.count, BLANKS)), "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": duplicates, "n_repeat_words": n_repeat, "base_failed": failed, "kept": not failed and not strange,
        "class_distance": by_class, "word_distance": by_word, "nearest": nearest}


_SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "class_distance double, word_distance double, nearest string")
_TYPES = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2 + [pa.string()]


def scored(docs: DataFrame, refs: References | None = None) -> DataFrame:
    """(doc_id, measures, verdict) of every row. A null text counts as an empty one and fails the base rules; repeated rows are
    judged alike; where no document has a language, only the base rules count; an empty table gives none."""
    refs = refs or references(docs)
    names = [x.split()[0] for x in _SCHEMA.split(", ")]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(text, refs) for _, text in texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([r[n] for r in rows], t) for n, t in zip(names, _TYPES, strict=True))],
                names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judge, f"doc_id long, {_SCHEMA}")


def accepted(docs: DataFrame, refs: References | None = None) -> DataFrame:
    """The rows of ``docs`` that pass, columns as they are."""
    refs = refs or references(docs)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([measure(text, refs)["kept"] for _, text in texts(batch)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op4_histogram_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
