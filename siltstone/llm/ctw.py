"""Operator 8: language-model scores by context-tree weighting.

Bytes are coded bit by bit. A node of the tree is a context (up to ``DEPTH`` bytes) with the bits of the next byte read so far;
it holds how often a 0 and a 1 came next in the training texts. A Krichevsky-Trofimov estimate of each node is
mixed with what the contexts one byte longer say, in the proportion that the training texts bear out, from the longest
context to none. Texts are scored with that tree as it stands after training.

What a text needs is the value of each word (for the base) and of each run of ``DEPTH + 1`` bytes. Both are counted by shuffle, and
subtrees are built in tasks dealt by their whole context. While words and runs are few enough for every task, their values go to all;
beyond that texts go in blocks, each of which names its distinct words and runs and gets the values of these.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import crc_of_id, staged, table, texts

#: Bytes of context, bytes of text in a block, and bytes whose runs are sorted at a time.
DEPTH, BLOCK_BYTES, CHUNK_BYTES = 5, 10_000_000, 1_000_000
_END = b"\n"
_END_KEY = xxhash.xxh3_64_intdigest(_END)


def body(text: str) -> bytes:
    """The token sequence as bytes: lower-cased words between single blanks, and an end that no word contains."""
    return b" ".join(text.encode().lower().split()) + _END


def runs(bodies: list[bytes]) -> np.ndarray:
    """For every byte of every text, that byte and the ``DEPTH`` before it as a number, oldest byte first; ends stand before a text."""
    pad = _END * DEPTH
    raw = np.frombuffer(b"".join(pad + x for x in bodies), np.uint8)
    code = np.zeros(max(len(raw) - DEPTH, 0), np.int64)
    for k in range(DEPTH + 1):
        code = (code << 8) | raw[k : k + len(code)]
    own = np.ones(len(raw), bool)
    begins = np.cumsum([0, *(len(x) + DEPTH for x in bodies[:-1])])
    for k in range(DEPTH):
        own[begins + k] = False
    return code[own[DEPTH:]]


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers: Stirling's series eight further up."""
    y = x + 8
    series = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return series - np.log(np.prod([x + i for i in range(8)], axis=0))


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of so many zeros and ones in any order."""
    zeros, ones = np.asarray(zeros, float), np.asarray(ones, float)
    out = _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - math.log(math.pi) - _log_gamma(zeros + ones + 1)
    return np.where(zeros + ones > 0, out, 0.0)


def _weighted(own: np.ndarray, longer: np.ndarray) -> np.ndarray:
    return math.log(0.5) + np.logaddexp(own, longer)


def _share(own: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """Part of the mix that a node's own estimate gets."""
    return 1 / (1 + np.exp(np.clip(longer - own, -700, 700)))


_MID = (1 << (8 * (DEPTH - 1))) - 1


class _Subtrees:
    """Nodes of ``DEPTH`` and ``DEPTH - 1`` bytes of context that some runs pass, whole subtrees of the latter, laid out flat: only what a run
    passes has a place, however many contexts there are. A node is its context and the bits of the next byte read so far."""

    def __init__(self, run: np.ndarray, n: np.ndarray) -> None:
        run = run.astype(np.int64)
        key = (((run >> 8) & _MID) << 16) | ((run >> (8 * DEPTH)) << 8) | (run & 255)  # shorter context, oldest byte, next byte
        order = np.argsort(key, kind="stable")
        self.run, key, n = run[order], key[order], n[order].astype(float)
        next_byte, context = key & 255, key >> 16
        self._levels, names, parts = [], [], []
        for i in range(8):
            bit = (next_byte >> (7 - i)) & 1
            begins = np.flatnonzero(np.diff(key >> (8 - i), prepend=-1))
            of_row = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(key))))
            ones, both = np.add.reduceat(n * bit, begins), np.add.reduceat(n, begins)
            name = (context[begins] << 9) | ((next_byte[begins] | 256) >> (8 - i))
            shallow, of_node = np.unique(name, return_inverse=True)
            sums = [np.bincount(of_node, x, len(shallow)) for x in (both - ones, ones, log_kt(both - ones, ones))]
            names.append(shallow)
            parts.append(np.array(sums))
            self._levels.append((bit, of_row, ones, both, of_node, len(shallow)))
        self.names = np.concatenate(names)
        self.zeros, self.ones, longer = np.concatenate(parts, axis=1)
        own = log_kt(self.zeros, self.ones)
        self.weighted, self._share = _weighted(own, longer), _share(own, longer)

    def values(self, names: np.ndarray, factor: np.ndarray, zero: np.ndarray, one: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each run, in the order of ``run``, from what shorter contexts add for each of the nodes
        (``names``, rising): zero or one, and factor times what is known here."""
        at = np.searchsorted(names, self.names)
        value, first = np.zeros(len(self.run)), 0
        for bit, of_row, ones, both, of_node, n in self._levels:
            here = slice(first, first + n)
            share, shallow = self._share[here], (self.ones[here] + 0.5) / (self.zeros[here] + self.ones[here] + 1)
            p = (share * shallow)[of_node] + (1 - share)[of_node] * (ones + 0.5) / (both + 1)  # of a 1, at each deep node
            up = at[here][of_node]
            told = np.log10(np.array([zero[up] + factor[up] * (1 - p), one[up] + factor[up] * p]))
            value += told[bit, of_row]
            first += n
        return value


#: Runs whose subtrees are laid out together; one subtree has at most 65,536.
_RUNS = 200_000


def _whole(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Rows that come sorted by a column, some ``_RUNS`` at a time and never parting equal ones."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < _RUNS:
            continue
        table_ = pa.Table.from_batches(held)
        marks = table_.column(column).to_numpy()
        edges = np.flatnonzero(marks[1:] != marks[:-1])
        if len(edges):
            end = int(edges[-1]) + 1
            yield table_.slice(0, end)
            held, rows = table_.slice(end).to_batches(), len(marks) - end
    if rows:
        yield pa.Table.from_batches(held)


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _whole(batches, "mid"):
        trees = _Subtrees(part.column("run").to_numpy(), part.column("n").to_numpy())
        yield pa.RecordBatch.from_arrays(
            [pa.array(trees.names >> 9), pa.array((trees.names & 511).astype(np.int32)), pa.array(trees.zeros), pa.array(trees.ones), pa.array(trees.weighted)],
            names=["context", "node", "zeros", "ones", "weighted"])


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows of runs and, for the same contexts, of what shorter contexts add for each node."""
    for part in _whole(batches, "mid"):
        is_run = part.column("node").to_numpy() < 0
        column = lambda name, rows: part.column(name).to_numpy()[rows]  # noqa: E731, B023
        trees = _Subtrees(column("run", is_run), column("n", is_run))
        names = (column("mid", ~is_run) << 9) | column("node", ~is_run)
        order = np.argsort(names)
        value = trees.values(names[order], *(column(c, ~is_run)[order] for c in ("factor", "zero", "one")))
        yield pa.RecordBatch.from_arrays([pa.array(trees.run), pa.array(value)], names=["run", "value"])


def _level(lower: DataFrame) -> DataFrame:
    """Nodes of the contexts one byte shorter: (context, node, zeros, ones, weighted, factor, zero, one), the last three saying what
    their estimate makes of the probability p that longer contexts give a bit: zero or one + factor * p."""

    @F.pandas_udf("weighted double, factor double, zero double, one double")
    def mix(zeros: pd.Series, ones: pd.Series, longer: pd.Series) -> pd.DataFrame:
        a, b, s = (x.to_numpy(float) for x in (zeros, ones, longer))
        own = log_kt(a, b)
        share, one = _share(own, s), (b + 0.5) / (a + b + 1)
        return pd.DataFrame({"weighted": _weighted(own, s), "factor": 1 - share, "zero": share * (1 - one), "one": share * one})

    return (
        lower.withColumn("context", F.col("shorter")).groupBy("context", "node")
        .agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("longer"))
        .withColumn("mix", mix("zeros", "ones", "longer")).select("context", "node", "zeros", "ones", "mix.*"))


def run_values(counts: DataFrame) -> DataFrame:
    """(run, value) from (run, n), each run once: log10 probability of the run's last byte after the others. Runs with n = 0 get theirs too.

    Subtrees are dealt by the whole of their context, as many tasks as runs ask for, so no ending of a context is one task's."""
    spark = counts.sparkSession
    counts = counts.withColumn("mid", F.shiftright("run", 8).bitwiseAND(F.lit(_MID)))
    tasks = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), counts.count() // _RUNS + 1))
    dealt = counts.repartition(tasks, "mid").sortWithinPartitions("mid")
    roots = staged(dealt.select("mid", "run", "n").mapInArrow(_roots, "context long, node int, zeros double, ones double, weighted double"), "roots")
    levels, lower, of = [], roots, roots
    for depth in range(DEPTH - 2, -1, -1):
        level = staged(_level(lower.withColumn("shorter", F.col("context").bitwiseAND(F.lit((1 << (8 * depth)) - 1)))), "level")
        levels.append(level)
        lower = level
    above = of.select("context", "node", F.lit(1.0).alias("factor"), F.lit(0.0).alias("zero"), F.lit(0.0).alias("one"))
    for depth, level in zip(range(DEPTH - 2, -1, -1), levels, strict=True):
        here = level.select(F.col("context").alias("shorter"), F.col("node").alias("n"), F.col("factor").alias("f"), F.col("zero").alias("z"), F.col("one").alias("o"))
        above = above.join(
            here, (F.col("context").bitwiseAND(F.lit((1 << (8 * depth)) - 1)) == F.col("shorter")) & (F.col("node") == F.col("n"))
        ).select("context", "node", (F.col("factor") * F.col("f")).alias("factor"), (F.col("z") + F.col("f") * F.col("zero")).alias("zero"),
                 (F.col("o") + F.col("f") * F.col("one")).alias("one"))
    both = counts.select("mid", "run", "n", F.lit(-1).alias("node"), *[F.lit(0.0).alias(c) for c in ("factor", "zero", "one")]).unionByName(
        above.select(F.col("context").alias("mid"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("n"), "node", "factor", "zero", "one"))
    return both.repartition(tasks, "mid").sortWithinPartitions("mid").mapInArrow(_values, "run long, value double")


def _bodies(docs: DataFrame, held_out: Column) -> DataFrame:
    """(doc_id, held_out, block, body): blocks of ``BLOCK_BYTES`` in the order of the scan."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                blocks, made = [], []
                for _, text in texts(part, "text"):
                    made.append(body(text))
                    if held and held + len(made[-1]) > BLOCK_BYTES:
                        block, held = block + 1, 0
                    held += len(made[-1])
                    blocks.append(block)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(blocks, pa.int64()), pa.array(made, pa.binary())], names=["doc_id", "held_out", "block", "body"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text").mapInArrow(
        make, "doc_id long, held_out boolean, block long, body binary")


def _chunks(bodies: list[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for x in bodies:
        held.append(x)
        size += len(x)
        if size > CHUNK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _word_keys(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Distinct keys, rising; sorting them is several times as fast as the hashing of ``np.unique``."""
    keys = np.sort(keys)
    return keys[np.append(np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1])]


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sum of their numbers."""
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def _named(bodies: DataFrame) -> DataFrame:
    """(block, word, key, n, held): distinct words (by hash) and runs of each block as a task reads it, how often training texts there have
    them, and of words whether a held-out text there has them."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(block: int, train: list[bytes], held: list[bytes]) -> Iterator[pa.RecordBatch]:
            seen: Counter[bytes] = Counter()
            for x in train:
                seen.update(x.split())
            seen[_END] = len(train)
            asked = {w for x in held for w in x.split()} | ({_END} if held else set())
            seen.update(dict.fromkeys(asked - seen.keys(), 0))
            yield batch_of(
                block, True, _word_keys(list(seen)), np.fromiter(seen.values(), np.int64, len(seen)), np.fromiter((w in asked for w in seen), bool, len(seen)))
            parts = [np.unique(runs(c), return_counts=True) for c in _chunks(train)]
            keys, n = _added(parts + [(k, np.zeros(len(k))) for k in (_distinct(runs(c)) for c in _chunks(held))])
            yield batch_of(block, False, keys, n, np.zeros(len(keys), bool))

        def batch_of(block: int, word: bool, keys: np.ndarray, n: np.ndarray, asked: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys), block)), pa.array(np.full(len(keys), word)), pa.array(keys), pa.array(n), pa.array(asked)],
                names=["block", "word", "key", "n", "held"])

        now, train, held = None, [], []
        for batch in batches:
            for block, is_held, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if block != now:
                    if now is not None:
                        yield from out(now, train, held)
                    now, train, held = block, [], []
                (held if is_held else train).append(x)
        if now is not None:
            yield from out(now, train, held)

    return bodies.select("block", "held_out", "body").mapInArrow(name, "block long, word boolean, key long, n long, held boolean")


#: Words and runs whose values may be broadcast (16 bytes each, 64 MB); with more, each block of texts gets its own by a shuffle.
_SENT = 4_000_000
#: Words whose counts a scorer keeps by their bytes.
_KEPT = 200_000


class Scorer:
    """Sums over a text, from values by rising keys of words (their counts) and of runs. A word without a value is one that no training text
    has, or one that stands once, in a training text: its count is 1 in a training text and 0 in one held out."""

    def __init__(self, word_keys: np.ndarray, word_values: np.ndarray, run_keys: np.ndarray, run_values: np.ndarray) -> None:
        self._words, self._counts, self._runs, self._values = word_keys, word_values, run_keys, run_values
        self._known: dict[bytes, float] = {}

    def _count(self, words: list[bytes], held_out: bool) -> np.ndarray:
        known = self._known
        found = list(map(known.get, words))
        if None in found:
            new = list({w for w, c in zip(words, found, strict=True) if c is None})
            if len(known) + len(new) > _KEPT:
                known.clear()
                new = list(set(words))
            keys = _word_keys(new)
            at = np.searchsorted(self._words, keys)
            counts = np.full(len(new), -1.0)
            has = np.flatnonzero(at < len(self._words))
            has = has[self._words[at[has]] == keys[has]]
            counts[has] = self._counts[at[has]]
            known.update(zip(new, counts.tolist(), strict=True))
            found = list(map(known.__getitem__, words))
        c = np.array(found)
        c[c < 0] = 0.0 if held_out else 1.0
        return c

    def of(self, bodies: list[bytes], held_out: list[bool]) -> list[tuple[int, int, float, float, float]]:
        """Of each body: tokens, known tokens, log10(count + 0.1) summed, log10 probability and bits per byte. The runs of some bodies are looked
        up together, each once."""
        out = []
        first = 0
        for part in _chunks(bodies):
            runs_of = [np.unique(runs([x]), return_counts=True) for x in part]
            all_ = _distinct(np.concatenate([found for found, _ in runs_of]))
            values = self._values[np.searchsorted(self._runs, all_)]
            for x, held, (found, n) in zip(part, held_out[first : first + len(part)], runs_of, strict=True):
                c = self._count([*x.split(), _END], held)
                score = float((values[np.searchsorted(all_, found)] * n).sum())
                out.append((len(c), int((c > 0).sum()), float(np.log10(c + 0.1).sum()), score, -score * math.log2(10) / len(x)))
            first += len(part)
        return out


_SUMS = ("n_tokens", "n_known", "logs", "score", "bits_per_byte")
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double, bits_per_byte double"


def _arrays(keys: np.ndarray, values: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, ...]:
    out = []
    for of in (is_word, ~is_word):
        found, first = np.unique(keys[of], return_index=True)
        out += [found, values[of][first]]
    return tuple(out)


def _scored_block(texts_of: pd.DataFrame, keyed: pd.DataFrame) -> pd.DataFrame:
    scorer = Scorer(*_arrays(keyed["key"].to_numpy(), keyed["value"].to_numpy(), keyed["word"].to_numpy(bool)))
    sums = scorer.of(texts_of["body"].tolist(), texts_of["held_out"].astype(bool).tolist())
    return pd.DataFrame({"doc_id": texts_of["doc_id"], "held_out": texts_of["held_out"].astype(bool)} | dict(
        zip(_SUMS, zip(*sums, strict=True) if sums else [()] * len(_SUMS), strict=True)))


def _scored_by_all(docs: DataFrame, arrays: tuple[np.ndarray, ...]) -> DataFrame:
    """Sums of every text, where the values of all words and runs are few enough to go to every task."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*arrays)
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                yield summed(scorer, batch.slice(begin, 512))

    def summed(scorer: Scorer, batch: pa.RecordBatch) -> pa.RecordBatch:
        sums = scorer.of([body(text) for _, text in texts(batch, "text")], batch.column(1).to_pylist())
        columns = list(zip(*sums, strict=True)) if sums else [()] * len(_SUMS)
        types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=["doc_id", "held_out", *_SUMS])

    return docs.mapInArrow(score, _SCORES)


def _scored_by_block(bodies: DataFrame, values: DataFrame) -> DataFrame:
    """Sums of every text by blocks, each of which gets the values of its own words and runs."""
    bodies = staged(bodies, "bodies", "zstd")
    named = _named(bodies)
    keyed = named.join(values, (F.col("word") == F.col("of_word")) & (F.col("key") == F.col("of_key"))).select("block", "key", "value", "word")
    return bodies.groupBy("block").cogroup(keyed.groupBy("block")).applyInPandas(_scored_block, _SCORES)


def scored(docs: DataFrame, held_out: Column) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row; rows that are not
    ``held_out`` are learned from.

    ``score`` is the log10 probability of the token sequence, ``bits_per_byte`` its code length over the length of ``body``. A null
    or empty text is its end alone. Repeated rows are learned from and scored each. With nothing to learn from, every bit has the
    chance of one half, and the base falls back on its smoothing. An empty table gives none."""
    bodies = _bodies(docs, held_out)
    counts = staged(_named(bodies).groupBy("word", "key").agg(F.sum("n").alias("n"), F.bool_or("held").alias("held")), "counts", "zstd")
    told = F.col("word") & ((F.col("n") > 1) | ((F.col("n") == 1) & F.col("held")))  # the rest of the words need no value (see Scorer)
    once = counts.agg(
        F.sum(F.when(F.col("word"), F.col("n"))).alias("n"), F.count(F.when(F.col("word") & (F.col("n") > 0), 1)).alias("v"),
        F.count(F.when(~F.col("word") | told, 1)).alias("keys")).first()
    n, v = once["n"] or 0, once["v"]
    values = run_values(counts.where("NOT word").select(F.col("key").alias("run"), "n")).select(
        F.lit(False).alias("of_word"), F.col("run").alias("of_key"), "value")
    values = values.unionByName(counts.where(told).select(F.lit(True).alias("of_word"), F.col("key").alias("of_key"), F.col("n").cast("double").alias("value")))
    if once["keys"] <= _SENT:
        held = values.toArrow()
        arrays = _arrays(*(held.column(c).to_numpy() for c in ("of_key", "value", "of_word")))
        done = _scored_by_all(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text"), arrays)
    else:
        done = _scored_by_block(bodies, values)
    spread = math.log10(n + 0.1 * (v + 1))
    return done.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(spread)).alias("base_score"), "score", "bits_per_byte")


def op8_context_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose id's CRC-32 is 0 modulo 10 are held out, as are those without an id."""
    held_out = F.coalesce(crc_of_id() % 10 == 0, F.lit(True))
    return scored(table(spark, sf_dir, "documents"), held_out)
