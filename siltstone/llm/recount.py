"""Operator 10: token counts that follow edits.

A document keeps a segment tree over its pre-tokens: leaves hold how many code points, pre-tokens and tokens a stretch of text has,
inner nodes hold sums. An edit re-encodes from a few pre-tokens before it up to the first leaf boundary after it that the new
pre-tokens meet again; from there on nothing can differ, as pre-tokens are cut from left to right and never look back. Only
the sums above the leaves touched are renewed.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import fresh, staged, table

#: Pre-tokens in a leaf of a new tree, in the largest leaf before a tree is built anew, and those before an edit that it can bear on.
LEAF, LARGEST, CONTEXT = 64, 512, 4
VOCABULARY = "byte_bpe_50k.tiktoken"
_KEPT_PIECES = 300_000

#: What the query edits out: mail addresses, long digit runs and hexadecimal secrets.
PRIVATE = r"[\w.+-]+@[\w-]+\.[\w.-]+|\b[0-9a-f]{32,}\b|\b\d[\d -]{8,}\d\b"
MASK = "<private>"


class Counter:
    """Pre-tokens of a text and how many tokens each has. Counts are kept until there are too many, then anew."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self._known: dict[str, int] = {}

    def tokens(self, pieces: list[str]) -> np.ndarray:
        known = self._known
        new = {p for p in pieces if p not in known}
        if new:
            if len(known) + len(new) > _KEPT_PIECES:
                known.clear()
                new = set(pieces)
            for p in new:
                known[p] = len(self._encoding.encode_ordinary(p))
        return np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))


@dataclass
class Tree:
    """A heap of sums over ``width`` leaves, a power of two: row 1 is the whole, row i the sum of 2i and 2i + 1, columns are code
    points, pre-tokens and tokens."""

    sums: np.ndarray

    @property
    def width(self) -> int:
        return len(self.sums) // 2

    @property
    def total(self) -> int:
        return int(self.sums[1, 2])

    @classmethod
    def of(cls, leaves: np.ndarray) -> Tree:
        width = 1 << max(0, (len(leaves) - 1).bit_length())
        sums = np.zeros((2 * width, 3), np.int64)
        sums[width : width + len(leaves)] = leaves
        at = width
        while at > 1:
            sums[at // 2 : at] = sums[at : 2 * at].reshape(-1, 2, 3).sum(1)
            at //= 2
        return cls(sums)

    @classmethod
    def grown(cls, text: str, counter: Counter) -> Tree:
        return cls.of(_leaves(counter.pattern.findall(text), counter))

    def find(self, place: int, column: int) -> tuple[int, int]:
        """Leaf that holds unit ``place`` (from 0) of a column, and how many units lie before the leaf."""
        node, before = 1, 0
        while node < self.width:
            node *= 2
            if place - before >= self.sums[node, column]:
                before += int(self.sums[node, column])
                node += 1
        return node - self.width, before

    def before(self, leaf: int) -> np.ndarray:
        """Sums of all leaves before one."""
        node, out = leaf + self.width, np.zeros(3, np.int64)
        while node > 1:
            if node & 1:
                out += self.sums[node - 1]
            node >>= 1
        return out

    def put(self, first: int, leaves: np.ndarray) -> None:
        """New leaves from ``first`` on, and the sums above them."""
        low, high = self.width + first, self.width + first + len(leaves) - 1
        self.sums[low : high + 1] = leaves
        while low > 1:
            low, high = low >> 1, high >> 1
            self.sums[low : high + 1] = self.sums[2 * low : 2 * high + 2].reshape(-1, 2, 3).sum(1)


def _leaves(pieces: list[str], counter: Counter, n: int | None = None) -> np.ndarray:
    """Rows for pre-tokens dealt evenly to ``n`` leaves, or by ``LEAF``."""
    n = n or max(1, -(-len(pieces) // LEAF))
    units = np.column_stack([np.fromiter(map(len, pieces), np.int64, len(pieces)), np.ones(len(pieces), np.int64), counter.tokens(pieces)])
    edges = np.linspace(0, len(pieces), n + 1).round().astype(int)
    sums = np.vstack([np.zeros((1, 3), np.int64), units.cumsum(0)]) if len(pieces) else np.zeros((1, 3), np.int64)
    return sums[edges[1:]] - sums[edges[:-1]]


def edited(text: str, tree: Tree, edits: list[tuple[int, int, str]], counter: Counter) -> tuple[str, Tree, int]:
    """The text after replacing code points [start, stop) by a string, the tree of it, and how many pre-tokens were encoded anew.

    Edits name places in the text as it is handed over and are made from the last to the first. One that is out of the text,
    or reaches into one that starts before it, is left out; of equal ones one is made."""
    good, end = [], 0
    for start, stop, new in sorted(set(edits)):
        if end <= start <= stop <= len(text):
            good.append((start, stop, new))
            end = max(stop, start + (start == stop))
    encoded = 0
    for start, stop, new in reversed(good):
        after = text[:start] + new + text[stop:]
        leaf, _ = tree.find(min(start, max(len(text) - 1, 0)), 0)
        ahead = int(tree.before(leaf)[1])
        first = tree.find(max(ahead - CONTEXT, 0), 1)[0] if ahead > 0 else 0
        last = tree.find(stop, 0)[0] if stop < len(text) else tree.width - 1
        at = int(tree.before(first)[0])
        shift, pieces = len(after) - len(text), []
        boundary = int(tree.before(last)[0] + tree.sums[tree.width + last, 0]) + shift
        place, found = at, counter.pattern.finditer(after, at)
        while place < len(after):
            while last < tree.width - 1 and (boundary < place or boundary - shift <= stop):
                last += 1
                boundary += int(tree.sums[tree.width + last, 0])
            if place == boundary and boundary - shift > stop:
                break
            piece = next(found).group()
            pieces.append(piece)
            place += len(piece)
        else:
            last = tree.width - 1
        leaves = _leaves(pieces, counter, last - first + 1)
        tree.put(first, leaves)
        text, encoded = after, encoded + len(pieces)
        if len(leaves) and leaves[:, 1].max() > LARGEST:
            tree = Tree.grown(text, counter)
            encoded += int(tree.sums[1, 1])
    return text, tree, encoded


_COUNTERS: dict[tuple[str, str], Counter] = {}


def _counter(path: str, pattern: str) -> Counter:
    if (path, pattern) not in _COUNTERS:
        _COUNTERS[path, pattern] = Counter(path, pattern)
    return _COUNTERS[path, pattern]


def _mapped(df: DataFrame, added: list[tuple[str, T.DataType]], make: Callable[[dict[str, list], int], tuple]) -> DataFrame:
    """``df`` with columns that ``make`` gives for each row, from lists of the columns of a few rows. A column of the same
    name is replaced."""
    names = df.columns
    new = dict(added)
    fields = [f for f in df.schema.fields if f.name not in new] + [T.StructField(n, t) for n, t in added]
    schema = T.StructType(fields)
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(t) for _, t in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                lists = {n: part.column(i).to_pylist() for i, n in enumerate(names)}
                columns = list(zip(*(make(lists, i) for i in range(part.num_rows)), strict=True)) or [()] * len(added)
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i, n in enumerate(names) if n not in new] + [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                    names=[f.name for f in fields])

    return df.mapInArrow(run, schema)


def counted(docs: DataFrame, path: str, pattern: str, text: str = "text", tree: str = "token_tree") -> DataFrame:
    """``docs`` with the tree of each text (a null text has that of an empty one); its total is the number of tokens. A column that
    already has the name of the tree is replaced. Repeated rows get equal trees."""

    def make(row: dict[str, list], i: int) -> tuple:
        return (Tree.grown(row[text][i] or "", _counter(path, pattern)).sums.astype("<i8").tobytes(),)

    return _mapped(docs, [(tree, T.BinaryType())], make)


def recounted(
    docs: DataFrame, path: str, pattern: str, edits: str = "edits", text: str = "text", tree: str = "token_tree",
) -> DataFrame:
    """``docs`` with ``edits`` (arrays of start, stop and new text; null for none) made: text and tree renewed, and three new columns
    in place of any of these names: ``tokens_before``, ``tokens_after`` and ``pieces_encoded``. A null text without edits stays null."""

    def make(row: dict[str, list], i: int) -> tuple:
        old, wanted = row[text][i], row[edits][i]
        was = Tree(np.frombuffer(row[tree][i], "<i8").reshape(-1, 3).copy())
        before = was.total
        if not wanted:
            return old, row[tree][i], before, before, 0
        done = [(e["start"], e["stop"], e["new"] or "") for e in wanted if e and e["start"] is not None and e["stop"] is not None]
        new, grown, encoded = edited(old or "", was, done, _counter(path, pattern))
        return new, grown.sums.astype("<i8").tobytes(), before, grown.total, encoded

    added = [(text, T.StringType()), (tree, T.BinaryType()), ("tokens_before", T.LongType()), ("tokens_after", T.LongType()), ("pieces_encoded", T.LongType())]
    return _mapped(docs, added, make)


EDIT = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("new", T.StringType())]))


def masking(docs: DataFrame, private: str = PRIVATE, mask: str = MASK, text: str = "text", edits: str = "edits") -> DataFrame:
    """``docs`` with the edits that put ``mask`` over what matches ``private``."""
    found = regex.compile(private)

    def make(row: dict[str, list], i: int) -> tuple:
        return ([{"start": m.start(), "stop": m.end(), "new": mask} for m in found.finditer(row[text][i] or "")] or None,)

    return _mapped(docs, [(edits, EDIT)], make)


def with_edits(docs: DataFrame, edits: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` with a column ``edits`` gathered from rows of key, start, stop and new, equal rows once. Edits of a document do not
    overlap, so a document never gathers more than it has code points that count."""
    name = fresh("edits_of", docs.columns)
    lists = (
        edits.select(F.col(key).alias(name), F.struct(F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "new").alias("e")).distinct()
        .groupBy(name).agg(F.collect_list("e").alias("edits")))
    return docs.drop("edits").join(lists, docs[key] == F.col(name), "left").drop(name)


def op10_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document counted, then masked where it is private and counted again by its tree. The trees are a table, written with the texts
    they belong to, and the edits are made on what is read back."""
    import public_tokenizers

    path, pattern = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    done = recounted(masking(staged(counted(docs, path, pattern), "token-trees")), path, pattern)
    return done.select(
        "doc_id", "tokens_before", F.coalesce(F.size("edits"), F.lit(0)).cast("long").alias("n_edits"), "tokens_after", "pieces_encoded",
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
