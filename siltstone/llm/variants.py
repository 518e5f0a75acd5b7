"""Operator 11: spelling variants, words one edit apart, grouped under the form that is written most.

For the words of a block there is a bitset per (position, letter): which words have the letter there. A word is looked up by running over
its letters once, with sets of the words that agree so far without an error, with one letter replaced, and with one letter more than the
word; the last is read one position further on. 64 words are served by each operation.

Blocks come from halves: of two words one edit apart, the longer first half or the longer last half, counted on the shorter word, is equal
in both. So each word enters the blocks of its halves, once as the shorter and once as the longer of a pair. A block with more words than
fit is cut into pieces, and each piece is looked up in every piece.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import staged, table, texts

#: Code points and occurrences that make a run a word; how many times as often the form of a word is written.
LENGTH, TIMES, MORE = 7, 2, 10
#: Words of one piece of a block.
BLOCK = 4096
#: Rows whose blocks are indexed together, and distinct runs a task counts before it hands them on.
_ROWS, _COUNTED = 8192, 200_000

_FOLD = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def edited_run(doc_id: int | None, run: str, every: int = 31) -> str:
    """The folded run, short of one code point if the hash of id and run says so. A null id is an empty one."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def counted(docs: DataFrame, least: int = LENGTH, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(word, n): words of at least ``least`` code points and how often they occur. A null or empty text has none; repeated rows count each.
    Counts are combined in each task first, so a word in a third of all rows costs no task more than another."""
    run_of = re.compile(rf"(?<![A-Za-zÀ-ÿ])[A-Za-zÀ-ÿ]{{{least},}}")  # a shorter run gives no word

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handed(words: dict[str, int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])

        total: dict[str, int] = {}
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, value in texts(batch, text):
                own: dict[str, int] = {}
                for found in run_of.findall(value.translate(_FOLD)):
                    own[found] = own.get(found, 0) + 1
                for found, n in own.items():
                    word = edited_run(ids[i], found)
                    if len(word) >= least:
                        total[word] = total.get(word, 0) + n
                if len(total) > _COUNTED:
                    yield handed(total)
                    total = {}
        yield handed(total)

    pairs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias(text)).mapInArrow(run, "word string, n long")
    return pairs.groupBy("word").agg(F.sum("n").alias("n"))


def _entries(words: DataFrame, least: int) -> DataFrame:
    """(word, n, least, side, key): the blocks of each word. ``least`` is the length of the shorter word of the block's pairs."""
    length = F.length("word")
    sized = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("least")).where(F.col("least") >= least)
    half = F.ceil((F.col("least") - 1) / 2).cast("int")
    halves = F.array(
        F.struct(F.lit(0).alias("side"), F.xxhash64(F.substring("word", F.lit(1), half), "least").alias("key")),
        F.struct(F.lit(1).alias("side"), F.xxhash64(F.lit(1), F.right("word", half), "least").alias("key")))
    return sized.select("word", "n", "least", F.inline(halves))


def _pieces(entries: DataFrame, block: int) -> DataFrame:
    """Entries dealt to cells: (cell, asks, told). In a block of k pieces cell (i, j) looks the words of piece i up among those of piece j; a
    block that fits has one cell. The sizes of blocks are counted before the shuffle, and only those too large come back to the entries."""
    large = (
        entries.groupBy("side", "key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > block)
        .select(F.col("side").alias("_side"), F.col("key").alias("_key"), F.ceil(F.col("size") / block).cast("int").alias("_k")))
    dealt = entries.join(large, (F.col("side") == F.col("_side")) & (F.col("key") == F.col("_key")), "left")
    piece, last = F.pmod(F.xxhash64(F.lit(2), "word"), F.col("_k")).cast("int"), F.col("_k") - 1
    cell = lambda i, j, asks, told: F.struct((i * F.col("_k") + j).alias("cell"), F.lit(asks).alias("asks"), F.lit(told).alias("told"))
    others = F.filter(F.sequence(F.lit(0), last), lambda j: j != piece)
    many = F.concat(
        F.array(cell(piece, piece, True, True)), F.transform(others, lambda j: cell(piece, j, True, False)),
        F.transform(others, lambda j: cell(j, piece, False, True)))
    one = F.array(F.struct(F.lit(0).alias("cell"), F.lit(True).alias("asks"), F.lit(True).alias("told")))
    return dealt.select("word", "n", "least", "side", "key", F.inline(F.when(F.col("_k").isNull(), one).otherwise(many)))


def looked_up(
    words: list[str], least: int, side: int, first: np.ndarray, stop: np.ndarray, asks: np.ndarray, told: np.ndarray,
) -> tuple[np.ndarray, np.ndarray]:
    """Places (asking, found) of words one edit apart, of words of ``least`` or one more code points whose blocks lie one behind the other:
    that of word i is ``first[i]`` to ``stop[i]``. Words of ``least`` code points ask, those marked ``told`` are found: of the same length by
    a letter replaced, longer ones by a letter put in. On side 1, pairs that share the first half as well are left to side 0."""
    n, lengths = len(words), np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    letters, code = np.unique(flat, return_inverse=True)
    grid = np.full((n, least + 1), len(letters), np.int64)  # beyond a word's end: a letter that none has
    row = np.repeat(np.arange(n), lengths)
    grid[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = code
    width = -(-n // 64)

    def packed(rows: np.ndarray) -> np.ndarray:
        bits = np.zeros((*rows.shape[:-1], width * 64), bool)
        bits[..., :n] = rows
        return np.packbits(bits, axis=-1, bitorder="little").view("<u8")

    def having(position: int) -> np.ndarray:
        """By letter, the bitset of words that have it at the position."""
        rows = np.zeros((len(letters) + 1, n), bool)
        rows[grid[:, position], np.arange(n)] = True
        rows[len(letters)] = False
        return packed(rows)

    asking = np.flatnonzero(asks & (lengths == least))
    word0, word1 = first[asking] >> 6, (stop[asking] - 1) >> 6
    spread = word1 - word0 + 1
    item = np.repeat(np.arange(len(asking)), spread)  # one per asking word and 64 words of its block
    if not len(item):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(len(item)) - np.repeat(np.cumsum(spread) - spread, spread) + word0[item]
    low, high = np.maximum(first[asking][item] - at * 64, 0), np.minimum(stop[asking][item] - at * 64, 64)
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    block = (ones << low.astype(np.uint64)) & (ones >> (64 - high).astype(np.uint64))
    same, swapped, more = block, np.zeros_like(block), block.copy()
    query, half, shared = grid[asking], -(-(least - 1) // 2), None
    here = having(0)
    for i in range(least):
        letter, following = query[item, i], having(i + 1)
        fits = here[letter, at]
        swapped = (swapped & fits) | (same & ~fits)
        same = same & fits
        more = (more & following[letter, at]) | same
        if i + 1 == half:
            shared = same
        here = following
    open_to = packed(np.stack([told & (lengths == least), told & (lengths == least + 1)]))
    found = (swapped & open_to[0, at]) | (more & open_to[1, at])
    found &= ~shared if side == 1 else shared
    hit = np.flatnonzero(found)
    bits = np.unpackbits(found[hit].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    which, bit = np.nonzero(bits)
    return asking[item[hit[which]]], at[hit[which]] * 64 + bit


def _near_rows(part: pa.Table) -> pa.RecordBatch:
    """Pairs (word, near, near_n), both ways where lengths differ, of whole cells that lie in order."""
    least, side = part.column("least").to_numpy(), part.column("side").to_numpy()
    cells = np.column_stack([least, side, part.column("key").to_numpy(), part.column("cell").to_numpy()])
    opens = np.concatenate([[0], np.flatnonzero((cells[1:] != cells[:-1]).any(1)) + 1, [len(cells)]])
    size = np.diff(opens)
    group = np.repeat(np.arange(len(size)), size)
    asks, told = part.column("asks").to_numpy(), part.column("told").to_numpy()
    words, n = np.array(part.column("word").to_pylist(), object), part.column("n").to_numpy()
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for kind in np.unique(cells[:, :2], axis=0):
        own = np.flatnonzero((least == kind[0]) & (side == kind[1]) & (size[group] > 1))
        if not len(own):
            continue
        first = np.searchsorted(own, opens[:-1])[group[own]]
        stop = np.searchsorted(own, opens[1:])[group[own]]
        a, b = looked_up(words[own].tolist(), int(kind[0]), int(kind[1]), first, stop, asks[own], told[own])
        a, b = own[a], own[b]
        longer = np.fromiter((len(words[i]) for i in b), np.int64, len(b)) > kind[0]
        left += [a, b[longer]]
        right += [b, a[longer]]
    left, right = np.concatenate(left), np.concatenate(right)
    return pa.RecordBatch.from_arrays(
        [pa.array(words[left], pa.string()), pa.array(words[right], pa.string()), pa.array(n[right], pa.int64())], names=["word", "near", "near_n"])


def near_pairs(words: DataFrame, least: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """(word, near, near_n): every two words of (word, n), of at least ``least`` code points, that differ by exactly one code point inserted,
    deleted or replaced; each pair both ways, once. Words are distinct."""
    cells = _pieces(_entries(words, least), block)
    order = ["least", "side", "key", "cell"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < _ROWS:
                continue
            whole = pa.Table.from_batches(held).combine_chunks()
            marks = [whole.column(c).to_numpy() for c in order]
            last = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0))
            if len(last):  # the last cell may go on in the next batch
                end = int(last[-1]) + 1
                for begin, stop in _cuts(marks, end):
                    yield _near_rows(whole.slice(begin, stop - begin))
                held = whole.slice(end).to_batches()
                rows = whole.num_rows - end
        if rows:
            whole = pa.Table.from_batches(held).combine_chunks()
            for begin, stop in _cuts([whole.column(c).to_numpy() for c in order], whole.num_rows):
                yield _near_rows(whole.slice(begin, stop - begin))

    return (
        cells.repartition("side", "key", "cell").sortWithinPartitions(*order)
        .mapInArrow(run, "word string, near string, near_n long"))


def _cuts(marks: list[np.ndarray], end: int) -> Iterator[tuple[int, int]]:
    """Stretches of whole cells of about ``_ROWS`` rows."""
    edges = np.concatenate([[0], np.flatnonzero(np.any([m[1:end] != m[: end - 1] for m in marks], axis=0)) + 1, [end]])
    begin = 0
    while begin < end:
        stop = int(edges[max(np.searchsorted(edges, begin + _ROWS, "right") - 1, np.searchsorted(edges, begin, "right"))])
        yield begin, stop
        begin = stop


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last form reached from each word. A form is written at least ``MORE`` times as often as its word, so
    chains are short and have no circles; every round looks twice as far."""
    now = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        step = now.join(ahead, F.col("root") == F.col("_word"), "left")
        further = staged(step.select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("_moved")), "roots")
        moved = further.where("_moved").limit(1).count()
        now = further.drop("_moved")
        if not moved:
            return now


def variants(words: DataFrame, least: int = LENGTH, more: int = MORE, block: int = BLOCK) -> DataFrame:
    """Every word of (word, n) with ``n_near`` (words one edit apart), ``form`` (of these the one with the largest n, then the first in
    code-point order, if it is written at least ``more`` times as often), ``form_n`` and ``root``. No words give no rows."""
    # The smallest struct is the largest n, then the smallest word: strings compare by their bytes, as code points do.
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("_best")
    near = near_pairs(words, least, block).groupBy(F.col("word").alias("_of")).agg(F.count(F.lit(1)).alias("_n_near"), best)
    joined = words.join(near, F.col("word") == F.col("_of"), "left")
    often = -F.col("_best.less") >= F.lit(more) * F.col("n")
    found = staged(joined.select(
        "word", F.when(often, F.col("_best.near")).alias("form"), "n", F.coalesce("_n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(often, -F.col("_best.less")).alias("form_n")), "forms")
    roots = rooted(found.where("form IS NOT NULL")).select(F.col("word").alias("_of"), "root")
    return found.join(roots, F.col("word") == F.col("_of"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_sliced_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    words = counted(table(spark, sf_dir, "documents")).where(F.col("n") >= TIMES)
    return variants(staged(words, "words"))
