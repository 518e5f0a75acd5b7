"""Operator 1: line dedup by a segment-partition edit join.

Near copies lie within a twentieth of the shorter line's length, and within two edits where that is less. Lines fall into classes of length.
In each a line is cut into one segment more than the edits allowed there, all of one width, and entered under them. Of two near copies a
segment outlives the edits whole, and in the longer one it begins no further from its place than it has segments before it. So a line looks
up, for each segment number, its substrings that begin that near, in its own class and in the one below if an edited line can come from there.

Substrings far outnumber segments, and hardly any of them is a segment of another line. So the segments are first noted in a filter, a
fixed number of bits for each, and only substrings that it may hold leave the scan; segments leave it if another line may have the same, or
if such a substring asks for them. A filter has a largest size, so lines are dealt by length to spans with a filter each: a line asks only in
the spans it can be edited from, its own and mostly no other, so work grows with the lines and not with the lines times the spans. What
meets is sifted by length and parities of character pairs and verified by a banded bit-parallel edit distance, many pairs at a time. Equal
lines are one class throughout. In each group of equal keys one line meets all others first; only what is still apart after that meets again,
in blocks bounded in rows, so a group of near copies is not spelled out in pairs.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import BLANKS, components, fresh, key_filter, passes, passing, staged, table, texts

#: Edits allowed between near copies at least, per cent of the shorter line's length allowed, and the fewest code points of a line that
#: edits are allowed in.
EDITS, PERCENT, LEAST_CHARS = 2, 5, 20
#: Longs of parities.
_WORDS = 4
#: Lines of a group of equal keys in one block, code points of lines passed on, cut and held at a time, and lines a task remembers.
_BLOCK, _CHUNK, _CUT, _HELD, _SEEN = 2048, 250_000, 65_536, 8_000_000, 200_000
#: Spark's setting for the bytes of texts that a task holds at once, in the JVM and again in Python, and what it is while lines are sought.
_BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)
_PARITIES = [f"parity{i}" for i in range(_WORDS)]


def edits(chars: int) -> int:
    """Edits allowed in a pair whose shorter line has so many code points."""
    return max(EDITS, chars * PERCENT // 100)


#: Least lengths of the classes, each a fifth above the one before.
_CLASSES = [LEAST_CHARS]
while _CLASSES[-1] < 1 << 31:
    _CLASSES.append(_CLASSES[-1] * 6 // 5)
#: Least lengths of quarters of classes, between which spans of lengths may end.
_QUARTERS = sorted({low + (high - low) * i // 4 for low, high in zip(_CLASSES, _CLASSES[1:], strict=False) for i in range(4)})


def layout(kind: int) -> tuple[int, int]:
    """Edits to reckon with in a class, and the width of its segments."""
    most = edits(_CLASSES[kind + 1] - 1)
    return most, _CLASSES[kind] // (most + 1)


def classes_of(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each length, and the lowest class that a line of that length can be edited from."""
    shortest = np.maximum(chars - np.maximum(EDITS, chars * PERCENT // 100), LEAST_CHARS)
    return np.searchsorted(_CLASSES, chars, "right") - 1, np.searchsorted(_CLASSES, shortest, "right") - 1


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance in code points is at most ``edits``: only a band of 2 * edits + 1 rows around the diagonal is kept,
    as bits, and it moves down a row with every column."""
    if abs(len(a) - len(b)) > edits:
        return False
    same = len(os.path.commonprefix([a, b]))
    a, b = a[same:], b[same:]
    same = len(os.path.commonprefix([a[::-1], b[::-1]]))
    a, b = a[: len(a) - same], b[: len(b) - same]
    if not a or not b:
        return max(len(a), len(b)) <= edits
    rows, width = len(a), 2 * edits + 1
    mask, low = (1 << width) - 1, 1 << (width - 1)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    plus, minus = mask >> edits << edits, 0  # differences down the first column; rows above the first have none
    score = min(edits, rows)
    for j, c in enumerate(b):
        top = j - edits  # row, from 0, of the band's first bit
        hits = places.get(c, 0)
        hits = (hits >> top if top >= 0 else hits << -top) & mask
        level = ((((hits & plus) + plus) ^ plus) | hits | minus) & mask
        right_plus, right_minus = (minus | ~(level | plus)) & mask, level & plus
        last = rows - 1 - top
        if last >= width - 1:
            score += not level & low
        else:
            score += (right_plus >> last & 1) - (right_minus >> last & 1)
        if score > edits + min(len(b) - 1 - j, len(b) - rows + edits):  # it can fall by one a column on the last row only
            return False
        down = level >> 1
        plus, minus = (right_minus | ~(down | right_plus)) & mask, down & right_plus
    return score <= edits


#: Words of bits that a band may take, pairs compared at a time, and columns between two looks at which are still near.
_BANDS, _PAIRS, _COLUMNS = (np.uint8, np.uint16, np.uint32, np.uint64), 1024, 32


def _codes(found: list[str], lengths: np.ndarray, ahead: np.ndarray, width: int, blank: int, kind: type) -> np.ndarray:
    """Code points of texts, each in a row with some ``blank`` ahead and after, and no more of it than ``lengths``."""
    out = np.full((len(found), width), blank, kind)
    column = np.arange(width)
    out[(column >= ahead[:, None]) & (column < (ahead + lengths)[:, None])] = np.frombuffer(
        "".join(x[:n] for x, n in zip(found, lengths.tolist(), strict=True)).encode("utf-32-le"), "<u4")
    return out


def _near_in_band(longer: list[str], shorter: list[str], most: np.ndarray, word: type) -> np.ndarray:
    """``within`` of many pairs, whose edits are fewer than ``word`` has bits, a column of all pairs at a time. A band need hold only the
    diagonals that the edits reach and come back from, at most one more than the edits. Differences along the last diagonal are added up."""
    bits = np.dtype(word).itemsize * 8
    cols = np.array([len(x) for x in shorter])
    delta = np.array([len(x) for x in longer]) - cols
    above = (most - delta) // 2
    wide, top = int(cols.max()), int(np.frombuffer("".join([*longer, *shorter]).encode("utf-32-le"), "<u4").max())
    kind = next(k for k in (np.uint8, np.uint16, np.uint32) if top + 2 < 1 << 8 * np.dtype(k).itemsize)
    a = _codes(longer, np.minimum(delta + cols, wide + bits - above), above, wide + bits, top + 1, kind)
    b = _codes(shorter, cols, np.zeros(len(cols), int), wide, top + 2, kind)
    left, near, one = np.arange(len(cols)), np.zeros(len(cols), bool), word(1)
    score, last, allowed = delta.astype(np.int32), (above + delta).astype(word), most.astype(np.int32)
    plus, minus = np.full(len(cols), ~word(0)) << above.astype(word), np.zeros(len(cols), word)
    for begin in range(0, wide, _COLUMNS):
        end = min(begin + _COLUMNS, wide)
        windows = np.lib.stride_tricks.sliding_window_view(a[:, begin : end + bits - 1], bits, axis=1)
        hits = np.packbits(windows == b[:, begin:end, None], axis=-1, bitorder="little").view(word)[:, :, 0].T.copy()
        for j in range(begin, end):
            hit = hits[j - begin]
            level = (((hit & plus) + plus) ^ plus) | hit | minus
            right_plus, right_minus = minus | ~(level | plus), level & plus
            score += ((level >> last & one) == 0) & (j < cols)
            down = level >> one
            plus, minus = right_minus | ~(down | right_plus), down & right_plus
        near[left[(cols <= end) & (score <= allowed)]] = True
        still = (score <= allowed) & (cols > end)
        if not still.all():
            left, a, b, cols, score, last, allowed, plus, minus = (x[still] for x in (left, a, b, cols, score, last, allowed, plus, minus))
            if not len(left):
                break
    return near


def _pair_counts(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    return np.bincount(((codes[:-1] << np.uint64(21) | codes[1:]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(52)).view(np.int64), minlength=4096)


def all_within(x: list[str], y: list[str]) -> np.ndarray:
    """Of each pair of lines, whether it is within the edits allowed."""
    n, m = (np.array([len(t) for t in c], np.int64) for c in (x, y))
    short = np.minimum(n, m)
    most = np.maximum(EDITS, short * PERCENT // 100)
    out, delta = np.zeros(len(n), bool), np.abs(n - m)

    def try_band(of: np.ndarray, most: np.ndarray, word: type) -> None:
        of, begin, bits = of[np.argsort(short[of], kind="stable")], 0, np.dtype(word).itemsize * 8
        while begin < len(of):
            end = min(begin + _PAIRS, len(of))
            while end - begin > 1 and (end - begin) * (int(short[of[end - 1]]) + bits) > 1 << 20:
                end = begin + (end - begin) // 2
            at = of[begin:end]
            pairs = [(x[i], y[i]) if n[i] >= m[i] else (y[i], x[i]) for i in at.tolist()]
            out[at] = _near_in_band([p for p, _ in pairs], [p for _, p in pairs], most[at], word)
            begin = end

    least = 0
    for word in _BANDS:
        bits = np.dtype(word).itemsize * 8
        try_band(np.flatnonzero((delta <= most) & (least <= most) & (most < bits)), most, word)
        least = bits
    # More edits than a word has bits: a band of one word finds most near copies; of the rest, an edit changes four pairs of characters at most.
    try_band(np.flatnonzero((delta < least) & (most >= least)), np.minimum(most, least - 1), _BANDS[-1])
    for i in np.flatnonzero((delta <= most) & (most >= least) & ~out).tolist():
        if np.abs(_pair_counts(x[i]) - _pair_counts(y[i])).sum() <= 4 * most[i]:
            out[i] = within(x[i], y[i], int(most[i]))
    return out


def _lines(text: str) -> list[tuple[int, str]]:
    """Number and text of the lines that are not blank."""
    return [(i, line) for i, line in enumerate(text.split("\n")) if line.strip(BLANKS)]


def _keys(lines: list[str]) -> np.ndarray:
    """Two 64-bit halves of a line's hash; the last bit of the first is left free."""
    made = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) for x in lines), "<i8").reshape(-1, 2).copy()
    made[:, 0] &= -2
    return made


def _parities(found: list[str], chars: np.ndarray) -> np.ndarray:
    """For each of the lines, in columns: of each of 256 kinds of neighbouring characters, whether their number is odd. An edit changes four of
    them at most."""
    out, part = [np.zeros((_WORDS, 0), np.uint64)], (np.cumsum(chars) - chars) // _CUT
    edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(chars)]
    for begin, end in zip(edges, edges[1:], strict=False):
        if begin < end:
            codes = np.frombuffer("".join(found[begin:end]).encode("utf-32-le"), "<u4").astype(np.uint64)
            kinds = np.append((codes[:-1] << np.uint64(21) | codes[1:]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56), np.uint64(0))
            bits, ends = np.uint64(1) << (kinds & np.uint64(63)), np.cumsum(chars[begin:end])
            bits[ends - 1] = 0  # a line's last character has no neighbour
            word, begins = (kinds >> np.uint64(6)).astype(np.uint8), ends - chars[begin:end]
            out.append(np.array([np.bitwise_xor.reduceat(bits * (word == i), begins) for i in range(_WORDS)]))
    return np.concatenate(out, axis=1).view(np.int64)


def _marks(docs: DataFrame) -> DataFrame:
    """(doc_id, line, h1, h2, quarter) of each line that is not blank; ``quarter`` of a class by length, -1 for lines that no edits are allowed in."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), [[] for _ in range(5)]
            for i, text in texts(batch):
                found = _lines(text)
                if not found or ids[i] is None:
                    continue
                keys = _keys([x for _, x in found])
                for column, values in zip(out, (
                        np.full(len(found), ids[i]), np.array([n for n, _ in found], np.int32), keys[:, 0], keys[:, 1],
                        np.array([len(x) for _, x in found], np.int32)), strict=True):
                    column.append(values)
            columns = [np.concatenate(c) if c else np.zeros(0, np.int32) for c in out]
            columns[4] = np.searchsorted(_QUARTERS, columns[4], "right") - 1
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "line", "h1", "h2", "quarter"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        mark, "doc_id long, line int, h1 long, h2 long, quarter int")


_SPREAD, _STEP, _WHOLE = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, (1 << 64) - 1
_ODD, _BASE, _INVERSE = np.uint64(_SPREAD), np.uint64(_STEP), np.uint64(pow(_STEP, -1, 1 << 64))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """The first ``n`` powers; those of a usual chunk are kept."""
    kept = _POWERS.get(int(base), ())
    if n > len(kept):
        out = np.full(max(n, 2 * _CUT), base, np.uint64)
        out[0] = 1
        kept = np.cumprod(out)
        if n <= 2 * _CUT:
            _POWERS[int(base)] = kept
    return kept[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD
    return x ^ (x >> np.uint64(29))


#: In place of a segment's number.
_ANY = 1 << 31


class Cut:
    """Some lines of one class on end, with a hash of every substring as wide as the class's segments. Its keys begin with the bits of
    ``region`` (their value and number), so that those of a class lie together in a filter, and with a bit that tells the two sorts apart."""

    def __init__(self, found: list[str], kind: int, region: tuple[int, int] = (0, 0)) -> None:
        self.kind, (self.most, self.width), (prefix, self._taken) = kind, layout(kind), region
        self._prefixes = [np.uint64((prefix << 1 | sort) << (63 - self._taken)) for sort in (0, 1)]
        self.chars = np.array([len(x) for x in found], np.int64)
        self.begins = np.cumsum(self.chars) - self.chars
        codes = np.frombuffer("".join(found).encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
        self._ahead = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * _powers(_BASE, len(codes)))])

    def _hash(self, at: np.ndarray) -> np.ndarray:
        """Hashes of the substrings that begin there."""
        return (self._ahead[at + self.width] - self._ahead[at]) * _powers(_INVERSE, len(self._ahead))[at]

    def _put(self, mixed: np.ndarray, sort: int) -> np.ndarray:
        return mixed >> np.uint64(self._taken + 1) | self._prefixes[sort]

    def _key(self, salt: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        return self._put(_mixed(hashes + (np.asarray(salt + (self.kind << 32), np.uint64) * np.uint64(2) + np.uint64(1)) * _ODD), 1)

    def _any(self, hashes: np.ndarray) -> np.ndarray:
        """Keys as of segments of any number, for a filter only."""
        return self._put((hashes ^ (hashes >> np.uint64(32))) * np.uint64(_SPREAD * (2 * self.kind + 1) & _WHOLE), 0)

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all segments of all lines: the line, the key, and the key that segments of any number would have."""
        number = np.tile(np.arange(self.most + 1), len(self.chars))
        line = np.repeat(np.arange(len(self.chars)), self.most + 1)
        at = self.begins[line] + number * self.width
        hashes = self._hash(at)
        return line, self._key(number, hashes), self._any(hashes)

    def substrings(
        self, own: bool, may_hold: Callable[[np.ndarray], np.ndarray], may_repeat: Callable[[np.ndarray], np.ndarray] | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """(line, key) of the substrings that can be a segment of another line, of those that ``may_hold`` picks: first whether they can be a
        segment at all, then for each number whose place they are near enough to. ``own`` says that these lines have segments of this class
        themselves. A substring equal to the line's own segment of that number is left out, as that one stands for it, and so are the line's own
        segments that ``may_repeat`` does not pick, which no other segment equals."""
        n = len(self._ahead) - self.width
        at = may_hold(self._any((self._ahead[self.width :] - self._ahead[:n]) * _powers(_INVERSE, n)))  # those across lines are dropped here:
        line = np.searchsorted(self.begins, at, "right") - 1
        place = at - self.begins[line]
        inside = place <= np.minimum(self.chars[line] - self.width, self.most * (self.width + 1))
        if own and may_repeat:
            mine = np.flatnonzero(inside & (place % self.width == 0) & (place <= self.most * self.width))
            inside[mine] = False
            inside[mine[may_repeat(self._any(self._hash(at[mine])))]] = True
        line, at, place = line[inside], at[inside], place[inside]
        # Some segment has as many edits before it as segments, so it is moved no further than that, nor further ahead than edits are left.
        low = -(-place // (self.width + 1))
        high = np.minimum(np.minimum(place // (self.width - 1), (place + self.most) // (self.width + 1)), self.most)
        n = np.maximum(high - low + 1, 0)
        if own:
            n[(n == 1) & (low * self.width == place)] = 0  # the line's own segment, and near to no other number
        few = np.flatnonzero(n)
        line, at, low, n = line[few], at[few], low[few], n[few]
        number = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        of = np.repeat(line, n)
        key = self._key(number, np.repeat(self._hash(at), n))
        picked = may_hold(key)
        of, key, number = of[picked], key[picked], number[picked]
        if own:
            other = np.flatnonzero(key != self._key(number, self._hash(self.begins[of] + number * self.width)))
            of, key = of[other], key[other]
        order = np.lexsort((key, of))
        of, key = of[order], key[order]
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (key[1:] != key[:-1])
        return of[new], key[new]


def _cuts(
    names: np.ndarray, found: list[str], chars: np.ndarray, span: tuple[int, int], lower: bool, regions: dict[int, tuple[int, int]]
) -> Iterator[tuple[np.ndarray, Cut, bool]]:
    """Names of lines and the lines cut, some at a time, by class, and whether they are entered there; those of lengths in ``span`` are. With
    ``lower``, also lines that are not, by the classes in the span that they can be edited from."""
    own, lowest = classes_of(chars)
    entered = (span[0] <= chars) & (chars < span[1])
    for kind in np.unique(np.concatenate([own, lowest])).tolist():
        if _CLASSES[kind] >= span[1] or _CLASSES[kind + 1] <= span[0]:
            continue
        mine = entered & (own == kind)
        for is_mine, of in ((True, mine), (False, (lowest <= kind) & (kind <= own) & ~mine)):
            at = np.flatnonzero(of)
            if len(at) and (is_mine or lower):
                part = (np.cumsum(chars[at]) - chars[at]) // _CUT
                for piece in np.split(at, np.flatnonzero(part[1:] != part[:-1]) + 1):
                    yield names[piece], Cut([found[i] for i in piece.tolist()], kind, regions.get(kind, (0, 0))), is_mine


def _in_classes(found: dict[int, str], lower: bool) -> Iterator[tuple[np.ndarray, Cut, bool]]:
    """``_cuts`` of lines by name, of all lengths."""
    chars = np.array([len(x) for x in found.values()], np.int64)
    return _cuts(np.array(list(found), np.int64), list(found.values()), chars, (0, 1 << 62), lower, {})


def _distinct_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[int, str]]:
    """Lines that edits are allowed in, by the first half of their hash, mostly once for each task and some ``_CHUNK`` code points at a time."""
    seen: set[int] = set()
    for batch in batches:
        ids, held, size = batch.column(0).to_pylist(), {}, 0
        if len(seen) > _SEEN:
            seen.clear()
        for i, text in texts(batch):
            found = [x for _, x in _lines(text) if len(x) >= LEAST_CHARS] if ids[i] is not None else []
            for line, key in zip(found, _keys(found)[:, 0].tolist() if found else [], strict=True):
                if key not in seen:
                    seen.add(key)
                    held[key] = line
                    size += len(line)
            if size > _CHUNK:
                yield held
                held, size = {}, 0
        if held:
            yield held


#: Bits of a filter for each key at least, of a part of it, and of all of it at most (32 MB); places of a key in it. More keys are worked
#: off in spans of lengths, each with a filter of its own, and those of a quarter of a class that are too many still in slices of keys.
_BITS_EACH, _PART_BITS, _MOST_BITS, _PLACES = 8, 16, 28, 3


class Filter:
    """Whether a key may be held, and whether it may be held twice. Built of parts by a shuffle; a key is a few bits, wherever it lies."""

    def __init__(self, bits: int) -> None:
        self.bits = bits
        self.once = np.zeros(max(1 << (bits - 3), 1), np.uint8)
        self.twice = np.zeros_like(self.once)

    @staticmethod
    def for_keys(n: int) -> int:
        return min(max((n * _BITS_EACH).bit_length(), _PART_BITS), _MOST_BITS)

    @staticmethod
    def places(keys: np.ndarray, bits: int, turn: int) -> np.ndarray:
        """The first follows from the bits that a key begins with, the others lie in the same 512 bytes; keys are mixed already."""
        first = keys >> np.uint64(64 - bits)
        return first ^ (keys * np.uint64(_STEP * (2 * turn + 1) & _WHOLE) >> np.uint64(52)) if turn else first

    @staticmethod
    def among(held: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
        """Which ``keys`` may be held."""
        left = None
        for turn in range(_PLACES):
            at = Filter.places(keys if left is None else keys[left], bits, turn).view(np.int64)
            hit = np.flatnonzero((held.take(at >> 3, mode="clip") >> (at & 7).astype(np.uint8) & np.uint8(1)).view(bool))
            left = hit if left is None else left[hit]
        return left

    @staticmethod
    def noted(parts: list[np.ndarray], bits: int) -> pa.RecordBatch:
        """(part, places): the places of keys, twice at most, by part of the filter."""
        keys = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        # A key noted twice counts twice in each of its places, and so do two keys in one.
        at = np.sort(np.concatenate([Filter.places(keys, bits, turn).astype(np.uint32) for turn in range(_PLACES)]))
        at = np.concatenate([at[:2], at[2:][at[2:] != at[:-2]]])
        part = (at >> np.uint32(_PART_BITS)).astype(np.int64)
        edges = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]]) if len(part) else np.zeros(1, np.int64)
        raw = (at & np.uint32((1 << _PART_BITS) - 1)).astype("<u2")
        return pa.RecordBatch.from_arrays(
            [pa.array(part[edges[:-1]], pa.int64()), pa.array([raw[b:e].tobytes() for b, e in zip(edges, edges[1:], strict=False)], pa.binary())],
            names=["part", "places"])

    @classmethod
    def of(cls, noted: DataFrame, bits: int) -> Filter:
        """From rows of ``noted``, added up by part in tasks; what comes back is the filter, of a size with a bound."""

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def out(part: int, held: list[bytes]) -> pa.RecordBatch:
                counts = np.bincount(np.frombuffer(b"".join(held), "<u2"), minlength=1 << _PART_BITS)
                packed = [np.packbits(counts >= n, bitorder="little").tobytes() for n in (1, 2)]
                return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), *[pa.array([x], pa.binary()) for x in packed]], names=["part", "once", "twice"])

            now, held = None, []
            for batch in batches:
                for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if part != now:
                        if held:
                            yield out(now, held)
                        now, held = part, []
                    held.append(raw)
            if held:
                yield out(now, held)

        made, size = cls(bits), 1 << (_PART_BITS - 3)
        parts = noted.repartition("part").sortWithinPartitions("part").mapInArrow(add, "part long, once binary, twice binary")
        with passing():
            for row in staged(parts, "filter", "zstd").toLocalIterator():
                for held, name in ((made.once, "once"), (made.twice, "twice")):
                    held[row["part"] * size : (row["part"] + 1) * size] = np.frombuffer(row[name], np.uint8)
        return made


_SHARED = "key long, line long, told boolean"
#: Keys noted at a time.
_NOTED = 1_000_000


def _rows(parts: list[tuple[np.ndarray, np.ndarray]], told: bool) -> pa.RecordBatch:
    keys, of = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(of), pa.array(np.full(len(of), told))], names=["key", "line", "told"])


def _noting(parts: Iterator[np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    """Keys of a task noted in a filter, some at a time."""
    held, n = [], 0
    for keys in parts:
        held.append(keys)
        n += len(keys)
        if n > _NOTED:
            yield Filter.noted(held, bits)
            held, n = [], 0
    yield Filter.noted(held, bits)


#: A filter's lines: from which length on, up to which, and in how many slices of keys.
Span = tuple[int, int, int]


def _spans(segments: dict[int, int]) -> list[Span]:
    """Spans of lengths with as many segments (given by quarter of a class) as a filter has room for, and slices of those that have more."""
    room, out, held = max((1 << _MOST_BITS) // (2 * _BITS_EACH), 1), [], 0
    for quarter, n in sorted(segments.items()):
        if not out or held + n > room:
            out.append([_QUARTERS[quarter], 0, 1])
            held = 0
        held += n
        out[-1][2] = max(-(-held // room), 1)
    ends = [low for low, _, _ in out[1:]] + [1 << 62]
    return [(low, high, slices) for (low, _, slices), high in zip(out, ends, strict=True)]


def _regions(segments: dict[int, int]) -> dict[int, tuple[int, int]]:
    """The bits that keys of each class begin with, for so many segments by class: a class has its share of a filter, by powers of two."""
    total, free, taken = sum(segments.values()), 1.0, {}
    for kind, n in segments.items():
        taken[kind] = (-(-total // n) - 1).bit_length()
        free -= 0.5 ** taken[kind]
    for kind in sorted(taken, key=lambda k: -segments[k] * 2 ** taken[k]):  # what is left goes to the fullest
        if taken[kind] and 0.5 ** taken[kind] <= free:
            free -= 0.5 ** taken[kind]
            taken[kind] -= 1
    out, at = {}, 0.0
    for kind in sorted(taken, key=lambda k: (taken[k], k)):
        out[kind] = (int(at * 2 ** taken[kind]), taken[kind])
        at += 0.5 ** taken[kind]
    return out


def _class(quarter: int) -> int:
    return int(classes_of(np.array([_QUARTERS[quarter]]))[0][0])


def _repeated(classes: DataFrame) -> tuple[np.ndarray, int]:
    """A filter of the hashes of lines that occur more than once."""
    keys = classes.where("n > 1").select("h1")
    bits = Filter.for_keys(keys.count())

    def note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _noting((_mixed(batch.column(0).to_numpy().view(np.uint64)) for batch in batches), bits)

    return Filter.of(keys.mapInArrow(note, "part long, places binary"), bits).once, bits


def _distinct(docs: DataFrame, spans: list[Span], clashing: list[int], classes: DataFrame | None = None) -> DataFrame:
    """(span, h1, chars, entered, line) of each line that edits are allowed in, but those of ``clashing`` hashes, once for each span that it
    is entered or asks in. Only lines that occur more than once, by ``classes``, are shuffled for that. Staged."""
    lows, left_out = np.array([low for low, _, _ in spans]), set(clashing)
    schema = "span int, h1 long, chars int, entered boolean, repeated boolean, line string"
    send = docs.sparkSession.sparkContext.broadcast
    repeated, bits = _repeated(classes) if classes else (np.zeros(0, np.uint8), 0)
    known = send(repeated)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _distinct_lines(batches):
            for key in left_out & found.keys():
                del found[key]
            h1, lines = np.array(list(found), np.int64), pa.array(list(found.values()), pa.string())
            chars = np.array([len(x) for x in found.values()], np.int64)
            shortest = np.maximum(chars - np.maximum(EDITS, chars * PERCENT // 100), LEAST_CHARS)
            own, lowest = (np.searchsorted(lows, n, "right") - 1 for n in (chars, shortest))
            more = np.full(len(h1), not bits)
            if bits:
                more[Filter.among(known.value, bits, _mixed(h1.view(np.uint64)))] = True
            for span in np.unique(np.concatenate([own, lowest])).tolist():
                at = np.flatnonzero((lowest <= span) & (span <= own))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), span), pa.int32()), pa.array(h1[at]), pa.array(chars[at], pa.int32()), pa.array(own[at] == span),
                     pa.array(more[at]), lines.take(pa.array(at))],
                    names=["span", "h1", "chars", "entered", "repeated", "line"])

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # no more than a task's rows
        for batch in batches:
            keep = []
            for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keep.append(key not in seen)
                seen.add(key)
            yield batch.filter(pa.array(keep, pa.bool_()))

    def put(df: DataFrame, label: str) -> DataFrame:
        return staged(df, label, "zstd") if len(spans) == 1 else staged(df, label, "zstd", by="span")

    columns = ["span", "h1", "chars", "entered", "line"]
    dealt = put(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(deal, schema), "dealt")
    known.destroy()
    shuffled = dealt.where("repeated").select(*columns).repartition("span", "h1")
    single = put(shuffled.mapInArrow(once, "span int, h1 long, chars int, entered boolean, line string"), "single")
    return dealt.where("NOT repeated").select(*columns).unionByName(single.select(*columns))


def _shared(docs: DataFrame, segments: int | dict[int, int], lines: DataFrame | None = None) -> DataFrame:
    """(key, line, told) of segments (``told``) and of substrings that another line may share; the rest, far the
    most, does not leave the scan. ``segments`` is how many there are, in all or by quarter of a class, which says how large filters, how many spans of
    lengths and how many slices of keys it takes. ``lines``: those of ``docs``, if dealt to these spans already."""
    counts = segments if isinstance(segments, dict) else {0: segments}
    spans = _spans(counts)
    source = _distinct(docs, spans, []) if lines is None else lines
    out = []
    for number, (low, high, slices) in enumerate(spans):
        by_class: dict[int, int] = {}
        for quarter, n in counts.items():
            if n and low <= _QUARTERS[quarter] < high:
                by_class[_class(quarter)] = by_class.get(_class(quarter), 0) + n
        bits = Filter.for_keys(2 * sum(by_class.values()) // slices + 1)
        rows = source.where(F.col("span") == number).select("h1", "chars", "line")
        out += [_slice_rows(rows, (low, high), _regions(by_class), bits, slices, i) for i in range(slices)]
    shared = out[0]
    for more in out[1:]:
        shared = shared.unionByName(more)
    return shared


def _slice_rows(
    source: DataFrame, span: tuple[int, int], regions: dict[int, tuple[int, int]], bits: int, slices: int, slice_: int) -> DataFrame:
    """``_shared`` for the lines (h1, chars, line) of one span, and the keys of one slice."""

    def mine(keys: np.ndarray) -> np.ndarray:
        return np.arange(len(keys)) if slices == 1 else np.flatnonzero(_mixed(keys) % np.uint64(slices) == np.uint64(slice_))

    def cuts(batches: Iterator[pa.RecordBatch], lower: bool) -> Iterator[Iterator[tuple[np.ndarray, Cut, bool]]]:
        """Of many lines at a time, so that a class's part of the filter is used again while it is at hand."""
        names, chars, found, size = [], [], [], 0
        for batch in batches:
            names.append(batch.column(0).to_numpy())
            chars.append(batch.column(1).to_numpy().astype(np.int64))
            found += batch.column(2).to_pylist()
            size += int(chars[-1].sum())
            if size > _HELD:
                yield _cuts(np.concatenate(names), found, np.concatenate(chars), span, lower, regions)
                names, chars, found, size = [], [], [], 0
        if found:
            yield _cuts(np.concatenate(names), found, np.concatenate(chars), span, lower, regions)

    def note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def keys() -> Iterator[np.ndarray]:
            for held in cuts(batches, False):
                for _, cut, _ in held:
                    _, key, plain = cut.segments()
                    at = mine(key)
                    yield np.concatenate([key[at], plain[at]])

        return _noting(keys(), bits)

    known = Filter.of(source.mapInArrow(note, "part long, places binary"), bits)
    send = source.sparkSession.sparkContext.broadcast
    once, twice = send(known.once), send(known.twice)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in cuts(batches, True):
            parts = []
            again = (lambda k: Filter.among(twice.value, bits, k)) if slices == 1 else None  # a slice notes only some of a line's segments
            for names, cut, own in held:
                line, key = cut.substrings(own, lambda k: Filter.among(once.value, bits, k), again)
                at = mine(key)
                parts.append((key[at], names[line[at]]))
            yield _rows(parts, False)

    asked = staged(source.mapInArrow(ask, _SHARED), "asked", "zstd")
    once.destroy()  # else it lies on every executor until the driver next collects garbage
    asked_bits = Filter.for_keys(asked.count())

    def note_asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _noting((batch.column(0).to_numpy().view(np.uint64) for batch in batches), asked_bits)

    wanted = send(Filter.of(asked.select("key").mapInArrow(note_asked, "part long, places binary"), asked_bits).once)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in cuts(batches, False):
            parts = []
            for names, cut, _ in held:
                line, key, _ = cut.segments()
                at = mine(key)
                key, line, picked = key[at], line[at], np.zeros(len(at), bool)
                picked[Filter.among(twice.value, bits, key)] = True
                picked[Filter.among(wanted.value, asked_bits, key)] = True
                parts.append((key[picked], names[line[picked]]))
            yield _rows(parts, True)

    told = staged(source.mapInArrow(tell, _SHARED), "told", "zstd")
    twice.destroy()
    wanted.destroy()
    return asked.unionByName(told)


def _may_match(x: str, y: str) -> Column:
    """Whether lengths and parities of lines, in columns that end in ``x`` and ``y``, allow the edits."""
    allowed = F.greatest(F.lit(EDITS), F.floor(F.least(f"chars_{x}", f"chars_{y}") * PERCENT / 100))
    differ = sum((F.bit_count(F.col(f"{p}_{x}").bitwiseXOR(F.col(f"{p}_{y}"))) for p in _PARITIES), F.lit(0))
    return (F.abs(F.col(f"chars_{x}") - F.col(f"chars_{y}")) <= allowed) & (differ <= 4 * allowed)


def _side(rows: DataFrame, name: str, line: str, *others: str) -> DataFrame:
    """``line`` as ``name``, and what ``_may_match`` asks of it."""
    return rows.select(F.col(line).alias(name), *others, *(F.col(c).alias(f"{c}_{name}") for c in ("chars", *_PARITIES)))


def _alike(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (a, b) whose lengths and parities allow the edits."""
    return pairs.join(_side(sketches, "a", "h1"), "a").join(_side(sketches, "b", "h1"), "b").where(_may_match("a", "b")).select("a", "b")


def _sketches(lines: DataFrame, named: DataFrame) -> DataFrame:
    """(h1, chars, parity0 ...) of the lines named, and perhaps of more. Staged."""
    bits = key_filter(named, "h1")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(passes(bits, batch.column(0).to_numpy())))
            chars = batch.column(1).to_numpy().astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *map(pa.array, _parities(batch.column(2).to_pylist(), chars))], names=["h1", "chars", *_PARITIES])

    rows = lines.select("h1", "chars", "line").mapInArrow(sketch, "h1 long, chars int, " + ", ".join(f"{x} long" for x in _PARITIES))
    return staged(rows, "sketches", "zstd")


def _verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """Pairs whose lines are within the edits, staged. Only lines that a pair names leave the scan."""
    with passing() as scope:
        return scope.keep(staged(_near(pairs, lines), "line-links"))


def _near(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    named = staged(pairs.select(F.col("a").alias("h1")).union(pairs.select("b")).distinct(), "named")
    bits = key_filter(named, "h1")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(bits, batch.column(0).to_numpy())))

    source = lines.select("h1", "line").mapInArrow(take, "h1 long, line string")
    found = staged(source.join(named, "h1", "left_semi"), "lines", "zstd")

    @F.pandas_udf("boolean")
    def near(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(all_within(x.tolist(), y.tolist()))

    left = found.select(F.col("h1").alias("a"), F.col("line").alias("line_a"))
    right = found.select(F.col("h1").alias("b"), F.col("line").alias("line_b"))
    return pairs.join(left, "a").join(right, "b").where(near("line_a", "line_b")).select("a", "b")


def _links(docs: DataFrame, classes: DataFrame, segments: dict[int, int], clashing: list[int]) -> DataFrame:
    """(node, component) of lines (h1) with a near copy."""
    lines = _distinct(docs, _spans(segments), clashing, classes)
    with passing() as scope:
        rows = _shared(docs, segments, lines)
        told, asked = rows.where("told"), rows.where("NOT told")
        firsts = told.groupBy("key").agg(F.min("line").alias("first"), F.max("line").alias("last"))
        # A key that one line is entered under is done with when those that ask for it have met that line.
        met = asked.join(firsts, "key").unionByName(told.join(firsts, "key").where("first != last"))
        shared = scope.keep(staged(met.select("key", "line", "told", "first", (F.col("first") != F.col("last")).alias("several")), "met", "zstd"))
    lines = lines.where("entered")
    sketches = _sketches(lines, shared.select(F.col("line").alias("h1")).union(shared.select("first")))
    ordered = (F.least("line", "first").alias("a"), F.greatest("line", "first").alias("b"))
    star = staged(_alike(shared.where("line != first").select(*ordered).distinct(), sketches), "star")
    links = _verified(star, lines)
    parts = components(links)
    named = (
        shared.where("several").join(parts, shared["line"] == parts["node"], "left")
        .select("key", "line", "told", "first", F.coalesce("component", "line").alias("part")))
    apart = named.groupBy("key").agg((F.min("part") != F.max("part")).alias("apart")).where("apart").select("key")
    named = named.join(apart, "key", "left_semi").where("line != first").drop("first")
    named = staged(named.join(sketches.withColumnRenamed("h1", "line"), "line"), "apart", "zstd")
    sizes = named.groupBy("key").agg(F.ceil(F.count("*") / _BLOCK).alias("blocks"))
    dealt = named.join(sizes, "key")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    left = dealt.withColumn("row", F.pmod(F.xxhash64("line"), F.col("blocks"))).withColumn("column", every)
    right = dealt.withColumn("column", F.pmod(F.xxhash64("line", F.lit(1)), F.col("blocks"))).withColumn("row", every)
    x = _side(left.where("told"), "x", "line", "key", "row", "column", F.col("part").alias("part_x"))
    y = _side(right, "y", "line", "key", "row", "column", (~F.col("told")).alias("probe"), F.col("part").alias("part_y"))
    rest = (
        x.join(y, (x["key"] == y["key"]) & (x["row"] == y["row"]) & (x["column"] == y["column"]) & (F.col("probe") | (F.col("x") < F.col("y"))) & (F.col("part_x") != F.col("part_y")) & _may_match("x", "y"))
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    rest = staged(rest.join(star, ["a", "b"], "left_anti"), "rest")
    return components(links.unionByName(_verified(rest, lines)))


def _segments(classes: DataFrame) -> dict[int, int]:
    """How many segments lines have, by quarter of a class."""
    counts = classes.where("quarter >= 0").groupBy("quarter").agg(F.count("*").alias("n")).collect()  # some hundred rows at most
    return {r["quarter"]: r["n"] * (layout(_class(r["quarter"]))[0] + 1) for r in counts}


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, line, h1, near): lines to go, by number from 0. Of lines that are equal or linked by near copies, the first by
    doc_id and number stays; ``near`` says that no equal line comes earlier, only a near copy. Staged; what was staged for it is dropped."""
    spark = docs.sparkSession
    name, size = _BATCH_BYTES
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        with passing() as scope:
            return scope.keep(staged(_repeats(docs), "repeats", "zstd"))
    finally:
        spark.conf.set(name, before)


def _repeats(docs: DataFrame) -> DataFrame:
    marks = staged(_marks(docs), "marks", "zstd")
    place = F.struct("doc_id", "line")
    classes = staged(
        marks.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n"), F.min("quarter").alias("quarter")), "line-classes", "zstd")
    clashing = classes.groupBy("h1").agg(F.count("*").alias("n")).where("n > 1")  # 63 bits: none, or very few
    parts = staged(_links(docs, classes, _segments(classes) or {0: 0}, [r["h1"] for r in clashing.select("h1").collect()]), "parts")
    linked = classes.join(parts, classes["h1"] == parts["node"])
    heads = linked.groupBy("component").agg(F.min("first").alias("head"))
    of_part = linked.join(heads, "component").select("h1", "h2", "first", "head")
    alone = classes.join(parts, classes["h1"] == parts["node"], "left_anti").where("first != last").select("h1", "h2", "first", F.col("first").alias("head"))
    plural = of_part.unionByName(alone)
    return (
        marks.select("doc_id", "line", "h1", "h2").join(plural, ["h1", "h2"])
        .where(F.struct("doc_id", "line") != F.col("head"))
        .select("doc_id", "line", "h1", (F.struct("doc_id", "line") == F.col("first")).alias("near")))


def cleaned(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` short of its repeated lines, then three columns: lines that are not blank, and how many went as equal and as
    near copies. They are named n_lines, n_exact and n_near, underscored where ``docs`` has such names.

    Blank lines stay. A null text stays null. A row with a null doc_id takes no part and stays as it is. Rows that repeat a
    doc_id are one document: equal ones are treated alike; where their texts differ, each loses the lines named for that id
    that it has there. An empty table gives none."""
    gone = repeats(docs).distinct().groupBy("doc_id").agg(F.collect_list(F.struct("line", "h1", "near")).alias("gone"))
    names = []
    for name in ("n_lines", "n_exact", "n_near"):
        names.append(fresh(name, [*docs.columns, *names]))
    marker, of = fresh("gone", docs.columns), fresh("gone_of", docs.columns)
    joined = docs.join(
        gone.select(F.col("doc_id").alias(of), F.col("gone").alias(marker)), docs["doc_id"].cast("long") == F.col(of), "left").drop(of)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(name, T.LongType()) for name in names)])
    at, kept_names = docs.columns.index("text"), docs.columns

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, new, counts = batch.column(batch.num_columns - 1).to_pylist(), [], []
            for text, drop in zip(batch.column(at).to_pylist(), lists, strict=True):
                if text is None:
                    new.append(None)
                    counts.append((0, 0, 0))
                    continue
                lines, dropped, near = text.split("\n"), set(), 0
                total = sum(1 for x in lines if x.strip(BLANKS))
                for x in drop or ():
                    if x["line"] < len(lines) and int(_keys([lines[x["line"]]])[0, 0]) == x["h1"] and x["line"] not in dropped:
                        dropped.add(x["line"])
                        near += x["near"]
                new.append("\n".join(x for i, x in enumerate(lines) if i not in dropped) if dropped else text)
                counts.append((total, len(dropped) - near, near))
            columns = [pa.array(new, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns - 1)]
            columns += [pa.array([c[i] for c in counts], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept_names, *names])

    return joined.mapInArrow(strip, schema)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with repeated lines taken out; a document that had lines and loses them all goes."""
    done = cleaned(docs)
    n, exact, near = done.columns[-3:]
    return done.where((F.col(n) == 0) | (F.col(n) > F.col(exact) + F.col(near))).select(*docs.columns)


def op1_segment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document: its lines that are not blank, how many go as equal and as near copies, whether any stays, and the CRC-32 of the text
    that stays."""
    done = cleaned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return done.select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_lines", "n_exact", "n_near",
        ((F.col("n_lines") == 0) | (F.col("n_lines") > F.col("n_exact") + F.col("n_near"))).alias("kept"), F.crc32(text).alias("text_crc32"))
