"""Operator 3: documents packed into sequences of a fixed number of tokens, by best-two-fit.

How many pieces there are of each length says all that packing needs, and there are at most 4096 lengths: bins are
planned on that histogram as patterns with a number of copies, however many documents there are. Pieces are numbered
within their length (numbers per staged part plus those before it, so a hot length is never one task's) and their
number says which copy of which pattern holds them.
"""

from __future__ import annotations

import json
import os
import re
import string
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import byte_letters, staged, table, texts

CAPACITY, VOCABULARY, END_ID = 4096, "word_bpe_49k.json", 1
#: Words whose ids a worker keeps; when full it drops the later half, as frequent words come first, so memory is bounded and results are
#: not touched.
_KEPT_WORDS = 1_200_000
_STOPS = string.punctuation.encode()
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Words of letters that neither folding nor composing can make something else of, and a byte that no text holds, for a word's end.
_PLAIN, _WORD_END = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+"), b"\xff"
# Fixed value: where the vocabulary cuts a text before merging.
_CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _merges(path: str) -> Callable[[bytes], list[int]] | None:
    """Ids of a word of letters and a word's end, from a file's own merges, where they are bytes, bytes that end a word, and merges in order of
    their ids: joining a byte to the end then comes before every merge. It takes a tenth of the time. None for any other file."""
    with open(path, encoding="utf-8") as lines:
        made = json.load(lines)
    model, steps = made["model"], (made.get("normalizer") or {}).get("normalizers", [])
    cut = ((made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    if model.get("type") != "BPE" or model.get("end_of_word_suffix") != "</w>" or [x.get("type") for x in steps] != ["NFC", "Replace", "Lowercase"]:
        return None
    if cut.get("pattern") != {"Regex": _CUTS} or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "ignore_merges")):
        return None
    letters, vocab = byte_letters(), model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if [vocab.get(a + b) for a, b in pairs] != list(range(512, 512 + len(pairs))):
        return None
    if {vocab.get(c) for c in letters} != set(range(256)) or {vocab.get(f"{c}</w>") for c in letters} != set(range(256, 512)):
        return None
    import tiktoken

    spelled = lambda t: bytes(letters[c] for c in t.removesuffix("</w>")) + (_WORD_END if t.endswith("</w>") else b"")
    ranks = {spelled(t): i for t, i in vocab.items() if i < 512 + len(pairs)}
    ranks |= {bytes([b]): len(vocab) + b for b in range(256) if bytes([b]) not in ranks}
    own = ranks.pop(_WORD_END, None)  # the byte itself gives way to the end; words of letters never hold it
    ranks[_WORD_END] = len(vocab) + 256
    plain = array("I").itemsize == 4 and sys.byteorder == "little"  # ids are kept as little-endian 32-bit numbers
    return None if own is None or not plain else tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})._encode_single_piece


def word_ids(path: str):
    """text -> its token ids as little-endian uint32 bytes. Words between ASCII blanks are encoded once and kept: the
    vocabulary's rules never look across a blank, nor from a letter or digit into the ASCII signs that end a word, and fold case first. A text
    with a special token's string is encoded as it stands."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    merge = _merges(path)
    known: dict[bytes, bytes] = {}

    def learn(words: set[bytes]) -> None:
        ended = {}
        for w in words:
            if w.isalpha():
                continue
            stem = w.rstrip(_STOPS)
            if len(stem) < len(w) and (stem[-1:].isalnum() or _PLAIN.fullmatch(stem.decode())):
                ended[w] = stem, w[len(stem) :]
        new = [w for w in {x for w in words for x in ended.get(w, (w,))} if w not in known]
        if merge is not None:
            rest = []
            for w in new:
                if w.isalpha():  # ASCII letters, folded already
                    known[w] = array("I", merge(w + _WORD_END)).tobytes()
                elif _PLAIN.fullmatch(text := w.decode()):
                    known[w] = array("I", merge(text.lower().encode() + _WORD_END)).tobytes()
                else:
                    rest.append(w)
            new = rest
        made = tokenizer.encode([w.decode() for w in new], is_pretokenized=True, add_special_tokens=False)
        raw = np.array(made.ids, "<u4").tobytes()
        edges = (4 * np.searchsorted(np.array(made.word_ids, np.int64), np.arange(len(new) + 1))).tolist()
        known.update((w, raw[b:e]) for w, b, e in zip(new, edges, edges[1:], strict=False))
        known.update((w, known[stem] + known[stops]) for w, (stem, stops) in ended.items())

    def of(text: str) -> bytes:
        if any(s in text for s in special):
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = text.encode().lower().split()
        found = list(map(known.get, words))
        if None in found:
            new = {w for w, ids in zip(words, found, strict=True) if ids is None}
            if len(known) + 2 * len(new) > _KEPT_WORDS:
                for w in list(islice(known, _KEPT_WORDS // 2, None)):
                    del known[w]
                new = {w for w in words if w not in known}
            learn(new)
            found = map(known.__getitem__, words)
        return b"".join(found)

    return of


_ENCODERS: dict[str, object] = {}


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of a document's ids and the end id: only what is longer than a sequence is cut. A null or empty
    text is the end id alone; repeated rows give their pieces again."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = word_ids(path)
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            out: list[tuple] = []
            ids = batch.column(0).to_pylist()
            for i, text in texts(batch):
                raw = _ENCODERS[path](text) + end
                for n, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    out.append((ids[i], n, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, _PIECES)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns (lengths that share a bin, longest first) and copies of each.

    A bin starts with the longest piece left and takes the longest that fits, again and again. If a gap remains, its
    smallest piece, unless it is the only one, goes back and the two unpacked pieces that fill the wider gap best take its
    place, if they fill more. A pattern is used as often as the histogram allows, so each use at least halves some
    length's count: patterns number lengths times the logarithm of the largest count at most."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    lengths = np.arange(capacity + 1)
    out = []

    def longest(most: int) -> int:
        while most > 0 and left[most] <= 0:
            below = np.flatnonzero(left[:most] > 0)
            most = int(below[-1]) if len(below) else 0
        return max(most, 0)

    while (first := longest(capacity)) > 0:
        before, bin_, gap = left.copy(), [first], capacity - first
        left[first] -= 1
        while gap > 0 and (fit := longest(gap)) > 0:
            bin_.append(fit)
            left[fit] -= 1
            gap -= fit
        while gap > 0 and len(bin_) > 1:
            small = min(bin_)
            room = gap + small
            one = np.flatnonzero(left[: room + 1] > 0)
            one = one[one > 0]
            if not len(one):
                break
            reach = np.maximum.accumulate(np.where(left[: room + 1] > 0, lengths[: room + 1], 0))
            other = reach[room - one]
            alone = (other == one) & (left[one] < 2)
            if alone.any():
                other[alone] = reach[np.maximum(one[alone] - 1, 0)]
            both = np.where(other > 0, one + other, 0)
            best = int(both.argmax())
            if both[best] <= small:
                break
            bin_.remove(small)
            bin_ += [int(one[best]), int(other[best])]
            left[small] += 1
            left[one[best]] -= 1
            left[other[best]] -= 1
            gap = room - int(both[best])
        used = before - left
        copies = int((before[used > 0] // used[used > 0]).min())
        left = before - used * copies
        out.append((sorted(bin_, reverse=True), copies))
    return out


def _slots(patterns: list[tuple[list[int], int]], capacity: int) -> dict[str, np.ndarray]:
    """For each use of a length by a pattern, in the order in which its pieces are numbered: first number, pieces in a bin, first
    bin, offset in the bin. ``key`` is length and first number in one."""
    taken = np.zeros(capacity + 1, np.int64)
    rows, bins = [], 0
    for lengths, copies in patterns:
        offset = 0
        for length in dict.fromkeys(lengths):
            per = lengths.count(length)
            rows.append((length, taken[length], per, bins, offset))
            taken[length] += per * copies
            offset += per * length
        bins += copies
    rows.sort()
    length, first, per, base, offset = np.array(rows, np.int64).reshape(-1, 5).T
    return {"length": length, "first": first, "per": per, "base": base, "offset": offset}


def packed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (rows with doc_id, piece and length of 1 to ``capacity``) with sequence_id and offset. Ties within a length go by
    doc_id and piece; equal rows are interchangeable. An empty table gives none."""
    laid = staged(cut.withColumn("part", F.spark_partition_id()), "pieces")
    counts = laid.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = _slots(plan(histogram, capacity), capacity)
    span = 1 << 48  # numbers within one length stay below this
    slots["key"] = slots["length"] * span + slots["first"]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        n = number.to_numpy(np.int64)
        at = np.searchsorted(slots["key"], length.to_numpy(np.int64) * span + n, "right") - 1
        n = n - slots["first"][at]
        per = slots["per"][at]
        return pd.DataFrame({
            "sequence_id": slots["base"][at] + n // per, "offset": slots["offset"][at] + n % per * slots["length"][at]})

    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("part", "length", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("begin"))
    within = Window.partitionBy("part", "length").orderBy("doc_id", "piece")
    numbered = (
        laid.withColumn("number", F.row_number().over(within) - 1).join(begins, ["part", "length"])
        .withColumn("at", place(F.col("length"), F.col("number") + F.col("begin"))))
    return numbered.select(*cut.columns, "at.sequence_id", "at.offset")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    return packed(pieces(docs, path, capacity), capacity)


def vocabulary() -> str:
    """Where the vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op3_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place; see ``pieces`` and ``packed`` for nulls, empty texts and ties."""
    return pack(table(spark, sf_dir, "documents"), vocabulary())
