"""Operator 13: the tokens of two tokenizers aligned by the bytes they cover.

Both tokenizers end a token at some of a text's bytes. The shorter list of ends drives a galloping search (steps that double, then
halving) into the longer one. Ends found in both cut the tokens into groups; where an end falls among the other list's ends tells
which tokens overlap, without comparing tokens. How often two ids overlap is counted over the whole corpus by a shuffle, and every
document is then told how its links stand among those counts.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import byte_letters, fresh, staged, table, texts

VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Code points of texts aligned at once and of the longest word kept; words and token ids kept by a worker. When full it starts again,
#: so memory is bounded (about 300 MB) and results are not touched.
_CHUNK, _KEPT_WORD, _KEPT, _KEPT_IDS = 1 << 20, 64, 800_000, 12_000_000
_BEFORE_BLANK = re.compile(r"\s ")
# Fixed value: where byte-level BPE cuts a text before merging.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Id pairs that may be broadcast, some 100 MB in an executor; more are joined by a shuffle.
_SENT = 2_000_000

LINKS = T.ArrayType(T.StructType([T.StructField("pair", T.LongType()), T.StructField("n", T.LongType())]))
_COLUMNS = [
    T.StructField("n_a", T.LongType()), T.StructField("n_b", T.LongType()), T.StructField("n_groups", T.LongType()),
    T.StructField("n_links", T.LongType()), T.StructField("groups_sha256", T.StringType()), T.StructField("links", LINKS)]


def gallop(keys: np.ndarray, ends: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """For each key, how many of the rising ``ends`` are smaller. Each search starts at its own guess, doubles its step until it has
    passed the key, and then halves it; all searches step together."""
    n = len(ends)
    if not n or not len(keys):
        return np.zeros(len(keys), np.int64)
    at = np.clip(guess, 0, n - 1).astype(np.int64)
    up = ends[at] < keys
    low, high = np.where(up, at, -1), np.where(up, n, at)  # ends[low] < key <= ends[high]
    step, left = 1, np.arange(len(keys))
    while len(left):
        rising = up[left]
        near = np.where(rising, low[left] + step, high[left] - step)
        inside = (near > low[left]) & (near < high[left]) & (near >= 0) & (near < n)
        left, near, rising = left[inside], near[inside], rising[inside]
        smaller = ends[near] < keys[left]
        low[left[smaller]] = near[smaller]
        high[left[~smaller]] = near[~smaller]
        left = left[smaller == rising]  # the others are bracketed
        step *= 2
    left = np.flatnonzero(high - low > 1)
    while len(left):
        middle = (low[left] + high[left]) >> 1
        smaller = ends[middle] < keys[left]
        low[left[smaller]] = middle[smaller]
        high[left[~smaller]] = middle[~smaller]
        left = left[high[left] - low[left] > 1]
    return high


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of every stretch, one stretch after the other."""
    ahead = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - ahead, lengths)


class Words:
    """Token ids by both tokenizers of words after a blank, encoded once while there is room.

    Neither tokenizer has a token across the place between a character that is no white space and a blank, so that texts may be cut
    there: A's rules end a pre-token there, and none of B's pieces holds the mark of a blank behind another character."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_file(a_path)
        self._a.encode_special_tokens = True
        quick = _quick(a_path)
        self._encoded_a = quick or (lambda text: self._a.encode(text, add_special_tokens=False).ids)
        self._b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_letters()
        pieces = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        self.a_bytes = [bytes(letters[c] for c in self._a.id_to_token(i)) if all(c in letters for c in self._a.id_to_token(i) or "\0") else b"" for i in range(self._a.get_vocab_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_length = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_length = np.array([len(x) for x in self.b_bytes], np.int64)
        self.cut = not any(re.search("[^▁]▁", p) for p in pieces)
        n, m = len(self.a_bytes), len(pieces)
        self.spelled = np.array(
            [f"{i}," for i in range(n)] + [f"{i}|" for i in range(n)] + [f"{i}," for i in range(m)] + [f"{i};" for i in range(m)], object)
        self._space = self._b.encode("x")
        self._clear()

    def _clear(self) -> None:
        self._known: dict[str, int] = {}
        self._a_store, self._b_store = _Store(), _Store()

    def _encoded_b(self, word: str) -> list[int]:
        if word.strip(" "):
            return self._b.encode(word)
        return self._b.encode(f"x {word}")[len(self._space) :]  # blanks alone are nothing to B unless something is before them

    def _encoded(self, word: str) -> tuple[list[int], list[int]] | None:
        """Ids of blank + word by both; None where the tokens' bytes are not the word's."""
        a, b = self._encoded_a(f" {word}"), self._encoded_b(word)
        whole = b"".join([self.a_bytes[i] for i in a]) == f" {word}".encode() == b"".join([self.b_bytes[i] for i in b])
        return (a, b) if whole else None

    def _add(self, ids: tuple[list[int], list[int]]) -> int:
        self._b_store.add(np.array(ids[1]), np.array([len(ids[1])]))
        return self._a_store.add(np.array(ids[0]), np.array([len(ids[0])]))

    def _learn(self, words: list[str]) -> None:
        """Keep the ids of words, in one call to each tokenizer: joined by blanks they are a text that may be cut between any two. Where
        the joined bytes do not come back, each word is encoded alone, and one that does not come back gets place -1."""
        known = self._known
        for begin in range(0, len(words), 4096):
            part = words[begin : begin + 4096]
            joined = " ".join(part)
            a, b = self._encoded_a(f" {joined}"), self._b.encode(joined)
            if b"".join([self.a_bytes[i] for i in a]) == f" {joined}".encode() == b"".join([self.b_bytes[i] for i in b]):
                ends = np.cumsum([len(w.encode()) + 1 for w in part])
                a, b = np.array(a), np.array(b)
                stops = [np.searchsorted(x, ends, "left") + 1 for x in (np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b]))]
                first = self._a_store.add(a, np.diff(stops[0], prepend=0))
                self._b_store.add(b, np.diff(stops[1], prepend=0))
                known.update(zip(part, range(first, first + len(part)), strict=True))
                continue
            for word in part:
                known[word] = -1 if (made := self._encoded(word)) is None else self._add(made)

    def of(self, text: str) -> list[str]:
        """The words of a text: what stands between blanks, together with further blanks and other white space before the next one."""
        if not text or not self.cut:
            return [text] if text else []
        parts = text.split(" ")
        if not (text[0] == " " or text[-1].isspace() or _BEFORE_BLANK.search(text)):
            return parts
        out, held = [], []
        for p in parts:
            held.append(p)
            if p and not p[-1].isspace():
                out.append(" ".join(held))
                held = []
        return out + [" ".join(held)] if held else out

    def ids(self, chunk: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Token ids of the texts of a chunk, one behind the other, and their number in each text, by A and by B; none for a text that is
        empty or whose tokens' bytes differ from it."""
        if self._a_store.size > _KEPT_IDS or len(self._known) > _KEPT:
            self._clear()
        cut = [self.of(t) for t in chunk]
        words = [w for part in cut for w in part]
        places = list(map(self._known.get, words))
        missing = [i for i, place in enumerate(places) if place is None] if None in places else []
        if missing:
            new = {words[i] for i in missing}
            lone = [w for w in new if not w or w[-1].isspace()]  # only at the end of a text
            passing = [w for w in new if len(w) > _KEPT_WORD]
            self._learn(list(new.difference(lone)))
            for w in lone:
                self._learn([w])
            for i in missing:
                places[i] = self._known[words[i]]
            for w in {*passing, *lone}:
                del self._known[w]
        at, counts = np.array(places, np.int64), np.array([len(part) for part in cut], np.int64)
        if len(at) and at.min() < 0:  # a word that does not come back: let its text as a whole decide
            text_of = np.repeat(np.arange(len(chunk)), counts)
            wrong = np.unique(text_of[at < 0])
            pieces = np.split(at, np.cumsum(counts)[:-1])
            for k in wrong.tolist():
                whole = self._encoded(chunk[k])
                pieces[k] = np.array([] if whole is None else [self._add(whole)], np.int64)
            at, counts = np.concatenate(pieces), np.array([len(x) for x in pieces], np.int64)
        text_of = np.repeat(np.arange(len(chunk)), counts)
        out = []
        for store in (self._a_store, self._b_store):
            ids, lengths = store.get(at)
            out += [ids, np.bincount(text_of, lengths, len(chunk)).astype(np.int64)]
        return out[0], out[1], out[2], out[3]


class _Store:
    """Lists of ids one behind the other."""

    def __init__(self) -> None:
        self._ids, self._first, self._length = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.size = self.n = 0

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> int:
        """Keep ids as lists of these lengths; the number of the first list."""
        while self.size + len(ids) > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        while self.n + len(lengths) > len(self._first):
            self._first = np.concatenate([self._first, np.zeros_like(self._first)])
            self._length = np.concatenate([self._length, np.zeros_like(self._length)])
        number = self.n
        self._ids[self.size : self.size + len(ids)] = ids
        self._first[number : number + len(lengths)] = self.size + np.cumsum(lengths) - lengths
        self._length[number : number + len(lengths)] = lengths
        self.size, self.n = self.size + len(ids), number + len(lengths)
        return number

    def get(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = self._length[numbers].astype(np.int64)
        return self._ids[_ragged(self._first[numbers], lengths)].astype(np.int64), lengths


def _quick(path: str) -> Callable[[str], list[int]] | None:
    """The same encoder from a file's own merges, where it is plain byte-level BPE whose ids rise with the merges: it takes a tenth of the time.
    None for any other file."""
    with open(path, encoding="utf-8") as lines:
        made = json.load(lines)
    vocab, merges = made["model"].get("vocab"), made["model"].get("merges")
    byte_level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    before = made.get("pre_tokenizer") or {}
    if made.get("normalizer") or made["model"].get("type") != "BPE" or any(before.get(k) != v for k, v in byte_level.items()):
        return None
    if any(made["model"].get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return None
    pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
    letters, special = byte_letters(), {t["content"] for t in made.get("added_tokens", [])}
    plain = {t: i for t, i in vocab.items() if t not in special}
    in_order = [vocab.get(a + b) for a, b in pairs]
    if in_order != list(range(256, 256 + len(pairs))) or set(plain) != {*letters, *(a + b for a, b in pairs)}:
        return None
    import tiktoken

    ranks = {bytes(letters[c] for c in t): i for t, i in plain.items()}
    return tiktoken.Encoding("plain", pat_str=_BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def overlaps(
    own: np.ndarray, other: np.ndarray, own_first: np.ndarray, own_n: np.ndarray, other_first: np.ndarray, other_n: np.ndarray,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the tokens of some texts, named by their first token and their number in both lists of ends, whose ``own`` list is the shorter:
    places in ``own`` of these tokens, first of the other's tokens that each overlaps, and the last one. An end is common where both
    lists have it."""
    places = _ragged(own_first, own_n)
    nth = places - np.repeat(own_first, own_n)
    guess = np.repeat(other_first, own_n) + nth * np.repeat(other_n, own_n) // np.repeat(np.maximum(own_n, 1), own_n)
    last = gallop(own[places], other, guess)
    after = last + (other[last] == own[places]) if len(places) else last
    first = np.empty_like(last)
    first[1:] = after[:-1]
    opening = (np.cumsum(own_n) - own_n)[own_n > 0]
    first[opening] = other_first[own_n > 0]
    return places, first, last


def aligned_chunk(words: Words, chunk: list[str]) -> tuple:
    """n_a, n_b, n_groups, n_links and groups_sha256 of the texts; edges of each text's part of the id pairs and times that follow."""
    a_ids, a_n, b_ids, b_n = words.ids(chunk)
    # Texts of a chunk stand one behind the other; both lists of ends have the end of every text.
    a_ends, b_ends = np.cumsum(words.a_length[a_ids]), np.cumsum(words.b_length[b_ids])
    a_first, b_first = np.cumsum(a_n) - a_n, np.cumsum(b_n) - b_n
    by_a = a_n <= b_n
    pa_, fb, lb = overlaps(a_ends, b_ends, a_first[by_a], a_n[by_a], b_first[by_a], b_n[by_a])
    pb_, fa, la = overlaps(b_ends, a_ends, b_first[~by_a], b_n[~by_a], a_first[~by_a], a_n[~by_a])
    link_a = np.concatenate([np.repeat(pa_, lb - fb + 1), _ragged(fa, la - fa + 1)])
    link_b = np.concatenate([_ragged(fb, lb - fb + 1), np.repeat(pb_, la - fa + 1)])

    # Group ends: own places with a common end, and the other's place of it.
    same_a, same_b = b_ends[lb] == a_ends[pa_], a_ends[la] == b_ends[pb_]
    end_a = np.sort(np.concatenate([pa_[same_a], la[same_b]]))
    end_b = np.sort(np.concatenate([lb[same_a], pb_[same_b]]))
    is_end_a, is_end_b = np.zeros(len(a_ids), bool), np.zeros(len(b_ids), bool)
    is_end_a[end_a], is_end_b[end_b] = True, True
    group_a, group_b = np.cumsum(is_end_a) - is_end_a, np.cumsum(is_end_b) - is_end_b
    before_b = np.concatenate([[0], end_b + 1])  # B's tokens ahead of each group
    n, m = len(words.a_bytes), len(words.b_bytes)
    codes = np.empty(len(a_ids) + len(b_ids), np.int64)
    codes[np.arange(len(a_ids)) + before_b[group_a]] = a_ids + n * is_end_a
    codes[np.arange(len(b_ids)) + end_a[group_b] + 1 if len(b_ids) else np.zeros(0, np.int64)] = 2 * n + b_ids + m * is_end_b
    spelled = words.spelled[codes].tolist()

    text_of_a = np.repeat(np.arange(len(chunk)), a_n)
    n_groups = np.bincount(text_of_a[end_a], minlength=len(chunk))
    n_links = np.bincount(text_of_a[link_a], minlength=len(chunk))
    key = (text_of_a[link_a] * n + a_ids[link_a]) * m + b_ids[link_b]
    found, times = np.unique(key, return_counts=True)
    edges = np.searchsorted(found, np.arange(len(chunk) + 1) * n * m)
    stops = np.concatenate([[0], np.cumsum(a_n + b_n)]).tolist()
    digests = [
        hashlib.sha256("".join(spelled[s:e])[:-1].encode()).hexdigest() if e > s else "" for s, e in zip(stops, stops[1:], strict=False)]
    return a_n, b_n, n_groups, n_links, digests, edges, found % (n * m), times


_WORDS: dict[tuple[str, str], Words] = {}


def aligned(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """``docs`` with, in place of any columns of these names: how many tokens each tokenizer gives a text (blank + text by A, text by B,
    which adds the blank itself), groups between common ends, links (pairs of overlapping tokens), the SHA-256 of the groups spelled out,
    and ``links``: each id pair (a * size of B + b) with its number of links.

    A null or empty text, or one whose tokens' bytes are not blank + text, has no tokens: zeros, '' and no pairs. Repeated rows get
    equal values. A long text is aligned whole, in memory in proportion to it."""
    names = docs.columns
    added = {f.name for f in _COLUMNS}
    kept = [f for f in docs.schema.fields if f.name not in added]
    schema = T.StructType([*kept, *_COLUMNS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (a_path, b_path) not in _WORDS:
            _WORDS[a_path, b_path] = Words(a_path, b_path)
        words = _WORDS[a_path, b_path]
        for batch in batches:
            first, chunk, held = 0, [], 0
            for i, value in texts(batch, text):
                chunk.append(value)
                held += len(value)
                if held >= _CHUNK or i == batch.num_rows - 1:
                    a_n, b_n, groups, links, digests, edges, pairs, times = aligned_chunk(words, chunk)
                    part = batch.slice(first, len(chunk))
                    counted = pa.StructArray.from_arrays([pa.array(pairs, pa.int64()), pa.array(times, pa.int64())], names=["pair", "n"])
                    made = [pa.array(x, pa.int64()) for x in (a_n, b_n, groups, links)]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(names.index(f.name)) for f in kept] + made
                        + [pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), counted)],
                        names=schema.names)
                    first, chunk, held = i + 1, [], 0

    return docs.mapInArrow(run, schema)


def pair_counts(links: DataFrame, b_size: int) -> DataFrame:
    """(pair, count, best) of exploded links (pair, n): how many links hold an id pair, and whether none of its B id has more. A B id has at
    most as many pairs as A has ids, which bounds the window; counts are combined before they are dealt out."""
    counts = links.groupBy("pair").agg(F.sum("n").alias("count"))
    same = Window.partitionBy(F.col("pair") % b_size)
    return counts.select("pair", "count", (F.col("count") == F.max("count").over(same)).alias("best"))


def scored(docs: DataFrame, b_size: int, links: str = "links") -> DataFrame:
    """``docs`` (see ``aligned``) with ``n_best`` (links whose pair is one of its B id's most frequent) and ``count_sum`` (of its links' counts),
    in place of columns of these names, without ``links``. The rows are written once, numbered. Counts are broadcast if there are few
    pairs, and joined by a shuffle otherwise, where adaptive execution may split a frequent pair."""
    row = fresh("row", docs.columns)
    kept = staged(docs.drop("n_best", "count_sum").withColumn(row, F.monotonically_increasing_id()), "aligned")
    linked = kept.select(row, F.inline(links))
    counts = staged(pair_counts(linked, b_size), "pairs")
    if counts.count() <= _SENT:
        counts = F.broadcast(counts)
    sums = (
        linked.join(counts, "pair").groupBy(row)
        .agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum")))
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    return kept.drop(links).join(sums, row, "left").select(*[c for c in docs.columns if c not in (links, "n_best", "count_sum")], zero("n_best"), zero("count_sum"))


def op13_galloping_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens by the byte-level vocabulary aligned with those by the piece vocabulary."""
    import public_tokenizers
    import sentencepiece

    a_path, b_path = public_tokenizers.path(VOCABULARY_A), public_tokenizers.path(VOCABULARY_B)
    b_size = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scored(aligned(docs, a_path, b_path).drop("text"), b_size).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
