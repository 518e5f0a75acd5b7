"""Context trees against a direct recursion, and the base against plain counts."""

import math
import re
import zlib
from collections import Counter

from siltstone.llm import ctw


class Node:
    def __init__(self):
        self.n, self.longer = [0, 0], {}

    def kt(self):
        a, b = self.n
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)

    def weighted(self, depth):
        if depth == ctw.DEPTH:
            return self.kt()
        a, b = self.kt(), sum(x.weighted(depth + 1) for x in self.longer.values())
        return math.log(0.5) + max(a, b) + math.log1p(math.exp(-abs(a - b)))

    def chance(self, context, bit, depth):
        own = (self.n[bit] + 0.5) / (sum(self.n) + 1)
        if depth == ctw.DEPTH:
            return own
        ratio = math.exp(min(max(self.kt() - sum(x.weighted(depth + 1) for x in self.longer.values()), -700), 700))
        return (ratio * own + self.longer.get(context[-1 - depth], Node()).chance(context, bit, depth + 1)) / (ratio + 1)


def walk(raw):
    raw = b"\n" * ctw.DEPTH + raw
    for i in range(ctw.DEPTH, len(raw)):
        node = 1
        for k in range(7, -1, -1):
            yield raw[i - ctw.DEPTH : i], node, raw[i] >> k & 1
            node = 2 * node + (raw[i] >> k & 1)


def test_scores_as_by_recursion(documents):
    rows = [(1, "The cat sat"), (2, "the CAT ran\tup"), (3, "dogs"), (4, None), (5, ""), (6, "the cat"), (7, "zebra é"), (1, "The cat sat"), (None, "cat")]
    df = documents(rows)
    got = ctw.scored(df, df["doc_id"].isNull() | (df["doc_id"] > 5)).collect()
    trees, words, n_train = {}, Counter(), 0
    for doc, text in rows:
        if doc is None or doc > 5:
            continue
        for context, node, bit in walk(ctw.body(text or "")):
            at = trees.setdefault(node, Node())
            at.n[bit] += 1
            for d in range(ctw.DEPTH):
                at = at.longer.setdefault(context[-1 - d], Node())
                at.n[bit] += 1
        tokens = [*(text or "").lower().split(), "\n"]
        words.update(tokens)
        n_train += len(tokens)
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for doc, text in rows:
        r, tokens = by[doc], [*(text or "").lower().split(), "\n"]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(words[t] > 0 for t in tokens), n_train)
        wanted = sum(math.log10((words[t] + 0.1) / (n_train + 0.1 * (len(words) + 1))) for t in tokens)
        assert abs(r["base_score"] - wanted) < 1e-9
        score = sum(math.log10(trees.get(node, Node()).chance(context, bit, 0)) for context, node, bit in walk(ctw.body(text or "")))
        assert abs(r["score"] - score) < 1e-8


def test_chances_of_all_bytes_add_up(documents):
    texts = [f"ab{chr(c)}" for c in range(33, 127)]
    rows = [(1, "abc abd abe abc")] + [(10 + i, t) for i, t in enumerate(texts)]
    df = documents(rows)
    got = {r["doc_id"]: r["score"] for r in ctw.scored(df, df["doc_id"] > 1).collect()}
    assert all(s < 0 for s in got.values()) and sum(10 ** got[10 + i] for i in range(len(texts))) < 1


def test_held_out_and_empty(spark, small, documents):
    got = ctw.op8_context_trees(spark, small).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0) for r in got)
    assert all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)
    word = re.compile(r"[^\x20\x09-\x0D]+")
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert all(r["n_tokens"] == len(word.findall(texts[r["doc_id"]])) + 1 for r in got)
    empty = documents([])
    assert ctw.scored(empty, empty["doc_id"] > 1).count() == 0


def test_the_fifth_byte_of_context_tells(documents):
    rows = [(1, "1bcdex " * 50), (2, "2bcdey " * 50), (11, "1bcdex"), (12, "1bcdey")]
    df = documents(rows)
    got = {r["doc_id"]: r["score"] for r in ctw.scored(df, df["doc_id"] > 10).collect()}
    assert got[11] > got[12] + 1


def test_blocks_with_values_of_their_own_change_nothing(spark, small, prose, monkeypatch, documents):
    """Texts in many blocks, each given its values by a shuffle, score as with all values at hand; bits per byte are the score over the bytes."""
    df = documents([r[:2] for r in prose[:80]] + [(5001, "z" * 30_000 + " " + "é日本 " * 3000), (5002, "q")])
    df = df.withColumn("key", df["lang"]).withColumn("run", df["lang"]).withColumn("block", df["lang"])
    held_out = df["doc_id"] % 4 == 0
    want = {r.doc_id: (r.score, r.base_score, r.n_known) for r in ctw.scored(df, held_out).collect()}
    monkeypatch.setattr(ctw, "_RUNS", 500)
    monkeypatch.setattr(ctw, "_SENT", 0)
    monkeypatch.setattr(ctw, "BLOCK_BYTES", 20_000)
    got = ctw.scored(df, held_out).collect()
    texts = {r.doc_id: r.text for r in df.collect()}
    assert len(got) == len(want)
    for r in got:
        assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for a, b in zip((r.score, r.base_score, r.n_known), want[r.doc_id]))
        assert math.isclose(r.bits_per_byte, -r.score * math.log2(10) / len(ctw.body(texts[r.doc_id])))


def test_subtrees_in_parts_equal_subtrees_at_once(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    run = np.unique(rng.integers(97, 101, (4000, ctw.DEPTH + 1)) @ (256 ** np.arange(ctw.DEPTH, -1, -1)))
    mid, n = (run >> 8) & ctw._MID, rng.integers(0, 5, len(run))
    order = np.argsort(mid, kind="stable")
    rows = pa.table({"mid": mid[order], "run": run[order], "n": n[order]})

    def roots(size, per_batch):
        monkeypatch.setattr(ctw, "_RUNS", size)
        made = pa.Table.from_batches(ctw._roots(iter(rows.to_batches(per_batch)))).to_pylist()
        return sorted((r["context"], r["node"], r["zeros"], r["ones"], round(r["weighted"], 9)) for r in made)

    whole = roots(10**9, 10**9)
    assert len(whole) == len({r[:2] for r in whole}) and roots(100, 37) == whole
    for context, node, zeros, ones, _ in whole[::50]:
        depth = node.bit_length() - 1
        own = [(r & 255, k) for r, m, k in zip(run, mid, n) if m == context and ((r & 255) | 256) >> (8 - depth) == node]
        assert (zeros, ones) == tuple(sum(k for b, k in own if b >> (7 - depth) & 1 == bit) for bit in (0, 1))
