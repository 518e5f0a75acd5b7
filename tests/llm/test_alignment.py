"""Alignment of two tokenizers against comparing all tokens' byte ranges."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import alignment as A

public_tokenizers = pytest.importorskip("public_tokenizers")
PATHS = public_tokenizers.path(A.VOCABULARY_A), public_tokenizers.path(A.VOCABULARY_B)
ODD = ["a", "the", " ", "  ", "\n", "\t", "é", "日本", "😀", "1", "23", "'s", "<|endoftext|>", "</s>", "▁", " ", "　", "\x1c", "\x00", ".", "--", "foo", "́", "\r\n", "İ", "_"]


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    letters = A.byte_letters()
    return (
        lambda t: [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + t, add_special_tokens=False).ids],
        lambda t: [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(t)])


def spans(tokens):
    out, at = [], 0
    for i, raw in tokens:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def plain(tools, text):
    """(n_a, n_b, n_groups, n_links, digest, links) by comparing every two tokens."""
    a, b = (f(text) if text else [] for f in tools)
    if not text or any(b"".join(raw for _, raw in x) != f" {text}".encode() for x in (a, b)):
        return 0, 0, 0, 0, "", Counter()
    a, b = spans(a), spans(b)
    links = Counter((x, y) for x, s, e in a for y, u, v in b if s < v and u < e)
    groups, before = [], 0
    for end in sorted({e for *_, e in a} & {e for *_, e in b}):
        part = [",".join(str(i) for i, s, e in x if before < e <= end) for x in (a, b)]
        groups.append("|".join(part))
        before = end
    return len(a), len(b), len(groups), sum(links.values()), hashlib.sha256(";".join(groups).encode()).hexdigest(), links


def odd_texts(n):
    rng = random.Random(n)
    return ["".join(rng.choice(ODD) for _ in range(rng.randrange(25))) for _ in range(n)] + ["", " ", "  ", "a ", "a  ", " a", "x" * 500, "日本" * 80, " " * 300, None]


def test_chunks_align_as_all_pairs(tools, prose):
    words = A.Words(*PATHS)
    texts = [t or "" for t in odd_texts(1200)] + [t[:400] for _, t, *_ in prose[:40]]
    size = len(words.b_bytes)
    for begin in range(0, len(texts), 83):
        chunk = texts[begin : begin + 83]
        a_n, b_n, groups, links, digests, edges, pairs, times = A.aligned_chunk(words, chunk)
        for i, text in enumerate(chunk):
            own = Counter({(int(p) // size, int(p) % size): int(n) for p, n in zip(pairs[edges[i] : edges[i + 1]], times[edges[i] : edges[i + 1]])})
            assert (a_n[i], b_n[i], groups[i], links[i], digests[i], own) == plain(tools, text), repr(text)


def test_kept_words_change_nothing(tools, monkeypatch):
    texts = [t or "" for t in odd_texts(300)]
    want = [plain(tools, t)[:5] for t in texts]
    for name, value in (("_KEPT", 5), ("_KEPT_WORD", 2)):
        monkeypatch.setattr(A, name, value)
        words = A.Words(*PATHS)
        found = [A.aligned_chunk(words, texts[i : i + 7])[:5] for i in range(0, len(texts), 7)]
        assert [tuple(x) for part in found for x in zip(*part)] == want
    words.cut = False
    assert [tuple(x) for x in zip(*A.aligned_chunk(words, texts)[:5])] == want


def test_galloping_counts_smaller_ends():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 5, 200):
        ends = np.cumsum(rng.integers(1, 5, n))
        keys = np.sort(rng.integers(0, 600, 50))
        for guess in (np.zeros(50, int), rng.integers(-5, 300, 50), np.full(50, n)):
            assert (A.gallop(keys, ends, guess) == np.searchsorted(ends, keys)).all()


def by_hand(tools, rows):
    found = [plain(tools, t) for _, t in rows]
    count = Counter()
    for *_, links in found:
        count.update(links)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return sorted(
        (str(d), *x[:4], sum(n for (a, b), n in x[5].items() if count[a, b] == best[b]), sum(n * count[p] for p, n in x[5].items()), x[4])
        for (d, _), x in zip(rows, found))


@pytest.mark.parametrize("sent", [A._SENT, 0])
def test_counts_over_the_corpus(spark, documents, tools, prose, monkeypatch, sent):
    monkeypatch.setattr(A, "_SENT", sent)
    rows = [(d, t[:600]) for d, t, *_ in prose[:60]] + list(enumerate(odd_texts(60), 10_000))
    rows += [rows[0], rows[0], (None, rows[1][1]), (5, None), (6, "word " * 3000)]
    df = documents(rows)
    for name in ("n_a", "links", "row", "pair", "n", "count"):
        df = df.withColumn(name, df["lang"])
    out = A.scored(A.aligned(df, *PATHS), 32000)
    assert {"row", "pair", "n", "count", "text"} <= set(out.columns) and "links" not in out.columns
    got = sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in out.collect())
    assert got == by_hand(tools, rows)


def test_query_over_whole_documents(spark, small, tools, prose):
    got = {r.doc_id: tuple(r)[1:] for r in A.op13_galloping_alignment(spark, small).collect()}
    assert len(got) == len(prose)
    links = spark.createDataFrame([(d, sum(x[5].values()), x[4]) for d, t, *_ in prose[:30] for x in [plain(tools, t)]], "d long, n long, sha string")
    assert {r.d: (r.n, r.sha) for r in links.collect()} == {d: (got[d][3], got[d][6]) for d, *_ in prose[:30]}


def test_empty_table(spark, documents):
    assert A.scored(A.aligned(documents([]), *PATHS), 32000).agg(F.count("*")).first()[0] == 0
