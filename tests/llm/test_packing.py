"""Packing against the vocabulary itself and the least number of bins."""

import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import packing


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plans_use_each_length_as_often_as_it_occurs(lengths):
    plan = packing.plan(Counter(lengths), 40)
    used = Counter()
    for bin_, copies in plan:
        assert sum(bin_) <= 40 and copies > 0
        for x in bin_:
            used[x] += copies
    assert used == Counter(lengths)
    best = -(-sum(lengths) // 40)
    assert sum(c for _, c in plan) <= best * 1.7 + 1


def test_two_fit_replaces_the_smallest():
    assert packing.plan({6: 1, 3: 1, 2: 2, 5: 0}, 10) == [([6, 2, 2], 1), ([3], 1)]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.vocabulary())


def test_words_give_the_ids_of_whole_texts(tokenizer, prose):
    ids = packing.word_ids(packing.vocabulary())
    odd = ["", " \n", "It's a'sb 'S 3.14, é. É! x...y?!", "<|endoftext|> a", "é, İI ΣΑΣ ﬁ ½　。", ".", "a .b ,", "!?x"]
    for text in [t or "" for _, t, *_ in prose] + odd:
        assert ids(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_places(documents, tokenizer):
    rows = [(1, "word " * 9000), (2, None), (3, ""), (None, "a b"), *((i, "x y z " * (i % 700)) for i in range(4, 300)), (4, "again"), (4, "again")]
    got = packing.pack(documents(rows), packing.vocabulary()).collect()
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(bins) <= -(-sum(r["length"] for r in got) // 4096) + 1
    wanted = Counter()
    for doc, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        for n, at in enumerate(range(0, len(ids), 4096)):
            wanted[doc, n, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == wanted
    assert packing.pack(documents([]), packing.vocabulary()).count() == 0


def test_merges_of_the_file_give_the_tokenizers_ids(tmp_path):
    import json
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.VOCABULARY)
    merge, tokenizer, rng = packing._merges(path), Tokenizer.from_file(path), random.Random(1)
    for _ in range(1500):
        word = "".join(rng.choice("aAbethingßÿÄéÈzÞþð") for _ in range(rng.randrange(1, 120)))
        assert packing._PLAIN.fullmatch(word) and merge(word.lower().encode() + packing._WORD_END) == tokenizer.encode(word, add_special_tokens=False).ids
    made = json.loads(open(path, encoding="utf-8").read())
    made["model"]["merges"] = made["model"]["merges"][::-1]
    (tmp_path / "other.json").write_text(json.dumps(made))
    assert packing._merges(str(tmp_path / "other.json")) is None


def test_long_words_and_clashing_names(documents):
    rows = [(1, "x" * 40_000), (2, "Word, " * 20_000), (2, None), (None, "É́ K ﬁ")]
    docs = documents(rows).selectExpr("*", "1 AS piece", "2 AS start", "3 AS length", "4 AS sequence_id")
    packed = packing.pack(docs, packing.vocabulary()).collect()
    assert {r["doc_id"] for r in packed} == {1, 2, None} and max(r["length"] for r in packed) == packing.CAPACITY
    of_sequence = {}
    for r in packed:
        of_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sorted(x)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(x), sorted(x)[1:])) for x in of_sequence.values())


class Counting:
    """A tokenizer that notes the words it is asked for."""

    def __init__(self, real):
        self.real, self.asked = real, []

    def encode(self, text, is_pretokenized=False, add_special_tokens=True):
        self.asked += text if is_pretokenized else []
        return self.real.encode(text, is_pretokenized=is_pretokenized, add_special_tokens=add_special_tokens)

    def __getattr__(self, name):
        return getattr(self.real, name)


def test_signs_behind_words_and_words_met_first_cost_no_more_encoding(tokenizer, monkeypatch):
    import tokenizers

    made = Counting(tokenizer)
    monkeypatch.setattr(tokenizers.Tokenizer, "from_file", lambda path: made)
    ids = packing.word_ids(packing.vocabulary())
    plain = lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    for text in ("raesco$$$ heit*** osó, ÑciÉ.%%% a'' it's' x.'s $$$ 'll, b_ c-' ΣΑΣ. é! é̸= d≠ 9's' ...'t", "a$ b% $"):
        assert ids(text) == plain(text)
    assert not {"raesco$$$", "heit***", "osó,", "ÑciÉ.%%%", "a$"} & set(made.asked)
    monkeypatch.setattr(packing, "_KEPT_WORDS", 40)
    ids = packing.word_ids(packing.vocabulary())
    ids("1-a 1-b 1-c 1-d")
    made.asked.clear()
    for i in range(30):
        text = f"1-a 1-b 2-{i} 3-{i} 4-{i} 5-{i}"
        assert ids(text) == plain(text)
    assert not {"1-a", "1-b"} & set(made.asked) and len(made.asked) == 120
