"""Line dedup where the edits allowed follow the line's length."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from test_lines import edit_distance

from siltstone.llm import lines

def edited(draw, line, n, letters="xyz"):
    for _ in range(n):
        i, kind = draw.randrange(len(line)), draw.randrange(3)
        line = line[:i] + (draw.choice(letters) if kind else "") + line[i + (kind < 2) :]
    return line


def entered(line, lower):
    """Keys that a line is entered under, and those that it asks for."""
    told, asked, every = set(), set(), lambda keys: np.arange(len(keys))
    for _, cut, own in lines._in_classes({2: line}, lower):
        if own:
            told |= set(cut.segments()[1].tolist())
        asked |= set(cut.substrings(own, every)[1].tolist())
    return told, asked


@settings(max_examples=300, deadline=None)
@given(st.integers(20, 400), st.sampled_from(["a", "ab", "abcdefgh", "abcdefghijklmnopqrstuvwxyz "]), st.randoms(use_true_random=False))
def test_lines_within_the_edits_share_a_segment(length, alphabet, draw):
    a = "".join(draw.choice(alphabet) for _ in range(length))
    b = edited(draw, a, draw.randrange(lines.edits(length) + 1), alphabet + "x")
    a, b = sorted((a, b), key=len)
    if len(a) < lines.LEAST_CHARS or edit_distance(a, b) > lines.edits(len(a)):
        return
    told, _ = entered(a, False)
    own, asked = entered(b, True)
    assert told & (own | asked)


def test_a_line_asks_for_each_segment_at_no_more_places_than_it_may_be_moved():
    cut = next(c for _, c, _ in lines._in_classes({2: "".join(chr(97 + i * i % 23) for i in range(300))}, False))
    assert len(cut.substrings(True, lambda keys: np.arange(len(keys)))[1]) <= (cut.most + 1) ** 2
    assert len(cut.substrings(True, lambda keys: np.zeros(0, int))[1]) == 0
    assert len(cut.segments()[0]) == cut.most + 1 and (cut.most + 1) * cut.width <= 300
    assert all(lines.layout(kind)[1] > 0 and lines.layout(kind)[0] >= lines.edits(lines._CLASSES[kind + 1] - 1) for kind in range(40))


def test_the_filter_forgets_nothing(spark, monkeypatch):
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    bits = lines.Filter.for_keys(len(keys))
    batches = [lines.Filter.noted([keys[:2000], keys[:10]], bits), lines.Filter.noted([keys[1900:]], bits), lines.Filter.noted([], bits)]
    noted = spark.createDataFrame([r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))], "part long, places binary")
    made = lines.Filter.of(noted, bits)
    assert len(lines.Filter.among(made.once, bits, keys)) == 3000
    again = np.concatenate([keys[:10], keys[1900:2000]])
    assert len(lines.Filter.among(made.twice, bits, again)) == 110
    others = rng.integers(0, 1 << 63, 20000).astype(np.uint64)
    assert len(lines.Filter.among(made.once, bits, others)) < 2000 and len(lines.Filter.among(made.twice, bits, keys)) < 400


def expected(found):
    """Component of each line by brute force, as its first line."""
    of = list(range(len(found)))
    for i, a in enumerate(found):
        for j, b in enumerate(found[:i]):
            least = min(len(a), len(b))
            if a == b or least >= 20 and abs(len(a) - len(b)) <= max(2, least // 20) and edit_distance(a, b) <= max(2, least // 20):
                x, y = sorted((of[i], of[j]))
                of = [x if k == y else k for k in of]
    return of


def test_long_near_copies_go(documents):
    draw, found = random.Random(3), []
    words = ["".join(draw.choice("abcdefghiklmnoprstu") for _ in range(draw.randrange(2, 8))) for _ in range(60)]
    passage = " ".join(draw.choice(words) for _ in range(12))
    for length in (30, 57, 59, 60, 61, 63, 79, 80, 125, 200, 300):
        for k in range(2):
            base = (passage + " " if k else "") + " ".join(draw.choice(words) for _ in range(length))
            base = base[:length]
            allowed = max(2, length // 20)
            found += [base, *(edited(draw, base, n) for n in (1, allowed, allowed, allowed + 1, 2 * allowed + 2))]
    draw.shuffle(found)
    of = expected(found)
    assert sum(of[i] != i for i in range(len(of))) > 40
    got = {r["doc_id"]: r["text"] for r in lines.cleaned(documents(list(enumerate(found)))).collect()}
    assert {i for i, text in got.items() if text} == {i for i in range(len(found)) if of[i] == i}


def test_slices_of_keys_change_nothing(documents, monkeypatch):
    draw = random.Random(7)
    found = ["".join(draw.choice("abcdefgh ") for _ in range(draw.choice((24, 50, 90, 130)))) for _ in range(30)]
    found += [edited(draw, x, draw.choice((1, 2, lines.edits(len(x))))) for x in found]
    docs = documents(list(enumerate(found)))
    whole = sorted(map(tuple, lines._shared(docs, 600).distinct().collect()))
    monkeypatch.setattr(lines, "_MOST_BITS", lines._PART_BITS)
    monkeypatch.setattr(lines, "_BITS_EACH", 200)
    assert -(-1200 * lines._BITS_EACH >> lines._MOST_BITS) > 2
    parts = sorted(map(tuple, lines._shared(docs, 600).distinct().collect()))

    def met(rows):
        by_key = {}
        for key, line, told in rows:
            by_key.setdefault(key, set()).add((line, told))
        return {k: v for k, v in by_key.items() if len({x for x, _ in v}) > 1 and any(told for _, told in v)}

    assert met(whole) == met(parts) and len(met(whole)) > 20
    of = expected(found)
    got = {r["doc_id"]: r["text"] for r in lines.cleaned(docs).collect()}
    assert {i for i, text in got.items() if text} == {i for i in range(len(found)) if of[i] == i}


def test_a_hot_group_meets_in_blocks(documents, monkeypatch):
    monkeypatch.setattr(lines, "_BLOCK", 4)
    draw = random.Random(5)
    found = ["a hot beginning, " + "".join(draw.choice("abcdefgh") for _ in range(27)) for _ in range(25)]
    found += [edited(draw, x, 2) for x in found[:15]]
    of = expected(found)
    got = {r["doc_id"]: r["text"] for r in lines.cleaned(documents(list(enumerate(found)))).collect()}
    assert {i for i, text in got.items() if text} == {i for i in range(len(found)) if of[i] == i} and len(set(of)) == 25
