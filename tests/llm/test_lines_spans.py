"""Line dedup where lines are dealt to spans of lengths, and many pairs compared at a time."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import lines


def edited(draw, line, n, letters):
    for _ in range(n):
        i, kind = draw.randrange(len(line)), draw.randrange(3)
        line = line[:i] + (draw.choice(letters) if kind else "") + line[i + (kind < 2) :]
    return line


def test_a_line_is_worked_on_in_few_spans_however_many_there_are(documents, monkeypatch):
    draw = random.Random(11)
    found = ["".join(draw.choice("abcdefgh ") for _ in range(int(20 * 1.05 ** draw.randrange(80)))) for _ in range(200)]
    counts = {}
    for x in found:
        quarter = int(np.searchsorted(lines._QUARTERS, len(x), "right")) - 1
        counts[quarter] = counts.get(quarter, 0) + lines.layout(int(lines.classes_of(np.array([len(x)]))[0][0]))[0] + 1
    monkeypatch.setattr(lines, "_MOST_BITS", lines._PART_BITS)
    monkeypatch.setattr(lines, "_BITS_EACH", 200)
    spans = lines._spans(counts)
    assert len(spans) > 8 and spans[-1][1] > 1 << 31
    assert all(a[1] == b[0] and a[0] < a[1] for a, b in zip(spans, spans[1:], strict=False))
    rows = lines._distinct(documents(list(enumerate(found)) + [(999, found[0])]), spans, []).collect()
    for row in rows:
        low, high, _ = spans[row["span"]]
        fewest = row["chars"] - max(lines.EDITS, row["chars"] * lines.PERCENT // 100)
        assert row["entered"] == (low <= row["chars"] < high) and low <= row["chars"] and max(fewest, lines.LEAST_CHARS) < high
    assert sorted(r["line"] for r in rows if r["entered"]) == sorted(set(found)) and len(rows) < 2 * len(found)


def test_classes_share_a_filter_without_overlap():
    counts = {0: 1, 3: 700, 4: 7000, 5: 6999, 9: 80000, 12: 3}
    parts = sorted((prefix / 2 ** bits, 2.0 ** -bits, kind) for kind, (prefix, bits) in lines._regions(counts).items())
    assert {kind for *_, kind in parts} == set(counts) and parts[-1][0] + parts[-1][1] <= 1
    assert all(a[0] + a[1] <= b[0] for a, b in zip(parts, parts[1:], strict=False))
    assert all(size >= counts[kind] / sum(counts.values()) / 2 for _, size, kind in parts) and lines._regions({7: 5}) == {7: (0, 0)}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 1 << 32), st.sampled_from(["ab", "abcdefgh", "abcdefghi é€😀"]))
def test_many_pairs_are_compared_as_one_by_one(seed, alphabet):
    x, y, draw = [], [], random.Random(seed)
    for _ in range(12):
        n = draw.choice((20, 33, 60, 119, 120, 159, 160, 300, 319, 320, 639, 640, 1279, 1280, 1500))
        a, k = "".join(draw.choice(alphabet) for _ in range(n)), lines.edits(n)
        b = edited(draw, a, draw.choice((0, 1, k - 1, k, k, k + 1, 2 * k)), alphabet)
        if draw.random() < 0.3:  # moved as a whole
            m = draw.randrange(k + 2)
            b = "".join(draw.choice(alphabet) for _ in range(m)) + a[: n - draw.randrange(m + 1)]
        x.append(a)
        y.append(b)
    pairs = list(zip(x, y, strict=True))
    assert lines.all_within(x, y).tolist() == [lines.within(a, b, lines.edits(min(len(a), len(b)))) for a, b in pairs]
    assert lines.all_within([], []).tolist() == []


def test_only_repeated_lines_are_shuffled_and_each_is_there_once(documents, monkeypatch):
    labels, real = {}, lines.staged

    def staged(df, label, codec=None):
        labels[label] = made = real(df, label, codec)
        return made

    monkeypatch.setattr(lines, "staged", staged)
    found = [f"line number {i} of its own, {i * 7919} and {i * 104729}" for i in range(40)]
    rows = [(i, f"{x}\na line that all of the documents have") for i, x in enumerate(found)] + [(100 + i, x) for i, x in enumerate(found[:3])]
    docs = documents(rows).repartition(8)
    marks = lines._marks(docs)
    classes = marks.groupBy("h1").count().withColumnRenamed("count", "n")
    got = lines._distinct(docs, lines._spans({0: 300}), [], classes).collect()
    assert sorted(r["line"] for r in got) == sorted([*found, "a line that all of the documents have"])
    shuffled = {r["line"] for r in labels["dealt"].where("repeated").collect()}
    assert {*found[:3], "a line that all of the documents have"} <= shuffled and len(shuffled) < 10


def test_own_segments_that_no_other_line_has_are_not_asked_for():
    line = "".join(chr(97 + i * i % 23) + chr(97 + i * 7 % 26) for i in range(600))
    cut = next(c for _, c, _ in lines._in_classes({2: line}, False))
    own = set(cut._any(cut._hash(cut.begins[0] + np.arange(cut.most + 1) * cut.width)).tolist())
    held = lambda keys: np.flatnonzero([k in own or k >> 63 for k in keys.tolist()])  # noqa: E731  own places, then any number
    every, none = (lambda keys: np.arange(len(keys))), (lambda keys: np.zeros(0, int))
    assert len(cut.substrings(True, held, every)[1]) > 0 and len(cut.substrings(True, held, none)[1]) == 0
