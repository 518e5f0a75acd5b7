"""Counts after edits against counting the whole text again."""

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import recount

PATH = public_tokenizers.path(recount.VOCABULARY)


@pytest.fixture(scope="module")
def counter():
    return recount.Counter(PATH, public_tokenizers.PATTERN)


PIECES = st.lists(st.sampled_from(["a", "b", " ", "  ", "'", "re", "s", "12", "!", "\n", "é", "Word", "'ve", "...", "\t"]), max_size=600).map("".join)


@settings(max_examples=150, deadline=None)
@given(text=PIECES, places=st.lists(st.tuples(st.floats(0, 1), st.integers(0, 40), PIECES), max_size=4))
def test_any_edits(counter, text, places):
    tree = recount.Tree.grown(text, counter)
    assert tree.total == len(counter._encoding.encode_ordinary(text))
    edits = [(int(at * len(text)), min(len(text), int(at * len(text)) + n), new) for at, n, new in places]
    new, tree, _ = recount.edited(text, tree, edits, counter)
    assert tree.total == len(counter._encoding.encode_ordinary(new)) and tree.sums[1, 0] == len(new)


def test_little_is_encoded_again(counter):
    text = "some plain words in a row " * 5000
    new, tree, encoded = recount.edited(text, recount.Tree.grown(text, counter), [(60000, 60004, "other")], counter)
    assert encoded <= 4 * recount.LEAF and tree.total == len(counter._encoding.encode_ordinary(new))


def test_bad_edits_are_left_out(counter):
    text = "one two three"
    new, _, _ = recount.edited(text, recount.Tree.grown(text, counter), [(0, 3, "1"), (0, 3, "1"), (2, 5, "x"), (9, 99, "y"), (5, 4, "z")], counter)
    assert new == "1 two three"


def test_tables(spark, documents, counter):
    docs = documents([(1, "call 012-345-678-90 now"), (2, None), (3, ""), (1, "call 012-345-678-90 now")]).selectExpr("*", "1 AS tokens_before", "2 AS edits")
    grown = recount.counted(docs, PATH, public_tokenizers.PATTERN)
    done = {r["doc_id"]: r for r in recount.recounted(recount.masking(grown), PATH, public_tokenizers.PATTERN).collect()}
    assert done[1]["text"] == "call <private> now" and done[2]["text"] is None and done[3]["tokens_after"] == 0
    assert done[1]["tokens_after"] == len(counter._encoding.encode_ordinary("call <private> now"))
    edits = spark.createDataFrame([(1, 0, 4, "ring"), (1, 0, 4, "ring"), (9, 0, 1, "")], "doc_id long, start long, stop long, new string")
    done = recount.recounted(recount.with_edits(grown, edits), PATH, public_tokenizers.PATTERN)
    assert sorted(str(r["text"]) for r in done.collect()) == ["", "None", "ring 012-345-678-90 now", "ring 012-345-678-90 now"]
    assert recount.counted(documents([]), PATH, public_tokenizers.PATTERN).count() == 0


def test_driver_documents(spark, small, prose, counter):
    got = {r["doc_id"]: r for r in recount.op10_edit_counts(spark, small).collect()}
    for doc, text, *_ in prose:
        assert got[doc]["tokens_before"] == len(counter._encoding.encode_ordinary(text or ""))
        masked = recount.regex.sub(recount.PRIVATE, recount.MASK, text or "")
        assert got[doc]["tokens_after"] == len(counter._encoding.encode_ordinary(masked))
