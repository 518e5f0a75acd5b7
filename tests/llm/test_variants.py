"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from siltstone.llm import variants as V


def plain_words(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(words):
    """{word: (form, root, n, n_near, form_n)} from all pairs."""
    near = {w: [x for x in words if x != w and abs(len(x) - len(w)) < 2 and one_apart(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


def got(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def dealt(seed, n=400):
    """Words that crowd together: few letters, edits of a few stems, and halves that many share."""
    rng = random.Random(seed)
    stems = ["aaaaaaaa", "abcabcabc", "élèvement", "straßenbahn"] + ["".join(rng.choice("abé") for _ in range(rng.randrange(7, 14))) for _ in range(20)]
    words = {}
    while len(words) < n:
        w = list(rng.choice(stems))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(w) + 1)
            kind = rng.randrange(3)
            w[at : at + (kind > 0)] = [rng.choice("abcéÿ")] if kind < 2 else []
        if len(w) >= 7:
            words["".join(w)] = rng.choice([2, 3, 20, 30, 300])
    return words


@pytest.mark.parametrize("block", [4096, 7])
def test_pairs_forms_and_roots_as_from_all_pairs(spark, block):
    words = dealt(block)
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    assert got(V.variants(df, block=block)) == plain(words)


def test_chains_of_forms_end_at_their_root(spark):
    words = {"aaaaaaa": 2, "aaaaaaab": 20, "aaaaaabb": 200, "aaaaabbb": 2000, "aaaabbbb": 20000, "zzzzzzz": 2}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert got(V.variants(df)) == plain(words)
    assert plain(words)["aaaaaaa"][1] == "aaaabbbb"


def test_many_cells_in_one_batch_and_cells_across_batches(spark):
    words = dealt(3, 900)
    df = spark.createDataFrame(list(words.items()), "word string, n long").coalesce(1)
    kept, V._ROWS = V._ROWS, 50
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
        assert got(V.variants(df, block=40)) == plain(words)
    finally:
        V._ROWS = kept
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def test_words_of_documents(spark, documents):
    rng = random.Random(5)
    stems = ["thinking", "thinkings", "Élévation", "élévations", "overflow", "×÷×÷×÷×÷", "short"]
    rows = [(i, " ".join(rng.choice(stems) + rng.choice(["", ".", "\n", "2", "S"]) for _ in range(300))) for i in range(60)]
    rows += [rows[0], rows[0], (None, rows[1][1]), (None, None), (99, None), (98, ""), (97, "x" * 50_000 + " " + "word" * 20_000)] * 2
    words = V.counted(documents(rows)).where("n >= 2")
    assert {r.word: r.n for r in words.collect()} == plain_words(rows)
    assert got(V.variants(words)) == plain(plain_words(rows))


def test_whole_small_documents(spark, small, prose):
    want = plain_words([r[:2] for r in prose])
    few = {w: n for w, n in sorted(want.items())[:1500]}
    assert {r.word: r.n for r in V.counted(spark.read.parquet(f"{small}/documents.parquet")).where("n >= 2").collect()} == want
    assert got(V.variants(spark.createDataFrame(list(few.items()), "word string, n long"))) == plain(few)


def test_empty_tables_and_clashing_columns(spark, documents):
    none = documents([])
    assert V.variants(V.counted(none)).collect() == []
    rows = [(i, "thinking thinkink") for i in range(40)]
    df = documents(rows)
    for name in ("word", "n", "id", "form"):
        df = df.withColumn(name, df["doc_id"])
    assert got(V.variants(V.counted(df).where("n >= 2"))) == plain(plain_words(rows))
