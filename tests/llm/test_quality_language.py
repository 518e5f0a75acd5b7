"""Quality rules and language identification."""

import math
import re
import zlib

from siltstone.llm import language, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {g for g in grams if grams.count(g) > 1} if len(grams) < 2000 else None
    covered = {i + k for i, g in enumerate(grams) if g in often for k in range(3)} if often is not None else None
    lines, dup = set(), 0
    for x in text.split("\n"):
        if WORD.search(x):
            dup += x in lines
            lines.add(x)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, None if covered is None else len(covered)


def test_base_rules_as_counted_plainly(prose):
    none = quality.References([], None, [], [])
    odd = ["", "a a a a", "a b a b a b", "x y z\n\n \nx y z", "a b c\n" * 40, "é|#\x0b\x0c<>"]
    for text in [t or "" for _, t, *_ in prose[:120]] + odd:
        got = quality.measure(text, none)
        wanted = base(text)
        assert (got["n_words"], got["word_chars"], got["n_symbols"], got["n_dup_lines"]) == wanted[:4]
        if wanted[4] is not None:
            assert got["n_repeat_words"] == wanted[4]
            assert got["base_failed"] == (wanted[0] < 50 or 100 * wanted[4] > 50 * wanted[0])


def test_verdicts_follow_the_labels(spark, small):
    sf = small.replace("sf0.001", "sf0.01")
    got = {r["doc_id"]: r for r in quality.op4_histogram_divergence(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    clean = [got[r["doc_id"]] for r in labels if r["quality"] == 1 and not got[r["doc_id"]]["base_failed"]]
    junk = [got[r["doc_id"]] for r in labels if r["quality"] == 0]
    assert sum(r["kept"] for r in clean) >= 0.99 * len(clean)
    assert sum(r["kept"] for r in junk) <= 0.1 * len(junk)


def test_quality_edges(documents):
    rows = [(1, None), (2, ""), (3, "word " * 60), (3, "word " * 60), (4, " ".join(f"w{i}" for i in range(60)))]
    got = sorted((r["doc_id"], r["n_words"], r["kept"]) for r in quality.scored(documents(rows)).collect())
    assert got == [(1, 0, False), (2, 0, False), (3, 60, False), (3, 60, False), (4, 60, True)]
    docs = documents(rows).selectExpr("*", "1 AS kept", "2 AS n_words")
    assert quality.accepted(docs).columns == docs.columns and quality.accepted(docs).count() == 1
    assert quality.scored(documents([])).count() == 0


def test_distance():
    import numpy as np

    a, b = np.array([1.0, 0.0]), np.array([0.0, 1.0])
    assert quality.distance(a, a) == 0 and quality.distance(a, b) == 1


def test_held_out_accuracy(spark, small):
    sf = small.replace("sf0.001", "sf0.01")
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = language.op6_nearest_centroid(spark, sf).collect()
    assert len(got) == len(truth) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_language_edges(documents):
    rows = [(1, "the cat sat on the mat", "en"), (2, "der Hund lag im Garten", "de"), (3, None, "en"), (4, "123 !?", None), (5, "", None), (6, "the mat", None), (8, "½ ² ① Ⅷ _", None), (None, "der Garten", None)]
    model = language.learn(documents(rows))
    got = {r["doc_id"]: (r["lang_pred"], r["score"] > 0) for r in language.predicted(documents(rows), model).collect()}
    assert got == {1: ("en", True), 2: ("de", True), 3: ("und", False), 4: ("und", False), 5: ("und", False), 6: ("en", True), 8: ("und", False), None: ("de", True)}
    bare = language.learn(documents([(1, "abc")]))
    assert [r["lang_pred"] for r in language.predicted(documents([(1, "abc")]), bare).collect()] == ["und"]
    assert language.predicted(documents([]), model).count() == 0


def plain_vector(text, idf):
    """Hashed n-grams of a text counted one by one."""
    raw = bytearray()
    for b in f" {text.lower()} ".encode():
        b = b if chr(b).isalpha() or b > 127 else 32
        if not (b == 32 and raw and raw[-1] == 32):
            raw.append(b)
    counts = [0] * language.FEATURES
    for n in range(1, language.LONGEST + 1):
        for i in range(len(raw) - n + 1):
            key = 0
            for b in raw[i : i + n]:
                key = (key * 257 + b + 1) % 2**32
            counts[(key * 2654435761 % 2**32) >> 20] += 1
    v = [math.log1p(c) * w for c, w in zip(counts, idf)]
    norm = math.sqrt(sum(x * x for x in v))
    return [x / norm for x in v]


def test_predictions_and_frequencies_against_plain_cosines(spark, documents, prose):
    rows = [r for r in prose if r[1]][:60]
    docs = documents([(*r[:3],) for r in rows] + [(900, "x y z q", "xx"), (901, "x y z q", "xx"), (902, "a" * 50_000, None)])
    model = language.learn(docs)
    labelled = [r.text for r in docs.collect() if r.lang is not None]
    seen = [sum(v > 0 for v in column) for column in zip(*(plain_vector(t, [1] * language.FEATURES) for t in labelled))]
    assert all(abs(a - math.log((1 + len(labelled)) / (1 + n)) - 1) < 1e-9 for a, n in zip(model.idf, seen))
    got = {r.doc_id: r for r in language.predicted(docs, model).collect()}
    for doc_id, text in [(r.doc_id, r.text) for r in docs.collect()]:
        v = plain_vector(text, model.idf)
        near = [sum(a * b for a, b in zip(v, centre)) for centre in model.matrix]
        best = max(near)
        of = {lang for lang, x in zip(model.languages, near) if x > best - 1e-9}
        assert got[doc_id].lang_pred in of and abs(got[doc_id].score - min(max(best, 0), 1)) < 1e-6


def test_language_ties_repeats_and_clashing_names(documents):
    rows = [(1, "same words here", "bb"), (2, "same words here", "aa"), (2, "same words here", "aa"), (3, "other text", "cc")]
    docs = documents(rows).selectExpr("*", "1 AS key", "2 AS rank", "'x' AS lang_pred", "0 AS score")
    model = language.learn(docs)
    got = [(r.doc_id, r.lang_pred) for r in language.predicted(docs, model).collect()]
    assert sorted(got) == [(1, "aa"), (2, "aa"), (2, "aa"), (3, "cc")]


def test_repeated_words_among_very_many_distinct_ones():
    """Beyond 2^20 distinct words pairs are numbered anew; the count stays."""
    import numpy as np

    draw = np.random.default_rng(2)
    for _ in range(20):
        number = draw.integers(0, 9, 300)
        assert quality.repeated_words(number, 1 << 21) == quality.repeated_words(number, 9)
    words = [f"w{i}" for i in range((1 << 20) + 10)] + ["w1", "w2", "w3"]
    got = quality.measure(" ".join(words), quality.References([], None, [], []))
    assert (got["n_words"], got["n_repeat_words"], got["kept"]) == (len(words), 6, True)
