"""Licence scans: base phrases against a plain search, edited notices against their templates."""

import random
import re

import pytest

from siltstone.llm import licenses as L

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def plain(text):
    words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    starts = [(i, label) for phrase, label in PHRASES.items() for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
    first, last = min((s for s, _ in starts), default=None), max((s for s, _ in starts), default=None)
    return len(words), len(starts), first, last, ",".join(sorted({label for _, label in starts}))


def base(row):
    return row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels


def noise(rng, n):
    return " ".join(rng.choice(["the", "of", "software", "license", "gnu", "general", "cc", "by", "mit", "apache", "public", "a"]) for _ in range(n))


def notice(label):
    return next(t for t in L.NOTICES if t.label == label)


def test_base_phrases_as_by_plain_search(spark, documents):
    rng = random.Random(1)
    texts = [noise(rng, rng.randrange(40)) for _ in range(200)]
    texts += ["CC-BY cc by CC  BY\ncc\tby", "ccby cc by4 cc by é", "GNU General  Public-License", "Kcc by", "MİT license", "mit license" * 3, "mit license " * 5000, None, "", "   ", "cc"]
    df = documents(list(enumerate(texts)))
    got = {r.doc_id: r for r in L.scanned(df).collect()}
    assert {i: base(r) for i, r in got.items()} == {i: plain(t) for i, t in enumerate(texts)}
    assert all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) for r in got.values())
    empty = got[texts.index(None)]
    assert (empty.n_words, empty.first_word, empty.labels, empty.score) == (0, None, "", 0.0)


def test_whole_small_documents(spark, small, prose):
    got = {r.doc_id: base(r) for r in L.op12_diagonal_licenses(spark, small).collect()}
    assert got == {d: plain(t) for d, t, *_ in prose}


@pytest.mark.parametrize("label", ["mit", "apache", "bsd", "isc", "lgpl"])
def test_notices_are_found_whole_and_edited(spark, documents, label):
    rng = random.Random(2)
    words = notice(label).text.split()

    def edited(n):
        out = list(words)
        for _ in range(n):
            at = rng.randrange(len(out))
            out[at : at + rng.randrange(2)] = ["changed"]
        return " ".join(out)

    texts = [" ".join(words), edited(2), edited(len(words) // 15), f"{noise(rng, 60)} {edited(2)} {noise(rng, 50)}"]
    texts += [" ".join(rng.sample(words, len(words))), " ".join(words[: len(words) // 2]), noise(rng, 400)]
    got = {r.doc_id: r for r in L.scanned(documents(list(enumerate(texts)))).collect()}
    own = {i: [s for s in r.spans if s.label == label and s.n_words > 15] for i, r in got.items()}
    assert [len(own[i]) for i in range(len(texts))] == [1, 1, 1, 1, 0, 0, 0]
    assert own[0][0].likeness == 1.0 and own[0][0].first_word == 0 and own[3][0].first_word in range(50, 70)
    assert all(label in got[i].labels.split(",") and 0.75 <= got[i].score <= 1 for i in range(4))


def test_likeness_is_the_longest_common_subsequence():
    rng = random.Random(3)

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0] + [max(row[j], 0) for j in range(1, len(row))] if False else _next(row, x, b)
        return row[-1]

    def _next(row, x, b):
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        return new

    for _ in range(200):
        a, b = ([rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randrange(1, 90))] for _ in range(2))
        assert L.in_order(a, b) == longest(a, b)


def test_votes_equal_a_count_of_equal_runs(spark):
    """Diagonals and their votes, of a text that repeats itself, as by comparing all runs of words with all of a template's."""
    rng = random.Random(4)
    template = L.Template("x", " ".join(rng.choice("abcdefgh") for _ in range(40)))
    text = " ".join([*(rng.choice("abcdefgh") for _ in range(300)), template.text, *(rng.choice("abcdefgh") for _ in range(20))])
    words, own = L.words_of(text), template.words
    votes = {}
    for i in range(len(words) - 2):
        for j in range(len(own) - 2):
            if words[i : i + 3] == own[j : j + 3]:
                votes[i - j] = votes.get(i - j, 0) + 1
    support = {d: sum(n for e, n in votes.items() if abs(d - e) <= L.NEAR) for d in votes}
    need = int(38 * L.VOTES)
    strong = {d: (s, votes[d], -d) for d, s in support.items() if s >= need}
    peaks = {d for d, s in strong.items() if s == max(x for e, x in strong.items() if abs(d - e) <= L.NEAR)}
    df = spark.createDataFrame([(text,)], "text string").selectExpr("xxhash64(text) AS a", "xxhash64(1, text) AS b", "text")
    places = L._run_places(df, "text", ["a", "b"], [r[0] for r in L.template_runs([template])])
    assert {r.diagonal for r in L.candidates(places, [template], ["a", "b"]).collect()} == peaks
    assert 300 in peaks


def test_pieces_do_not_change_hashes(monkeypatch):
    text = ("words of Every kind é日本 " * 50 + "x" * 300).encode()
    whole = L.word_hashes(text)
    monkeypatch.setattr(L, "_PIECE", 64)
    parts = L.word_hashes(text)
    assert all((a == b).all() for a, b in zip(whole, parts)) and len(whole[0]) == len(L.words_of(text.decode()))
    assert len(L.word_hashes(b"")[0]) == 0


def test_repeated_rows_null_ids_and_clashing_columns(spark, documents):
    text = f"intro {notice('isc').text} under the MIT License"
    rows = [(1, text), (1, text), (None, text), (2, None), (2, ""), (3, "no word of it")]
    df = documents(rows)
    for name in ("n_words", "score", "spans", "key_a", "of_a", "found", "held", "template", "diagonal", "pos", "run"):
        df = df.withColumn(name, df["lang"])
    out = L.scanned(df)
    got = out.collect()
    assert len(got) == len(rows) and {"key_a", "of_a", "found", "held", "template", "run"} <= set(out.columns)
    assert sorted(str(r.doc_id) for r in got if r.labels == "isc,mit") == ["1", "1", "None"]
    assert all(base(r) == plain(text) for r in got if r.labels)
    assert L.scanned(documents([])).count() == 0


def test_a_template_without_a_run_is_refused():
    with pytest.raises(ValueError, match="needs 2 words"):
        L.template_runs([L.Template("x", "one")])
