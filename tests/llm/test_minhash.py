"""Near copies against all pairs of full sets."""

import random

import numpy as np

from siltstone.llm import minhash


def expected(rows):
    sets = {}
    for doc, text in rows:
        words = (text or "").encode().lower().split()
        n = max(1, len(words) - 4) if words else 0
        sets[doc] = {tuple(words[i : i + 5]) for i in range(n)}
    of = {d: d for d in sets}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                of[y] = x
    return sorted((d, len(s), root(d), root(d) == d) for d, s in sets.items())


def made(docs):
    return sorted(tuple(r) for r in minhash.near_copies(docs).collect())


def test_driver_documents(spark, small, prose):
    assert sorted(tuple(r) for r in minhash.op5_bayes_minhash(spark, small).collect()) == expected([r[:2] for r in prose])


def test_a_group_of_near_copies(documents):
    draw = random.Random(4)
    base = [f"w{draw.randrange(10**6)}" for _ in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 260):
        words = base.copy()
        for _ in range(draw.choice([0, 1, 2, 4, 6, 9])):
            words[draw.randrange(150)] = f"x{draw.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    assert made(documents(rows)) == expected(rows)


def test_edges(documents):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE\ttwo"), (6, "one two three"), (7, "a b c d e"), (8, "a b c d e f"), (9, "z " * 3000)]
    assert made(documents(rows)) == expected(rows)
    assert made(documents([])) == []
    again = documents([(1, "a b c"), (1, "a b c"), (2, "a b c"), (None, "a b c")])
    assert sorted(map(str, minhash.near_copies(again).collect())) == sorted([
        "Row(doc_id=1, n_shingles=1, component_id=1, kept=True)"] * 2 + ["Row(doc_id=2, n_shingles=1, component_id=1, kept=False)",
        "Row(doc_id=None, n_shingles=0, component_id=None, kept=True)"])
    clash = again.selectExpr("*", "1 AS gone_id", "2 AS node", "3 AS signature")
    kept = minhash.deduplicated(clash.drop("gone_id"))
    assert kept.columns == clash.drop("gone_id").columns and kept.count() == 3


def test_estimates_follow_similarity():
    draw = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.75, 0.9):
        both, n = int(2000 * share), int(2000 * (1 - share) / 2)
        x = draw.integers(0, 1 << 63, both + 2 * n, np.uint64)
        a, b = np.unique(x[: both + n]), np.unique(np.append(x[:both], x[both + n :]))
        made_ = minhash.signatures(np.concatenate([a, b]), np.array([0, len(a)]))
        assert abs((made_[0] == made_[1]).mean() - share) < 0.16
        assert minhash.survive(made_[:1], made_[1:])[0] == (share >= 0.75)


def test_the_compared_text_of_a_repeated_id_brings_its_own_signature(documents):
    draw, rows = random.Random(7), []
    for i in range(12):
        base, other = ([f"w{draw.randrange(10**6)}" for _ in range(150)] for _ in range(2))
        by_hash = sorted([" ".join(base), " ".join(other)], key=lambda t: np.frombuffer(minhash.xxhash.xxh3_128_digest(t.encode()), "<i8").tolist())
        near = by_hash[0].split()
        near[-1] = "x"
        rows += [(10 * i, by_hash[0]), (10 * i, by_hash[1]), (10 * i + 1, " ".join(near))]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_copies(documents(rows)).collect()}
    assert all(got[10 * i + 1] == 10 * i for i in range(12))
