"""Near vectors against all pairs."""

import numpy as np
import pytest

from siltstone.llm import pivots


def expected(rows):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    of = list(range(len(good)))

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    links = [0] * len(good)
    for a in range(len(good)):
        for b in range(a):
            x, y = good[a][1], good[b][1]
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95:
                links[a] += 1
                links[b] += 1
                p, q = sorted((root(a), root(b)))
                of[q] = p
    least = {}
    for k, (i, _) in enumerate(good):
        least[root(k)] = min(least.get(root(k), i), i)
    out = [(i, links[k], least[root(k)], least[root(k)] == i) for k, (i, _) in enumerate(good)]
    bad = len(rows) - len(good)
    return sorted(out, key=str), bad


@pytest.mark.parametrize("kind", ["float", "double"])
def test_links_of_groups_copies_and_bad_vectors(spark, kind):
    draw = np.random.default_rng(3)
    rows, centre = [], draw.normal(size=(40, 24))
    for i in range(900):
        v = centre[draw.integers(40)] + draw.normal(size=24) * draw.choice([0, 0.05, 0.2, 2])
        rows.append((i, np.float32(v).astype(float).tolist()))
    rows += [(900, None), (901, []), (902, [0.0] * 24), (903, [None] + [1.0] * 23), (904, [float("nan")] * 24), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (907, rows[5][1]), (907, rows[6][1])]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    got = sorted((tuple(r) for r in pivots.near_vectors(df).collect()), key=str)
    wanted, bad = expected(rows)
    assert [g for g in got if g[0] not in (900, 901, 902, 903, 904)] == wanted
    assert [g for g in got if g[0] in (900, 901, 902, 903, 904)] == [(i, 0, i, True) for i in range(900, 905)] and bad == 5


def test_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (None, None), (3, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, pivots.near_vectors(df).collect()), key=str) == [(3, 0, 3, True), (None, 0, None, True), (None, 0, None, True)]
    assert pivots.near_vectors(df.limit(0)).count() == 0


def test_clashing_names_change_nothing(spark):
    rows = [(i, [float(i % 3 == k) + 0.001 * i for k in range(3)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    plain = sorted(map(tuple, pivots.near_vectors(df).collect()))
    for name in ("id", "v", "vector", "node", "component", "key", "a", "b", "rank", "kept", "n_links"):
        df = df.withColumn(name, df["vec_id"])
    assert sorted(map(tuple, pivots.near_vectors(df).collect())) == plain


def test_recall_on_an_uneven_set(spark):
    """Half of the vectors crowd around one direction, the rest lie anywhere: at least nine links of ten are found, and none that is none."""
    draw = np.random.default_rng(8)
    crowd = draw.normal(size=32)
    rows = [(i, (crowd + draw.normal(size=32) * 0.35).tolist() if i % 2 else draw.normal(size=32).tolist()) for i in range(600)]
    rows += [(1000 + i, (np.array(rows[i][1]) * 2 + draw.normal(size=32) * 0.02).tolist()) for i in range(0, 600, 5)]
    got = {r.vec_id: r.n_links for r in pivots.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    want = {r[0]: r[1] for r in expected(rows)[0]}
    assert all(got[i] <= want[i] for i in want) and sum(got.values()) >= 0.9 * sum(want.values()) > 0
