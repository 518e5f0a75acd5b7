import pytest

from siltstone.domains import exchange_rates as fx
from siltstone.operators import quality as Q
from siltstone.sinks import tables as K
from frames import rows


@pytest.fixture(scope="module")
def child(spark):
    return spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "b"), (None, None), (3, None)], "k int, p string")


def test_single_checks(spark, child):
    parent = spark.createDataFrame([("a",), (None,)], "code string")
    assert rows(Q.dq_not_null(child, ["k"])) == sorted([(None, "b"), (None, None)], key=str)
    assert rows(Q.dq_not_null(child, ["k", "p"])) == sorted([(None, "b"), (None, None), (3, None)], key=str)
    assert rows(Q.dq_unique(child, "k")) == [(1, 2)]
    assert rows(Q.dq_unique(child, ["k", "p"])) == [(1, "a", 2)]
    assert rows(Q.dq_primary_key(child, "k")) == [(1, 2), (None, 2)]
    assert rows(Q.dq_relationships(child, "p", parent, "code")) == [("b", 2)]
    assert rows(Q.dq_foreign_key(child, "p", parent, "code")) == sorted([(2, "b"), (None, "b")], key=str)


def test_suite_reports_every_check(spark, child):
    parent = spark.createDataFrame([("a",), ("b",)], "code string")
    got = Q.dq_suite({"child": child, "parent": parent}, [
        Q.Check("not_null", "child", ("k", "p")), Q.Check("not_null", "parent", "code"),
        Q.Check("unique", "child", "k"), Q.Check("primary_key", "child", ("k", "p")),
        Q.Check("relationships", "child", "p", "parent", "code"), Q.Check("foreign_key", "child", "p", "parent", "code")])
    assert got.columns == ["test", "table", "column", "failures"]
    assert rows(got) == sorted([
        ("not_null", "child", "k", 2), ("not_null", "child", "p", 2), ("not_null", "parent", "code", 0),
        ("unique", "child", "k", 1), ("primary_key", "child", "k,p", 4),
        ("relationships", "child", "p", 0), ("foreign_key", "child", "p", 0)], key=str)


def test_each_key_set_is_counted_once(spark, child):
    parent = spark.createDataFrame([("a",), ("b",)], "code string")
    suite = Q.dq_suite({"child": child, "parent": parent}, [
        Q.Check("unique", "child", "p"), Q.Check("primary_key", "child", "p"), Q.Check("primary_key", "parent", "code"),
        Q.Check("relationships", "child", "p", "parent", "code"), Q.Check("foreign_key", "child", "p", "parent", "code")])
    plan = suite._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1 and plan.count("Scan ExistingRDD") == 2
    assert rows(suite) == sorted([
        ("unique", "child", "p", 2), ("primary_key", "child", "p", 3), ("primary_key", "parent", "code", 0),
        ("relationships", "child", "p", 0), ("foreign_key", "child", "p", 0)], key=str)


def test_key_sets_of_different_types_and_tied_references(spark):
    tables = {
        "a": spark.createDataFrame([(1,), (2,), (2,), (None,), (9,)], "x int"), "b": spark.createDataFrame([(1,), (2,), (3,)], "y bigint"),
        "c": spark.createDataFrame([(2, 1), (3, 1), (3, 1), (None, 1)], "x int, z int")}
    got = Q.dq_suite(tables, [
        Q.Check("foreign_key", "a", "x", "b", "y"), Q.Check("relationships", "b", "y", "c", "x"), Q.Check("unique", "c", "x"),
        Q.Check("primary_key", "c", ("x", "z")), Q.Check("unique", "c", "z")])
    assert rows(got) == sorted([
        ("foreign_key", "a", "x", 1), ("relationships", "b", "y", 1), ("unique", "c", "x", 1), ("primary_key", "c", "x,z", 2),
        ("unique", "c", "z", 1)], key=str)


def test_stored_key_counts(spark, tmp_path):
    import random

    rng, path = random.Random(1), str(tmp_path / "counts")
    loads = [[(rng.choice([None, *range(40)]), rng.randrange(2)) for _ in range(n)] for n in (60, 0, 30, 25)]
    seen = []
    for load in loads:
        seen += load
        met = K.count_keys(spark, path, spark.createDataFrame(load, "k int, p int"), ["k", "p"], buckets=8)
        assert {(r.k, r.p): r.n_records for r in met.collect()} == {key: seen.count(key) for key in set(load)}
    stored = spark.read.parquet(path)
    assert {(r.k, r.p): r.n_records for r in stored.collect()} == {key: seen.count(key) for key in set(seen)}


def test_unknown_keys_of_a_batch(spark, tmp_path):
    parents = str(tmp_path / "parents")
    K.count_keys(spark, parents, spark.createDataFrame([(i,) for i in range(0, 50, 2)], "id bigint"), ["id"], buckets=8)
    met = K.count_keys(spark, str(tmp_path / "children"), spark.createDataFrame([(1,), (1,), (2,), (None,), (99,)], "ref int"), ["ref"], buckets=8)
    assert rows(K.unknown_keys(met, ["ref"], spark.read.parquet(parents), ["id"], buckets=8)) == sorted([(1, 2), (99, 1)], key=str)


def test_unknown_check():
    with pytest.raises(ValueError):
        Q.Check("nonnull", "t", "c")


def test_declared_checks_cover_the_domain():
    columns = [(c.table, n) for c in fx.CHECKS if c.kind == "not_null" for n in ([c.columns] if isinstance(c.columns, str) else c.columns)]
    assert len(columns) == len(set(columns)) == 27
    assert sum(c.kind == "unique" for c in fx.CHECKS) == 4
    assert sum(c.kind == "relationships" for c in fx.CHECKS) == 3
