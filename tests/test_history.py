import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from siltstone.operators import history as H
from siltstone.operators import ordered
from siltstone.sinks.staging import stage
from siltstone.sinks.tables import save_snapshot, splice_snapshot
from frames import rows


@pytest.fixture
def many_ranges(spark, monkeypatch):
    """Many tasks, and keys of a few rows hot already, as with much data."""
    monkeypatch.setattr(ordered, "_FEW", 5)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


T1, T2, T3 = datetime(2024, 1, 1), datetime(2024, 2, 1), datetime(2024, 3, 1)
SCHEMA = "k string, a string, b int, note string"


def snap(spark, target, data, at, **options):
    source = spark.createDataFrame(data, SCHEMA)
    return H.scd2_snapshot(target, source, "k", ["a", "b"], at, time_type=TimestampNTZType(), **options)


FIRST = [("same", "x", 1, "n"), ("changed", "x", 1, "n"), ("to_null", "x", 1, "n"), ("from_null", None, 1, "n"), ("gone", "x", 1, "n"), ("note", "x", 1, "n")]
SECOND = [("same", "x", 1, "n"), ("changed", "y", 1, "n"), ("to_null", None, 1, "n"), ("from_null", "x", 1, "n"), ("note", "x", 1, "other"), ("new", "x", 1, "n")]


def test_snapshot(spark):
    first = snap(spark, None, FIRST, T1)
    assert {(r.valid_from, r.valid_to) for r in first.collect()} == {(T1, None)}
    second = snap(spark, first, SECOND, T2)
    got = {(r.k, r.a, r.valid_from, r.valid_to, r.note) for r in second.collect()}
    assert got == {
        ("same", "x", T1, None, "n"), ("changed", "x", T1, T2, "n"), ("changed", "y", T2, None, "n"),
        ("to_null", "x", T1, T2, "n"), ("to_null", None, T2, None, "n"),
        ("from_null", None, T1, T2, "n"), ("from_null", "x", T2, None, "n"),
        ("gone", "x", T1, None, "n"), ("note", "x", T1, None, "n"), ("new", "x", T2, None, "n")}
    again = snap(spark, second, SECOND, T2)
    assert rows(again) == rows(second)
    back = snap(spark, second, FIRST[1:2], T3).filter("k = 'changed'")
    assert [(r.a, r.valid_from, r.valid_to) for r in back.orderBy("valid_from").collect()] == [
        ("x", T1, T2), ("y", T2, T3), ("x", T3, None)]


def test_stored_history_leaves_the_past_alone(spark, tmp_path):
    path = str(tmp_path / "history")

    def save(data, at):
        return rows(save_snapshot(spark, path, spark.createDataFrame(data, SCHEMA), "k", ["a", "b"], at, time_type=TimestampNTZType()))

    first = snap(spark, None, FIRST, T1)
    second = snap(spark, first, SECOND, T2)
    assert save(FIRST, T1) == rows(first)
    assert save(SECOND, T2) == rows(second) == save(SECOND, T2)
    past = {p for p in (tmp_path / "history").glob("closed_at=2024*/*.parquet")}
    assert past and save(FIRST, T3) == rows(snap(spark, second, FIRST, T3))
    assert past <= {p for p in (tmp_path / "history").glob("closed_at=2024*/*.parquet")}
    # a second look at the same moment adds to what the first one closed
    third = snap(spark, second, FIRST, T3)
    more = [*FIRST, ("new", "z", 2, "n")]
    assert save(more, T3) == rows(snap(spark, third, more, T3))


def test_hard_deletes_and_first_date(spark):
    first = snap(spark, None, FIRST, T1, first_valid_from=datetime(1900, 1, 1))
    second = snap(spark, first, SECOND, T2, hard_deletes="invalidate")
    assert [tuple(r)[4:] for r in second.filter("k = 'gone'").collect()] == [(datetime(1900, 1, 1), T2)]


def test_dates_must_move_forward(spark):
    first = snap(spark, None, FIRST, T2)
    for at in (T1, T2):
        with pytest.raises(PySparkException, match="at or before"):
            snap(spark, first, SECOND, at).collect()
        assert rows(snap(spark, first, FIRST, at)) == rows(first)


@pytest.mark.parametrize("bad", [[("k", "x", 1, "n"), ("k", "x", 1, "m")], [(None, "x", 1, "n")]])
def test_repeated_or_null_keys_fail(spark, bad):
    with pytest.raises(PySparkException, match="repeated or NULL"):
        snap(spark, None, bad, T1).collect()
    with pytest.raises(PySparkException, match="repeated or NULL"):
        snap(spark, snap(spark, None, FIRST, T1), bad, T2).collect()


def random_batches(seed, keys=5, days=40):
    rng = random.Random(seed)
    out, state = [], {}
    for day in range(days):
        at = T1 + timedelta(days=day * 3, hours=rng.randrange(24))
        for k in range(keys):
            if str(k) not in state or rng.random() < 0.3:
                state[str(k)] = (rng.choice(["x", "y", None]), rng.choice([1, None]))
            out.append((str(k), *state[str(k)], f"{day}", at))
    return out


def test_replay_equals_snapshots_one_by_one(spark):
    data = random_batches(7, days=4)
    batches = spark.createDataFrame(data, SCHEMA + ", at timestamp_ntz")
    target = None
    for at in sorted({r[4] for r in data}):
        target = stage(snap(spark, target, [r[:4] for r in data if r[4] == at], at), "history")
    assert rows(H.scd2_replay(batches, "k", ["a", "b"], "at")) == rows(target)


def replayed(data):
    out = []
    for k in {r[0] for r in data}:
        versions = []
        for r in sorted((r for r in data if r[0] == k), key=lambda r: r[4]):
            if not versions or versions[-1][1:3] != r[1:3]:
                versions.append(r)
        ends = [v[4] for v in versions[1:]] + [None]
        out += [(*v[:4], v[4], end) for v, end in zip(versions, ends)]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_replay_and_asof_merge_against_brute_force(spark, many_ranges, seed):
    data = random_batches(seed)
    data += [("hot", random.Random(i * seed).choice("xyz"), i % 3, "n", T1 + timedelta(hours=i)) for i in range(200)]
    batches = spark.createDataFrame(data + data[:50], SCHEMA + ", at timestamp_ntz").repartition(5)
    want = replayed(data)
    history = H.scd2_replay(batches, "k", ["a", "b"], "at")
    assert rows(history) == want
    moments = sorted({r[4] for r in data} | {T1 - timedelta(days=1), T3, T3 + timedelta(days=300)})
    facts = [(i, k, at) for i, at in enumerate(moments) for k in ("0", "3", "hot", "unknown", None)] + [(-1, "0", None)]
    fact = spark.createDataFrame(facts, "n int, code string, ts timestamp_ntz")
    for closed in ("half", "both"):
        def holds(at, begin, end):
            return begin <= at and (end is None or (at < end if closed == "half" else at <= end))
        expected = sorted(((n, c, at, *v) for n, c, at in facts if at for v in want if v[0] == c and holds(at, v[4], v[5])), key=str)
        versions = spark.createDataFrame(want, SCHEMA + ", valid_from timestamp_ntz, valid_to timestamp_ntz")
        assert rows(H.asof_merge_join(fact, versions, {"code": "k"}, "ts", closed)) == expected
        assert rows(H.asof_dim_join(fact, versions, {"code": "k"}, "ts", closed)) == expected
        assert rows(H.asof_join(fact, versions, {"code": "k"}, "ts", closed)) == expected
        if closed == "half":
            assert len({e[0:2] for e in expected}) == len(expected)


def test_asof_joins_refuse_shared_names(spark):
    history = snap(spark, None, FIRST, T1)
    for join in (H.asof_dim_join, H.asof_merge_join):
        with pytest.raises(ValueError, match="share"):
            join(spark.createDataFrame([("same", T2)], "k string, ts timestamp_ntz"), history, {"k": "k"}, "ts")


def test_replay_rejects_null_keys(spark):
    batches = spark.createDataFrame([(None, "x", 1, "n", T1)], SCHEMA + ", at timestamp_ntz")
    with pytest.raises(PySparkException, match="NULL key"):
        H.scd2_replay(batches, "k", ["a"], "at").collect()


HOT = 6_000


def hot_rows(spark):
    """A third of all rows are one key's and fall on one day; every row is a change."""
    even = [(f"k{i % 1000}", "xyz"[i // 1000 % 3], i % 7, "n", T1 + timedelta(hours=i // 1000)) for i in range(2 * HOT)]
    hot = [("hot", "xyz"[i % 3], i % 7, "n", T2 + timedelta(seconds=i)) for i in range(HOT)]
    return spark.createDataFrame(even + hot, SCHEMA + ", at timestamp_ntz").repartition(5)


def per_task(df):
    return sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("task")).count().collect())


def balanced(sizes):
    return sizes[-1] < 2 * sizes[len(sizes) // 2]


def test_replay_spreads_a_hot_key_of_one_day(spark, many_ranges):
    sizes = per_task(H.scd2_replay(hot_rows(spark), "k", ["a", "b"], "at"))
    assert sum(sizes) == 3 * HOT and balanced(sizes)


def test_asof_spreads_a_hot_key_and_a_hot_moment(spark, many_ranges):
    versions = spark.createDataFrame(
        [(f"k{i}", "x", T1, None) for i in range(1000)] + [("hot", "x", T1, T2), ("hot", "y", T2, None)], "k string, a string, valid_from timestamp_ntz, valid_to timestamp_ntz")
    facts = hot_rows(spark).selectExpr("k AS code", "CASE WHEN k = 'hot' THEN TIMESTAMP_NTZ'2024-02-10' ELSE at END AS ts", "hash(at, k) AS n")
    joined = H.asof_merge_join(facts, versions, {"code": "k"}, "ts")
    sizes = per_task(joined)
    assert sum(sizes) == 3 * HOT and balanced(sizes)
    assert joined.filter("code = 'hot'").select("a").distinct().collect()[0][0] == "y"


def test_hot_rows_are_dealt_by_range_once(spark, many_ranges):
    """Windows take the ranges as they are dealt, and rows of keys that are not hot are shuffled by key."""
    plan = H.scd2_replay(hot_rows(spark), "k", ["a", "b"], "at")._jdf.queryExecution().executedPlan().toString()
    assert "shufflepartitionidpassthrough" in plan and "hashpartitioning(k#" in plan and "_range" not in "".join(
        re.findall(r"hashpartitioning\((k#[^)]*)\)", plan))


def test_without_a_hot_key_nothing_is_written(spark):
    plan = H.scd2_replay(hot_rows(spark).filter("k <> 'hot'"), "k", ["a", "b"], "at")._jdf.queryExecution().executedPlan().toString()
    assert "parquet" not in plan and "_range" not in plan


def one_by_one(spark, data, checks, **options):
    target = None
    for at in sorted({r[4] for r in data}):
        target = stage(snap(spark, target, [r[:4] for r in data if r[4] == at], at, **options), "history")
    return target


def vanishing(seed, keys=6, days=8):
    rng = random.Random(seed)
    out = []
    for day in range(days):
        at = T1 + timedelta(days=day * 3, hours=rng.randrange(24))
        out += [(str(k), rng.choice(["x", "x", "y", None]), 1, "n", at) for k in range(keys) if rng.random() < 0.6]
        out.append(("always", rng.choice("xy"), 1, "n", at))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_replay_with_vanished_keys_equals_snapshots(spark, many_ranges, seed):
    data = vanishing(seed)
    batches = spark.createDataFrame(data + data[:5], SCHEMA + ", at timestamp_ntz")
    got = H.scd2_replay_deletes(batches, "k", ["a", "b"], "at")
    assert rows(got) == rows(one_by_one(spark, data, ["a", "b"], hard_deletes="invalidate"))


def islands(data):
    """The history under closing of vanished keys, walked batch by batch."""
    times = sorted({r[4] for r in data})
    out, current = [], {}
    for at in times:
        seen = {r[0]: r for r in data if r[4] == at}
        for k in list(current):
            if k not in seen or current[k][1:3] != seen[k][1:3]:
                out.append((*current[k][:4], current[k][4], at))
                del current[k]
        for k, r in seen.items():
            current.setdefault(k, r)
    return sorted(out + [(*r[:4], r[4], None) for r in current.values()], key=str)


def test_replay_with_vanished_keys_over_many_ranges(spark, many_ranges):
    data = vanishing(9, keys=12, days=150)
    batches = spark.createDataFrame(data, SCHEMA + ", at timestamp_ntz").repartition(3)
    assert rows(H.scd2_replay_deletes(batches, "k", ["a", "b"], "at")) == islands(data)


def test_replay_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA + ", at timestamp_ntz")
    assert H.scd2_replay(none, "k", ["a"], "at").count() == H.scd2_replay_deletes(none, "k", ["a"], "at").count() == 0


def spliced(spark, data, order, hard_deletes):
    history, taken = None, []
    for at in order:
        source = spark.createDataFrame([r[:4] for r in data if r[4] == at], SCHEMA)
        if history is None:
            history = H.scd2_snapshot(None, source, "k", ["a", "b"], at, time_type=TimestampNTZType())
        else:
            seen = spark.createDataFrame([(t,) for t in taken], "at timestamp_ntz")
            history = H.scd2_splice(history, seen, source, "k", ["a", "b"], at, hard_deletes)
        history = stage(history, "history")
        taken.append(at)
    return history


@pytest.mark.parametrize("seed", range(4))
def test_batches_in_any_order_give_one_history(spark, seed):
    data = vanishing(seed, keys=8, days=5)
    order = sorted({r[4] for r in data})
    random.Random(seed).shuffle(order)
    assert rows(spliced(spark, data, order, "invalidate")) == islands(data)


def test_stored_batches_in_any_order(spark, tmp_path):
    data = vanishing(11, keys=6, days=5)
    times = sorted({r[4] for r in data})
    paths = str(tmp_path / "history"), str(tmp_path / "taken")

    def take(at):
        source = spark.createDataFrame([r[:4] for r in data if r[4] == at], SCHEMA)
        return splice_snapshot(spark, *paths, source, "k", ["a", "b"], at, "invalidate", TimestampNTZType())

    for i in (2, 0, 4, 1, 1):
        got = take(times[i])
    assert rows(got) == islands([r for r in data if r[4] != times[3]])
    early = {p.name for p in (tmp_path / "history").glob(f"closed_at={times[1]:%Y%m%d}*/*.parquet")}
    assert early and rows(take(times[3])) == islands(data)
    assert early == {p.name for p in (tmp_path / "history").glob(f"closed_at={times[1]:%Y%m%d}*/*.parquet")}
    assert sorted(r[0] for r in spark.read.parquet(paths[1]).collect()) == times


def test_any_order_without_deletes(spark):
    data = random_batches(3, keys=6, days=5)
    order = sorted({r[4] for r in data})
    random.Random(1).shuffle(order)
    got = [(*r[:3], *r[4:]) for r in rows(spliced(spark, data, order, "ignore"))]  # a version opened again repeats its first note
    assert sorted(got, key=str) == sorted([(*r[:3], *r[4:]) for r in replayed(data)], key=str)


def test_a_moment_is_taken_once(spark):
    first = snap(spark, None, FIRST, T1)
    taken = spark.createDataFrame([(T1,)], "at timestamp_ntz")
    assert rows(H.scd2_splice(first, taken, spark.createDataFrame(FIRST, SCHEMA), "k", ["a", "b"], T1)) == rows(first)
    with pytest.raises(PySparkException, match="taken already"):
        H.scd2_splice(first, taken, spark.createDataFrame(SECOND, SCHEMA), "k", ["a", "b"], T1).collect()


def test_dimension_and_surrogate(spark):
    history = snap(spark, snap(spark, None, FIRST, T1), SECOND, T2)
    dim = H.scd2_dimension(history, {"key": "k", "a": "a"})
    assert dim.columns == ["key", "a", "valid_from", "valid_to", "is_current"]
    assert dim.filter("is_current").count() == 7
    fact = spark.createDataFrame([(1, "changed", T1), (2, "changed", T2), (3, "changed", datetime(2023, 1, 1)), (4, None, T2)], "n int, code string, ts timestamp_ntz")
    keyed = {r.n: r.dim_sk for r in H.resolve_surrogate(fact, history, {"code": "k"}, "ts").collect()}
    assert keyed[1] and keyed[2] and keyed[1] != keyed[2] and keyed[3] is None and keyed[4] is None


def test_stored_snapshot_of_an_empty_source_closes_all(spark, tmp_path):
    def take(data, at):
        return save_snapshot(spark, str(tmp_path / "history"), spark.createDataFrame(data, SCHEMA), "k", ["a", "b"], at,
                             time_type=TimestampNTZType(), hard_deletes="invalidate")

    first = spark.createDataFrame([], SCHEMA).schema
    some = [tuple(f"v{i}" if f.dataType.typeName() == "string" else i for f in first) for i in (1, 2)]
    assert take(some, "2024-01-01 00:00:00").count() == 2
    done = take([], "2024-01-02 00:00:00")
    assert done.count() == 2 and done.filter(F.col(H.TO).isNull()).count() == 0


def test_one_history_in_two_roles(spark):
    from siltstone.functions import values as V
    from siltstone.operators import star as S

    day = lambda n: datetime(2024, 1, n)
    history = spark.createDataFrame(
        [("E", "old", day(1), day(5)), ("E", "new", day(5), None), ("U", "only", day(3), None)],
        "code string, name string, valid_from timestamp_ntz, valid_to timestamp_ntz")
    fact = spark.createDataFrame(
        [(1, "E", "U", day(4)), (2, "E", "E", day(5)), (3, "U", "E", day(2)), (4, None, "X", day(9)), (5, "E", "U", None)],
        "n int, base string, quote string, at timestamp_ntz")
    roles = [S.AsOfRole(history, {c: "code"}, {f"{c}_name": "name", f"{c}_since": "valid_from"}, f"{c}_sk") for c in ("base", "quote")]
    got = S.asof_star_join(fact, "at", *roles)
    assert got.columns == [*fact.columns, "base_name", "base_since", "base_sk", "quote_name", "quote_since", "quote_sk"]
    assert [(r.n, r.base_name, r.quote_name) for r in got.orderBy("n").collect()] == [
        (1, "old", "only"), (2, "new", "new"), (3, None, "old"), (4, None, None), (5, None, None)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert ">=" not in plan and got.count() == 5  # no fact is paired with versions it does not get
    keys = {tuple(r) for r in history.select("name", V.surrogate_key("code", "valid_from")).collect()} | {(None, None)}
    assert {(r.base_name, r.base_sk) for r in got.collect()} | {(r.quote_name, r.quote_sk) for r in got.collect()} <= keys
