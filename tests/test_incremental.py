from datetime import datetime, timedelta

from pyspark.sql import functions as F

from siltstone.operators import incremental as I
from siltstone.operators import star as S
from siltstone.plans import layers as P
from siltstone.sinks import tables as K
from frames import rows

SCHEMA = "base string, quote string, rate double, at timestamp_ntz"


def at(minute, second=0, day=1):
    return datetime(2024, 1, day, 10, minute, second)


def rates(spark, *data):
    return spark.createDataFrame(data, SCHEMA)


def build(source, previous=None, **options):
    return P.build_star(source, "at", ["base", "quote"], ["rate"], previous, **options)


def key(minute, day=1):
    return 202401000000 + day * 10000 + 1000 + minute


def test_full_then_incremental(spark):
    star = build(rates(spark, ("E", "U", 1.0, at(1, 5)), ("E", "U", 1.5, at(1, 50)), ("E", "J", 2.0, at(2))))
    assert rows(star.dim_date) == [(key(1), at(1)), (key(2), at(2))]
    assert rows(star.fact) == [(key(1), "E", "U", 1.5), (key(2), "E", "J", 2.0)]
    # late row ignored, same-minute row replaced, new row added
    batch = rates(spark, ("E", "X", 9.0, at(0)), ("E", "J", 3.0, at(2, 30)), ("E", "J", 4.0, at(5)))
    more = build(batch, star)
    assert rows(more.dim_date) == [(key(1), at(1)), (key(2), at(2)), (key(5), at(5))]
    assert rows(more.fact) == [(key(1), "E", "U", 1.5), (key(2), "E", "J", 3.0), (key(5), "E", "J", 4.0)]
    again = build(batch, more)
    assert rows(again.fact) == rows(more.fact) and rows(again.dim_date) == rows(more.dim_date)


def test_refresh_forgets_and_empty_target_loads(spark):
    old = build(rates(spark, ("E", "U", 1.0, at(1))))
    new = rates(spark, ("E", "U", 2.0, at(0)))
    assert rows(build(new, old).fact) == [(key(1), "E", "U", 1.0)]
    assert rows(build(new, old, full_refresh=True).fact) == [(key(0), "E", "U", 2.0)]
    empty = P.Star(old.dim_date.filter("false"), old.fact.filter("false"))
    assert rows(build(new, empty).fact) == [(key(0), "E", "U", 2.0)]


def test_null_time_and_missing_member(spark):
    source = rates(spark, ("E", "U", 1.0, None), ("E", "U", 2.0, at(3)), ("E", "J", 2.0, at(4)))
    star = build(source)
    assert (None, "E", "U", 1.0) in rows(star.fact)
    assert (None, None) in rows(star.dim_date)
    partial = star.dim_date.filter(F.col("date") == at(3))
    fact = I.incremental_fact(source, partial, None, "at", ["base", "quote"], ["rate"])
    assert rows(fact) == sorted([(key(3), "E", "U", 2.0), (None, "E", "J", 2.0), (None, "E", "U", 1.0)], key=str)


def test_not_strict_keeps_every_row(spark):
    source = rates(spark, ("E", "U", 1.0, at(1, 5)), ("E", "U", 1.5, at(1, 50)))
    assert build(source, strict=False).fact.count() == 2


def test_upsert(spark):
    target = spark.createDataFrame([(1, "a", "old"), (2, "b", "old"), (None, "c", "old")], "k int, j string, v string")
    new = spark.createDataFrame([(1, "a", "new"), (1, "a", "newer"), (3, "b", "new"), (None, "c", "new")], "k int, j string, v string")
    want = sorted([(1, "a", "newer"), (2, "b", "old"), (3, "b", "new"), (None, "c", "new"), (None, "c", "old")], key=str)
    once = I.upsert_delete_insert(target, new, ["k", "j"])
    assert rows(once) == want
    solid = new.filter("k is not null")
    first = I.upsert_delete_insert(target, solid, ["k", "j"])
    assert rows(I.upsert_delete_insert(first, solid, ["k", "j"])) == rows(first)
    assert I.upsert_delete_insert(target, new, ["k", "j"], strict=False).count() == 6


def test_upsert_partitions_rewrites_only_what_it_touches(spark, tmp_path):
    path = str(tmp_path / "fact")
    old = spark.createDataFrame([(d, k, "old") for d in (1, 2, 3) for k in range(4)], "day int, k int, v string")
    K.write_layer(old, path, partition_by=["day"])
    before = {p.name for p in (tmp_path / "fact").glob("day=*/*.parquet")}
    new = spark.createDataFrame([(1, 0, "new"), (3, 9, "new"), (4, 1, "new")], "day int, k int, v string")
    for _ in range(2):
        K.upsert_partitions(spark, path, new, ["day", "k"], "day")
        got = rows(spark.read.parquet(path).select("day", "k", "v"))
        assert got == sorted([*((d, k, "new" if (d, k) == (1, 0) else "old") for d in (1, 2, 3) for k in range(4)), (3, 9, "new"), (4, 1, "new")], key=str)
    kept = {p.name for p in (tmp_path / "fact").glob("day=2/*.parquet")}
    assert kept and kept <= before


def test_upsert_partitions_keeps_rows_without_a_partition(spark, tmp_path):
    path = str(tmp_path / "fact")
    K.write_layer(spark.createDataFrame([(1, 1, "old"), (None, 1, "old")], "day int, k int, v string"), path, partition_by=["day"])
    K.upsert_partitions(spark, path, spark.createDataFrame([(None, 2, "new")], "day int, k int, v string"), ["day", "k"], "day")
    assert rows(spark.read.parquet(path).select("day", "k", "v")) == sorted([(1, 1, "old"), (None, 1, "old"), (None, 2, "new")], key=str)


def test_stored_star_equals_the_one_in_memory(spark, tmp_path):
    first = rates(spark, ("E", "U", 1.0, at(1, 5)), ("E", "U", 1.5, at(2, 50)), ("E", "J", 2.0, at(2, day=2)), ("E", "J", 2.0, None))
    second = rates(spark, ("E", "X", 9.0, at(0)), ("E", "J", 3.0, at(2, 30, day=2)), ("E", "J", 4.0, at(5, day=3)))
    load = lambda batch, **o: P.load_star(spark, batch, str(tmp_path / "d"), str(tmp_path / "f"), "at", ["base", "quote"], ["rate"], **o)
    load(first)
    memory = build(second, build(first))
    for _ in range(2):
        star = load(second)
        assert rows(star.fact) == rows(memory.fact) and rows(star.dim_date) == rows(memory.dim_date)
    assert rows(load(second, full_refresh=True).fact) == rows(build(second).fact)


def test_cutoff_goes_through_the_dimension(spark):
    dates = I.date_dimension(rates(spark, ("E", "U", 1.0, at(1)), ("E", "U", 1.0, at(9))), "at")
    fact = spark.createDataFrame([(key(1), "E"), (None, "E")], "date_key bigint, base string")
    assert I.fact_cutoff(fact, dates).first()[0] == at(1)
    assert I.fact_cutoff(fact.filter("false"), dates).first()[0] is None


def test_watermark_reaches_the_scan(spark, small):
    events = spark.read.parquet(f"{small}/events.parquet")
    target = I.date_dimension(events.filter("ts < timestamp_ntz '2024-01-20'"), "ts")
    plan = I.incremental_filter(events, "ts", target, "date")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(ts,2024-01-" in plan


def test_star_roles_and_preview(spark):
    star = build(rates(spark, ("E", "U", 1.0, at(1)), ("U", "E", 2.0, at(2))))
    assert rows(S.read_fact(star.fact, star.dim_date)) == [(at(1), "E", "U", 1.0), (at(2), "U", "E", 2.0)]
    names = spark.createDataFrame([("E", "Euro"), ("U", "Dollar")], "code string, name string")
    both = S.star_join(star.fact, S.Role(names, "base", "code", {"base_name": "name"}), S.Role(names, "quote", "code", {"quote_name": "name"}))
    assert rows(both.select("base_name", "quote_name", "rate")) == [("Dollar", "Euro", 2.0), ("Euro", "Dollar", 1.0)]
    assert [r.rate for r in S.preview(star.fact, 1).collect()] == [1.0]


def partitions_read(spark, df):
    """Of the one file scan in a frame's plan, once it has run."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df._jdf.queryExecution().executedPlan()
        plan.executeCollect()
        leaves = plan.collectLeaves()
        scans = [leaves.apply(i) for i in range(leaves.size()) if leaves.apply(i).nodeName().startswith("Scan parquet")]
        return [s.metrics().apply("numPartitions").value() for s in scans]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_upsert_reads_only_the_partitions_it_rewrites(spark, tmp_path):
    path = str(tmp_path / "fact")
    table = spark.range(300).select("id", (F.col("id") % 30).cast("int").alias("day"), F.lit(0).alias("v"))
    table = table.unionByName(spark.range(300, 302).select("id", F.lit(None).cast("int").alias("day"), F.lit(0).alias("v")))
    K.write_layer(table, path, partition_by=["day"])
    new = table.filter("id IN (0, 29)").withColumn("v", F.lit(1))
    stored = spark.read.parquet(path)
    touched = K.touched_partitions(stored, new, "day")
    assert partitions_read(spark, touched) == [2] and touched.count() == 20
    with_null = K.touched_partitions(stored, new.unionByName(table.filter("id = 300")), "day")
    assert partitions_read(spark, with_null) == [3] and with_null.count() == 22
    assert K.touched_partitions(stored, new.filter("false"), "day").count() == 0
    K.upsert_partitions(spark, path, new, ["id"], "day")
    assert rows(spark.read.parquet(path).filter("v = 1").select("id", "day")) == [(0, 0), (29, 29)]
    assert spark.read.parquet(path).count() == 302


def test_lookback_loads_late_rows(spark, tmp_path):
    first = [("E", "U", 1.0, at(1)), ("E", "J", 2.0, at(30))]
    late = [("E", "X", 3.0, at(25)), ("E", "Y", 4.0, at(2)), ("E", "J", 5.0, at(30, 10))]
    star = build(rates(spark, *first))
    again = rates(spark, *first, *late)
    got = build(again, star, lookback=timedelta(minutes=10))
    assert rows(got.fact) == [(key(1), "E", "U", 1.0), (key(25), "E", "X", 3.0), (key(30), "E", "J", 5.0)]
    assert rows(got.dim_date) == [(key(1), at(1)), (key(25), at(25)), (key(30), at(30))]
    whole = build(again, star, lookback=timedelta(hours=1))
    assert rows(whole.fact) == rows(build(again).fact) and rows(whole.dim_date) == rows(build(again).dim_date)
    paths = str(tmp_path / "dim"), str(tmp_path / "fact")
    for batch in (rates(spark, *first), again):
        stored = P.load_star(spark, batch, *paths, "at", ["base", "quote"], ["rate"], lookback=timedelta(hours=1))
    assert rows(stored.fact) == rows(whole.fact)


BATCHED = SCHEMA + ", _batch_id string"


def test_batches_of_any_age_load_once(spark, tmp_path):
    """Every order of batches gives the star of all rows; what is loaded need not be landed any more, and is not loaded twice."""
    import itertools

    data = {
        "b1": [("E", "U", 1.0, at(1, 5)), ("E", "J", 2.0, at(30)), ("E", "X", 7.0, None)],
        "b2": [("E", "U", 1.5, at(1, 50)), ("E", "J", 3.0, at(2, day=2))],
        "b3": [("E", "U", 1.2, at(1, 20)), ("U", "E", 4.0, at(0, day=3)), ("U", "E", 4.5, at(0, day=3))],
    }
    whole = build(rates(spark, *[r for b in data.values() for r in b]))
    for n, order in enumerate(itertools.permutations(data)):
        paths = [str(tmp_path / f"{n}{name}") for name in ("dim", "fact", "ledger")]
        for i, name in enumerate(order):
            landed = [(*r, b) for b in (order[: i + 1] if n % 2 else (name,)) for r in data[b]]
            star = P.load_batches(spark, spark.createDataFrame(landed, BATCHED), *paths, "at", ["base", "quote"], ["rate"])
        assert rows(star.fact) == rows(whole.fact) and rows(star.dim_date) == rows(whole.dim_date)
        if n:
            continue
        files = {p.name for p in (tmp_path / f"{n}fact").rglob("*.parquet")}
        again = P.load_batches(spark, spark.createDataFrame(landed, BATCHED), *paths, "at", ["base", "quote"], ["rate"])
        assert rows(again.fact) == rows(whole.fact) and files == {p.name for p in (tmp_path / f"{n}fact").rglob("*.parquet")}
        assert rows(spark.read.parquet(paths[2])) == [("b1", 3), ("b2", 2), ("b3", 3)]


def test_a_load_reads_only_missing_batches(spark, tmp_path):
    path = str(tmp_path / "landed")
    landed = spark.range(40).select("id", F.concat(F.lit("b"), (F.col("id") % 10).cast("string")).alias("_batch_id"))
    K.write_layer(landed.unionByName(landed.filter("id = 0").withColumn("_batch_id", F.lit(None).cast("string"))), path, partition_by=["_batch_id"])
    ledger = spark.createDataFrame([(f"b{i}", 4) for i in range(8)], "_batch_id string, n_rows bigint")
    missing = I.unloaded(spark.read.parquet(path), ledger)
    assert partitions_read(spark, missing)[0] == 3 and missing.count() == 9  # b8, b9 and the rows without a batch
    assert I.unloaded(landed, None) is landed
    assert rows(I.batch_entries(missing)) == [("b8", 4), ("b9", 4)]


def test_ledger_facts_hold_surrogates(spark, tmp_path):
    history = spark.createDataFrame(
        [("E", at(0), at(10)), ("E", at(10), None)], "code string, valid_from timestamp_ntz, valid_to timestamp_ntz")
    role = S.AsOfRole(history, {"base": "code"}, {"since": "valid_from"})
    paths = [str(tmp_path / name) for name in ("dim", "fact", "ledger")]
    for batch in ([("E", "U", 1.0, at(11), "b2")], [("E", "U", 2.0, at(9), "b1"), ("Z", "U", 2.0, at(9), "b1")]):
        star = P.load_batches(spark, spark.createDataFrame(batch, BATCHED), *paths, "at", ["base", "quote"], ["rate"], histories=[role])
    assert rows(star.fact.select("base", "rate", "since")) == sorted([("E", 1.0, at(10)), ("E", 2.0, at(0)), ("Z", 2.0, None)], key=str)


def test_moving_upsert_leaves_one_row_per_key(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "k int, j int, part string, v int"
    old = [(k, j, "abc"[(k + j) % 3], 0) for k in range(30) for j in range(2)] + [(99, 0, None, 0), (98, 0, "lone", 0)]
    K.write_layer(spark.createDataFrame(old, schema), path, partition_by=["part"])
    new = [(1, 0, "c", 1), (2, 1, "new", 1), (3, 0, "b", 1), (99, 0, "a", 1), (98, 0, "a", 1), (500, 0, "a", 1), (4, 0, None, 1)]
    frame = spark.createDataFrame(new, schema)
    for _ in range(2):
        K.upsert_partitions(spark, path, frame, ["k", "j"], "part", moving=True)
        want = [r for r in old if r[:2] not in {n[:2] for n in new}] + new
        assert rows(spark.read.parquet(path).select("k", "j", "part", "v")) == sorted(want, key=str)
    holding = K.holding_partitions(spark.read.parquet(path), frame, ["k", "j"], "part")
    assert {r[0] for r in holding.collect()} == {"a", "b", "c", "new", None}
    plan = holding._jdf.queryExecution().executedPlan().toString()
    assert "v#" not in plan.split("ReadSchema")[1][:40]


def test_moving_upsert_leaves_other_partitions_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    K.write_layer(spark.createDataFrame([(k, k % 5, 0) for k in range(50)], "k int, part int, v int"), path, partition_by=["part"])
    kept = {p.name for p in (tmp_path / "t").glob("part=[124]/*.parquet")}
    K.upsert_partitions(spark, path, spark.createDataFrame([(3, 0, 1)], "k int, part int, v int"), ["k"], "part", moving=True)
    assert kept and kept == {p.name for p in (tmp_path / "t").glob("part=[124]/*.parquet")}
    assert rows(spark.read.parquet(path).filter("k = 3").select("k", "part", "v")) == [(3, 0, 1)]
