"""Native operators: mixing and sharding."""

import zlib

from siltstone.llm import mixing, sharding


def water(sizes, weights, epochs=3):
    whole, caps = sum(sizes.values()), {s: epochs * n for s, n in sizes.items()}
    capped = set()
    while True:
        rest = whole - sum(caps[s] for s in capped)
        spread = sum(w for s, w in weights.items() if s not in capped)
        over = {s for s in sizes if s not in capped and spread and weights[s] * rest / spread > caps[s]}
        if not over:
            return {s: caps[s] if s in capped else weights[s] * rest / spread if spread else 0 for s in sizes}
        capped |= over


def test_targets_by_rounds(documents):
    counts = {"a": 50, "b": 3, "c": 1, "d": 400, None: 20, "é": 0}
    rows = [(i * 10 + j, "w " * n, None, s) for i, (s, n) in enumerate(counts.items()) for j in range(1)]
    order = sorted((s for s in counts if s is not None), key=lambda s: s.encode()) + [None]
    wanted = water(counts, {s: 1 + i % 3 for i, s in enumerate(order)})
    df = documents(rows)
    sizes = df.select("source", df["doc_id"].alias("key"), mixing.word_count(df["text"]).alias("size"))
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    assert got.keys() == wanted.keys()
    assert all(abs(got[s] - wanted[s]) < 1e-9 for s in wanted)


def test_taken_comes_near_targets_and_repeats(spark, small):
    first, second = (sorted(map(tuple, mixing.op9_capped_mix(spark, small).collect())) for _ in range(2))
    assert first == second
    sources = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got, wanted, largest = {}, {}, {}
    for doc, size, _, target, taken in first:
        assert taken % max(size, 1) == 0 and taken <= 3 * size
        s = sources[doc]
        got[s], wanted[s], largest[s] = got.get(s, 0) + taken, target, max(largest.get(s, 0), size)
    assert all(abs(got[s] - wanted[s]) <= largest[s] for s in got)


def test_rows_without_an_id_or_sharing_one_come_near_targets(spark, documents, tmp_path):
    rows = [(None if i % 2 else 7, f"w{i} x y z", None, "abc"[i % 3]) for i in range(3000)] + [(5, None, None, "a"), (6, "v " * 20_000, None, "b")]
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    taken, target, largest = {}, {}, {}
    got = mixing.op9_capped_mix(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        s = r["source_size"], r["target"]
        taken[s], target[s], largest[s] = taken.get(s, 0) + r["taken"], r["target"], max(largest.get(s, 0), r["size"])
        assert r["taken"] <= 3 * r["size"]
    assert all(abs(taken[s] - target[s]) <= max(largest[s], 40) for s in taken)


def test_mixed_rows(documents):
    docs = documents([(1, "a b c", None, "x"), (1, "a b c", None, "x"), (2, None, None, None), (None, "d", None, "y")]).selectExpr("*", "1 AS copies", "2 AS cut", "3 AS row")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert {tuple(r) for r in out.collect()} <= {tuple(r) for r in docs.collect()}
    assert mixing.mixed(documents([])).count() == 0
    assert mixing.mixed(documents([(1, "", None, "x"), (2, None, None, "y")])).count() in (0, 2)


def test_shards(spark, documents):
    long = "x" * 300
    rows = [(i, long if i % 3 else "é" * (i % 50)) for i in range(400)] + [(7, long)] * 50 + [(None, None), (5, None)]
    docs = documents(rows).selectExpr("doc_id", "coalesce(octet_length(text), 0) + 1 AS size")
    got = sharding.balanced(docs, ["doc_id", "size"], "size").collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(d), len((t or "").encode()) + 1) for d, t in rows)
    total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
    ends = []
    for shard in range(8):
        mine = [r for r in got if r["shard"] == shard]
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
        assert abs(sum(r["size"] for r in mine) - total / 8) <= largest
        ids = [r["doc_id"] if r["doc_id"] is not None else -1 for r in sorted(mine, key=lambda r: r["slot"])]
        assert ids == sorted(ids)
        ends += [ids[0], ids[-1]]
    assert ends == sorted(ends)
    assert sharding.balanced(docs.limit(0), ["doc_id", "size"], "size").count() == 0


def test_shards_of_the_driver(spark, small, prose):
    got = {r["doc_id"]: r for r in sharding.op7_byte_shards(spark, small).collect()}
    for doc, text, *_ in prose:
        raw = (text or "").encode()
        assert (got[doc]["size"], got[doc]["text_crc32"], got[doc]["law"], got[doc]["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
