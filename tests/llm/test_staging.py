"""What staged tables leave on disk."""

import glob
import os
import tempfile

from pyspark.sql import functions as F

from siltstone.llm import common, lines


def shuffled(spark):
    root = spark.conf.get("spark.local.dir", None) or tempfile.gettempdir()
    return set(glob.glob(f"{root}/**/blockmgr-*/*/shuffle_*", recursive=True) + glob.glob(f"{root}/blockmgr-*/*/shuffle_*"))


def test_a_staged_table_leaves_no_shuffle(spark):
    before, setting = shuffled(spark), spark.conf.get(common._DROP_SHUFFLES)
    made = common.staged(spark.range(5000, numPartitions=3).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    left = shuffled(spark) - before
    assert sorted(r["count"] for r in made.collect()) == [714] * 5 + [715] * 2
    assert not left and spark.conf.get(common._DROP_SHUFFLES) == setting


def test_candidates_are_staged_once(documents, monkeypatch):
    labels, real = [], lines.staged
    monkeypatch.setattr(lines, "staged", lambda df, label, codec=None: labels.append(label) or real(df, label, codec))
    base = "a line that is long enough to be edited, and then some more of it"
    docs = documents([(1, base), (2, base.replace("long", "lung")), (3, base.replace("more", "mort")), (4, "another line that stands quite alone here")])
    got = {r["doc_id"]: r["n_near"] for r in lines.cleaned(docs).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 0}
    assert "shared" not in labels and labels.count("asked") == labels.count("told") == 1


def folder(spark):
    root = (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).removeprefix("file:")
    return f"{root.rstrip('/')}/siltstone-llm"


def tables(spark):
    return set(os.listdir(folder(spark))) if os.path.isdir(folder(spark)) else set()


def test_what_is_staged_in_passing_goes_but_for_what_is_kept(spark):
    before = tables(spark)
    with common.passing() as outer:
        with common.passing() as inner:
            common.staged(spark.range(3), "gone")
            kept = inner.keep(common.staged(spark.range(5), "kept"))
            also = inner.keep(common.staged(spark.range(7), "also"))
        assert kept.count() == 5 and {x.split("-")[0] for x in tables(spark) - before} == {"kept", "also"}
        outer.keep(kept)
    assert kept.count() == 5 and {x.split("-")[0] for x in tables(spark) - before} == {"kept"}
    assert also.schema == kept.schema
    common.staged(spark.range(2), "alone")
    assert {x.split("-")[0] for x in tables(spark) - before} == {"kept", "alone"}


def test_lines_leave_one_table(spark, documents):
    before, batch = tables(spark), spark.conf.get(lines._BATCH_BYTES[0])
    base = "a line that is long enough to be edited, and then some more of it"
    docs = documents([(1, base), (2, base.replace("long", "lung")), (3, base), (4, "another line that stands quite alone here")])
    done = lines.cleaned(docs)
    assert {x.split("-")[0] for x in tables(spark) - before} == {"repeats"}
    assert {r["doc_id"]: (r["n_exact"], r["n_near"]) for r in done.collect()} == {1: (0, 0), 2: (0, 1), 3: (1, 0), 4: (0, 0)}
    assert spark.conf.get(lines._BATCH_BYTES[0]) == batch


def test_lines_are_sought_in_batches_bounded_in_bytes(documents, monkeypatch):
    """Filters are sent apart from the code of tasks, and no task holds more texts at once than the setting says."""
    seen, real = [], lines.staged

    def noted(df, label, codec=None):
        seen.append((label, df.sparkSession.conf.get(lines._BATCH_BYTES[0])))
        return real(df, label, codec)

    monkeypatch.setattr(lines, "staged", noted)
    lines.repeats(documents([(1, "a line that is long enough to be edited"), (2, "a line that is lung enough to be edited")]))
    assert {size for label, size in seen if label in ("asked", "told", "marks")} == {str(lines._BATCH_BYTES[1])}
