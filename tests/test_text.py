import re
import subprocess
import sys

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle
from pyspark.sql import functions as F

from siltstone.functions import cleaning, text as X
from siltstone.operators import validation as VAL

CASES = [
    (None, None),
    ("", None),
    ("  ", None),
    (" ", None),
    ("​", None),
    ("&nbsp;x&nbsp;", "x"),
    ("&amp;lt;", "&lt;"),
    ("a\r\nb", "a b"),
    ("a\rb", "ab"),
    ("a​b", "ab"),
    ("a﻿b", "ab"),
    ("a\x85b", "a\x85b"),
    ("a\x85\x85b", "a b"),
    ("a　　b", "a b"),
    ("ﬁ①Ａ", "fi1A"),
    ("&#128;", "€"),
    ("&apos;", "'"),
    ("&amp", "&"),
    ("plain", "plain"),
    (" padded  twice ", "padded twice"),
    ("tab\there", "tab here"),
    ("\x00bell\x07\x7f", "bell"),
    ("\x0bonly\x0c", "only"),
    ("\n \t", None),
    ("&", "&"),
    ("café", "café"),
]


#: Characters that no clean text has.
REMOVED = "[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\t\n\r\u200b-\u200f\u202a-\u202e\ufeff]"

tricky = st.text(st.sampled_from("ab \t\n\r\x00\x0b\x0c\x1c\x1f\x7f\x85   ​‪﻿　ﬁ &;#nbspampl128t"))


@settings(max_examples=1000, deadline=None)
@given(st.one_of(tricky, st.text()))
def test_nothing_unwanted_is_left(s):
    done = cleaning.clean_text(s)
    assert done is None or done and done == done.strip() and not re.search(REMOVED, done) and not re.search(r"\s{2}", done)


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from("abÄé \t\n\r")))
def test_plain_text_keeps_its_words_and_stays_as_it_is_once_clean(s):
    done = cleaning.clean_text(s)
    assert cleaning.clean_text(done) == done
    assert (done or "").split() == s.replace("\r", "").split()


def test_clean_expression(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(CASES)], "id int, s string")
    got = {r.id: r.s for r in VAL.clean_strings(df, ["s"]).collect()}
    assert got == {i: want for i, (_, want) in enumerate(CASES)}


def test_clean_expression_equals_function_on_odd_text(spark):
    odd = [a + b + c for a in ("", " ", "x", "&lt;") for b in ("\n", "\r", " ", "  ", "​​", "\x1f", "\x85 ")
           for c in ("", " ", "y", "\t\t", "﻿", "&#32;", " ")]
    df = spark.createDataFrame([(s,) for s in odd], "s string").withColumn("t", F.col("s"))
    for row in VAL.clean_strings(df, ["t"]).collect():
        assert row.t == cleaning.clean_text(row.s), repr(row.s)


def test_clean_strings_defaults(spark):
    df = spark.createDataFrame([(" a ", " b ", 1)], "s string, _batch_id string, n int")
    assert VAL.clean_strings(df).first() == ("a", " b ", 1)
    assert VAL.clean_strings(df, ["s", "absent"]).first() == ("a", " b ", 1)
    empty = VAL.clean_strings(df.filter("n = 2"))
    assert empty.columns == df.columns and empty.count() == 0


def test_blank_and_padding(spark):
    df = spark.createDataFrame([("8",), ("1234",), (None,), ("   ",)], "c string")
    assert [r.c for r in VAL.blank_strings_to_null(df).collect()] == ["8", "1234", None, None]
    padded = df.limit(3).select(X.pad_code(F.col("c"), truncate=True).alias("a"), X.pad_code(F.col("c")).alias("b"))
    assert [tuple(r) for r in padded.collect()] == [("008", "008"), ("123", "1234"), (None, None)]


@settings(max_examples=1000, deadline=None)
@given(st.lists(st.one_of(st.none(), tricky, st.text(), st.text(st.sampled_from("ab &")))))
def test_batches_equal_single_values(values):
    """Also for the values that are passed over as clean already."""
    assert cleaning.clean_values(pa.array(values, pa.string())).to_pylist() == [cleaning.clean_text(v) for v in values]


def test_cleaning_is_evaluated_once_however_rows_are_split(spark):
    df = spark.range(3).select(F.col("id").cast("string").alias("s"))
    annotated = VAL.validate(VAL.clean_strings(df, ["s"]), {"s": {"required": True, "length": 1}})
    for part in VAL.split_quarantine(annotated):
        assert part._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_executors_need_no_copy_of_the_package(tmp_path):
    (tmp_path / "udf").write_bytes(cloudpickle.dumps(cleaning.clean_values))
    code = ("import pickle, pyarrow as pa; f = pickle.load(open('udf', 'rb'));"
            "print(f(pa.array(['&lt; ', None, '\\ufb01', ' '])).to_pylist())")
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.stdout.strip() == "['<', None, 'fi', None]", done.stderr
