"""Inexact block replacement."""

import pytest
from pyspark.sql import functions as F

from millrace.functions.replace import distance, replace_block, replaced

TEXT = "def f():\n    a = 1\n    b  =  2\n    return a\n\ndef g():\n    return 2\n"


@pytest.mark.parametrize(
    "find,new,want",
    [
        ("a = 1", "a = 9", TEXT.replace("a = 1", "a = 9")),
        ("a = 1\nb  =  2", "X", TEXT.replace("    a = 1\n    b  =  2", "X")),
        ("    b = 2", "    c", TEXT.replace("    b  =  2", "    c")),
        ("def g():\\n    return 2", "pass", TEXT.replace("def g():\n    return 2", "pass")),
        ("def f():\n    a = 0\n    b  =  3\n    return a", "Y", TEXT.replace("def f():\n    a = 1\n    b  =  2\n    return a", "Y")),
    ],
)
def test_finds_blocks(find, new, want):
    assert replace_block(TEXT, find, new) == (want, None)


def test_errors():
    assert replace_block("x", "x", "x") == (None, "identical")
    assert replace_block("x y", "z", "q") == (None, "not found")
    assert replace_block("x x", "x", "q") == (None, "multiple")
    assert replace_block("x x", "x", "q", everywhere=True) == ("q q", None)
    assert distance("", "abc") == 3 and distance("kitten", "sitting") == 3


def test_column(spark):
    rows = spark.createDataFrame([("a b", "b", "c"), (None, "b", "c")], "t string, f string, n string")
    got = rows.select(replaced(F.col("t"), F.col("f"), F.col("n")).alias("r")).collect()
    assert [(r.r.text, r.r.error) for r in got] == [("a c", None), (None, "not found")]
