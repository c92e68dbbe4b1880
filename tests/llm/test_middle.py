"""Fill-in-middle against plain Python, and the way back from every output."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import middle

UNITS = {
    "lines": r"[^\n]*\n|[^\n]+",
    "words": r"[^\x20\x09-\x0D]*[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+",
    "characters": r"[\s\S]",
}
TEXTS = [
    None, "", "one", "\n", "\n\n\n", "a\nb", "a\nb\n", "\na\r\nb\n\nc", "<P>", "has <S> in it\nx", "x<M", "<", "ends with <\nS>\n<P\n>", "日本\n😀 é\n", " leading\n\ttab\x0b\x85 x y\n", "w " * 3000, "l\n" * 3000, "$1 \\n \\E (x)\n" * 3,
]


def plain(i, text, units, seed=7, percent=100, spm=50):
    text = text or ""
    us = re.findall(UNITS[units], text)
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(us) + 1) for x in h[:2])
    p, m, s = "".join(us[:a]), "".join(us[a:b]), "".join(us[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return len(us), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(us), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(us), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("units,percent,spm", [("lines", 100, 50), ("words", 60, 0), ("characters", 100, 100)])
def test_against_python(spark, units, percent, spm):
    rows = [(i if i % 11 else None, t, "x", 5) for i, t in enumerate(TEXTS * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n int")
    made = middle.transform(docs, units, 7, percent, spm).withColumn("back", middle.restore(F.col("output"), F.col("form"))).collect()
    got = sorted((str(r.doc_id), r.n, r.form, r.prefix_chars or 0, r.middle_chars or 0, r.output) for r in made)
    want = [plain(i, t, units, 7, percent, spm) for i, t, *_ in rows]
    assert got == sorted((str(r[0]), n, f, p or 0, m or 0, o) for r, (n, f, p, m, o) in zip(rows, want))
    assert all(r.back == (r.text or "") for r in made)


def test_units_give_the_text_back(spark):
    frame = spark.createDataFrame([(t,) for t in TEXTS if t is not None], "text string")
    for grammar in middle.GRAMMARS:
        assert frame.where(F.array_join(middle.units(F.col("text"), grammar), "") != F.col("text")).count() == 0
        assert frame.where(F.exists(middle.units(F.col("text"), grammar), lambda x: x == "")).count() == 0


def test_other_columns_and_no_rows(spark):
    made = middle.transform(spark.createDataFrame([(1, "a\nb", "keep", 2)], "doc_id long, text string, `odd.name` string, output int"))
    assert made.columns == ["doc_id", "text", "odd.name", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert middle.transform(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_markers_that_overlap_are_refused():
    with pytest.raises(ValueError):
        middle.Markers("<P>", "><", "<M>")
    with pytest.raises(ValueError):
        middle.Markers("<P>", "<P>", "<M>")
