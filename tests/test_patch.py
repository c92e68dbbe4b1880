"""Patches, Markdown, the service and its plug-ins."""

import pytest
from pyspark.sql import functions as F

from millrace import api
from millrace.functions import markdown, patch
from millrace.operators import privacy

FILE = "one\ntwo \n  three\nfour\n“five”\n"


def wrapped(body):
    return f"*** Begin Patch\n{body}\n*** End Patch"


def test_find_lines_by_looser_looks():
    lines = FILE.split("\n")
    assert patch.find_lines(lines, ["two "]) == 1 and patch.find_lines(lines, ["two"]) == 1
    assert patch.find_lines(lines, ["three", "four"]) == 2 and patch.find_lines(lines, ['"five"']) == 4
    assert patch.find_lines(lines, ["six"]) == -1 and patch.find_lines(lines, []) == -1
    assert patch.find_lines(["a", "b", "a"], ["a"], 0, at_end=True) == 2 and patch.find_lines(["a", "b"], ["a"], 1) == -1


def test_parse():
    text = wrapped("*** Add File: a.txt\n+x\n+\n+y\n*** Delete File: b\n*** Update File: c\n*** Move to: d\n@@ ctx\n-old\n+new\n keep\n*** End of File\n*** Update File:\n")
    got = patch.parse_patch(f"cat <<'EOF'\n{text}\nEOF")
    assert [(h.kind, h.path, h.move, h.content) for h in got] == [("add", "a.txt", None, "x\n\ny"), ("delete", "b", None, None), ("update", "c", "d", None)]
    assert (got[2].changes[0].context, got[2].changes[0].old, got[2].changes[0].new) == ("ctx", ["old", "keep"], ["new", "keep"])
    with pytest.raises(ValueError):
        patch.parse_patch("*** Begin Patch")


def test_apply(spark):
    cases = [
        ("@@\n-two\n+2\n@@ four\n-\"five\"\n+5", "one\n2\n  three\nfour\n5\n", None),
        ("@@\n+six", FILE + "six\n", None),
        ("@@\n-four\n-\n+4", "one\ntwo \n  three\n4\n“five”\n", None),
        ("@@\n-nine\n+4", None, "expected lines are not there"),
        ("@@ nowhere\n-one", None, "no context 'nowhere'"),
        ("@@\n one\n-two \n+deux\n", "one\ndeux\n  three\nfour\n“five”\n", None),
    ]
    rows = [(i, FILE, "f", wrapped("*** Update File: f\n" + body)) for i, (body, _, _) in enumerate(cases)]
    rows += [(10, FILE, "f", wrapped("*** Delete File: f")), (11, FILE, "g", wrapped("*** Delete File: f")), (12, None, "f", wrapped("*** Add File: f\n+x")), (13, FILE, "f", None)]
    df = spark.createDataFrame(rows, "i int, c string, p string, t string")
    got = {r.i: r.r for r in df.select("i", patch.applied(F.col("c"), F.col("p"), F.col("t")).alias("r")).collect()}
    for i, (_, want, error) in enumerate(cases):
        assert (got[i].content, got[i].error) == (want or FILE, error)
    assert got[10].content is None and got[11].content == FILE and got[12].content == "x" and got[13].error
    counted = df.select("i", F.size(patch.hunks(F.col("t"))).alias("n")).collect()
    assert {r.i: r.n for r in counted}[0] == 1


def test_markdown(spark):
    html = "<h2>A <em>b</em></h2><script>x</script><p>one <b>two</b>\n three<br>four</p><ul><li>x</li><li>y <a href='u'>z</a></li></ul><pre>a\n  b</pre><hr>&amp;"
    want = "## A *b*\n\none **two** three  \nfour\n\n-   x\n-   y [z](u)\n\n```\na\n  b\n```\n\n---\n\n&"
    assert markdown.to_markdown(html) == want
    assert spark.createDataFrame([(html,), (None,)], "h string").select(markdown.markdown(F.col("h"))).collect()[1][0] is None


def test_service(spark):
    docs = spark.createDataFrame([(1, "write to a@b.org now"), (2, "nothing here"), (3, None)], "doc_id long, text string")
    seen = []
    s = api.Service(spark, patterns=privacy.STRUCTURED[:1], hooks=[lambda t, df: seen.append(t) or df, lambda t, df: df.withColumn("tool", F.lit(t))])
    with pytest.raises(LookupError):
        s.search("x")
    answers = {r.doc_id: r for r in s.ingest(docs).collect()}
    assert answers[1].pii_count == 1 and answers[1].risk == "medium" and answers[2].explanation == "No PII detected" and answers[1].tool == "ingest"
    assert [r.doc_id for r in s.search("CONTACT_1").collect()] == [1]
    with pytest.raises(LookupError):
        s.delete(spark.createDataFrame([(9,)], "doc_id long"))
    assert s.delete(spark.createDataFrame([(1,)], "doc_id long")).count() == 1
    assert s.search("CONTACT_1").count() == 0 and s.audit("ingest").count() == 3 and s.audit().count() == 4
    back = {r.doc_id: r.text for r in s.deanonymize(s.anonymize(docs)).collect()}
    assert back[1] == "write to a@b.org now" and "search" in seen
    with pytest.raises(ValueError):
        s.audit("drop")


def test_plug_ins(spark):
    custom = spark.createDataFrame([("case", "JurisRef", r"\bRG \d+", True), ("off", "Per", "x", False)], "name string, category string, regex string, enabled boolean")
    patterns = api.patterns_of(custom)
    assert patterns == (("JurisRef", r"\bRG \d+"),)
    docs = spark.createDataFrame([(1, "see RG 12")], "doc_id long, text string")
    assert privacy.anonymize(docs, "max", patterns).first().pii_count == 1
    with pytest.raises(ValueError):
        api.patterns_of(spark.createDataFrame([("bad", "Per", "(")], "name string, category string, regex string"))

    import pandas as pd

    def twice(x: pd.Series) -> pd.Series:
        return x * 2

    api.tool(spark, "twice", "long")(twice)
    assert spark.sql("select twice(21) n").first().n == 42
    step = api.chained(lambda df: df.withColumn("a", F.lit(1)), lambda df: df.withColumn("b", F.col("a") + 1))
    assert step(docs).first().b == 2
    assert docs.select(F.size(api.detector("Per", "RG")(F.col("text")))).first()[0] == 1
