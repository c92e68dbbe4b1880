"""Detection and overlaps over all documents against plain Python."""

import re

from pyspark.sql import functions as F

from millrace.operators import privacy

SF = "/root/testdata/sf0.01"


def found(text, patterns):
    out = []
    for rule, (category, regex) in enumerate(patterns):
        plain = re.compile(regex.replace("(?iU)", "(?i)").replace("(?U)", ""))
        out += [(m.start(), m.end(), category, m[0], rule) for m in plain.finditer(text or "") if m[0]]
    return out


def resolved(spans):
    kept = []
    for s in sorted(spans, key=lambda s: (s[0] - s[1], s[0], s[4])):
        if all(s[0] >= k[1] or s[1] <= k[0] for k in kept):
            kept.append(s)
    return sorted(kept)


def test_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    patterns = privacy.LEGAL + privacy.STRUCTURED
    spans = privacy.detect(F.col("text"), patterns)
    rows = docs.select("doc_id", "text", spans.alias("all"), privacy.dedup(spans).alias("kept")).collect()
    some = 0
    for r in rows:
        want = found(r.text, patterns)
        assert sorted(map(tuple, r["all"])) == sorted(want), r.doc_id
        assert [tuple(x) for x in r["kept"]] == resolved(want), r.doc_id
        some += len(want)
    assert some > 20
