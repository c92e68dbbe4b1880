"""Plain text of pages whose hidden elements are not closed."""

import pytest
from pyspark.sql import functions as F

from millrace.llm import warc

PAGES = [
    ("<html><head><title>T</title><body><p>text", "text"),
    ("<html><head><title>use <body> tags</title><meta charset=x></head><body>text", "text"),
    ("<HEAD\n><title>T</title>\n<link rel=a><meta b><p>text", "text"),
    ("<head>plain words<p>text", "plain words\ntext"),
    ("<head><title>T</head><body>text<svg><title>s</title></svg>", "text\ns"),
    ("<head><script>x = '</head>'; y</script></head><body>text", "text"),
    ("<head><style>a</style><script>x = '<body>'</script><title>T</title></head>text", "text"),
    ("<header>one</header><p>two", "one\ntwo"),
    ("one<iframe src=a>two<p>three", "onetwo\nthree"),
    ("one<noscript>no</noscript>two<object>three</object>four<template>five", "one two fourfive"),
    *[(f"one<{tag}>two</p>three", "onetwo\nthree") for tag in warc.HIDDEN[:-1]],
    ("one<!-- two --><script>three</script><script>four</SCRIPT >five", "one five"),
    ("<head>" + "<meta a>\n" * 50_000 + "<title>T</title><body>text", "text"),
    ("<head>" + "<meta a>\n" * 50_000 + "<p>text", "text"),
    (None, ""),
]


@pytest.mark.parametrize("derive", [False, True])
def test_unclosed_elements_keep_the_text(spark, derive):
    frame = spark.createDataFrame([(i, "u", p) for i, (p, _) in enumerate(PAGES)], "page_id long, url string, html string")
    if derive:
        out = warc.derive(warc.responses_of(frame)).where("warc_type = 'conversion'").select("page_id", "block")
    else:
        out = frame.select("page_id", F.coalesce(warc.plain_text(F.col("html")), F.lit("")).alias("block"))
    got = {r.page_id: r.block for r in out.collect()}
    assert [got[i] for i in range(len(PAGES))] == [t for _, t in PAGES]
