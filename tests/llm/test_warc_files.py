"""WARC files: bytes and headers that survive the way through files, and entities."""

import gzip
import hashlib
import html

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.llm import queries, warc


def record(kind, block, **fields):
    head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


LATIN = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\nX: 1\r\n\r\n<p>caf\xe9</p>"
BROKEN = b"HTTP/1.1 200 OK\r\n\r\n<p>a\xff</p>\r\n\r\nWARC/1.0\r\n<p>b</p>"


@pytest.mark.parametrize("zipped", [False, True])
def test_bytes_and_headers(spark, tmp_path, zipped):
    info = record("warcinfo", b"software: x\r\n", WARC_Record_ID="<i>")
    records = [
        record("response", LATIN, WARC_Record_ID="<a>", WARC_Target_URI="http://a"),
        record("response", BROKEN, WARC_Record_ID="<b>", WARC_Payload_Digest="sha1:GIVEN"),
        record("request", b"GET / HTTP/1.1\r\n\r\n", WARC_Record_ID="<c>"),
        record("response", b"", WARC_Record_ID="<d>"),
    ]
    data = b"".join(gzip.compress(r) if zipped else r for r in [info, *records])
    path = tmp_path / ("x.warc.gz" if zipped else "x.warc")
    path.write_bytes(data)
    rows = warc.read_warc(spark, str(path))
    got = {r.record_id: r for r in rows.collect()}
    assert {k: bytes(r.payload) for k, r in got.items()} == {
        "<a>": b"<p>caf\xe9</p>",
        "<b>": BROKEN.partition(b"\r\n\r\n")[2],
        "<c>": b"GET / HTTP/1.1\r\n\r\n",
        "<d>": b"",
    }
    out = warc.derive(rows.where("warc_type = 'response'"))
    of = {(r.refers_to, r.warc_type): r for r in out.collect()}
    assert of["<a>", "conversion"].block == "café" and of["<b>", "conversion"].payload_digest == "sha1:GIVEN"
    assert of["<a>", "metadata"].payload_digest == "sha1:" + hashlib.sha1(b"<p>caf\xe9</p>").hexdigest()
    warc.write_warc(out.coalesce(1), str(tmp_path / "out"))
    back = {(r.record_id, r.warc_type): r for r in warc.read_warc(spark, str(tmp_path / "out")).collect()}
    assert len(back) == len(of) == 6
    for r in of.values():
        again = back[r.record_id, r.warc_type]
        assert (bytes(again.payload).decode(), again.http_headers, again.payload_digest) == (r.block, r.source_headers, r.payload_digest)
    heads = [gzip.decompress(f.read_bytes()) for f in (tmp_path / "out").glob("*.gz")]
    assert all(h.startswith(b"WARC/1.0\r\nWARC-Type: warcinfo") for h in heads if h)


CASES = ["a &amp;lt; b", "&copy;&middot;&eacute;&nbsp;x", "&#233;&#xE9;&#X1F600;&#0;&#55296;&#1114112;", "&nothing; &amp &;", "", "no", "&amp;&amp;", "&apos;&quot;&lt;"]


def test_entities(spark):
    frame = spark.createDataFrame([(i, c) for i, c in enumerate(CASES)], "i int, t string")
    got = {r.i: r.x for r in frame.select("i", warc.decoded(F.col("t")).alias("x")).collect()}
    for i, c in enumerate(CASES):
        want = "é" * 2 + "😀" + "�" * 3 if "#233" in c else html.unescape(c).replace("\xa0", " ") if "&nothing" not in c else "&nothing; &amp &;"
        assert got[i] == want, c


def test_sql_agrees_on_entities(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", c) for i, c in enumerate(CASES)], "page_id long, url string, html string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(queries.oracle_sql()["op9_warc_derivatives"]).df()
    got = queries.op9_warc_derivatives(spark, str(tmp_path)).toPandas()
    by = ["page_id", "warc_type"]
    for c in ("block", "block_digest", "record_id"):
        assert got.sort_values(by)[c].tolist() == want.sort_values(by)[c].tolist()
