"""Derivatives of WARC responses: linked metadata and plain-text conversion records.

Every response gives one ``metadata`` and one ``conversion`` record. Both name the response in ``refers_to``, keep
its target, date and HTTP headers, and carry the digest of its payload's bytes and of their own block. All of it is
one narrow pass of DataFrame functions; only the reader and writer of WARC files handle records in Python, one at a
time. Files hold the source's HTTP headers in fields named SOURCE_FIELD, one for each line.

Defined results: a null payload or header is empty; a payload may be text or bytes, and bytes are read as the charset
of the Content-Type header where that is Latin-1, else as UTF-8 with replacement characters; a payload digest that the
source gives is passed on; a null target stays null and gives a record without a target; repeated responses give
repeated records with the same ids; no responses give no records; further columns of the input are kept on both
records unless they have the name of a result column; an entity that is not known stays as it is.
"""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Iterator
from html.entities import name2codepoint
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Elements without readable text, elements that end a line, and the form of an entity.
HIDDEN = ("script", "style", "noscript", "template", "iframe", "object", "head")
BREAKS = "p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|nav|blockquote|pre|hr|title"
ENTITY = "&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});"
# Characters by name, as HTML 4 has them; a no-break space counts as a blank.
NAMED = {name: " " if code == 160 else chr(code) for name, code in sorted(name2codepoint.items())} | {"apos": "'"}
LATIN = r"(?i)content-type:[^\n]*charset=[\"']?(?:iso-8859-1|latin-?1|windows-1252|us-ascii)\b"
SOURCE_FIELD = "X-Source-HTTP-Header"
SEPARATOR = "\r\n\r\nWARC/1."
#: A record whose length may be wrong is held while so many bytes of what may be further records follow it.
HELD_BYTES = 64 << 20
NOT_GZIPPED = "{*[!z],*[!g]z,*[!.]gz,z,gz}"
WARC_STANDARD = "http://bibnum.bnf.fr/WARC/WARC_ISO_28500_version1_latestdraft.pdf"
RESPONSE = "record_id string, warc_type string, target_uri string, warc_date string, http_headers string, payload binary, payload_digest string, damage string"
ADDED = ("record_id", "warc_type", "refers_to", "target_uri", "warc_date", "content_type", "payload_digest", "block_digest", "content_length", "source_headers", "block")


def uuid_of(*parts: Column) -> Column:
    """A record id that depends on these columns alone, so a task that runs again gives the same id."""
    h = F.md5(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


# A title ends at its end tag and before the end of the head. A head ends at its end tag or where a body begins; with
# neither, it is the elements that stand in a head only. Repeats are possessive, so long pages need no deep stack.
_TITLE = r"<title(?:\s[^>]*)?>[^<]*+(?:<(?!/title|/head)[^<]*+)*+</title\s*>"
_HEAD = (
    rf"<head(?:\s[^>]*)?>(?:[^<]++|{_TITLE}|<(?!/head\s*>|body[\s/>]))*+(?:</head\s*>|(?=<body[\s/>]))"
    rf"|<head(?:\s[^>]*)?>(?:\s++|{_TITLE}|<(?:meta|link|base)(?:\s[^>]*)?>)*+"
)


def decoded(text: Column) -> Column:
    """The text with its entities decoded, each once."""

    def char(e: Column) -> Column:
        number = F.when(F.lower(F.substring(e, 3, 1)) == "x", F.conv(F.substring(e, 4, 7), 16, 10)).otherwise(F.substring(e, 3, 8))
        code = F.regexp_replace(number, ";", "").cast("int")
        valid = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code < 0x110000))
        from_code = F.when(code == 160, " ").when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("\ufffd")
        names = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])
        of_name = F.when(e == "&amp;", "&").otherwise(F.coalesce(F.try_element_at(names, F.regexp_replace(e, "[&;]", "")), e))
        return F.when(F.substring(e, 2, 1) == "#", from_code).otherwise(of_name)

    found = F.transform(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), char)
    joined = F.zip_with(F.split(text, ENTITY), found, lambda gap, c: F.concat(gap, F.coalesce(c, F.lit(""))))
    return F.when(F.contains(text, F.lit("&")), F.array_join(joined, "")).otherwise(text)


def plain_text(html: Column) -> Column:
    """The readable text: hidden elements and comments go, block elements end lines, entities are decoded.

    A hidden element without an end tag loses its tag only. Scripts and styles go first, as they may quote other tags.
    """
    raw, others = "|".join(HIDDEN[:2]), "|".join(HIDDEN[2:-1])
    t = F.regexp_replace(html, rf"(?is)<!--.*?(-->|\z)|<({raw})(\s[^>]*)?>.*?</\2\s*>", " ")
    t = F.regexp_replace(t, rf"(?is)<({others})(\s[^>]*)?>.*?</\1\s*>|{_HEAD}", " ")
    t = F.regexp_replace(t, rf"(?i)</?({BREAKS})(\s[^>]*|/)?>", "\n")
    t = F.regexp_replace(t, r"<[a-zA-Z/!?][^>]*>", "")
    t = F.transform(F.array(t), decoded)[0]
    t = F.regexp_replace(t, r"[ \t\r\f]+", " ")
    t = F.regexp_replace(t, r" ?(\n ?)+", "\n")
    return F.regexp_replace(t, r"^[ \n]+|[ \n]+$", "")


def title(html: Column) -> Column:
    found = F.regexp_extract(html, r"(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>", 1)
    return F.regexp_replace(F.regexp_replace(found, r"[ \t\r\n\f]+", " "), "^ | $", "")


def derive(responses: DataFrame) -> DataFrame:
    """Two records for every row of (record_id, target_uri, warc_date, http_headers, payload), with ``payload_digest`` or without."""
    own = [F.col(f"`{c}`") for c in responses.columns if c not in ADDED and c not in ("http_headers", "payload")]
    headers = F.coalesce("http_headers", F.lit(""))
    if dict(responses.dtypes)["payload"] == "binary":
        raw = F.coalesce("payload", F.lit(b""))
        text = F.when(F.regexp_like(headers, F.lit(LATIN)), F.decode(raw, "ISO-8859-1")).otherwise(F.make_valid_utf8(raw.cast("string")))
    else:
        raw = text = F.coalesce("payload", F.lit(""))
    told = F.col("payload_digest") if "payload_digest" in responses.columns else F.lit(None).cast("string")
    r = responses.select(
        *own,
        F.col("record_id").alias("refers_to"),
        "target_uri",
        "warc_date",
        headers.alias("source_headers"),
        text.alias("__p"),
        F.octet_length(raw).alias("__n"),
        F.coalesce(told, F.concat(F.lit("sha1:"), F.sha1(raw))).alias("payload_digest"),
    )
    status = F.regexp_extract("source_headers", r"^HTTP/[0-9.]+ ([0-9]+)", 1)
    links = F.size(F.regexp_extract_all("__p", F.lit(r"(?i)<a\s[^>]*href"), F.lit(0)))
    fields = F.concat(
        *[F.lit("status: "), status, F.lit("\r\ntitle: "), title(F.col("__p"))],
        *[F.lit("\r\nlinks: "), links.cast("string"), F.lit("\r\npayload-length: ")],
        *[F.col("__n").cast("string"), F.lit("\r\n")],
    )
    both = F.array(
        F.struct(F.lit("metadata").alias("t"), F.lit("application/warc-fields").alias("c"), fields.alias("b")),
        F.struct(F.lit("conversion").alias("t"), F.lit("text/plain").alias("c"), plain_text(F.col("__p")).alias("b")),
    )
    made = r.withColumn("__d", F.explode(both))
    block = F.col("__d.b")
    return made.select(
        *own,
        uuid_of(F.col("refers_to"), F.col("__d.t")).alias("record_id"),
        F.col("__d.t").alias("warc_type"),
        *["refers_to", "target_uri", "warc_date", F.col("__d.c").alias("content_type"), "payload_digest"],
        F.concat(F.lit("sha1:"), F.sha1(block)).alias("block_digest"),
        F.octet_length(block).cast("long").alias("content_length"),
        *["source_headers", block.alias("block")],
    )


def responses_of(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Crawled pages (page_id, url, html) as response records; ``page_id`` stays."""
    size = F.octet_length(F.coalesce("html", F.lit(""))).cast("string")
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n"))
    return pages.select(
        "page_id",
        uuid_of(F.col("page_id"), F.col("url")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("warc_date"),
        headers.alias("http_headers"),
        F.col("html").alias("payload"),
    )


def write_warc(records: DataFrame, path: str) -> None:
    """Write derived records as gzipped WARC files, one for each partition, each with a ``warcinfo`` record at its head."""
    named = (
        ("WARC-Type", F.col("warc_type")),
        ("WARC-Record-ID", F.col("record_id")),
        ("WARC-Refers-To", F.col("refers_to")),
        ("WARC-Target-URI", F.col("target_uri")),
        ("WARC-Date", F.col("warc_date")),
        ("WARC-Payload-Digest", F.col("payload_digest")),
        ("WARC-Block-Digest", F.col("block_digest")),
        ("Content-Type", F.col("content_type")),
    )
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{n}: "), v, F.lit("\r\n"))).otherwise("") for n, v in named]
    given = F.filter(F.split(F.coalesce("source_headers", F.lit("")), r"\r?\n"), lambda x: x != "")
    kept = F.array_join(F.transform(given, lambda x: F.concat(F.lit(f"{SOURCE_FIELD}: "), x, F.lit("\r\n"))), "")
    size = F.concat(F.lit("Content-Length: "), F.col("content_length").cast("string"), F.lit("\r\n\r\n"))
    record = F.concat(F.lit("WARC/1.0\r\n"), *lines, kept, size, F.col("block"))

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = False
        for batch in batches:
            if batch.num_rows and not begun:
                begun = True
                block = f"software: millrace\r\nformat: WARC File Format 1.0\r\nconformsTo: {WARC_STANDARD}\r\n"
                info = f"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\n"
                info += f"Content-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n{block}"
                yield pa.RecordBatch.from_pydict({"value": [info]})
            yield batch

    out = records.select(record.alias("value")).mapInArrow(of_task, "value string")
    out.write.option("compression", "gzip").option("lineSep", "\r\n\r\n").text(path)


def _head(row: bytes) -> tuple[dict, bytes] | None:
    """The headers by lower-cased name and the block behind them, of a row that starts like a record, else null."""
    head, _, block = row.removeprefix(b"WARC/1.").partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    headers: dict = {}
    for line in lines:
        name, _, value = line.partition(b":")
        headers.setdefault(name.decode("latin-1").strip().lower(), []).append(value.decode("utf-8", "replace").strip())
    return (headers, block) if first.isdigit() and "warc-type" in headers else None


class _Record:
    """A record whose rows are read one after the other; ``rows`` holds those after its head, ``other`` the first of them that starts like a record."""

    def __init__(self, headers: dict, block: bytes):
        self.headers, self.blocks, self.rows = headers, [block], []
        self.length, self.other, self.since = len(block), None, 0
        told = headers.get("content-length", [""])[-1]
        self.size = int(told) if told.isascii() and told.isdigit() else None

    def add(self, row: bytes, starts: bool) -> None:
        if starts and self.other is None:
            self.other = len(self.rows)
        self.since += len(row) if self.other is not None else 0
        self.rows.append(row)
        self.blocks.append(row)
        self.length += len(SEPARATOR) + len(row)

    def ended(self) -> bool:
        """Whether the block is as long as it should be; the end of a file may follow it."""
        over = self.length - (self.size if self.size is not None else self.length + 1)
        return over == 0 or 0 < over <= 4 and len(self.blocks[-1]) >= over and not self.blocks[-1][-over:].strip(b"\r\n")

    def block(self) -> bytes:
        return SEPARATOR.encode().join(self.blocks)

    def cut(self) -> tuple[bytes, list[bytes]]:
        """The block up to the row that starts like another record, and the rows from there on."""
        if self.other is None:
            return self.block(), []
        return SEPARATOR.encode().join(self.blocks[: self.other + 1]), self.rows[self.other :]


def parsed(rows: Iterator[bytes]) -> Iterator[tuple[dict, bytes, str | None]]:
    """Records (headers by lower-cased name, block, damage) of the rows of one file, which lie between separators.

    A block that holds separators is put together again until it has its length. If it never does, because it grows too
    long, the file ends, or HELD_BYTES have been read behind a row that starts like a record, the length was wrong: the
    block ends before that row, which is read as the next record. Damage is ``length`` for a wrong one, ``no length`` where
    none is told or it is no number, ``truncated`` at the end of a file, and ``stray`` for bytes that belong to no record.
    Nothing that is read is left out.
    """
    waiting: deque[bytes] = deque()
    open_: _Record | None = None
    more = True
    source = iter(rows)
    while True:
        if not waiting:
            row = next(source, None) if more else None
            if row is None:
                more = False
                if open_ is None:
                    return
                block, rest = open_.cut()
                yield open_.headers, block, "no length" if open_.size is None else "length" if rest else "truncated"
                waiting.extend(rest)
                open_ = None
                continue
            waiting.append(row)
        row = waiting.popleft()
        found = _head(row)
        if open_ is not None and open_.size is None and found:
            yield open_.headers, open_.block(), "no length"
            open_ = None
        if open_ is None:
            if not found:
                if row.strip():
                    yield {}, row, "stray"
                continue
            open_ = _Record(*found)
        else:
            open_.add(row, found is not None)
        if open_.ended():
            yield open_.headers, open_.block()[: open_.size], None
            open_ = None
        elif open_.size is not None and (open_.length > open_.size or open_.since > HELD_BYTES):
            block, rest = open_.cut()
            yield open_.headers, block, "length"
            waiting.extendleft(reversed(rest))
            open_ = None


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """All records of WARC files but ``warcinfo``; a response's block is split into its HTTP headers and its payload's bytes.

    Files are read as text that ends at the start of the next record, so no file has to fit in memory. Spark does not
    split gzipped files. Others may be split within a block, so their rows are dealt by file and put in order again.
    ``damage`` says what is wrong with a record (see ``parsed``), or is null.
    """
    names = [c.split()[0] for c in RESPONSE.split(", ")]

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def made() -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "payload" else pa.string()) for n, c in zip(names, columns, strict=True)], names)

        pairs = ((p, v) for batch in batches for p, v in zip(batch.column("path").to_pylist(), batch.column("value").to_pylist(), strict=True))
        for h, block, damage in (x for _, own in groupby(pairs, lambda p: p[0]) for x in parsed(v for _, v in own)):
            one = {k: v[-1] for k, v in h.items()}
            kind, head = one.get("warc-type"), "".join(f"{x}\r\n" for x in h.get(SOURCE_FIELD.lower(), ()))
            if kind == "warcinfo":
                continue
            if kind == "response":
                start, _, block = block.partition(b"\r\n\r\n")
                head = start.decode("utf-8", "replace") + "\r\n" if start else ""
            told = one.get("warc-payload-digest")
            rows.append((one.get("warc-record-id"), kind, one.get("warc-target-uri"), one.get("warc-date"), head, block, told, damage))
            size += len(block)
            if size > 8 << 20 or len(rows) == 1000:
                yield made()
                rows, size = [], 0
        if rows:
            yield made()

    def lines(glob: str) -> DataFrame:
        text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("lineSep", SEPARATOR).text(path)
        return text.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))

    dealt = lines(NOT_GZIPPED).withColumn("at", F.monotonically_increasing_id()).repartition("path").sortWithinPartitions("path", "start", "at")
    columns = ["path", "value"]
    return lines("*.gz").select(columns).mapInArrow(of_task, RESPONSE).unionByName(dealt.select(columns).mapInArrow(of_task, RESPONSE))
