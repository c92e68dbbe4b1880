"""Text of office documents: zipped XML of word processors (docx, odt), and plain text; broken files are told apart.

Files come as rows (path, content), as Spark's ``binaryFile`` source gives them, and are read one by one in Arrow batches.

Defined results: the kind of a file is that of its name's ending, in any case; a kind without a reader is an error, and so are a
file that is no container, lacks its text, is broken inside, or would unpack to more than MOST_BYTES; an error gives no
text; other names are texts, whose bytes that are not UTF-8 become replacement characters; null content is an error.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MOST_BYTES = 256 << 20
# Names of the members and elements that hold the text of each kind, and kinds that are not text.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
OPEN = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
MEMBERS = {"docx": "word/document.xml", "odt": "content.xml"}
UNREAD = ("pdf", "png", "jpg", "jpeg", "tiff", "tif")


class Unreadable(Exception):
    """What is wrong with a file."""


def _word(member: io.BufferedIOBase) -> str:
    """Paragraphs as lines; runs of text, tabs and breaks within them."""
    lines: list[str] = []
    line: list[str] = []
    signs = {f"{WORD}tab": "\t", f"{WORD}br": "\n", f"{WORD}cr": "\n"}
    for _, e in ElementTree.iterparse(member):
        if e.tag == f"{WORD}t":
            line.append(e.text or "")
        elif e.tag in signs:
            line.append(signs[e.tag])
        elif e.tag == f"{WORD}p":
            lines.append("".join(line))
            line = []
            e.clear()
    return "\n".join(lines)


def _open(member: io.BufferedIOBase) -> str:
    """Paragraphs and headings as lines; counted blanks, tabs and breaks within them."""

    def inner(e: ElementTree.Element) -> str:
        sign = {f"{OPEN}tab": "\t", f"{OPEN}line-break": "\n"}.get(e.tag, "")
        if e.tag == f"{OPEN}s":
            sign = " " * int(e.get(f"{OPEN}c", "1"))
        return sign + (e.text or "") + "".join(inner(x) + (x.tail or "") for x in e)

    lines = []
    for _, e in ElementTree.iterparse(member):
        if e.tag in (f"{OPEN}p", f"{OPEN}h"):
            lines.append(inner(e))
            e.clear()
    return "\n".join(lines)


def text_of(path: str, content: bytes | None) -> str:
    """The text of one file."""
    kind = path.rpartition("/")[2].rpartition(".")[2].lower() if "." in path.rpartition("/")[2] else ""
    if content is None:
        raise Unreadable("no content")
    if kind in UNREAD:
        raise Unreadable(f"no reader for {kind}")
    if kind not in MEMBERS:
        return content.decode("utf-8", "replace")
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            info = z.getinfo(MEMBERS[kind])
            if info.file_size > MOST_BYTES:
                raise Unreadable("too large")
            with z.open(info) as member:
                return (_word if kind == "docx" else _open)(member)
    except KeyError as e:
        raise Unreadable("no text inside") from e
    except (zipfile.BadZipFile, ElementTree.ParseError, EOFError, OSError, ValueError, NotImplementedError, RuntimeError, RecursionError) as e:
        raise Unreadable("broken") from e
    except Exception as e:  # zlib has an error of its own that is no subclass of these
        if type(e).__name__ != "error":
            raise
        raise Unreadable("broken") from e


def extracted(files: DataFrame) -> DataFrame:
    """(path, text, error) of each row (path, content)."""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one at a time: a small file may hold a long text
                path, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                text = error = None
                try:
                    text = text_of(path or "", content)
                except Unreadable as e:
                    error = str(e)
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([text], pa.string()), pa.array([error], pa.string())], ["path", "text", "error"])

    return files.select("path", "content").mapInArrow(of_task, "path string, text string, error string")


def read_documents(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, text, error) of all files below a folder."""
    return extracted(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path))


def packed(documents: DataFrame) -> DataFrame:
    """(path, content): rows (path, text) as files of their names' kinds, a line of a text as a paragraph."""
    from xml.sax.saxutils import escape

    def container(path: str, text: str) -> bytes:
        kind = path.rpartition(".")[2].lower()
        if kind not in MEMBERS:
            return text.encode()
        lines = [escape(x) for x in text.split("\n")]
        if kind == "docx":
            body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{x}</w:t></w:r></w:p>' for x in lines)
            xml = f'<w:document xmlns:w="{WORD[1:-1]}"><w:body>{body}</w:body></w:document>'
        else:
            body = "".join(f"<text:p>{x}</text:p>" for x in lines)
            xml = f'<o:document xmlns:o="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="{OPEN[1:-1]}"><o:body>{body}</o:body></o:document>'
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(MEMBERS[kind], '<?xml version="1.0" encoding="UTF-8"?>' + xml)
        return out.getvalue()

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            made = [container(p, t or "") for p, t in zip(paths, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(made, pa.binary())], ["path", "content"])

    return documents.select("path", "text").mapInArrow(of_task, "path string, content binary")
