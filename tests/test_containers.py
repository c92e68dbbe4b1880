"""Office documents as files, good and broken ones."""

import io
import zipfile

from millrace.sources import containers, readers
from millrace.plans import registry, registry_all  # noqa: F401

TEXT = "first <line> & é\n\n  two  blanks\ttab\nlast"


def zipped(name, data):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(name, data)
    return out.getvalue()


def test_files_of_all_kinds(spark, tmp_path):
    made = containers.packed(spark.createDataFrame([("a.docx", TEXT), ("b.ODT", TEXT), ("c.txt", TEXT), ("d.docx", ""), ("e.odt", None)], "path string, text string"))
    files = {r.path: bytes(r.content) for r in made.collect()}
    files |= {"f.docx": files["a.docx"][:-30], "g.odt": zipped("other.xml", "x"), "h.docx": zipped("word/document.xml", "<w:p>"), "i.pdf": b"%PDF", "j": b"a\xffb", "sub.dir.md": b"md"}
    word = f'<d xmlns:w="{containers.WORD[1:-1]}"><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/><w:t>c</w:t></w:r></w:p><w:p/></d>'
    text = f'<d xmlns:t="{containers.OPEN[1:-1]}"><t:h>h</t:h><t:p>a<t:s t:c="3"/>b<t:span>c<t:tab/>d</t:span>e<t:line-break/>f</t:p></d>'
    files |= {"l.docx": zipped("word/document.xml", word), "m.odt": zipped("content.xml", text)}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rpartition("/")[2]: (r.text, r.error) for r in containers.read_documents(spark, str(tmp_path)).collect()}
    assert got == {
        "a.docx": (TEXT, None), "b.ODT": (TEXT, None), "c.txt": (TEXT, None), "d.docx": ("", None), "e.odt": ("", None), "f.docx": (None, "broken"), "g.odt": (None, "no text inside"), "h.docx": (None, "broken"),
        "i.pdf": (None, "no reader for pdf"), "j": ("a�b", None), "sub.dir.md": ("md", None), "l.docx": ("a\tb\nc\n", None), "m.odt": ("h\na   bc\tde\nf", None),
    }
    assert containers.extracted(spark.createDataFrame([("x.docx", None)], "path string, content binary")).first().error == "no content"
    assert containers.extracted(spark.createDataFrame([], "path string, content binary")).count() == 0


def test_too_large_a_text(spark, monkeypatch):
    monkeypatch.setattr(containers, "MOST_BYTES", 10)
    try:
        containers.text_of("a.docx", zipped("word/document.xml", "<a>" + "x" * 100 + "</a>"))
    except containers.Unreadable as e:
        assert str(e) == "too large"
    else:
        raise AssertionError


def test_filters_reach_the_database(spark):
    frame = registry.queries()["s3_database_scan"](spark, "/root/testdata/sf0.001")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThan(o_totalprice,150000.0)" in plan.replace("O_TOTALPRICE", "o_totalprice")
    assert frame.rdd.getNumPartitions() == 8
    assert readers.jdbc_table is not None
