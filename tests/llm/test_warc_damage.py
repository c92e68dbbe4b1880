"""WARC files with wrong, missing and huge lengths, cut ends, and blocks that hold separators: nothing is lost."""

import gzip

import pytest

from millrace.llm import warc


def record(kind, block, length=None, **fields):
    head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in fields.items())
    size = "" if length == "" else f"Content-Length: {len(block) if length is None else length}\r\n"
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\n{head}{size}\r\n".encode() + block + b"\r\n\r\n"


def response(i, body=b"", length=None):
    return record("response", b"HTTP/1.1 200 OK\r\n\r\n" + (body or f"body {i}".encode()), length, WARC_Record_ID=f"<{i}>")


INNER = b"a\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <inner>\r\nContent-Length: 3\r\n\r\nxyz\r\n\r\nWARC/1.1 b"
CASES = {
    "too long": ([response(1), response(2, length=500), response(3), response(4)], {"<2>": "length"}),
    "far too long": ([response(1), response(2, length=10**15), response(3), response(4)], {"<2>": "length"}),
    "no number": ([response(1), response(2, length="many"), response(3)], {"<2>": "no length"}),
    "negative": ([response(1), response(2, length=-4), response(3)], {"<2>": "no length"}),
    "missing": ([response(1), response(2, length=""), response(3)], {"<2>": "no length"}),
    "too short": ([response(1), response(2, length=5), response(3)], {"<2>": "length"}),
    "cut end": ([response(1), response(2, b"z" * 300)[:-150]], {"<2>": "truncated"}),
    "separators inside": ([response(1), response(2, INNER), response(3)], {}),
    "last one holds separators": ([response(1), response(2, INNER)], {}),
    "too long at the end": ([response(1), response(2, length=900)], {"<2>": "truncated"}),
    "two in a row": ([response(1, length=10**6), response(2, length=10**6), response(3)], {"<1>": "length", "<2>": "length"}),
}
HEAD = b"HTTP/1.1 200 OK\r\n\r\n"


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("zipped", [False, True])
def test_damage(spark, tmp_path, name, zipped):
    records, damaged = CASES[name]
    data = b"".join([record("warcinfo", b"software: x"), *records])
    (tmp_path / ("x.warc.gz" if zipped else "x.warc")).write_bytes(gzip.compress(data) if zipped else data)
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    got = {r.record_id: r for r in rows}
    assert sorted(got) == [f"<{i}>" for i in range(1, len(records) + 1)] and len(rows) == len(records)
    assert {k: r.damage for k, r in got.items() if r.damage} == damaged
    for i, r in enumerate(records, 1):
        whole = r.partition(b"\r\n\r\n")[2].removeprefix(HEAD)
        assert bytes(got[f"<{i}>"].payload).rstrip(b"\r\n") == whole.rstrip(b"\r\n")


def test_a_block_across_splits(spark, tmp_path):
    """Uncompressed files are cut into splits anywhere, within blocks that hold separators and records too."""
    records = [response(i, INNER * (1 + i % 3) + b"x" * (i * 37 % 900)) for i in range(200)]
    (tmp_path / "x.warc").write_bytes(b"".join(records))
    (tmp_path / "y.warc.gz").write_bytes(gzip.compress(response(1000)))
    (tmp_path / "buzz").write_bytes(response(1001))
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "4096")
    try:
        frame = warc.read_warc(spark, str(tmp_path))
        got = {r.record_id: r for r in frame.collect()}
    finally:
        spark.conf.set(name, before)
    assert len(got) == 202 and not any(r.damage for r in got.values())
    for i, r in enumerate(records):
        assert bytes(got[f"<{i}>"].payload) == r.partition(b"\r\n\r\n")[2].removeprefix(HEAD)[:-4]


def test_stray_bytes_are_told():
    made = [*warc.parsed(iter([b"garbage", b"0\r\nWARC-Type: x\r\nContent-Length: 2\r\n\r\nab", b"more garbage", b"0\r\nWARC-Type: x\r\nContent-Length: 2\r\n\r\ncd\r\n\r\n"]))]
    assert [(b, d) for _, b, d in made] == [(b"garbage", "stray"), (b"ab", None), (b"more garbage", "stray"), (b"cd", None)]


def test_a_wrong_length_is_given_up_after_a_bound(monkeypatch):
    monkeypatch.setattr(warc, "HELD_BYTES", 1000)
    one = b"0\r\nWARC-Type: x\r\nContent-Length: 100\r\n\r\n" + b"c" * 100
    seen = []

    def rows():
        yield b"0\r\nWARC-Type: x\r\nContent-Length: 999999\r\n\r\nab"
        for i in range(100):
            seen.append(i)
            yield one

    made = warc.parsed(rows())
    assert next(made)[1:] == (b"ab", "length") and len(seen) < 12
    assert [d for _, _, d in made] == [None] * 100
