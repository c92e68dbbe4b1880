"""Sources, sinks, functions, personal data and folds on small literal tables."""

import json
import re

import pytest
from pyspark.sql import functions as F

from millrace.functions import dates, numbers, text
from millrace.operators import billing, privacy
from millrace.sources import readers, sinks, tables
from millrace.streaming import folds


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_json_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert sorted(r.a for r in readers.json_lines(spark, str(tmp_path / "a.json"), "a int").collect()) == [1, 2]
    good, bad = readers.json_lines_with_errors(spark, str(tmp_path / "a.json"), "a int")
    assert sorted(r.a for r in good.collect()) == [1, 2] and [r.bad for r in bad.collect()] == ["not json"]
    (tmp_path / "s/p1").mkdir(parents=True)
    (tmp_path / "s/p1/x.json").write_text('{"t": "one"}')
    (tmp_path / "s/p1/y.json").write_text("{broken")
    good, bad = readers.json_folder(spark, str(tmp_path / "s"), "t string")
    assert [tuple(r) for r in good.collect()] == [("p1", "x", "one")] and bad.count() == 1


def test_tab_separated(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("a\t1\nb\tx\n")
    rows = readers.tab_separated(spark, str(tmp_path / "t.tsv"), {"k": "string", "n": "long"})
    assert sorted(map(tuple, rows.collect())) == [("a", 1), ("b", 0)]


def test_session_round_trip(spark, tmp_path):
    body = {"info": {"id": "s", "title": "T"}, "messages": [{"info": {"id": "m1", "role": "user"}, "parts": [{"id": "p1", "type": "text", "text": "hi"}]}, {"info": {"id": "m2", "role": "assistant"}, "parts": []}]}
    (tmp_path / "e.json").write_text(json.dumps(body))
    frames = readers.session_export(spark, str(tmp_path / "e.json"))
    assert [f.count() for f in frames] == [1, 2, 1]
    assert json.loads(sinks.nested_sessions(*frames).first().body) == body


def test_files(spark, tmp_path):
    for name in ("a.txt", "b.txt", "c.md"):
        (tmp_path / name).write_bytes(b"x\xff" if name == "a.txt" else b"y")
    assert readers.listing(spark, str(tmp_path), "*.txt").count() == 2
    assert readers.listing(spark, str(tmp_path), limit=1).first().path.endswith("a.txt")
    assert "x�" in {r.text for r in readers.whole_texts(spark, str(tmp_path), "*.txt").collect()}


def test_sinks(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, n int")
    new = spark.createDataFrame([(2, "B", 2), (3, "C", 2), (3, "C", 2)], "k int, v string, n int")
    assert sorted((r.k, r.v) for r in sinks.insert_if_absent(t, new, ["k"]).collect()) == [(1, "a"), (2, "b"), (3, "C")]
    assert sorted((r.k, r.v) for r in sinks.upsert(t, new, ["k"], "n").collect()) == [(1, "a"), (2, "B"), (3, "C")]
    assert sorted((r.k, r.n) for r in sinks.increment(t.drop("v"), new.drop("v"), ["k"], ["n"]).collect()) == [(1, 1), (2, 3), (3, 4)]
    gone = sinks.erase({"t": (t, "k")}, spark.createDataFrame([(1,)], "id int"))
    assert [r.k for r in gone["t"].collect()] == [2]
    lists = spark.createDataFrame([(1, ["x", "y"])], "k int, items array<string>")
    held = spark.createDataFrame([(1, 0, "old"), (2, 0, "z")], "k int, position int, item string")
    assert sorted(map(tuple, sinks.replace_set(held, lists, "k", "items").collect())) == [(1, 0, "x"), (1, 1, "y"), (2, 0, "z")]


def test_csv_and_partitioned_json(spark, tmp_path):
    df = spark.createDataFrame([('say "x", y', "m"), ("plain", None)], "t string, model string").withColumn("ts", F.lit("2024-01-02 03:04:05").cast("timestamp"))
    sinks.write_csv(df.select("t"), str(tmp_path / "csv"))
    lines = [x for p in (tmp_path / "csv").glob("*.csv") for x in p.read_text().splitlines()]
    assert '"say ""x"", y"' in lines and "plain" in lines
    sinks.write_by_time(df, str(tmp_path / "dump"), "ts")
    assert [p.parent.name for p in (tmp_path / "dump").rglob("*.json")] == ["h=03"]


def test_sql_shell(spark):
    assert tables.sql(spark, "/root/testdata/sf0.001", "select count(*) n from region").first().n == 5
    with pytest.raises(ValueError):
        tables.sql(spark, "/root/testdata/sf0.001", "drop table region")


@pytest.mark.parametrize(
    "value,want",
    [("1 500 000 €", 1500000.0), ("1.500.000", 1500000.0), ("1,5M€", 1500000.0), ("1.500,50", 1500.5), ("1,500.50", 1500.5), ("2 milliards", 2e9), ("300 k€", 300000.0), ("1,500,000", 1500000.0), ("none", None)],
)
def test_parse_amount(spark, value, want):
    assert one(spark, numbers.parse_amount(F.col("s")), s=value) == want


def test_text_functions(spark):
    assert one(spark, text.like_escape(F.lit("a%_\\"))) == "a\\%\\_\\\\"
    assert one(spark, text.fork_title(F.lit("X (fork #9)"))) == "X (fork #10)"
    assert one(spark, text.unescape(F.lit("a\\\\n\\n"))) == "a\\n\n"
    assert one(spark, text.dedent(F.lit("  a\n    b\n\n  c"))) == "a\n  b\n\nc"
    assert one(spark, text.snippet(F.lit("hay needle hay"), "NEEDLE", 3)) == "…ay needle ha…"
    assert re.match(text.wildcard_regex("git *"), "git") and re.match(text.wildcard_regex("git *"), "git push")
    assert not re.match(text.wildcard_regex("a?c"), "ac")
    assert one(spark, text.key_prefix(F.lit("sk_live_abcdefghijkl_x"))) == "abcdefghij"
    assert one(spark, text.fnv1a_base36(F.lit("hello"))) == _base36(_fnv("hello"))
    assert one(spark, text.hash_bucket(F.lit("abcdef"), 7)) == _bucket("cdef", 7)
    got = one(spark, text.chunks(F.lit(" a b  c d"), 2, 1))
    assert [(c.chunk_idx, c.chunk_offset, c.chunk_text) for c in got] == [(0, 1, "a b  "), (1, 3, "b  c "), (2, 6, "c d"), (3, 8, "d")]


def _fnv(s):
    h = 0x811C9DC5
    for c in s:
        h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
    return h


def _base36(n):
    out = ""
    while n:
        n, r = divmod(n, 36)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + out
    return out


def _bucket(s, n):
    h = 0
    for c in s:
        h = (h * 31 + ord(c)) & 0xFFFFFFFF
    return h % n


def test_dates(spark):
    day = lambda s: F.lit(s).cast("date")
    assert str(one(spark, dates.month_anchor(day("2024-03-30"), day("2023-01-31")))) == "2024-02-29"
    assert str(one(spark, dates.month_anchor(day("2024-03-31"), day("2023-01-31")))) == "2024-03-31"
    assert one(spark, dates.iso_week(F.lit("2027-01-01").cast("timestamp"))) == 202653
    assert str(one(spark, dates.parse_date(F.lit(" 31.12.2023 ")))) == "2023-12-31"
    assert one(spark, dates.parse_date(F.lit("soon"))) is None
    assert one(spark, dates.duration(F.lit(90061))) == "1d 1h"


LEGAL = {
    "Lawyer": "Le dossier de MAÎTRE DUPONT est clos.",
    "Ccn": "Selon la convention collective nationale de Syntec bureaux.",
    "LawRef": "Voir Article L. 1234-5 pour la suite.",
    "Amount": "Le prix est de 1 500 000 € net.",
    "DateRel": "DÉLAI DE 3 MOIS au plus.",
    "OrgForm": "La société SARL existe.",
    "Role": "Le Président signe.",
    "Zone": "En zone urbaine dense.",
}


@pytest.mark.parametrize("category", LEGAL)
def test_legal_patterns(spark, category):
    spans = one(spark, privacy.detect(F.col("s"), privacy.LEGAL), s=LEGAL[category])
    mine = [x for x in spans if x.category == category]
    assert mine and all(LEGAL[category][x.start : x.end] == x.value for x in mine)


def test_dedup_keeps_longest(spark):
    rows = [(0, 5, "A", "x", 0), (3, 12, "B", "y", 1), (12, 14, "C", "z", 2), (3, 12, "D", "y", 3), (20, 21, "E", "w", 4)]
    spans = F.from_json(F.lit(json.dumps([dict(zip(("start", "end", "category", "value", "rule"), r)) for r in rows])), privacy.SPAN)
    assert [x.category for x in one(spark, privacy.dedup(spans))] == ["B", "C", "E"]


def test_treatment_numbers_first_occurrences(spark):
    values = ["Me A", "Me B", "Me A", "Me C", "Me D", "Me E", "Me E"]
    rows = [("s", 10 * i, 10 * i + 4, "Lawyer", v) for i, v in enumerate(values)] + [("s", 90, 94, "Contact", "a@b.c"), ("s", 100, 104, "Role", "DG")]
    frame = spark.createDataFrame(rows, "session string, start int, end int, category string, value string")
    got = [r.replacement for r in privacy.treated(frame, "litige").orderBy("start").collect()]
    assert got == ["Party A", "Party B", "Party A", "Party C", "Party D", "[LAWYER_1]", "[LAWYER_1]", "[CONTACT_1]", "DG"]


def test_relative_dates(spark):
    rows = [("s", i * 10, i * 10 + 9, "DateAbs", v) for i, v in enumerate(["01/02/2024", "2024-02-11", "01.02.2024", "le 3 mai", "31/01/2024"])]
    frame = spark.createDataFrame(rows, "session string, start int, end int, category string, value string")
    got = [r.replacement for r in privacy.treated(frame, "deal").orderBy("start").collect()]
    assert got == ["[DATE_D0]", "[DATE_D+10]", "[DATE_D+0]", "[DATE_1]", "[DATE_D-1]"]


def test_anonymize_and_restore(spark):
    t = "Write to a@b.fr or c@d.org, again a@b.fr."
    docs = spark.createDataFrame([(1, t), (2, None), (3, "clean")], "doc_id long, text string")
    out = {r.doc_id: r for r in privacy.anonymize(docs, "max", privacy.STRUCTURED[:1]).collect()}
    assert out[1].text == "Write to [CONTACT_1] or [CONTACT_2], again [CONTACT_1]." and out[1].pii_count == 3
    assert out[3].text == "clean" and out[3].pii_count == 0 and out[2].text is None
    assert one(spark, privacy.restore(F.col("s"), F.create_map(F.lit("[CONTACT_1]"), F.lit("x"))), s="[CONTACT_1] [CONTACT_9]") == "x [CONTACT_9]"


def test_enterprise_is_never_charged(spark):
    snap = spark.createDataFrame([("t", 202401, 10**9, 10**12, 10**9, 10**12, 10**12, "enterprise")], "tenant_id string, period_ym int, total_docs long, total_chars_in long, total_rag_queries long, total_ai_tokens_in long, total_ai_tokens_out long, plan string")
    limited = snap.join(billing.plan_table(spark), "plan")
    row = limited.select(billing.overage_millicents().alias("o"), billing.cap_message().alias("m"), F.size(billing.invoice_lines()).alias("n")).first()
    assert (row.o, row.m, row.n) == (0, None, 0)


def test_caps_and_invoice_at_the_limit(spark):
    snap = spark.createDataFrame([("t", 202401, 1001, 5_000_000, 0, 250_001, 0, "starter")], "tenant_id string, period_ym int, total_docs long, total_chars_in long, total_rag_queries long, total_ai_tokens_in long, total_ai_tokens_out long, plan string")
    limited = snap.join(billing.plan_table(spark), "plan")
    assert limited.select(billing.cap_message().alias("m")).first().m == "monthly document cap of 1000 reached (1001 used)"
    lines = billing.invoices(limited).first().lines
    assert [(x.description, x.quantity) for x in lines] == [("Document overage (1 docs)", 1), ("AI token (input) overage (1 tokens)", 1)]


def test_event_reducer(spark):
    log = [("a", 1, "set", "x"), ("a", 2, "append", "y"), ("b", 3, "set", "q"), ("b", 4, "remove", None), ("c", 5, "append", "z"), ("a", 6, "set", "n"), ("a", 7, "append", "m")]
    got = folds.reduce_events(spark.createDataFrame(log, "k string, seq long, op string, value string"), ["k"])
    assert sorted(map(tuple, got.collect())) == [("a", "nm"), ("c", "z")]


def test_rolling_quota_boundary(spark):
    rows = [("u", "2024-01-01 00:00:00", 1), ("u", "2024-01-01 05:00:00", 2), ("u", "2024-01-01 05:00:01", 4), ("u", "2024-01-01 06:00:00", 8)]
    e = spark.createDataFrame(rows, "k string, t string, c long").withColumn("t", F.col("t").cast("timestamp"))
    r = folds.rolling_quota(e, "k", "t", "c", 5 * 3600).first()
    assert r.usage == 12 and str(r.anchor) == "2024-01-01 05:00:01"
