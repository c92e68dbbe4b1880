"""Texts masked by a vault table and put back from it."""

import pytest

from millrace.operators import privacy as p

MAILS = (p.STRUCTURED[0],)
ROWS = [(1, "a@b.org and c@d.org, a@b.org"), (1, "a@b.org and c@d.org, a@b.org"), (None, "none but x@y.net"), (3, None), (4, ""), (5, "no address [CONTACT_9999] stays")] + [(i, f"hot a@b.org {i} u{i}@v.org") for i in range(10, 200)]


@pytest.mark.parametrize("common", [1, 50, p.COMMON_WORDS])
def test_there_and_back(spark, monkeypatch, common):
    monkeypatch.setattr(p.looked_up, "__defaults__", (common,))
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    vault = p.vault(docs, MAILS).cache()
    masked = p.mask_by_vault(docs, vault, MAILS)
    texts = sorted((str(r.doc_id), str(r.text)) for r in masked.collect())
    hot = vault.where("value = 'a@b.org'").first().token
    assert not any("@" in t for _, t in texts) and sum(f"[{hot}]" in t for _, t in texts) == 192
    back = p.rehydrate(masked, vault)
    assert sorted((str(r.doc_id), str(r.text)) for r in back.collect()) == sorted((str(i), str(t)) for i, t in ROWS)


def test_unknown_values_and_tokens_stay(spark):
    docs = spark.createDataFrame([(1, "a@b.org c@d.org [CONTACT_7]")], "doc_id long, text string")
    vault = spark.createDataFrame([("Contact", "a@b.org", "CONTACT_1")], "category string, value string, token string")
    masked = p.mask_by_vault(docs, vault, MAILS)
    assert masked.first().text == "[CONTACT_1] c@d.org [CONTACT_7]"
    assert p.rehydrate(masked, vault).first().text == "a@b.org c@d.org [CONTACT_7]"
    none = vault.where("false")
    assert p.rehydrate(masked, none).first().text == masked.first().text and p.mask_by_vault(docs.where("false"), vault, MAILS).count() == 0


def test_a_match_holds_what_is_looked_for_first(spark):
    """Texts that match a pattern are never left out, in any letter case and with letters that fold into others."""
    from pyspark.sql import functions as F

    texts = [
        "PRÉSIDENTE", "pdg", "Mme le Juge", "conſeil rapporteur", "Maître Dupont", "ART. L 12-3", "L. 12-3 du Code", "CCN Métaux et autres", "CONVENTİON collective de Bois et", "12 000 €", "3 MILLIONS d'euros",
        "entre 3 € et 5 €", "de 1 EUR à 2 EUR", "3 x EBITDA", "10% du capital", "2 fois le résultat", "J+3", "ſous 3 jours", "délai de 2 mois", "BREVET", "EP 123456", "FR 1234567", "marque déposée 12",
        "Parcelle cadastrale 3", "lot 5", "section cadastrale A 2", "zone UA", "ıcpe 12", "Natura 2000", "CHIFFRE D'AFFAIRES", "levier financier", "SARL x", "a SELAFA", "x@y.org", "FR7630006000011234567890189", "01 02 03 04", "2024-01-02",
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for category, pattern in p.LEGAL + p.STRUCTURED:
        found = F.size(F.regexp_extract_all("t", F.lit(pattern), F.lit(0))) > 0
        missed = rows.where(found & ~p.may_match(F.col("t"), p.folded(F.col("t")), pattern)).collect()
        assert not missed, (category, missed)


def test_chunks_are_counted_by_words(spark):
    from pyspark.sql import functions as F

    from millrace.functions import text
    from millrace.operators import documents

    rows = [("w " * n + tail,) for n in (0, 1, 3, 4, 5, 7, 8, 9, 20) for tail in ("", "x")] + [("",), (" \n ",), ("é\u00a0b c d e",)]
    frame = spark.createDataFrame(rows, "t string")
    for size, overlap in ((4, 1), (3, 0), (2, 5)):
        assert frame.where(text.chunk_count(F.col("t"), size, overlap) != F.size(text.chunks(F.col("t"), size, overlap))).count() == 0
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    a, b = (documents.ingest(docs, patterns=MAILS, at_once=x) for x in (False, True))
    for name in ("documents", "chunks", "entities", "audit", "answers"):
        one, two = getattr(a, name), getattr(b, name)
        assert one.columns == two.columns and sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
