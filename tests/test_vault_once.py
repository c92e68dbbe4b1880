"""A vault and the texts masked by it come from one detection."""

import pytest

from millrace.operators import privacy as p
from millrace.plans import privacy_queries as q

ROWS = [(1, "a@b.org, Maître Durand and 2024-01-31"), (1, "again a@b.org"), (None, "x@y.net"), (3, None), (4, ""), (5, "EBITDA of 12 M€ stays [CONTACT_9]")]


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("query", [q.rehydrated, q.masked_by_vault])
def test_texts_are_searched_once(spark, folder, monkeypatch, query):
    found, detect = [], p.detect
    monkeypatch.setattr(p, "detect", lambda *a: found.append(a) or detect(*a))
    assert query(spark, folder).count() == len(ROWS)
    assert len(found) == 1


def test_spans_found_once_give_the_same_vault_and_masks(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = p.detected(docs, q.ALL)
    vault = p.vault(docs, q.ALL).cache()
    assert sorted(map(tuple, p.vault_of(found).collect())) == sorted(map(tuple, vault.collect()))
    assert vault.count() > 4

    def texts(df):
        return sorted((str(r.doc_id), str(r.text)) for r in df.collect())

    masked = p.mask_found(found, vault)
    assert texts(masked) == texts(p.mask_by_vault(docs, vault, q.ALL)) != texts(docs)
    assert texts(p.rehydrate(masked, vault)) == texts(docs) == texts(q.rehydrated(spark, folder))
