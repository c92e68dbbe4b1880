"""The privacy queries with all patterns against brute force in Python, with null and repeated ids."""

import re
from collections import Counter

import pytest

from millrace.operators import privacy as p
from millrace.plans import privacy_queries, registry, registry_all  # noqa: F401

ALL = [(c, re.compile(x.replace("(?iU)", "(?i)").replace("(?U)", ""))) for c, x in privacy_queries.ALL]
RICH = (
    "Maître Durand, Gérant de la SAS, écrit à a@b.fr le 2024-01-05 et le 07/01/2024 : 250 000 € payés, IBAN "
    "FR76 3000 6000 0112 3456 7890 189, tel 01 23 45 67 89, dans 3 mois, EBITDA, zone naturelle, encore a@b.fr."
)
ROWS = [
    (1, RICH), (1, RICH), (1, "autre a@c.fr"), (2, None), (3, ""), (4, "rien"), (None, RICH), (None, "x@y.org et x@z.org"),
    (5, "Le Président Directeur Général, Maître Le Goff, Article L. 123-4, entre 5 € et 10 €, le 01.02.2023."), (6, "CCN Syntec bureaux, FR 1234567, lot n°7, 5x EBITDA"),
]


def spans(text):
    found = [(m.start() - m.end(), m.start(), i, m.end(), c, m.group()) for i, (c, x) in enumerate(ALL) for m in x.finditer(text or "") if m.group()]
    kept = []
    for _, a, _, b, c, v in sorted(found):
        if all(a >= y or b <= x for x, y, *_ in kept):
            kept.append((a, b, c, v))
    return sorted(kept)


def masked(text):
    out, at, tokens, count = "", 0, {}, Counter()
    for a, b, c, v in spans(text):
        new = v
        if p.TREATMENTS[c][0] == "M":
            if v not in tokens:
                count[p.PLACEHOLDERS[c]] += 1
                tokens[v] = f"[{p.PLACEHOLDERS[c]}_{count[p.PLACEHOLDERS[c]]}]"
            new = tokens[v]
        out, at = out + text[at:a] + new, b
    return text if text is None else out + text[at:]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("privacy"))
    spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3).write.parquet(path + "/documents.parquet")
    return path


def run(spark, folder, name):
    return registry.queries()[name](spark, folder).collect()


def test_mask_all(spark, folder):
    assert Counter(map(tuple, run(spark, folder, "d1_5_mask_all"))) == Counter((i, masked(t), len(spans(t))) for i, t in ROWS)
    assert all(x not in masked(RICH) for x in ("a@b.fr", "FR76", "23 45 67", "2024", "Durand", "250 000"))


def test_round_trip_all(spark, folder):
    assert Counter(map(tuple, run(spark, folder, "d1_8_round_trip_all"))) == Counter(ROWS)


def test_vault_all(spark, folder):
    firsts = {}
    for i, t in ROWS:
        for a, _, c, v in spans(t):
            at = (i is not None, i or 0, a)  # a null id comes first
            firsts[c, v] = min(firsts.get((c, v), at), at)
    got = {(r.category, r.value): r.token for r in run(spark, folder, "d1_9_vault_all")}
    assert set(got) == set(firsts)
    for c in {c for c, _ in firsts}:
        mine = sorted((at, v) for (k, v), at in firsts.items() if k == c)
        numbers = [int(got[c, v].rsplit("_", 1)[1]) for _, v in mine]
        assert sorted(numbers) == list(range(1, len(mine) + 1))
        if len({at for at, _ in mine}) == len(mine):
            assert numbers == sorted(numbers)


def test_treat_all(spark, folder):
    want = (
        "Party A, Gérant de la SAS, écrit à [CONTACT_1] le [DATE_D0] et le [DATE_D+2] : ~500K payés, IBAN [ID_FIN_1], tel [CONTACT_2], "
        "dans 3 mois, EBITDA, zone naturelle, encore [CONTACT_1]."
    )
    got = Counter((r.doc_id, r.text) for r in run(spark, folder, "d1_4_treat_all"))
    assert got[1, want] == 2 and got[None, want] == 1 and got[1, "autre [CONTACT_1]"] == 1
    assert sum(got.values()) == len(ROWS)
