"""The stages of the pipeline on null ids and on repeated ids with equal and with different texts."""

from collections import Counter

import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(k):
    return "\n".join(" ".join(f"word{k}n{i}l{j} and" for i in range(12)) + " ends here." for j in range(4))


def rows():
    """(doc_id, text): one id with equal texts, one with different texts, a copy under another id, null ids."""
    copied = prose(1)
    found = [(1, copied), (1, copied), (2, prose(2)), (2, prose(3)), (3, prose(4)), (3, copied)]
    found += [(None, prose(5)), (None, prose(6)), (None, prose(6)), (None, copied)]
    found += [(k, prose(k)) for k in range(10, 30)]
    return [(i, t, "en", None if k % 7 == 3 else f"s{k % 3}", len(t)) for k, (i, t) in enumerate(found)]


@pytest.fixture(params=["files", "memory"])
def docs(spark, request, tmp_path):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    if request.param == "memory":
        return df
    df.write.parquet(str(tmp_path / "docs"))
    return spark.read.parquet(str(tmp_path / "docs"))


def pairs(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_one_of_each_group(spark, docs):
    out = corpus_pipeline.one_of_each_group(spark, docs, "")
    assert out.columns == docs.columns
    # One row of each text, under its smallest id; different texts under one id stay.
    best = {}
    for i, t, *_ in rows():
        best[t] = min(best.get(t, (True, 0)), (i is None, i or 0))
    assert pairs(out) == Counter((None if none else i, t) for t, (none, i) in best.items())


def test_mixed_sources(spark, docs):
    out = corpus_pipeline.mixed_sources(spark, docs, "")
    assert out.columns == docs.columns
    assert pairs(out) == Counter((i, t) for i, t, *_ in rows())


def test_quality_rules(spark, docs):
    assert Counter(r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, "").collect()) == Counter(r[0] for r in rows())


def test_packed(spark, docs):
    out = corpus_pipeline.packed(spark, docs, "").where("start = 0").collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows())


def test_without_toxic(spark, docs, tmp_path):
    texts = [(100 + k, (prose(k) if k % 2 else "scum filth idiot " * 9), "en", "s0", 9) for k in range(40)]
    spark.createDataFrame([(100 + k, 1, 1 - k % 2) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    both = docs.unionByName(spark.createDataFrame(texts, SCHEMA))
    out = corpus_pipeline.without_toxic(spark, both, str(tmp_path))
    assert out.columns == docs.columns
    assert pairs(out.where("doc_id is null or doc_id < 100")) == Counter((i, t) for i, t, *_ in rows())


@pytest.fixture
def made(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


CLASHES = ["kept", "score", "slot", "block", "in_block", "component_id", "n_words", "cleaned", "start", "length"]


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES[:-1]])
def test_clashing_columns_pass(spark, made, tmp_path, name):
    spark.createDataFrame([(k, 1, k % 2) for k in range(10, 30)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    wide = made
    for i, c in enumerate(CLASHES):
        wide = wide.selectExpr("*", f"concat('{c}', doc_id, {i}) `{c}`")
    out = dict(corpus_pipeline.STAGES)[name](spark, wide, str(tmp_path))
    assert out.columns == wide.columns
    for r in out.collect():
        assert all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}{i}") for i, c in enumerate(CLASHES))


@pytest.mark.parametrize("labels", [[], [(k, 1, 0) for k in range(10, 30)]])
def test_empty_tables_and_one_label(spark, made, tmp_path, labels):
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, made.where("doc_id < -5"), str(tmp_path)).count() == 0, name
    # With one label or none there is nothing to learn, and no document counts as toxic.
    assert pairs(corpus_pipeline.without_toxic(spark, made, str(tmp_path))) == Counter((i, t) for i, t, *_ in rows())


def test_null_empty_and_long_texts(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    long = "\n".join(prose(k) for k in range(400))
    odd = [(1, None), (2, ""), (3, " \n"), (4, long), (5, long + "\nand one more line ends here."), (None, None), (6, "one")]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in odd], SCHEMA)
    assert {r.doc_id for r in corpus_pipeline.quality_rules(spark, df, "").collect()} == {4, 5}
    # Texts without words resemble nothing, so each row of them stays; the longer of the long ones is a near copy.
    assert Counter(r.doc_id for r in corpus_pipeline.one_of_each_group(spark, df, "").collect()) == Counter([1, 2, 3, 4, None, 6])
    assert Counter(r.doc_id for r in corpus_pipeline.mixed_sources(spark, df, "").collect()) == Counter([1, 2, 3, 4, 5, None, 6])
    out = corpus_pipeline.packed(spark, df, "").where("start = 0").collect()
    assert Counter(r.doc_id for r in out) == Counter([1, 2, 3, 4, 5, None, 6])


def shingles(text, k=5):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def test_run_accounts_for_every_document(spark, tmp_path):
    """The whole pipeline over one table, each stage against plain Python on what the one before it kept."""
    bad = [(200 + k, "scum filth idiot " * 12 + f"number {k} ends here.") for k in range(12)]
    near = [(300 + k, prose(300) + f"\nA last line {k} of its own that ends here.") for k in range(5)]
    short = [(400, "too short."), (401, "menu | home | about\n" * 9)]
    clean = [(k, prose(k)) for k in range(40)]
    all_rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in [*clean, *bad, *near, *short]]
    spark.createDataFrame(all_rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    told = [(i, 1, 0) for i, _ in clean] + [(i, 0, 1) for i, _ in bad]
    spark.createDataFrame(told, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    good = stages["quality rules"](spark, docs, str(tmp_path))
    left = {r.doc_id: r.text for r in good.collect()}
    assert set(left) >= {i for i, _ in [*clean, *near]} and not set(left) & {400, 401}
    calm = {r.doc_id for r in stages["toxicity"](spark, good, str(tmp_path)).collect()}
    assert calm >= {i for i, _ in [*clean, *near]}
    sets = {i: shingles(left[i]) for i in sorted(calm)}
    first: dict = {}
    for i in sets:
        same = [j for j in sets if j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
        first[i] = min([first[j] for j in same], default=i)
    stay = {i for i in first if first[i] == i}
    assert {r.doc_id for r in out} == stay
    by_doc: dict = {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    for pieces in by_doc.values():
        pieces.sort()
        assert all(a + n == b for (a, n, _), (b, _, _) in zip(pieces, pieces[1:], strict=False))
        assert pieces[0][0] == 0 and pieces[-1][0] + pieces[-1][1] == pieces[0][2]
