"""Token counts against the library on whole texts."""

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from millrace.llm import counts
from millrace.llm.queries import op11_token_counts, piece_vocabulary

TEXTS = [
    None, "", " ", "   ", "\n", "a", "a ", " a", "  a  b ", "a\nb\n\nc", "\x00x\x01", "<s> x </s> <unk> <0x0A>", "▁▁a▁", "ﬁ ① Å é é 　x ​z", "\r\n\t",
    "!!!!!!!!!!!!!!!!!!!! .,.,.,", "日本語のテキスト", "😀😀 👩‍👩‍👧", "don't e-mail me@x.org 12345.678", "Ünïcödé ÀÉÎ ßtraße", "x" * 5000, "ab " * 4000, "1234567890" * 300,
]


def expected(texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_vocabulary())
    return [(len((t or "").encode()), len(sp.encode(t or ""))) for t in texts]


def frame(spark, texts):
    rows = [(i, t, 7, "k", -1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, key string, row int")


@pytest.mark.parametrize("common", [1, 50, counts.COMMON])
def test_counts_like_the_library(spark, common):
    rng = np.random.default_rng(3)
    alphabet = list("abcde  \n.,'▁é日0-") + ["the ", "ing", "\t", "<s>"]
    texts = TEXTS + ["".join(rng.choice(alphabet, int(rng.integers(1, 200)))) for _ in range(150)]
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in counts.count_tokens(frame(spark, texts), piece_vocabulary(), 1000, common).collect()}
    assert got == {i: (b, n, n > 1000) for i, (b, n) in enumerate(expected(texts))}


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "same text"), (1, "same text"), (None, "other"), (None, None), (2, "same text too")]
    made = counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), piece_vocabulary(), common=1)
    want = sorted((str(i), *e) for (i, _), e in zip(rows, expected([t for _, t in rows])))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in made.collect()) == want


def test_empty_table(spark):
    assert counts.count_tokens(frame(spark, []), piece_vocabulary()).count() == 0


def test_pre_tokens_are_counted_once(spark):
    table = counts.distinct_pre_tokens(frame(spark, ["a b a b", "b a", None]), piece_vocabulary())
    assert {bytes(r.key): (r.pieces, r.occurrences) for r in table.collect()} == {b" a": (1, 3), b" b": (1, 3)}


def test_cuts_hold_for_every_pair_of_pieces():
    model = counts.Pieces.of(piece_vocabulary())
    for i in range(0, model.model.vocab_size(), 7):
        b = model.model.id_to_piece(i).replace(counts.MARK, " ").encode()
        if not model.model.is_byte(i) and not model.model.is_control(i) and not model.model.is_unknown(i):
            assert all(model.joined[x, y] for x, y in zip(b, b[1:]))


def test_query_on_whole_table(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in op11_token_counts(spark, d).collect()}
    assert got == dict(zip(texts, expected(texts.values())))
    assert op11_token_counts(spark, d).where(F.col("over_limit") != (F.col("n_tokens") > 4096)).count() == 0
