"""Token ids: words are taken apart by Arrow, only distinct parts are looked up, and the ids are the library's."""

import random

import pyarrow as pa
from public_tokenizers import path
from tokenizers import Tokenizer

from millrace.llm.tokens import END_ID, Encoder

VOCABULARY = path("word_bpe_49k.json")


def test_plain_words_are_looked_up_by_parts_only():
    encoder = Encoder(VOCABULARY)
    asked = []
    one = encoder._part
    encoder._part = lambda part: asked.append(part) or one(part)
    texts = [" ".join(f"Ab{i}{j}cd" for j in range(100)) for i in range(100)]
    ids, offsets = encoder.encode(pa.array(texts))
    assert len(asked) <= 12 and not encoder.words.young  # ten digits and two runs of letters, of ten thousand words
    library = Tokenizer.from_file(VOCABULARY)
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == [*library.encode(t, add_special_tokens=False).ids, END_ID]


def test_ids_are_the_librarys():
    rng = random.Random(3)
    signs = ["a", "B", "é", "ÿ", "ß", "×", "÷", "'s", "'T", "'re", "'", "7", "12", ".", "<|", "|>", "<|endoftext|>", "ж", "中", "K", "İ", "́", "\x1c", "\x7f", "\xa0", " ", "  ", "\t", "\n", "\x0b", " ", "😀"]
    texts = ["", None, " ", "\n\n", *("".join(rng.choices(signs, k=rng.randrange(1, 30))) for _ in range(3000)), ""]
    library, encoder = Tokenizer.from_file(VOCABULARY), Encoder(VOCABULARY, 50, 20)
    for n in (1, 7, len(texts)):
        some = texts[:n] if n < len(texts) else texts
        ids, offsets = encoder.encode(pa.array(some, pa.string()))
        assert len(offsets) == len(some) + 1 and offsets[-1] == len(ids)
        for i, t in enumerate(some):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == [*library.encode(t or "", add_special_tokens=False).ids, END_ID], repr(t)
    ids, offsets = encoder.encode(pa.array(texts, pa.string()).slice(5, 9))
    assert offsets[-1] == len(ids) and len(offsets) == 10
