"""Token counts without token ids: pieces are counted once for each distinct pre-token and joined to the documents.

A pre-token is a stretch of text that no merge of the vocabulary can leave: text is cut between two bytes that stand
side by side in no piece (and never inside a character), so its pieces are those of its pre-tokens, one after the other.

1. Every task emits its distinct pre-tokens with their occurrences; they meet once, by a grouping on the pre-token.
   Each is encoded there, and its number of pieces is kept under a key of at most 33 bytes.
2. Pre-tokens with a share of at least 1 / ``common`` of all occurrences go to the tasks: there are at most ``common``
   of them and their keys are short, so what is broadcast has a bound whatever the input. Tasks count the pre-tokens of
   each document, add up the common ones at once and send the others as (row, key, frequency), by key, to the table of
   step 1. No key of that join holds more than 1 / ``common`` of all occurrences.
3. Products of frequency and pieces are summed by row.

Defined results: a null text counts as an empty one, which has no bytes and no tokens; a text is never shortened, and one
without a cut is one pre-token; repeated rows and null ids give a row each; an empty table gives no rows; other columns
are ignored. A vocabulary whose normaliser changes texts is refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.store import Scratch, numbered, released
from millrace.llm.tokens import slices

COMMON = 400_000
KEY_BYTES = 32
SLICE_BYTES = 8 << 20
ENCODED_AT_ONCE = 20_000
#: The sign that stands for a space inside pieces.
MARK = "▁"


def key_of(word: bytes) -> bytes:
    """The pre-token itself if it is short, else its digest behind a byte that no text holds."""
    return word if len(word) <= KEY_BYTES else b"\xff" + hashlib.sha256(word).digest()


class Pieces:
    """A sentencepiece vocabulary: where texts can be cut, and how many pieces a pre-token has. One per worker and file."""

    _made: dict[str, Pieces] = {}

    @classmethod
    def of(cls, path: str) -> Pieces:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = " ﬁ  Á\n"
        if self.model.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError(f"{path} changes texts before it splits them")
        self.joined = np.zeros((256, 256), bool)
        self.joined[:, 0x80:0xC0] = True
        for i in range(self.model.vocab_size()):
            if self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i):
                continue
            b = np.frombuffer(self.model.id_to_piece(i).replace(MARK, " ").encode(), np.uint8)
            self.joined[b[:-1], b[1:]] = True
        # A sign before a pre-token keeps the model's own leading space away from it.
        alone = [b for b in range(1, 128) if not self.joined[b, :0x80].any() and not self.joined[b, 0xC0:].any() and not self.joined[0x20, b]]
        if not alone:
            raise ValueError(f"{path} has no sign that stands apart from all others")
        self.guard = chr(alone[0])
        self.guard_pieces = len(self.model.encode(self.guard))

    def split(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The pre-tokens of all texts as bytes, and the text that each belongs to."""
        texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), MARK, " ")
        none, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
        texts = pc.binary_join_element_wise(pc.if_else(pc.equal(texts, none), none, space), texts, none)
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        starts = np.empty(len(data), bool)
        starts[1:] = ~self.joined[data[:-1], data[1:]]
        starts[bounds[:-1][np.diff(bounds) > 0]] = True
        at = np.flatnonzero(starts)
        offsets = np.append(at, len(data)).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        return words, np.searchsorted(bounds, at, side="right") - 1

    def count(self, words: list[bytes]) -> list[int]:
        """The number of pieces of each pre-token."""
        encoded = self.model.encode([self.guard + w.decode() for w in words], num_threads=1)
        return [len(e) - self.guard_pieces for e in encoded]


def distinct_pre_tokens(docs: DataFrame, path: str) -> DataFrame:
    """Each distinct pre-token of all texts once: ``key``, ``pieces`` and ``occurrences``."""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces.of(path)
        for part in slices(batches, "text", SLICE_BYTES):
            coded = model.split(part.column("text"))[0].dictionary_encode()
            n = np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary))
            yield pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.binary()), pa.array(n, pa.int64())], ["word", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces.of(path)
        for batch in batches:
            for a in range(0, batch.num_rows, ENCODED_AT_ONCE):
                part = batch.slice(a, ENCODED_AT_ONCE)
                words = part.column("word").to_pylist()
                columns = [pa.array(map(key_of, words), pa.binary()), pa.array(model.count(words), pa.int64()), part.column("occurrences")]
                yield pa.RecordBatch.from_arrays(columns, ["key", "pieces", "occurrences"])

    words = docs.select("text").mapInArrow(released(of_task), "word binary, n long")
    return words.groupBy("word").agg(F.sum("n").alias("occurrences")).mapInArrow(released(counted), "key binary, pieces long, occurrences long")


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, common: int = COMMON, id_column: str = "doc_id") -> DataFrame:
    """For every row its id, ``n_bytes``, ``n_tokens`` and ``over_limit``, as the vocabulary file's library counts them."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "pieces")
    rows = numbered(docs.select(F.col(id_column).alias("id"), "text"), "row")
    table = scratch.cut(distinct_pre_tokens(rows, path))
    total = table.agg(F.sum("occurrences")).head()[0] or 0
    often = table.where(F.col("occurrences") * common >= total).select("key", "pieces")
    known = spark.sparkContext.broadcast({bytes(r.key): r.pieces for r in often.toLocalIterator()})

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, pieces = Pieces.of(path), known.value
        for part in slices(batches, "text", SLICE_BYTES):
            words, owner = model.split(part.column("text"))
            coded = words.dictionary_encode()
            keys = list(map(key_of, coded.dictionary.to_pylist()))
            of_word = np.fromiter((pieces.get(k, -1) for k in keys), np.int64, len(keys))
            each = of_word[coded.indices.to_numpy(zero_copy_only=False)]
            at = np.append(0, np.cumsum(np.where(each > 0, each, 0)))
            ends = np.searchsorted(owner, np.arange(part.num_rows + 1))
            rare = each < 0
            pair, n = np.unique(owner[rare] * np.int64(len(keys) or 1) + coded.indices.to_numpy(zero_copy_only=False)[rare], return_counts=True)
            text, word = np.divmod(pair, len(keys) or 1)
            row = part.column("row").to_numpy()
            # The row of a document itself has a key that no pre-token has, and its frequency is what it has so far.
            own = [b"\xfe" + int(r).to_bytes(8, "big") for r in row]
            size = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
            none = pa.nulls(len(pair))
            columns = [
                pa.array(np.concatenate([row, row[text]])),
                pa.concat_arrays([part.column("id"), none.cast(part.column("id").type)]),
                pa.concat_arrays([size, none.cast(pa.int64())]),
                pa.concat_arrays([pa.array(own, pa.binary()), pa.array(keys, pa.binary()).take(pa.array(word))]),
                pa.array(np.concatenate([np.diff(at[ends]), n]).astype(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["row", "id", "n_bytes", "key", "n"])

    id_type = rows.schema["id"].dataType.simpleString()
    parts = rows.mapInArrow(released(frequencies), f"row long, id {id_type}, n_bytes long, key binary, n long")
    tokens = F.sum(F.col("n") * F.coalesce("pieces", F.lit(1))).alias("n_tokens")
    summed = parts.join(table.select("key", "pieces"), "key", "left").groupBy("row").agg(F.max("id").alias(id_column), F.max("n_bytes").alias("n_bytes"), tokens)
    return summed.select(id_column, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
