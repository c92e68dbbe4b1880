"""Token ids in shard files that hold a wavelet matrix: bit planes with rank directories.

A shard is a Parquet part file written by one task of a range partitioning by ``doc_id``, so shards and the rows in
them ascend. It holds blocks of whole documents (about ``BLOCK_TOKENS`` ids each); a block is one row with its
document ids and starts and, for each of the sixteen bit planes, its number of zeros, its bits in chunks that are
compressed one by one, and the number of ones before each chunk. To read an id, count an id in a range or find its
k-th occurrence, one or two chunks of each plane are unpacked, never a whole plane. :func:`tokens_at`, :func:`counts`
and :func:`occurrences` do that over all shards of a folder. Files go through Spark's writer and reader, so any store
that Spark reaches will do, and a lost task writes its shard again under the same commit protocol.

Defined results: a null or empty text is a document of one end id; a null ``doc_id`` sorts first; repeated rows are
written once each; rows with one ``doc_id`` stand next to each other in a seeded random order, so that a ``doc_id`` of
many rows is split over shards; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.store import narrow_batches, released
from millrace.llm.tokens import Encoder, slices

BITS = 16
CHUNK = 1 << 16
CHUNKS_KEPT = 64
CACHE_WORDS, CACHE_PARTS = 50_000, 300_000  # tokens are all that the task holds, so its caches may be large
BLOCK_TOKENS = 1 << 21
FILE_SCHEMA = T.StructType(
    [
        T.StructField("shard", T.IntegerType()),
        T.StructField("block", T.IntegerType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("starts", T.ArrayType(T.LongType())),
        T.StructField("planes", T.ArrayType(T.ArrayType(T.BinaryType()))),
        T.StructField("zeros", T.ArrayType(T.LongType())),
        T.StructField("ranks", T.ArrayType(T.ArrayType(T.IntegerType()))),
    ]
)
READ_SCHEMA = "doc_id long, shard int, block int, local_start long, n_tokens long, ids_crc32 long"


def _unpacked(chunk: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(chunk)


class WaveletMatrix:
    """Access, rank, select and count over a sequence of integers below 2 ** BITS."""

    def __init__(self, planes: list[list[bytes]], zeros: list[int], ranks: list[list[int]], n: int):
        """``planes`` are compressed chunks of CHUNK bits, highest bit of the ids first; ``ranks`` the ones before each chunk."""
        self.n, self.zeros, self.planes, self.ranks = n, zeros, planes, ranks
        self.kept: dict[tuple[int, int], np.ndarray] = {}

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        planes, zeros, ranks = [], [], []
        values = np.ascontiguousarray(ids, np.uint16)
        for k in reversed(range(BITS)):
            bits = ((values >> k) & 1).astype(bool)
            packed = np.packbits(bits).tobytes()
            planes.append([squeeze(packed[a : a + CHUNK // 8]) for a in range(0, len(packed), CHUNK // 8)])
            ones = np.flatnonzero(bits)
            ranks.append(np.searchsorted(ones, np.arange(0, len(bits) + 1, CHUNK)).tolist())
            values = np.concatenate([values[~bits], values[ones]])
            zeros.append(len(bits) - len(ones))
        return cls(planes, zeros, ranks, len(ids))

    def _chunk(self, plane: int, a: int) -> np.ndarray:
        """The bits of one chunk; a few chunks stay unpacked."""
        found = self.kept.pop((plane, a), None)
        if found is None:
            size = min(CHUNK, self.n - a * CHUNK)
            found = np.unpackbits(np.frombuffer(_unpacked(self.planes[plane][a]), np.uint8), count=size)
            if len(self.kept) >= CHUNKS_KEPT:
                del self.kept[next(iter(self.kept))]
        self.kept[plane, a] = found
        return found

    def _ones(self, plane: int, i: int) -> int:
        """Ones before position i."""
        a, rest = divmod(i, CHUNK)
        return self.ranks[plane][a] + (int(self._chunk(plane, a)[:rest].sum(dtype=np.int64)) if rest else 0)

    def _down(self, plane: int, bit: int, i: int) -> int:
        ones = self._ones(plane, i)
        return self.zeros[plane] + ones if bit else i - ones

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for plane in range(BITS):
            bit = int(self._chunk(plane, i // CHUNK)[i % CHUNK])
            value = value << 1 | bit
            i = self._down(plane, bit, i)
        return value

    def _range(self, value: int, a: int, b: int) -> tuple[int, int]:
        for plane in range(BITS):
            bit = value >> (BITS - 1 - plane) & 1
            a, b = self._down(plane, bit, a), self._down(plane, bit, b)
        return a, b

    def count(self, value: int, a: int = 0, b: int | None = None) -> int:
        """How often an id occurs in positions a to b."""
        a, b = self._range(value, a, self.n if b is None else b)
        return b - a

    def rank(self, value: int, i: int) -> int:
        """How often an id occurs before position i."""
        return self.count(value, 0, i)

    def select(self, value: int, k: int) -> int:
        """The position of the k-th occurrence, counted from 0."""
        first, last = self._range(value, 0, self.n)
        if not 0 <= k < last - first:
            raise IndexError(k)
        i = first + k
        for plane in reversed(range(BITS)):
            bit = value >> (BITS - 1 - plane) & 1
            i = self._nth(plane, bit, i - self.zeros[plane] if bit else i)
        return i

    def _nth(self, plane: int, bit: int, k: int) -> int:
        """The position of the k-th bit of this kind."""
        counts = np.array(self.ranks[plane], np.int64)
        if not bit:
            counts = np.arange(len(counts)) * CHUNK - counts
        a = int(np.searchsorted(counts, k, "right")) - 1
        return a * CHUNK + int(np.flatnonzero(self._chunk(plane, a) == bit)[k - counts[a]])

    def occurrences(self, value: int) -> list[int]:
        """All positions of an id."""
        return [self.select(value, k) for k in range(self.count(value))]

    def decode(self) -> np.ndarray:
        """All ids, by undoing the planes from the last to the first."""
        values = np.zeros(self.n, np.uint16)
        for plane in reversed(range(BITS)):
            packed = b"".join(map(_unpacked, self.planes[plane]))
            bits = np.unpackbits(np.frombuffer(packed, np.uint8), count=self.n).astype(bool)
            z = self.zeros[plane]
            above = np.empty(self.n, np.uint16)
            above[~bits] = values[:z]
            above[bits] = values[z:] | np.uint16(1 << (BITS - 1 - plane))
            values = above
        return values


def write_shards(docs: DataFrame, path: str, vocabulary: str, shards: int) -> None:
    """Encode all documents and write them as shard files below ``path``."""

    def of_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, shard, block = Encoder.of(vocabulary, CACHE_WORDS, CACHE_PARTS), TaskContext.get().partitionId(), 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            ids = np.concatenate([h[1] for h in held])
            ends = np.cumsum([0, *(len(h[1]) for h in held)])
            starts = np.concatenate([h[2][:-1] + e for h, e in zip(held, ends, strict=False)])
            w = WaveletMatrix.build(ids)
            return pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array([shard], pa.int32()),
                    "block": pa.array([block], pa.int32()),
                    "n_tokens": pa.array([len(ids)], pa.int64()),
                    "doc_ids": pa.array([[d for h in held for d in h[0]]], pa.list_(pa.int64())),
                    "starts": pa.array([starts], pa.list_(pa.int64())),
                    "planes": pa.array([w.planes], pa.list_(pa.list_(pa.binary()))),
                    "zeros": pa.array([w.zeros], pa.list_(pa.int64())),
                    "ranks": pa.array([w.ranks], pa.list_(pa.list_(pa.int32()))),
                }
            )

        for part in slices(batches, "text", 4 << 20):
            ids, offsets = encoder.encode(part.column("text"))
            held.append((part.column("doc_id").to_pylist(), ids, offsets))
            if sum(len(h[1]) for h in held) >= BLOCK_TOKENS:
                yield flush()
                held, block = [], block + 1
        if held:
            yield flush()

    narrow_batches(docs.sparkSession)
    # Rows of one id are told apart by a seeded random number, as one document may hold a third of all rows.
    keyed = docs.select("doc_id", "text", F.rand(7).alias("r"))
    sorted_docs = keyed.repartitionByRange(shards, "doc_id", "r").sortWithinPartitions("doc_id", "r")
    sorted_docs.select("doc_id", "text").mapInArrow(released(of_shard), FILE_SCHEMA).write.option("compression", "none").parquet(path)


def open_block(row) -> WaveletMatrix:
    """The wavelet matrix of one row of the shard files."""
    return WaveletMatrix(row["planes"], row["zeros"], row["ranks"], row["n_tokens"])


def blocks_of(spark: SparkSession, path: str) -> DataFrame:
    """(shard, block, n_tokens, before): the ids of all blocks before each. Only these columns are read.

    A window holds the blocks of one shard, or one row for each shard.
    """
    blocks = spark.read.schema(FILE_SCHEMA).parquet(path).select("shard", "block", "n_tokens")

    def up_to(w):
        return w.rowsBetween(Window.unboundedPreceding, -1)

    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    far = F.coalesce(F.sum("n").over(up_to(Window.orderBy("shard"))), F.lit(0)).alias("far")
    near = F.coalesce(F.sum("n_tokens").over(up_to(Window.partitionBy("shard").orderBy("block"))), F.lit(0))
    placed = blocks.withColumn("near", near).join(shards.select("shard", far), "shard")
    return placed.select("shard", "block", "n_tokens", (F.col("near") + F.col("far")).alias("before"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def counts(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """(token_id, n) for each of these ids: how often it occurs in all shards."""

    def of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            w = open_block(row)
            yield pa.RecordBatch.from_pydict({"token_id": pa.array(ids, pa.int32()), "n": pa.array([w.count(i) for i in ids], pa.int64())})

    wanted = spark.createDataFrame([(i,) for i in dict.fromkeys(ids)], "token_id int")
    files = spark.read.schema(FILE_SCHEMA).parquet(path).select("planes", "zeros", "ranks", "n_tokens")
    ids = list(dict.fromkeys(ids))
    each = files.mapInArrow(released(of_blocks), "token_id int, n long").groupBy("token_id").agg(F.sum("n").alias("n"))
    return wanted.join(each, "token_id", "left").select("token_id", F.coalesce("n", F.lit(0)).alias("n"))


def occurrences(spark: SparkSession, path: str, token_id: int) -> DataFrame:
    """(position, doc_id, offset): every occurrence of an id, its place in all ids and in its document."""

    def of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            at = np.array(open_block(row).occurrences(token_id), np.int64)
            starts = np.array(row["starts"], np.int64)
            doc = np.searchsorted(starts, at, "right") - 1
            own = [row["doc_ids"][d] for d in doc]
            yield pa.RecordBatch.from_pydict({"position": pa.array(at + row["before"]), "doc_id": pa.array(own, pa.int64()), "offset": pa.array(at - starts[doc])})

    return _placed(spark, path).mapInArrow(released(of_blocks), "position long, doc_id long, offset long")


def tokens_at(spark: SparkSession, path: str, positions: list[int]) -> DataFrame:
    """(position, token_id) of these places in all ids; places beyond them give no rows."""
    sent = spark.sparkContext.broadcast(np.array(sorted({p for p in positions if p >= 0}), np.int64))  # the caller's list

    def of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            a, b = np.searchsorted(sent.value, [row["before"], row["before"] + row["n_tokens"]])
            w, mine = open_block(row), sent.value[a:b]
            found = [w.access(int(p - row["before"])) for p in mine]
            yield pa.RecordBatch.from_pydict({"position": pa.array(mine), "token_id": pa.array(found, pa.int32())})

    return _placed(spark, path).mapInArrow(released(of_blocks), "position long, token_id int")


def _placed(spark: SparkSession, path: str) -> DataFrame:
    before = blocks_of(spark, path).select("shard", "block", "before")
    return spark.read.schema(FILE_SCHEMA).parquet(path).join(before, ["shard", "block"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, read back from the shard files: place, length and checksum of its ids.

    ``start`` counts the ids of all documents before it. It adds the block's start, from a table of one row per
    block, to the document's start there.
    """

    def of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            wide = open_block(row).decode().astype("<u4").tobytes()
            starts = row["starts"]
            ends = [*starts[1:], row["n_tokens"]]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "shard": pa.array([row["shard"]] * len(starts), pa.int32()),
                    "block": pa.array([row["block"]] * len(starts), pa.int32()),
                    "local_start": pa.array(starts, pa.int64()),
                    "n_tokens": pa.array([b - a for a, b in zip(starts, ends, strict=True)], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(starts, ends, strict=True)], pa.int64()),
                }
            )

    before = blocks_of(spark, path).select("shard", "block", "before")
    docs = spark.read.schema(FILE_SCHEMA).parquet(path).mapInArrow(released(of_blocks), READ_SCHEMA).join(before, ["shard", "block"])
    start = (F.col("before") + F.col("local_start")).alias("start")
    return docs.select("doc_id", start, "n_tokens", "ids_crc32")
