"""Harmonic packing of token ids into sequences of a fixed capacity.

A piece of length n belongs to class k = capacity // n, and a bin of class k takes exactly k pieces of it, so bins
fill without looking at what others hold. A document longer than the capacity gives full pieces first; what is left
is cut at capacity // k, the largest piece of its class, as long as the uncut rest would waste more than a given
share of its place. Cut pieces fill their class's bins but for capacity % k ids.

Every task packs its own rows: no shuffle, and no bin is shared between tasks. The bins of a class that are not full
when a task ends give up their pieces to a last first-fit pass over these pieces alone (fewer than k for each class
k, whatever the input's size). Sequence ids hold the task's number in their upper bits.

Defined results: a null or empty text is one document of one end id; repeated rows are packed once each; an empty
table gives no pieces; columns besides ``doc_id`` and ``text`` are ignored; ties keep the order of the rows read.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.store import narrow_batches, released
from millrace.llm.tokens import Encoder, slices

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
    ]
)
TASK_BITS = 36
FLUSH_PIECES = 2_000


def cut_lengths(n: int, capacity: int, waste: float) -> list[int]:
    """The lengths of a document's pieces, in order."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        if (capacity // k - rest) <= waste * rest:
            out.append(rest)
            break
        out.append(capacity // (k + 1))
        rest -= capacity // (k + 1)
    return out


class Bins:
    """The open bin of each class, and the finished pieces of closed bins."""

    def __init__(self, capacity: int, base: int):
        self.capacity, self.next = capacity, base
        self.open: dict[int, list[tuple]] = defaultdict(list)
        self.done: list[tuple] = []

    def close(self, pieces: list[tuple]) -> None:
        at = 0
        for p in pieces:
            self.done.append((*p, self.next, at))
            at += p[2]
        self.next += 1

    def add(self, piece: tuple) -> None:
        k = self.capacity // piece[2]
        pieces = self.open[k]
        pieces.append(piece)
        if len(pieces) == k:
            self.close(pieces)
            self.open[k] = []

    def finish(self) -> None:
        """First fit over what the unfinished bins hold, longest first; the emptiest bins are kept in a heap."""
        left = sorted((p for pieces in self.open.values() for p in pieces), key=lambda p: -p[2])
        bins: list[list[tuple]] = []
        room: list[tuple[int, int]] = []
        for p in left:
            if room and -room[0][0] >= p[2]:
                space, i = heapq.heappop(room)
                bins[i].append(p)
                heapq.heappush(room, (space + p[2], i))
            else:
                bins.append([p])
                heapq.heappush(room, (p[2] - self.capacity, len(bins) - 1))
        for pieces in bins:
            self.close(pieces)
        self.open.clear()


def pack_lists(docs: Iterator[tuple[int, bytes]], capacity: int, waste: float, base: int = 0) -> Iterator[list[tuple]]:
    """Pieces of (doc_id, ids as 32-bit bytes) in lists of rows (doc_id, start, length, ids, doc_tokens, sequence_id, offset)."""
    bins = Bins(capacity, base)
    for doc_id, ids in docs:
        n, at = len(ids) // 4, 0
        for length in cut_lengths(n, capacity, waste):
            bins.add((doc_id, at, length, ids[4 * at : 4 * (at + length)], n))
            at += length
        if len(bins.done) >= FLUSH_PIECES:
            yield bins.done
            bins.done = []
    bins.finish()
    yield bins.done


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, waste: float = 0.02) -> DataFrame:
    """Pieces of all documents with their ids (little-endian unsigned 32-bit), sequence and offset there."""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = Encoder.of(vocabulary)

        def texts() -> Iterator[tuple[int, bytes]]:
            for part in slices(batches, "text", 4 << 20):
                ids, offsets = encoder.encode(part.column("text"))
                wide = ids.astype("<u4").tobytes()
                for doc_id, a, b in zip(part.column("doc_id").to_pylist(), offsets[:-1], offsets[1:], strict=True):
                    yield doc_id, wide[4 * a : 4 * b]

        task = TaskContext.get().partitionId() << TASK_BITS
        for rows in pack_lists(texts(), capacity, waste, task):
            if rows:
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=ARROW)

    narrow_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(released(of_task), SCHEMA)


def padding(lengths: np.ndarray, capacity: int = 2048) -> int:
    """Padded ids over sequences with these fills: up to ``capacity``, and none at a power of two."""
    lengths = np.asarray(lengths, np.int64)
    return int((capacity - lengths)[(lengths & (lengths - 1)) != 0].sum())
