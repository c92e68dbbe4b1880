"""Filter interaction audit: what each filter removes in every order of all filters, exact duplicates among them.

1. Rows are sorted by ranges of (fingerprint, id), and within a range by fingerprint, full text and id. Range bounds hold
   no texts, and a group of copies of any size is spread over ranges by its ids.
2. Every task reads its range once and compares each row with the one before it: a row of the same text whose id is
   larger than the first one's is a duplicate. Only the first rows of a text under the first or last fingerprint of a
   range can have an equal text in another range; those go out with a digest of their text, one row for each part and text.
3. These edges, a few for each task, meet by digest; one whose id is larger than the smallest there is a duplicate.
4. The failed filters of a row are bits of a mask. Rows are summed by (id, part, mask), meet their labels, and are summed
   by (part, mask): at most 2 to the number of filters for each part. All orders are answered from these counters.

Defined results: a null text counts as an empty one, a null part as an empty string; empty texts are copies of each other;
rows of equal ids are no duplicates of each other; a null id is never larger or smaller than another, and has no labels;
of several labels of an id the highest counts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.store import Scratch, released

CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ARROW = pa.schema([("id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("n", pa.int64()), ("edge", pa.binary())])
ROWS_AT_ONCE = 20_000


@dataclass(frozen=True)
class TextFilters:
    """Thresholds of the filters that look at one text; duplicates are the last filter."""

    min_words: int = 200
    min_distinct_percent: int = 50
    max_capital_percent: int = 3
    symbols: bytes = b"#$%&*|"
    letters: str = "ABCDE"

    @property
    def duplicate(self) -> int:
        """The bit of the filter of duplicates."""
        return 1 << (len(self.letters) - 1)

    def mask(self, text: bytes) -> int:
        """The bits of the filters that a text fails by itself."""
        words = text.split()  # bytes split at ASCII white space only
        capitals = len(text) - len(text.translate(None, CAPITALS))
        return (
            (len(words) < self.min_words)
            | (100 * len(set(words)) < self.min_distinct_percent * len(words)) << 1
            | (100 * capitals > self.max_capital_percent * len(text.decode())) << 2
            | (len(text.translate(None, self.symbols)) < len(text)) << 3
        )


class Sorted:
    """Judges rows in the order of fingerprint, text and id; the rows that another task may change wait for the end of their fingerprint."""

    def __init__(self, filters: TextFilters):
        self.filters = filters
        self.done: list[tuple] = []
        self.runs = 0
        self.fingerprint: int | None = None
        self.text: bytes | None = None
        self.first_id: int | None = None
        self.own = 0
        self.first: Counter = Counter()
        self.digest = b""

    def add(self, fingerprint: int, text: bytes, doc_id: int | None, part: str) -> None:
        if fingerprint != self.fingerprint:
            self._close(last=False)
            self.fingerprint, self.text = fingerprint, None
            self.runs += 1
        if text != self.text:
            self.text, self.first_id = text, None
            self.own = self.filters.mask(text)
            self.digest = hashlib.sha256(text).digest()
        if doc_id is None:
            self.done.append((None, part, self.own, 1, None))
        elif self.first_id is None or doc_id == self.first_id:
            self.first_id = doc_id
            self.first[self.digest, doc_id, part, self.own] += 1
        else:
            self.done.append((doc_id, part, self.own | self.filters.duplicate, 1, None))

    def _close(self, last: bool) -> None:
        edge = last or self.runs == 1
        self.done += [(doc_id, part, mask, n, digest if edge else None) for (digest, doc_id, part, mask), n in self.first.items()]
        self.first.clear()

    def finish(self) -> None:
        self._close(last=True)

    def take(self) -> list[tuple]:
        rows, self.done = self.done, []
        return rows


def failure_masks(docs: DataFrame, filters: TextFilters = TextFilters(), part: str = "lang") -> DataFrame:
    """The rows by id, part and mask of failed filters: ``id``, ``part``, ``mask`` and their number ``n``."""

    def of_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judged = Sorted(filters)

        def rows(end: bool) -> Iterator[pa.RecordBatch]:
            if judged.done and (end or len(judged.done) >= ROWS_AT_ONCE):
                columns = [pa.array(c, f.type) for c, f in zip(zip(*judged.take(), strict=True), ARROW, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=ARROW)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("fingerprint", "body", "id", "part")]
            for row in zip(*columns, strict=True):
                judged.add(*row)
            yield from rows(False)
        judged.finish()
        yield from rows(True)

    scratch = Scratch(docs.sparkSession, "masks")
    body = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"), body.cast("binary").alias("body"), F.xxhash64(body).alias("fingerprint"))
    ranged = keyed.repartitionByRange("fingerprint", "id").sortWithinPartitions("fingerprint", "body", "id")
    schema = "id long, part string, mask int, n long, edge binary"
    judged = scratch.cut(ranged.mapInArrow(released(of_range), schema))
    edges = judged.where("edge is not null")
    smallest = edges.groupBy("edge").agg(F.min("id").alias("smallest"))
    known = edges.join(smallest, "edge").withColumn("mask", F.when(F.col("id") > F.col("smallest"), F.col("mask").bitwiseOR(filters.duplicate)).otherwise(F.col("mask")))
    names = ["id", "part", "mask", "n"]
    return judged.where("edge is null").select(names).unionByName(known.select(names)).groupBy("id", "part", "mask").agg(F.sum("n").alias("n"))


def counters(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows, good rows and toxic rows by part and mask: ``part``, ``mask``, ``n``, ``good`` and ``toxic``."""
    of_id = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    met = masks.join(of_id, "id", "left")

    def rows_with(label: str):
        return F.sum(F.when(F.col(label) == 1, F.col("n")).otherwise(0))

    return met.groupBy("part", "mask").agg(F.sum("n").alias("n"), rows_with("quality").alias("good"), rows_with("toxic").alias("toxic"))


def in_all_orders(counted: DataFrame, letters: str) -> DataFrame:
    """The counts of each part, order of filters and step, from the counters of masks."""
    bit = {x: 1 << i for i, x in enumerate(letters)}
    orders = F.explode(F.array(*[F.lit("".join(o)) for o in itertools.permutations(letters)]))
    steps = F.explode(F.sequence(F.lit(1), F.lit(len(letters))))
    bits = F.create_map(*[F.lit(x) for pair in bit.items() for x in pair])
    placed = counted.withColumn("filter_order", orders).withColumn("step", steps).withColumn("letter", F.substring("filter_order", F.col("step"), F.lit(1)))
    before = F.aggregate(F.split(F.substring("filter_order", F.lit(1), F.col("step") - 1), ""), F.lit(0), lambda m, x: m.bitwiseOR(F.coalesce(F.try_element_at(bits, x), F.lit(0))))
    placed = placed.withColumn("own", bits[F.col("letter")]).withColumn("before", before)
    fails, gone = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0

    def total(condition, column: str, name: str):
        return F.sum(F.when(condition, F.col(column)).otherwise(0)).alias(name)

    per_step = placed.groupBy("part", "filter_order", "step", "letter").agg(
        total(~fails & ~gone, "n", "kept"),
        total(fails & ~gone, "n", "removed"),
        total(fails & gone, "n", "redundant"),
        total(F.col("mask") == F.col("own"), "n", "unique_fails"),
        total(fails & ~gone, "good", "good_lost"),
        total(fails & ~gone, "toxic", "toxic_lost"),
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "letter")).alias("shapley")
    return per_step.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", shapley)


def audit(docs: DataFrame, labels: DataFrame, filters: TextFilters = TextFilters(), part: str = "lang") -> DataFrame:
    """One row for each part, order of all filters and step, zeros included."""
    return in_all_orders(counters(failure_masks(docs, filters, part), labels), filters.letters)
