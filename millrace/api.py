"""The functions that a service would offer, plug-ins, and hooks around them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import accounts, documents, privacy


@dataclass
class Service:
    """The document tools over frames: ingest, search, audit, delete, anonymize, deanonymize, list and review.

    ``hooks`` are called in their order, each with the name of the tool and the frame that the one before it returned.
    """

    spark: SparkSession
    profile: str = "max"
    patterns: tuple = privacy.LEGAL + privacy.STRUCTURED
    stored: documents.Ingested | None = None
    hooks: list[Callable[[str, DataFrame], DataFrame]] = field(default_factory=list)

    def _hooked(self, tool: str, out: DataFrame) -> DataFrame:
        for hook in self.hooks:
            out = hook(tool, out)
        return out

    def ingest(self, docs: DataFrame) -> DataFrame:
        new = documents.ingest(docs, self.profile, self.patterns)
        old = self.stored
        frames = ("documents", "chunks", "entities", "audit", "answers")
        self.stored = new if old is None else documents.Ingested(*[getattr(old, f).unionByName(getattr(new, f)) for f in frames])
        return self._hooked("ingest", new.answers)

    def _there(self) -> documents.Ingested:
        if self.stored is None:
            raise LookupError("nothing is ingested")
        return self.stored

    def search(self, needle: str, limit: int = 10) -> DataFrame:
        return self._hooked("search", documents.search(self._there().documents, self._there().chunks, needle, limit))

    def audit(self, action: str | None = None) -> DataFrame:
        rows = self._there().audit
        return self._hooked("audit", rows if action is None else rows.where(F.col("event_type") == accounts.checked_action(action, ("ingest", "delete"))))

    def delete(self, ids: DataFrame) -> DataFrame:
        """Erase documents; an id that is not there is an error, and nothing is erased then."""
        left, _, unknown = documents.erase(self._there(), ids)
        if accounts.exists(unknown, F.lit(True)):
            raise LookupError("a document is not there")
        self.stored = left
        return self._hooked("delete", left.audit.where("event_type = 'delete'"))

    def anonymize(self, docs: DataFrame, profile: str | None = None) -> DataFrame:
        return self._hooked("anonymize", privacy.anonymize(docs, profile or self.profile, self.patterns))

    def deanonymize(self, treated: DataFrame) -> DataFrame:
        restored = documents.restore_all(F.col("text"), F.col("token_map")).alias("text")
        return self._hooked("deanonymize", treated.select("doc_id", restored))

    def list_documents(self) -> DataFrame:
        return self._hooked("list_documents", documents.listing(self._there().documents))

    def review_queue(self, least: int = documents.REVIEW_LEAST) -> DataFrame:
        return self._hooked("review_queue", documents.review_queue(self._there().documents, least))


def tool(spark: SparkSession, name: str, returns: str) -> Callable:
    """Decorator that offers a Python function over Arrow series to SQL under a name."""
    import pandas as pd  # noqa: F401

    def add(f: Callable) -> Callable:
        spark.udf.register(name, F.pandas_udf(f, returns))
        return f

    return add


def patterns_of(table: DataFrame) -> tuple:
    """Custom detectors of a table (category, regex, optionally enabled), in the order of their names.

    The table is a configuration of a few rows; a regex that does not compile is an error that names it.
    """
    rows = table.where("coalesce(enabled, true)") if "enabled" in table.columns else table
    out = []
    for r in rows.orderBy("name").collect():
        try:
            table.sparkSession.range(1).select(F.regexp_like(F.lit(""), F.lit(r["regex"]))).collect()
        except Exception as e:
            raise ValueError(f"pattern {r['name']!r} does not compile") from e
        out.append((r["category"], r["regex"]))
    return tuple(out)


def on_batches(stream: DataFrame, subscribers: dict[str, Callable[[DataFrame, int], None]], kind: str = "event_type"):
    """Run subscribers over a stream of events: each gets the rows of its kind of every batch, ``*`` gets all."""

    def deliver(df: DataFrame, batch: int) -> None:
        df.persist()
        for name, f in subscribers.items():
            f(df if name == "*" else df.where(F.col(kind) == name), batch)
        df.unpersist()

    return stream.writeStream.foreachBatch(deliver).trigger(availableNow=True)


def chained(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """One step of several that each change what the one before it returned."""

    def run(df: DataFrame) -> DataFrame:
        for step in steps:
            df = df.transform(step)
        return df

    return run


def detector(category: str, regex: str) -> Callable[[Column], Column]:
    """A detector of one's own as a function of a text column."""
    return lambda text: privacy.spans_of(text, category, regex)
