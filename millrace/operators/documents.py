"""The document store: ingest into frames, search, audit, review and erasure."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import neighbours, privacy
from millrace.sources.shared import shared_path

# Numbers of personal data from which on a document's risk is higher.
RISK_LEVELS = (("low", 1), ("medium", 10), ("high", 30))
TOP_RISK = "critical"
REVIEW_LEAST, REVIEW_ROWS, REPORT_ROWS, AUDIT_ROWS = 20, 50, 200, 50


@dataclass(frozen=True)
class Ingested:
    """The frames that an ingest writes; the first four are what is stored, the last is the answer for each document."""

    documents: DataFrame
    chunks: DataFrame
    entities: DataFrame
    audit: DataFrame
    answers: DataFrame


def risk_level(pii_count: Column) -> Column:
    out = F.lit(TOP_RISK)
    for name, below in reversed(RISK_LEVELS):
        out = F.when(pii_count < below, name).otherwise(out)
    return out


def explanation(spans: Column, degraded: Column) -> Column:
    """What was found, as counts by category in the order of their texts."""

    def told(of: Column) -> Column:
        names = F.array_distinct(F.transform(of, lambda s: s["category"]))
        parts = F.transform(names, lambda n: F.concat(F.size(F.filter(of, lambda s: s["category"] == n)).cast("string"), F.lit("×"), n))
        layer = F.when(degraded, "L1 only").otherwise("L1+L2")
        said = F.concat(F.lit("Detected "), F.size(of).cast("string"), F.lit(" PII entities via "), layer, F.lit(": "), F.array_join(F.array_sort(parts), ", "))
        return F.when(F.size(of) == 0, "No PII detected").otherwise(said)

    return F.transform(F.array(spans), told)[0]


def ingest(docs: DataFrame, profile: str = "max", patterns=privacy.LEGAL, chunk_words: int = 400, overlap: int = 50, key: str = "doc_id", degraded: bool = True, at_once: bool = False) -> Ingested:
    """Treat, cut and record documents (key, text). No stored frame holds the text as it came.

    Where several of the frames are used, ``at_once`` writes the treated documents to the shared folder, so that they are
    detected once. Without a second detection layer documents are marked as degraded, as here, where there is none.
    """
    done = privacy.anonymize(docs, profile, patterns, key).withColumn("ner_degraded", F.lit(degraded))
    if at_once:
        path = shared_path(docs.sparkSession, "treated")
        done.write.parquet(path)
        done = docs.sparkSession.read.schema(done.schema).parquet(path)
    documents = done.select(key, F.col("text").alias("anon_text"), "pii_count", "ner_degraded", text.preview(F.col("text")).alias("preview"))
    chunks = done.select(key, F.inline(text.chunks(F.col("text"), chunk_words, overlap)))
    entities = done.select(key, F.inline("spans"), "ner_degraded").select(key, F.col("category").alias("entity_type"), F.col("replacement").alias("pseudonym"), "treatment", "ner_degraded")
    audit = done.select(F.lit("ingest").alias("event_type"), key, "pii_count")
    answers = done.select(
        key,
        "pii_count",
        text.chunk_count(F.col("text"), chunk_words, overlap).alias("chunk_count"),
        "ner_degraded",
        risk_level(F.col("pii_count")).alias("risk"),
        explanation(F.col("spans"), F.col("ner_degraded")).alias("explanation"),
    )
    return Ingested(documents, chunks, entities, audit, answers)


def treatment_breakdown(spans: Column) -> Column:
    """Category to treatment, for the categories that occur; a category has one treatment under a profile."""
    pairs = F.array_distinct(F.transform(spans, lambda s: F.struct(s["category"], s["treatment"])))
    return F.map_from_entries(pairs)


def kept_entities(spans: Column) -> Column:
    """The values that stay as they are, in text order, repeats included."""
    return F.transform(F.filter(spans, lambda s: s["treatment"] == "keep"), lambda s: s["value"])


def fail_closed(cleaned: Column, failed: Column) -> Column:
    """Where detection failed, the blocked notice; no text passes that was not treated."""
    return F.when(F.coalesce(failed, F.lit(True)) | cleaned.isNull(), F.lit(privacy.BLOCKED)).otherwise(cleaned)


def restore_all(text_: Column, tokens: Column) -> Column:
    """All tokens of a map replaced by their values, longest token first, so that one may begin like another."""
    longest = F.array_sort(F.transform(F.map_entries(tokens), lambda e: F.struct((-F.length(e["key"])).alias("n"), e["key"].alias("key"), e["value"].alias("value"))))
    return F.aggregate(longest, text_, lambda a, e: F.replace(a, e["key"], e["value"]))


def token_table(done: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, token, value): what each session's tokens stand for."""
    return done.select(key, F.explode("token_map").alias("token", "value"))


def search(documents: DataFrame, chunks: DataFrame, needle: str, limit: int = 10, key: str = "doc_id") -> DataFrame:
    """(key, chunk_idx, chunk_text): chunks that hold the needle; only if none does, the documents' surroundings of it.

    The needle is taken as it is, and letters of either case are alike. The reference leaves the order open; here it
    is that of keys and chunks.
    """
    pattern = "%" + needle.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    of_chunks = chunks.where(F.col("chunk_text").ilike(pattern)).select(key, F.col("chunk_idx").cast("int").alias("chunk_idx"), "chunk_text")
    of_chunks = of_chunks.orderBy(key, "chunk_idx").limit(limit).withColumn("__p", F.lit(0))
    whole = documents.where(F.col("anon_text").ilike(pattern)).select(key, F.lit(None).cast("int").alias("chunk_idx"), text.snippet(F.col("anon_text"), needle).alias("chunk_text"))
    both = of_chunks.unionByName(whole.orderBy(key).limit(limit).withColumn("__p", F.lit(1)))
    # At most twice ``limit`` rows are ranked.
    return both.withColumn("__best", F.min("__p").over(Window.partitionBy(F.lit(0)))).where("__p = __best").drop("__p", "__best")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 1024, rows: int = 4096) -> DataFrame:
    """(query_id, vec_id, score): the k rows (vec_id, embedding) of highest cosine for each query (query_id, embedding).

    This compares all pairs; ``collection.Collection`` keeps an index that does not. The stated set of queries is dealt into
    blocks of about ``block`` and the vectors into blocks of about ``rows``; each pair of blocks is one matrix product, and
    at most k rows for a query leave it. Ties go by vec_id. Vectors of another length than the query's, and those of norm
    0 or with null or non-finite components, score 0; rows without a vec_id are left out.
    """
    asked = max(1, -(-queries.count() // block))
    held = max(1, -(-vectors.count() // rows))

    def dealt(df: DataFrame, key: str, own: str, n: int, other: str, m: int) -> DataFrame:
        at = F.pmod(F.xxhash64(key, F.lit(1)), F.lit(n)).cast("int")
        return df.select(key, "embedding", at.alias(own), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other))

    left = dealt(vectors, "vec_id", "rows", held, "asked", asked).groupBy("rows", "asked")
    right = dealt(queries, "query_id", "asked", asked, "rows", held).groupBy("rows", "asked")
    best = left.cogroup(right).applyInArrow(lambda v, q: neighbours.best(q.select(["query_id", "embedding"]), v.select(["vec_id", "embedding"]), k), neighbours.SCHEMA)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("k", F.row_number().over(order)).where(F.col("k") <= k).drop("k")


def audit_of(audit: DataFrame, doc_id, limit: int = AUDIT_ROWS) -> DataFrame:
    """The newest events of a document."""
    return audit.where(F.col("doc_id") == doc_id).orderBy(F.desc("ts"), F.desc("id")).limit(limit)


def audit_report(audit: DataFrame, doc_id=None, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """The newest events, at most REPORT_ROWS, of a document and between the midnights of two days, both included."""
    from millrace.functions import dates

    seconds = F.unix_timestamp("ts")
    out = audit if doc_id is None else audit.where(F.col("doc_id") == doc_id)
    out = out.where(seconds >= dates.epoch_day(F.lit(date_from))) if date_from else out
    out = out.where(seconds <= dates.epoch_day(F.lit(date_to))) if date_to else out
    return out.orderBy(F.desc("id")).limit(REPORT_ROWS)


def review_queue(documents: DataFrame, least: int = REVIEW_LEAST, limit: int = REVIEW_ROWS, key: str = "doc_id") -> DataFrame:
    """The documents with most personal data first."""
    due = documents.where(F.col("pii_count") >= least).select(key, "pii_count", "ner_degraded", risk_level(F.col("pii_count")).alias("risk"))
    return due.orderBy(F.desc("pii_count"), key).limit(limit)


def listing(documents: DataFrame) -> DataFrame:
    """(risk, n, total): documents by risk, and how many there are in all."""
    per = documents.groupBy(risk_level(F.col("pii_count")).alias("risk")).agg(F.count("*").alias("n"))
    return per.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0))))


def erase(stored: Ingested, ids: DataFrame, key: str = "doc_id") -> tuple[Ingested, DataFrame, DataFrame]:
    """The frames without these documents, with an audit row for each that was there; and the ids that were not.

    ``ids`` has one column, the key.
    """
    wanted = ids.select(F.col(ids.columns[0]).alias(key)).distinct()
    there = wanted.join(stored.documents.select(key).distinct(), key, "left_semi")
    gone = there.select(F.lit("delete").alias("event_type"), key, F.lit(None).cast("long").alias("pii_count"))
    left = [f.join(there, key, "left_anti") for f in (stored.documents, stored.chunks, stored.entities)]
    audit = stored.audit.unionByName(gone)
    return Ingested(*left, audit, stored.answers.join(there, key, "left_anti")), audit, wanted.join(there, key, "left_anti")
