"""Registered queries of the document store and of what treatment reports.

Detection uses the email pattern where SQL has to follow; the queries that end in ``_all`` elsewhere use every pattern.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import numbers
from millrace.operators import documents as store
from millrace.operators import privacy as p
from millrace.plans.privacy_queries import EMAIL, EMAIL_SQL
from millrace.plans.registry import register
from millrace.sources.tables import table

MASKED = rf"""v as (select doc_id, text raw, regexp_extract_all(text, '{EMAIL_SQL}') vs, regexp_split_to_array(text, '{EMAIL_SQL}') gaps from documents),
n as (select *, [list_position(firsts, x) for x in vs] nr from (select *, [vs[i] for i in range(1, len(vs) + 1) if list_position(vs, vs[i]) = i] firsts from v)),
done as (select doc_id, array_to_string([gaps[i] || coalesce('[CONTACT_' || nr[i] || ']', '') for i in range(1, len(gaps) + 1)], '') t, len(vs)::bigint pii_count, vs, nr from n)"""
RISK_SQL = "case when pii_count < 1 then 'low' when pii_count < 10 then 'medium' when pii_count < 30 then 'high' else 'critical' end"
WORDS_SQL = r"""w as (select doc_id, t, pii_count, regexp_extract_all(t, '(?s)\S+\s*') p from done),
c as (select *, unnest(case when len(p) <= 100 then [0] else range(0, len(p), 80) end) s from w),
chunk as (select doc_id, pii_count, (s // 80)::int chunk_idx, (case when len(p) <= 100 then 0 else length(regexp_extract(t, '^\s*')) + length(array_to_string(p[1:s], '')) end)::int chunk_offset,
    case when len(p) <= 100 then t else array_to_string(p[s + 1:s + 100], '') end chunk_text from c)"""


def _ingested(spark: SparkSession, d: str) -> store.Ingested:
    return store.ingest(table(spark, d, "documents"), "max", (EMAIL,), 100, 20)


@register("d2_1_ingest_documents", f"with {MASKED} select doc_id, t anon_text, pii_count, true ner_degraded, substr(t, 1, 500) preview from done")
def ingest_documents(spark: SparkSession, d: str) -> DataFrame:
    return _ingested(spark, d).documents


@register("d2_1_ingest_chunks", f"with {MASKED}, {WORDS_SQL} select doc_id, chunk_idx, chunk_offset, chunk_text from chunk")
def ingest_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _ingested(spark, d).chunks


@register(
    "d2_1_ingest_answers",
    f"""with {MASKED}, {WORDS_SQL}, k as (select doc_id, count(*)::int chunk_count from chunk group by 1)
    select doc_id, pii_count, chunk_count, true ner_degraded, {RISK_SQL} risk,
        case when pii_count = 0 then 'No PII detected' else 'Detected ' || pii_count || ' PII entities via L1 only: ' || pii_count || '×Contact' end explanation from done join k using (doc_id)""",
)
def ingest_answers(spark: SparkSession, d: str) -> DataFrame:
    return _ingested(spark, d).answers


@register("d2_1_ingest_audit", f"with {MASKED} select 'ingest' event_type, doc_id, pii_count from done")
def ingest_audit(spark: SparkSession, d: str) -> DataFrame:
    return _ingested(spark, d).audit


@register(
    "d2_2_entity_map",
    f"with {MASKED} select doc_id, 'Contact' entity_type, '[CONTACT_' || unnest(nr) || ']' pseudonym, 'mask' treatment, true ner_degraded from done",
)
def entity_map(spark: SparkSession, d: str) -> DataFrame:
    return _ingested(spark, d).entities


@register(
    "d2_3_search_chunks",
    f"with {MASKED}, {WORDS_SQL} select doc_id, chunk_idx, chunk_text from chunk where chunk_text ilike '%tion%' order by doc_id, chunk_idx limit 200",
)
def search_chunks(spark: SparkSession, d: str) -> DataFrame:
    made = _ingested(spark, d)
    return store.search(made.documents, made.chunks, "TION", 200)


@register(
    "d2_3_search_fallback",
    f"""with {MASKED}, h as (select doc_id, t, instr(lower(t), 'contact_') q from done)
    select doc_id, null::int chunk_idx, '…' || substr(t, greatest(q - 50, 1), q - greatest(q - 50, 1) + 8 + 50) || '…' chunk_text from h where q > 0 order by doc_id limit 200""",
)
def search_fallback(spark: SparkSession, d: str) -> DataFrame:
    """No chunk of none holds the needle, so whole documents are searched; its underscore stands for itself."""
    made = _ingested(spark, d)
    return store.search(made.documents, made.chunks.where("chunk_idx < 0"), "contact_", 200)


@register(
    "d2_4_vector_search",
    """with q as (select vec_id query_id, embedding::double[] q from embeddings where vec_id % 100 = 0),
    s as (select query_id, vec_id, list_cosine_similarity(embedding::double[], q) c from embeddings, q)
    select query_id, vec_id, round(c, 6) score from (select *, row_number() over (partition by query_id order by c desc, vec_id) k from s) x where k <= 10""",
)
def nearest(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    found = store.nearest(e, e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"))
    return found.withColumn("score", F.round("score", 6))


AUDIT_SQL = "a as (select event_id id, user_id doc_id, event_type, ts from events where event_type in ('purchase', 'error'))"


def _audit(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type in ('purchase', 'error')")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("doc_id"), "event_type", "ts")


@register("d2_6_audit_of", f"with {AUDIT_SQL} select id, event_type from a where doc_id = 7 order by ts desc, id desc limit 50")
def audit_of(spark: SparkSession, d: str) -> DataFrame:
    return store.audit_of(_audit(spark, d), 7).select("id", "event_type")


@register(
    "d2_7_audit_report",
    f"with {AUDIT_SQL} select id, doc_id, event_type from a where ts >= timestamp '2024-01-05 00:00:00' and epoch(ts)::bigint <= epoch(timestamp '2024-01-09 00:00:00') order by id desc limit 200",
)
def audit_report(spark: SparkSession, d: str) -> DataFrame:
    audit = _audit(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    return store.audit_report(audit, date_from="2024-01-05", date_to="2024-01-09").select("id", "doc_id", "event_type")


@register("d2_9_review_by_pii", f"with {MASKED} select doc_id, pii_count, true ner_degraded, {RISK_SQL} risk from done where pii_count >= 2 order by pii_count desc, doc_id limit 50")
def review(spark: SparkSession, d: str) -> DataFrame:
    return store.review_queue(_ingested(spark, d).documents, least=2)



@register("d2_10_erase", f"with {MASKED} select 'ingest' event_type, doc_id, pii_count from done union all select 'delete', doc_id, null from labels where toxic = 1 and doc_id in (select doc_id from documents)")
def erase_audit(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    return store.erase(_ingested(spark, d), gone)[1]


@register("d2_10_erase_chunks", f"with {MASKED}, {WORDS_SQL} select doc_id, chunk_idx from chunk where doc_id not in (select doc_id from labels where toxic = 1)")
def erase_chunks(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    return store.erase(_ingested(spark, d), gone)[0].chunks.select("doc_id", "chunk_idx")


@register("d2_10_erase_unknown", "select doc_id + 10000000 as doc_id from labels where toxic = 1")
def erase_unknown(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "labels").where("toxic = 1").select((F.col("doc_id") + 10_000_000).alias("doc_id"))
    return store.erase(_ingested(spark, d), gone)[2]


@register("d2_11_listing", f"with {MASKED}, r as (select {RISK_SQL} risk from done) select risk, count(*) n, (sum(count(*)) over ())::bigint total from r group by risk")
def listing(spark: SparkSession, d: str) -> DataFrame:
    return store.listing(_ingested(spark, d).documents)


def _treated(spark: SparkSession, d: str, profile: str = "max") -> DataFrame:
    return p.anonymize(table(spark, d, "documents"), profile, (EMAIL,))


@register("d1_6_breakdown", f"with {MASKED} select doc_id, 'Contact' category, 'mask' treatment from done where pii_count > 0")
def breakdown(spark: SparkSession, d: str) -> DataFrame:
    made = store.treatment_breakdown(F.col("spans"))
    return _treated(spark, d).select("doc_id", F.explode(made).alias("category", "treatment"))


@register("d1_7_kept", rf"with v as (select doc_id, regexp_extract_all(text, '{EMAIL_SQL}') vs from documents) select doc_id, generate_subscripts(vs, 1)::int - 1 pos, unnest(vs) as value from v")
def kept(spark: SparkSession, d: str) -> DataFrame:
    """Addresses as a category that the profile keeps."""
    role = (("Role", EMAIL[1]),)
    done = p.anonymize(table(spark, d, "documents"), "deal", role)
    return done.select("doc_id", F.posexplode(store.kept_entities(F.col("spans"))).alias("pos", "value"))


@register("d1_11_restore_pseudonyms", "select doc_id, text from documents")
def restored(spark: SparkSession, d: str) -> DataFrame:
    """Addresses as organisations under a profile that gives pseudonyms and then masks; restored, texts are as before."""
    done = p.anonymize(table(spark, d, "documents"), "litige", (("Org", EMAIL[1]),))
    return done.select("doc_id", store.restore_all(F.col("text"), F.col("token_map")).alias("text"))


@register("d1_12_fail_closed", f"with {MASKED} select doc_id, case when doc_id % 9 = 0 then '{p.BLOCKED}' else t end as text from done")
def fail_closed(spark: SparkSession, d: str) -> DataFrame:
    return _treated(spark, d).select("doc_id", store.fail_closed(F.col("text"), F.col("doc_id") % 9 == 0).alias("text"))


@register("d1_16_token_table", f"with {MASKED}, x as (select doc_id, unnest(nr) k, unnest(vs) as value from done) select distinct doc_id, '[CONTACT_' || k || ']' token, value from x")
def token_table(spark: SparkSession, d: str) -> DataFrame:
    return store.token_table(_treated(spark, d))


@register("f74_inverted", f"with {MASKED}, x as (select doc_id, unnest(nr) k, unnest(vs) as value from done) select distinct doc_id, value, '[CONTACT_' || k || ']' token from x")
def inverted(spark: SparkSession, d: str) -> DataFrame:
    entries = F.map_from_entries(F.transform(F.map_entries("token_map"), lambda e: F.struct(e["value"], e["key"])))
    return _treated(spark, d).select("doc_id", F.explode(entries).alias("value", "token"))


@register("f75_overlaps", rf"select doc_id, unnest(regexp_extract_all(text, '{EMAIL_SQL}')) as value from documents")
def overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Addresses are found twice, whole and by their hosts; the shorter spans go."""
    twice = (EMAIL, ("Org", r"@[A-Za-z0-9-]+"))
    spans = p.dedup(p.detect(F.col("text"), twice))
    return table(spark, d, "documents").select("doc_id", F.inline(spans)).where("category = 'Contact'").select("doc_id", "value")


@register("f50_cosine", "select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 9) c from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", F.round(numbers.cosine(F.col("embedding"), F.col("other")), 9).alias("c"))
