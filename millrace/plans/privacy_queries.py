"""Registered queries of detection, treatment and restoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import privacy as p
from millrace.plans.registry import register
from millrace.sources.shared import shared_path
from millrace.sources.tables import table

EMAIL = p.STRUCTURED[0]
EMAIL_SQL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"


@register("d1_1_detect_structured", "\n union all ".join(
    rf"select doc_id, {i} as rule, '{c}' category, value from (select doc_id, unnest(regexp_extract_all(text, '{x}')) as value from documents)" for i, (c, x) in enumerate(p.STRUCTURED)
))
def detect_structured(spark: SparkSession, d: str) -> DataFrame:
    spans = p.detect(F.col("text"), p.STRUCTURED)
    return table(spark, d, "documents").select("doc_id", F.inline(spans)).select("doc_id", "rule", "category", "value")


@register("d1_2_detect_legal")
def detect_legal(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.inline(p.detect(F.col("text"), p.LEGAL)))


@register("d1_3_span_dedup")
def span_dedup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.inline(p.dedup(p.detect(F.col("text")))))


@register(
    "d1_5_mask_emails",
    rf"""with v as (select doc_id, text, regexp_extract_all(text, '{EMAIL_SQL}') vs, regexp_split_to_array(text, '{EMAIL_SQL}') gaps from documents),
    n as (select *, [list_position(list_distinct_ordered, x) for x in vs] nr from (select *, [vs[i] for i in range(1, len(vs) + 1) if list_position(vs, vs[i]) = i] list_distinct_ordered from v))
    select doc_id, array_to_string([gaps[i] || coalesce('[CONTACT_' || nr[i] || ']', '') for i in range(1, len(gaps) + 1)], '') as text, len(vs)::bigint pii_count from n""",
)
def mask_emails(spark: SparkSession, d: str) -> DataFrame:
    return p.anonymize(table(spark, d, "documents"), "max", (EMAIL,)).select("doc_id", "text", "pii_count")


@register("d1_8_round_trip", "select doc_id, text from documents")
def round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Masked texts restored from their token maps are the documents again."""
    out = p.anonymize(table(spark, d, "documents"), "max", (EMAIL,))
    return out.select("doc_id", p.restore(F.col("text"), F.col("token_map")).alias("text"))


@register(
    "d1_9_vault",
    rf"""with s as (select doc_id, unnest(regexp_extract_all(text, '{EMAIL_SQL}')) as value, generate_subscripts(regexp_extract_all(text, '{EMAIL_SQL}'), 1) i from documents),
    f as (select value, min((doc_id, i)) a from s group by value)
    select 'Contact' category, value, 'CONTACT_' || row_number() over (order by a) token from f""",
)
def vault(spark: SparkSession, d: str) -> DataFrame:
    return p.vault(table(spark, d, "documents"), (EMAIL,))


# Dates before phone numbers: the phone pattern matches a whole date too, and of equal spans the earlier rule stays.
ALL = p.LEGAL + (p.STRUCTURED[3], *p.STRUCTURED[:3])


@register("d1_4_treat_all")
def treat_all(spark: SparkSession, d: str) -> DataFrame:
    """All documents with all patterns under a profile that masks, keeps, generalizes, gives pseudonyms and relativizes."""
    out = p.anonymize(table(spark, d, "documents"), "litige", ALL)
    return out.select("doc_id", "text", "pii_count", F.size("token_map").alias("tokens"))


@register("d1_5_mask_all")
def mask_all(spark: SparkSession, d: str) -> DataFrame:
    return p.anonymize(table(spark, d, "documents"), "max", ALL).select("doc_id", "text", "pii_count")


@register("d1_8_round_trip_all", "select doc_id, text from documents")
def round_trip_all(spark: SparkSession, d: str) -> DataFrame:
    """Texts masked with all patterns and restored are the documents again."""
    out = p.anonymize(table(spark, d, "documents"), "max", ALL)
    return out.select("doc_id", p.restore(F.col("text"), F.col("token_map")).alias("text"))


@register("d1_9_vault_all")
def vault_all(spark: SparkSession, d: str) -> DataFrame:
    return p.vault(table(spark, d, "documents"), ALL)


@register(
    "d1_9_masked_by_vault",
    rf"""with s as (select doc_id, unnest(regexp_extract_all(text, '{EMAIL_SQL}')) as value, generate_subscripts(regexp_extract_all(text, '{EMAIL_SQL}'), 1) i from documents),
    f as (select value, min((doc_id, i)) a from s group by value), v as (select value, '[CONTACT_' || row_number() over (order by a) || ']' token from f),
    t as (select s.doc_id, list(token order by i) ts from s join v using (value) group by 1)
    select d.doc_id, case when ts is null then d.text else array_to_string([g || coalesce(ts[i], '') for g, i in regexp_split_to_array(d.text, '{EMAIL_SQL}')], '') end as text
    from documents d left join t on t.doc_id = d.doc_id""",
)
def masked_by_vault(spark: SparkSession, d: str) -> DataFrame:
    """Addresses replaced by tokens that are the same in all documents."""
    found = p.detected(table(spark, d, "documents"), (EMAIL,))
    return p.mask_found(found, p.vault_of(found))


@register("d1_10_rehydrated", "select doc_id, text from documents")
def rehydrated(spark: SparkSession, d: str) -> DataFrame:
    """Texts masked by the vault of all documents, with all patterns, and put back from the vault's table."""
    found = p.detected(table(spark, d, "documents"), ALL)  # both the vault and the masks need the spans
    known = shared_path(spark, "vault")  # numbered once: two looks at it must agree
    p.vault_of(found).write.parquet(known)
    tokens = spark.read.parquet(known)
    return p.rehydrate(p.mask_found(found, tokens), tokens)


@register("d1_15_profiles", "select * from (values " + ", ".join(f"('{x}', 30)" for x in p.PROFILES) + ") v(profile, treatment_count)")
def profiles(spark: SparkSession, d: str) -> DataFrame:
    rows = [(x, c) for x in p.PROFILES for c in p.TREATMENTS]
    return spark.createDataFrame(rows, "profile string, category string").groupBy("profile").agg(F.count("*").cast("int").alias("treatment_count"))


@register(
    "j17_treatment_matrix",
    "select * from (values " + ", ".join(f"('{x}', '{c}', '{p.NAMES[t]}')" for c, ts in p.TREATMENTS.items() for x, t in zip(p.PROFILES, ts, strict=True)) + ") v(profile, category, treatment)",
)
def matrix(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(x, c) for x in p.PROFILES for c in p.TREATMENTS], "profile string, category string")
    return rows.withColumn("treatment", p.treatment(F.col("category"), F.col("profile")))
