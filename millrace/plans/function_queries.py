"""Registered queries of the text, date and number functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import dates, markup, numbers, text
from millrace.plans.registry import register
from millrace.sources.tables import table


@register("f1_like_escape", r"select p_partkey, replace(replace(replace('a%' || p_name || '_\', '\', '\\'), '%', '\%'), '_', '\_') escaped from part")
def like_escape(spark: SparkSession, d: str) -> DataFrame:
    s = F.concat(F.lit("a%"), "p_name", F.lit("_\\"))
    return table(spark, d, "part").select("p_partkey", text.like_escape(s).alias("escaped"))


@register(
    "f2_snippet",
    """select doc_id, case when p > 0 then '…' || substr(text, greatest(p - 50, 1), p - greatest(p - 50, 1) + 4 + 50) || '…' else substr(text, 1, 100) end snippet
    from (select doc_id, text, instr(lower(text), 'tion') p from documents)""",
)
def snippet(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.snippet(F.col("text"), "tion").alias("snippet"))


@register(
    "f3_chunks",
    r"""with w as (select doc_id, text, regexp_extract_all(text, '(?s)\S+\s*') p from documents),
    c as (select doc_id, text, p, unnest(case when len(p) <= 100 then [0] else range(0, len(p), 80) end) s from w)
    select doc_id, (s // 80)::int chunk_idx, (case when len(p) <= 100 then 0 else length(regexp_extract(text, '^\s*')) + length(array_to_string(p[1:s], '')) end)::int chunk_offset,
        case when len(p) <= 100 then text else array_to_string(p[s + 1:s + 100], '') end chunk_text from c""",
)
def chunked(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "documents").select("doc_id", F.inline(text.chunks(F.col("text"), 100, 20)))
    return chunks.select("doc_id", "chunk_idx", "chunk_offset", "chunk_text")


@register("f6_collapse_blanks", r"select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) t from documents")
def collapse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.collapse_blanks(F.col("text")).alias("t"))


@register(
    "f9_similarity",
    "select a.n_nationkey a, b.n_nationkey b, 1 - levenshtein(a.n_name, b.n_name) / greatest(length(a.n_name), length(b.n_name)) similarity from nation a join nation b on a.n_nationkey < b.n_nationkey",
)
def similarity(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    a, b = (n.select(F.col("n_nationkey").alias(x), F.col("n_name").alias(f"n{x}")) for x in "ab")
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", text.similarity(F.col("na"), F.col("nb")).alias("similarity"))


@register(
    "f12_truncate_head",
    """with l as (select doc_id, string_split(text, chr(10))[1:5] x from documents),
    n as (select doc_id, x, len([i for i in range(1, len(x) + 1) if strlen(array_to_string(x[1:i], chr(10))) <= 1500]) k from l)
    select doc_id, array_to_string(x[1:k], chr(10)) head from n""",
)
def truncated(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.truncate_head(F.col("text"), 5, 1500).alias("head"))


@register(
    "f20_grep",
    r"""select doc_id, i::int line, case when length(x) > 2000 then substr(x, 1, 2000) || '...' else x end as text from (
        select doc_id, unnest(string_split_regex(text, '\r?\n')) x, generate_subscripts(string_split_regex(text, '\r?\n'), 1) i from documents) where regexp_matches(x, '[Tt]ion[.,]')""",
)
def grep(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.inline(text.grep(F.col("text"), "[Tt]ion[.,]")))


@register("f21_fork_title", "select c_custkey, c_name || ' (fork #1)' a, c_name || ' (fork #10)' b from customer")
def forked(spark: SparkSession, d: str) -> DataFrame:
    nine = F.concat("c_name", F.lit(" (fork #9)"))
    return table(spark, d, "customer").select("c_custkey", text.fork_title(F.col("c_name")).alias("a"), text.fork_title(nine).alias("b"))


@register("f22_csv_cell", """select doc_id, case when regexp_matches(text, '[",\n]') then '"' || replace(text, '"', '""') || '"' else text end cell from documents""")
def csv_cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.csv_cell(F.col("text")).alias("cell"))


@register("f30_yyyymm", "select event_id, strftime(ts, '%Y%m')::int ym, strftime(ts, '%Y%m%d') ymd from events")
def months(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", dates.yyyymm(F.col("ts")).alias("ym"), dates.yyyymmdd(F.col("ts")).alias("ymd"))


@register("f31_iso_week", "select o_orderkey, (isoyear(o_orderdate) * 100 + week(o_orderdate))::int as week, date_trunc('week', o_orderdate)::timestamp monday from orders")
def weeks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", dates.iso_week(F.col("o_orderdate")).alias("week"), dates.week_start(F.col("o_orderdate")).alias("monday"))


@register(
    "f34_month_anchor",
    """with a as (select o_orderkey, o_orderdate::date as day, date '2020-01-31' anchor, date_trunc('month', o_orderdate)::date f from orders),
    b as (select *, f + (least(31, extract(day from last_day(f))) - 1)::int here, (f - interval 1 month)::date g from a)
    select o_orderkey, (case when here <= day then here else g + (least(31, extract(day from last_day(g))) - 1)::int end)::date as start from b""",
)
def anchored(spark: SparkSession, d: str) -> DataFrame:
    start = dates.month_anchor(F.to_date("o_orderdate"), F.lit("2020-01-31").cast("date"))
    return table(spark, d, "orders").select("o_orderkey", start.alias("start"))


@register(
    "f35_parse_date",
    "select o_orderkey, o_orderdate::date a, o_orderdate::date b, o_orderdate::date c, null::date d from orders",
)
def parsed_dates(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("o_orderdate")
    forms = [F.date_format(t, f) for f in ("dd/MM/yyyy", "yyyy-MM-dd", "dd.MM.yyyy")]
    cols = [dates.parse_date(F.concat(F.lit(" "), x)).alias(n) for x, n in zip(forms, "abc", strict=True)]
    return table(spark, d, "orders").select("o_orderkey", *cols, dates.parse_date(F.col("o_orderpriority")).alias("d"))


@register("f39_retry_after", "select event_id, ceil((86400000 - (epoch_us(ts) // 1000) % 86400000) / 1000.0)::bigint s from events")
def retry(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", dates.retry_after(F.col("ts").cast("timestamp")).alias("s"))


@register(
    "f51_parse_amount",
    "select o_orderkey, round(o_totalprice, 2) plain, floor(o_totalprice) * 1000000.0 millions, round(o_totalprice, 2) french from orders",
)
def amounts(spark: SparkSession, d: str) -> DataFrame:
    p = F.round("o_totalprice", 2)
    plain = F.format_string("%.2f EUR", p)
    millions = F.format_string("%d millions d'euros", F.floor("o_totalprice"))
    french = F.concat(F.translate(F.format_string("%,.2f", p), ",.", ".,"), F.lit(" €"))
    cols = [numbers.parse_amount(x).alias(n) for x, n in ((plain, "plain"), (millions, "millions"), (french, "french"))]
    return table(spark, d, "orders").select("o_orderkey", *cols)


@register(
    "f52_amount_range",
    """select o_orderkey, case when x < 1e5 then '<100K' when x < 5e5 then '~500K' when x < 2e6 then '~1.5M' when x < 1e7 then '~5M' when x < 5e7 then '~25M' when x < 2e8 then '~100M' else '~500M' end r
    from (select o_orderkey, floor(o_totalprice) * 300 x from orders)""",
)
def ranges(spark: SparkSession, d: str) -> DataFrame:
    s = F.concat((F.floor("o_totalprice") * 300).cast("string"), F.lit(" €"))
    return table(spark, d, "orders").select("o_orderkey", numbers.amount_range(s).alias("r"))


@register("f56_token_estimate", "select doc_id, floor(length(text) / 4 + 0.5)::bigint tokens from documents")
def tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@register(
    "f57_model_cost",
    """select event_id, case when i + c > 200000 then (i * 6 + (o + r) * 22.5 + c * 0.6) / 1e6 else (i * 3 + (o + r) * 15 + c * 0.3) / 1e6 end cost
    from (select event_id, event_id % 300000 i, event_id % 701 o, event_id % 31 r, user_id * 900 c from events)""",
)
def costs(spark: SparkSession, d: str) -> DataFrame:
    t = {
        "input": F.col("event_id") % 300_000,
        "output": F.col("event_id") % 701,
        "reasoning": F.col("event_id") % 31,
        "cache_read": F.col("user_id") * 900,
        "cache_write": F.lit(0),
    }
    low, high = {"input": 3.0, "output": 15.0, "cache_read": 0.3}, {"input": 6.0, "output": 22.5, "cache_read": 0.6}
    return table(spark, d, "events").select("event_id", numbers.model_cost(t, low, high).alias("cost"))


@register("f61_card_fee", "select event_id, round(((event_id % 9000) + 30) / 0.956 * 0.044 + 30)::bigint fee from events")
def fees(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", numbers.card_fee((F.col("event_id") % 9000).cast("double")).alias("fee"))


@register("f66_backoff", "select l_linenumber, least(2000 * pow(2, l_linenumber - 1), 30000)::bigint ms from (select distinct l_linenumber from lineitem)")
def backoff(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_linenumber").distinct().select("l_linenumber", numbers.backoff_millis(F.col("l_linenumber")).alias("ms"))


@register("x24_hashes", "select p_partkey, sha256(p_name) sha, rtrim(translate(to_base64(p_name::blob), '+/=', '-_ ')) b64 from part")
def hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.sha2("p_name", 256).alias("sha"), text.base64url(F.col("p_name").cast("binary")).alias("b64"))


def _html_sql() -> str:
    out = "html"
    for tag in markup.SKIPPED:
        out = rf"regexp_replace({out}, '(?is)<{tag}(\s[^>]*)?>.*?</{tag}\s*>', '', 'g')"
    return rf"select page_id, trim(regexp_replace({out}, '(?s)<[^>]*>', '', 'g')) t from pages"


@register("f14_html_text", _html_sql())
def html_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", markup.html_text(F.col("html")).alias("t"))
