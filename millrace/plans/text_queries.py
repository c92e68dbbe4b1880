"""Registered queries of further text and usage functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import dates, text, usage
from millrace.operators import labels
from millrace.plans.registry import register
from millrace.sources.tables import table


@register("f4_preview", "select doc_id, substr(text, 1, 500) preview from documents")
def previews(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.preview(F.col("text")).alias("preview"))


_LABELS = "values " + ", ".join(f"('{raw}', '{category}')" for raw, category in labels.LABELS.items())


@register(
    "f5_label_normalize",
    f"with m(raw, category) as ({_LABELS}), x as (select p_partkey, case when p_partkey % 5 = 4 then p_name else (['email', 'Siren', 'gpe', 'full_name'])[p_partkey % 5 + 1] end label from part)"
    " select p_partkey, coalesce(category, 'Per') category from x left join m on upper(label) = raw",
)
def label_names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    label = F.when(k == 4, F.col("p_name")).otherwise(F.get(F.array(*map(F.lit, ("email", "Siren", "gpe", "full_name"))), k.cast("int")))
    return labels.normalized(table(spark, d, "part").select("p_partkey", label.alias("label")), "label").select("p_partkey", "category")


@register(
    "f11_trim_diff",
    r"""with x as (select doc_id, [l for l in list_transform(string_split(text, chr(10)), lambda l, i: case i % 3 when 0 then '+' when 1 then '-' else ' ' end || repeat(' ', 2 + i % 2) || l)] l from documents),
    w as (select doc_id, l, list_min([length(regexp_extract(y, '^.(\s*)', 1)) for y in l if trim(substr(y, 2)) <> '']) n from x)
    select doc_id, array_to_string(case when coalesce(n, 0) = 0 then l else [y[1] || substr(y, 2 + n) for y in l] end, chr(10)) as diff from w""",
)
def trimmed_diffs(spark: SparkSession, d: str) -> DataFrame:
    mark = lambda i: F.element_at(F.array(F.lit("+"), F.lit("-"), F.lit(" ")), (i % 3 + 1).cast("int"))
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(mark(i + 1), F.repeat(F.lit(" "), (2 + (i + 1) % 2).cast("int")), x))
    return table(spark, d, "documents").select("doc_id", text.trim_diff(F.array_join(lines, "\n")).alias("diff"))


@register(
    "f12_truncate_tail",
    """with l as (select doc_id, text t, string_split(text, chr(10)) x from documents),
    n as (select *, list_reverse(x)[1:4] y from l),
    k as (select *, coalesce(list_max([i for i in range(1, len(y) + 1) if strlen(array_to_string(y[1:i], chr(10))) <= 900]), 0) k from n),
    c as (select *, array_to_string(list_reverse(y[1:k]), chr(10)) kept, len(x) <= 4 and strlen(t) <= 900 uncut, k = len(y) fits from k)
    select doc_id, kept, (case when uncut then 0 when fits then len(x) - k else strlen(t) - strlen(kept) end)::bigint removed, case when uncut then null when fits then 'lines' else 'bytes' end unit from c""",
)
def truncated_tails(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.truncated(F.col("text"), 4, 900, tail=True).alias("t")).select("doc_id", "t.*")


@register(
    "f13_read_page",
    r"""with l as (select doc_id, case when text = '' then [] else string_split_regex(regexp_replace(text, '\r?\n$', ''), '\r?\n') end x from documents),
    p as (select doc_id, x, [case when length(y) > 120 then substr(y, 1, 120) || '... (line truncated to 120 chars)' else y end for y in x[3:8]] y from l),
    k as (select *, coalesce(list_max([i for i in range(1, len(y) + 1) if strlen(array_to_string(y[1:i], chr(10))) <= 400]), 0) k from p)
    select doc_id, array_to_string([(i + 2) || ': ' || y[i] for i in range(1, k + 1)], chr(10)) as content, (k + 2)::int as last, len(x) > k + 2 as more from k where len(x) >= 3""",
)
def pages_of_text(spark: SparkSession, d: str) -> DataFrame:
    page = text.read_page(F.col("text"), 3, 6, 400, 120).alias("p")
    return table(spark, d, "documents").select("doc_id", page).where("p is not null").select("doc_id", "p.content", "p.last", "p.more")


PATTERNS = {"*": "any", "*.example.net*": "net", "https://*": "secure", "https://m.*": "mobile", "*/en/*": "english", "*?page=2*": "second"}


def _like(p: str) -> str:
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else c if c.isalnum() else "\\" + c for c in p) + "$"


_CASES = " ".join(f"when regexp_full_match(url, '{_like(p)}', 's') then '{v}'" for p, v in sorted(PATTERNS.items(), key=lambda x: (len(x[0]), x[0]), reverse=True))


@register("f17_wildcard_all", f"select page_id, case {_CASES} end as value from pages")
def wildcards(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.wildcard_value(F.col("url"), PATTERNS).alias("value"))


@register(
    "f17_wildcard_structured",
    """with t as (select p_partkey, string_split(p_name, ' ') w from part)
    select p_partkey, case when w[1] like 'a%' and len([i for i in range(2, len(w) + 1) if w[i] like '%e%']) > 0
        and len(w) > list_min([i for i in range(2, len(w) + 1) if w[i] like '%e%']) then 'late'
        when w[1] like 'a%' then 'a' when true then 'any' end as value from t""",
)
def structured(spark: SparkSession, d: str) -> DataFrame:
    rules = {"*": "any", "a* *": "a", "a* *e* * ?*": "late"}
    return table(spark, d, "part").select("p_partkey", text.structured_value(F.split("p_name", " "), rules).alias("value"))


@register("f18_fuzzy_search")
def fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """The twenty names that hold the letters best, hidden ones last."""
    names = table(spark, d, "part").select("p_partkey", F.concat(F.when(F.col("p_partkey") % 7 == 0, ".").otherwise(""), F.replace("p_name", F.lit(" "), F.lit("/")), F.lit("-"), F.col("p_partkey").cast("string")).alias("path"))
    return text.fuzzy_search(names, "path", "Red", 20)


@register(
    "f19_glob",
    r"""with p as (select page_id, regexp_extract(url, '://([^?#]*)', 1) p from pages)
    select page_id, p as path from p where regexp_full_match(p, '(?:.*/)?(?:en|de)/[^/]*\.html')""",
)
def globbed(spark: SparkSession, d: str) -> DataFrame:
    path = F.regexp_extract("url", "://([^?#]*)", 1)
    return table(spark, d, "pages").select("page_id", path.alias("path")).where(F.col("path").rlike(text.glob_regex("**/{en,de}/*.html")))


@register(
    "f20_grep_files",
    r"""with l as (select page_id, url, len(html) m, unnest(string_split_regex(html, '\r?\n')) x, generate_subscripts(string_split_regex(html, '\r?\n'), 1) i from pages)
    select url as path, i::int line, case when length(x) > 2000 then substr(x, 1, 2000) || '...' else x end as text from l where regexp_matches(x, '<h[12]') order by m desc, page_id, i limit 100""",
)
def grep_files(spark: SparkSession, d: str) -> DataFrame:
    """Matching lines of the newest files first, at most 100; the length of a page stands for its time."""
    hits = table(spark, d, "pages").select("page_id", F.col("url").alias("path"), F.length("html").alias("m"), F.inline(text.grep(F.col("html"), "<h[12]")))
    return hits.orderBy(F.desc("m"), "page_id", "line").limit(100).select("path", "line", "text")


@register(
    "f24_hash_bucket",
    """with c as (select event_id, event_id::varchar || '-' || event_type s from events), h as (select event_id,
        list_reduce(list_prepend(0::bigint, [ascii(x)::bigint for x in string_split(right(s, 4), '')]), lambda a, x: (a * 31 + x) % 4294967296) h from c)
    select event_id, (['a', 'b', 'b', 'b', 'c'])[h % 5 + 1] bucket from h""",
)
def buckets(spark: SparkSession, d: str) -> DataFrame:
    s = F.concat_ws("-", F.col("event_id").cast("string"), "event_type")
    return table(spark, d, "events").select("event_id", text.weighted_bucket(s, {"a": 1, "b": 3, "c": 1}).alias("bucket"))


@register("f25_path_keys", r"select page_id, regexp_extract(p, '([^/]*)$', 1) base, case when contains(p, '/') then regexp_replace(p, '/[^/]*$', '') else '.' end dir from (select page_id, regexp_extract(url, '://([^?#]*)', 1) p from pages)")
def path_keys(spark: SparkSession, d: str) -> DataFrame:
    p = F.regexp_extract("url", "://([^?#]*)", 1)
    return table(spark, d, "pages").select("page_id", text.basename(p).alias("base"), text.dirname(p).alias("dir"))


@register(
    "f32_week_bounds",
    """with k as (select event_id, isoyear(ts) y, week(ts) w, ts from events)
    select event_id, (make_date(y, 1, 4) - (isodow(make_date(y, 1, 4)) - 1)::int + (w - 1)::int * 7)::date monday, date_trunc('week', ts)::timestamp as "start", (date_trunc('week', ts) + interval 7 days)::timestamp as "end" from k""",
)
def week_bounds(spark: SparkSession, d: str) -> DataFrame:
    key = dates.iso_week(F.col("ts"))
    start, end = dates.week_bounds(F.col("ts"))
    return table(spark, d, "events").select("event_id", dates.monday_of(key).alias("monday"), start.cast("timestamp_ntz").alias("start"), end.cast("timestamp_ntz").alias("end"))


@register(
    "f42_day_cutoff",
    "select event_id, ts >= timestamp '2024-01-20 00:00:00' today, ts >= timestamp '2024-01-17 15:30:00' recent from events",
)
def cutoffs(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit("2024-01-20 15:30:00").cast("timestamp")
    ts = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select("event_id", (ts >= dates.day_cutoff(now, 0)).alias("today"), (ts >= dates.day_cutoff(now, 3)).alias("recent"))


USAGE_JSON = (
    """case event_id % 5 when 0 then '{"input_tokens": ' || event_id || ', "output_tokens": 7, "cache_read_input_tokens": 3, "cache_creation": {"ephemeral_5m_input_tokens": 11}}'"""
    """ when 1 then '{"input_tokens": ' || event_id || ', "output_tokens": 90, "output_tokens_details": {"reasoning_tokens": 40}, "input_tokens_details": {"cached_tokens": 1}}'"""
    """ when 2 then '{"prompt_tokens": ' || event_id || ', "completion_tokens": 5, "prompt_tokens_details": {"cached_tokens": 2}}'"""
    """ when 3 then '{"promptTokenCount": ' || event_id || ', "candidatesTokenCount": 4, "thoughtsTokenCount": 6}' else '{"output_tokens": null}' end"""
)
USAGE_KIND = "case event_id % 5 when 0 then 'anthropic' when 1 then 'openai' when 2 then 'oa-compat' when 3 then 'google' else 'anthropic' end"
USAGE_SQL = f"""u as (select event_id, event_id % 5 k, json_extract({USAGE_JSON}, '$') j from events),
n as (select event_id, k, case k when 0 then (j->>'$.input_tokens')::bigint when 1 then (j->>'$.input_tokens')::bigint - 1 when 2 then (j->>'$.prompt_tokens')::bigint - 2 when 3 then (j->>'$.promptTokenCount')::bigint else 0 end as "input",
    case k when 0 then 7 when 1 then 50 when 2 then 5 when 3 then 4 else 0 end::bigint as "output", case k when 1 then 40 when 3 then 6 end::bigint reasoning,
    case k when 0 then 3 when 1 then 1 when 2 then 2 when 3 then 0 end::bigint cache_read, case k when 0 then 11 end::bigint cache_write_5m, null::bigint cache_write_1h from u)"""


def _normalized(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", usage.normalized(F.expr(USAGE_JSON), F.expr(USAGE_KIND)).alias("u"))


@register("f59_usage_normalize", f"with {USAGE_SQL} select event_id, input, output, reasoning, cache_read, cache_write_5m, cache_write_1h from n")
def normalized_usage(spark: SparkSession, d: str) -> DataFrame:
    return _normalized(spark, d).select("event_id", "u.*")


@register(
    "f58_server_cost",
    f"""with {USAGE_SQL}, t as (select *, input + coalesce(cache_read, 0) + coalesce(cache_write_5m, 0) > 200000 as far from n)
    select event_id, round(case when far then (input * 6e-6 + (output + coalesce(reasoning, 0)) * 2.25e-5 + coalesce(cache_read, 0) * 6e-7) * 100
        else (input * 3e-6 + (output + coalesce(reasoning, 0)) * 1.5e-5 + coalesce(cache_read, 0) * 3e-7 + coalesce(cache_write_5m, 0) * 3.75e-6) * 100 end, 9) cents from t""",
)
def server_costs(spark: SparkSession, d: str) -> DataFrame:
    low = {"input": 3e-6, "output": 1.5e-5, "cache_read": 3e-7, "cache_write_5m": 3.75e-6}
    high = {"input": 6e-6, "output": 2.25e-5, "cache_read": 6e-7}
    return _normalized(spark, d).select("event_id", F.round(usage.server_cost(F.col("u"), low, high), 9).alias("cents"))


@register(
    "f60_token_adjust",
    """with x as (select event_id, value * 1000 i, (event_id % 50)::double o, case when event_id % 7 = 0 then null else (event_id % 90)::double end r, event_id % 3 = 0 as own from events)
    select event_id, round(case when own then i else i - coalesce(r, 0) - 5 end, 6) as "input", round(case when own then i + o + coalesce(r, 0) + 5 else i + 1 end, 6) total from x""",
)
def adjusted_tokens(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    read = F.when(e % 14 == 0, F.lit(float("nan"))).when(e % 7 == 0, F.lit(None)).otherwise((e % 90).cast("double"))
    own = e % 3 == 0
    t = usage.adjusted(F.col("value") * 1000, e % 50, read, F.lit(5), F.col("value") * 1000 + 1, own, own)
    return table(spark, d, "events").select("event_id", t.alias("t")).select("event_id", F.round("t.input", 6).alias("input"), F.round("t.total", 6).alias("total"))


@register(
    "f63_quota",
    """with q as (select event_id, (value * 100)::bigint used, (event_id % 90 + 1)::bigint * 50 lim, ts::timestamp u, timestamp '2024-01-18 12:00:00' now, date '2024-01-15' ws from events),
    r as (select *, u >= now - interval 5 hours fr, u >= ws::timestamp fw, u >= timestamp '2024-01-10 00:00:00' fm from q)
    select event_id, case when fr and used >= lim then 'rate-limited' else 'ok' end rolling_status,
        (case when fr then ceil((epoch_us(u + interval 5 hours) // 1000 - epoch_ms(now)) / 1000.0) else 18000 end)::bigint rolling_reset,
        (case when not fw then 0 when used >= lim then 100 else floor(least(100.0, used * 100.0 / lim)) end)::int weekly_percent,
        ceil((epoch_ms(ws::timestamp + interval 7 days) - epoch_ms(now)) / 1000.0)::bigint weekly_reset,
        case when fm and used >= lim then 'rate-limited' else 'ok' end monthly_status, 1944000::bigint monthly_reset from r""",
)
def quotas(spark: SparkSession, d: str) -> DataFrame:
    """Rolling, weekly and monthly analysis of usage that was updated at each event's time, at one moment."""
    now, anchor = F.lit("2024-01-18 12:00:00").cast("timestamp"), F.lit("2023-11-10").cast("date")
    used, limit, at = F.col("used"), (F.col("event_id") % 90 + 1) * 50, F.col("ts").cast("timestamp")
    start, end = dates.month_bounds(F.to_date(now), anchor)
    r, w, m = usage.rolling(used, limit, at, now, 5), usage.weekly(used, limit, at, now), usage.monthly(used, limit, at, now, start.cast("timestamp"), end.cast("timestamp"))
    e = table(spark, d, "events").withColumn("used", (F.col("value") * 100).cast("decimal(20,0)").cast("long"))
    e = e.select("event_id", r.alias("r"), w.alias("w"), m.alias("m"))
    return e.select("event_id", F.col("r.status").alias("rolling_status"), F.col("r.reset_in_sec").alias("rolling_reset"), F.col("w.usage_percent").alias("weekly_percent"), F.col("w.reset_in_sec").alias("weekly_reset"), F.col("m.status").alias("monthly_status"), F.col("m.reset_in_sec").alias("monthly_reset"))


@register(
    "f64_overflow",
    "select event_id, event_id % 11 <> 0 and (case when event_id % 2 = 0 then event_id * 40 else event_id * 30 + 100 end) >= (case when event_id % 3 = 0 then 100000 - 20000 else 200000 - 32000 end) overflows from events",
)
def overflowing(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    total = F.when(e % 2 == 0, e * 40).otherwise(0)
    context, limit = F.when(e % 11 == 0, 0).otherwise(200_000), F.when(e % 3 == 0, 100_000)
    return table(spark, d, "events").select("event_id", usage.overflows(total, [e * 30, F.lit(100)], context, limit, F.lit(32_000)).alias("overflows"))


@register("f65_percent", "select l_orderkey, l_linenumber, floor(l_quantity * 1000.0 / 50 + 0.5) / 10 share from lineitem")
def percents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", usage.percent(F.col("l_quantity"), F.lit(50)).alias("share"))
