"""Registered queries of the functions that no other query reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import dates, markdown, numbers, patch, replace, text
from millrace.operators import accounts
from millrace.plans.registry import register
from millrace.sources.tables import table


@register(
    "f7_dedent",
    r"""with x as (select doc_id, [case when i % 4 = 0 then '  ' else repeat(' ', 3 + i % 2) || l end for l, i in string_split(text, chr(10))] l from documents),
    w as (select doc_id, l, coalesce(list_min([length(regexp_extract(y, '^(\s*)', 1)) for y in l if trim(y) <> '']), 0) n from x)
    select doc_id, array_to_string([case when trim(y) = '' then y else substr(y, n + 1) end for y in l], chr(10)) as t from w""",
)
def dedented(spark: SparkSession, d: str) -> DataFrame:
    lines = F.transform(F.split("text", "\n"), lambda l, i: F.when((i + 1) % 4 == 0, "  ").otherwise(F.concat(F.repeat(F.lit(" "), (3 + (i + 1) % 2).cast("int")), l)))
    return table(spark, d, "documents").select("doc_id", text.dedent(F.array_join(lines, "\n")).alias("t"))


@register("f8_unescape", r"""select doc_id, replace(replace(text, 'e', chr(10)), 'a', '\x') as t from documents""")
def unescaped(spark: SparkSession, d: str) -> DataFrame:
    """Texts with sequences in place of two letters; an unknown sequence stays."""
    s = F.replace(F.replace(F.col("text"), F.lit("e"), F.lit("\\n")), F.lit("a"), F.lit("\\\\x"))
    return table(spark, d, "documents").select("doc_id", text.unescape(s).alias("t"))


@register("f16_wildcard", r"select page_id, regexp_full_match(url, 'https://.*\.example\..*/en/.*', 's') as hit from pages")
def wildcard(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.col("url").rlike(text.wildcard_regex("https://*.example.*/en/*")).alias("hit"))


@register("f23_key_prefix", "select c_custkey, case when c_custkey % 3 <> 0 then substr(lower(replace(c_mktsegment, '_', '')), 1, 10) end prefix from customer")
def prefixes(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat(F.when(F.col("c_custkey") % 3 != 0, "sk_live_").otherwise("other_"), F.lower("c_mktsegment"), F.lit("_x"))
    return table(spark, d, "customer").select("c_custkey", text.key_prefix(key).alias("prefix"))


@register("f36_day_token", "select o_orderkey, case when o_orderdate::date = date '1995-06-15' then '[DATE_D0]' else '[DATE_D' || case when o_orderdate::date < date '1995-06-15' then '' else '+' end || (o_orderdate::date - date '1995-06-15') || ']' end token from orders")
def day_tokens(spark: SparkSession, d: str) -> DataFrame:
    day, anchor = F.to_date("o_orderdate"), F.lit("1995-06-15").cast("date")
    return table(spark, d, "orders").select("o_orderkey", dates.day_token(day, anchor, day == anchor).alias("token"))


@register("f37_epoch_day", "select o_orderkey, case when o_orderkey % 3 <> 0 then epoch(o_orderdate::date)::bigint end secs from orders")
def epoch_days(spark: SparkSession, d: str) -> DataFrame:
    s = F.when(F.col("o_orderkey") % 3 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.col("o_orderpriority"))
    return table(spark, d, "orders").select("o_orderkey", dates.epoch_day(s).alias("secs"))


@register("f38_dates", "select event_id, ts::date as day, strftime(ts, '%Y%m%d') as key from events")
def event_days(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.to_date("ts").alias("day"), dates.yyyymmdd(F.col("ts")).alias("key"))


@register("f41_id_time", "select event_id, (epoch_us(ts) // 1000) % 68719476736 ms from events")
def id_times(spark: SparkSession, d: str) -> DataFrame:
    """Ids hold the lower 36 bits of their time."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    made = F.concat(F.lit("ses_"), F.lower(F.right(F.hex(ms * 4096 + F.col("event_id") % 4096), F.lit(12))), F.lit("xyz"))
    return table(spark, d, "events").select("event_id", dates.id_millis(made).alias("ms"))


@register(
    "f43_duration",
    "select event_id, case when s >= 86400 then (s // 86400) || 'd ' || (s % 86400 // 3600) || 'h' when s >= 3600 then (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' else (s // 60) || 'm' end said from (select event_id, event_id * 37 s from events)",
)
def durations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", dates.duration(F.col("event_id") * 37).alias("said"))


@register("f53_address", r"select c_custkey, case when c_custkey % 4 = 0 then '[ADDR_GENERALIZED]' else c_name end address from customer")
def addresses(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    s = F.when(k % 8 == 0, F.col("c_name")).when(k % 4 == 0, "12b  ").otherwise(F.concat(k.cast("string"), F.lit("a "), "c_name"))
    return table(spark, d, "customer").select("c_custkey", numbers.address_range(s).alias("address"))


@register("f54_saturating", "select l_orderkey, l_linenumber, greatest(l_linenumber - 3, 0)::int left_over from lineitem")
def saturated(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", numbers.saturating_sub(F.col("l_linenumber"), F.lit(3)).cast("int").alias("left_over"))


@register("f55_per_million", "select l_orderkey, l_linenumber, ((l_orderkey * 977 + l_linenumber)::hugeint * 150000 // 1000000)::bigint cost from lineitem")
def per_million(spark: SparkSession, d: str) -> DataFrame:
    from millrace.operators.billing import per_million as cost

    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", cost(F.col("l_orderkey") * 977 + F.col("l_linenumber"), 150_000).alias("cost"))


@register("f62_micro_cents", "select o_orderkey, round(floor(o_totalprice)::double / 8 * 1000000)::bigint micro from orders")
def micro(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", numbers.micro_cents(F.floor("o_totalprice") / 8).alias("micro"))


@register("x3_punctuation", "select doc_id, 'a''b\"c-d e...' || replace(replace(replace(replace(replace(replace(replace(replace(text, '’', ''''), '‘', ''''), '“', '\"'), '”', '\"'), '–', '-'), '—', '-'), chr(160), ' '), '…', '...') as t from documents")
def punctuation(spark: SparkSession, d: str) -> DataFrame:
    s = F.concat(F.lit("a‘b“c–d e…"), "text")
    return table(spark, d, "documents").select("doc_id", text.plain_punctuation(s).alias("t"))


@register(
    "f10_fuzzy_replace",
    r"""select doc_id, replace(text, string_split(text, chr(10))[1], 'NEW') as t, null::varchar error from documents
    where string_split(text, chr(10))[1] <> '' and len(string_split(text, string_split(text, chr(10))[1])) = 2 and string_split(text, chr(10))[1] <> 'NEW'""",
)
def fuzzy_replaced(spark: SparkSession, d: str) -> DataFrame:
    """The first line of every document replaced, where it stands there once."""
    first = F.substring_index("text", "\n", 1)
    docs = table(spark, d, "documents").where((first != "") & (F.size(F.split(F.replace(F.col("text"), first, F.lit("\u0001")), "\u0001")) == 2))
    r = replace.replaced(F.col("text"), first, F.lit("NEW"))
    return docs.select("doc_id", r.alias("r")).select("doc_id", F.col("r.text").alias("t"), "r.error")


@register("k13_csv_lines", """select doc_id, doc_id || ',' || case when regexp_matches(lang, '[",\\n]') then '"' || replace(lang, '"', '""') || '"' else lang end || ',' || n_chars line from documents""")
def csv_lines(spark: SparkSession, d: str) -> DataFrame:
    cells = [text.csv_cell(F.col(c).cast("string")) for c in ("doc_id", "lang", "n_chars")]
    return table(spark, d, "documents").select("doc_id", F.concat_ws(",", *cells).alias("line"))


@register("f56_tokens_utf16", "select doc_id, floor((length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]'))) / 4 + 0.5)::bigint tokens from documents")
def tokens_utf16(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


def _fnv_sql(s: str) -> str:
    h = f"list_reduce(list_prepend(2166136261::bigint, [unicode(c)::bigint for c in string_split({s}, '') if c <> '']), lambda h, c: (xor(h, c) * 16777619) % 4294967296)"
    digits = f"[substr('0123456789abcdefghijklmnopqrstuvwxyz', (({h}) // (36 ** k)::bigint % 36)::int + 1, 1) for k in [6, 5, 4, 3, 2, 1, 0]]"
    return f"ltrim(array_to_string({digits}, ''), '0')"


@register("x24_fnv", f"select p_partkey, {_fnv_sql('p_name')} hash from part")
def fnv(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.fnv1a_base36(F.col("p_name")).alias("hash"))


_POINTS = ("0", "floor(n * 0.25)", "floor(n * 0.5)", "floor(n * 0.75)", "n - 6")
_PIECES = " || ':' || ".join(_fnv_sql(f"substr(p_name, greatest(0, least(n - 6, {x} - 3))::int + 1, 6)") for x in _POINTS)


@register("x24_sampled", f"select p_partkey, case when n <= 20 then {_fnv_sql('p_name')} else n || ':' || {_PIECES} end hash from (select p_partkey, p_name, length(p_name) n from part)")
def sampled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.sampled_checksum(F.col("p_name"), 20, 6).alias("hash"))


_FIRST, _SECOND = "string_split(text, chr(10))[1]", "string_split(text, chr(10))[2]"


@register("x1_located", "select doc_id, (list_position(l, l[len(l)]) - 1)::int as place from (select doc_id, string_split(text, chr(10)) l from documents)")
def located(spark: SparkSession, d: str) -> DataFrame:
    """Where the last line of each document stands for the first time."""
    last = F.substring_index("text", "\n", -1)
    return table(spark, d, "documents").select("doc_id", patch.located(F.col("text"), last).alias("place"))


@register(
    "x2_patched",
    f"""select doc_id, 'NEW' || substr(t, length({_FIRST}) + 1) || case when right(t, 1) = chr(10) then '' else chr(10) end as content, 'moved' as path from (
        select doc_id, text, case when text like '%' || chr(10) || chr(10) then left(text, length(text) - 1) else text end t from documents) where {_SECOND} is not null""",
)
def patched(spark: SparkSession, d: str) -> DataFrame:
    """The first line of every document of two lines or more replaced by a patch that moves it."""
    first, second = (F.get(F.split("text", "\n"), F.lit(i)) for i in (0, 1))
    body = F.concat(F.lit("*** Begin Patch\n*** Update File: f\n*** Move to: moved\n@@\n-"), first, F.lit("\n+NEW\n "), second, F.lit("\n*** End Patch"))
    docs = table(spark, d, "documents").where(second.isNotNull())
    done = docs.select("doc_id", patch.applied(F.col("text"), F.lit("f"), body).alias("r"))
    return done.select("doc_id", "r.content", "r.path")


@register("f15_markdown")
def markdowns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", markdown.markdown(F.col("html")).alias("markdown"))


@register("k17_stats_rows", "select day, n, (n - lag(n, 1, 0) over (order by day))::bigint n_delta from (select ts::date as day, count(*) n from events group by 1)")
def stats_rows(spark: SparkSession, d: str) -> DataFrame:
    daily = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return accounts.with_deltas(daily, "day", ["n"])


# A block behind each document that only one of the tries finds; the document's number picks the try.
BLOCK = "'  alpha ' || n || chr(10) || '    beta  ' || n || chr(10) || '    gamma ' || n || chr(10) || '  omega ' || n"
GAMMA = "chr(10) || '    gamma ' || n || chr(10) || '  omega ' || n"


@register(
    "f10_all_strategies",
    f"""with d as (select doc_id, doc_id % 9 k, doc_id::varchar n, coalesce(text, '') || chr(10) t from documents)
    select doc_id, k, md5(case k when 0 then t || '  NEW' || chr(10) || '    beta  ' || n || {GAMMA} when 1 then t || 'NEW' || {GAMMA} when 2 then t || 'NEW'
        when 3 then t || '  alpha ' || n || chr(10) || 'NEW' || {GAMMA} when 4 then t || 'NEW' || {GAMMA} || chr(10) || 'alpha ' || n || chr(10) || '        beta  ' || n
        when 5 then t || '  NEW' || {GAMMA} when 6 then t || '  aNEW  ' || n || {GAMMA} when 8 then replace(t || {BLOCK}, 'a ' || n, 'NEW') end) as changed, case k when 7 then 'not found' end error from d""",
)
def all_strategies(spark: SparkSession, d: str) -> DataFrame:
    """An edit of every document that one try decides: exact, trimmed lines, anchors, white space, indentation, escapes, trimmed ends, none, everywhere."""
    n, k = F.col("doc_id").cast("string"), (F.col("doc_id") % 9).cast("int")
    alpha, beta = F.concat(F.lit("alpha "), n), F.concat(F.lit("beta  "), n)
    block = F.concat(F.lit("  "), alpha, F.lit("\n    "), beta, F.lit("\n    gamma "), n, F.lit("\n  omega "), n)
    twice = F.when(k == 4, F.concat(F.lit("\n"), alpha, F.lit("\n        "), beta)).otherwise("")
    finds = (
        alpha, F.concat(alpha, F.lit("\n"), beta), F.concat(alpha, F.lit("\nother\nlines\nomega "), n), F.concat(F.lit("beta "), n), F.concat(alpha, F.lit("\n  "), beta),
        F.concat(alpha, F.lit("\\n    "), beta), F.concat(F.lit(" lpha "), n, F.lit("\n    beta")), F.concat(F.lit("no such line "), n), F.concat(F.lit("a "), n),
    )
    rows = table(spark, d, "documents").select("doc_id", k.alias("k"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), block, twice).alias("t"), F.get(F.array(*finds), k).alias("find"))
    one = rows.where("k <> 8").withColumn("r", replace.replaced(F.col("t"), F.col("find"), F.lit("NEW")))
    every = rows.where("k = 8").withColumn("r", replace.replaced(F.col("t"), F.col("find"), F.lit("NEW"), everywhere=True))
    return one.unionByName(every).select("doc_id", "k", F.md5("r.text").alias("changed"), "r.error")
