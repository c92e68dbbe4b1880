"""Registered queries of event streams, logs, share data and change logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import logs
from millrace.plans.registry import register
from millrace.sources.tables import table

_FRAME = r"""case when turn % 3 = 0 then 'id: ' || turn || chr(10) else '' end || case when turn = 2 then 'retry: 50' || chr(10) else '' end
    || case turn % 4 when 0 then 'data: {"t": ' || length(text) || '}' when 1 then 'data: not json' || chr(10) || 'data:  ' || role when 2 then ': comment' else 'data: [1' end"""


@register(
    "x5_sse_frames",
    r"""with f as (select conv_id, turn, turn % 4 <> 2 as given, case turn % 4 when 0 then '{"t": ' || length(text) || '}' when 1 then 'not json' || chr(10) || role else '[1' end raw,
        max(case when turn % 3 = 0 then turn end) over (partition by conv_id order by turn) i, max(case when turn = 2 then 1 end) over (partition by conv_id order by turn) r from conversations)
    select conv_id, (row_number() over (partition by conv_id order by turn) - 1)::int seq, raw, turn % 4 = 0 json, i::varchar id, case when r = 1 then 50 else 1000 end retry from f where given""",
)
def frames(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation as an event stream with either kind of line end, read frame by frame; the last piece is not ended."""
    turn = F.expr(_FRAME.replace("chr(10)", "'\\n'"))
    per = table(spark, d, "conversations").select("conv_id", "turn", turn.alias("f")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "f"))).alias("x"))
    body = F.concat(F.array_join(F.transform("x", lambda x: x["f"]), "\n\n"), F.lit("\n\ndata: {}"))
    body = F.when(F.col("conv_id") % 2 == 0, F.replace(body, F.lit("\n"), F.lit("\r\n"))).otherwise(body)
    return per.select("conv_id", F.inline(logs.sse_frames(body)))


@register(
    "st16_sse_usage",
    "select conv_id as stream, max(turn) filter (where turn % 3 = 1) as n from conversations group by 1",
)
def usage(spark: SparkSession, d: str) -> DataFrame:
    """A record in every third frame, and the streams cut into chunks of seven characters."""
    frame = F.when(F.col("turn") % 3 == 1, F.format_string('data: {"usage": {"n": %d}}', "turn")).when(F.col("turn") % 3 == 2, "data: [DONE").otherwise('data: {"choices": []}')
    per = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", frame.alias("f")))).alias("x"))
    body = F.concat(F.array_join(F.transform("x", lambda x: x["f"]), "\n\n"), F.lit('\n\ndata: {"usage": {"n": -1}}'))
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.length("b") / 7).cast("int")), lambda i: F.substring("b", i * 7 + 1, F.lit(7)))
    chunks = per.select(F.col("conv_id").alias("stream"), body.alias("b")).select("stream", F.posexplode(pieces).alias("seq", "chunk"))
    return logs.sse_usage(chunks).select("stream", F.get_json_object("usage", "$.n").cast("long").alias("n"))


@register(
    "st17_metric_rows",
    """with l as (select user_id request, event_id seq, event_type t, json_extract_string(props, '$.k') k from events),
    e as (select request, seq, k, row_number() over (partition by request order by seq) - 1 nr, last_value(case when t = 'click' then k end ignore nulls) over (partition by request order by seq) clicked from l where t = 'error' or t = 'click'),
    r as (select request, seq, k code, clicked from e join (select request r2, seq s2 from l where t = 'error') x on x.r2 = request and x.s2 = seq),
    f as (select request, max(seq) + 1 seq, arg_max(k, seq) filter (where t = 'error') code, arg_max(k, seq) filter (where t = 'click') clicked from l group by 1),
    u as (select request, seq, 'llm.error' event_type, code, clicked from r union all select request, seq, 'completions', code, clicked from f)
    select request, (row_number() over (partition by request order by seq) - 1)::int seq, event_type, code, coalesce(clicked, 'none') clicked from u""",
)
def metrics(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    line = (
        F.when(F.col("event_type") == "error", F.concat(F.lit('_metric:{"llm.error.code": "'), k, F.lit('"}')))
        .when(F.col("event_type") == "click", F.concat(F.lit('_metric:{"clicked": "'), k, F.lit('", "n": 1}')))
        .otherwise("a line of text")
    )
    base = F.create_map(F.lit("clicked"), F.lit("none"))
    lines = table(spark, d, "events").select(F.col("user_id").alias("request"), F.col("event_id").alias("seq"), line.alias("message"), base.alias("base"))
    data = F.col("data")
    return logs.metric_rows(lines).select("request", "seq", "event_type", data["llm.error.code"].alias("code"), data["clicked"].alias("clicked"))


@register("f76_metric_merge", """with l as (select user_id request, event_type t, arg_max(json_extract_string(props, '$.k'), event_id) k from events where event_type in ('click', 'view') group by 1, 2)
    select request, max(k) filter (where t = 'click') click, max(k) filter (where t = 'view') as view from l group by 1""")
def merged(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit('_metric:{"'), "event_type", F.lit('": "'), F.get_json_object("props", "$.k"), F.lit('"}'))
    e = table(spark, d, "events").where("event_type in ('click', 'view')")
    lines = e.select(F.col("user_id").alias("request"), F.col("event_id").alias("seq"), line.alias("message"), F.lit(None).cast("map<string,string>").alias("base"))
    return logs.metric_rows(lines).where("event_type = 'completions'").select("request", F.col("data")["click"].alias("click"), F.col("data")["view"].alias("view"))


def _share(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events").select(F.col("user_id").alias("share"), F.col("event_type").alias("key"), F.col("value").cast("string").alias("value"), F.col("event_id").alias("seq"))
    old = e.where("seq < 4000").groupBy("share", "key").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))
    return old, e


@register("st15_share_data", "select user_id as share, event_type as key, arg_max(event_id, event_id) seq from events group by 1, 2")
def share_data(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot of the first events and all events together give what all events would."""
    return logs.compacted(*_share(spark, d), ["share", "key"], "seq")[0].select("share", "key", "seq")


@register("st15_share_marks", "select user_id as share, max(event_id) event from events group by 1")
def share_marks(spark: SparkSession, d: str) -> DataFrame:
    return logs.compacted(*_share(spark, d), ["share", "key"], "seq")[1]


@register("x20_share_sync", "select user_id, date_trunc('hour', ts)::timestamp as batch, event_type as key, max(event_id) seq from events group by 1, 2, 3")
def sync(spark: SparkSession, d: str) -> DataFrame:
    """Batches by the hour: of each key the last value only is sent on."""
    e = table(spark, d, "events")
    return e.groupBy("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("batch"), F.col("event_type").alias("key")).agg(F.max("event_id").alias("seq"))


@register("x21_published", "with w as (select regexp_extract(url, '://([^?#]*)', 1) key, page_id from pages) select key, max(page_id) as value from w where starts_with(key, 'www.') or starts_with(key, 'm.') group by key")
def published(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "pages").select(F.regexp_extract("url", "://([^?#]*)", 1).alias("key"), F.col("page_id").alias("value"), F.col("page_id").alias("seq"))
    return logs.published(w, ["www.", "m."])


@register("s9_listing", "with w as (select distinct regexp_extract(url, '://([^?#]*)', 1) key from pages) select key from w where starts_with(key, 'm.') and key > 'm.th' and key < 'm.ththz' order by key limit 30")
def listed(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "pages").select(F.regexp_extract("url", "://([^?#]*)", 1).alias("key")).distinct()
    return logs.listed(w, "m.", "m.th", "m.ththz", 30)


_PREFIX = "(['core/cmd/', 'core/', 'desktop/native/', 'app/', 'docs/', 'github/'])"


@register(
    "x10_changes",
    f"""with f as (select l_orderkey o, {_PREFIX}[l_linenumber % 6 + 1] p, l_linenumber % 6 k from lineitem), a as (select o, list_sort(list_distinct(list(case k when 0 then 'tui' when 1 then 'core' when 2 then 'tauri' when 3 then 'app' when 5 then 'github' end))) areas from f where k <> 4 group by 1)
    select o_orderkey nr, substr(md5(o_orderkey::varchar), 1, 7) sha, o_custkey::varchar author, o_orderpriority || ' ' || o_orderstatus message, array_to_string(areas, ',') areas
    from orders join a on o = o_orderkey where o_orderkey % 4 <> 1 and o_orderkey % 5 <> 2""",
)
def changes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    sha = F.md5(k.cast("string")).alias("sha")
    orders = table(spark, d, "orders")
    log = orders.select(k.alias("nr"), sha)
    said = F.concat(F.when(k % 5 == 2, "Chore: ").otherwise(""), "o_orderpriority", F.lit(" "), "o_orderstatus", F.lit("\nmore"))
    commits = orders.where("o_orderkey % 4 <> 1").select(sha, F.col("o_custkey").cast("string").alias("login"), said.alias("message"))
    prefix = F.get(F.expr(_PREFIX[1:-1].replace("[", "array(").replace("]", ")")), F.col("l_linenumber") % 6)
    files = table(spark, d, "lineitem").select(F.md5(F.col("l_orderkey").cast("string")).alias("sha"), F.concat(prefix, F.lit("x.ts")).alias("path"))
    return logs.changes(log, commits, files).withColumn("areas", F.array_join("areas", ","))


@register(
    "x11_without_reverts",
    """with recursive c as (select event_id nr, user_id u, event_type = 'error' r, row_number() over (partition by user_id order by event_id) i from events where event_type in ('error', 'signup')),
    f as (select u, 0::bigint i, null::bigint plain, null::bigint revert from c group by u
        union all select c.u, c.i, case when c.r then case when f.plain is not null then null else f.plain end else case when f.revert is not null then f.plain else c.nr end end,
            case when c.r then case when f.plain is not null then f.revert else c.nr end else case when f.revert is not null then null else f.revert end end from f join c on c.u = f.u and c.i = f.i + 1),
    l as (select u, arg_max(plain, i) p, arg_max(revert, i) r, arg_max((plain, revert), i) z from f group by u)
    select z[1] as nr from l where z[1] is not null union all select z[2] from l where z[2] is not null""",
)
def reverts(spark: SparkSession, d: str) -> DataFrame:
    plain = F.concat(F.lit("feat "), F.col("user_id").cast("string"))
    message = F.when(F.col("event_type") == "error", F.concat(F.lit('Revert "'), plain, F.lit('"'))).otherwise(plain)
    c = table(spark, d, "events").where("event_type in ('error', 'signup')").select(F.col("event_id").alias("nr"), message.alias("message"))
    return logs.without_reverts(c).select("nr")


@register(
    "x19_working_tree",
    """select 'm' || event_id as path, case when event_id % 4 = 0 then 0 else event_id end::int added, (event_id % 9)::int removed, 'modified' status from events where event_type = 'click'
    union all select 'u' || doc_id, len(string_split(text, chr(10)))::int, 0, 'added' from documents union all select 'm' || event_id, 0, 0, 'deleted' from events where event_type = 'click' and event_id % 7 = 0""",
)
def tree_status(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type = 'click'")
    path = F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("path")
    m = e.select(path, F.when(F.col("event_id") % 4 == 0, "-").otherwise(F.col("event_id").cast("string")).alias("added"), (F.col("event_id") % 9).cast("string").alias("removed"))
    u = table(spark, d, "documents").select(F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("path"), "text")
    return logs.working_tree(m, u, e.where("event_id % 7 = 0").select(path))


@register(
    "x18_numstat_lines",
    "select 'src/' || event_id as path, case when event_id % 3 = 0 then 0 else event_id % 50 end::int added, case when event_id % 3 = 0 then 0 else user_id end::int removed, case when event_id % 5 = 0 then event_type else 'modified' end status from events",
)
def numstat(spark: SparkSession, d: str) -> DataFrame:
    e, k = table(spark, d, "events"), F.col("event_id")
    path = F.concat(F.lit("src/"), k.cast("string"))
    line = F.concat_ws("\t", F.when(k % 3 == 0, "-").otherwise((k % 50).cast("string")), F.when(k % 3 == 0, "-").otherwise(F.col("user_id").cast("string")), path)
    return logs.numstat(e.select(line.alias("line")), e.where("event_id % 5 = 0").select(path.alias("path"), F.col("event_type").alias("status")))


@register(
    "x9_tree_listing",
    """with p as (select distinct regexp_extract(url, '://([^?#]*)', 1) path from pages order by path limit 100), s as (select string_split(path, '/') p from p),
    d as (select distinct unnest([p[1:i] for i in range(0, len(p))]) p, true is_dir from s), b as (select * from d union all select p, false from s),
    k as (select *, [{'f': not is_dir and i = len(p), 'x': p[i]} for i in range(1, len(p) + 1)] key from b)
    select (row_number() over (order by key) - 1)::int nr, len(p)::int depth, case when len(p) = 0 then '' else p[len(p)] end as name, is_dir from k""",
)
def listing_tree(spark: SparkSession, d: str) -> DataFrame:
    return logs.tree_rows(table(spark, d, "pages").select(F.regexp_extract("url", "://([^?#]*)", 1).alias("path")))


@register(
    "o14_breadth_first",
    """with s as (select string_split(regexp_extract(url, '://([^?#]*)', 1), '/') p from pages), e as (select distinct unnest([array_to_string(p[1:i], '/') for i in range(1, len(p) + 1)]) path from s),
    x as (select path, len(string_split(path, '/'))::int depth from e)
    select (row_number() over (order by depth, path) - 1)::int nr, path, depth, (select count(*) from x) - 50 hidden from x order by depth, path limit 50""",
)
def breadth(spark: SparkSession, d: str) -> DataFrame:
    return logs.breadth_first(table(spark, d, "pages").select(F.regexp_extract("url", "://([^?#]*)", 1).alias("path")))


@register(
    "o12_folders_first",
    "with e as (select distinct string_split(regexp_extract(url, '://([^?#]*)', 1), '/') p from pages), n as (select distinct p[2] as name, len(p) > 2 is_dir from e where len(p) >= 2) select name, is_dir from n order by is_dir desc, name",
)
def folders_first(spark: SparkSession, d: str) -> DataFrame:
    p = F.split(F.regexp_extract("url", "://([^?#]*)", 1), "/")
    n = table(spark, d, "pages").select(p.alias("p")).where(F.size("p") >= 2).select(F.get("p", F.lit(1)).alias("name"), (F.size("p") > 2).alias("is_dir")).distinct()
    return n.orderBy(F.desc("is_dir"), "name")


@register(
    "s13_unignored",
    """with p as (select distinct regexp_extract(url, '://([^?#]*)', 1) path from pages) select path from p
    where regexp_matches(path, '\\.html$') and not regexp_matches(path, '(^|/)fr/') and (not starts_with(path, 'm.') or regexp_matches(path, '(^|/)en(/|$)'))""",
)
def unignored(spark: SparkSession, d: str) -> DataFrame:
    from millrace.sources import readers

    paths = table(spark, d, "pages").select(F.regexp_extract("url", "://([^?#]*)", 1).alias("path")).distinct()
    return readers.unignored(paths, ["# rules", "m.*", "!en/", "fr/"], "*.html")
