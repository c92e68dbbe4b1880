"""Registered relational queries: predicates, joins, aggregations, windows, sorts and set operations.

Customers stand for workspaces, orders for sessions, line items for messages and their parts, events for usage records.
A query whose SQL both engines understand is written once; the second text is DuckDB's where the dialects differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.plans.registry import register
from millrace.sources.tables import sql

QUERIES: dict[str, tuple[str, str | None]] = {
    # scans and predicates
    "s1_full_scan": ("select r_regionkey, r_name from region", None),
    "s2_keyed_scan": ("select l_orderkey, l_linenumber, l_quantity from lineitem where l_orderkey = 7", None),
    "s6_latest_version": (
        "select user_id, event_type, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) rn from events) x where rn = 1",
        None,
    ),
    "p1_conjunction": (
        "select o_orderkey, o_totalprice from orders where o_orderstatus = 'O' and o_totalprice >= 1000 and o_custkey is not null and o_orderpriority like '%HIGH%'",
        None,
    ),
    "p2_cursor_listing": (
        "select o_orderkey, o_orderdate from orders where o_orderdate < timestamp '1996-01-01 00:00:00' and o_orderstatus <> 'F' order by o_orderdate desc, o_orderkey desc limit 100",
        None,
    ),
    "p3_like_contains": ("select p_partkey, p_name from part where lower(p_name) like '%re%'", None),
    "p4_like_escaped": (r"select page_id from pages where url ilike '%utm\\_source%' escape '\\'", r"select page_id from pages where url ilike '%utm\_source%' escape '\'"),
    "p5_threshold": ("select doc_id, n_chars from documents where n_chars >= 4000", None),
    "p6_half_open_range": ("select event_id from events where ts >= timestamp '2024-01-05 00:00:00' and ts < timestamp '2024-01-09 00:00:00'", None),
    "p7_date_range_to_midnight": ("select event_id from events where ts >= timestamp '2024-01-05 00:00:00' and ts <= timestamp '2024-01-08 00:00:00'", None),
    "p8_in_list": ("select c_custkey, c_name from customer where c_mktsegment in ('BUILDING', 'MACHINERY')", None),
    "p9_in_or_null": (
        "select u.event_id from events u left join (select doc_id from labels where toxic = 1) t on u.event_id = t.doc_id where u.event_type in ('error') or t.doc_id is not null",
        None,
    ),
    "p10_null_aware_inequality": (
        "select d.doc_id from documents d left join labels l on d.doc_id = l.doc_id where l.quality is null or l.quality <> 1",
        None,
    ),
    "p12_soft_delete": ("select d.doc_id from documents d left join labels l on d.doc_id = l.doc_id and l.quality = 0 where l.doc_id is null", None),
    "p13_risk_bucket": (
        "select doc_id, case when n_chars = 0 then 'low' when n_chars < 1000 then 'medium' when n_chars < 3000 then 'high' else 'critical' end risk from documents",
        None,
    ),
    "p15_event_routing": ("select event_id, user_id from events where event_type = 'purchase' and (props like '{\"k\": 1%' or props like '{\"k\": 2%')", None),
    "p17_length_validation": ("select doc_id, length(text) between 1 and 1000 ok from documents", None),
    # joins
    "j1_inner": ("select o.o_orderkey, l.l_linenumber, o.o_totalprice from orders o join lineitem l on o.o_orderkey = l.l_orderkey where l.l_quantity > 45", None),
    "j2_three_way": (
        "select n.n_name, c.c_custkey, o.o_orderkey from orders o join customer c on o.o_custkey = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey where o.o_totalprice > 200000",
        None,
    ),
    "j3_composite_key": (
        "select a.event_id a, b.event_id b from events a join events b on a.user_id = b.user_id and a.value = b.value where a.event_id < b.event_id",
        None,
    ),
    "j4_constant_in_on": ("select c.c_custkey, o.o_orderkey from customer c join orders o on c.c_custkey = o.o_custkey and o.o_orderstatus = 'P'", None),
    "j5_left_predicate_in_on": (
        "select c.c_custkey, count(o.o_orderkey) n from customer c left join orders o on c.c_custkey = o.o_custkey and o.o_orderstatus = 'P' group by c.c_custkey",
        None,
    ),
    "j6_star": (
        """select l.l_orderkey, l.l_linenumber, r.r_name, sn.n_name supplier_nation, p.p_brand from lineitem l
        join orders o on l.l_orderkey = o.o_orderkey join customer c on o.o_custkey = c.c_custkey join part p on l.l_partkey = p.p_partkey
        left join supplier s on l.l_suppkey = s.s_suppkey left join nation n on c.c_nationkey = n.n_nationkey
        left join nation sn on s.s_nationkey = sn.n_nationkey left join region r on n.n_regionkey = r.r_regionkey where l.l_discount > 0.08""",
        None,
    ),
    "j7_left_on_false": ("select c.c_custkey, o.o_orderkey from customer c left join orders o on false", None),
    "j8_right_then_left": (
        "select n.n_nationkey, c.c_custkey, s.s_suppkey from customer c right join nation n on c.c_nationkey = n.n_nationkey left join supplier s on s.s_nationkey = n.n_nationkey and s.s_acctbal > 9000 where c.c_acctbal > 9000",
        None,
    ),
    "j9_cross_of_filtered": ("select n.n_name, r.r_name from nation n join region r on r.r_regionkey = 1 where n.n_regionkey = 2", None),
    "j10_left_lookup": ("select o.o_orderkey, c.c_name from orders o left join customer c on o.o_custkey = c.c_custkey where o.o_totalprice > 250000", None),
    "j11_group_join": (
        "select o.o_orderkey, array_join(array_sort(collect_list(lpad(cast(l.l_linenumber as string), 3, '0') || ':' || cast(l.l_partkey as string))), ',') parts from orders o left join lineitem l on o.o_orderkey = l.l_orderkey group by o.o_orderkey",
        "select o.o_orderkey, coalesce(string_agg(lpad(l.l_linenumber::varchar, 3, '0') || ':' || l.l_partkey, ',' order by lpad(l.l_linenumber::varchar, 3, '0') || ':' || l.l_partkey), '') parts from orders o left join lineitem l on o.o_orderkey = l.l_orderkey group by o.o_orderkey",
    ),
    "j12_semi": ("select o_orderkey from orders o where exists (select 1 from customer c where c.c_custkey = o.o_custkey and c.c_mktsegment = 'BUILDING')", None),
    "j13_anti_orphans": ("select count(*) orphans from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey)", None),
    "j14_multi_lookup": (
        """with spend as (select user_id, cast(sum(value) as decimal(18, 2)) v from events where event_type = 'purchase' group by user_id),
        seen as (select user_id, count(*) n from events where event_type = 'view' group by user_id), u as (select distinct user_id from events)
        select u.user_id, coalesce(v, 0) spend, coalesce(n, 0) views from u left join spend on u.user_id = spend.user_id left join seen on u.user_id = seen.user_id""",
        None,
    ),
    "j15_self_join_parent": (
        "select a.conv_id, a.turn parent, b.turn child from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1 where a.role = 'user'",
        None,
    ),
    "j16_calendar": (
        """with d as (select explode(sequence(date'2024-01-01', date'2024-02-05', interval 1 day)) day), t as (select distinct event_type from events),
        e as (select to_date(ts) day, event_type, count(*) n from events group by 1, 2)
        select d.day, t.event_type, coalesce(e.n, 0) n from d cross join t left join e on d.day = e.day and t.event_type = e.event_type""",
        """with d as (select unnest(generate_series(date '2024-01-01', date '2024-02-05', interval 1 day))::date as day), t as (select distinct event_type from events),
        e as (select ts::date as day, event_type, count(*) n from events group by 1, 2)
        select d.day, t.event_type, coalesce(e.n, 0) n from d cross join t left join e on d.day = e.day and t.event_type = e.event_type""",
    ),
    "j18_reconciliation": (
        """with a as (select user_id, count(*) n from events where event_type = 'purchase' group by user_id), b as (select o_custkey user_id, count(*) m from orders group by o_custkey)
        select coalesce(a.user_id, b.user_id) user_id, case when a.user_id is null then 'missing' when b.user_id is null then 'unbilled' when n = m then 'ok' else 'differs' end status from a full outer join b on a.user_id = b.user_id""",
        None,
    ),
    # aggregations
    "a1_group_count": ("select source, count(*) n from documents group by source", None),
    "a2_conditional_count": ("select user_id, count_if(event_type = 'purchase') purchases from events group by user_id", None),
    "a3_widening_sum": ("select l_returnflag, sum(cast(l_linenumber as bigint)) n from lineitem group by l_returnflag", "select l_returnflag, sum(l_linenumber)::bigint n from lineitem group by l_returnflag"),
    "a5_daily_sum": (
        "select to_date(ts) day, event_type, get_json_object(props, '$.k') k, count(*) n from events group by 1, 2, 3",
        "select ts::date as day, event_type, json_extract_string(props, '$.k') k, count(*) n from events group by 1, 2, 3",
    ),
    "a6_weekly_sum": (
        "select user_id, cast(extract(yearofweek from ts) * 100 + weekofyear(ts) as int) week, coalesce(sum(cast(round(value * 100) as bigint)), 0) cents from events where event_type = 'purchase' group by 1, 2",
        "select user_id, (isoyear(ts) * 100 + week(ts))::int as week, coalesce(sum(round(value * 100)::bigint), 0)::bigint cents from events where event_type = 'purchase' group by 1, 2",
    ),
    "a7_weekly_complement": (
        "select user_id, cast(extract(yearofweek from ts) * 100 + weekofyear(ts) as int) week, count(*) n from events where event_type is null or event_type <> 'purchase' group by 1, 2",
        "select user_id, (isoyear(ts) * 100 + week(ts))::int as week, count(*) n from events where event_type is null or event_type <> 'purchase' group by 1, 2",
    ),
    "a8_top_share": (
        """with s as (select user_id, event_type, count(*) n from events group by 1, 2), r as (select *, row_number() over (partition by user_id order by n desc, event_type) k, sum(n) over (partition by user_id) t from s)
        select user_id, event_type, k, cast(round(n * 1000 / t) as int) share_permille from r where k <= 3""",
        None,
    ),
    "a9_multi_measure": ("select l_returnflag, l_linestatus, sum(l_quantity) qty, sum(l_quantity) + count(*) both_sums, count(*) n from lineitem group by 1, 2", None),
    "a12_session_stats": (
        "select event_type, count(*) n, min(ts) first_ts, max(ts) last_ts, median(value) middle, count(distinct user_id) users from events group by event_type",
        None,
    ),
    "a13_latest_nonzero": (
        "select user_id, cast(sum(value) as decimal(18, 2)) total, max_by(event_id, struct(ts, event_id)) filter (where value > 0) latest from events group by user_id",
        "select user_id, sum(value)::decimal(18, 2) total, arg_max(event_id, (ts, event_id)) filter (where value > 0) latest from events group by user_id",
    ),
    "a15_diff_summary": ("select l_orderkey, cast(sum(l_quantity) as bigint) additions, cast(sum(l_linenumber) as bigint) deletions, count(distinct l_partkey) files from lineitem group by l_orderkey", None),
    "a16_first_last": (
        "select user_id, min_by(event_id, struct(ts, event_id)) first_event, max_by(event_id, struct(ts, event_id)) last_event from events group by user_id",
        "select user_id, arg_min(event_id, (ts, event_id)) first_event, arg_max(event_id, (ts, event_id)) last_event from events group by user_id",
    ),
    "a17_histogram_sentence": (
        "select user_id, 'Seen ' || sum(n) || ': ' || array_join(array_sort(collect_list(n || 'x' || event_type)), ', ') said from (select user_id, event_type, count(*) n from events group by 1, 2) x group by user_id",
        "select user_id, 'Seen ' || sum(n)::bigint || ': ' || string_agg(n || 'x' || event_type, ', ' order by n || 'x' || event_type) said from (select user_id, event_type, count(*) n from events group by 1, 2) x group by user_id",
    ),
    "a20_distinct": ("select distinct user_id, event_type from events", None),
    "a21_count_all": ("select count(*) n from lineitem", None),
    "a23_last_write": (
        "select user_id, event_type, max_by(value, struct(ts, event_id)) value from events group by 1, 2",
        "select user_id, event_type, arg_max(value, (ts, event_id)) as value from events group by 1, 2",
    ),
    # windows
    "w1_delta": ("select day, n, n - lag(n, 1, cast(0 as bigint)) over (order by day) delta from (select cast(ts as date) day, count(*) n from events group by 1) x", 'select day, n, n - lag(n, 1, 0) over (order by day) delta from (select ts::date as day, count(*) n from events group by 1) x'),
    "w2_reverse_running_total": (
        "select conv_id, turn from (select conv_id, turn, sum(length(text)) over (partition by conv_id order by turn desc) c from conversations) x where c > 2000",
        None,
    ),
    "w3_turn_counter": (
        "select conv_id, turn from (select conv_id, turn, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn desc) k from conversations) x where k >= 2",
        None,
    ),
    "w4_stop_at_marker": (
        "select conv_id, turn from (select conv_id, turn, coalesce(max(case when role = 'system' then 1 else 0 end) over (partition by conv_id order by turn desc rows between unbounded preceding and 1 preceding), 0) k from conversations) x where k = 0",
        None,
    ),
    "w6_top_k": ("select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) k from orders) x where k <= 3", None),
    "w7_first_occurrence": (
        "select event_id, dense_rank() over (partition by user_id order by f) as nr from (select event_id, user_id, min(event_id) over (partition by user_id, event_type) f from events) x",
        None,
    ),
    "w8_first_value": (
        "select event_id, first_value(event_id) over (partition by user_id order by ts, event_id) anchor from events",
        None,
    ),
    "w9_position": ("select conv_id, turn, row_number() over (partition by conv_id order by turn) - 1 pos from conversations", None),
    # sorts and limits
    "o1_latest": ("select o_orderkey from orders order by o_orderdate desc, o_orderkey desc limit 100", None),
    "o3_page": ("select o_orderkey from orders order by o_orderdate desc, o_orderkey desc limit 50 offset 100", None),
    "o4_cursor_page": ("select event_id, ts from events where ts < timestamp '2024-01-10 00:00:00' order by ts desc, event_id desc limit 51", None),
    "o8_top_by_score": ("select l_orderkey, l_linenumber from lineitem order by l_extendedprice desc, l_orderkey, l_linenumber limit 20", None),
    "o13_multi_sort": ("select s_suppkey, s_nationkey from supplier order by s_nationkey, s_name", None),
    # set operations
    "t1_union_distinct": ("select c_nationkey k from customer union select s_nationkey k from supplier order by k", None),
    "t2_merge_last_wins": (
        "select k, max_by(v, seq) v from (select n_nationkey k, n_name v, 0 seq from nation union all select s_nationkey k, max(s_name) v, 1 seq from supplier group by s_nationkey) x group by k",
        "select k, arg_max(v, seq) v from (select n_nationkey k, n_name v, 0 seq from nation union all select s_nationkey k, max(s_name) v, 1 seq from supplier group by s_nationkey) x group by k",
    ),
    "t3_difference": ("select c_custkey k from customer except select o_custkey k from orders where o_orderstatus = 'P'", None),
    # quotas and state folds
    "st3_tumbling_week": (
        "select user_id, date_trunc('week', ts) week, count(*) n from events group by 1, 2",
        "select user_id, date_trunc('week', ts)::timestamp as week, count(*) n from events group by 1, 2",
    ),
    # sinks as set operations on state and change
    "k6_upsert_increment": (
        "select k, sum(n) n from (select user_id k, 10 n from events where event_type = 'signup' union all select user_id k, 1 n from events) x group by k",
        "select k, sum(n)::bigint n from (select user_id k, 10 n from events where event_type = 'signup' union all select user_id k, 1 n from events) x group by k",
    ),
    "k8_erasure": (
        "select d.doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id and l.toxic = 1)",
        None,
    ),
    # further dataflows
    "x12_priority_class": (
        "select user_id, min(case event_type when 'error' then 0 when 'purchase' then 1 when 'signup' then 2 when 'click' then 3 else 4 end) area from events group by user_id",
        None,
    ),
    "x22_fork_remap": (
        "select c.conv_id + 1000000 conv_id, c.turn, p.turn parent from conversations c left join conversations p on c.conv_id = p.conv_id and p.turn = c.turn - 1 and p.turn < 4 where c.turn < 4",
        None,
    ),
    "x23_conditional_reassign": ("select c_custkey, case when c_mktsegment = 'BUILDING' or c_acctbal < 0 then -1 else c_nationkey end project from customer", None),
    # search, audit and review
    "d2_3_keyword_search": (
        "select doc_id from documents where lower(text) like '%estion%' order by doc_id limit 50",
        None,
    ),
    "d2_8_audit_query": ("select event_id, ts, user_id from events where event_type = 'error' order by ts desc, event_id desc limit 1000", None),
    "x4_line_diff": (
        r"""with p as (select a.doc_id, coalesce(split(a.text, '\n'), array()) x, coalesce(split(b.text, '\n'), array()) y from documents a join documents b on b.doc_id = a.doc_id + 1),
        l as (select doc_id, posexplode(arrays_zip(x, y)) as (line, z) from p)
        select doc_id, line, z.x old_line, z.y new_line from l where not (z.x <=> z.y)""",
        """with p as (select a.doc_id, coalesce(string_split(a.text, chr(10)), []) x, coalesce(string_split(b.text, chr(10)), []) y from documents a join documents b on b.doc_id = a.doc_id + 1),
        l as (select doc_id, x, y, unnest(range(greatest(len(x), len(y))))::int line from p)
        select doc_id, line, x[line + 1] old_line, y[line + 1] new_line from l where x[line + 1] is distinct from y[line + 1]""",
    ),
    "x9_tree_prefixes": (
        "select prefix, count(*) n from (select explode(transform(sequence(1, size(p)), i -> array_join(slice(p, 1, i), '/'))) prefix from (select split(regexp_extract(url, '://([^?#]*)', 1), '/') p from pages) q) r group by prefix",
        "select prefix, count(*) n from (select unnest([array_to_string(p[1:i], '/') for i in range(1, len(p) + 1)]) prefix from (select string_split(regexp_extract(url, '://([^?#]*)', 1), '/') p from pages)) group by prefix",
    ),
    "f70_json_extract": (
        "select event_id, cast(get_json_object(props, '$.k') as int) k from events where cast(get_json_object(props, '$.k') as int) > 50",
        "select event_id, json_extract_string(props, '$.k')::int k from events where json_extract_string(props, '$.k')::int > 50",
    ),
}


def _query(text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return sql(spark, sf_dir, text)

    return run


for _name, (_spark, _duck) in QUERIES.items():
    register(_name, _duck or _spark)(_query(_spark))
