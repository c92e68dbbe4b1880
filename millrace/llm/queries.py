"""The registered queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import audit, chat, counts, embed, jaccard, middle, mixing, packing, quality, toxicity, urls, warc, wavelet
from millrace.llm.store import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """The production vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_vocabulary() -> str:
    """The vocabulary file of formatted conversations, whose tokens give back every byte."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's number of links, component and verdict at a cosine of 0.98."""
    return embed.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of 4-word shingles and the component of texts linked at a similarity of 0.85."""
    return jaccard.similar(_table(spark, sf_dir, "documents"), words=4, percent=85)


def op3_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in a mixture whose targets lean towards small sources."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs).select("doc_id", "source", "block", "slot", "in_block")


def op4_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one that imitates control strings, read back from prefix-tree blocks."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    names = byte_vocabulary()
    return chat.read_conversations(chat.format_trees(rows.unionByName(own), names), names)


URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op5_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    judged = urls.judge(_table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op6_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 2048 tokens."""
    pieces = packing.pack(_table(spark, sf_dir, "documents"), vocabulary())
    crc = F.crc32("ids").alias("ids_crc32")
    return pieces.select("doc_id", "start", "length", crc, "doc_tokens", "sequence_id", "offset")


def op7_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and checksum, read back from the shard files."""
    path = new_path(spark, "wavelet")
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wavelet.write_shards(_table(spark, sf_dir, "documents"), path, vocabulary(), shards)
    return wavelet.read_documents(spark, path)


def op8_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base verdict and line-first verdict of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metadata and a conversion record for the response of every page."""
    return warc.derive(warc.responses_of(_table(spark, sf_dir, "pages")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a network that saw no label of the held-out fold."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    net = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % toxicity.FOLDS
    scored = toxicity.score(docs, net)
    return scored.select(
        "doc_id", F.coalesce(fold == toxicity.HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def piece_vocabulary() -> str:
    """The vocabulary file that tokens are counted by."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes and tokens of every document, and whether it has more than 4096 tokens."""
    return counts.count_tokens(_table(spark, sf_dir, "documents"), piece_vocabulary(), limit=4096)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in each order, by language and step."""
    return audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into lines and rearranged, and the text restored from the output."""
    moved = middle.transform(_table(spark, sf_dir, "documents").select("doc_id", "text"), seed=7, percent=100, spm_percent=50)
    digest = F.sha2(F.col("output").cast("binary"), 256)
    restored = F.sha2(middle.restore(F.col("output"), F.col("form")).cast("binary"), 256)
    return moved.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest.alias("output_sha256"), restored.alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embedding_near_duplicates": op1_embedding_near_duplicates,
        "op2_ngram_jaccard": op2_ngram_jaccard,
        "op3_pfair_mixing": op3_pfair_mixing,
        "op4_chat_prefix_tree": op4_chat_prefix_tree,
        "op5_url_templates": op5_url_templates,
        "op6_harmonic_packing": op6_harmonic_packing,
        "op7_wavelet_tokens": op7_wavelet_tokens,
        "op8_line_quality": op8_line_quality,
        "op9_warc_derivatives": op9_warc_derivatives,
        "op10_toxicity": op10_toxicity,
        "op11_token_counts": op11_token_counts,
        "op12_filter_audit": op12_filter_audit,
        "op13_fill_in_middle": op13_fill_in_middle,
    }


def _op8_sql() -> str:
    r = quality.DEFAULT
    phrases = " or ".join(f"contains(lower(x), '{p}')" for p in quality.BOILERPLATE)
    return rf"""
with d as (select doc_id, coalesce(text, '') t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws from d),
win as (select doc_id, i, array_to_string(ws[i:i + 7], ' ') h from w, unnest(range(1, len(ws) - 6)) u(i)),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, h) c from win) where c > 1),
cov as (select doc_id, count(distinct p) c from rep, unnest(range(i, i + 8)) u(p) group by doc_id),
l as (select doc_id, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') lw from d, unnest(string_split(t, chr(10))) u(x)),
lines as (
    select doc_id, x, length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) n,
        length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g')) * 100 > {r.max_symbol_percent} * length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g'))
        or length(regexp_replace(x, '[^|]+', '', 'g')) >= {r.min_separators}
        or (not regexp_matches(x, '[a-z]') and length(regexp_replace(x, '[^A-Z]+', '', 'g')) >= {r.min_shout_letters})
        or (not regexp_matches(x, '[\p{{P}}\p{{S}}][\x20\x09-\x0D]*$') and len(lw) <= {r.max_fragment_words})
        or len([i for i in range(1, len(lw) - {r.max_stutter - 1}) if len(list_distinct(lw[i:i + {r.max_stutter}])) = 1]) > 0
        or (strlen(x) <= {r.max_furniture_bytes} and ({phrases})) bad
    from l where len(lw) > 0),
per as (select doc_id, count(*) - count(distinct x) dup, coalesce(sum(n) filter (not bad), 0) good from lines group by doc_id),
f as (
    select w.doc_id, len(ws)::bigint n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint n_symbols, coalesce(dup, 0)::bigint n_dup_lines,
        coalesce(c, 0)::bigint n_repeat_words, coalesce(good, 0) good
    from w left join cov on w.doc_id = cov.doc_id left join per on w.doc_id = per.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < {r.min_words} or 100 * n_repeat_words > {r.max_repeat_percent} * n_words base_failed,
    not (n_words < {r.min_words} or 100 * n_repeat_words > {r.max_repeat_percent} * n_words) and good * 100 >= {r.min_kept_percent} * word_chars kept
from f"""


def _op9_sql() -> str:
    text = r"regexp_replace(p, '(?s)<!--.*?(-->|\z)', ' ', 'g')"
    for tag in warc.HIDDEN:
        text = rf"regexp_replace({text}, '(?is)<{tag}(\s[^>]*)?>.*?(</{tag}\s*>|\z)', ' ', 'g')"
    text = rf"regexp_replace({text}, '(?i)</?({warc.BREAKS})(\s[^>]*|/)?>', chr(10), 'g')"
    text = rf"regexp_replace({text}, '<[a-zA-Z/!?][^>]*>', '', 'g')"
    names = ", ".join(f"'{k}': '{v.replace(chr(39), chr(39) * 2)}'" for k, v in warc.NAMED.items())
    code = "case when lower(e[3]) = 'x' then ('0x' || e[4:length(e) - 1])::bigint else e[3:length(e) - 1]::bigint end"
    named = f"coalesce(map_extract_value(map {{{names}}}, e[2:length(e) - 1]), e)"
    char = f"case when e[2] <> '#' then {named} when {code} = 160 then ' ' when {code} between 1 and 55295 or {code} between 57344 and 1114111 then chr(({code})::int) else chr(65533) end"
    found = f"list_transform(regexp_extract_all(x, '{warc.ENTITY}'), lambda e: {char})"
    joined = f"list_transform(list_zip(string_split_regex(x, '{warc.ENTITY}'), {found}), lambda z: z[1] || coalesce(z[2], ''))"
    text = f"list_transform([{text}], lambda x: array_to_string({joined}, ''))[1]"
    text = rf"regexp_replace({text}, '[ \t\r\f]+', ' ', 'g')"
    text = rf"regexp_replace({text}, ' ?(\n ?)+', chr(10), 'g')"
    text = rf"regexp_replace({text}, '^[ \n]+|[ \n]+$', '', 'g')"
    title = r"regexp_extract(p, '(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>', 1)"
    title = rf"regexp_replace(regexp_replace({title}, '[ \t\r\n\f]+', ' ', 'g'), '^ | $', '', 'g')"
    crlf = "chr(13) || chr(10)"

    def uuid(h: str) -> str:
        parts = " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
        return f"'<urn:uuid:' || {parts} || '>'"

    return rf"""
with a as (select page_id, url, coalesce(html, '') p, md5(page_id::varchar || chr(10) || coalesce(url, '')) h from pages),
b as (select *, {uuid("h")} refers_to from a),
c as (
    select *, 'metadata' warc_type, 'application/warc-fields' content_type,
        'status: 200' || {crlf} || 'title: ' || {title} || {crlf} || 'links: ' || len(regexp_extract_all(p, '(?i)<a\s[^>]*href'))
        || {crlf} || 'payload-length: ' || strlen(p) || {crlf} block from b
    union all select *, 'conversion', 'text/plain', {text} from b),
d as (select *, md5(refers_to || chr(10) || warc_type) g from c)
select page_id, {uuid("g")} record_id, warc_type, refers_to, url target_uri, '1970-01-01T00:00:00Z' warc_date, content_type,
    'sha1:' || sha1(p) payload_digest, 'sha1:' || sha1(block) block_digest, strlen(block)::bigint content_length,
    'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf} || 'Content-Length: ' || strlen(p) || {crlf} source_headers, block
from d"""


def _op12_sql() -> str:
    return r"""
with d as (select doc_id, coalesce(lang, '') part, coalesce(text, '') t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws, min(doc_id) over (partition by t) first from d),
m as (
    select doc_id, part, (case when len(ws) < 200 then 1 else 0 end) + (case when 100 * len(list_distinct(ws)) < 50 * len(ws) then 2 else 0 end)
        + (case when 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t) then 4 else 0 end)
        + (case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end) + (case when doc_id > first then 16 else 0 end) mask from w),
l as (select doc_id, max(quality) quality, max(toxic) toxic from labels group by doc_id),
c as (
    select part, mask, count(*) n, count(*) filter (l.quality = 1) good, count(*) filter (l.toxic = 1) bad
    from m left join l on m.doc_id = l.doc_id group by part, mask),
x as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(f, b)),
o as (
    select x1.f || x2.f || x3.f || x4.f || x5.f filter_order, [x1.b, x2.b, x3.b, x4.b, x5.b] bs
    from x x1, x x2, x x3, x x4, x x5 where x1.b + x2.b + x3.b + x4.b + x5.b = 31 and x1.b | x2.b | x3.b | x4.b | x5.b = 31),
s as (select filter_order, step::int step, bs[step] own, coalesce(list_sum(bs[1:step - 1]), 0)::int before from o, range(1, 6) r(step)),
p as (
    select part, filter_order, step, own,
        coalesce(sum(n) filter (mask & (before | own) = 0), 0)::bigint kept,
        coalesce(sum(n) filter (mask & before = 0 and mask & own > 0), 0)::bigint removed,
        coalesce(sum(n) filter (mask & before > 0 and mask & own > 0), 0)::bigint redundant,
        coalesce(sum(n) filter (mask = own), 0)::bigint unique_fails,
        coalesce(sum(good) filter (mask & before = 0 and mask & own > 0), 0)::bigint good_lost,
        coalesce(sum(bad) filter (mask & before = 0 and mask & own > 0), 0)::bigint toxic_lost
    from c, s group by part, filter_order, step, own)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) over (partition by part, own))::bigint shapley from p"""


def _op13_sql() -> str:
    draw = ", ".join(f"('0x' || substr(h, {8 * i + 1}, 8))::bigint h{i + 1}" for i in range(4))
    return rf"""
with d as (select doc_id, coalesce(text, '') t, sha256('7:' || coalesce(doc_id::varchar, '')) h from documents),
u as (select doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') us, {draw} from d),
c as (
    select *, len(us)::bigint n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) a, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) b,
        case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain'
            when h4 % 100 < 50 then 'spm' else 'psm' end form from u),
p as (
    select *, array_to_string(us[1:a], '') x, array_to_string(us[a + 1:b], '') y, array_to_string(us[b + 1:], '') z from c)
select doc_id, n, form, case when form <> 'plain' then length(x) end prefix_chars, case when form <> 'plain' then length(y) end middle_chars,
    sha256(case form when 'plain' then t when 'psm' then '<P>' || x || '<S>' || z || '<M>' || y else '<S>' || z || '<P>' || x || '<M>' || y end) output_sha256,
    sha256(t) restored_sha256 from p"""


def oracle_sql() -> dict[str, str]:
    return {
        "op8_line_quality": _op8_sql(),
        "op9_warc_derivatives": _op9_sql(),
        "op12_filter_audit": _op12_sql(),
        "op13_fill_in_middle": _op13_sql(),
    }
