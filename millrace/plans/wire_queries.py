"""Registered queries of the chat services' wire formats, over all conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import wire
from millrace.plans.registry import register
from millrace.sources.tables import table


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    """(conv_id, body): every conversation as a request in the format of messages with tool calls."""
    turn = F.struct("turn", F.struct("role", F.col("text").alias("content")).alias("m"))
    listed = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(turn)), lambda x: x["m"]).alias("messages"))
    body = F.struct(F.concat(F.lit("m-"), (F.col("conv_id") % 5).cast("string")).alias("model"), (F.col("conv_id") % 1000 + 1).alias("max_tokens"), F.col("messages"), (F.col("conv_id") % 2 == 0).alias("stream"))
    return listed.select("conv_id", F.to_json(body).alias("body"))


def _turns(bodies: DataFrame) -> DataFrame:
    """The turns of bodies in the format they came from."""
    read = F.from_json("body", "model string, max_tokens long, stream boolean, messages array<struct<role: string, content: string>>").alias("b")
    told = bodies.select("conv_id", read).select("conv_id", "b.model", "b.max_tokens", "b.stream", F.posexplode("b.messages").alias("at", "m"))
    return told.select("conv_id", "model", "max_tokens", "stream", "at", "m.role", F.col("m.content").alias("text"))


ORIGINAL = """select conv_id, 'm-' || (conv_id % 5) model, conv_id % 1000 + 1 max_tokens, conv_id % 2 = 0 as stream, (row_number() over (partition by conv_id order by ROLE turn) - 1)::int as at, role, text
    from conversations where text <> ''"""


@register("x7_through_responses", ORIGINAL.replace("ROLE", ""))
def through_responses(spark: SparkSession, d: str) -> DataFrame:
    """Requests turned into lists of input items and back."""
    there = wire.convert_request(F.col("body"), "completions", "responses")
    return _turns(_bodies(spark, d).select("conv_id", wire.convert_request(there, "responses", "completions").alias("body")))


@register("x7_through_messages", ORIGINAL.replace("ROLE", "role <> 'system',").replace("'m-' || (conv_id % 5)", "null::varchar"))
def through_messages(spark: SparkSession, d: str) -> DataFrame:
    """Requests turned into content blocks and back; system texts come first, and the model is named by the address there."""
    there = wire.convert_request(F.col("body"), "completions", "messages")
    return _turns(_bodies(spark, d).select("conv_id", wire.convert_request(there, "messages", "completions").alias("body")))


@register(
    "x7_content_blocks",
    """with c as (select *, row_number() over (partition by conv_id order by role <> 'system', turn) k from conversations where text <> '')
    select conv_id, (row_number() over (partition by conv_id, role = 'system' order by turn) - 1)::int as at, role, 'text' kind, text, k <= 4 as cached from c""",
)
def content_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of every request, of which the first four are marked to be cached."""
    block = "array<struct<type: string, text: string, cache_control: struct<type: string>>>"
    shape = f"system {block}, messages array<struct<role: string, content: {block}>>"
    read = _bodies(spark, d).select("conv_id", F.from_json(wire.convert_request(F.col("body"), "completions", "messages"), shape).alias("b"))

    def told(role: Column, b: Column) -> list[Column]:
        return [role.alias("role"), b["type"].alias("kind"), b["text"].alias("text"), (b["cache_control"]["type"] == "ephemeral").alias("cached")]

    system = read.select("conv_id", F.posexplode("b.system").alias("at", "x")).select("conv_id", "at", *told(F.lit("system"), F.col("x")))
    turns = read.select("conv_id", F.posexplode("b.messages").alias("at", "m")).select("conv_id", "at", "m.role", F.explode("m.content").alias("x"))
    return system.unionByName(turns.select("conv_id", "at", *told(F.col("role"), F.col("x")))).withColumn("cached", F.coalesce("cached", F.lit(False)))


@register(
    "x7_answers",
    """select conv_id, turn, 'chatcmpl_' || conv_id || '_' || turn id, text as content, ['stop', 'length', 'content_filter'][turn % 3 + 1] finish, (conv_id % 100)::bigint prompt, length(text)::bigint completion,
    (conv_id % 100 + length(text))::bigint total, nullif(turn % 4, 0)::bigint cached from conversations where role = 'assistant' and text <> ''""",
)
def answers(spark: SparkSession, d: str) -> DataFrame:
    """Every answer through the three formats one after the other."""
    c = table(spark, d, "conversations").where("role = 'assistant' and text <> ''")
    stop = F.get(F.array(*map(F.lit, ("stop", "length", "content_filter"))), F.col("turn") % 3)
    message = F.struct(F.lit("assistant").alias("role"), F.col("text").alias("content"))
    choice = F.struct(F.lit(0).alias("index"), message.alias("message"), stop.alias("finish_reason"))
    prompt, completion = F.col("conv_id") % 100, F.length("text")
    cached = F.when(F.col("turn") % 4 != 0, F.struct((F.col("turn") % 4).alias("cached_tokens")))
    usage = F.struct(prompt.alias("prompt_tokens"), completion.alias("completion_tokens"), (prompt + completion).alias("total_tokens"), cached.alias("prompt_tokens_details"))
    body = F.to_json(F.struct(F.concat_ws("_", F.lit("chatcmpl"), "conv_id", "turn").alias("id"), F.array(choice).alias("choices"), usage.alias("usage")))
    sent = c.select("conv_id", "turn", body.alias("body"))
    for source, target in (("completions", "messages"), ("messages", "responses"), ("responses", "completions")):
        sent = sent.withColumn("body", wire.convert_response(F.col("body"), source, target, F.lit(0)))
    read = sent.select("conv_id", "turn", wire.read_response(F.col("body"), "completions").alias("r"))
    return read.select("conv_id", "turn", "r.id", "r.content", "r.finish", "r.usage.*")


@register(
    "x7_chunks",
    "select conv_id, turn, text as content, null::varchar finish from conversations where role = 'assistant' and text <> '' union all select conv_id, turn, null, 'stop' from conversations where role = 'assistant' and text <> ''",
)
def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Every answer as a chunk of text and a last chunk, from content blocks to messages with tool calls and on to events."""
    c = table(spark, d, "conversations").where("role = 'assistant' and text <> ''")
    text = F.concat(F.lit("event: content_block_delta\ndata: "), F.to_json(F.struct(F.lit("content_block_delta").alias("type"), F.lit(0).alias("index"), F.struct(F.lit("text_delta").alias("type"), F.col("text")).alias("delta"))))
    end = F.lit('event: message_delta\ndata: {"type":"message_delta","delta":{"stop_reason":"end_turn"},"usage":{"input_tokens":3,"output_tokens":4}}')
    sent = c.select("conv_id", "turn", F.explode(F.array(text, end)).alias("chunk"))
    there = sent.select("conv_id", "turn", wire.convert_chunk(F.col("chunk"), "messages", "completions", F.lit(0)).alias("chunk"))
    read = there.select("conv_id", "turn", wire.read_chunk(F.col("chunk"), "completions").alias("r"))
    return read.select("conv_id", "turn", "r.content", "r.finish")
