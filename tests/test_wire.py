"""Wire formats: requests, answers and chunks of the three formats, and what one becomes in another."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import wire

COMPLETIONS = {
    "model": "m", "max_tokens": 9, "temperature": 0.5, "top_p": 0.9, "stop": ["x", "y"], "stream": True,
    "messages": [
        {"role": "system", "content": "be brief"},
        {"role": "user", "content": "hello"},
        {"role": "user", "content": [{"type": "text", "text": "look"}, {"type": "image_url", "image_url": {"url": "data:image/png;base64,AAA="}}, {"type": "image_url", "image_url": {"url": "http://x/y.png"}}]},
        {"role": "assistant", "content": "calling", "tool_calls": [{"id": "c1", "type": "function", "function": {"name": "f", "arguments": '{"a":[1,"b"]}'}}]},
        {"role": "tool", "tool_call_id": "c1", "content": '[1, "é"]'},
        {"role": "assistant", "content": "done"},
    ],
    "tools": [{"type": "function", "function": {"name": "f", "description": "d", "parameters": {"type": "object", "properties": {}}}}],
    "tool_choice": "required",
}


def through(spark, bodies, expression):
    rows = spark.createDataFrame([(i, b if b is None or isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)], "i int, body string")
    out = [r.x for r in rows.select("i", expression(F.col("body")).alias("x")).orderBy("i").collect()]
    return [None if x is None else json.loads(x) for x in out]


def test_content_blocks(spark):
    got = through(spark, [COMPLETIONS], lambda b: wire.convert_request(b, "completions", "messages"))[0]
    mark = {"cache_control": {"type": "ephemeral"}}
    assert got == {
        "max_tokens": 9, "temperature": 0.5, "top_p": 0.9, "stream": True, "stop_sequences": ["x", "y"], "tool_choice": {"type": "any"},
        "system": [{"type": "text", "text": "be brief", **mark}],
        "messages": [
            {"role": "user", "content": [{"type": "text", "text": "hello", **mark}]},
            {"role": "user", "content": [{"type": "text", "text": "look", **mark}, {"type": "image", "source": {"type": "base64", "media_type": "image/png", "data": "AAA="}, **mark}, {"type": "image", "source": {"type": "url", "url": "http://x/y.png"}}]},
            {"role": "assistant", "content": [{"type": "text", "text": "calling"}, {"type": "tool_use", "id": "c1", "name": "f", "input": {"a": [1, "b"]}}]},
            {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "c1", "content": '[1, "é"]'}]},
            {"role": "assistant", "content": [{"type": "text", "text": "done"}]},
        ],
        "tools": [{"name": "f", "description": "d", "input_schema": {"type": "object", "properties": {}}}],
    }


def test_there_and_back(spark):
    back = through(spark, [COMPLETIONS], lambda b: wire.convert_request(wire.convert_request(b, "completions", "messages"), "messages", "completions"))[0]
    assert back == {k: v for k, v in COMPLETIONS.items() if k != "model"}
    back = through(spark, [COMPLETIONS], lambda b: wire.convert_request(wire.convert_request(b, "completions", "responses"), "responses", "completions"))[0]
    want = {k: v for k, v in COMPLETIONS.items() if k != "temperature"}
    calling = dict(want["messages"][3])
    apart = [{"role": "assistant", "content": "calling"}, {"role": "assistant", "tool_calls": calling["tool_calls"]}]
    assert back == want | {"messages": [*want["messages"][:3], *apart, *want["messages"][4:]]}


def test_odd_requests(spark):
    bodies = [None, "", "no json", "[1]", {}, {"messages": "x"}, {"messages": [None, 3, {"content": "a"}, {"role": "user"}, {"role": "user", "content": []}, {"role": "system", "content": ""}, {"role": "ghost", "content": "a"}]}]
    for form in ("messages", "responses"):
        got = through(spark, bodies, lambda b: wire.convert_request(b, "completions", form))
        assert got[:4] == [None] * 4 and all(not x.get("messages", x.get("input")) for x in got[4:])
    image = {"role": "user", "content": [{"type": "image", "source": {"type": "base64", "media_type": "a/b", "data": "Q"}}, {"type": "tool_result", "tool_use_id": "t", "content": [{"type": "text", "text": "r"}]}]}
    got = through(spark, [{"messages": [image], "stop_sequences": "s", "tool_choice": {"type": "tool", "name": "g"}}], lambda b: wire.convert_request(b, "messages", "completions"))[0]
    assert [m["role"] for m in got["messages"]] == ["tool", "user"] and json.loads(got["messages"][0]["content"]) == [{"type": "text", "text": "r"}]
    assert got["stop"] == "s" and got["tool_choice"] == {"type": "function", "function": {"name": "g"}}


ANSWER = {
    "id": "chatcmpl_7", "object": "chat.completion", "created": 5, "model": "m",
    "choices": [{"index": 0, "message": {"role": "assistant", "content": "hi", "tool_calls": [{"id": "c", "type": "function", "function": {"name": "f", "arguments": '{"x":1}'}}]}, "finish_reason": "tool_calls"}],
    "usage": {"prompt_tokens": 3, "completion_tokens": 4, "total_tokens": 7, "prompt_tokens_details": {"cached_tokens": 2}},
}


@pytest.mark.parametrize("form", ["messages", "responses"])
def test_answers(spark, form):
    made = through(spark, [ANSWER], lambda b: wire.convert_response(b, "completions", form))[0]
    if form == "messages":
        assert made == {
            "id": "chatcmpl_7", "type": "message", "role": "assistant", "model": "m", "stop_reason": "tool_use",
            "content": [{"type": "text", "text": "hi"}, {"type": "tool_use", "id": "c", "name": "f", "input": {"x": 1}}],
            "usage": {"input_tokens": 3, "output_tokens": 4, "cache_read_input_tokens": 2},
        }
    else:
        assert made["id"] == "resp_7" and made["stop_reason"] == "tool_call" and [o["type"] for o in made["output"]] == ["message", "function_call"]
        assert made["usage"] == {"input_tokens": 3, "output_tokens": 4, "total_tokens": 7, "input_tokens_details": {"cached_tokens": 2}}
    back = through(spark, [made], lambda b: wire.convert_response(b, form, "completions", F.lit(5)))[0]
    assert back == ANSWER
    kept = through(spark, ["nothing", '{"a":1}'], lambda b: F.to_json(F.struct(wire.convert_response(b, "messages", "completions").alias("v"))))
    assert [k["v"] for k in kept] == ["nothing", '{"a":1}']


CHUNKS = [
    ({"type": "content_block_start", "index": 1, "content_block": {"type": "tool_use", "id": "t", "name": "f"}}, {"tool_calls": [{"index": 1, "id": "t", "type": "function", "function": {"name": "f", "arguments": ""}}]}, None),
    ({"type": "content_block_delta", "index": 1, "delta": {"type": "input_json_delta", "partial_json": '{"a'}}, {"tool_calls": [{"index": 1, "function": {"arguments": '{"a'}}]}, None),
    ({"type": "content_block_delta", "index": 0, "delta": {"type": "text_delta", "text": "ab\n"}}, {"content": "ab\n"}, None),
    ({"type": "message_delta", "delta": {"stop_reason": "max_tokens"}, "usage": {"input_tokens": 1, "output_tokens": 2}}, {}, "length"),
]


def test_chunks(spark):
    sent = [f"event: {c['type']}\ndata: {json.dumps(c)}" for c, _, _ in CHUNKS]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(sent)], "i int, c string")
    there = rows.withColumn("o", wire.convert_chunk(F.col("c"), "messages", "completions", F.lit(0)))
    made = there.withColumn("r", wire.convert_chunk(F.col("o"), "completions", "responses")).withColumn("b", wire.convert_chunk(F.col("o"), "completions", "messages")).orderBy("i").collect()
    for row, (chunk, delta, finish) in zip(made, CHUNKS):
        got = json.loads(row.o.removeprefix("data: "))
        assert got["choices"][0]["delta"] == delta and got["choices"][0].get("finish_reason") == finish
        assert json.loads(row.b).get("type") == chunk["type"]
    events = [r.r.split("\n")[0] for r in made]
    assert events == ["event: response.output_item.added", "event: response.function_call_arguments.delta", "event: response.output_text.delta", "event: response.completed"]
    assert json.loads(made[3].r.split("data: ")[1])["response"]["usage"] == {"input_tokens": 1, "output_tokens": 2, "total_tokens": 3}
    odd = spark.createDataFrame([("",), ("data: [DONE]",), ("event: ping\ndata: {}",), (None,)], "c string").select(*[wire.convert_chunk(F.col("c"), s, t, F.lit(0)).alias(s) for s, t in (("completions", "messages"), ("responses", "messages"))]).collect()
    assert [r.completions for r in odd] == ["", "data: [DONE]", "event: ping\ndata: {}", None] and odd[2].responses == "{}"
