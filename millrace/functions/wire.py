"""Three wire formats of chat services, each read into one common shape and written from it, by column expressions.

Formats are ``messages`` (content blocks, a system list apart), ``responses`` (a list of input items) and ``completions``
(messages with tool calls). JSON is read as variant values, so a field may be a text here and a list there.

What a format cannot say is lost on the way through it, as a service would lose it: ``messages`` joins the texts of an assistant
turn, ``responses`` does not carry the temperature and gives each tool call a turn of its own. A body that is not a JSON object
gives null; messages without a role, parts of unknown types and empty system texts are left out. Ids that a format needs and
its source lacks are made from a digest of the body.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ("messages", "responses", "completions")
# Why a message ended, in the common shape and in each format; the first name is the one that is written.
FINISHES = {
    "messages": {"stop": ("end_turn",), "tool_calls": ("tool_use",), "length": ("max_tokens",), "content_filter": ("content_filter",)},
    "responses": {"stop": ("stop",), "tool_calls": ("tool_call", "tool_calls"), "length": ("max_output_tokens", "length"), "content_filter": ("content_filter",)},
    "completions": {"stop": ("stop",), "tool_calls": ("tool_calls",), "length": ("length",), "content_filter": ("content_filter",)},
}
# The prefixes of answers' ids, most tokens where a request does not say, parts that are marked as cached, the effort and verbosity asked for.
ID_PREFIXES = {"messages": "msg_", "responses": "resp_", "completions": "chatcmpl_"}
MOST_TOKENS, CACHED_PARTS = 32_000, 4
EFFORT, VERBOSITY = "medium", "low"

PART = "struct<type: string, text: string, url: string>"
CALL = "struct<id: string, name: string, arguments: string>"
MESSAGE = f"struct<role: string, content: string, parts: array<{PART}>, call_id: string, calls: array<{CALL}>>"
BLOCK = "struct<type: string, text: string, source: struct<type: string, url: string, media_type: string, data: string>, id: string, name: string, input: variant, tool_use_id: string, content: string>"
ITEM = "struct<role: string, content: variant, type: string, call_id: string, name: string, arguments: string, output: string>"


# -- variants ---------------------------------------------------------------------------------------------------------


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _text(v: Column, path: str) -> Column:
    """A field that is a text, else null."""
    return F.when(_kind(_get(v, path, "variant")) == "STRING", _get(v, path))


def _said(v: Column, path: str) -> Column:
    """A field's text, or its JSON where it is something else."""
    inner = _get(v, path, "variant")
    return F.when(_kind(inner) == "STRING", _get(v, path)).otherwise(F.to_json(inner))


def _list(v: Column, path: str) -> Column:
    """A field's elements; none where it is not a list."""
    inner = _get(v, path, "variant")
    return F.when(_kind(inner).startswith("ARRAY"), F.coalesce(_get(v, path, "array<variant>"), _no("variant"))).otherwise(_no("variant"))


def _no(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _struct(kind: str, **fields: Column) -> Column:
    """A struct of a type's fields, null where none is given."""
    names = [x.split(":")[0].strip() for x in _top_level(kind)]
    return F.struct(*[fields.get(n, F.lit(None)).alias(n) for n in names]).cast(kind)


def _top_level(kind: str) -> list[str]:
    """The fields of a struct type as they are written."""
    out, depth, at = [], 0, ""
    for c in kind[len("struct<") : -1]:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(at)
            at = ""
        else:
            at += c
    return [*out, at]


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.transform(F.array(value), body)[0]


def _variant(json_or_text: Column) -> Column:
    """A text as the JSON value that it holds, or as a text where it holds none."""
    return F.coalesce(F.try_parse_json(json_or_text), json_or_text.cast("variant"))


# -- requests: into the common shape ------------------------------------------------------------------------------------


def _image(p: Column) -> Column:
    """The address of an image part of any format."""
    inline = F.concat(F.lit("data:"), _text(p, "$.source.media_type"), F.lit(";base64,"), _text(p, "$.source.data"))
    from_source = F.when(_get(p, "$.source.type") == "url", _text(p, "$.source.url")).when(_get(p, "$.source.type") == "base64", inline)
    return F.coalesce(_text(p, "$.image_url.url"), _text(p, "$.image_url"), from_source)


def _parts(content: Column, texts: tuple[str, ...], images: tuple[str, ...]) -> Column:
    def part(p: Column) -> Column:
        is_text = _get(p, "$.type").isin(*texts) & _text(p, "$.text").isNotNull()
        is_image = _get(p, "$.type").isin(*images) & _image(p).isNotNull()
        return F.when(is_text, _struct(PART, type=F.lit("text"), text=_text(p, "$.text"))).when(is_image, _struct(PART, type=F.lit("image_url"), url=_image(p)))

    return F.filter(F.transform(content, part), lambda x: x.isNotNull())


def _user(parts: Column) -> Column:
    """No message for no parts, a plain text for one text, else the parts."""
    alone = (F.size(parts) == 1) & (parts[0]["type"] == "text")
    whole = F.when(alone, _struct(MESSAGE, role=F.lit("user"), content=parts[0]["text"])).otherwise(_struct(MESSAGE, role=F.lit("user"), parts=parts))
    return F.when(F.size(parts) == 0, _no(MESSAGE)).otherwise(F.array(whole))


def _user_of(m: Column, texts: tuple[str, ...], images: tuple[str, ...]) -> Column:
    content = _text(m, "$.content")
    plain = F.array(_struct(MESSAGE, role=F.lit("user"), content=content))
    return F.when(content.isNotNull(), plain).otherwise(_bound(_parts(_list(m, "$.content"), texts, images), _user))


def _tool(call_id: Column, content: Column) -> Column:
    return _struct(MESSAGE, role=F.lit("tool"), call_id=call_id, content=content)


def _calls_of(m: Column) -> Column:
    def call(c: Column) -> Column:
        return _struct(CALL, id=_get(c, "$.id"), name=_get(c, "$.function.name"), arguments=_said(c, "$.function.arguments"))

    return F.when(_kind(_get(m, "$.tool_calls", "variant")).startswith("ARRAY"), F.transform(_list(m, "$.tool_calls"), call))


def _from_messages(m: Column) -> Column:
    results = F.filter(_list(m, "$.content"), lambda p: _get(p, "$.type") == "tool_result")
    tools = F.transform(results, lambda p: _tool(_get(p, "$.tool_use_id"), _said(p, "$.content")))
    user = F.concat(tools, _bound(_parts(_list(m, "$.content"), ("text",), ("image",)), _user))
    texts = F.transform(_parts(_list(m, "$.content"), ("text",), ()), lambda p: p["text"])
    uses = F.filter(_list(m, "$.content"), lambda p: _get(p, "$.type") == "tool_use")
    calls = F.transform(uses, lambda p: _struct(CALL, id=_get(p, "$.id"), name=_get(p, "$.name"), arguments=F.coalesce(_said(p, "$.input"), F.lit("{}"))))
    assistant = _struct(MESSAGE, role=F.lit("assistant"), content=F.array_join(texts, ""), calls=F.when(F.size(calls) > 0, calls))
    return F.when(_get(m, "$.role") == "user", user).when(_get(m, "$.role") == "assistant", F.array(assistant)).otherwise(_no(MESSAGE))


def _from_completions(m: Column) -> Column:
    role, content = _get(m, "$.role"), _text(m, "$.content")
    assistant = _struct(MESSAGE, role=role, content=content, calls=_calls_of(m))
    return (
        F.when(role == "system", F.when(content != "", F.array(_struct(MESSAGE, role=role, content=content))).otherwise(_no(MESSAGE)))
        .when(role == "user", _user_of(m, ("text",), ("image_url",)))
        .when(role == "assistant", F.array(assistant))
        .when(role == "tool", F.array(_tool(_get(m, "$.tool_call_id"), _said(m, "$.content"))))
        .otherwise(_no(MESSAGE))
    )


def _from_responses(m: Column) -> Column:
    role, content = _get(m, "$.role"), _text(m, "$.content")
    first = F.get(F.filter(F.transform(_list(m, "$.content"), lambda p: _text(p, "$.text")), lambda t: t.isNotNull()), F.lit(0))
    system = F.coalesce(content, first)
    call = _struct(CALL, id=F.coalesce(_get(m, "$.call_id"), _get(m, "$.id")), name=_get(m, "$.name"), arguments=F.coalesce(_said(m, "$.arguments"), F.lit("{}")))
    said = F.transform(_parts(_list(m, "$.content"), ("output_text", "text"), ()), lambda p: p["text"])
    answer = F.coalesce(F.when(content != "", content), F.when(F.size(said) > 0, F.array_join(said, "")))
    results = F.filter(_list(m, "$.content"), lambda p: _get(p, "$.type") == "tool_result")
    tools = F.transform(results, lambda p: _tool(_get(p, "$.tool_call_id"), _said(p, "$.content")))
    return (
        F.when(role.isNull() & (_get(m, "$.type") == "function_call"), F.array(_struct(MESSAGE, role=F.lit("assistant"), calls=F.array(call))))
        .when(role.isNull() & (_get(m, "$.type") == "function_call_output"), F.array(_tool(_get(m, "$.call_id"), _said(m, "$.output"))))
        .when(role.isin("system", "developer"), F.when(system != "", F.array(_struct(MESSAGE, role=F.lit("system"), content=system))).otherwise(_no(MESSAGE)))
        .when(role == "user", F.concat(tools, _user_of(m, ("text", "input_text"), ("image_url", "input_image"))))
        .when(role == "assistant", F.array(_struct(MESSAGE, role=role, content=answer, calls=_calls_of(m))))
        .when(role == "tool", F.array(_tool(_get(m, "$.tool_call_id"), _said(m, "$.content"))))
        .otherwise(_no(MESSAGE))
    )


TOOL = "struct<name: string, description: string, parameters: variant>"


def read_request(body: Column, form: str) -> Column:
    """A request's body in a format as struct(model, max_tokens, temperature, top_p, stop, messages, stream, tools, tool_choice)."""

    def read(v: Column) -> Column:
        each = {"messages": _from_messages, "responses": _from_responses, "completions": _from_completions}[form]
        items = _list(v, "$.messages")
        if form == "responses":
            items = F.when(_kind(_get(v, "$.input", "variant")).startswith("ARRAY"), _list(v, "$.input")).otherwise(items)
        messages = F.flatten(F.transform(items, each))
        if form == "messages":
            texts = F.filter(_parts(_list(v, "$.system"), ("text",), ()), lambda p: p["text"] != "")
            messages = F.concat(F.transform(texts, lambda p: _struct(MESSAGE, role=F.lit("system"), content=p["text"])), messages)
        names = {"messages": ("$.name", "$.description", "$.input_schema"), "responses": ("$.name", "$.description", "$.parameters"), "completions": ("$.function.name", "$.function.description", "$.function.parameters")}[form]

        def tool(t: Column) -> Column:
            inner = ("$.function.name", "$.function.description", "$.function.parameters")
            name, told = (F.coalesce(_get(t, a), _get(t, b)) for a, b in zip(names[:2], inner[:2], strict=True))
            return _struct(TOOL, name=name, description=told, parameters=F.coalesce(_get(t, names[2], "variant"), _get(t, inner[2], "variant")))

        tools = F.when(_kind(_get(v, "$.tools", "variant")).startswith("ARRAY"), F.transform(_list(v, "$.tools"), tool))
        kind = F.coalesce(_get(v, "$.tool_choice.type"), _get(v, "$.tool_choice"))
        choice = F.coalesce(_get(v, "$.tool_choice.name"), _get(v, "$.tool_choice.function.name"))
        told = F.when(kind == "auto", "auto").when(kind.isin("any", "required"), "required").when(kind.isin("tool", "function") & choice.isNotNull(), "function")
        stops = [_get(v, "$.stop_sequences", "variant"), _get(v, "$.stop", "variant")]
        stop = {"messages": stops[0], "responses": F.coalesce(*stops), "completions": stops[1]}[form]
        stop = _bound(stop, lambda s: F.when(_kind(s) == "STRING", F.array(_get(s, "$"))).when(_kind(s).startswith("ARRAY"), _get(s, "$", "array<string>")))
        most = {"messages": _get(v, "$.max_tokens", "long"), "completions": _get(v, "$.max_tokens", "long")}.get(form, F.coalesce(_get(v, "$.max_output_tokens", "long"), _get(v, "$.max_tokens", "long")))
        return F.struct(
            _get(v, "$.model").alias("model"), most.alias("max_tokens"), _get(v, "$.temperature", "double").alias("temperature"), _get(v, "$.top_p", "double").alias("top_p"),
            stop.alias("stop"), messages.alias("messages"), F.coalesce(_get(v, "$.stream", "boolean"), F.lit(False)).alias("stream"), tools.alias("tools"),
            F.when(told.isNotNull(), F.struct(told.alias("type"), F.when(told == "function", choice).alias("name"))).alias("tool_choice"),
        )

    return _bound(F.try_parse_json(body), lambda v: F.when(_kind(v).startswith("OBJECT"), read(v)))


# -- requests: out of the common shape ----------------------------------------------------------------------------------


def _block_of(p: Column) -> Column:
    pattern = r"(?s)^data:([^;]+);base64,(.*)$"
    inline = p["url"].rlike(pattern)
    source = F.struct(
        F.when(inline, "base64").otherwise("url").alias("type"), F.when(~inline, p["url"]).alias("url"),
        F.when(inline, F.regexp_extract(p["url"], pattern, 1)).alias("media_type"), F.when(inline, F.regexp_extract(p["url"], pattern, 2)).alias("data"),
    )
    return F.when(p["type"] == "text", _struct(BLOCK, type=F.lit("text"), text=p["text"])).otherwise(_struct(BLOCK, type=F.lit("image"), source=source))


def _calls(m: Column) -> Column:
    return F.coalesce(m["calls"], _no(CALL))


def _parts_of(m: Column) -> Column:
    """A user message's parts, a plain text as one."""
    return F.when(m["content"].isNotNull(), F.array(_struct(PART, type=F.lit("text"), text=m["content"]))).otherwise(F.coalesce(m["parts"], _no(PART)))


def _to_messages(r: Column) -> Column:
    def blocks(m: Column) -> Column:
        text = F.when(m["content"] != "", F.array(_struct(BLOCK, type=F.lit("text"), text=m["content"]))).otherwise(_no(BLOCK))
        uses = F.transform(_calls(m), lambda c: _struct(BLOCK, type=F.lit("tool_use"), id=c["id"], name=c["name"], input=_variant(c["arguments"])))
        result = F.array(_struct(BLOCK, type=F.lit("tool_result"), tool_use_id=m["call_id"], content=m["content"]))
        return F.when(m["role"] == "user", F.transform(_parts_of(m), _block_of)).when(m["role"] == "assistant", F.concat(text, uses)).otherwise(result)

    system = F.filter(r["messages"], lambda m: (m["role"] == "system") & (m["content"] != ""))
    turns = F.transform(F.filter(r["messages"], lambda m: m["role"] != "system"), lambda m: F.struct(F.when(m["role"] == "assistant", "assistant").otherwise("user").alias("role"), blocks(m).alias("content")))
    turns = F.filter(turns, lambda t: F.size(t["content"]) > 0)

    def marked(block: Column, at: Column) -> Column:
        mark = F.when(at < CACHED_PARTS, F.struct(F.lit("ephemeral").alias("type")))
        return block.withField("cache_control", mark)

    def written(x: Column) -> Column:
        n = F.size(x["system"])

        def turn(t: Column, i: Column) -> Column:
            # A turn has a part at least, so only those before the first few turns need counting.
            before = F.when(i < CACHED_PARTS, n + F.aggregate(F.slice(x["turns"], F.lit(1), F.least(i, F.lit(CACHED_PARTS))), F.lit(0), lambda a, y: a + F.size(y["content"]))).otherwise(CACHED_PARTS)
            return F.struct(t["role"].alias("role"), F.transform(t["content"], lambda b, k: marked(b, before + k)).alias("content"))

        parts = n + F.aggregate(F.slice(x["turns"], F.lit(1), F.lit(CACHED_PARTS)), F.lit(0), lambda a, y: a + F.size(y["content"]))
        told = F.transform(x["system"], lambda m, k: marked(F.struct(F.lit("text").alias("type"), m["content"].alias("text")), k))
        tools = F.transform(r["tools"], lambda t, k: marked(F.struct(t["name"].alias("name"), t["description"].alias("description"), t["parameters"].alias("input_schema")), parts + k))
        choice = r["tool_choice"]["type"]
        kind = F.when(choice == "auto", "auto").when(choice == "required", "any").when(choice == "function", "tool")
        return F.to_json(
            F.struct(
                F.coalesce(r["max_tokens"], F.lit(MOST_TOKENS)).alias("max_tokens"), r["temperature"].alias("temperature"), r["top_p"].alias("top_p"), F.when(n > 0, told).alias("system"),
                F.transform(x["turns"], turn).alias("messages"), r["stream"].alias("stream"), tools.alias("tools"), F.when(kind.isNotNull(), F.struct(kind.alias("type"), r["tool_choice"]["name"].alias("name"))).alias("tool_choice"),
                r["stop"].alias("stop_sequences"),
            )
        )

    return _bound(F.struct(system.alias("system"), turns.alias("turns")), written)


def _function_choice(r: Column) -> Column:
    """The choice of a tool as a variant: a word, or an object."""
    choice = r["tool_choice"]
    named = F.try_parse_json(F.to_json(F.struct(F.lit("function").alias("type"), F.struct(choice["name"].alias("name")).alias("function"))))
    return F.when(choice["type"].isin("auto", "required"), choice["type"].cast("variant")).when(choice["type"] == "function", named)


def _to_responses(r: Column) -> Column:
    def part(p: Column) -> Column:
        return F.struct(
            F.when(p["type"] == "text", "input_text").otherwise("input_image").alias("type"), p["text"].alias("text"), F.when(p["type"] != "text", F.struct(p["url"].alias("url"))).alias("image_url")
        )

    def content(parts: Column) -> Column:
        return F.try_parse_json(F.to_json(parts))

    def items(m: Column) -> Column:
        said = F.array(F.struct(F.lit("output_text").alias("type"), m["content"].alias("text")))
        text = F.when(m["content"] != "", F.array(_struct(ITEM, role=F.lit("assistant"), content=content(said)))).otherwise(_no(ITEM))
        calls = F.transform(_calls(m), lambda c: _struct(ITEM, type=F.lit("function_call"), call_id=c["id"], name=c["name"], arguments=c["arguments"]))
        user = F.when(F.size(_parts_of(m)) > 0, F.array(_struct(ITEM, role=F.lit("user"), content=content(F.transform(_parts_of(m), part))))).otherwise(_no(ITEM))
        return (
            F.when(m["role"] == "system", F.array(_struct(ITEM, role=m["role"], content=m["content"].cast("variant"))))
            .when(m["role"] == "user", user)
            .when(m["role"] == "assistant", F.concat(text, calls))
            .otherwise(F.array(_struct(ITEM, type=F.lit("function_call_output"), call_id=m["call_id"], output=m["content"])))
        )

    tools = F.transform(r["tools"], lambda t: F.struct(F.lit("function").alias("type"), t["name"].alias("name"), t["description"].alias("description"), t["parameters"].alias("parameters")))
    return F.to_json(
        F.struct(
            r["model"].alias("model"), F.flatten(F.transform(r["messages"], items)).alias("input"), r["max_tokens"].alias("max_output_tokens"), r["top_p"].alias("top_p"), r["stop"].alias("stop_sequences"),
            r["stream"].alias("stream"), tools.alias("tools"), _function_choice(r).alias("tool_choice"), F.struct(F.lit(VERBOSITY).alias("verbosity")).alias("text"), F.struct(F.lit(EFFORT).alias("effort")).alias("reasoning"),
        )
    )


def _function_calls(calls: Column) -> Column:
    return F.transform(calls, lambda c: F.struct(c["id"].alias("id"), F.lit("function").alias("type"), F.struct(c["name"].alias("name"), c["arguments"].alias("arguments")).alias("function")))


def _to_completions(r: Column) -> Column:
    def part(p: Column) -> Column:
        return F.struct(p["type"].alias("type"), p["text"].alias("text"), F.when(p["type"] != "text", F.struct(p["url"].alias("url"))).alias("image_url"))

    def message(m: Column) -> Column:
        content = F.when(m["content"].isNotNull(), m["content"].cast("variant")).otherwise(F.try_parse_json(F.to_json(F.transform(m["parts"], part))))
        return F.struct(m["role"].alias("role"), content.alias("content"), m["call_id"].alias("tool_call_id"), _function_calls(m["calls"]).alias("tool_calls"))

    tools = F.transform(r["tools"], lambda t: F.struct(F.lit("function").alias("type"), F.struct(t["name"].alias("name"), t["description"].alias("description"), t["parameters"].alias("parameters")).alias("function")))
    stop = F.when(F.size(r["stop"]) == 1, r["stop"][0].cast("variant")).otherwise(F.try_parse_json(F.to_json(r["stop"])))
    return F.to_json(
        F.struct(
            r["model"].alias("model"), r["max_tokens"].alias("max_tokens"), r["temperature"].alias("temperature"), r["top_p"].alias("top_p"), stop.alias("stop"),
            F.transform(r["messages"], message).alias("messages"), r["stream"].alias("stream"), tools.alias("tools"), _function_choice(r).alias("tool_choice"),
        )
    )


def write_request(request: Column, form: str) -> Column:
    """A request of the common shape as a body in a format."""
    writer = {"messages": _to_messages, "responses": _to_responses, "completions": _to_completions}[form]
    return _bound(request, lambda r: F.when(r.isNotNull(), writer(r)))


def convert_request(body: Column, source: str, target: str) -> Column:
    """A body of one format in another; the same format gives it back as it is."""
    return body if source == target else write_request(read_request(body, source), target)


# -- responses ----------------------------------------------------------------------------------------------------------


def _finish(reason: Column, form: str) -> Column:
    out = F.lit(None).cast("string")
    for name, own in FINISHES[form].items():
        out = F.when(reason.isin(*own), name).otherwise(out)
    return out


def _reason(finish: Column, form: str) -> Column:
    out = F.lit(None).cast("string")
    for name, own in FINISHES[form].items():
        out = F.when(finish == name, own[0]).otherwise(out)
    return out


def _usage(v: Column, path: str, form: str) -> Column:
    """struct(prompt, completion, total, cached), null where nothing is told."""
    prompt, completion, cached = {
        "messages": ("input_tokens", "output_tokens", "cache_read_input_tokens"),
        "responses": ("input_tokens", "output_tokens", "input_tokens_details.cached_tokens"),
        "completions": ("prompt_tokens", "completion_tokens", "prompt_tokens_details.cached_tokens"),
    }[form]
    a, b = _get(v, f"{path}.{prompt}", "long"), _get(v, f"{path}.{completion}", "long")
    total = _get(v, f"{path}.total_tokens", "long") if form == "completions" else a + b
    told = F.struct(a.alias("prompt"), b.alias("completion"), total.alias("total"), _get(v, f"{path}.{cached}", "long").alias("cached"))
    return F.when(_kind(_get(v, path, "variant")).startswith("OBJECT"), told)


def read_response(body: Column, form: str) -> Column:
    """An answer's body in a format as struct(id, model, content, calls, finish, usage)."""

    def made_id(given: Column, k: Column) -> Column:
        return F.coalesce(F.when(given != "", given), F.concat(F.lit("toolu_"), F.substring(F.md5(F.concat(body, k.cast("string"))), 1, 12)))

    def call(c: Column, k: Column, arguments: str) -> Column:
        return _struct(CALL, id=made_id(_text(c, "$.id"), k), name=_get(c, "$.name"), arguments=F.coalesce(_said(c, arguments), F.lit("{}")))

    def read(v: Column) -> Column:
        if form == "messages":
            texts = F.transform(_parts(_list(v, "$.content"), ("text",), ()), lambda p: p["text"])
            calls = F.transform(F.filter(_list(v, "$.content"), lambda b: _get(b, "$.type") == "tool_use"), lambda c, k: call(c, k, "$.input"))
            reason, usage, valid = _get(v, "$.stop_reason"), _usage(v, "$.usage", form), _get(v, "$.type") == "message"
        elif form == "responses":
            said = F.flatten(F.transform(F.filter(_list(v, "$.output"), lambda o: _get(o, "$.type") == "message"), lambda o: _list(o, "$.content")))
            texts = F.transform(_parts(said, ("output_text",), ()), lambda p: p["text"])
            calls = F.transform(F.filter(_list(v, "$.output"), lambda o: _get(o, "$.type") == "function_call"), lambda c, k: call(c, k, "$.arguments"))
            reason, usage, valid = _get(v, "$.stop_reason"), _usage(v, "$.usage", form), F.lit(True)
        else:
            first = _get(v, "$.choices[0].message", "variant")
            texts = F.array(F.coalesce(_text(first, "$.content"), F.lit("")))
            calls = F.coalesce(_calls_of(first), _no(CALL))
            reason, usage, valid = _get(v, "$.choices[0].finish_reason"), _usage(v, "$.usage", form), first.isNotNull()
        content = F.array_join(texts, "")
        given = F.regexp_replace(_text(v, "$.id"), f"^{ID_PREFIXES[form]}", ID_PREFIXES["completions"])
        answer_id = F.coalesce(given, F.concat(F.lit(ID_PREFIXES["completions"]), F.substring(F.md5(body), 1, 12)))
        return F.when(
            valid,
            F.struct(
                answer_id.alias("id"), _get(v, "$.model").alias("model"), F.when(content != "", content).alias("content"), F.when(F.size(calls) > 0, calls).alias("calls"),
                _finish(reason, form).alias("finish"), usage.alias("usage"),
            ),
        )

    v = F.try_parse_json(body)
    whole = F.coalesce(_get(v, "$.response", "variant"), v) if form == "responses" else v
    return _bound(whole, read)


def write_response(answer: Column, form: str, created: Column | None = None) -> Column:
    """An answer of the common shape as a body in a format; ``created`` is in seconds, by default now."""
    created = F.unix_timestamp() if created is None else created

    def write(r: Column) -> Column:
        u, calls = r["usage"], _calls(r)
        if form == "messages":
            text = F.when(r["content"].isNotNull() | (F.size(calls) == 0), F.array(_struct(BLOCK, type=F.lit("text"), text=F.coalesce(r["content"], F.lit(""))))).otherwise(_no(BLOCK))
            uses = F.transform(calls, lambda c: _struct(BLOCK, type=F.lit("tool_use"), id=c["id"], name=c["name"], input=_variant(c["arguments"])))
            usage = F.struct(u["prompt"].alias("input_tokens"), u["completion"].alias("output_tokens"), u["cached"].alias("cache_read_input_tokens"))
            own = [r["id"].alias("id"), F.lit("message").alias("type"), F.lit("assistant").alias("role"), F.concat(text, uses).alias("content"), r["model"].alias("model"), _reason(r["finish"], form).alias("stop_reason")]
        elif form == "responses":
            item = "struct<id: string, type: string, status: string, role: string, content: array<struct<type: string, text: string, annotations: array<string>, logprobs: array<string>>>, name: string, call_id: string, arguments: string>"
            said = F.array(F.struct(F.lit("output_text").alias("type"), r["content"].alias("text"), _no("string").alias("annotations"), _no("string").alias("logprobs")))
            message = _struct(item, id=F.concat(F.lit("msg_"), F.substring(F.md5(r["id"]), 1, 12)), type=F.lit("message"), status=F.lit("completed"), role=F.lit("assistant"), content=said)
            uses = F.transform(calls, lambda c: _struct(item, id=c["id"], type=F.lit("function_call"), name=c["name"], call_id=c["id"], arguments=c["arguments"]))
            output = F.concat(F.when(r["content"].isNotNull(), F.array(message)).otherwise(_no(item)), uses)
            cached = F.when(u["cached"] != 0, F.struct(u["cached"].alias("cached_tokens")))
            usage = F.struct(u["prompt"].alias("input_tokens"), u["completion"].alias("output_tokens"), u["total"].alias("total_tokens"), cached.alias("input_tokens_details"))
            own_id = F.regexp_replace(r["id"], f"^{ID_PREFIXES['completions']}", ID_PREFIXES[form])
            own = [own_id.alias("id"), F.lit("response").alias("object"), r["model"].alias("model"), output.alias("output"), _reason(r["finish"], form).alias("stop_reason")]
        else:
            message = F.struct(F.lit("assistant").alias("role"), r["content"].alias("content"), _function_calls(r["calls"]).alias("tool_calls"))
            choice = F.struct(F.lit(0).alias("index"), message.alias("message"), r["finish"].alias("finish_reason"))
            cached = F.when(u["cached"].isNotNull(), F.struct(u["cached"].alias("cached_tokens")))
            usage = F.struct(u["prompt"].alias("prompt_tokens"), u["completion"].alias("completion_tokens"), u["total"].alias("total_tokens"), cached.alias("prompt_tokens_details"))
            own = [r["id"].alias("id"), F.lit("chat.completion").alias("object"), created.alias("created"), r["model"].alias("model"), F.array(choice).alias("choices")]
        return F.when(r.isNotNull(), F.to_json(F.struct(*own, F.when(u.isNotNull(), usage).alias("usage"))))

    return _bound(answer, write)


def convert_response(body: Column, source: str, target: str, created: Column | None = None) -> Column:
    """An answer of one format in another; what cannot be read stays as it is."""
    return body if source == target else F.coalesce(write_response(read_response(body, source), target, created), body)


# -- chunks of a streamed answer ----------------------------------------------------------------------------------------

CHUNK_CALL = "struct<index: int, id: string, name: string, arguments: string>"


def read_chunk(chunk: Column, form: str) -> Column:
    """A chunk of a stream as struct(id, model, index, role, content, call, finish, usage, any); null where it cannot be read.

    ``any`` says whether it holds a part of an answer at all.
    """
    lines = F.split(chunk, "\n")
    line = {
        "messages": F.get(F.filter(lines, lambda x: x.startswith("data: ")), F.lit(0)),
        "responses": F.when(F.get(lines, F.lit(1)).startswith("data: "), F.get(lines, F.lit(1))),
        "completions": F.when(chunk.startswith("data: "), chunk),
    }[form]
    event = F.trim(F.replace(F.get(lines, F.lit(0)), F.lit("event: "), F.lit("")))

    def read(v: Column) -> Column:
        none = F.lit(None).cast("string")
        role, usage = none, _usage(v, "$.usage", form)
        if form == "messages":
            kind, block, delta = _get(v, "$.type"), _get(v, "$.content_block.type"), _get(v, "$.delta.type")
            starts, goes_on, ends = kind == "content_block_start", kind == "content_block_delta", kind == "message_delta"
            index = F.coalesce(_get(v, "$.index", "int"), F.lit(0))
            role = F.when(starts & (block == "text"), "assistant")
            content = F.when(starts & (block == "text"), "").when(goes_on & (delta == "text_delta"), _get(v, "$.delta.text"))
            call = F.when(starts & (block == "tool_use"), _struct(CHUNK_CALL, index=index, id=_get(v, "$.content_block.id"), name=_get(v, "$.content_block.name"), arguments=F.lit("")))
            call = call.when(goes_on & (delta == "input_json_delta"), _struct(CHUNK_CALL, index=index, arguments=_get(v, "$.delta.partial_json")))
            finish, end = F.when(ends, _finish(_get(v, "$.delta.stop_reason"), form)), ends
            index = F.when(ends, 0).otherwise(index)
            own_id, model = F.coalesce(_get(v, "$.id"), _get(v, "$.message.id")), F.coalesce(_get(v, "$.model"), _get(v, "$.message.model"))
        elif form == "responses":
            said = F.coalesce(_text(v, "$.delta"), _text(v, "$.text"), _text(v, "$.output_text_delta"))
            content = F.when((event == "response.output_text.delta") & (said != ""), said)
            name, more = _text(v, "$.item.name"), F.coalesce(_text(v, "$.delta"), _text(v, "$.arguments_delta"))
            begins = (event == "response.output_item.added") & (_get(v, "$.item.type") == "function_call") & (name != "")
            call = F.when(begins, _struct(CHUNK_CALL, index=F.lit(0), id=_get(v, "$.item.id"), name=name, arguments=F.lit("")))
            call = call.when((event == "response.function_call_arguments.delta") & (more != ""), _struct(CHUNK_CALL, index=F.lit(0), arguments=more))
            end, index = event == "response.completed", F.lit(0)
            finish = F.when(end, _finish(F.coalesce(_get(v, "$.response.stop_reason"), _get(v, "$.stop_reason")), form))
            usage = F.when(end, _usage(v, "$.response.usage", form))
            own_id, model = F.coalesce(_get(v, "$.response.id"), _get(v, "$.id")), F.coalesce(_get(v, "$.response.model"), _get(v, "$.model"))
        else:
            content = F.when(_text(v, "$.choices[0].delta.content") != "", _text(v, "$.choices[0].delta.content"))
            first = _get(v, "$.choices[0].delta.tool_calls[0]", "variant")
            call = F.when(first.isNotNull(), _struct(CHUNK_CALL, index=F.coalesce(_get(first, "$.index", "int"), F.lit(0)), id=_get(first, "$.id"), name=_get(first, "$.function.name"), arguments=_get(first, "$.function.arguments")))
            index, finish = F.coalesce(_get(v, "$.choices[0].index", "int"), F.lit(0)), _get(v, "$.choices[0].finish_reason")
            own_id, model, end = _get(v, "$.id"), _get(v, "$.model"), finish.isNotNull()
        parsed = F.struct(
            F.coalesce(own_id, F.lit("")).alias("id"), F.coalesce(model, F.lit("")).alias("model"), index.alias("index"), role.alias("role"), content.alias("content"), call.alias("call"),
            finish.alias("finish"), usage.alias("usage"), F.coalesce(content.isNotNull() | call.isNotNull() | end, F.lit(False)).alias("any"),
        )
        valid = _get(v, "$.choices[0].delta", "variant").isNotNull() if form == "completions" else _kind(v).startswith("OBJECT")
        return F.when(valid, parsed)

    return _bound(F.try_parse_json(F.substring(line, F.lit(7), F.length(line))), read)


def write_chunk(chunk: Column, form: str, created: Column | None = None) -> Column:
    """A chunk of the common shape in a format. One without a part of an answer gives what the format has for nothing."""
    created = F.unix_timestamp() if created is None else created

    def write(c: Column) -> Column:
        u, call = c["usage"], c["call"]
        if form == "messages":
            usage = F.when(u.isNotNull(), F.struct(u["prompt"].alias("input_tokens"), u["completion"].alias("output_tokens"), u["cached"].alias("cache_read_input_tokens")))
            named, more = call["name"].isNotNull(), call["name"].isNull() & (call["arguments"] != "")
            kind = F.when(c["finish"].isNotNull(), "message_delta").when(named, "content_block_start").when(more | (c["content"] != ""), "content_block_delta")
            text = F.try_parse_json(F.to_json(F.struct(F.lit("text_delta").alias("type"), c["content"].alias("text"))))
            part = F.try_parse_json(F.to_json(F.struct(F.lit("input_json_delta").alias("type"), call["arguments"].alias("partial_json"))))
            stop = F.try_parse_json(F.concat(F.lit('{"stop_reason":"'), _reason(c["finish"], form), F.lit('","stop_sequence":null}')))
            delta = F.when(c["finish"].isNotNull(), stop).when(more, part).when(~named | named.isNull(), F.when(c["content"] != "", text))
            block = F.when(named, F.struct(F.lit("tool_use").alias("type"), call["id"].alias("id"), call["name"].alias("name"), F.try_parse_json(F.lit("{}")).alias("input")))
            index = F.when(named | more, call["index"]).when(c["content"] != "", 0)
            return F.when(c["any"], F.to_json(F.struct(kind.alias("type"), index.alias("index"), delta.alias("delta"), block.alias("content_block"), usage.alias("usage")))).otherwise("{}")
        if form == "responses":
            def sent(event: str, data: Column) -> Column:
                return F.concat(F.lit(f"event: {event}\ndata: "), F.to_json(data))

            about = F.struct(c["id"].alias("id"), c["model"].alias("model"))
            text = F.struct(c["id"].alias("id"), F.lit("response.output_text.delta").alias("type"), c["content"].alias("delta"), about.alias("response"))
            item = F.struct(call["id"].alias("id"), F.lit("function_call").alias("type"), call["name"].alias("name"), call["id"].alias("call_id"), F.lit("").alias("arguments"))
            added = F.struct(F.lit("response.output_item.added").alias("type"), F.lit(0).alias("output_index"), item.alias("item"))
            more = F.struct(F.lit("response.function_call_arguments.delta").alias("type"), F.lit(0).alias("output_index"), call["arguments"].alias("delta"))
            cached = F.when(u["cached"] != 0, F.struct(u["cached"].alias("cached_tokens")))
            usage = F.when(u.isNotNull(), F.struct(u["prompt"].alias("input_tokens"), u["completion"].alias("output_tokens"), u["total"].alias("total_tokens"), cached.alias("input_tokens_details")))
            done = F.struct(c["id"].alias("id"), F.lit("response.completed").alias("type"), F.struct(c["id"].alias("id"), c["model"].alias("model"), usage.alias("usage")).alias("response"))
            return (
                F.when(c["content"] != "", sent("response.output_text.delta", text))
                .when(call["name"].isNotNull(), sent("response.output_item.added", added))
                .when(call["arguments"] != "", sent("response.function_call_arguments.delta", more))
                .when(c["finish"].isNotNull(), sent("response.completed", done))
                .otherwise("")
            )
        function = F.struct(call["name"].alias("name"), call["arguments"].alias("arguments"))
        calls = F.array(F.struct(call["index"].alias("index"), call["id"].alias("id"), F.when(call["name"].isNotNull(), "function").alias("type"), function.alias("function")))

        def choice(**delta: Column) -> Column:
            given = [delta.get(n, F.lit(None).cast(t)).alias(n) for n, t in (("role", "string"), ("content", "string"))]
            return F.struct(c["index"].alias("index"), F.struct(*given, F.when(delta.get("call", F.lit(False)), calls).alias("tool_calls")).alias("delta"), delta.get("finish", F.lit(None).cast("string")).alias("finish_reason"))

        choices = F.concat(
            F.when(c["role"].isNotNull(), F.array(choice(role=c["role"]))).otherwise(F.array()),
            F.when(c["content"] != "", F.array(choice(content=c["content"]))).otherwise(F.array()),
            F.when(call.isNotNull(), F.array(choice(call=F.lit(True)))).otherwise(F.array()),
            F.when(c["finish"].isNotNull(), F.array(choice(finish=c["finish"]))).otherwise(F.array()),
        )
        cached = F.when(u["cached"] != 0, F.struct(u["cached"].alias("cached_tokens")))
        usage = F.when(u.isNotNull(), F.struct(u["prompt"].alias("prompt_tokens"), u["completion"].alias("completion_tokens"), u["total"].alias("total_tokens"), cached.alias("prompt_tokens_details")))
        return F.concat(F.lit("data: "), F.to_json(F.struct(c["id"].alias("id"), F.lit("chat.completion.chunk").alias("object"), created.alias("created"), c["model"].alias("model"), choices.alias("choices"), usage.alias("usage"))))

    return _bound(chunk, lambda c: F.when(c.isNotNull(), write(c)))


def convert_chunk(chunk: Column, source: str, target: str, created: Column | None = None) -> Column:
    """A chunk of one format's stream in another; what cannot be read stays as it is."""
    return chunk if source == target else F.coalesce(write_chunk(read_chunk(chunk, source), target, created), chunk)
