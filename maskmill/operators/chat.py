"""Chat datasets: one message format to the other, rejects with a reason, and responses put together from stream chunks.

A request is parsed once, as a variant, and its messages, tools and reject reason come out of that one value as arrays: no branch
of the plan reads the table again, and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskmill.functions.columns import usage_normalize
from maskmill.functions.rules import DEFAULT, Policy

from .nested import redact_json

#: A chunk's data: what the two formats share.
CHUNK = "struct<choices:array<struct<delta:struct<content:string,tool_calls:array<struct<index:int,id:string,function:struct<name:string,arguments:string>>>>>>,usage:struct<prompt_tokens:bigint,input_tokens:bigint,completion_tokens:bigint,output_tokens:bigint,total_tokens:bigint>>"
_TEXT_PARTS, _IMAGE_PARTS = ["input_text", "output_text", "text"], ["input_image", "image_url"]
_ROLES = ["user", "assistant", "system", "developer"]
_CALLS, _RESULTS = ["function_call", "custom_tool_call"], ["function_call_output", "custom_tool_call_output"]


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _get(body: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(body, path, kind)


def _list(body: Column, path: str) -> Column:
    """The items at path; null if there is no list."""
    return _get(body, path, "array<variant>")


def _is(body: Column, path: str, kind: str) -> Column:
    """Whether what is at path is an OBJECT, ARRAY, STRING, BOOLEAN or VOID (null); nothing is none of them."""
    whole = {"OBJECT": "map<string,variant>", "ARRAY": "array<variant>"}
    if kind in whole:
        return _get(body, path, whole[kind]).isNotNull()
    return F.coalesce(F.schema_of_variant(F.try_variant_get(body, path, "variant")) == kind, F.lit(False))


def _missing(body: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(body, path, "variant").isNull(), F.lit(True))


def _absent(body: Column, path: str) -> Column:
    """Missing or null."""
    return _missing(body, path) | _is(body, path, "VOID")


def _text(body: Column, path: str) -> Column:
    """The text at path; null if it is none."""
    return F.when(_is(body, path, "STRING"), _get(body, path))


def _quoted(text: Column) -> Column:
    return F.to_json(text.cast("variant"))


def _none() -> Column:
    return F.lit(None).cast("string")


def _first(reasons: Column) -> Column:
    return F.get(F.filter(reasons, lambda x: x.isNotNull()), F.lit(0))


def parse(df: DataFrame, id_col: str, col: str) -> DataFrame:
    """(id, body): the payload as a variant, null where it is malformed."""
    return df.select(F.col(id_col).alias("id"), F.try_parse_json(col).alias("body"))


def request_items(parsed: DataFrame) -> DataFrame:
    """(id, pos, item) of the input lists."""
    return parsed.select("id", F.posexplode(_list(F.col("body"), "$.input")).alias("pos", "item"))


def _part(part: Column) -> Column:
    """struct<why, text, json> of a content part; text is null for an image."""
    text, kind = _text(part, "$.text"), F.coalesce(_get(part, "$.type"), F.lit(""))
    # the url counts where image_url is missing or empty
    open_ = _absent(part, "$.image_url") | F.coalesce(F.to_json(F.try_variant_get(part, "$.image_url", "variant")).isin('""', "{}", "[]", "0", "false"), F.lit(False))
    plain = F.coalesce(F.nullif(_text(part, "$.image_url"), F.lit("")), F.when(open_, F.nullif(_text(part, "$.url"), F.lit(""))))
    # an image's own object goes on as it is, else one is made of its url
    made = F.when(F.length(_text(part, "$.image_url.url")) > 0, F.to_json(F.try_variant_get(part, "$.image_url", "variant"))).when(
        open_ & (F.length(_text(part, "$.url.url")) > 0), F.to_json(F.try_variant_get(part, "$.url", "variant"))
    ).when(plain.isNotNull(), F.concat(F.lit('{"url":'), _quoted(plain), F.lit("}")))
    detail = F.when(_missing(part, "$.image_url.detail") & _missing(part, "$.url.detail"), F.nullif(_text(part, "$.detail"), F.lit("")))

    def judged(p: Column) -> Column:
        is_text, is_image = p["kind"].isin(_TEXT_PARTS), p["kind"].isin(_IMAGE_PARTS)
        why = (
            F.when(~_is(part, "$", "OBJECT"), "content item must be an object")
            .when(~is_text & ~is_image, "unsupported content item")
            .when(is_text & p["text"].isNull(), "text content requires text")
            .when(is_image & p["url"].isNull(), "image content requires image_url")
            .when(is_image & ~_absent(part, "$.detail") & ~_is(part, "$.detail", "STRING"), "image detail must be text")
        )
        url = F.when(p["detail"].isNull(), p["url"]).otherwise(F.concat(F.left(p["url"], F.length(p["url"]) - 1), F.lit(',"detail":'), _quoted(p["detail"]), F.lit("}")))
        json = F.when(is_text, F.concat(F.lit('{"type":"text","text":'), _quoted(p["text"]), F.lit("}"))).otherwise(F.concat(F.lit('{"type":"image_url","image_url":'), url, F.lit("}")))
        return F.struct(why.alias("why"), F.when(is_text, p["text"]).alias("text"), json.alias("json"))

    return _let(F.struct(kind.alias("kind"), text.alias("text"), made.alias("url"), detail.alias("detail")), judged)


def _content(item: Column) -> Column:
    """struct<why, content> of an item's content as chat content: text, or the text parts joined by newlines, or the JSON list of
    parts if any is an image, with its detail folded in."""

    def of_parts(parts: Column) -> Column:
        texts = F.filter(F.transform(parts, lambda p: p["text"]), lambda t: t.isNotNull())
        listed = F.concat(F.lit("["), F.array_join(F.transform(parts, lambda p: p["json"]), ","), F.lit("]"))
        joined = F.when(F.exists(parts, lambda p: p["text"].isNull()), listed).otherwise(F.array_join(texts, "\n"))
        why = (
            F.when(_missing(item, "$.content"), "message content is required")
            .when(_is(item, "$.content", "STRING"), None)
            .when(F.coalesce(F.size(parts), F.lit(0)) < 1, "content must be text or a non-empty list")
            .otherwise(_first(F.transform(parts, lambda p: p["why"])))
        )
        return F.struct(why.alias("why"), F.coalesce(_text(item, "$.content"), joined).alias("content"))

    return _let(F.transform(_list(item, "$.content"), _part), of_parts)


def content_to_chat(item: Column) -> Column:
    """An item's content as chat content."""
    return _content(item)["content"]


def item_type(item: Column) -> Column:
    return _get(item, "$.type")


def tool_name(item: Column) -> Column:
    return F.concat_ws("__", F.nullif(_get(item, "$.namespace"), F.lit("")), _get(item, "$.name"))


def _output(item: Column) -> Column:
    """struct<why, content> of a tool's output: text, or the text of its parts joined by newlines."""

    def of_parts(parts: Column) -> Column:
        why = (
            F.when(_absent(item, "$.output"), "tool output is required")
            .when(_is(item, "$.output", "STRING"), None)
            .when(F.coalesce(F.size(parts), F.lit(0)) < 1, "tool output must be text or a text list")
            .when(F.exists(parts, lambda t: t.isNull()), "unsupported tool output")
        )
        return F.struct(why.alias("why"), F.coalesce(_text(item, "$.output"), F.array_join(parts, "\n")).alias("content"))

    return _let(F.transform(_list(item, "$.output"), lambda p: F.when(_get(p, "$.type") == "input_text", _text(p, "$.text"))), of_parts)


def _message(item: Column) -> Column:
    """struct<why, role, content, tool_calls, tool_call_id>: an input item as a chat message, or why it is none."""
    kind = F.when(_missing(item, "$.type"), "message").otherwise(_text(item, "$.type"))
    call_id, name = _text(item, "$.call_id"), _text(item, "$.name")

    def shape(why: Column, role: Column | None = None, content: Column | None = None, calls: Column | None = None, call: Column | None = None) -> Column:
        values = {"role": role, "content": content, "tool_calls": calls, "tool_call_id": call}
        return F.struct(why.alias("why"), *((_none() if v is None else v).alias(k) for k, v in values.items()))

    def said(c: Column) -> Column:
        role = _text(item, "$.role")
        why = F.when(F.coalesce(F.length(role), F.lit(0)) == 0, "message role is required").when(~role.isin(_ROLES), "unsupported role").otherwise(c["why"])
        return shape(why, role, c["content"])

    def called(arguments: Column) -> Column:
        why = (
            F.when(F.coalesce(F.length(call_id), F.lit(0)) == 0, "call_id is required")
            .when(F.coalesce(F.length(name), F.lit(0)) == 0, "tool call requires name")
            .when(~_absent(item, "$.namespace") & ~_is(item, "$.namespace", "STRING"), "namespace must be text")
            .when(arguments.isNull(), "arguments must be text")
        )
        call = F.to_json(F.array(F.struct(call_id.alias("id"), F.lit("function").alias("type"), F.struct(tool_name(item).alias("name"), arguments.alias("arguments")).alias("function"))))
        return shape(why, F.lit("assistant"), None, call)

    def answered(c: Column) -> Column:
        return shape(F.when(F.coalesce(F.length(call_id), F.lit(0)) == 0, "call_id is required").otherwise(c["why"]), F.lit("tool"), c["content"], None, call_id)

    def of_kind(k: Column) -> Column:
        arguments = F.when(k == "function_call", _text(item, "$.arguments")).otherwise(_text(item, "$.input"))
        odd = F.when(~_is(item, "$", "OBJECT"), "input item must be an object").when(k.isNull(), "item type must be text").otherwise("unsupported item type")
        return (
            F.when(~_is(item, "$", "OBJECT"), shape(odd)).when(k == "message", _let(_content(item), said)).when(k.isin(_CALLS), _let(arguments, called))
            .when(k.isin(_RESULTS), _let(_output(item), answered)).otherwise(shape(odd))
        )

    return _let(kind, of_kind)


def tool_items(items: DataFrame) -> DataFrame:
    """(id, pos, role, content, tool_calls, tool_call_id) of tool calls and tool outputs."""
    tools = items.where(item_type(F.col("item")).isin(_CALLS + _RESULTS))
    return tools.select("id", "pos", _message(F.col("item")).alias("m")).select("id", "pos", "m.role", "m.content", "m.tool_calls", "m.tool_call_id")


def _tool(tool: Column, namespace: Column) -> Column:
    """struct<why, name, description, parameters, strict> of a function tool."""
    why = (
        F.when(F.coalesce(F.length(_text(tool, "$.name")), F.lit(0)) == 0, "function tool requires name")
        .when(~_absent(tool, "$.description") & ~_is(tool, "$.description", "STRING"), "description must be text")
        .when(~_is(tool, "$.parameters", "OBJECT"), "parameters must be an object")
        .when(~_absent(tool, "$.strict") & ~_is(tool, "$.strict", "BOOLEAN"), "strict must be boolean")
    )
    return F.struct(
        why.alias("why"), F.concat_ws("__", namespace, _get(tool, "$.name")).alias("name"), F.coalesce(_get(tool, "$.description"), F.lit("")).alias("description"),
        F.to_json(F.try_variant_get(tool, "$.parameters", "variant")).alias("parameters"), _get(tool, "$.strict", "boolean").alias("strict"),
    )


def _bad_tool(why: str) -> Column:
    none = _none()
    return F.struct(F.lit(why).alias("why"), none.alias("name"), none.alias("description"), none.alias("parameters"), F.lit(None).cast("boolean").alias("strict"))


def _tools(body: Column) -> Column:
    """array<struct<why, name, description, parameters, strict>> of the payload's tools, those of a namespace one by one."""

    def of_one(tool: Column) -> Column:
        namespace, kind = _text(tool, "$.name"), _text(tool, "$.type")

        def inside(tools: Column) -> Column:
            each = F.transform(tools, lambda t: F.when(F.coalesce(_get(t, "$.type") == "function", F.lit(False)), _tool(t, namespace)).otherwise(_bad_tool("namespace supports only function tools")))
            return F.when(F.coalesce(F.length(namespace), F.lit(0)) == 0, F.array(_bad_tool("namespace requires name"))).when(F.coalesce(F.size(tools), F.lit(0)) < 1, F.array(_bad_tool("namespace requires tools"))).otherwise(each)

        return F.when(kind == "function", F.array(_tool(tool, _none()))).when(kind == "namespace", _let(_list(tool, "$.tools"), inside)).otherwise(F.array(_bad_tool("unsupported tool type")))

    return F.flatten(F.transform(_list(body, "$.tools"), of_one))


def conversions(df: DataFrame, id_col: str, col: str) -> DataFrame:
    """(id, reject_reason, messages, tools) of each payload: messages (pos, role, content, tool_calls, tool_call_id), instructions
    first at pos -1; tools (pos, name, description, parameters, strict). A payload that cannot be converted has the first reason found, in the
    order instructions, input, tools, and null messages and tools; a null payload is malformed."""
    body = F.col("body")
    found = parse(df, id_col, col).select("id", "body", F.transform(_list(body, "$.input"), _message).alias("items"), _tools(body).alias("tools"))
    why = (
        F.when(body.isNull(), "malformed JSON")
        .when(~_absent(body, "$.instructions") & ~_is(body, "$.instructions", "STRING"), "instructions must be text")
        .when(~_is(body, "$.input", "STRING") & F.col("items").isNull(), "input must be text or a list")
        .when(F.size("items") == 0, "input list cannot be empty")
        .otherwise(F.coalesce(_first(F.transform("items", lambda m: m["why"])), F.when(~_missing(body, "$.tools") & ~_is(body, "$.tools", "ARRAY"), "tools must be a list"), _first(F.transform("tools", lambda t: t["why"]))))
    )
    one = lambda pos, role, content: F.struct(F.lit(pos).alias("pos"), F.lit(role).alias("role"), content.alias("content"), _none().alias("tool_calls"), _none().alias("tool_call_id"))
    system, plain = F.array(one(-1, "system", _text(body, "$.instructions"))), F.array(one(0, "user", _text(body, "$.input")))
    said = F.transform("items", lambda m, i: F.struct(i.alias("pos"), m["role"].alias("role"), m["content"].alias("content"), m["tool_calls"].alias("tool_calls"), m["tool_call_id"].alias("tool_call_id")))
    messages = F.concat(F.filter(system, lambda m: F.length(m["content"]) > 0), F.coalesce(said, plain))
    tools = F.transform("tools", lambda t, i: F.struct(i.alias("pos"), *(t[c].alias(c) for c in ("name", "description", "parameters", "strict"))))
    judged = found.select("id", why.alias("reject_reason"), messages.alias("messages"), tools.alias("tools"))
    good = F.col("reject_reason").isNull()
    return judged.select("id", "reject_reason", F.when(good, F.col("messages")).alias("messages"), F.when(good, F.col("tools")).alias("tools"))


def conversion_rejects(df: DataFrame, id_col: str, col: str) -> DataFrame:
    """(id, reject_reason): each payload that cannot be converted, with the first reason found."""
    return _rows(conversions(df, id_col, col).select("id", F.array(F.struct("reject_reason")).alias("why")), "why", "reject_reason")


def responses_to_chat(df: DataFrame, id_col: str, col: str) -> DataFrame:
    """(id, pos, role, content, tool_calls, tool_call_id): the messages of each payload that converts, instructions first."""
    return _rows(conversions(df, id_col, col), "messages", "role")


def _rows(df: DataFrame, col: str, must: str) -> DataFrame:
    """id and the fields of the structs in col, where must is not null. The outer form: from the inner one, as from a filter below
    it, Spark would infer filters that evaluate the whole expression of col again."""
    return df.select("id", F.inline_outer(col)).where(F.col(must).isNotNull())


def tools_to_chat(df: DataFrame, id_col: str, col: str) -> DataFrame:
    """(id, pos, name, description, parameters, strict) of the function tools, flat and namespaced (namespace__name). Tools that
    cannot be converted are left out here; conversion_rejects has their payload."""
    good = parse(df, id_col, col).select("id", F.filter(_tools(F.col("body")), lambda t: t["why"].isNull()).alias("tools"))
    return _rows(good.select("id", F.transform("tools", lambda t, i: F.struct(i.alias("pos"), *(t[c].alias(c) for c in ("name", "description", "parameters", "strict")))).alias("tools")), "tools", "pos")


def chat_params(df: DataFrame, id_col: str, col: str) -> DataFrame:
    """(id, model, stream, tool_choice, parallel_tool_calls, temperature, top_p, max_tokens, response_format, stream_options) of
    each payload; what it does not hold is null."""
    body = F.col("body")
    stream = F.coalesce(_get(body, "$.stream", "boolean"), F.lit(False))
    choice = _get(body, "$.tool_choice")
    form = "$.text.format"
    schema = F.coalesce(F.to_json(F.try_variant_get(body, f"{form}.schema", "variant")), F.lit("{}"))
    wrapped = F.concat(
        F.lit('{"type":"json_schema","json_schema":{"name":'), F.to_json(F.coalesce(F.nullif(_get(body, f"{form}.name"), F.lit("")), F.lit("response")).cast("variant")),
        F.lit(',"schema":'), schema, F.lit(',"strict":'), F.coalesce(_get(body, f"{form}.strict", "boolean"), F.lit(False)).cast("string"), F.lit("}}"),
    )
    return parse(df, id_col, col).where("body IS NOT NULL").select(
        "id", _get(body, "$.model").alias("model"), stream.alias("stream"), F.when(choice.isin("auto", "none", "required"), choice).alias("tool_choice"),
        _get(body, "$.parallel_tool_calls", "boolean").alias("parallel_tool_calls"), _get(body, "$.temperature", "double").alias("temperature"), _get(body, "$.top_p", "double").alias("top_p"),
        _get(body, "$.max_output_tokens", "bigint").alias("max_tokens"), F.when(_get(body, f"{form}.type") == "json_schema", wrapped).alias("response_format"),
        F.when(stream, F.lit('{"include_usage":true}')).alias("stream_options"),
    )


def chat_to_responses(df: DataFrame, id_col: str, col: str) -> DataFrame:
    """(id, response_id, pos, type, text, call_id, name, arguments, input_tokens, output_tokens, total_tokens): the output items of
    chat responses, message first, then tool calls. A response without any has one row with a null type. Ids come from the payload's
    id, else from the row's."""
    parsed = parse(df, id_col, col).where("body IS NOT NULL")
    body = F.col("body")
    key = F.coalesce(F.nullif(_get(body, "$.id"), F.lit("")), F.col("id").cast("string"))
    usage = F.from_json(F.to_json(F.try_variant_get(body, "$.usage", "variant")), "struct<prompt_tokens:bigint,input_tokens:bigint,completion_tokens:bigint,output_tokens:bigint,total_tokens:bigint>")
    message = "$.choices[0].message"
    calls = F.from_json(F.to_json(F.try_variant_get(body, f"{message}.tool_calls", "variant")), "array<struct<id:string,function:struct<name:string,arguments:string>>>")
    text = F.nullif(_get(body, f"{message}.content"), F.lit(""))
    base = parsed.select("id", F.concat(F.lit("resp_"), key).alias("response_id"), key.alias("key"), text.alias("text"), calls.alias("calls"), usage_normalize(usage).alias("u"))
    none = F.lit(None).cast("string")
    said = F.struct(F.lit("message").alias("type"), F.col("text").alias("text"), none.alias("call_id"), none.alias("name"), none.alias("arguments"))
    made = F.transform(
        F.coalesce("calls", F.array().cast("array<struct<id:string,function:struct<name:string,arguments:string>>>")),
        lambda c, i: F.struct(
            F.lit("function_call").alias("type"), none.alias("text"), F.coalesce(F.nullif(c["id"], F.lit("")), F.concat(F.lit("call_"), F.col("key"), F.lit("_"), i.cast("string"))).alias("call_id"),
            F.coalesce(F.nullif(c["function"]["name"], F.lit("")), F.lit("tool")).alias("name"), F.coalesce(F.nullif(c["function"]["arguments"], F.lit("")), F.lit("{}")).alias("arguments"),
        ),
    )
    items = F.concat(F.when(F.col("text").isNotNull(), F.array(said)).otherwise(F.slice(F.array(said), 1, 0)), made)
    return base.select("id", "response_id", "u", F.posexplode_outer(items).alias("pos", "item")).select("id", "response_id", "pos", "item.*", "u.*")


def safe_responses_to_chat(df: DataFrame, id_col: str, col: str, policy: Policy = DEFAULT) -> DataFrame:
    """Redact, then convert: no message holds what the rules find."""
    return responses_to_chat(redact_json(df, col, policy), id_col, col)


def _joined_bytes(df: DataFrame, id_col: str, seq: str, chunk: str) -> DataFrame:
    """(id, t): each response's text. Bytes are joined before they are decoded, so characters and line ends may be split over chunks."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.hex(F.col(chunk).cast("binary")).alias("h"))))
    raw = df.groupBy(F.col(id_col).alias("id")).agg(F.unhex(F.array_join(F.transform(ordered, lambda x: x["h"]), "")).alias("raw"))
    return raw.select("id", F.regexp_replace(F.make_valid_utf8(F.col("raw").cast("string")), r"\r\n|\r", "\n").alias("t"))


def _calls(deltas: Column, key: Column) -> Column:
    """array<struct<index, call_id, name, arguments>> of tool-call deltas in order, calls by first appearance. A delta without an index
    begins the next call: its index is how many there are so far. Names and arguments are joined, the last id that is not empty counts."""
    seen = lambda acc: acc["seen"]

    def step(acc: Column, delta: Column) -> Column:
        return _let(F.coalesce(delta["index"], F.size(seen(acc))), lambda i: F.struct(F.array_union(seen(acc), F.array(i)).alias("seen"), F.array_append(acc["at"], i).alias("at")))

    none = F.array().cast("array<int>")
    placed = F.aggregate(deltas, F.struct(none.alias("seen"), none.alias("at")), step)

    def merge(p: Column) -> Column:
        rows = F.zip_with(p["at"], deltas, lambda i, d: F.struct(i.alias("i"), d.alias("d")))

        def one(index: Column) -> Column:
            own = F.filter(rows, lambda r: r["i"] == index)
            ids = F.filter(F.transform(own, lambda r: r["d"]["id"]), lambda x: F.length(x) > 0)
            text = lambda f: F.array_join(F.transform(own, lambda r: F.coalesce(r["d"]["function"][f], F.lit(""))), "")
            named = F.coalesce(F.try_element_at(ids, F.lit(-1)), F.concat(F.lit("call_"), key.cast("string"), F.lit("_"), index.cast("string")))
            return F.struct(index.alias("index"), named.alias("call_id"), text("name").alias("name"), text("arguments").alias("arguments"))

        return F.transform(seen(p), one)

    return _let(placed, merge)


def assembled(df: DataFrame, id_col: str = "response_id", seq: str = "seq", chunk: str = "chunk") -> DataFrame:
    """(id, complete, deltas, calls, usage) of each response: its text deltas, tool calls and last usage. complete: whether [DONE] came;
    what follows it is left out. One aggregate by response; a response is one group, whose size is that of one answer. Null
    chunks and events that are no JSON hold nothing."""
    blocks = F.split("t", r"\n\n+")
    lines = lambda b: F.filter(F.split(b, "\n"), lambda x: x.startswith("data:"))
    data = F.transform(blocks, lambda b: F.array_join(F.transform(lines(b), lambda x: F.regexp_replace(x, r"^data:(?U)\s*", "")), "\n"))
    events = _joined_bytes(df, id_col, seq, chunk).select("id", data.alias("data"), F.array_position(data, "[DONE]").alias("end"))
    kept = F.when(F.col("end") > 0, F.slice("data", F.lit(1), F.greatest(F.col("end") - 1, F.lit(0)).cast("int"))).otherwise(F.col("data"))
    parsed = events.select("id", (F.coalesce("end", F.lit(0)) > 0).alias("complete"), F.transform(F.filter(kept, lambda x: x != ""), lambda x: F.from_json(x, CHUNK)).alias("d"))
    full = lambda a: F.filter(a, lambda x: x.isNotNull())
    flat = lambda a: F.coalesce(F.flatten(full(a)), F.array())
    said = parsed.select("id", "complete", flat(F.transform("d", lambda d: F.transform(d["choices"], lambda c: c["delta"]))).alias("said"), F.try_element_at(full(F.transform("d", lambda d: d["usage"])), F.lit(-1)).alias("u"))
    texts = F.filter(F.transform("said", lambda x: x["content"]), lambda x: F.length(x) > 0)
    calls = said.select("id", "complete", texts.alias("deltas"), full(flat(F.transform("said", lambda x: x["tool_calls"]))).alias("parts"), usage_normalize(F.col("u")).alias("usage"))
    return calls.select("id", "complete", F.coalesce("deltas", F.array().cast("array<string>")).alias("deltas"), _calls(F.col("parts"), F.col("id")).alias("calls"), "usage")


def merge_tool_calls(made: DataFrame) -> DataFrame:
    """(id, index, call_id, name, arguments): the tool calls of assembled responses, a row each."""
    return made.select("id", F.inline("calls"))


def call_list(calls: Column) -> Column:
    """Tool calls as JSON; null if there are none."""
    each = F.transform(calls, lambda c: F.struct(c["call_id"].alias("call_id"), c["name"].alias("name"), c["arguments"].alias("arguments")))
    return F.when(F.size(calls) > 0, F.to_json(each))


def assemble_chunks(df: DataFrame, id_col: str = "response_id", seq: str = "seq", chunk: str = "chunk") -> DataFrame:
    """(id, text, tool_calls, input_tokens, output_tokens, total_tokens) of each response; the last usage counts. A response whose
    chunks hold no event has empty text; null chunks hold nothing."""
    made = assembled(df, id_col, seq, chunk)
    return made.select("id", F.array_join("deltas", "").alias("text"), call_list(F.col("calls")).alias("tool_calls"), "usage.*")


def response_events(df: DataFrame, id_col: str = "response_id", seq: str = "seq", chunk: str = "chunk") -> DataFrame:
    """(id, n, type, text, item, response): created, item added, the deltas, items done (the message, then tool calls by first
    appearance), completed, in order. text: what the message holds so far or gains; item and response: JSON of the event's
    own. Ids come from the response's. Every stream is completed at its end, [DONE] or not."""
    key = F.col("id").cast("string")
    text = F.array_join("deltas", "")
    message = lambda t: F.concat(F.lit('{"type":"message","role":"assistant","id":'), _quoted(F.concat(F.lit("msg_"), key)), F.lit(',"content":[{"type":"output_text","text":'), _quoted(t), F.lit("}]}"))
    call = lambda c: F.to_json(F.struct(F.lit("function_call").alias("type"), c["call_id"].alias("call_id"), c["name"].alias("name"), c["arguments"].alias("arguments")))
    none, some = _none(), F.size("deltas") > 0

    def event(kind: str, said: Column = none, item: Column = none, response: Column = none) -> Column:
        return F.struct(F.lit(kind).alias("type"), said.alias("text"), item.alias("item"), response.alias("response"))

    zero = F.lit(0).cast("long")
    usage = F.col("usage")
    counted = F.to_json(
        F.struct(
            usage["input_tokens"].alias("input_tokens"), F.struct(zero.alias("cached_tokens")).alias("input_tokens_details"), usage["output_tokens"].alias("output_tokens"),
            F.struct(zero.alias("reasoning_tokens")).alias("output_tokens_details"), usage["total_tokens"].alias("total_tokens"),
        )
    )
    items = F.concat(F.filter(F.array(F.col("said")), lambda _x: some), F.transform("calls", call))
    head = F.concat(F.lit('{"id":'), _quoted(F.concat(F.lit("resp_"), key)), F.lit(',"status":'))
    done = F.concat(head, F.lit('"completed","output":['), F.array_join("items", ","), F.lit('],"usage":'), F.coalesce(F.when(usage.isNotNull(), counted), F.lit("null")), F.lit(',"end_turn":true}'))
    rows = assembled(df, id_col, seq, chunk).withColumn("text", text).withColumn("said", message(F.col("text"))).withColumn("items", items)
    if_some = lambda x: F.filter(F.array(x), lambda _x: some)
    whole = F.concat(
        F.array(event("response.created", response=F.concat(head, F.lit('"in_progress"}')))), if_some(event("response.output_item.added", F.lit(""), message(F.lit("")))),
        F.transform("deltas", lambda t: event("response.output_text.delta", t)), if_some(event("response.output_item.done", F.col("text"), F.col("said"))),
        F.transform("calls", lambda c: event("response.output_item.done", item=call(c))), F.array(event("response.completed", F.when(some, F.col("text")), response=done)),
    )
    return rows.select("id", F.posexplode(whole).alias("n", "e")).select("id", "n", "e.type", "e.text", "e.item", "e.response")
