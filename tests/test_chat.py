"""Chat conversions against a plain version, on payloads of every kind; responses out of chunks, in batch and as a stream."""

import json
import random
from collections import defaultdict

from pyspark.sql import functions as F

from maskmill.functions.pyrules import Redactor
from maskmill.functions.rules import DEFAULT, PLACEHOLDER
from maskmill.operators import chat
from maskmill.sources.derived import view

SECRET = "sk-ant-" + "a1" * 12
TEXT, IMAGE = ("input_text", "output_text", "text"), ("input_image", "image_url")


class Bad(Exception):
    pass


def need(ok, why):
    if not ok:
        raise Bad(why)


def filled(x):
    return isinstance(x, str) and x != ""


def plain_content(item):
    need("content" in item, "message content is required")
    content = item["content"]
    if isinstance(content, str):
        return content
    need(isinstance(content, list) and content, "content must be text or a non-empty list")
    out = []
    for p in content:
        need(isinstance(p, dict), "content item must be an object")
        need(p.get("type") in TEXT + IMAGE, "unsupported content item")
        if p["type"] in TEXT:
            need(isinstance(p.get("text"), str), "text content requires text")
            out.append({"type": "text", "text": p["text"]})
            continue
        given = p.get("image_url") or p.get("url")
        need(filled(given) or (isinstance(given, dict) and filled(given.get("url"))), "image content requires image_url")
        need(p.get("detail") is None or isinstance(p["detail"], str), "image detail must be text")
        image = {"url": given} if isinstance(given, str) else dict(given)
        if p.get("detail"):
            image.setdefault("detail", p["detail"])
        out.append({"type": "image_url", "image_url": image})
    return out if any(p["type"] == "image_url" for p in out) else "\n".join(p["text"] for p in out)


def plain_item(item):
    need(isinstance(item, dict), "input item must be an object")
    kind = item.get("type", "message")
    need(isinstance(kind, str), "item type must be text")
    if kind == "message":
        need(filled(item.get("role")), "message role is required")
        need(item["role"] in ("user", "assistant", "system", "developer"), "unsupported role")
        return item["role"], plain_content(item), None, None
    if kind in ("function_call", "custom_tool_call"):
        need(filled(item.get("call_id")), "call_id is required")
        need(filled(item.get("name")), "tool call requires name")
        space = item.get("namespace")
        need(space is None or isinstance(space, str), "namespace must be text")
        arguments = item.get("arguments" if kind == "function_call" else "input")
        need(isinstance(arguments, str), "arguments must be text")
        return "assistant", None, [{"id": item["call_id"], "type": "function", "function": {"name": f"{space}__{item['name']}" if space else item["name"], "arguments": arguments}}], None
    need(kind in ("function_call_output", "custom_tool_call_output"), "unsupported item type")
    need(filled(item.get("call_id")), "call_id is required")
    output = item.get("output")
    need(output is not None, "tool output is required")
    if not isinstance(output, str):
        need(isinstance(output, list) and output, "tool output must be text or a text list")
        need(all(isinstance(o, dict) and o.get("type") == "input_text" and isinstance(o.get("text"), str) for o in output), "unsupported tool output")
        output = "\n".join(o["text"] for o in output)
    return "tool", output, None, item["call_id"]


def plain_tool(tool, inside=False):
    if inside:
        need(isinstance(tool, dict) and tool.get("type") == "function", "namespace supports only function tools")
    elif isinstance(tool, dict) and tool.get("type") == "namespace":
        need(filled(tool.get("name")), "namespace requires name")
        need(isinstance(tool.get("tools"), list) and tool["tools"], "namespace requires tools")
        return [(f"{tool['name']}__{n}", *rest) for t in tool["tools"] for n, *rest in plain_tool(t, True)]
    else:
        need(isinstance(tool, dict) and tool.get("type") == "function", "unsupported tool type")
    need(filled(tool.get("name")), "function tool requires name")
    need(tool.get("description") is None or isinstance(tool["description"], str), "description must be text")
    need(isinstance(tool.get("parameters"), dict), "parameters must be an object")
    need(tool.get("strict") is None or isinstance(tool["strict"], bool), "strict must be boolean")
    return [(tool["name"], tool.get("description") or "", tool["parameters"], tool.get("strict"))]


def plain_conversion(body):
    """(messages, tools), or Bad."""
    try:
        payload = json.loads(body)
    except ValueError:
        raise Bad("malformed JSON") from None
    out, text = [], payload.get("instructions")
    need(text is None or isinstance(text, str), "instructions must be text")
    if text:
        out.append((-1, "system", text, None, None))
    given = payload.get("input")
    need(isinstance(given, (str, list)), "input must be text or a list")
    need(given != [], "input list cannot be empty")
    out += [(0, "user", given, None, None)] if isinstance(given, str) else [(i, *plain_item(x)) for i, x in enumerate(given)]
    tools = payload.get("tools", [])
    need(isinstance(tools, list), "tools must be a list")
    return out, [t for x in tools for t in plain_tool(x)]


def payloads(seed, n):
    """Mostly sound payloads, with one odd value here and there."""
    rng = random.Random(seed)
    odd = [None, 5, True, "", [], {}, "x", ["y"], {"z": 1}]

    def maybe(good, p=0.04):
        return rng.choice(odd) if rng.random() < p else good

    def obj(**fields):
        return {k: maybe(v) for k, v in fields.items() if rng.random() > 0.02}

    def part():
        if rng.random() < 0.7:
            return maybe(obj(type=rng.choice(TEXT), text=rng.choice(["see", "é\n\"q\"", f"my {SECRET}", ""])), 0.02)
        url = rng.choice(["http://i/1", {"url": "http://i/2", "detail": "high"}, {"url": "http://i/3", "x": [1]}])
        return obj(type=rng.choice(IMAGE), detail=rng.choice(["low", None, ""]), **{rng.choice(["image_url", "url"]): url})

    def item():
        kind = rng.random()
        if kind < 0.6:
            return maybe(obj(role=rng.choice(["user", "assistant", "developer", "system"]), content=rng.choice(["hi", f"a {SECRET}", [part() for _ in range(rng.randint(1, 3))]]), **({"type": "message"} if rng.random() < 0.5 else {})), 0.02)
        if kind < 0.8:
            return obj(type=rng.choice(["function_call", "custom_tool_call"]), call_id="c1", name="f", namespace=rng.choice(["n", None, ""]), arguments='{"a":1}', input="raw")
        return obj(type=rng.choice(["function_call_output", "custom_tool_call_output", "other"] if rng.random() < 0.1 else ["function_call_output"]), call_id="c1", output=rng.choice(["done", [{"type": "input_text", "text": "o1"}, maybe({"type": "input_text", "text": "o2"})]]))

    def tool(inside=False):
        if not inside and rng.random() < 0.3:
            return obj(type="namespace", name="ns", tools=[tool(True) for _ in range(rng.randint(1, 2))])
        return maybe(obj(type="function", name="f", description=rng.choice(["d", None]), parameters={"type": "object"}, strict=rng.choice([True, False, None])), 0.02)

    out = ["{", "", "nonsense"]
    for _ in range(n):
        body = {"model": "m", "input": maybe(rng.choice(["hello", f"key {SECRET}", [item() for _ in range(rng.randint(1, 4))]]))}
        if rng.random() < 0.5:
            body["instructions"] = maybe("be brief")
        if rng.random() < 0.5:
            body["tools"] = maybe([tool() for _ in range(rng.randint(0, 3))])
        out.append(json.dumps(body))
    return out


def _expected(bodies):
    messages, tools, why = defaultdict(list), {}, {}
    for i, body in enumerate(bodies):
        try:
            messages[i], tools[i] = plain_conversion(body)
        except Bad as bad:
            why[i] = str(bad)
            messages.pop(i, None)
    return dict(messages), tools, why


def _loaded(row):
    content = row["content"]
    if content and content.startswith("[{"):
        content = json.loads(content)
    return row["pos"], row["role"], content, row["tool_calls"] and json.loads(row["tool_calls"]), row["tool_call_id"]


def _found(rows):
    out = defaultdict(list)
    for r in rows:
        out[r["id"]].append(_loaded(r))
    return {i: sorted(v, key=lambda m: m[0]) for i, v in out.items()}


def test_conversions_match_a_plain_version(spark):
    bodies = payloads(1, 1500)
    df = spark.createDataFrame(list(enumerate(bodies)), "k int, body string")
    messages, tools, why = _expected(bodies)
    assert len(set(why.values())) > 20 and len(messages) > 500
    assert {r["id"]: r["reject_reason"] for r in chat.conversion_rejects(df, "k", "body").collect()} == why
    assert _found(chat.responses_to_chat(df, "k", "body").collect()) == messages
    got = chat.conversions(df, "k", "body").where("reject_reason IS NULL").collect()
    assert {r["id"]: [(t["name"], t["description"], json.loads(t["parameters"]), t["strict"]) for t in r["tools"] or []] for r in got} == tools
    nothing = spark.createDataFrame([(1, None)], "k int, body string")
    assert [tuple(r) for r in chat.conversion_rejects(nothing, "k", "body").collect()] == [(1, "malformed JSON")] and chat.responses_to_chat(df.where("false"), "k", "body").count() == 0


def test_redacted_conversions_match_a_plain_version(spark):
    bodies = payloads(2, 800)
    df = spark.createDataFrame(list(enumerate(bodies)), "k int, body string")
    redactor = Redactor(DEFAULT)
    messages, _, _ = _expected([redactor.json(b)[0] or "{" for b in bodies])
    rows = chat.safe_responses_to_chat(df, "k", "body").collect()
    assert _found(rows) == messages
    assert not any(SECRET in str(r) for r in rows) and any(PLACEHOLDER in str(r) for r in rows)


def test_conversion_reads_its_table_once(spark, tmp_path):
    spark.createDataFrame(list(enumerate(payloads(3, 5))), "k int, body string").write.parquet(str(tmp_path / "t"))
    plan = chat.responses_to_chat(spark.read.parquet(str(tmp_path / "t")), "k", "body")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def _event(**chunk):
    return f"data: {json.dumps(chunk, ensure_ascii=False)}\n\n".encode()


def _delta(**delta):
    return _event(choices=[{"delta": delta}])


def _call(name="", arguments="", **more):
    return {"function": {"name": name, "arguments": arguments}, **more}


STREAMS = {
    1: [_delta(content="é𝄞 "), _delta(tool_calls=[_call("f", "{", id="a")]), _delta(tool_calls=[_call("g", "[]")]), _delta(content="b"), _event(usage={"prompt_tokens": 3, "completion_tokens": 4}), b"data: [DONE]\n\n", _delta(content="late")],
    2: [_delta(tool_calls=[_call("second", "2", index=1), _call("first", "1", index=0, id="z")]), _delta(tool_calls=[_call("", "22", index=1, id="y")]), b"data: [DONE]\n\n"],
    3: [_event(choices=[{"delta": {"content": "x"}}, {"delta": {"content": "y"}}]), b"data: {broken\n\n", b": comment\n\n", _delta(content=None), b"data: [DONE]\n\n"],
    4: [b"data: [DONE]\n\n"],
}
ANSWERS = {
    1: ("é𝄞 b", [("a", "f", "{"), ("call_1_1", "g", "[]")], (3, 4, 7)),
    2: ("", [("y", "second", "222"), ("z", "first", "1")], (None, None, None)),
    3: ("xy", [], (None, None, None)),
    4: ("", [], (None, None, None)),
}


def _chunks(size):
    """The streams cut into pieces of so many bytes: inside characters, line ends and names."""
    return [(i, k, data[at : at + size]) for i, parts in STREAMS.items() for data in [b"".join(parts)] for k, at in enumerate(range(0, len(data), size))]


def _answers(rows, key):
    return {r[key]: (r["text"], [tuple(c[f] for f in ("call_id", "name", "arguments")) for c in json.loads(r["tool_calls"] or "[]")], (r["input_tokens"], r["output_tokens"], r["total_tokens"])) for r in rows}


def test_chunks_give_text_calls_and_usage(spark):
    for size in (1, 7, 10_000):
        df = spark.createDataFrame(_chunks(size), "response_id long, seq long, chunk binary").repartition(3)
        assert _answers(chat.assemble_chunks(df).collect(), "id") == ANSWERS
    assert [(r["index"], r["call_id"]) for r in chat.merge_tool_calls(chat.assembled(df).where("id = 2")).collect()] == [(1, "y"), (0, "z")]


def test_events_of_responses_carry_their_items(spark):
    df = spark.createDataFrame(_chunks(9), "response_id long, seq long, chunk binary")
    rows = [r for r in chat.response_events(df).orderBy("id", "n").collect() if r["id"] == 1]
    assert [r["type"].removeprefix("response.") for r in rows] == ["created", "output_item.added", "output_text.delta", "output_text.delta", "output_item.done", "output_item.done", "output_item.done", "completed"]
    items = [json.loads(r["item"]) for r in rows if r["type"].endswith("done")]
    assert items[0] == {"type": "message", "role": "assistant", "id": "msg_1", "content": [{"type": "output_text", "text": "é𝄞 b"}]}
    assert items[1:] == [{"type": "function_call", "call_id": "a", "name": "f", "arguments": "{"}, {"type": "function_call", "call_id": "call_1_1", "name": "g", "arguments": "[]"}]
    assert json.loads(rows[0]["response"]) == {"id": "resp_1", "status": "in_progress"}
    last = json.loads(rows[-1]["response"])
    assert last["output"] == items and last["usage"] == {"input_tokens": 3, "input_tokens_details": {"cached_tokens": 0}, "output_tokens": 4, "output_tokens_details": {"reasoning_tokens": 0}, "total_tokens": 7}
    none = [json.loads(r["response"]) for r in chat.response_events(df).where("id = 4 AND type = 'response.completed'").collect()]
    assert none == [{"id": "resp_4", "status": "completed", "output": [], "usage": None, "end_turn": True}]


def test_streamed_responses_are_those_of_the_batch(spark, tmp_path):
    """Chunks in any order over several restarts of the query give what assemble_chunks gives."""
    from maskmill.streaming import redaction

    rows = _chunks(30)
    random.Random(1).shuffle(rows)
    schema = "response_id long, seq long, chunk binary, ts timestamp"
    timed = [(*r, __import__("datetime").datetime(2024, 1, 1)) for r in rows]
    for part in range(3):
        spark.createDataFrame(timed[part::3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = redaction.stream_assemble(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "checkpoint")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert all(r["complete"] for r in out) and len(out) == len(STREAMS)
    assert _answers(out, "response_id") == ANSWERS


def test_events_of_the_registered_view_are_whole(spark):
    d = "/root/testdata/sf0.001"
    made = chat.assemble_chunks(view(spark, d, "tool_chunks"))
    assert made.where(F.col("tool_calls").isNotNull() & F.col("total_tokens").isNotNull()).count() > 0
