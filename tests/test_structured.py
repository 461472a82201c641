"""Nested values, JSON, bytes, requests and chat payloads on literal rows."""

import json

from pyspark.sql import functions as F

from maskmill.functions.rules import PLACEHOLDER
from maskmill.operators import chat, nested, requests

SECRET = "sk-ant-" + "a1" * 12


def test_json_fields_by_name_and_content(spark):
    body = {"max_tokens": 1024, "databasePassword": 123456, "apiKey": "longenough", "token": "string", "credentials": {"a": ["x", None, True]}, "note": f"see {SECRET}"}
    rows = [(1, json.dumps(body)), (2, "{bad"), (3, None), (4, json.dumps({"sk-ant-" + "a" * 20: 1, "sk-ant-" + "b" * 20: 2}))]
    out = {r["id"]: r for r in nested.redact_json(spark.createDataFrame(rows, "id int, body string"), "body").collect()}
    assert json.loads(out[1]["body"]) == {"max_tokens": 1024, "databasePassword": PLACEHOLDER, "apiKey": PLACEHOLDER, "token": "string", "credentials": {"a": [PLACEHOLDER, None, True]}, "note": f"see {PLACEHOLDER}"}
    assert out[1]["redactions"] == 4
    assert out[2]["reject_reason"] == "malformed" and out[3]["reject_reason"] is None and out[4]["reject_reason"] == "colliding keys"


def test_typed_nested_values_agree_with_json(spark):
    df = spark.sql(f"SELECT struct('{SECRET}' AS note, struct('secretvalue' AS apiKey) AS inner, map('password', 'p', 'k', '{SECRET}') AS m, cast(null AS array<string>) AS none) AS p")
    out = nested.redact_nested(df, "p").first()["p"]
    assert out["note"] == PLACEHOLDER and out["inner"]["apiKey"] == PLACEHOLDER and out["m"] == {"password": PLACEHOLDER, "k": PLACEHOLDER} and out["none"] is None


def test_bytes_that_are_not_text_survive(spark):
    df = spark.createDataFrame([(b"\xff\xfe " + SECRET.encode() + b" \x80",), (None,)], "b binary")
    out = [r["b"] and bytes(r["b"]) for r in nested.redact_binary(df, "b").collect()]
    assert out == [b"\xff\xfe " + PLACEHOLDER.encode() + b" \x80", None]


def test_targets_and_queries(spark):
    urls = ["https://allowed.example/v1/%2e%2e/admin%zz", "https://allowed.example/v1/x", "https://allowed.example/v1.evil", "https://allowed.example/v1/../admin", "https://ALLOWED.example:443/v1", "https://[]", None]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string")
    allowed = {r["i"]: r["allowed"] for r in requests.allowlist(df, "url", spark.createDataFrame([("https://allowed.example/v1",)], "url string")).collect()}
    assert allowed == {0: False, 1: True, 2: False, 3: False, 4: True, 5: False, 6: False}
    query = spark.createDataFrame([("http://h/p?tag=a&tag=b&api_key=12345678#f",), ("http://h/p",)], "url string")
    assert [r["url"] for r in requests.redact_query(query, "url").collect()] == ["http://h/p?tag=a&tag=b&api_key=%5BREDACTED_SECRET%5D#f", "http://h/p"]


def test_chunks_split_inside_characters_and_line_ends(spark):
    event = 'data: {"choices":[{"delta":{"content":"é𝄞"}}]}\r\n\r\n'.encode()
    parts = [event[:41], event[41:44], event[44:-3], event[-3:], b"data: [DONE]\n\n", event]
    df = spark.createDataFrame([(1, i, p) for i, p in enumerate(parts)] + [(2, 0, None)], "response_id long, seq long, chunk binary")
    out = {r["id"]: r["text"] for r in chat.assemble_chunks(df).collect()}
    assert out == {1: "é𝄞", 2: ""}


def test_conversion_rejects_have_reasons(spark):
    bad = ["{", '{"input":[]}', '{"input":5}', '{"input":[{"type":"message","role":"user"}]}', '{"input":[{"type":"function_call","call_id":"c","name":"f"}]}', '{"input":"x","tools":[{"type":"web"}]}']
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bad)] + [(9, '{"input":"fine"}')], "k int, body string")
    why = {r["id"]: r["reject_reason"] for r in chat.conversion_rejects(df, "k", "body").collect()}
    assert why == {0: "malformed JSON", 1: "input list cannot be empty", 2: "input must be text or a list", 3: "message content is required", 4: "arguments must be text", 5: "unsupported tool type"}
    assert [r["content"] for r in chat.responses_to_chat(df, "k", "body").select(F.col("content")).collect()] == ["fine"]


def test_literal_addresses_of_both_kinds(spark):
    hosts = ["[2606:4700::1111]", "[::1]", "[fd00::1%25eth0]", "[::ffff:10.0.0.1]", "[::ffff:8.8.8.8]", "[2001:db8::5]", "[1:2:3:4:5:6:7:8]", "[1::2::3]", "8.8.8.8", "172.20.1.1", "172.32.0.1", "named.example", "both.example"]
    df = spark.createDataFrame([(h, f"https://{h}/v1") for h in hosts], "h string, url string")
    known = spark.createDataFrame([("both.example", "0" * 20 + "ffff08080808"), ("both.example", "0" * 20 + "ffff0a000001")], "host string, ip string")
    got = {r["h"]: r["private"] for r in requests.private_targets(df, "url", known, requests.reserved_ranges(spark)).collect()}
    assert [h for h in hosts if not got[h]] == ["[2606:4700::1111]", "[::ffff:8.8.8.8]", "[1:2:3:4:5:6:7:8]", "8.8.8.8", "172.32.0.1"]


def test_rules_of_a_request_and_of_a_tenant(spark):
    from maskmill.operators import text

    heads = ['[{"type":"regex","value":"["}]', '[{"type":"regex","value":".*"}]', '[{"type":"regex","value":"a+b"}]', None, "[]"]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(heads)], "i int, h string")
    assert {r["i"]: r["extra_reason"] for r in requests.validate_extra_rules(df, "h", allow_regex=True).collect()} == {0: "bad rule", 1: "bad rule", 2: None, 3: None, 4: None}
    rules = [("a", 1, "exact", r"zzzzzzzzzzzzzzzzz\E|.+|\Q", "n"), ("a", 2, "exact", r"\E|.+|\Qxy", "n"), ("b", 1, "exact", r"tail\Efin", "n"), ("c", 1, "exact", "$1 and \\ here, long enough", "n")]
    table = spark.createDataFrame(rules, "tenant string, ord int, type string, value string, name string")
    rows = spark.createDataFrame([("a", "plain text"), ("b", r"x 12345678tail\Efin y"), ("c", "see $1 and \\ here, long enough."), (None, "n")], "tenant string, text string")
    got = [r["text"] for r in text.redact_per_tenant(rows, "text", "tenant", table).collect()]
    assert sorted(got) == sorted(["plain text", f"x {PLACEHOLDER} y", f"see {PLACEHOLDER}.", "n"])


def test_hits_of_typed_values_parameters_and_queries(spark):
    df = spark.sql(f"SELECT struct('{SECRET}' AS api_key, array(struct('user' AS role, 'see {SECRET}' AS content)) AS messages, map('password', 'p') AS extra) AS params, 'http://h/p?a=1&token=abcdefgh&q={SECRET}' AS url")
    params = nested.scan_params(df).first()
    assert params["rule_hits"] == {"anthropic_key": 2, "sensitive_field": 1} and params["redactions"] == 3
    assert params["params"]["messages"][0]["content"] == f"see {PLACEHOLDER}" and params["params"]["extra"] == {"password": PLACEHOLDER}
    payload = nested.scan_nested(df, "params").first()
    assert payload["rule_hits"] == {"anthropic_key": 1, "sensitive_field": 2}
    query = requests.scan_query(df, "url").first()
    assert query["rule_hits"] == {"anthropic_key": 1, "sensitive_field": 1} and "abcdefgh" not in query["url"]
