"""Views derived from the given tables by SQL that Spark and DuckDB read alike: rows with a known secret, request logs, chunks."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

from .tables import spread, table

# A secret for 39 of 50 keys, in the order of the rules; h is a hash of the key, hh is h and its own hash.
_RECIPES = [
    "'sk-ant-'||h", "'sk-or-v1-'||h", "'sk-cp-'||h", "'sk-proj-'||h", "'fw_'||h", "'xai-'||h", "'ghp_'||h", "'github_pat_'||h", "'ATATT3xFfGF0'||h", "'glpat-'||h", "'xoxb-'||h", "'sk_live_'||h",
    "'AKIA'||substr(upper(h),1,16)", "'ABIA'||translate(substr(upper(h),1,16),'0189','GHIJ')", "'ABSK'||hh||substr(h,1,16)", "'AIza'||h||substr(h,1,3)",
    "'eyJ'||substr(h,1,12)||'.'||substr(h,1,12)||'.'||substr(h,13,12)", "'ya29.'||h", "'ops_eyJ'||hh||hh", "'AGE-SECRET-KEY-1'||translate(substr(hh,1,58),'0123456789abcdef','QPZRY9X8GF2TVDW0')",
    "'dapi'||h", "'dop_v1_'||hh", "'hf_'||h||substr(h,1,2)", "'lin_api_'||h||substr(h,1,8)", "'npm_'||h||substr(h,1,4)", "'pypi-AgEIcHlwaS5vcmc'||hh", "'SG.'||hh||substr(h,1,2)",
    "'https://hooks.slack.com/services/'||hh", "'123456:A'||h||substr(h,1,2)", "'SK'||h", "'hvs.'||hh||h", "'shpat_'||h", "'sntryu_'||h||substr(h,1,8)",
    "'-----BEGIN '||'PRIVATE KEY-----'||chr(10)||h||chr(10)||'-----END '||'PRIVATE KEY-----'", "'-----BEGIN PGP '||'PRIVATE KEY BLOCK-----'||chr(10)||h||chr(10)||'-----END PGP '||'PRIVATE KEY BLOCK-----'",
    "'https://b.example/o?X-Amz-Signature='||hh", "'DB_PASSWORD='||h", "'Authorization: Bearer '||h", "'postgresql://user:'||h||'@db.example/app'",
]
_CASES = " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_RECIPES))

# STR is string in Spark, varchar in DuckDB. Each view may use those before it.
VIEWS = {
    "seeded": f"SELECT k, h, 'note ' || s || ' end' AS text FROM (SELECT k, h, CASE k % 50 {_CASES} ELSE h END AS s FROM (SELECT k, h, h || md5(h) AS hh FROM (SELECT o_orderkey AS k, md5(CAST(o_orderkey AS STR)) AS h FROM orders)))",
    "seeded_docs": "select d.doc_id, d.lang, d.source, d.text || chr(10) || coalesce(s.text, '') as text from documents d left join seeded s on s.k = d.doc_id",
    "request_log": """select k as req_id, o_orderdate as ts,
 case k % 4 when 0 then '/v1/chat/completions' when 1 then '/v1/responses' when 2 then '/v1/messages' else '/v1/raw' end as path,
 case k % 4 when 3 then 'Text/Plain; charset=utf-8' when 2 then 'application/vnd.api+json' else 'application/json' end as content_type,
 '{"Content-Encoding":"' || case when k % 17 = 0 then 'gzip' else 'identity' end || '","X-Request-ID":"' || cast(k as STR) || '","X-Custom-Secret":"v","Cookie":"c","Connection":"keep-alive, X-Hop","X-Hop":"1"}' as headers_json,
 case when k % 4 = 3 then text when k % 23 = 0 then '{"messages": [' else '{"model":"m","max_tokens":1024,"password":"short","apiKey":"' || md5(text) || '","messages":[{"role":"user","content":"' || replace(text, chr(10), chr(92) || 'n') || '"}]}' end as body,
 'https://' || case k % 5 when 0 then 'allowed.example' when 1 then 'ALLOWED.example:443' when 2 then 'other.example' when 3 then '127.0.0.1' else '93.184.216.34' end || case k % 3 when 0 then '/v1/chat' when 1 then '/v1.evil' else '/v1/../admin' end || '?tag=one&tag=two&api_key=' || md5(text) as url
 from (select s.k, s.text, o.o_orderdate from seeded s join orders o on o.o_orderkey = s.k)""",
    "event_text": "select e.event_id, e.ts, '/v1/' || e.event_type as path, s.text from events e join seeded s on s.k = e.event_id",
    "chunks": """select conv_id as response_id, turn as seq, 'data: {"choices":[{"delta":{"content":"' || substr(md5(cast(conv_id * 1000 + turn as STR)), 1, 8) || '"}}]}' || chr(13) || chr(10) || chr(13) || chr(10) as chunk from conversations""",
    "tool_chunks": """select conv_id as response_id, turn as seq, 'data: {"choices":[{"delta":{' || case when turn % 2 = 0 then '"content":"t' || cast(turn as STR) || ' "' else '"tool_calls":[{"index":' || cast(turn % 3 as STR) || ',' || case when turn < 3 then '"id":"c' || cast(conv_id as STR) || '_' || cast(turn as STR) || '",' else '' end || '"function":{"name":"' || case when turn < 3 then 'f' else '' end || '","arguments":"a' || cast(turn as STR) || '"}}]' end || '}}],"usage":{"prompt_tokens":' || cast(turn as STR) || ',"completion_tokens":2}}' || chr(10) || chr(10) as chunk from conversations""",
    "responses_log": """select k, '{"model":"m","stream":' || case when k % 2 = 0 then 'true' else 'false' end || case when k % 3 = 0 then ',"instructions":"be brief"' else '' end || ',"max_output_tokens":' || cast(k % 100 as STR) || ',"tool_choice":"' || case when k % 5 = 0 then 'auto' else 'other' end || '","tools":[{"type":"function","name":"f' || cast(k % 7 as STR) || '","description":"d","parameters":{}},{"type":"namespace","name":"ns","tools":[{"type":"function","name":"g","parameters":{}}]}],"input":' ||
 case k % 6 when 0 then '"hi ' || h || '"' when 1 then '[{"role":"user","content":"a ' || h || '"},{"type":"message","role":"assistant","content":[{"type":"output_text","text":"b"},{"type":"text","text":"c"}]}]'
  when 2 then '[{"type":"function_call","call_id":"c1","namespace":"n","name":"f","arguments":"x' || substr(h,1,4) || '"},{"type":"function_call_output","call_id":"c1","output":[{"type":"input_text","text":"o1"},{"type":"input_text","text":"o2"}]}]'
  when 3 then '[]' when 4 then '[{"type":"message","role":"robot","content":"z"}]' else '[{"type":"message","role":"user","content":[{"type":"input_text","text":"see"},{"type":"input_image","image_url":"http://i/' || substr(h,1,4) || '","detail":"low"}]}]' end || '}' as body from seeded""",
    "chat_log": """select k, '{"id":"' || case when k % 4 = 0 then '' else 'x' || cast(k as STR) end || '","choices":[{"message":{"role":"assistant","content":' || case when k % 3 = 0 then 'null' else '"' || h || '"' end || case when k % 2 = 0 then ',"tool_calls":[{"id":"t1","function":{"name":"f","arguments":"{}"}},{"id":"","function":{"name":"","arguments":""}}]' else '' end || '}}],"usage":{"prompt_tokens":' || cast(k % 10 as STR) || ',"input_tokens":7,"completion_tokens":' || cast(k % 3 as STR) || ',"total_tokens":0}}' as body from seeded""",
}
_NEEDS = {"seeded_docs": ["seeded"], "request_log": ["seeded"], "event_text": ["seeded"], "responses_log": ["seeded"], "chat_log": ["seeded"]}
#: The tables and what they are joined and grouped by.
_TABLES = {"orders": "o_orderkey", "documents": "doc_id", "events": "event_id", "conversations": "conv_id"}


def with_views(*names: str, string: str) -> str:
    """WITH seeded AS (...), ... of the named views and what they need."""
    wanted = list(dict.fromkeys(x for n in names for x in [*_NEEDS.get(n, []), n]))
    typed = {n: re.sub(r"(?i)\b(as) STR\b", rf"\1 {string}", VIEWS[n]) for n in wanted}
    return "WITH " + ", ".join(f"{n} AS ({sql})" for n, sql in typed.items())


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view of the tables in sf_dir. Its tables are read under names of their own, so sessions can hold several, and dealt by
    their keys into as many tasks as the longest of them asks for: the view's expressions, and what follows, run on all cores."""
    sql = f"{with_views(name, string='string')} SELECT * FROM {name}"
    read = {t: table(spark, sf_dir, t) for t in _TABLES if re.search(rf"\b(?:FROM|from|join) {t}\b", sql)}
    rows = max(df.count() for df in read.values())
    for t, df in read.items():
        own = f"mm_{hashlib.md5(sf_dir.encode()).hexdigest()}_{t}"
        spread(df, _TABLES[t], rows=rows).createOrReplaceTempView(own)
        sql = re.sub(rf"\b(FROM|from|join) {t}\b", rf"\1 {own}", sql)
    return spark.sql(sql)
