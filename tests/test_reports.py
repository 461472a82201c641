"""Attribution, leaks, reuse, samples, tenants' rules, line detection, deep payloads and ranges against plain versions."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from maskmill.functions.pyrules import Redactor
from maskmill.functions.rules import BUILTIN, PLACEHOLDER, Policy, custom_rules
from maskmill.operators import nested, requests, text

SECRET = "sk-ant-" + "a1" * 12


def test_attribution_matches_a_plain_sweep(spark):
    rules = custom_rules([{"type": "regex", "value": v, "name": n} for n, v in (("ab", "ab+"), ("bc", "b+c*"), ("any", "[a-c]{2,}"), ("pair", "ca|cc"))])
    rng = random.Random(1)
    rows = ["".join(rng.choice("abcx ") for _ in range(rng.randint(0, 30))) for _ in range(400)]
    want = Counter()
    for t in rows:
        owner: dict[int, int] = {}
        for i, rule in enumerate(rules):
            for m in __import__("re").finditer(rule.pattern, t):
                held = [owner[k] for k in range(m.start(), m.end()) if k in owner]
                if held:
                    want[rules[min(held)].name, rule.name] += 1
                else:
                    owner |= dict.fromkeys(range(m.start(), m.end()), i)
    df = spark.createDataFrame([(t,) for t in rows] + [(None,), ("",)], "text string").repartition(3)
    got = text.rule_attribution(df, policy=Policy(rules=rules, builtin=()))
    assert {(r["taker"], r["loser"]): r["n"] for r in got.collect()} == dict(want) and len(want) > 4
    both = spark.createDataFrame([(f"api_key={SECRET} and sk-proj-{'b' * 24}",)], "text string")
    assert {(r["taker"], r["loser"], r["n"]) for r in text.rule_attribution(both).collect()} == {("anthropic_key", "openai_key", 1), ("anthropic_key", "assigned_secret", 1)}
    assert text.rule_attribution(df.where("false")).count() == 0


def test_leaks_are_found_in_any_row(spark):
    rng = random.Random(2)
    values = ["".join(rng.choice("abcdef0123") for _ in range(n)) for n in (1, 3, 7, 8, 9, 20, 33, 200)] + ["é" * 6, "aaaa", "x" * 8, None, "", "aaaa"]
    rows = []
    for i in range(300):
        parts = [rng.choice(["some text ", "x" * 8, "aa", "é", rng.choice(values) or ""]) for _ in range(rng.randint(0, 8))]
        rows.append((i % 290, "".join(parts) if i else None))
    want: Counter = Counter()
    digest = lambda v: __import__("hashlib").sha256(v.encode()).hexdigest()[:8]
    for k, t in rows:
        for v in {v for v in values if v}:
            n = sum((t or "").startswith(v, at) for at in range(len(t or "")))
            if n:
                want[k, digest(v)] += n
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "k int, text string, hash int").repartition(3)
    known = spark.createDataFrame([(v,) for v in values], "value string")
    got = text.corpus_leaks(df, "k", "text", known, "value").collect()
    assert {(r["k"], r["digest"]): r["n"] for r in got} == dict(want)
    assert text.corpus_leaks(df, "k", "text", known.where("false"), "value").count() == text.corpus_leaks(df.where("false"), "k", "text", known, "value").count() == 0
    plan = text.corpus_leaks(df, "k", "text", known, "value")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_the_filter_of_known_values_grows_with_them(spark, monkeypatch):
    """Most windows are told from values by the filter, however many there are; a full filter, and texts in small pieces, change nothing."""
    assert [text._filter_words(n) for n in (0, 1 << 19, (1 << 19) + 1, 9_000_000, 54_000_000, 1 << 40)] == [1 << 16, 1 << 16, 1 << 17, 1 << 21, 1 << 23, 1 << 23]
    value = lambda i: __import__("hashlib").md5(str(i).encode()).hexdigest()
    known = spark.createDataFrame([(value(i),) for i in range(3000)], "value string")
    df = spark.createDataFrame([(i, None if i % 7 == 0 else f"é{value(i)}{value(i + 5000)}" * (i % 3)) for i in range(0, 6000, 10)], "k int, text string").repartition(2)
    want = {(i, 1 if i % 3 == 1 else 2) for i in range(0, 3000, 10) if i % 7 and i % 3}
    for bounds, piece in (((1 << 16, 1 << 23), 1 << 22), ((1, 1), 1 << 22), ((1, 1 << 9), 100)):
        monkeypatch.setattr(text, "FILTER_WORDS", bounds)
        monkeypatch.setattr(text, "PIECE", piece)
        assert {(r["k"], r["n"]) for r in text.corpus_leaks(df, "k", "text", known, "value").collect()} == want


def test_secrets_with_one_short_digest_stay_apart(spark):
    one, two = "ghp_" + "a" * 36, "ghp_" + "b" * 36
    df = spark.createDataFrame([(1, one), (2, one), (2, one), (3, two), (4, two), (5, "ghp_" + "c" * 36), (6, None)], "k int, text string")
    stub = lambda m: F.concat(F.lit("00000000"), m)
    rows = text.secret_reuse(df, "k", "text", digest=stub, sketch=True)
    assert [(r["digest"], r["rows"]) for r in rows.collect()] == [("00000000", 2)] * 2
    assert rows.select(F.hll_sketch_estimate("rows_sketch")).first()[0] == 2


def test_the_reuse_query_goes_by_short_digests(spark, tmp_path):
    """The secrets of these two keys have the same first 8 characters of their digest, which is all that the query's SQL looks at."""
    from maskmill.plans import catalogue

    spark.createDataFrame([(36312,), (315912,)], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    rows = catalogue.a7_secret_reuse(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in rows] == [("081670f9", "aws_access_key", 4)]


def _plain_detect(value, first, second):
    import re

    found = [m[0] for line in re.split("\r\n|\n|\r", value) for p in first for m in re.finditer(p, line)] or [m[0] for line in re.split("\r\n|\n|\r", value) for p in second for m in re.finditer(p, line)]
    hits = 0
    for v in found if value.strip() else []:
        parts = [p.strip().strip("\"'") for p in v.split(",")] if "," in v else [v]
        n = 0
        for p in filter(None, parts):
            n += value.count(p)
            value = value.replace(p, "#")
        if "," in v and not n:
            n = value.count(v)
            value = value.replace(v, "#")
        hits += n
    return value, hits


def test_line_detection_matches_a_plain_version(spark):
    first, second = ["K[^;\n]*;", "Q[0-9],[0-9]?"], ["z+", "y"]
    rows = ["K,,; a", "Ka, 'b' , c;\nb and c", "no", "zz top y", "zz K1;", "", "  \n", "Q1,2 1 2 Q3,", "K;K;", 'K"x","y";y', "K, ,;z"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)] + [(99, None)], "i int, text string")
    got = {r["i"]: r for r in text.line_detect(df, "text", dict(zip("ab", first, strict=True)), Policy(placeholder="#"), eager=dict(zip("cd", second, strict=True))).collect()}
    assert {i: (got[i]["text"], got[i]["redactions"]) for i in range(len(rows))} == {i: _plain_detect(t, first, second) for i, t in enumerate(rows)}
    assert got[99]["text"] is None and got[99]["redactions"] == 0 and got[3]["rule_hits"] == {"detect:c": 1, "detect:d": 1}


def test_rules_of_tenants_are_counted_and_judged(spark):
    rules = [("a", 1, "regex", "n[0-9]+", "num"), ("a", 2, "exact", "a literal of some length", None), ("b", 1, "exact", "abcd1234", "tail"), ("b", 2, "exact", "short", "s"), ("b", 3, "regex", "[", "r"), ("b", 4, "regex", "x*", "r"), ("b", 5, "exact", "y" * 1025, "r"), (None, 1, "exact", "z" * 20, "r")]
    rules += [("c", i, "exact", f"rule number {i} of many", "n") for i in range(21)]
    table = spark.createDataFrame(rules, "tenant string, ord int, type string, value string, name string")
    why = {(r["tenant"], r["ord"]): r["reason"] for r in text.tenant_rules(table, allow_regex=True).collect()}
    assert why["a", 1] is why["a", 2] is why["b", 1] is None and why["c", 3] == "too many rules" and why["b", 5] == "rule too long"
    assert (why["b", 2], why["b", 3], why["b", 4], why[None, 1]) == ("exact under 8 characters", "does not compile", "matches empty text", "no tenant")
    assert {r["reason"] for r in text.tenant_rules(table).where("type = 'regex'").collect()} == {"regex not allowed"}
    rows = [("a", f"n12 n3 {SECRET} a literal of some length."), ("b", "n12 q" + "1" * 8 + "abcd1234"), ("c", "rule number 3 of many"), (None, SECRET), ("d", None)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "tenant string, text string, redactions int")
    got = {r["tenant"]: (r["text"], r["redactions"], r["rule_hits"]) for r in text.scan_per_tenant(df, "text", "tenant", table, allow_regex=True).collect()}
    p = PLACEHOLDER
    assert got["a"] == (f"{p} {p} {p} {p}.", 4, {"num": 2, "exact_1": 1, "anthropic_key": 1})
    assert got["b"] == (f"n12 {p}", 1, {"tail": 1}) and got["c"] == ("rule number 3 of many", 0, {})
    assert got[None] == (p, 1, {"anthropic_key": 1}) and got["d"] == (None, 0, {})


def test_few_rules_of_tenants_leave_rows_where_they_are(spark, monkeypatch):
    df = spark.range(60).select("id", F.concat(F.lit("t"), F.col("id") % 3).alias("tenant"), F.lit("own-value-1 and own-value-2").alias("text")).repartition(9, "id")
    rules = spark.createDataFrame([("t0", 1, "exact", "own-value-1 and own", "a"), ("t1", 1, "exact", "own-value-2" + "x" * 9, "b")], "tenant string, ord int, type string, value string, name string")
    few = text.redact_per_tenant(df, "text", "tenant", rules)
    assert few.rdd.getNumPartitions() == 9
    monkeypatch.setattr(text, "BROADCAST_RULES", 1)
    many = text.redact_per_tenant(df, "text", "tenant", rules)
    assert sorted(few.collect()) == sorted(many.collect()) and few.where(F.contains("text", F.lit(PLACEHOLDER))).count() == 20


def test_maps_at_any_depth_redact_or_reject(spark):
    inner = "map<string,struct<note:string,tokens:map<string,int>,n:int>>"
    kind = f"map<string,array<map<string,{inner}>>>"
    a, b = "sk-ant-" + "a" * 24, "sk-ant-" + "b" * 24
    leaf = lambda keys, n=5: {k: {"note": f"see {SECRET}", "tokens": {"t": 1}, "n": n} for k in keys}
    rows = [(0, {"x": [{"y": leaf(["k"])}]}), (1, {"x": [{"y": leaf([a, b])}]}), (2, {"apiKeys": [{"y": leaf(["k"])}]}), (3, {"x": [None, {a: leaf(["k"]), b: leaf(["k"])}]}), (4, None), (5, {}), (6, {a: None, b: []})]
    df = spark.createDataFrame(rows, f"i int, m {kind}").withColumn("reject_reason", F.lit("old"))
    got = {r["i"]: (r["m"], r["reject_reason"]) for r in nested.nested_or_reject(df, "m").collect()}
    assert {i for i, (_, why) in got.items() if why == "colliding keys"} == {1, 3, 6} and got[1][0] is None
    redactor = Redactor(Policy())
    plain = lambda v: v.asDict(True) if hasattr(v, "asDict") else {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else [plain(x) for x in v] if isinstance(v, list) else v
    want = json.loads(redactor.json(json.dumps(rows[0][1]))[0])
    assert plain(got[0][0]) == want and got[4] == (None, None) and got[5] == ({}, None)
    strict = plain(got[2][0])["apiKeys"][0]["y"]["k"]
    assert strict == {"note": PLACEHOLDER, "tokens": {"t": None}, "n": None}
    assert [r["collides"] for r in nested.key_collisions(df, "m").orderBy("i").collect()] == [False, True, False, True, False, False, True]
    assert nested.redact_nested(df.where("i = 0"), "m").first()["m"] == got[0][0]
    with pytest.raises(Exception, match="collide"):
        nested.redact_nested(df, "m").collect()


def test_plans_of_nested_maps_grow_with_their_depth(spark):
    one_rule = Policy(builtin=BUILTIN[:1])

    def size(depth):
        kind = "string"
        for _ in range(depth):
            kind = f"map<string,{kind}>"
        df = spark.createDataFrame([], f"m {kind}")
        return len(nested.redact_nested(df, "m", one_rule)._jdf.queryExecution().analyzed().toString())

    sizes = [size(d) for d in (1, 2, 3, 4, 5)]
    steps = [b - a for a, b in zip(sizes, sizes[1:], strict=False)]
    assert max(steps) < 1.5 * min(steps)


def test_leaves_at_any_depth(spark):
    deep = '{"a":' * 60 + "[1.50,{\"b\":[]}]" + "}" * 60
    bodies = [deep, '{"token":{"x":["s",null,true,1e5]}}', "5", '"t"', "{", None, "[]", "[" * 50_000 + "]" * 50_000, '{"k":1,"k":2}']
    df = spark.createDataFrame([(i, b, "x") for i, b in enumerate(bodies)], "i int, body string, path string")
    got = [tuple(r) for r in nested.payload_leaves(df, "i", "body").orderBy("row_id", "path").collect()]
    assert got[0] == (0, "$" + ".a" * 60 + "[0]", "a", "1.50", "normal")
    assert [r[1:] for r in got if r[0] == 1] == [("$.token.x[0]", "x", "s", "sensitive"), ("$.token.x[1]", "x", None, "sensitive"), ("$.token.x[2]", "x", "true", "sensitive"), ("$.token.x[3]", "x", "1e5", "sensitive")]
    assert [r[1:4] for r in got if r[0] in (2, 3, 8)] == [("$", None, "5"), ("$", None, "t"), ("$.k", "k", "2")]
    assert {r[0] for r in got} <= {0, 1, 2, 3, 7, 8} and [r[3] for r in got if r[0] == 7] in ([], [bodies[7]])


def test_samples_hold_rejects_of_every_kind(spark):
    bad = json.dumps({"sk-ant-" + "a" * 24: 1, "sk-ant-" + "b" * 24: 2})
    rows = [(i, json.dumps({"note": SECRET, "i": i})) for i in range(20)] + [(30 + i, "{" * (i + 1)) for i in range(9)] + [(50, bad), (51, bad), (52, None)]
    df = spark.createDataFrame(rows, "k int, body string").repartition(4)
    got = nested.payload_sample(df, "k", "body", 30, 3).collect()
    by = {why: sorted(r["k"] for r in got if r["reject_reason"] == why) for why in (None, "malformed", "colliding keys")}
    assert by == {None: [0, 1, 2], "malformed": [30, 31, 32], "colliding keys": [50, 51]}
    assert all(r["redacted"] is None for r in got if r["reject_reason"]) and not any(SECRET in (r["redacted"] or "") for r in got)
    assert {(len(r["raw"]), r["raw_cut"]) for r in got if r["reject_reason"] is None} == {(30, True)}


def test_hits_of_message_lists(spark):
    df = spark.createDataFrame([(1, [("user", f"see {SECRET}"), ("assistant", "DB_PASSWORD=abcdefgh1")]), (2, []), (3, None)], "id int, messages array<struct<role:string,content:string>>")
    got = {r["id"]: (r["redactions"], r["rule_hits"]) for r in nested.scan_message_lists(df).collect()}
    assert got == {1: (2, {"anthropic_key": 1, "assigned_secret": 1}), 2: (0, {}), 3: (0, {})}
    pairs = spark.createDataFrame([(1, [["user", SECRET]])], "id int, messages array<array<string>>")
    assert nested.scan_message_lists(pairs).first()["redactions"] == 1


def test_ranges_are_searched_as_bounds(spark):
    rng = random.Random(3)
    ranges = [(a, a + rng.randint(0, 1 << 20)) for a in (rng.randint(0, 1 << 32) for _ in range(300))]
    ranges += [(5, 9), (9, 12), (13, 13)]
    ips = [rng.choice([r[0], r[1], r[0] - 1, r[1] + 1, rng.randint(0, 1 << 32)]) for r in ranges for _ in range(3)]
    ips = [ip for ip in ips if ip >= 0]
    hosts = spark.createDataFrame([(f"h{i}.example", f"{ip:032X}") for i, ip in enumerate(ips)], "host string, ip string")
    table = spark.createDataFrame([(f"{a:032x}", f"{b:032x}", "r") for a, b in ranges], "lo string, hi string, name string")
    df = spark.createDataFrame([(i, f"https://H{i}.example/x") for i in range(len(ips))], "i int, url string")
    got = {r["i"]: r["private"] for r in requests.private_targets(df, "url", hosts, table).collect()}
    assert got == {i: any(a <= ip <= b for a, b in ranges) for i, ip in enumerate(ips)}
    none = requests.private_targets(df, "url", hosts, table.where("false")).where("private").count()
    assert none == 0


def test_urls_with_user_info_are_never_allowed(spark):
    df = spark.createDataFrame([("https://user@allowed.example/v1",), ("https://u:p@allowed.example/v1",), ("https://allowed.example/v1?a=b@c",), (None,)], "url string")
    allowed = spark.createDataFrame([("https://allowed.example/v1",)], "url string")
    assert [r["allowed"] for r in requests.allowlist(df, "url", allowed).collect()] == [False, False, True, False]
    assert [r["allowed"] for r in requests.allowlist(df, "url", allowed.where("false")).collect()] == [False, False, True, True]


def test_sql_names_of_messages_and_parameters(spark):
    from maskmill.functions.sql import register

    register(spark)
    m, p = json.dumps([{"role": "user", "content": SECRET}]), json.dumps({"api_key": SECRET, "messages": [{"content": SECRET}], "extra": {"password": "p"}})
    row = spark.createDataFrame([(m, p, "{")], "m string, p string, bad string").selectExpr("redact_messages(m) m", "scan_messages(m) nm", "redact_params(p) p", "scan_params(p) np", "redact_messages(p) a", "scan_params(bad) b", "redact_text(m) t", "scan_redactions(m) nt", "scan_payload(p) pp", "redact_payload(bad) rb").first()
    assert json.loads(row["m"]) == [{"role": "user", "content": PLACEHOLDER}] and row["nm"] == 1
    assert json.loads(row["p"]) == {"api_key": PLACEHOLDER, "messages": [{"content": PLACEHOLDER}], "extra": {"password": PLACEHOLDER}} and row["np"] == 3
    assert row["a"] is None and row["b"] is None and row["rb"] is None and row["nt"] == 1 and row["pp"] == 3 and SECRET not in row["t"]


def test_bracketed_hosts_have_their_own_port(spark):
    from maskmill.functions import columns as X

    urls = ["http://[::1]", "https://[::1]:8443/x", "https://u:p@[::1]/", "http://h:0/", "https://h:99999", "http:///", "http://h.example///"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string")
    ports = {r["i"]: r["p"] for r in df.select("i", X.effective_port(F.col("url")).alias("p")).collect()}
    assert ports == {0: 80, 1: 8443, 2: 443, 3: 80, 4: None, 5: 80, 6: 80}
    why = {r["i"]: r["url_reason"] for r in requests.validate_base_url(df, "url").collect()}
    assert why == {0: None, 1: None, 2: "userinfo", 3: None, 4: "port", 5: "host", 6: None}
