"""Rules on literal rows: a positive, a comma list and a near miss for every rule; policies; reports."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from maskmill.functions.columns import redacted
from maskmill.functions.pyrules import Redactor
from maskmill.functions.rules import BUILTIN, PLACEHOLDER, Policy, RuleError, custom_rules, rule_reason
from maskmill.operators import text
from maskmill.sources.derived import _RECIPES

H = hashlib.md5(b"1").hexdigest()
HH = H + hashlib.md5(H.encode()).hexdigest()


def secrets(spark):
    cols = ", ".join(f"{r} AS r{i}" for i, r in enumerate(_RECIPES))
    row = spark.sql(f"SELECT {cols} FROM (SELECT '{H}' AS h, '{HH}' AS hh)").first()
    return list(row)


def test_every_rule_takes_its_own_secret_alone_and_in_lists(spark):
    values = secrets(spark)
    rows = [(i, v, f"{v}, {v}", f"x{v[:6]}") for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, one string, two string, miss string")
    one = {r["i"]: r for r in text.scan_text(df, "one").collect()}
    two = {r["i"]: r for r in text.scan_text(df, "two").collect()}
    miss = {r["i"]: r for r in text.scan_text(df, "miss").collect()}
    for i, rule in enumerate(BUILTIN):
        assert one[i]["rule_hits"] == {rule.name: 1}, rule.name
        # a context rule's value runs up to the next blank, comma included
        assert two[i]["rule_hits"] == {rule.name: 2}, rule.name
        assert miss[i]["redactions"] == 0, rule.name
        secret = H if rule.keeps_context else values[i]
        assert secret not in two[i]["two"] and PLACEHOLDER in two[i]["two"]


def test_context_stays_and_empty_values_pass(spark):
    df = spark.createDataFrame([("DB_PASSWORD='abcdefgh1'",), ("",), (None,), ("password: [short]",), ("Authorization: Bearer abcdefgh",)], "text string")
    out = [r["text"] for r in text.redact_text(df).collect()]
    assert out == [f"DB_PASSWORD='{PLACEHOLDER}'", "", None, "password: [short]", f"Authorization: Bearer {PLACEHOLDER}"]


def test_partial_masks_and_digest(spark):
    secret = "sk-ant-" + H
    df = spark.createDataFrame([(secret,)], "text string")
    out = text.redact_text(df, policy=Policy(mode="partial")).first()["text"]
    assert out == f"{secret[:4]}...{secret[-4:]}:{hashlib.sha256(secret.encode()).hexdigest()[:8]}"


def test_custom_rules_come_first_and_bad_ones_are_refused(spark):
    rules = custom_rules([{"type": "exact", "value": "abcd1234"}, {"type": "exact", "value": "a literal of some length"}, {"type": "regex", "value": "n[0-9]+"}])
    df = spark.createDataFrame([("x " + "q" * 8 + "abcd1234 y",), ("a literal of some length.",), ("n12 n3",), ("abcd1234",)], "text string")
    out = [(r["text"], r["rule_hits"]) for r in text.scan_text(df, policy=Policy(rules=rules, placeholder="$1\\")).collect()]
    assert out == [("x $1\\ y", {"exact_0": 1}), ("$1\\.", {"exact_1": 1}), ("$1\\ $1\\", {"regex_2": 2}), ("abcd1234", {})]
    assert rule_reason("regex", ".*") == "matches empty text"
    with pytest.raises(RuleError):
        custom_rules([{"type": "exact", "value": "short"}])


def test_switched_off_and_high_entropy_text_stay(spark):
    df = spark.createDataFrame([("sk-ant-" + H, HH)], "text string, plain string")
    assert text.redact_text(df, policy=Policy(enabled=False)).first()["text"] == "sk-ant-" + H
    assert text.redact_text(df, "plain").first()["plain"] == HH


def test_clashing_columns_empty_table_and_reports(spark):
    df = spark.createDataFrame([("sk-ant-" + H, 5, "p")], "text string, redactions int, path string")
    scanned = text.scan_text(df)
    assert scanned.first()["redactions"] == 1
    assert text.scan_text(df.where("false")).count() == 0
    assert [tuple(r) for r in text.merge_stats(text.long_hits(scanned, "path"), "path").collect()] == [("p", "anthropic_key", 1)]
    event = text.audit_events(scanned, ts=F.lit("t")).first()
    assert event["rules"] == {"anthropic_key": 1} and event["redactions"] == 1


def test_line_detector_splits_comma_lists(spark):
    df = spark.createDataFrame([("key a1,b2\nagain b2 a1",)], "text string")
    out = text.line_detect(df, "text", {"pair": "[a-z][0-9],[a-z][0-9]"}).first()
    assert out["text"] == f"key {PLACEHOLDER},{PLACEHOLDER}\nagain {PLACEHOLDER} {PLACEHOLDER}" and out["rule_hits"] == {"detect:pair": 4}


def test_rules_tried_by_their_literals_give_the_whole_fold(spark):
    """Texts of pieces of secrets, in the order and out of it, against every rule on every text; with short and caseless own rules."""
    rng = random.Random(4)
    pieces = ["sk-ant-" + "a1" * 12, "sk-" + "b2" * 12, "fw_", "api_key", "=", ": ", '"', "Authorization: Bearer ", "postgresql://u:", "passw@h", "tail1234", "x" * 9, "TOKEN", "\u017fecret=", "\u212aEY=", "0123456789abcdef", " ", "\n"]
    rows = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 9))) for _ in range(400)]
    own = custom_rules([{"type": "exact", "value": "tail1234"}, {"type": "regex", "value": "x{3,}"}, {"type": "exact", "value": "0123456789abcdef0123"}])
    for policy in (Policy(rules=own), Policy(rules=own, builtin=BUILTIN[-6:], mode="partial"), Policy(placeholder="sk-tokens")):
        redactor = Redactor(policy)

        def whole(value, hits, redactor=redactor):
            for rule, pattern in redactor.rules:
                value, n = pattern.subn(lambda m, rule=rule: redactor._mask(rule, m), value)
                hits[rule.name] += n
            return value

        for t in rows:
            want, got = Counter(), Counter()
            assert redactor.text(t, got) == whole(t, want) and got == +want
        df = spark.createDataFrame([(t,) for t in rows], "t string")
        assert [r[0] for r in df.select(redacted(F.col("t"), policy)).collect()] == [whole(t, Counter()) for t in rows]
    assert redactor.short("role", got := Counter()) == "role" and redactor.short("sk-" + "b" * 20, got) == redactor.short("sk-" + "b" * 20, got) == "sk-tokens" and got == {"openai_key": 2}


def test_patterns_of_names_run_only_where_a_name_gets_a_value():
    """The placeholder holds a literal of the slowest pattern, which ran on every text that had a hit (F19)."""
    redactor, names = Redactor(Policy()), {r.name: i for i, r in enumerate(BUILTIN)}
    for value in (f"a {PLACEHOLDER} b", "the token is a key, significant; author=me", "keykey" * 20_000):
        assert not {names["assigned_secret"], names["auth_header"], names["signed_url_query_param"]} & set(redactor._tried(value, 0)), value[:60]
    for value in ("X_API_KEYS.old\n:\tv", "paſſword='v", "to\u212aen\u3000= v", "APİ-KEY:v"):
        assert names["assigned_secret"] in redactor._tried(value, 0), value
    assert redactor._tried("sk-ant- token=", names["assigned_secret"]) == [names["assigned_secret"]]


def test_the_fold_is_that_of_all_patterns_one_by_one():
    pieces = ["key", "api_", "ſecret", "PASSWD", "to\u212aen", "webhook-url", "?sig", "&X-Amz-Signature", "Authorization", "x-auth-key", "-", ".", "é", " ", "\n", "\u3000", ":", "=", " = ", "'", '"', "[", ";", "abcdefgh1", H, "SK" + H, "bearer ", PLACEHOLDER, "https://u:p@h"]
    rng, redactor, matched = random.Random(7), Redactor(Policy()), Counter()
    for _ in range(4000):
        value = "".join(rng.choices(pieces, k=rng.randint(1, 14)))
        hits: Counter = Counter()
        done, plain, want = redactor.text(value, hits), value, Counter()
        for rule, pattern in redactor.rules:
            plain, n = pattern.subn(lambda m, rule=rule: redactor._mask(rule, m), plain)
            want += Counter({rule.name: n})
        assert (done, hits) == (plain, want), value
        matched += hits
    assert min(matched[n] for n in ("assigned_secret", "auth_header", "signed_url_query_param", "twilio_api_key", "url_credentials")) > 20
