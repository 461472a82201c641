"""Policy on request logs: bodies, headers, query parameters and targets. Rejected rows are set apart with a reason, never lost."""

from __future__ import annotations

import ipaddress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskmill.functions import columns as X
from maskmill.functions.columns import SENSITIVE_FIELD, classify_key, mask_field, percent_decoded, redacted, url_part
from maskmill.functions.rules import DEFAULT, Policy, rule_reason

from .nested import redact_json

MAX_BODY_BYTES = 32 << 20
#: Tables of rules, targets and ranges above this many rows are joined by a shuffle, not broadcast.
BROADCAST_ROWS = 100_000

# Header names, lower-case.
NOT_FORWARDED = "content-length cookie host connection keep-alive proxy-authenticate proxy-authorization set-cookie te trailer transfer-encoding upgrade".split()
NOT_RETURNED = "content-length cookie transfer-encoding connection keep-alive proxy-authenticate proxy-authorization set-cookie te trailer upgrade".split()
STALE_ONCE_TRANSFORMED = "content-digest content-encoding content-md5 digest etag repr-digest".split()
MASKED_IN_DEBUG = "authorization cookie set-cookie x-api-key x-auth-token x-target-api-key x-target-authorization".split()
TARGET_SETTINGS = "x-target-base-url x-target-api-key x-target-api-key-header x-target-authorization".split()
CLIENT_AUTH = "authorization x-api-key x-auth-token".split()
_FIELD = "(?U)" + SENSITIVE_FIELD


def route_bodies(df: DataFrame, content_type: str = "content_type") -> DataFrame:
    """df with body_kind: json for application/json and +json, else text. A null type is text."""
    return df.withColumn("body_kind", F.when(X.is_json(F.col(content_type)), "json").otherwise("text"))


def split_valid_json(df: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, malformed rows). A null body is malformed."""
    bad = F.try_parse_json(F.col(col)).isNull()
    return df.where(~bad), df.where(bad)


def size_guard(df: DataFrame, col: str, limit: int = MAX_BODY_BYTES) -> DataFrame:
    """df with reject_reason 'too large' where the body has more bytes than limit."""
    return df.withColumn("reject_reason", F.when(F.octet_length(col) > limit, "too large"))


def encoding_guard(df: DataFrame, headers: str = "headers", enabled: bool = True) -> DataFrame:
    """df with reject_reason 'encoded' where a content-encoding other than identity is declared, while redaction is on."""
    declared = F.lower(F.trim(F.coalesce(_header(headers, "content-encoding"), F.lit("identity"))))
    return df.withColumn("reject_reason", F.when(F.lit(enabled) & (declared != "identity"), "encoded"))


def _header(headers: str, name: str) -> Column:
    entries = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name)
    return F.get(entries, F.lit(0))["value"]


def _keep(headers: str, condition) -> Column:
    return F.map_filter(headers, lambda k, _v: condition(F.lower(k)))


def _named_by_connection(headers: str) -> Column:
    listed = F.split(F.coalesce(_header(headers, "connection"), F.lit("")), ",")
    return F.filter(F.transform(listed, lambda x: F.lower(F.trim(x))), lambda x: x != "")


def drop_connection_headers(df: DataFrame, headers: str = "headers") -> DataFrame:
    """df without the headers that the connection header names."""
    return df.withColumn(headers, _keep(headers, lambda k: ~F.array_contains(_named_by_connection(headers), k)))


def outgoing_headers(df: DataFrame, headers: str = "headers", forward_client_auth: bool = False) -> DataFrame:
    """df with the headers that may go on: no hop-by-hop, cookie, target or redaction settings, no client authentication unless
    it is forwarded, nothing named like a secret; accept-encoding is identity where the client names none."""
    dropped = NOT_FORWARDED + TARGET_SETTINGS

    def stays(k: Column) -> Column:
        auth = k.isin(CLIENT_AUTH)
        secret = F.when(auth, F.lit(not forward_client_auth)).otherwise(k.rlike(_FIELD))
        return ~(k.isin(dropped) | F.array_contains(_named_by_connection(headers), k) | k.startswith("x-redact-") | secret)

    kept = _keep(headers, stays)
    named = F.exists(F.map_keys(headers), lambda k: F.lower(k) == "accept-encoding")
    return df.withColumn(headers, F.when(named, kept).otherwise(F.map_concat(kept, F.create_map(F.lit("accept-encoding"), F.lit("identity")))))


def response_headers(df: DataFrame, headers: str = "headers", transformed: bool = False) -> DataFrame:
    """df with the headers of a response that may go back; more go where the body was transformed."""
    dropped = NOT_RETURNED + (STALE_ONCE_TRANSFORMED if transformed else [])
    return df.withColumn(headers, _keep(headers, lambda k: ~(k.isin(dropped) | F.array_contains(_named_by_connection(headers), k))))


def mask_headers(df: DataFrame, headers: str = "headers") -> DataFrame:
    """df with the values of secret headers masked."""
    secret = lambda k: F.lower(k).isin(MASKED_IN_DEBUG) | F.lower(k).startswith("x-redact-") | F.lower(k).rlike(_FIELD)
    return df.withColumn(headers, F.transform_values(headers, lambda k, v: F.when(secret(k), F.lit("[REDACTED_HEADER]")).otherwise(v)))


def _pairs(url: str) -> Column:
    """The query parameters of a url column, decoded: array of (name, value)."""
    plain = lambda s: percent_decoded(F.replace(s, F.lit("+"), F.lit(" ")))

    def one(pair: Column) -> Column:
        value = F.when(F.contains(pair, F.lit("=")), F.substr(pair, F.locate("=", pair) + 1)).otherwise("")
        return F.struct(plain(F.substring_index(pair, "=", 1)).alias("name"), plain(value).alias("value"))

    return F.transform(F.filter(F.split(url_part(F.col(url), "query"), "&"), lambda p: p != ""), one)


def redact_query(df: DataFrame, url: str, policy: Policy = DEFAULT) -> DataFrame:
    """df with the query parameters of a url column redacted, in order, repeated ones kept. A parameter named like a secret is
    masked whole, others by content; names are scanned too. Urls without a query stay as they are."""

    def one(pair: Column) -> Column:
        kind = classify_key(pair["name"])
        hidden = F.when(kind == "normal", redacted(pair["value"], policy)).otherwise(mask_field(pair["value"], "string", kind, policy.placeholder))
        return F.concat(F.url_encode(redacted(pair["name"], policy)), F.lit("="), F.url_encode(hidden))

    made = F.array_join(F.transform(_pairs(url), one), "&")
    head, tail = F.regexp_extract(url, r"^([^?#]*)", 1), F.regexp_extract(url, r"(#.*)$", 1)
    return df.withColumn(url, F.when(url_part(F.col(url), "query") == "", F.col(url)).otherwise(F.concat(head, F.lit("?"), made, tail)))


def scan_query(df: DataFrame, url: str, policy: Policy = DEFAULT) -> DataFrame:
    """redact_query with redactions and rule_hits: what the parameters' names, content and sensitive names (sensitive_field) gave.
    Null and malformed urls have no hits."""
    objects = F.to_json(F.transform(_pairs(url), lambda p: F.create_map(p["name"], p["value"])))
    rest = [c for c in df.columns if c not in ("redactions", "rule_hits")]
    counted = redact_json(df.select(*rest, objects.alias("__mm_pairs")), "__mm_pairs", policy)
    none = F.create_map().cast("map<string,bigint>")
    return redact_query(counted.select(*rest, F.coalesce("redactions", F.lit(0)).alias("redactions"), F.coalesce("rule_hits", none).alias("rule_hits")), url, policy)


def validate_rules(rules: DataFrame) -> DataFrame:
    """rules (type, value, name) with reason: why a rule is rejected, or null. Compiling needs Python's re: an Arrow batch of rules."""

    @F.pandas_udf("string")
    def reason(kind: pd.Series, value: pd.Series, name: pd.Series) -> pd.Series:
        clean = lambda x: None if x is None or x is pd.NA or x != x else x
        return pd.Series([rule_reason(clean(k), clean(v), clean(n)) for k, v, n in zip(kind, value, name, strict=True)], dtype=object)

    return rules.withColumn("reason", reason("type", "value", "name"))


def validate_extra_rules(df: DataFrame, header: str, max_rules: int = 20, max_chars: int = 1024, max_bytes: int = 16384, allow_regex: bool = False) -> DataFrame:
    """df with extra_reason: why a request's own rules (a JSON list in a header) are refused, or null. No header: nothing to refuse."""
    rules = F.from_json(F.col(header), "array<struct<type:string,value:string,name:string>>")
    is_list = F.try_parse_json(F.col(header)).isNotNull() & F.startswith(F.ltrim(F.col(header)), F.lit("["))
    bad_name = lambda r: r["name"].isNotNull() & ~r["name"].rlike(r"^[A-Za-z0-9_.-]{1,64}$")
    wrong = lambda r: r.isNull() | r["type"].isNull() | ~r["type"].isin("exact", "regex") | r["value"].isNull() | (r["value"] == "") | ((r["type"] == "exact") & (F.length(r["value"]) < 8)) | bad_name(r)
    reason = (
        F.when(F.col(header).isNull() | (F.col(header) == ""), None)
        .when(F.octet_length(header) > max_bytes, "header too large")
        .when(~is_list | rules.isNull(), "not a list")
        .when(F.size(rules) > max_rules, "too many rules")
        .when(F.exists(rules, wrong), "bad rule")
        .when(F.exists(rules, lambda r: F.length(r["value"]) > max_chars), "rule too long")
        .when(F.lit(not allow_regex) & F.exists(rules, lambda r: r["type"] == "regex"), "regex not allowed")
    )
    if allow_regex:
        patterns = F.transform(F.filter(rules, lambda r: r["type"] == "regex"), lambda r: r["value"])
        reason = F.coalesce(reason, F.when(F.size(patterns) > 0, _bad_pattern()(patterns)))
    return df.withColumn("extra_reason", reason)


def _bad_pattern():
    """Whether one of a request's patterns does not compile or matches empty text: needs Python's re."""

    @F.pandas_udf("string")
    def bad(values: pd.Series) -> pd.Series:
        wrong = lambda found: found is not None and any(rule_reason("regex", p) for p in found)
        return pd.Series(["bad rule" if wrong(v) else None for v in values], dtype=object)

    return bad


def validate_base_url(df: DataFrame, url: str) -> DataFrame:
    """df with url_reason: why a url cannot be a base url, or null."""
    part = lambda p: url_part(F.regexp_replace(F.col(url), "(?<=[^/:])/+$", ""), p)
    port = part("port")
    reason = (
        F.when(F.col(url).isNull() | ~part("scheme").isin("http", "https"), "scheme")
        .when((part("host") == "") | (part("host") == "[]"), "host")
        .when(part("userinfo") != "", "userinfo")
        .when((part("query") != "") | (part("fragment") != ""), "query or fragment")
        .when((port != "") & ~F.coalesce(port.rlike("^[0-9]{1,5}$") & (port.cast("int") <= 65535), F.lit(False)), "port")
    )
    return df.withColumn("url_reason", reason)


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def allowlist(df: DataFrame, url: str, allowed: DataFrame) -> DataFrame:
    """df with allowed: whether the url has scheme, host and effective port of an allowed one, and its path or one below it, after
    decoding and resolving dots. An empty list allows all but urls with user info, which are never allowed; a null or
    malformed url is allowed by no entry."""
    plain = F.coalesce(url_part(F.col(url), "userinfo") == "", F.lit(True))
    if allowed.isEmpty():
        return df.withColumn("allowed", plain)
    keys = lambda u: (url_part(u, "scheme"), url_part(u, "host"), X.effective_port(u), X.normalize_path(url_part(u, "path")))
    names = ("__s", "__h", "__p", "__path")
    listed = allowed.select(*(k.alias(n) for k, n in zip(keys(F.col("url")), ("s", "h", "p", "root"), strict=True))).distinct()
    # the distinct targets are looked up, not every row
    own = df.where(plain).select(F.col(url).alias("__url")).distinct().select("__url", *(k.alias(n) for k, n in zip(keys(F.col("__url")), names, strict=True)))
    below = (F.col("root") == "/") | (F.col("__path") == F.col("root")) | F.startswith("__path", F.concat("root", F.lit("/")))
    found = own.join(_small(listed), (F.col("__s") == F.col("s")) & (F.col("__h") == F.col("h")) & (F.col("__p") == F.col("p")) & below, "left_semi").select("__url", F.lit(True).alias("__ok"))
    return df.join(found, df[url] == found["__url"], "left").select(*df.columns, F.coalesce("__ok", F.lit(False)).alias("allowed"))


def ipv4_hex(ip: Column) -> Column:
    """An IPv4 address as the fixed-width hex text of its mapped IPv6 form; null if it is none."""
    parts = F.transform(F.split(ip, r"\."), lambda p: F.lpad(F.lower(F.hex(p.cast("int"))), 2, "0"))
    return F.when(ip.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?!$)|$)){4}$"), F.concat(F.lit("0" * 20 + "ffff"), F.array_join(parts, "")))


def ipv6_hex(ip: Column) -> Column:
    """An IPv6 address (without brackets or zone) as 32 hex digits; its last part may be an IPv4 address. Null if it is none."""
    tail = F.regexp_extract(ip, r"([0-9]+(?:\.[0-9]+){3})$", 1)
    four = F.substr(ipv4_hex(tail), F.lit(25))
    plain = F.when(tail == "", ip).otherwise(F.concat(F.regexp_replace(ip, r"[0-9]+(?:\.[0-9]+){3}$", ""), F.left(four, F.lit(4)), F.lit(":"), F.right(four, F.lit(4))))
    groups = lambda t: F.filter(F.split(t, ":", -1), lambda g: g != "")
    halves = F.split(plain, "::", -1)
    left, right = groups(F.get(halves, F.lit(0))), groups(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
    missing = 8 - F.size(left) - F.size(right)
    whole = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)
    shape = plain.rlike(r"^(?:[0-9A-Fa-f]{1,4}:)*(?:[0-9A-Fa-f]{1,4})?(?:::(?:[0-9A-Fa-f]{1,4}:)*(?:[0-9A-Fa-f]{1,4})?)?$") & ~plain.rlike(r"^:[^:]|[^:]:$")
    fits = F.when(F.size(halves) == 1, missing == 0).otherwise((F.size(halves) == 2) & (missing >= 1))
    return F.when(shape & fits & F.contains(plain, F.lit(":")), F.lower(F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), "")))


# Address blocks that are not for the public internet.
RESERVED = """0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.168.0.0/16 198.18.0.0/15
198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 240.0.0.0/4 ::/128 ::1/128 64:ff9b:1::/48 100::/64 2001::/23 2001:db8::/32 2002::/16 fc00::/7 fe80::/10 ff00::/8""".split()


def reserved_ranges(spark: SparkSession, blocks: list[str] = RESERVED) -> DataFrame:
    """(lo, hi, name) of address blocks, as hex text of equal width."""
    rows = []
    for block in blocks:
        net = ipaddress.ip_network(block)
        shift = 0xFFFF << 32 if net.version == 4 else 0
        rows.append((f"{int(net[0]) + shift:032x}", f"{int(net[-1]) + shift:032x}", block))
    return spark.createDataFrame(rows, "lo string, hi string, name string")


def _bounds(ranges: DataFrame) -> tuple[list[str], list[str]]:
    """(first, last) addresses of disjoint ranges, sorted, that cover the same addresses."""
    out: list[list[str]] = []
    for lo, hi in ranges.select(F.lower("lo"), F.lower("hi")).where("lo <= hi").distinct().orderBy("lo", "hi").collect():
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [x[0] for x in out], [x[1] for x in out]


def _inside(ip: Column, ranges: DataFrame) -> Column:
    """Whether an address (hex text) lies in one of the ranges: a binary search in their sorted bounds, which go to the tasks once."""
    first, last = (np.array(x, dtype="U32") for x in _bounds(ranges))

    def search(values: pa.Array) -> pa.Array:
        given = np.array([v or "" for v in values.to_pylist()], dtype="U32")
        at = np.searchsorted(first, given, "right") - 1
        return pa.array((at >= 0) & (given <= last[at]) if len(first) else np.zeros(len(given), bool), pa.bool_())

    search.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(search, "boolean")(ip)


def private_targets(df: DataFrame, url: str, hosts: DataFrame, ranges: DataFrame) -> DataFrame:
    """df with private: whether any address of the url's host lies in a reserved range. A host that is an address stands for
    itself; a host without a known address counts as private.

    hosts: host, ip (hex text); ranges: lo, hi (hex text of equal width), at most BROADCAST_ROWS of them, or ValueError. Distinct hosts are
    shuffled once and meet their addresses and verdict where they are; the table is shuffled once to get them.
    """
    if ranges.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        raise ValueError(f"more than {BROADCAST_ROWS} ranges: merge them first")
    host = url_part(F.col(url), "host")
    targets = df.select(host.alias("__host")).distinct()
    plain = F.regexp_replace("__host", r"^\[|\]$|%[^\]]*(?=\]$)", "")
    known = targets.join(hosts.select(F.lower("host").alias("__host"), F.lower("ip").alias("ip")), "__host", "left")
    known = known.select("__host", F.coalesce(ipv4_hex(F.col("__host")), ipv6_hex(plain), "ip").alias("ip"))
    judged = known.select("__host", (F.col("ip").isNull() | _inside(F.col("ip"), ranges)).alias("bad")).groupBy("__host").agg(F.bool_or("bad").alias("private"))
    return df.withColumn("__host", host).join(judged, "__host", "left").select(*df.columns, F.coalesce("private", F.lit(True)).alias("private"))
