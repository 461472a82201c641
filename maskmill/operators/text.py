"""Redaction and scanning of text columns, and the reports made from their hits.

The fold runs in Arrow batches: each rule counts and replaces in what the rule before it left, and its pattern runs only on texts
that hold one of its literals. (As a chain of Spark's own regular expressions it took about twice as long, and filters or joins
above such a chain kept the optimizer busy without end.) Null texts stay null with no hits.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskmill.functions.columns import hits, may_match
from maskmill.functions.pyrules import Redactor
from maskmill.functions.rules import AUDIT, DEFAULT, Policy, Rule, custom_rules, rule_reason

_FOUND = "struct<text:string,redactions:bigint,rule_hits:map<string,bigint>>"


def hit_counts(found: list[Counter]) -> pa.Array:
    """The hits of each row as an Arrow map."""
    ends = np.cumsum([0, *map(len, found)])
    names, counts = [name for f in found for name in f], [n for f in found for n in f.values()]
    return pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(names, pa.string()), pa.array(counts, pa.int64()))


def _found(texts: list, found: list[Counter]) -> pa.Array:
    totals = pa.array([f.total() for f in found], pa.int64())
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()), totals, hit_counts(found)], ["text", "redactions", "rule_hits"])


def folded_text(text: Column, policy: Policy = DEFAULT) -> Column:
    """struct<text, redactions, rule_hits> of a text. Not computed twice where it is used twice."""

    def scan(values: pa.Array) -> pa.Array:
        redactor, given = Redactor(policy), values.to_pylist()
        found = [Counter() for _ in given]
        return _found([None if value is None else redactor.text(value, hits) for value, hits in zip(given, found, strict=True)], found)

    scan.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(scan, _FOUND).asNondeterministic()(text)


def _fold(df: DataFrame, col: str, policy: Policy) -> DataFrame:
    """df with the fold's result in __mm."""
    return df.withColumn("__mm", folded_text(F.col(col), policy))


def text_source(df: DataFrame, id_col: str, col: str) -> DataFrame:
    """(row_id, text) of any table."""
    return df.select(F.col(id_col).alias("row_id"), F.col(col).cast("string").alias("text"))


def redact_text(df: DataFrame, col: str = "text", policy: Policy = DEFAULT) -> DataFrame:
    """df with col redacted."""
    if not policy.fold:
        return df
    return _fold(df, col, policy).select(*(F.col("__mm.text").alias(c) if c == col else F.col(c) for c in df.columns))


def scan_text(df: DataFrame, col: str = "text", policy: Policy = DEFAULT) -> DataFrame:
    """df with col redacted, redactions (all hits) and rule_hits (hits of each rule that has some)."""
    rest = [F.col("__mm.text").alias(c) if c == col else F.col(c) for c in df.columns if c not in ("redactions", "rule_hits")]
    return _fold(df, col, policy).select(*rest, "__mm.redactions", "__mm.rule_hits")


def long_hits(scanned: DataFrame, *keys: str) -> DataFrame:
    """(keys, rule, hits) of a scanned table, a row for each rule that hit."""
    return scanned.select(*keys, F.explode("rule_hits").alias("rule", "hits"))


def has_secret(df: DataFrame, col: str = "text", policy: Policy = DEFAULT) -> DataFrame:
    """The rows with at least one hit."""
    return _fold(df, col, policy).where("__mm.redactions > 0").drop("__mm")


def audit_scan(df: DataFrame, col: str = "text") -> DataFrame:
    """scan_text by the rules that hardly ever err, for the history of a repository."""
    return scan_text(df, col, Policy(builtin=AUDIT))


def rule_overlap(df: DataFrame, col: str = "text", policy: Policy = DEFAULT) -> DataFrame:
    """(rule, raw_hits, chained_hits): hits of each rule on the texts as they were, and in the fold, over all rows."""
    out = _fold(df.select(F.col(col).alias("raw")), "raw", policy)
    raw = [F.sum(F.when(may_match(F.col("raw"), r), hits(F.col("raw"), r)).otherwise(0)).alias(f"r{i}") for i, r in enumerate(policy.fold)]
    kept = [F.sum(F.col("__mm.rule_hits")[r.name]).alias(f"c{i}") for i, r in enumerate(policy.fold)]
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    rows = [F.struct(F.lit(r.name).alias("rule"), count(F.col(f"r{i}")).alias("raw_hits"), count(F.col(f"c{i}")).alias("chained_hits")) for i, r in enumerate(policy.fold)]
    return out.agg(*raw, *kept).select(F.inline(F.array(*rows)))


def rule_attribution(df: DataFrame, col: str = "text", policy: Policy = DEFAULT) -> DataFrame:
    """(taker, loser, n): how many matches of the rule loser, found in the texts as they were, an earlier rule took.

    A sweep over the spans that each rule would mask, in fold order: a span free of earlier ones is its rule's own; one that meets
    a span already taken is lost to the first rule, in fold order, that holds part of it. Context rules take only what they mask.
    Null texts have no spans; counts are summed in each batch before the shuffle.
    """

    def count(batches):
        redactor, lost = Redactor(policy), Counter()
        names = [r.name for r, _ in redactor.rules]
        for batch in batches:
            for value in batch.column(0).to_pylist():
                lost.update(_lost_spans(redactor.spans(value)) if value else ())
        if lost:
            pairs, n = zip(*lost.items(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i, _ in pairs]), pa.array([names[j] for _, j in pairs]), pa.array(n, pa.int64())], ["taker", "loser", "n"])

    found = df.select(F.col(col).cast("string")).mapInArrow(count, "taker string, loser string, n long")
    return found.groupBy("taker", "loser").agg(F.sum("n").alias("n"))


def _lost_spans(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(taker, loser) of spans (rule, start, end) in fold order; a rule's own spans do not overlap."""
    starts, taken, out = [], [], []  # disjoint spans (start, end, rule) by start
    for rule, start, end in spans:
        at = bisect_right(starts, start)
        first = at - 1 if at and taken[at - 1][1] > start else at
        last = bisect_left(starts, end)
        if first < last:
            out.append((min(t[2] for t in taken[first:last]), rule))
        else:
            starts.insert(at, start)
            taken.insert(at, (start, end, rule))
    return out


def _named_digest(rule: str, digest: Callable[[Column], Column]):
    return lambda m: F.struct(F.lit(rule).alias("rule"), digest(m).alias("digest"))


def _replaced(state: Column, value: Column, placeholder: str) -> Column:
    """struct<t, n> with the value replaced in t; n grows by how often."""
    n = ((F.length(state["t"]) - F.length(F.replace(state["t"], value, F.lit("")))) / F.length(value)).cast("long")
    return F.struct(F.replace(state["t"], value, F.lit(placeholder)).alias("t"), (state["n"] + n).alias("n"))


def line_detect(df: DataFrame, col: str, detectors: dict[str, str], policy: Policy = DEFAULT, eager: dict[str, str] | None = None) -> DataFrame:
    """df with what detectors (name: pattern) find in single lines replaced everywhere in the text, redactions and rule_hits.

    All values are found in the text as it was, line by line, then replaced in that order. A value with commas is split first: its parts,
    trimmed of white space and quotes, are replaced; if none occurs, the whole is. eager: detectors that look at a text only if
    the others find nothing in it. Each value counts as often as it is replaced; hits go to detect:<name>. Null and blank texts
    stay as they are.
    """
    names = list(detectors) + list(eager or {})
    lines = F.split(F.col(col), r"\r\n|\n|\r", -1)

    def finds(some: dict[str, str], first: int) -> Column:
        each = lambda i, pattern: lambda line: F.transform(F.regexp_extract_all(line, F.lit("(?U)" + pattern), F.lit(0)), lambda v: F.struct(F.lit(i).alias("i"), v.alias("v")))
        found = lambda line: F.concat(*(each(first + k, p)(line) for k, p in enumerate(some.values())))
        return F.filter(F.flatten(F.transform(lines, found)), lambda f: f["v"] != "")

    def step(acc: Column, found: Column) -> Column:
        value, start = found["v"], F.struct(acc["t"].alias("t"), F.lit(0).cast("long").alias("n"))
        trimmed = lambda v: F.regexp_replace(F.regexp_replace(v, r"(?U)^\s+|\s+$", ""), "^[\"']+|[\"']+$", "")
        parts = F.filter(F.transform(F.split(value, ","), trimmed), lambda p: p != "")
        done = F.when(~F.contains(value, F.lit(",")), _replaced(start, value, policy.placeholder)).otherwise(
            F.get(F.transform(F.array(F.aggregate(parts, start, lambda s, p: _replaced(s, p, policy.placeholder))), lambda d: F.when(d["n"] > 0, d).otherwise(_replaced(d, value, policy.placeholder))), F.lit(0))
        )
        return F.get(F.transform(F.array(done), lambda d: F.struct(d["t"].alias("t"), F.transform(acc["h"], lambda h, i: F.when(i == found["i"], h + d["n"]).otherwise(h)).alias("h"))), F.lit(0))

    out = df.withColumn("__mm_found", F.when(F.rlike(F.col(col), F.lit(r"(?U)\S")), finds(detectors, 0)))
    if eager:
        out = out.withColumn("__mm_found", F.when(F.size("__mm_found") == 0, finds(eager, len(detectors))).otherwise(F.col("__mm_found")))
    none = F.array(*(F.lit(0).cast("long") for _ in names))
    out = out.withColumn("__mm", F.aggregate("__mm_found", F.struct(F.col(col).alias("t"), none.alias("h")), step))
    counts = F.coalesce("__mm.h", none)
    rest = [F.coalesce("__mm.t", F.col(col)).alias(c) if c == col else F.col(c) for c in df.columns if c not in ("redactions", "rule_hits")]
    labels = F.array(*(F.lit(f"detect:{n}") for n in names))
    return out.select(*rest, F.aggregate(counts, F.lit(0).cast("long"), lambda a, h: a + h).alias("redactions"), F.map_filter(F.map_from_arrays(labels, counts), lambda _k, v: v > 0).alias("rule_hits"))


def merge_stats(hits_: DataFrame, *by: str) -> DataFrame:
    """(by, rule, hits): sums of long-form hits over any grouping."""
    return hits_.groupBy(*by, "rule").agg(F.sum("hits").alias("hits"))


def audit_events(scanned: DataFrame, path: str = "path", ts: Column | None = None) -> DataFrame:
    """ts, event, path, redactions, rules of each path with hits; the values themselves are never in it."""
    per_rule = merge_stats(long_hits(scanned, path), path)
    rules = F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule", "hits"))))
    out = per_rule.groupBy(F.col(path).alias("path")).agg(F.sum("hits").alias("redactions"), rules.alias("rules"))
    return out.select((F.current_timestamp() if ts is None else ts).alias("ts"), F.lit("redaction").alias("event"), "path", "redactions", "rules")


def audit_rollup(hits_: DataFrame) -> DataFrame:
    """(path, rule, hits) with subtotals (rule null) and the total (both null)."""
    return hits_.rollup("path", "rule").agg(F.sum("hits").alias("hits"))


def top_rules(hits_: DataFrame, k: int, key: str = "rule") -> DataFrame:
    """The k rules, or other keys, with the most hits; ties to the smaller key."""
    return hits_.groupBy(key).agg(F.sum("hits").alias("hits")).orderBy(F.desc("hits"), key).limit(k)


def rule_coverage(hits_: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(rule, hits) of every rule, 0 included."""
    names = hits_.sparkSession.createDataFrame([(r.name,) for r in rules], "rule string").distinct()
    return names.join(merge_stats(hits_), "rule", "left").select("rule", F.coalesce("hits", F.lit(0)).alias("hits"))


def leak_check(redacted: DataFrame, col: str, originals: DataFrame, value_col: str, key: str) -> DataFrame:
    """Rows whose redacted text still holds the known value of the same key: none, if all is well."""
    known = originals.select(F.col(key), F.col(value_col).alias("__mm_value")).where(F.length("__mm_value") > 0)
    return redacted.join(known, key).where(F.contains(F.col(col), F.col("__mm_value"))).drop("__mm_value")


#: Known values are found by windows of so many bytes at their end (all of a shorter value), looked up in a filter of words of 64 bits,
#: so many of them at least and at most (0.5 and 64 MB), and about one for eight values between. Bytes of text looked at in one go.
WINDOW, FILTER_WORDS, VALUES_PER_WORD, PIECE = 8, (1 << 16, 1 << 23), 8, 1 << 22
_MULT = 0x9E3779B97F4A7C15
#: The bits of a hash that name the four bits it has in its word.
_BITS_AT = (28, 34, 40, 46)


def _mixed(parts, n: int) -> np.ndarray:
    """n hashes, of the bytes that parts hold one after the other."""
    out = np.zeros(n, np.uint64)
    for part in parts:
        out = (out ^ part) * np.uint64(_MULT)
        out ^= out >> np.uint64(29)
    return out


def _windows(data: np.ndarray, size: int) -> np.ndarray:
    """The hash of each window of so many bytes."""
    n = max(len(data) - size + 1, 0)
    return _mixed((data[j : j + n] for j in range(size)), n)


def _bytes_of(values: pa.Array) -> tuple[bytes, np.ndarray]:
    """The texts of an array in one, and where each begins and the last ends; nulls are empty."""
    each = [v or b"" for v in values.cast(pa.binary()).to_pylist()]
    return b"".join(each), np.cumsum([0, *map(len, each)])


def _filter_words(values: int) -> int:
    """A power of two: the fewest words that hold so many values, within the bounds."""
    least, most = FILTER_WORDS
    return min(max(least, 1 << max(-(-values // VALUES_PER_WORD) - 1, 0).bit_length()), most)


def _value_ends(batches):
    """(value, size, hash) of known values: the hash is that of the last WINDOW bytes."""
    for batch in batches:
        raw, at = _bytes_of(batch.column(0))
        data, sizes = np.frombuffer(raw, np.uint8).astype(np.uint64), np.minimum(np.diff(at), WINDOW)
        found = np.zeros(batch.num_rows, np.uint64)
        for size in np.unique(sizes):
            own = np.flatnonzero(sizes == size)
            found[own] = _mixed((data[at[own + 1] - size + j] for j in range(size)), len(own))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(found.astype(np.int64))], ["value", "size", "hash"])


def corpus_leaks(df: DataFrame, key: str, col: str, values: DataFrame, value_col: str) -> DataFrame:
    """(key, digest, n): which rows of a table hold which of the known values, wherever these come from, and how often.

    The texts' windows of bytes are looked up in a filter of the values' ends, which grows with the number of values up to 64 MB (of 64
    million values one window in thirty passes by chance); only windows that pass are rows, joined with the values by their hash
    and compared in full. So no value meets a text that does not hold its end. Values are named by the first 8 characters of their
    digest, and told apart in full. Overlapping places count one by one. Null and empty values and null texts are found nowhere;
    rows that repeat a key are counted together.
    """
    spark = df.sparkSession
    given = values.select(F.col(value_col).cast("string").alias("value")).where(F.length("value") > 0)
    wanted = given.distinct().mapInArrow(_value_ends, "value string, size int, hash long")
    words = _filter_words(given.count())
    one = " | ".join(f"shiftleft(1L, cast(shiftrightunsigned(hash, {b}) & 63 AS int))" for b in _BITS_AT)
    bits = wanted.groupBy((F.col("hash").bitwiseAND(words - 1)).alias("word"), "size").agg(F.bit_or(F.expr(one)).alias("mask"), F.max(F.octet_length("value")).alias("longest")).toPandas()
    table, sizes, longest = np.zeros(words, np.uint64), [int(x) for x in sorted(set(bits["size"]))], int(bits["longest"].max()) if len(bits) else 0
    np.bitwise_or.at(table, bits["word"].to_numpy(np.int64), bits["mask"].to_numpy(np.int64).astype(np.uint64))
    held = spark.sparkContext.broadcast(table)

    def places(batches):
        table = held.value
        for batch in batches:
            whole, ends, first = *_bytes_of(batch.column(1)), 0
            while first < batch.num_rows:
                n = max(1, int(np.searchsorted(ends, ends[first] + PIECE, "right")) - 1 - first)
                raw, at = whole[ends[first] : ends[first + n]], ends[first : first + n + 1] - ends[first]
                data = np.frombuffer(raw, np.uint8).astype(np.uint64)
                for size in sizes:
                    found = _windows(data, size)
                    mask = np.zeros(len(found), np.uint64)
                    for b in _BITS_AT:
                        mask |= np.uint64(1) << ((found >> np.uint64(b)) & np.uint64(63))
                    begin = np.flatnonzero((table[(found & np.uint64(len(table) - 1)).astype(np.int64)] & mask) == mask)
                    row = np.searchsorted(at[1:], begin, "right")
                    inside = begin + size <= at[row + 1]  # a window that ends in the next text is none
                    begin, row = begin[inside], row[inside]
                    cuts = zip(np.maximum(at[row], begin + size - longest).tolist(), (begin + size).tolist(), strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(first + row)), pa.array(np.full(len(row), size), pa.int32()), pa.array(found[begin].astype(np.int64)), pa.array([raw[x:y] for x, y in cuts], pa.binary())],
                        ["k", "size", "hash", "before"],
                    )
                first += n

    kind = df.schema[key].dataType.simpleString()
    near = df.select(F.col(key).alias("k"), F.col(col).cast("string").alias("t")).mapInArrow(places, f"k {kind}, size int, hash long, before binary")
    met = near.join(wanted, ["size", "hash"]).where(F.endswith(F.col("before"), F.col("value").cast("binary")))
    full = met.groupBy("k", "value").agg(F.count("*").alias("n"))
    return full.select(F.col("k").alias(key), F.left(F.sha2("value", 256), F.lit(8)).alias("digest"), "n")


def secret_reuse(df: DataFrame, key: str, col: str, rules: tuple[Rule, ...] = AUDIT, digest: Callable[[Column], Column] = lambda m: F.sha2(m, 256), sketch: bool = False) -> DataFrame:
    """(digest, rule, rows): secrets that more than one row holds, told apart by their whole digest, shown by its first 8 characters.
    sketch adds rows_sketch, a mergeable sketch of the rows' keys, from which the rows of several tables or days are counted
    together (hll_union_agg, hll_sketch_estimate). Null texts hold nothing; rows that repeat a key count once."""
    found = [F.transform(F.when(may_match(F.col(col), r), F.regexp_extract_all(col, F.lit(r.java), F.lit(0))).otherwise(F.array().cast("array<string>")), _named_digest(r.name, digest)) for r in rules]
    each = df.select(F.col(key).alias("k"), F.explode(F.concat(*found)).alias("m"))
    more = [F.hll_sketch_agg(F.col("k").cast("string")).alias("rows_sketch")] if sketch else []
    counted = each.groupBy("m.digest", "m.rule").agg(F.count_distinct("k").alias("rows"), *more).where(F.col("rows") > 1)
    return counted.withColumn("digest", F.left("digest", F.lit(8)))


def redaction_sample(df: DataFrame, col: str, n: int, policy: Policy = DEFAULT) -> DataFrame:
    """df's other columns, raw and redacted text cut at n characters, and whether each was cut."""
    rest = [c for c in df.columns if c != col]
    done = F.col("__mm.text")
    return _fold(df, col, policy).select(
        *rest, F.left(F.col(col), F.lit(n)).alias("raw"), (F.length(col) > n).alias("raw_cut"), F.left(done, F.lit(n)).alias("redacted"), (F.length(done) > n).alias("redacted_cut")
    )


def sample_by_reason(judged: DataFrame, key: str, raw: str, done: str, n: int, k: int) -> DataFrame:
    """(key, reject_reason, raw, raw_cut, redacted, redacted_cut): for each reject reason, and for rows without one, the k rows of the
    smallest key, their texts cut at n characters. judged has the texts before and after (null for a rejected row) and
    reject_reason. Each task keeps k rows a reason before the shuffle, whatever a reason's share; null keys come last."""
    order = Window.partitionBy("reject_reason").orderBy(F.asc_nulls_last(key), raw)
    few = judged.withColumn("__mm_n", F.row_number().over(order)).where(F.col("__mm_n") <= k)
    cut = lambda c, name: (F.left(F.col(c), F.lit(n)).alias(name), (F.length(c) > n).alias(f"{name}_cut"))
    return few.select(key, "reject_reason", *cut(raw, "raw"), *cut(done, "redacted"))


#: Own rules of one tenant: more, or longer ones, are refused.
MAX_RULES, MAX_RULE_CHARS, SALTS = 20, 1024, 32
#: Rules of all tenants above this number (10 MB at most) are joined by a shuffle, not broadcast.
BROADCAST_RULES = 10_000


def tenant_rules(rules: DataFrame, allow_regex: bool = False) -> DataFrame:
    """rules (tenant, ord, type, value, name) with reason: why a rule is refused, or null. Regex rules are refused unless
    the policy allows them (they may run away), and all rules of a tenant that has more than MAX_RULES."""

    def why(kind: pa.Array, value: pa.Array, name: pa.Array) -> pa.Array:
        return pa.array([rule_reason(*r) for r in zip(kind.to_pylist(), value.to_pylist(), name.to_pylist(), strict=True)], pa.string())

    why.__annotations__ = {"kind": pa.Array, "value": pa.Array, "name": pa.Array, "return": pa.Array}
    many = rules.groupBy("tenant").agg(F.count("*").alias("__mm_many"))
    reason = (
        F.when(F.col("tenant").isNull(), "no tenant").when(F.col("__mm_many") > MAX_RULES, "too many rules").when(F.length("value") > MAX_RULE_CHARS, "rule too long")
        .when(F.lit(not allow_regex) & (F.col("type") == "regex"), "regex not allowed").otherwise(F.col("__mm_why"))
    )
    judged = rules.withColumn("__mm_why", F.arrow_udf(why, "string")("type", "value", "name"))
    return judged.join(many, "tenant", "left").select(*rules.columns, reason.alias("reason"))


def scan_per_tenant(df: DataFrame, col: str, key: str, rules: DataFrame, policy: Policy = DEFAULT, allow_regex: bool = False) -> DataFrame:
    """df with col redacted, redactions and rule_hits: each row's own rules first, in their order, then the policy's.

    rules: tenant, ord, type, value, name, as for custom rules; tenant_rules says which are refused, and these are left out. A tenant's
    rules, at most MAX_RULES, travel as one array, broadcast if all tenants have at most BROADCAST_RULES, else dealt over SALTS tasks
    for a tenant that many rows have, and are compiled once a batch and tenant. Tenants without rules, and null tenants, get the policy alone; null texts stay null.
    """
    usable = tenant_rules(rules, allow_regex).where("reason IS NULL")
    own = usable.groupBy("tenant").agg(F.array_sort(F.collect_list(F.struct("ord", "type", "value", "name"))).alias("__mm_rules"))
    named = own.withColumnsRenamed({"tenant": "__mm_tenant"})
    if usable.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:  # the rows stay as they are dealt
        joined = df.join(F.broadcast(named), F.col(key) == F.col("__mm_tenant"), "left")
    else:
        dealt = named.withColumn("__mm_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
        salted = df.withColumn("__mm_salt", F.pmod(F.xxhash64(col), F.lit(SALTS)))
        joined = salted.join(dealt, (F.col(key) == F.col("__mm_tenant")) & (salted["__mm_salt"] == dealt["__mm_salt"]), "left")

    def scan(texts: pa.Array, rules_: pa.Array) -> pa.Array:
        redactors: dict = {}
        done, found = [], []
        for value, specs in zip(texts.to_pylist(), rules_.to_pylist(), strict=True):
            name = tuple(tuple(r.values()) for r in specs or ())
            if name not in redactors:
                redactors[name] = Redactor(replace(policy, rules=custom_rules(specs or []) + policy.rules))
            found.append(Counter())
            done.append(None if value is None else redactors[name].text(value, found[-1]))
        return _found(done, found)

    scan.__annotations__ = {"texts": pa.Array, "rules_": pa.Array, "return": pa.Array}
    found = joined.withColumn("__mm", F.arrow_udf(scan, _FOUND).asNondeterministic()(F.col(col), F.col("__mm_rules")))
    rest = [F.col("__mm.text").alias(c) if c == col else F.col(c) for c in df.columns if c not in ("redactions", "rule_hits")]
    return found.select(*rest, "__mm.redactions", "__mm.rule_hits")


def redact_per_tenant(df: DataFrame, col: str, key: str, rules: DataFrame, policy: Policy = DEFAULT, allow_regex: bool = False) -> DataFrame:
    """scan_per_tenant without the hits."""
    return scan_per_tenant(df, col, key, rules, policy, allow_regex).select(*(c for c in df.columns if c not in ("redactions", "rule_hits")))
