"""Redaction by field name and content: typed nested columns, free-form JSON, message lists, records and bytes."""

from __future__ import annotations

import json
from collections import Counter
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskmill.functions.columns import classify_key, mask_field, redacted
from maskmill.functions.pyrules import Redactor
from maskmill.functions.rules import DEFAULT, Policy

from .text import hit_counts, long_hits, merge_stats, sample_by_reason, scan_text

_NUMBERS = (T.IntegralType, T.FractionalType, T.DecimalType)


def _holds_named_map(kind: T.DataType) -> bool:
    """Whether keys may collide somewhere in values of this type."""
    if isinstance(kind, T.MapType):
        return isinstance(kind.keyType, T.StringType) or _holds_named_map(kind.valueType)
    if isinstance(kind, T.StructType):
        return any(_holds_named_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.ArrayType) and _holds_named_map(kind.elementType)


def _let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _checked(value: Column, kind: T.DataType, policy: Policy, under: Column) -> Column:
    """struct<v, bad>: the redacted value, and whether keys of some map in it became equal (then that map is null)."""
    if not _holds_named_map(kind):
        return F.struct(_leaf_tree(value, kind, policy, under).alias("v"), F.lit(False).alias("bad"))
    some = lambda rows: F.coalesce(F.exists(rows, lambda r: r["bad"]), F.lit(False))
    if isinstance(kind, T.ArrayType):
        each = F.transform(value, lambda x: _checked(x, kind.elementType, policy, under))
        return _let(each, lambda rows: F.struct(F.transform(rows, lambda r: r["v"]).alias("v"), some(rows).alias("bad")))
    if isinstance(kind, T.StructType):
        fields = F.struct(*(_checked(value[f.name], f.dataType, policy, _class_under(f.name, under)).alias(f"f{i}") for i, f in enumerate(kind.fields)))
        whole = lambda s: F.struct(*(s[f"f{i}"]["v"].alias(f.name) for i, f in enumerate(kind.fields)))
        bad = lambda s: reduce(lambda x, y: x | y, (s[f"f{i}"]["bad"] for i in range(len(kind.fields))))
        return _let(fields, lambda s: F.struct(F.when(value.isNotNull(), whole(s)).alias("v"), bad(s).alias("bad")))
    named = isinstance(kind.keyType, T.StringType)

    def entry(e: Column) -> Column:
        def of_class(c: Column) -> Column:
            return F.struct((redacted(e["key"], policy) if named else e["key"]).alias("k"), _checked(e["value"], kind.valueType, policy, c).alias("r"))

        return _let(F.when(under != "normal", under).otherwise(classify_key(e["key"])), of_class) if named else of_class(under)

    def together(rows: Column) -> Column:
        keys = F.transform(rows, lambda r: r["k"])
        own = F.coalesce(F.size(F.array_distinct(keys)) < F.size(keys), F.lit(False))
        whole = F.when(~own, F.map_from_arrays(keys, F.transform(rows, lambda r: r["r"]["v"])))
        return F.struct(whole.alias("v"), (own | F.coalesce(F.exists(rows, lambda r: r["r"]["bad"]), F.lit(False))).alias("bad"))

    return _let(F.transform(F.map_entries(value), entry), together)


def _leaf_tree(value: Column, kind: T.DataType, policy: Policy, under: Column) -> Column:
    """A redacted value of a type in which no keys can collide."""
    if isinstance(kind, T.StringType):
        return F.when(under == "normal", redacted(value, policy)).otherwise(mask_field(value, "string", under, policy.placeholder))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _leaf_tree(x, kind.elementType, policy, under))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(_leaf_tree(value[f.name], f.dataType, policy, _class_under(f.name, under)).alias(f.name) for f in kind.fields)))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _k, v: _leaf_tree(v, kind.valueType, policy, under))
    return F.when(under != "strict", value) if isinstance(kind, _NUMBERS) else value


def _class_under(name: str, under: Column) -> Column:
    """The class of what lies below a struct's field: that of the outermost sensitive name."""
    found = Redactor(Policy(builtin=())).key_class(name)
    return under if found == "normal" else F.when(under != "normal", under).otherwise(found)


def checked(value: Column, kind: T.DataType, policy: Policy = DEFAULT) -> Column:
    """struct<v, bad> of a typed value, built at plan time: the redacted value, and whether map keys collide at any depth.

    Struct fields and map keys are classified by name. Below a sensitive one all strings are masked whole, by the outermost one's class;
    numbers and other typed scalars keep their type and value (a typed column cannot hold the placeholder), except that a
    number below a strict field becomes null. Null values stay null. Each entry is bound once and its class goes down as
    a value, so the expression grows with the type, not with the number of classes at each level.
    """
    if not policy.enabled:
        return F.struct(value.alias("v"), F.lit(False).alias("bad"))
    return _checked(value, kind, policy, F.lit("normal"))


def nested(value: Column, kind: T.DataType, policy: Policy = DEFAULT) -> Column:
    """The redacted column of a typed value; keys that collide are an error of the job."""
    if not policy.enabled or not _holds_named_map(kind):
        return checked(value, kind, policy)["v"]
    return _let(checked(value, kind, policy), lambda c: F.when(c["bad"], F.raise_error(F.lit("map keys collide after redaction")).cast(kind)).otherwise(c["v"]))


def redact_nested(df: DataFrame, col: str, policy: Policy = DEFAULT) -> DataFrame:
    """df with a typed nested column redacted. Rows whose map keys would collide fail the job: nested_or_reject sets them apart."""
    return df.withColumn(col, nested(F.col(col), df.schema[col].dataType, policy))


def nested_or_reject(df: DataFrame, col: str, policy: Policy = DEFAULT) -> DataFrame:
    """df with a typed nested column redacted, and reject_reason: 'colliding keys' where map keys at any depth become equal (then col is
    null), else null. Null values are no rejects."""
    rest = [c for c in df.columns if c not in (col, "reject_reason")]
    done = df.select(*rest, checked(F.col(col), df.schema[col].dataType, policy).alias("__mm"))
    names = {c: F.col(c) for c in rest} | {col: F.when(~F.col("__mm.bad"), F.col("__mm.v")).alias(col)}
    return done.select(*(names[c] for c in df.columns if c in names), F.when(F.col("__mm.bad"), "colliding keys").alias("reject_reason"))


def key_collisions(df: DataFrame, col: str, policy: Policy = DEFAULT) -> DataFrame:
    """df with collides: whether keys of a map in col, at any depth, become equal. Null values do not collide."""
    return df.withColumn("collides", checked(F.col(col), df.schema[col].dataType, policy)["bad"])


class _Number(str):
    """A JSON number as it is written."""


def _leaves(body: str, redactor: Redactor):
    """(path, key, value, class) of the scalars of a JSON text, in order; none if it is malformed."""
    try:
        tree = json.loads(body, parse_int=_Number, parse_float=_Number, parse_constant=_Number)
    except ValueError:
        return
    except RecursionError:
        yield "$", None, body, "normal"
        return
    open_ = [("$", None, tree, "normal")]
    while open_:
        path, key, value, kind = open_.pop()
        if isinstance(value, dict):
            inner = [(f"{path}.{k}", k, v, redactor.key_class(k) if kind == "normal" else kind) for k, v in value.items()]
        elif isinstance(value, list):
            inner = [(f"{path}[{i}]", key, v, kind) for i, v in enumerate(value)]
        else:
            yield path, key, {None: None, True: "true", False: "false"}.get(value, value) if not isinstance(value, str) else str(value), kind
            continue
        open_ += reversed(inner)


def payload_leaves(df: DataFrame, id_col: str, col: str) -> DataFrame:
    """(row_id, path, key, value, key_class) of the scalars in a JSON text column, at any depth, in one pass; key_class is that of the
    outermost sensitive key, key that of the innermost one.

    Malformed or null JSON has no leaves; a scalar at the top has path $ and no key; of repeated keys the last counts. Numbers
    are as written, null is null. What nests too deep to be read is one leaf with the whole text, so nothing is lost.
    """

    def make(batches):
        redactor = Redactor(Policy(builtin=()))
        names = ["row_id", "path", "key", "value", "key_class"]
        for batch in batches:
            at, rows = [], []
            for i, body in enumerate(batch.column(1).to_pylist()):
                found = list(_leaves(body, redactor)) if body is not None else []
                at += [i] * len(found)
                rows += found
                if len(rows) >= 50_000 or i == batch.num_rows - 1:
                    cols = list(zip(*rows, strict=True)) if rows else [()] * 4
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, pa.string()) for c in cols)], names)
                    at, rows = [], []

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("row_id"), F.col(col).cast("string").alias("body")).mapInArrow(make, f"row_id {kind}, path string, key string, value string, key_class string")


def redact_json(df: DataFrame, col: str, policy: Policy = DEFAULT) -> DataFrame:
    """df with a JSON text column redacted, redactions, rule_hits and reject_reason (malformed, colliding keys, too deep: then col
    is null). Key order stays, of repeated keys the last counts, the output is compact ASCII. Null stays null."""
    rest = [c for c in df.columns if c not in (col, "redactions", "rule_hits", "reject_reason")]
    keyed = df.select(F.struct(F.lit(0).alias("c"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(rest))).alias("row"), F.col(col).alias("body"))

    def make(batches):
        redactor = Redactor(policy)
        for batch in batches:
            done = [redactor.json(b) if b is not None else (None, Counter(), None) for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([d[0] for d in done], pa.string()), pa.array([sum(d[1].values()) for d in done], pa.int64()), hit_counts([d[1] for d in done]), pa.array([d[2] for d in done], pa.string())],
                ["row", "body", "redactions", "rule_hits", "reject_reason"],
            )

    kind = f"row {keyed.schema['row'].dataType.simpleString()}, body string, redactions long, rule_hits map<string,long>, reject_reason string"
    out = keyed.mapInArrow(make, kind)
    names = {c: F.col("row")[f"c{i}"] for i, c in enumerate(rest)} | {col: F.col("body")}
    return out.select(*(names[c].alias(c) for c in df.columns if c in names), "redactions", "rule_hits", "reject_reason")


def redact_binary(df: DataFrame, col: str, policy: Policy = DEFAULT) -> DataFrame:
    """df with a binary column redacted; bytes that are not UTF-8 survive, null stays."""

    @F.pandas_udf(T.BinaryType())
    def change(values):
        redactor = Redactor(policy)
        return values.map(lambda b: redactor.data(bytes(b))[0], na_action="ignore")

    return df.withColumn(col, change(F.col(col)))


def _content_redacted(kind: T.DataType, policy: Policy):
    return lambda m: m.withField("content", nested(m["content"], kind, policy))


def redact_messages(df: DataFrame, col: str = "messages", policy: Policy = DEFAULT) -> DataFrame:
    """df with a message list redacted: an array of structs, of which content is redacted, or of (role, text) pairs as arrays, of
    which the second is. Other fields of a message stay."""
    element = df.schema[col].dataType.elementType
    if isinstance(element, T.ArrayType):
        return df.withColumn(col, F.transform(col, lambda m: F.when(F.size(m) == 2, F.array(m[0], redacted(m[1], policy))).otherwise(F.transform(m, lambda x: redacted(x, policy)))))
    if "content" not in element.names:
        return redact_nested(df, col, policy)
    return df.withColumn(col, F.transform(col, _content_redacted(element["content"].dataType, policy)))


def scan_messages(df: DataFrame, conversation: str = "conv_id", col: str = "text", policy: Policy = DEFAULT) -> DataFrame:
    """(conversation, turns, redactions) of a table with one row a turn."""
    return scan_text(df, col, policy).groupBy(conversation).agg(F.count("*").alias("turns"), F.sum("redactions").alias("redactions"))


def message_hits(df: DataFrame, conversation: str = "conv_id", col: str = "text", policy: Policy = DEFAULT) -> DataFrame:
    """(conversation, rule, hits) of a table with one row a turn."""
    return merge_stats(long_hits(scan_text(df.select(conversation, col), col, policy), conversation), conversation)


def scan_message_lists(df: DataFrame, col: str = "messages", policy: Policy = DEFAULT) -> DataFrame:
    """redact_messages with redactions and rule_hits of each list: of structs the content counts, of (role, text) pairs the text. Null
    and empty lists have no hits."""
    element = df.schema[col].dataType.elementType
    if isinstance(element, T.ArrayType):
        said = F.transform(col, lambda m: F.when(F.size(m) == 2, F.slice(m, 2, 1)).otherwise(m))
    else:
        said = F.transform(col, lambda m: m["content"]) if "content" in element.names else F.col(col)
    return redact_messages(_scanned(df, F.to_json(said), policy), col, policy)


def redact_params(df: DataFrame, col: str = "params", policy: Policy = DEFAULT) -> DataFrame:
    """df with a struct of call parameters redacted: messages as a message list, other fields as payloads. The parameters' own
    names are not classified."""
    kind = df.schema[col].dataType
    fields = []
    for f in kind.fields:
        value = F.col(col)[f.name]
        if f.name == "messages" and isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType) and "content" in f.dataType.elementType.names:
            value = F.transform(value, _content_redacted(f.dataType.elementType["content"].dataType, policy))
        else:
            value = nested(value, f.dataType, policy)
        fields.append(value.alias(f.name))
    return df.withColumn(col, F.when(F.col(col).isNotNull(), F.struct(*fields)))


def redact_record(df: DataFrame, cols: list[str], policy: Policy = DEFAULT) -> DataFrame:
    """df with each of cols redacted, redactions over all of them, and changed: the names of the fields with hits."""
    out, counts = df, []
    for i, c in enumerate(cols):
        out = scan_text(out, c, policy).withColumnRenamed("redactions", f"__mm_n{i}").drop("rule_hits")
        counts.append(F.col(f"__mm_n{i}"))
    changed = F.filter(F.array(*(F.when(n > 0, F.lit(c)) for c, n in zip(cols, counts, strict=True))), lambda x: x.isNotNull())
    return out.select(*df.columns, reduce(lambda a, b: a + b, counts).alias("redactions"), changed.alias("changed"))


def _scanned(df: DataFrame, value: Column, policy: Policy) -> DataFrame:
    """df with redactions and rule_hits of a value given as JSON."""
    rest = [c for c in df.columns if c not in ("redactions", "rule_hits")]
    found = redact_json(df.select(*rest, value.alias("__mm_json")), "__mm_json", policy)
    none = F.create_map().cast("map<string,bigint>")
    return found.select(*rest, F.coalesce("redactions", F.lit(0)).alias("redactions"), F.coalesce("rule_hits", none).alias("rule_hits"))


def scan_nested(df: DataFrame, col: str, policy: Policy = DEFAULT) -> DataFrame:
    """redact_nested with redactions and rule_hits; fields masked by name count as sensitive_field. A number below a strict field,
    which becomes null, counts too. Null values have no hits."""
    return redact_nested(_scanned(df, F.to_json(col), policy), col, policy)


def scan_params(df: DataFrame, col: str = "params", policy: Policy = DEFAULT) -> DataFrame:
    """redact_params with redactions and rule_hits. The parameters' own names are not classified; of messages the content counts."""
    kind, values = df.schema[col].dataType, []
    for i, f in enumerate(kind.fields):
        value = F.col(col)[f.name]
        if f.name == "messages" and isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType) and "content" in f.dataType.elementType.names:
            value = F.transform(value, lambda m: m["content"])
        values.append(value.alias(f"p{i}"))
    return redact_params(_scanned(df, F.to_json(F.struct(*values)), policy), col, policy)


def payload_sample(df: DataFrame, key: str, col: str, n: int, k: int, policy: Policy = DEFAULT) -> DataFrame:
    """sample_by_reason of a JSON text column: malformed payloads and those whose keys collide beside redacted ones."""
    both = redact_json(df.select(key, F.col(col).alias("__mm_raw"), F.col(col).alias("__mm_done")), "__mm_done", policy)
    return sample_by_reason(both, key, "__mm_raw", "__mm_done", n, k)
