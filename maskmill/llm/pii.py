"""Personal data by patterns, and information-theoretic sanitisation of what gives it away (operator 7).

1. Patterns find the protected entities: e-mail and IP addresses, card and phone numbers.
2. The words around an entity are its context. Over the whole corpus, a word's pointwise mutual information with an entity is
   log2(p(word, entity) / (p(word) p(entity))); the entity's own information is -log2 p(entity). A word whose share of the
   entity's information reaches `disclosure` says nearly as much as the entity itself.
3. Such words are spans of kind `term` wherever they occur in documents that hold the entity: removed where they disclose all of it, else generalised.
What is counted is distinct texts, on all sides (with the word, with the entity, with both, all of them), so copies of a document
change nothing. A word also needs `support` contexts of the entity that are not word for word the same.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .shared import cut

KINDS = ("email", "ip", "card", "phone")
# The patterns of the base kinds.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9.]{7,}+")
_WORD = re.compile(r"[^\W_]+")

WINDOW = 8
SUPPORT = 3
SALTS = 32
DISCLOSURE = 0.9


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _emails(text: str):
    """EMAIL's matches, from each @ outwards, so that long runs without one are not tried again and again."""
    low, at = 0, text.find("@")
    while at >= 0:
        before = text[low:at]
        start = low + len(before.rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        low = found.end() if found else at + 1
        at = text.find("@", low)


def _addresses(text: str):
    """IP's matches: of numbers joined by single dots, four and four from the left."""
    for run in _DOTTED.finditer(text):
        at, chain = run.start(), []
        for part in [*run[0].split("."), ""]:
            if part:
                chain.append((at, part))
                if len(chain) == 4:
                    if all(_octet(x) for _, x in chain):
                        yield chain[0][0], at + len(part)
                    chain = []
            else:
                chain = []
            at += len(part) + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind and start: the leftmost non-overlapping matches of each kind that hold."""
    found = [(0, a, b) for a, b in _emails(text)] + [(1, a, b) for a, b in _addresses(text)]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append((2, *m.span()))
    if "+" in text:
        found += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return found


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _outside(text: str, spans: list) -> list[re.Match]:
    """The words that lie in no span, in order."""
    out, at = [], 0
    for lo, hi in [*sorted((a, b) for _, a, b in spans), (len(text), len(text))]:
        out += _WORD.finditer(text, at, max(at, lo))
        at = max(at, hi)
    return out


def _contexts(text: str, spans: list) -> list[dict]:
    """The WINDOW words on each side of each span, of those in no span: word, entity, context, place."""
    words, out = _outside(text, spans), []
    starts = [m.start() for m in words]
    for kind, a, b in spans:
        first, after = bisect.bisect_left(starts, a), bisect.bisect_left(starts, b)
        near = words[max(0, first - WINDOW) : first] + words[after : after + WINDOW]
        value = _value(text, kind, a, b)
        around = " ".join(m[0].lower() for m in near)
        entity, context = _hash(value), _hash(f"{value}\n{around}")
        out += [{"word": _key(m[0]), "entity": entity, "context": context, "lo": m.start(), "hi": m.end()} for m in near]
    return out


def _value(text: str, kind: int, a: int, b: int) -> str:
    return text[a:b].lower() if kind == 0 else KINDS[kind] + _NOT_DIGIT.sub("." if kind == 1 else "", text[a:b])


def _hash(value: str) -> int:
    return tokens.hash_bytes(value.encode()) - (1 << 63)


def _key(word: str) -> int:
    return _hash(word.lower())


def _plain(text: str | None) -> str | None:
    """The text's words as _key has them, so that byte-wise words are the same words."""
    return text if text is None or text.isascii() else " ".join(w.lower() for w in _WORD.findall(text))


_CONTEXT = pa.struct([("word", pa.int64()), ("entity", pa.int64()), ("context", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])


def _find(batches):
    for batch in batches:
        spans, contexts, entities = [], [], []
        for text in batch.column(3).to_pylist():
            found = base_spans(text or "")
            spans.append(found)
            contexts.append(_contexts(text, found) if found else [])
            entities.append(sorted({_hash(_value(text, *s)) for s in found}))
        counts = [pa.array([sum(s[0] == k for s in found) for found in spans], pa.int64()) for k in range(4)]
        named = [[{"kind": KINDS[k], "lo": a, "hi": b} for k, a, b in found] for found in spans]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1), batch.column(2), *counts,
                pa.array(named, pa.list_(pa.struct([("kind", pa.string()), ("lo", pa.int32()), ("hi", pa.int32())]))),
                pa.array(contexts, pa.list_(_CONTEXT)), pa.array(entities, pa.list_(pa.int64())),
            ],
            ["id", "row", "same", *(f"n_{k}" for k in KINDS), "base", "contexts", "entities"],
        )


def _bit_filter(words: DataFrame, bits: int = 22) -> np.ndarray:
    """A bit for each low part of a word's hash: at most 2 ** bits / 8 bytes, whatever the number of words."""
    slot = words.select(F.pmod("word", F.lit(1 << bits)).alias("slot"))
    rows = slot.groupBy(F.expr("slot div 32").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 32 AS int)))").alias("mask")).toPandas()
    out = np.zeros(1 << (bits - 5), np.uint32)
    out[rows["at"].to_numpy(np.int64)] = rows["mask"].to_numpy(np.int64).astype(np.uint32)
    return out


def _document_counts(docs: DataFrame, text_col: str, words: DataFrame, copied: DataFrame) -> DataFrame:
    """(word, docs): in how many distinct texts each of the words occurs, over the whole corpus. copied: same, the hashes of texts that
    several rows have.

    Texts that no other row has are summed in tasks. A text that may be copied (a filter of fixed size tells) gives its wanted words
    once a task, under its hash, and once for all after a shuffle of these few.
    """
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast((_bit_filter(words), _bit_filter(copied.select(F.col("same").alias("word")))))
    low = np.uint64((1 << 22) - 1)

    def make(batches):
        want, may_repeat = bits.value
        for batch in batches:
            totals: list[np.ndarray] = []
            copies: dict[int, bytes] = {}
            same = batch.column(0).to_pylist()
            slot = np.array(same, np.int64) & ((1 << 22) - 1)
            repeats = (may_repeat[slot >> 5] >> (slot & 31).astype(np.uint32)) & 1 > 0
            for lo, hi, data, offsets in tokens.pieces(pa.array(map(_plain, batch.column(1).to_pylist()), pa.large_string())):
                starts, ends, first = tokens.spans(data, offsets, tokens.ALNUM)
                h = tokens.hashes(data, starts, ends)
                slot = (h & low).astype(np.int64)
                hit = (want[slot >> 5] >> (slot & 31).astype(np.uint32)) & 1 > 0
                doc = np.repeat(np.arange(lo, hi), np.diff(first))[hit]
                h = h[hit]
                for i in np.flatnonzero(repeats[lo:hi]) + lo:
                    if same[i] not in copies:
                        a, b = np.searchsorted(doc, (i, i + 1))
                        copies[same[i]] = (np.unique(h[a:b]) ^ np.uint64(1 << 63)).tobytes()
                once = ~repeats[doc]
                pair = np.unique(np.stack([doc[once].astype(np.uint64), h[once]]), axis=1) if once.any() else np.zeros((2, 0), np.uint64)
                totals.append(pair[1])
            word, n = np.unique(np.concatenate(totals) if totals else np.zeros(0, np.uint64), return_counts=True)
            rows = len(word) + len(copies)
            none = lambda k, kind: pa.nulls(k, kind)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array((word ^ np.uint64(1 << 63)).view(np.int64)), none(len(copies), pa.int64())]), pa.concat_arrays([pa.array(n.astype(np.int64)), none(len(copies), pa.int64())]),
                    pa.concat_arrays([none(rows - len(copies), pa.int64()), pa.array(list(copies), pa.int64())]), pa.concat_arrays([none(rows - len(copies), pa.binary()), pa.array(list(copies.values()), pa.binary())]),
                ],
                ["word", "n", "same", "words"],
            )

    def unpack(batches):
        for batch in batches:
            for words_ in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(words_, np.int64))], ["word"])

    found = cut(docs.select(F.xxhash64(text_col).alias("same"), text_col).mapInArrow(make, "word long, n long, same long, words binary"))
    copies = found.where("same IS NOT NULL").groupBy("same").agg(F.first("words").alias("words")).select("words").mapInArrow(unpack, "word long")
    counted = found.where("word IS NOT NULL").select("word", "n").unionByName(copies.select("word", F.lit(1).cast("long").alias("n")))
    return counted.groupBy("word").agg(F.sum("n").alias("docs")).join(words, "word", "left_semi")


def disclosing_terms(found: DataFrame, docs: DataFrame, text_col: str, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """(word, entity, share): the words that carry at least the share `disclosure` of an entity's information."""
    texts = found.groupBy("same").agg(F.count("*").alias("rows"))
    total, copied = texts.count(), texts.where(F.col("rows") > 1).select("same")
    each = found.where(F.size("contexts") > 0).select("same", F.explode("contexts").alias("c")).select("same", "c.word", "c.entity", "c.context")
    near = each.groupBy("word", "entity").agg(F.count_distinct("context").alias("contexts"), F.count_distinct("same").alias("both"))
    pairs = cut(near.where(F.col("contexts") >= support).select("word", "entity", "both"))
    n_entity = each.select("entity", "same").distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    words = pairs.select("word").distinct()
    counted = pairs.join(_document_counts(docs, text_col, words, copied), "word").join(n_entity, "entity")
    information = -F.log2(F.col("n_entity") / F.lit(float(max(total, 1))))
    mutual = F.log2(F.least(F.col("both"), F.col("n_entity"), F.col("docs")) * F.lit(float(max(total, 1))) / (F.col("docs") * F.col("n_entity")))
    return counted.select("word", "entity", (mutual / information).alias("share")).where((information > 0) & (F.col("share") >= disclosure))


def _places(batches):
    """(row, terms): every occurrence of a document's wanted words outside the patterns' spans."""
    for batch in batches:
        terms = []
        for text, wanted in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            share, out, known = {w["word"]: w["share"] for w in wanted}, [], {}
            for m in _outside(text, base_spans(text)):
                word = m[0].lower()
                key = known[word] if word in known else known.setdefault(word, _hash(word))
                if key in share:
                    out.append({"lo": m.start(), "hi": m.end(), "share": share[key]})
            terms.append(out)
        kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("share", pa.float64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, kind)], ["row", "terms"])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """One row for each row of docs: id, row (hash of id and text), n_email, n_ip, n_card, n_phone, base and terms.

    base: the patterns' spans by kind, then start; terms: the disclosing words' spans with their share. Offsets count code
    points, ends are exclusive. Null text counts as empty. Rows that repeat id and text have the same answer. Extra columns
    are not read; an empty table gives an empty table.
    """
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("row"), F.xxhash64(text_col).alias("same"), F.col(text_col).alias("text"))
    kind = f"id {docs.schema[id_col].dataType.simpleString()}, row long, same long, n_email long, n_ip long, n_card long, n_phone long, base array<struct<kind:string,lo:int,hi:int>>, contexts array<struct<word:long,entity:long,context:long,lo:int,hi:int>>, entities array<long>"
    found = cut(keyed.mapInArrow(_find, kind))
    terms = disclosing_terms(found, docs, text_col, support, disclosure)
    # an entity of many documents is dealt over SALTS tasks
    held = found.where(F.size("entities") > 0).select("row", F.explode("entities").alias("entity")).distinct().withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
    salted = terms.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
    wanted = held.join(salted, ["entity", "salt"]).groupBy("row", "word").agg(F.max("share").alias("share")).groupBy("row").agg(F.collect_list(F.struct("word", "share")).alias("wanted"))
    texts = keyed.select("row", "text").join(wanted, "row").select("row", "text", "wanted")
    spans = texts.mapInArrow(_places, "row long, terms array<struct<lo:int,hi:int,share:double>>").dropDuplicates(["row"])
    none = F.expr("cast(array() AS array<struct<lo:int,hi:int,share:double>>)")
    return found.join(spans, "row", "left").select(F.col("id").alias(id_col), "row", *(f"n_{k}" for k in KINDS), "base", F.coalesce("terms", none).alias("terms"))


def span_text(spans, kind=None):
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind) if kind else s["kind"], s["lo"].cast("string"), s["hi"].cast("string"))), ",")


def _sanitise(batches):
    for batch in batches:
        out = []
        for text, terms in zip(batch.column("__text").to_pylist(), batch.column("__terms").to_pylist(), strict=True):
            if text is not None:
                marks = [(a, b, f"[{KINDS[k].upper()}]") for k, a, b in base_spans(text)]
                marks += [(t["lo"], t["hi"], "" if t["share"] >= 1 else "[TERM]") for t in terms or []]
                text = _replaced(text, marks)
            out.append(text)
        at = batch.schema.get_field_index("__text")
        yield batch.set_column(at, "__text", pa.array(out, pa.string())).drop_columns(["__terms"])


def _replaced(text: str, marks: list[tuple[int, int, str]]) -> str:
    """Spans that overlap are replaced as one, by the mark of the first."""
    out, end = [], 0
    for a, b, mark in sorted(marks):
        if a >= end:
            out += [text[end:a], mark]
        end = max(end, b)
    return "".join([*out, text[end:]])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """docs with the text sanitised: base spans become [EMAIL], [IP], [CARD], [PHONE]; disclosing words become [TERM], or
    nothing where they disclose all. All other columns and rows stay as they are."""
    found = personal_data(docs, id_col, text_col, support, disclosure).where(F.size("terms") > 0).select(F.col("row").alias("__row"), F.col("terms").alias("__terms")).dropDuplicates(["__row"])
    keyed = docs.withColumn("__row", F.xxhash64(id_col, text_col)).join(found, "__row", "left").drop("__row").withColumnRenamed(text_col, "__text")
    schema = keyed.drop("__terms").schema
    return keyed.mapInArrow(_sanitise, schema).withColumnRenamed("__text", text_col).select(docs.columns)
