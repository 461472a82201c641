"""Benchmark decontamination by a positional inverted index (operator 5).

1. The index is a table in the shared folder, sharded by document: each row is the postings of about SHARD_BYTES of documents,
   a sorted list of positions for each term, of the terms that the benchmark may use (a bit filter of fixed size says which).
2. Phrases are looked up in every shard, so postings never move. Of each phrase the rarest term of the shard goes first: its
   list, less the term's offset in the phrase, are the possible starts, and the lists of the other terms, rarest next, are
   intersected with them at their own offsets.

The benchmark is the stated query set. It is taken in blocks of at most BLOCK_CHARS characters, each collected and broadcast
by itself, against the one index; what the blocks find in a document is merged.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .shared import cut

WINDOW = 13
BLOCK_CHARS, SHARD_BYTES = 2 << 20, 2 << 20
FILTER_BITS = 22


class Phrases:
    """Phrases of up to window terms, each from an item; ids are numbers of terms in a sorted vocabulary of hashes."""

    def __init__(self, names: list, texts: list, window: int):
        found: dict[bytes, tuple[np.ndarray, set]] = {}
        for _lo, _hi, data, offsets in tokens.pieces(pa.array(texts, pa.string())):
            starts, ends, first = tokens.spans(data, offsets, tokens.ALNUM)
            hashed = tokens.hashes(data, starts, ends)
            for i in range(_hi - _lo):
                words = hashed[first[i] : first[i + 1]]
                size = min(window, len(words))
                for at in range(len(words) - size + 1 if size else 0):
                    phrase = words[at : at + size]
                    found.setdefault(phrase.tobytes(), (phrase, set()))[1].add(names[_lo + i])
        phrases = [p for p, _ in found.values()]
        self.items = [sorted(str(x) for x in owners if x is not None) for _, owners in found.values()]
        self.size = np.array([len(p) for p in phrases], np.int64)
        self.vocabulary = np.unique(np.concatenate(phrases)) if phrases else np.zeros(0, np.uint64)
        self.terms = np.full((len(phrases), window), -1, np.int64)
        for i, p in enumerate(phrases):
            self.terms[i, : len(p)] = np.searchsorted(self.vocabulary, p)


class Shard:
    """The postings of some documents: terms (hashes, ascending), where each one's list begins, and positions, ascending in a list.
    first: each document's first position, with one more at the end."""

    def __init__(self, terms: np.ndarray, bounds: np.ndarray, positions: np.ndarray, first: np.ndarray):
        self.terms, self.bounds, self.positions, self.first = terms, bounds, positions, first
        self.doc_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self._place = np.repeat(np.arange(len(terms)) << 32, np.diff(bounds)) + positions

    @classmethod
    def of(cls, hashed: np.ndarray, first: np.ndarray, wanted: np.ndarray) -> Shard:
        """The postings of the wanted words."""
        position = np.flatnonzero(wanted)
        order = np.argsort(hashed[position], kind="stable")
        position, term = position[order], hashed[position][order]
        begin = np.flatnonzero(np.diff(term, prepend=~term[:1])) if len(term) else np.zeros(0, np.int64)
        return cls(term[begin], np.append(begin, len(term)), position, first)

    def lists(self, vocabulary: np.ndarray) -> np.ndarray:
        """The number of each term's list, -1 where the shard does not hold it."""
        at = np.minimum(np.searchsorted(self.terms, vocabulary), max(len(self.terms) - 1, 0))
        return np.where(self.terms[at] == vocabulary, at, -1) if len(self.terms) else np.full(len(vocabulary), -1)

    def holds(self, which: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether each list has each position."""
        want = (which << 32) + position
        at = np.minimum(np.searchsorted(self._place, want), len(self._place) - 1)
        return (which >= 0) & (self._place[at] == want)

    def phrase_starts(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, position of its first word) of every exact match inside one document."""
        if not len(phrases.size) or not len(self.positions):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lists = self.lists(phrases.vocabulary)
        frequency = np.where(lists >= 0, np.diff(self.bounds)[lists], 0)
        absent = phrases.terms < 0
        counts = np.where(absent, np.iinfo(np.int64).max, frequency[phrases.terms])
        by_rarity = np.argsort(counts, axis=1, kind="stable")
        lead = by_rarity[:, 0]
        rarest = phrases.terms[np.arange(len(lead)), lead]
        many = frequency[rarest]
        which = np.repeat(np.arange(len(lead)), many)
        within = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
        start = self.positions[self.bounds[lists[rarest]][which] + within] - lead[which]
        size = phrases.size[which]
        ok = (start >= 0) & (start + size <= len(self.doc_of))
        which, start, size = which[ok], start[ok], size[ok]
        ok = self.doc_of[start] == self.doc_of[start + size - 1]
        which, start = which[ok], start[ok]
        for j in range(1, phrases.terms.shape[1]):
            if not len(which):
                break
            offset = by_rarity[which, j]
            want = phrases.terms[which, offset]
            ok = (want < 0) | self.holds(lists[want], start + offset)
            which, start = which[ok], start[ok]
        return which, start

    def near(self, words: np.ndarray, slop: int) -> np.ndarray:
        """Documents (rows of the shard) that hold all words (hashes), in any order, within len(words) + slop consecutive words."""
        found = self.lists(words)
        if (found < 0).any():
            return np.zeros(0, np.int64)
        lists = sorted((self.positions[self.bounds[t] : self.bounds[t + 1]] for t in found), key=len)
        if not lists or not len(lists[0]):
            return np.zeros(0, np.int64)
        reach, hits = len(words) + slop, []
        for p in lists[0]:
            for lo in range(p - reach + 1, p + 1):
                inside = lambda q, lo=lo: (k := np.searchsorted(q, lo)) < len(q) and q[k] < lo + reach
                if 0 <= lo and lo + reach <= len(self.doc_of) + slop and all(inside(q) for q in lists[1:]):
                    found = [p, *(q[np.searchsorted(q, lo)] for q in lists[1:])]
                    if len({int(self.doc_of[x]) for x in found}) == 1:
                        hits.append(int(self.doc_of[p]))
                        break
        return np.unique(np.array(hits, np.int64))


def _wanted(benchmark: DataFrame, text_col: str) -> np.ndarray:
    """A bit for each low part of a benchmark word's hash: 2 ** FILTER_BITS / 8 bytes, whatever the benchmark's size."""

    def make(batches):
        bits = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            for _lo, _hi, data, offsets in tokens.pieces(batch.column(0)):
                starts, ends, _ = tokens.spans(data, offsets, tokens.ALNUM)
                bits[tokens.hashes(data, starts, ends) & np.uint64((1 << FILTER_BITS) - 1)] = True
        packed = np.packbits(bits).view(np.int64)
        at = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(packed[at])], ["at", "mask"])

    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for r in benchmark.select(text_col).mapInArrow(make, "at long, mask long").groupBy("at").agg(F.bit_or("mask").alias("mask")).collect():
        out[r["at"]] = r["mask"]
    return np.unpackbits(out.view(np.uint8)).astype(bool)


_INDEX = "rows array<long>, first binary, terms binary, bounds binary, positions binary"


def _postings(wanted):
    def make(batches):
        for batch in batches:
            for lo, hi, data, offsets in tokens.pieces(batch.column(2), SHARD_BYTES):
                starts, ends, first = tokens.spans(data, offsets, tokens.ALNUM)
                hashed = tokens.hashes(data, starts, ends)
                shard = Shard.of(hashed, first, wanted.value[hashed & np.uint64((1 << FILTER_BITS) - 1)])
                parts = (first.astype(np.int64), shard.terms, shard.bounds.astype(np.int32), shard.positions.astype(np.int32))
                ids, rows = (pa.array([batch.column(i).slice(lo, hi - lo).to_pylist()], pa.list_(batch.column(i).type)) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([ids, rows, *(pa.array([x.tobytes()], pa.binary()) for x in parts)], ["ids", "rows", "first", "terms", "bounds", "positions"])

    return make


def index(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """The index of docs (id, row, text), a row a shard, in the shared folder."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)
    return cut(docs.mapInArrow(_postings(shared), f"ids array<{docs.schema['id'].dataType.simpleString()}>, {_INDEX}"))


def _matches(block: Phrases, all_rows: bool):
    """Rows (id, row, n_words, spans, items): disjoint runs of hit words of a document, and the items that hit it."""
    ids = block

    def make(batches):
        phrases = ids.value
        for batch in batches:
            for i in range(batch.num_rows):
                first, terms, bounds, positions = (np.frombuffer(batch.column(c)[i].as_py(), k) for c, k in ((2, np.int64), (3, np.uint64), (4, np.int32), (5, np.int32)))
                shard = Shard(terms, bounds.astype(np.int64), positions.astype(np.int64), first)
                which, start = shard.phrase_starts(phrases)
                doc_of, many = shard.doc_of, len(first) - 1
                spans, items = [[] for _ in range(many)], [[] for _ in range(many)]
                if len(which):
                    change = np.zeros(len(doc_of) + 1, np.int64)
                    np.add.at(change, start, 1)
                    np.add.at(change, start + phrases.size[which], -1)
                    hit = np.zeros(len(doc_of) + 2, np.int8)
                    hit[1:-1] = np.cumsum(change[:-1]) > 0
                    edges = np.diff(hit)
                    # a run that goes over the edge of a document is cut there
                    for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True):
                        for d in range(int(doc_of[a]), int(doc_of[b - 1]) + 1):
                            x, y = max(a, first[d]), min(b, first[d + 1])
                            if x < y:
                                spans[d].append({"lo": int(x - first[d]), "hi": int(y - first[d])})
                    for d, w in {(int(doc_of[s]), int(w)) for w, s in zip(which, start, strict=True)}:
                        items[d].extend(phrases.items[w])
                take = np.arange(many) if all_rows else np.array([d for d in range(many) if spans[d]], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c)[i].values.take(pa.array(take)) for c in (0, 1)), pa.array(np.diff(first)[take]),
                        pa.array([spans[d] for d in take], pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))),
                        pa.array([sorted(set(items[d])) for d in take], pa.list_(pa.string())),
                    ],
                    ["id", "row", "n_words", "spans", "items"],
                )

    return make


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, share: float = 0.05, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """One row for each row of docs: id, n_words, n_hit, n_items, items (sorted), spans of hit words, contaminated.

    A word is hit if it lies in an occurrence of window consecutive words of an item (all words of a shorter item);
    contaminated: some hit, and n_hit at least share of n_words. Null or empty text, in docs or items, has no words. An item
    whose id is null hits words but is not counted or listed. Items that repeat an id are one item. Rows that repeat an id
    are judged by themselves. Extra columns are not read; empty tables give no rows or no hits.
    """
    spark = docs.sparkSession
    total = benchmark.agg(F.sum(F.length(item_text_col)).alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(total / block_chars))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    kind = f"id {docs.schema[id_col].dataType.simpleString()}, row long, n_words long, spans array<struct<lo:int,hi:int>>, items array<string>"
    indexed, parts = index(rows, _wanted(benchmark, item_text_col)), []
    for k in range(blocks):
        own = benchmark.where(F.pmod(F.xxhash64(item_col, item_text_col), F.lit(blocks)) == k).select(item_col, item_text_col).distinct().collect()
        phrases = spark.sparkContext.broadcast(Phrases([r[0] for r in own], [r[1] for r in own], window))
        parts.append(indexed.mapInArrow(_matches(phrases, k == 0), kind))
    found = parts[0]
    if blocks > 1:  # each document once a block: merge what the blocks found, then give every row its document's answer
        hits = parts[0].where("size(spans) > 0")
        for part in parts[1:]:
            hits = hits.unionByName(part)
        merged = hits.groupBy("row").agg(
            F.array_sort(F.flatten(F.collect_list("spans"))).alias("all_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("all_items")
        )
        found = (
            parts[0].select("id", "row", "n_words").join(merged, "row", "left")
            .select("id", "row", "n_words", F.coalesce("all_spans", F.expr("cast(array() as array<struct<lo:int,hi:int>>)")).alias("spans"), F.coalesce("all_items", F.expr("cast(array() as array<string>)")).alias("items"))
        )
    n_hit = F.expr("aggregate(spans, named_struct('n', 0L, 'end', 0), (s, x) -> named_struct('n', s.n + greatest(0, x.hi - greatest(x.lo, s.end)), 'end', greatest(s.end, x.hi)), s -> s.n)")
    return found.select(
        F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans"
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") >= F.col("n_words") * F.lit(share)) if share != 0.05 else (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def items_digest(items: str = "items"):
    return F.sha2(F.array_join(items, ","), 256)


def proximity_matches(docs: DataFrame, words: list[str], slop: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of documents that hold all words, in any order, within len(words) + slop consecutive words. No words: no rows."""
    wanted = np.unique(np.array([tokens.hash_bytes(w.encode()) for w in words], np.uint64))

    def make(batches):
        for batch in batches:
            for lo, _hi, data, offsets in tokens.pieces(batch.column(1)):
                starts, ends, first = tokens.spans(data, offsets, tokens.ALNUM)
                hashed = tokens.hashes(data, starts, ends)
                rows = Shard.of(hashed, first, np.isin(hashed, wanted)).near(wanted, slop)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows + lo))], ["id"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(make, f"id {kind}").withColumnRenamed("id", id_col)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without the contaminated ones. All rows that share an id and text have one answer; rows without an id stay."""
    bad = contamination(docs, benchmark, id_col, text_col, **how).where("contaminated").where(F.col(id_col).isNotNull()).select(id_col).distinct()
    return docs.join(bad, id_col, "left_anti").select(docs.columns)
