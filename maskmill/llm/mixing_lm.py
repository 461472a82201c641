"""Language-model scores by online logistic context mixing (operator 4).

A text is its words and one end. A word is coded byte by byte (a closing byte last; the end is a word of no bytes), a byte by the
bits of a prefix code, so a text's probability is a product over bits. Each bit is predicted from counts of zeros and ones in five
contexts: the word so far with the class of the text so far, the word so far alone, and the class with the last four, three and
two bytes. The predictions, stretched to log-odds, are summed with weights chosen by a gate (how often two contexts were seen),
and the result is refined by an adaptive map from gate and prediction to what came true.

1. Classes: pairs of letters of all learning documents give three principal axes and, along them, CLASSES centres. The class of
   a text at a word is the centre nearest to what came before the word, so that it follows language and kind as the text goes.
2. Vocabulary: the distinct (class, word) of all documents with their number in learning documents, in buckets by the words'
   first bytes. What the bits need is worked out once for each of them, however often it occurs, and grows with the corpus.
3. Counts: the contexts of short beginnings and of the last bytes are hashed into tables of fixed size, summed over buckets in a
   tree. A longer word so far has all its words in one bucket, where its counts are exact.
4. Weights move online: each bucket takes its learning bits in order and after every few of them the weights of their gates make
   a Newton step; buckets are averaged by their curvature. A bit never sees its own occurrence in the counts.
5. Scoring: texts are dealt to blocks, whose distinct (class, word) meet the vocabulary in one exchange there and one back. As a
   text goes, its own history (words, and words after words) joins in; its share moves after every word with its success.

All sums are over all learning documents and no step depends on how the table is split.
"""

from __future__ import annotations

import heapq
import math
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .shared import cut

BLOCK_BYTES, BUCKET_BYTES, PIECE_BYTES, MERGED = 8 << 20, 8 << 20, 1 << 20, 6
PAIRS, AXES, CLASSES, CELLS = 128, 3, 8, 16
#: Words are in a bucket by their first NEAR bytes, by their first FAR where more than HOT longer words begin alike.
NEAR, FAR, HOT = 4, 12, 8_000_000
PREFIX_BITS = 16
#: Slots of the hashed tables, as powers of two: short word so far with the class, without, last four bytes, three, two.
TABLES = (19, 18, 21, 20, 18)
CHUNK, FAN = 1 << 18, 64
GATES, STEPS, INPUTS, BATCH = 16, 33, len(TABLES) + 1, 1 << 16
CLOSE = 0x20
#: What a text's own history counts for before it has shown anything: words, words after words; and for how many words it holds.
PRIOR = (0.02, 0.02, 40.0)
_ODD = np.uint64(0xD6E8FEB86659FD93)
_LOW = np.uint64(15)
_SIGN = np.uint64(1 << 63)


def prefix_code(freq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, inner nodes on the path, bits) of each of 256 bytes, by merging the two rarest until one is left."""
    heap = [(int(f) + 1, b, b) for b, f in enumerate(freq)]
    heapq.heapify(heap)
    up: dict[int, tuple[int, int]] = {}
    fresh = 256
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        up[a[2]], up[b[2]] = (fresh, 0), (fresh, 1)
        heapq.heappush(heap, (a[0] + b[0], fresh, fresh))
        fresh += 1
    paths = []
    for b in range(256):
        path, at = [], b
        while at in up:
            path.append(up[at])
            at = up[at][0]
        paths.append(path[::-1])
    longest = max(map(len, paths))
    nodes, bits = np.zeros((256, longest), np.uint64), np.zeros((256, longest), np.int8)
    for b, path in enumerate(paths):
        for k, (node, bit) in enumerate(path):
            nodes[b, k], bits[b, k] = node, bit
    return np.array([len(p) for p in paths]), nodes, bits


# Classes of texts


_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[~tokens.NOT_SPACE] = CLOSE
_PAIR = (np.arange(256)[:, None] * 37 + np.arange(256)[None, :] * 101 + np.arange(256)[:, None] // 3) % PAIRS


def _pairs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the pair of bytes at each place (the last has none), and whether it counts: two blanks do not."""
    plain = _BLANK[data]
    return _PAIR[plain[:-1], plain[1:]], (plain[:-1] != CLOSE) | (plain[1:] != CLOSE)


def _text_pairs(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each text's shares of pairs, one row a text; texts without any: zeros."""
    docs = len(offsets) - 1
    pair, ok = _pairs(data)
    doc = np.repeat(np.arange(docs), np.diff(offsets))
    ok &= doc[:-1] == doc[1:]
    seen = np.bincount(doc[:-1][ok] * PAIRS + pair[ok], minlength=docs * PAIRS).reshape(docs, PAIRS)
    return seen / np.maximum(seen.sum(axis=1, keepdims=True), 1)


def _summed(rows: DataFrame, make, size: int) -> np.ndarray:
    """The sum over all tasks of a vector of fixed size; make adds one batch's texts to it."""

    def each(batches):
        total = np.zeros(size)
        for batch in batches:
            for _lo, _hi, data, offsets in tokens.pieces(batch.column(0), PIECE_BYTES):
                make(total, data, offsets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "v"])

    out = np.zeros(size)
    for r in rows.mapInArrow(each, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    return out


def _add_pairs(total: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    total[:256] += np.bincount(_BLANK[data], minlength=256)
    if len(data) > 1:
        x = _text_pairs(data, offsets)
        total[256] += len(x)
        total[257 : 257 + PAIRS] += x.sum(axis=0)
        total[257 + PAIRS :] += (x.T @ x).ravel()


def _axes(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(each pair's place on the axes, spread of the texts on each axis)."""
    n = max(total[256], 1.0)
    mean = total[257 : 257 + PAIRS] / n
    value, vector = np.linalg.eigh(total[257 + PAIRS :].reshape(PAIRS, PAIRS) / n - np.outer(mean, mean))
    top = vector[:, ::-1][:, :AXES]
    top = top * np.sign(top[np.abs(top).argmax(axis=0), np.arange(AXES)])
    return np.round(top - mean @ top, 6), np.sqrt(np.maximum(value[::-1][:AXES], 1e-12))


def _add_cells(places: np.ndarray, spread: np.ndarray):
    """Counts of texts by cell along the axes, then of words by a hash of their first bytes."""

    def make(total: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
        if len(data) < 2:
            return
        cell = np.clip(np.floor((_text_pairs(data, offsets) @ places / spread + 3) * (CELLS / 6)), 0, CELLS - 1).astype(np.int64)
        total[: CELLS**AXES] += np.bincount(cell @ (CELLS ** np.arange(AXES)), minlength=CELLS**AXES)
        starts, ends, _ = tokens.spans(data, offsets)
        longer = ends - starts > NEAR
        total[CELLS**AXES :] += np.bincount(_prefix(data, starts[longer], ends[longer], NEAR) >> np.uint64(64 - PREFIX_BITS), minlength=1 << PREFIX_BITS)

    return make


def _centres(counts: np.ndarray) -> np.ndarray:
    """CLASSES centres of the cells with their counts, in units of spread: seeds far apart and heavy, then weighted means."""
    own = np.flatnonzero(counts)
    at, n = np.stack([own // CELLS**a % CELLS for a in range(AXES)], axis=1) * (6 / CELLS) - 3 + 3 / CELLS, counts[own]
    if not len(own):
        return np.zeros((CLASSES, AXES))
    gap = ((at - np.average(at, axis=0, weights=n)) ** 2).sum(axis=1)
    seeds = []
    for _ in range(CLASSES):
        seeds.append(at[np.argmax(n * gap)])
        gap = np.minimum(gap, ((at - seeds[-1]) ** 2).sum(axis=1)) if len(seeds) > 1 else ((at - seeds[-1]) ** 2).sum(axis=1)
    centres = np.array(seeds)
    for _ in range(30):
        nearest = ((at[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        for k in range(CLASSES):
            if (nearest == k).any():
                centres[k] = np.average(at[nearest == k], axis=0, weights=n[nearest == k])
    return np.round(centres, 6)


@dataclass
class Plan:
    """What all tasks share: the byte code, pairs' places on the axes in whole numbers, the centres, hot beginnings, buckets."""

    code: tuple
    places: np.ndarray
    centres: np.ndarray
    hot: np.ndarray
    buckets: int

    def classes(self, data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The class of the text before each start: 0 before anything was seen. Whole numbers, so sums are exact."""
        pair, ok = _pairs(data) if len(data) > 1 else (np.zeros(0, np.int64), np.zeros(0, bool))
        upto, from_ = np.maximum(starts - 1, offsets[doc]), offsets[doc]
        sums = np.zeros((len(starts), AXES + 1))
        for a in range(AXES + 1):
            each = np.where(ok, self.places[pair, a], 0) if a < AXES else ok
            cum = np.zeros(len(data) + 1, np.int64)
            np.cumsum(each, out=cum[1 : len(each) + 1])
            sums[:, a] = cum[upto] - cum[from_]
        fit = sums[:, :AXES] @ self.centres.T - sums[:, AXES:] * ((self.centres**2).sum(axis=1) / 2)
        return np.where(sums[:, AXES] > 0, 1 + fit.argmax(axis=1), 0).astype(np.uint64)

    def near(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bucket of each word, how many bytes of it decide that)."""
        short = _prefix(data, starts, ends, NEAR)
        deep = self.hot[(short >> np.uint64(64 - PREFIX_BITS)).astype(np.int64)]
        key = np.where(deep, _prefix(data, starts, ends, FAR), short) if deep.any() else short
        return (tokens.mix64(key ^ _ODD) % np.uint64(self.buckets)).astype(np.int64), np.where(deep, FAR, NEAR)


def _prefix(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """A hash of the first bytes of each word."""
    out = np.full(len(starts), 1, np.uint64)
    for k in range(size):
        at = starts + k
        byte = np.where(at < ends, data[np.minimum(at, max(len(data) - 1, 0))] + np.uint64(1) if len(data) else np.uint64(0), np.uint64(0))
        out = (out ^ byte) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return tokens.mix64(out)


class Tokens:
    """All tokens of some texts, each text's end after its words: key (hash of the word with the class in its low bits)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, plan: Plan):
        starts, ends, first = tokens.spans(data, offsets)
        docs = len(offsets) - 1
        self.first = first + np.arange(docs + 1)
        doc = np.repeat(np.arange(docs), np.diff(first))
        words = np.arange(len(starts)) + doc
        n = len(starts) + docs
        self.start, self.end, self.doc = np.empty(n, np.int64), np.empty(n, np.int64), np.repeat(np.arange(docs), np.diff(self.first))
        last = self.first[1:] - 1
        self.start[words], self.end[words] = starts, ends
        self.start[last] = self.end[last] = offsets[1:]
        hashed = np.zeros(n, np.uint64)
        hashed[words] = tokens.hashes(data, starts, ends)
        self.word = hashed & ~_LOW
        # the end comes after the last word: blanks that follow it make no difference
        before = self.start.copy()
        before[last[np.diff(first) > 0]] = ends[first[1:][np.diff(first) > 0] - 1]
        self.key = self.word | plan.classes(data, offsets, before, self.doc)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct key, and each key's number."""
    of, found = pd.factorize(keys)
    first = np.empty(len(found), np.int64)
    first[of[::-1]] = np.arange(len(keys))[::-1]
    return first, of


# Vocabulary

_UNITS = "bucket long, bytes binary, sizes binary, classes binary, counts binary"


def _packed_units(bucket: int, data: np.ndarray, sizes: np.ndarray, classes: np.ndarray, counts: np.ndarray) -> list:
    return [bucket, data.tobytes(), sizes.astype(np.int32).tobytes(), classes.astype(np.uint8).tobytes(), counts.astype(np.int64).tobytes()]


def _gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of all spans, one after the other."""
    edge = np.cumsum(sizes) - sizes
    return data[np.repeat(starts - edge, sizes) + np.arange(int(sizes.sum()))]


def _units(plan):
    """Of each MERGED pieces, the distinct (class, word) by bucket, with their number in learning documents."""

    def flush(held: list) -> pa.RecordBatch:
        data, sizes, key, bucket, n = (np.concatenate(x) for x in zip(*held, strict=True))
        one, of = _distinct(key)
        n = np.bincount(of, n, len(one))
        order = np.argsort(bucket[one], kind="stable")
        one, n = one[order], n[order]
        start, bucket = (np.cumsum(sizes) - sizes)[one], bucket[one]
        sizes, key = sizes[one], key[one]
        edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
        rows = [_packed_units(int(bucket[a]), _gathered(data, start[a:b], sizes[a:b]), sizes[a:b], key[a:b] & _LOW, n[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        kinds = [pa.int64(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "bytes", "sizes", "classes", "counts"])

    def make(batches):
        held: list = []
        for batch in batches:
            learn = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            for lo, hi, data, offsets in tokens.pieces(batch.column(0), PIECE_BYTES):
                t = Tokens(data, offsets, plan.value)
                one, of = _distinct(t.key)
                sizes = t.end[one] - t.start[one]
                held.append((_gathered(data, t.start[one], sizes), sizes, t.key[one], plan.value.near(data, t.start[one], t.end[one])[0], np.bincount(of, learn[lo:hi][t.doc], len(one))))
                if len(held) == MERGED:
                    yield flush(held)
                    held = []
        if held:
            yield flush(held)

    return make


class Vocabulary:
    """The units of one bucket."""

    def __init__(self, table: pa.Table):
        whole = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        self.data, self.sizes, self.classes, self.counts = whole("bytes", np.uint8), whole("sizes", np.int32).astype(np.int64), whole("classes", np.uint8), whole("counts", np.int64)
        self.end = np.cumsum(self.sizes)
        self.start = self.end - self.sizes
        self.word = tokens.hashes(self.data, self.start, self.end) & ~_LOW
        self.key = self.word | self.classes


def _merge(table: pa.Table) -> pa.Table:
    """One row of distinct units, in the order of their keys, and how many learning tokens and distinct learning words they are."""
    v = Vocabulary(table)
    one, of = _distinct(v.key)
    counts = np.bincount(of, v.counts, len(one)).astype(np.int64)
    order = np.argsort(v.key[one])
    one, counts = one[order], counts[order]
    row = _packed_units(table.column("bucket")[0].as_py(), _gathered(v.data, v.start[one], v.sizes[one]), v.sizes[one], v.classes[one], counts)
    known = len(np.unique(v.word[one][counts > 0]))
    kinds = [pa.int64(), *[pa.binary()] * 4, pa.int64(), pa.int64()]
    return pa.table({n: pa.array([x], k) for n, x, k in zip(["bucket", "bytes", "sizes", "classes", "counts", "n", "v"], [*row, int(counts.sum()), known], kinds, strict=True)})


# Bits


class Steps:
    """The distinct steps from a word so far, in a class, to its next byte, and their bits."""

    def __init__(self, v: Vocabulary, plan: Plan):
        _, near = plan.near(v.data, v.start, v.end)
        size = v.sizes + 1
        self.edge = np.concatenate([[0], np.cumsum(size)])
        unit = np.repeat(np.arange(len(size)), size)
        within = np.arange(self.edge[-1]) - self.edge[unit]
        byte = np.full(len(unit), CLOSE, np.uint8)
        inner = within < v.sizes[unit]
        byte[inner] = v.data
        up, down = tokens._powers(len(byte) + 1)
        sums = np.zeros(len(byte) + 1, np.uint64)
        np.cumsum((byte.astype(np.uint64) + np.uint64(1)) * up[: len(byte)], out=sums[1:])
        begin = self.edge[unit]
        sofar = tokens.mix64((sums[:-1] - sums[begin]) * down[begin])
        kind = (v.classes[unit].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        one, self.of = _distinct(tokens.mix64(sofar ^ kind) + byte)
        self.seen = np.bincount(self.of, v.counts[unit], len(one))
        self.byte, self.deep = byte[one], (within >= near[unit])[one]
        back = np.zeros(len(one), np.uint64)
        recent = []
        for k in range(1, 5):
            back = back | np.where(within[one] >= k, byte[np.maximum(one - k, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0)) << np.uint64(9 * (k - 1))
            recent.append(back)
        self.contexts = [tokens.mix64(sofar[one] ^ kind[one]), sofar[one], *(tokens.mix64(recent[k - 1] ^ (kind[one] * np.uint64(k))) for k in (4, 3, 2))]
        self.code = plan.code

    def bits(self):
        """For each bit of the bytes: (steps that have it, the bit, each context's own number of the node)."""
        length, nodes, bits = self.code
        at = np.arange(len(self.byte))
        for k in range(nodes.shape[1]):
            at = at[length[self.byte[at]] > k]
            if not len(at):
                return
            node = nodes[self.byte[at], k] * _ODD
            yield at, bits[self.byte[at], k], [(c[at] ^ node) * _ODD for c in self.contexts]


def _slot(key: np.ndarray, table: int) -> np.ndarray:
    return (tokens.mix64(key) >> np.uint64(64 - TABLES[table])).astype(np.int64)


def _count(plan):
    def make(batches):
        tables = [np.zeros(2 << t, np.int64) for t in TABLES]
        for batch in batches:
            for i in range(batch.num_rows):
                steps = Steps(Vocabulary(pa.Table.from_batches([batch.slice(i, 1)])), plan.value)
                for at, bit, keys in steps.bits():
                    for k, table in enumerate(tables):
                        on = ~steps.deep[at] & (steps.seen[at] > 0) if k < 2 else steps.seen[at] > 0
                        np.add.at(table, (_slot(keys[k][on], k) << 1) + bit[on], steps.seen[at][on].astype(np.int64))
        yield from _chunks(tables)

    return make


def _packed(at: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending places and their counts, compressed."""
    return zlib.compress(np.diff(at, prepend=0).astype(np.int32).tobytes() + n.astype(np.int64).tobytes(), 1)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(data)
    third = len(raw) // 3
    return np.cumsum(np.frombuffer(raw[:third], np.int32), dtype=np.int64), np.frombuffer(raw[third:], np.int64)


def _chunks(tables: list[np.ndarray]):
    for i, table in enumerate(tables):
        for lo in range(0, len(table), CHUNK):
            part = table[lo : lo + CHUNK]
            at = np.flatnonzero(part)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([lo], pa.int32()), pa.array([_packed(at, part[at])], pa.binary())], ["which", "lo", "counts"])


def _add(table: pa.Table) -> pa.Table:
    total = np.zeros(CHUNK, np.int64)
    for counts in table.column("counts"):
        at, n = _unpacked(counts.as_py())
        total[at] += n
    at = np.flatnonzero(total)
    return pa.table({"which": table.column("which")[:1], "lo": table.column("lo")[:1], "part": table.column("part")[:1], "counts": pa.array([_packed(at, total[at])], pa.binary())})


def count_tables(vocabulary: DataFrame, plan) -> list[np.ndarray]:
    """The counts of every bit of every learning token in tables of fixed size, a byte for eight times the base-2 logarithm of
    one more than the count."""
    parts = vocabulary.rdd.getNumPartitions()
    sums = vocabulary.mapInArrow(_count(plan), "which int, lo int, counts binary").withColumn("part", F.spark_partition_id())
    while True:
        sums = sums.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("which", "lo", "part").applyInArrow(_add, "which int, lo int, part int, counts binary")
        parts = -(-parts // FAN)
        if parts <= 1:
            break
    tables = [np.zeros(2 << t, np.uint8) for t in TABLES]
    for r in sums.toLocalIterator():
        at, n = _unpacked(r["counts"])
        tables[r["which"]][r["lo"] + at] = np.rint(8 * np.log2(1.0 + n))
    return tables


_COUNT = 2 ** (np.arange(256) / 8) - 1


def _inputs(steps: Steps, tables: list[np.ndarray], at: np.ndarray, bit: np.ndarray, keys: list, own: bool):
    """Stretched predictions with a constant, and the gate, of each bit. own: leave one occurrence of the bit out of the counts."""
    x, gate = np.empty((INPUTS, len(at)), np.float32), np.zeros(len(at), np.int64)
    deep, n = steps.deep[at], steps.seen[at]
    for i, table in enumerate(tables):
        pair = table.view("<u2")[_slot(keys[i], i)]  # ones in the high byte
        zeros, ones = _COUNT[pair & 255], _COUNT[pair >> 8]
        if i < 2:
            of, _ = pd.factorize(keys[i])
            one, all_ = np.bincount(of, n * bit), np.bincount(of, n)
            zeros, ones = np.where(deep, (all_ - one)[of], zeros), np.where(deep, one[of], ones)
        if own:
            zeros, ones = np.maximum(zeros - (bit == 0), 0), np.maximum(ones - (bit == 1), 0)
        x[i] = np.log((ones + 0.4) / (zeros + 0.4))
        if i in (0, 2):
            both = zeros + ones
            gate += ((both >= 0.9).astype(np.int64) + (both >= 4) + (both >= 64)) * (4 if i == 0 else 1)
    x[-1] = 0.3
    return x, gate


class Mixer:
    """Weights of the inputs by gate, and the refining map."""

    def __init__(self, weights: np.ndarray, refined: np.ndarray):
        self.weights, self.refined = weights, refined

    @staticmethod
    def steps(z: np.ndarray) -> np.ndarray:
        return np.rint((np.clip(z, -8, 8) + 8) * ((STEPS - 1) / 16)).astype(np.int64)

    def odds(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        z = np.zeros(len(gate))
        for i, row in enumerate(x):
            z += row * self.weights[gate, i]
        return np.clip(z, -18, 18)

    def ones(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """The probability of a one."""
        z = self.odds(x, gate)
        return np.clip(0.5 * (1 / (1 + np.exp(-z)) + self.refined[gate, self.steps(z)]), 1e-7, 1 - 1e-7)


FIRST = 0.3
_MIDDLE = 1 / (1 + np.exp(-(np.arange(STEPS) * 16 / (STEPS - 1) - 8)))


def _online(plan, tables):
    """Rows (at, v) of each bucket: by gate the curvature and the curvature times the weights, then what came true by gate and step."""

    def make(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                v = Vocabulary(pa.Table.from_batches([batch.slice(i, 1)]))
                if not v.counts.any():
                    continue
                steps = Steps(v, plan.value)
                mixer = Mixer(np.full((GATES, INPUTS), FIRST), None)
                curve, true = np.tile(4.0 * np.eye(INPUTS), (GATES, 1, 1)), np.zeros((2, GATES, STEPS))
                for at, bit, keys in steps.bits():
                    x, gate = _inputs(steps, tables.value, at, bit, keys, own=True)
                    weight = steps.seen[at]
                    for lo in range(0, len(at), BATCH):
                        part = slice(lo, lo + BATCH)
                        _update(mixer.weights, curve, true, mixer.odds(x[:, part], gate[part]), x[:, part], gate[part], bit[part], weight[part])
                extra = curve - 4.0 * np.eye(INPUTS)
                out = np.concatenate([extra.ravel(), np.einsum("gij,gj->gi", extra, mixer.weights).ravel(), true.ravel()])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), pa.array(out)], ["at", "v"])

    return make


def _update(weights, curve, true, z, x, gate, bit, weight) -> None:
    """One online step of each gate's weights, by the bits just predicted."""
    p = 1 / (1 + np.exp(-z))
    slot = gate * STEPS + Mixer.steps(z)
    true[0] += np.bincount(slot, weight * bit, GATES * STEPS).reshape(GATES, STEPS)
    true[1] += np.bincount(slot, weight, GATES * STEPS).reshape(GATES, STEPS)
    error, slope = weight * (p - bit), weight * np.maximum(p * (1 - p), 1e-3)
    for g in np.unique(gate):
        own = gate == g
        a = x[:, own].astype(np.float64)
        curve[g] += (a * slope[own]) @ a.T
        weights[g] = np.clip(weights[g] - np.linalg.solve(curve[g], a @ error[own]), -2, 4)


def fit_mixer(vocabulary: DataFrame, plan, tables) -> Mixer:
    size = GATES * INPUTS * INPUTS
    total = np.zeros(size + GATES * INPUTS + 2 * GATES * STEPS)
    for r in vocabulary.mapInArrow(_online(plan, tables), "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        total[r["at"]] = r["v"]
    curve, pull = total[:size].reshape(GATES, INPUTS, INPUTS), total[size : size + GATES * INPUTS].reshape(GATES, INPUTS)
    weights = np.stack([np.linalg.solve(curve[g] + 4.0 * np.eye(INPUTS), pull[g] + 4.0 * FIRST) for g in range(GATES)])
    true = total[size + GATES * INPUTS :].reshape(2, GATES, STEPS)
    return Mixer(np.round(weights, 6), np.round((true[0] + 30 * _MIDDLE) / (true[1] + 30), 9))


def _judge(plan, tables, mixer):
    """(bucket, keys, totals, logs): each unit's natural logarithm of probability, and its word's number of learning tokens."""

    def make(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                v = Vocabulary(pa.Table.from_batches([batch.slice(i, 1)]))
                steps = Steps(v, plan.value)
                logs = np.zeros(len(steps.byte))
                for at, bit, keys in steps.bits():
                    p = mixer.ones(*_inputs(steps, tables.value, at, bit, keys, own=False))
                    logs[at] += np.log(np.where(bit == 1, p, 1 - p))
                cum = np.concatenate([[0.0], np.cumsum(logs[steps.of])])
                unit = (cum[steps.edge[1:]] - cum[steps.edge[:-1]]).astype(np.float32)
                _, of = np.unique(v.word, return_inverse=True)
                total = np.bincount(of, v.counts)[of].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("bucket").slice(i, 1), *(pa.array([x.tobytes()], pa.binary()) for x in (v.key, total, unit))], ["bucket", "keys", "totals", "logs"]
                )

    return make


# Texts


def _block_keys(data_of, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of a block's texts and their buckets, by bucket, then key."""
    keys, buckets = [], []
    for _lo, _hi, data, offsets in data_of:
        t = Tokens(data, offsets, plan)
        one, _ = _distinct(t.key)
        keys.append(t.key[one])
        buckets.append(plan.near(data, t.start[one], t.end[one])[0])
    key, one = np.unique(np.concatenate(keys), return_index=True)
    bucket = np.concatenate(buckets)[one]
    order = np.argsort(bucket, kind="stable")
    return key[order], bucket[order]


def _asked(plan):
    """(bucket, block, keys): what each block asks each bucket."""

    def flush(block: int, texts: list):
        key, bucket = _block_keys(tokens.pieces(pa.array(texts, pa.large_string()), PIECE_BYTES), plan.value)
        edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
        cuts = list(zip(edges[:-1], edges[1:], strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket[edges[:-1]]), pa.array(np.full(len(cuts), block, np.int64)), pa.array([key[a:b].tobytes() for a, b in cuts], pa.binary())], ["bucket", "block", "keys"]
        )

    def make(batches):
        open_block, texts = None, []
        for batch in batches:
            for block, text in zip(batch.column("block").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if block != open_block and texts:
                    yield flush(open_block, texts)
                    texts = []
                open_block = block
                texts.append(text)
        if texts:
            yield flush(open_block, texts)

    return make


def _answered(asked: pa.Table, judged: pa.Table) -> pa.Table:
    """(block, bucket, totals, logs) for the keys of each block, in their order."""
    key, total, log = (np.frombuffer(b"".join(judged.column(n).to_pylist()), k) for n, k in (("keys", np.uint64), ("totals", np.int64), ("logs", np.float32)))
    totals, logs = [], []
    for keys in asked.column("keys"):
        at = np.searchsorted(key, np.frombuffer(keys.as_py(), np.uint64))
        totals.append(total[at].tobytes())
        logs.append(log[at].tobytes())
    return pa.table({"block": asked.column("block"), "bucket": asked.column("bucket"), "totals": pa.array(totals, pa.binary()), "logs": pa.array(logs, pa.binary())})


def _earlier(keys: np.ndarray) -> np.ndarray:
    """How often each key came earlier."""
    of, _ = pd.factorize(keys)
    order = np.argsort(of, kind="stable")
    ordered = of[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    begin = np.maximum.accumulate(np.where(fresh, np.arange(len(keys)), 0))
    out = np.empty(len(keys), np.float64)
    out[order] = np.arange(len(keys)) - begin
    return out


def _with_history(t: Tokens, mixed: np.ndarray) -> np.ndarray:
    """The probability of each token: the bits' (mixed), the share of the word in the text so far, and its share of what came
    after the same word, by weights that are the mean success of each so far. All three are distributions over words, so that
    their mixture is one."""
    spot = np.arange(len(t.word)) - t.first[:-1][t.doc]
    salt = tokens.mix64(t.doc.astype(np.uint64) + np.uint64(1))
    before = np.zeros(len(t.word), np.uint64)
    before[1:] = t.word[:-1]
    before[spot == 0] = 1
    word = _earlier(tokens.mix64(t.word ^ salt)) / np.maximum(spot, 1)
    context, pair = _earlier(tokens.mix64(before ^ salt)), _earlier(tokens.mix64(tokens.mix64(t.word ^ salt) ^ (before * _ODD)))
    parts = np.stack([mixed, word, np.where(context > 0, pair / np.maximum(context, 1), mixed)])
    share = np.stack([parts[0] * (1 - PRIOR[0] - PRIOR[1]), parts[1] * 0.3, np.where(context > 0, parts[2] * 0.3, 0)])
    share = share / share.sum(axis=0)
    weight = np.empty_like(share)
    for k in (1, 2):
        cum = np.concatenate([[0.0], np.cumsum(share[k])])
        weight[k] = (cum[:-1] - cum[t.first[:-1]][t.doc] + PRIOR[k - 1] * PRIOR[2]) / (spot + PRIOR[2])
    weight[1][spot == 0] = 0
    weight[0] = 1 - weight[1] - weight[2]
    return (weight * parts).sum(axis=0)


def _score(plan):
    def make(docs: pa.Table, answers: pa.Table) -> pa.Table:
        texts = docs.column("text").combine_chunks()
        keys, _ = _block_keys(tokens.pieces(texts, PIECE_BYTES), plan.value)
        answers = answers.sort_by("bucket")
        total, log = (np.frombuffer(b"".join(answers.column(n).to_pylist()), k) for n, k in (("totals", np.int64), ("logs", np.float32)))
        order = np.argsort(keys)
        keys, total, log = keys[order], total[order], log[order]
        n_tokens, n_known, base, score, size = ([] for _ in range(5))
        for _lo, _hi, data, offsets in tokens.pieces(texts, PIECE_BYTES):
            t = Tokens(data, offsets, plan.value)
            at = np.searchsorted(keys, t.key)
            c = total[at].astype(np.float64)
            part = lambda v, t=t: np.add.reduceat(v, t.first[:-1])
            n_tokens.append(np.diff(t.first))
            n_known.append(part((c > 0).astype(np.int64)))
            base.append(part(np.log10(c + 0.5)))
            score.append(part(np.log10(_with_history(t, np.exp(log[at].astype(np.float64))))))
            size.append(np.diff(offsets) + 1)
        whole = lambda x, kind: pa.array(np.concatenate(x), kind)
        return pa.table(
            {
                "id": docs.column("id"), "held_out": docs.column("held_out"), "n_tokens": whole(n_tokens, pa.int64()), "n_known": whole(n_known, pa.int64()),
                "logs": whole(base, pa.float64()), "score": whole(score, pa.float64()), "n_bytes": whole(size, pa.int64()),
            }
        )

    return make


def make_plan(learning: DataFrame, total_bytes: int) -> Plan:
    """learning: the texts to learn from, in one column. Two sums over all of them."""
    sums = _summed(learning, _add_pairs, 257 + PAIRS + PAIRS * PAIRS)
    places, spread = _axes(sums)
    cells = _summed(learning, _add_cells(places, spread), CELLS**AXES + (1 << PREFIX_BITS))
    scaled = np.rint(places / spread * 4096).astype(np.int64)
    hot = cells[CELLS**AXES :] > HOT
    return Plan(prefix_code(sums[:256]), np.concatenate([scaled, np.ones((PAIRS, 1), np.int64)], axis=1), _centres(cells[: CELLS**AXES]) * 4096, hot, max(1, -(-total_bytes // BUCKET_BYTES)))


def language_scores(docs: DataFrame, held_out=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    held_out: a condition on the id; such documents are not learned from. Null text counts as empty: its end alone. A null id
    is learned from. Repeated rows count each time and get the same answer. Extra columns are not read; an empty table gives no
    rows.
    """
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    held_out = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), held_out.alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    plan = share(make_plan(rows.where(~F.col("held_out")).select("text"), size))
    units = rows.select("text", (~F.col("held_out")).alias("learn")).mapInArrow(_units(plan), _UNITS)
    vocabulary = cut(units.groupBy("bucket").applyInArrow(_merge, f"{_UNITS}, n long, v long"))
    sums = vocabulary.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = sums["n"] or 0, sums["v"] or 0
    tables = share(count_tables(vocabulary, plan))
    mixer = fit_mixer(vocabulary, plan, tables)
    judged = vocabulary.mapInArrow(_judge(plan, tables, mixer), "bucket long, keys binary, totals binary, logs binary")

    blocks = max(1, -(-size // BLOCK_BYTES))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks))).repartition("block")
    # the same columns as the texts' side of the cogroup, so that one exchange of the texts serves both
    asked = dealt.sortWithinPartitions("block").mapInArrow(_asked(plan), "bucket long, block long, keys binary")
    answers = asked.groupBy("bucket").cogroup(judged.groupBy("bucket")).applyInArrow(_answered, "block long, bucket long, totals binary, logs binary")
    kind = f"id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, logs double, score double, n_bytes long"
    scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(plan), kind)
    base = F.col("logs") - F.col("n_tokens") * F.lit(math.log10(n + 0.5 * (v + 1)))
    return scored.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
        (-F.col("score") * F.lit(math.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
