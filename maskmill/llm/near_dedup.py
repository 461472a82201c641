"""Near-duplicate groups by a MinHash LSH forest (operator 9).

1. Each document's set of word shingles gives a size, a 64-bit hash of the whole set, and min-hashes. Equal sets are one
   class from here on, however many copies it has.
2. Every tree of the forest sorts all classes by its own rotation of the signature. A region is a run of classes that
   share the first values (the shallowest depth). A region too large for one look is cut along the sorted order, so its
   pieces share longer prefixes: the depth adapts to the region, and range partitioning splits it over tasks.
3. In a piece, estimates from the whole sketch give a spanning forest of the most similar pairs and a link of each class
   to a leader, at most two candidates a class.
4. Candidates of all trees, each once, are confirmed on the full sets, block against block of neighbours. Their components
   are the parts of the second round, which doubts two kinds of classes: those with a likely partner of another part in a
   piece, and those of regions that were cut (by size, or by the borders of range partitions) and hold more than one part.
5. Doubtful classes of different parts are matched exactly: a class is found by those of its shingles that are rarest among
   all doubtful classes. Two sets so similar have a shingle in common early in both, at places that leave enough to share.
   These pairs are confirmed like the others, and components come from the links of both rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .shared import connected_components, cut, slots

TREES, DEPTH, PIECE = 20, 3, 512
#: Hashes that the trees sort by, more of which estimates alone use one byte, and all values of an order below the region's.
HASHES, EXTRA = TREES * DEPTH, 36
BELOW = HASHES - DEPTH + EXTRA
SALTS = 32
#: Classes that share a rare shingle and are matched in one task; more are dealt over several.
SHARE = 4096
#: Full sets of a block, by number and by bytes, while pairs are confirmed.
BLOCK, BLOCK_BYTES = 64, 1 << 20
_rng = np.random.default_rng(9)
_MULT = (_rng.integers(0, 1 << 63, HASHES + EXTRA, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, HASHES + EXTRA, dtype=np.uint64)


def _sets(texts: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray]]:
    for lo, hi, data, offsets in tokens.pieces(texts):
        starts, ends, first = tokens.spans(data, offsets)
        hashed = tokens.hashes(data, starts, ends)
        for i in range(hi - lo):
            yield lo + i, tokens.shingles(hashed[first[i] : first[i + 1]], words)


def _set_key(found: np.ndarray) -> int:
    return int(tokens.mix64(found ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64))


def _signature(found: np.ndarray) -> bytes:
    low = np.full(HASHES + EXTRA, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(found), 4096):
        part = found[at : at + 4096]
        np.minimum(low, ((part[None, :] * _MULT[:, None] + _ADD[:, None]) >> np.uint64(32)).astype(np.uint32).min(axis=1), out=low)
    return low[:HASHES].astype(">u4").tobytes() + (low[HASHES:] & 255).astype(np.uint8).tobytes()


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """(id, n_shingles, key, sig) of every row: key identifies the set; key and sig are null if it is empty."""

    def make(batches):
        for batch in batches:
            rows: list = [(0, None, None)] * batch.num_rows
            for i, found in _sets(batch.column(1), words):
                if len(found):
                    rows[i] = (len(found), _set_key(found), _signature(found))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], ["id", "n_shingles", "key", "sig"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(make, f"id {kind}, n_shingles long, key long, sig binary")


OWN = 4 * DEPTH  # bytes of an order that name the region


def _forest(batches):
    """Rows (tree, order, key and the columns after sig): order is the tree's own values in full, then one byte of each other
    value, in turn."""
    for batch in batches:
        keys = batch.column(0)
        whole = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, 4 * HASHES + EXTRA)
        sig, extra = whole[:, : 4 * HASHES].reshape(-1, HASHES, 4), whole[:, 4 * HASHES :]
        for tree in range(TREES):
            own = sig[:, tree * DEPTH : (tree + 1) * DEPTH].reshape(len(sig), -1)
            turned = np.roll(sig[:, :, 3], -(tree + 1) * DEPTH, axis=1)[:, : HASHES - DEPTH]
            order = np.concatenate([own, turned, extra], axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(sig), tree, np.int32)), _binary(order), keys, *batch.columns[2:]],
                ["tree", "order", "key", *batch.schema.names[2:]],
            )


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    edges = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(edges), pa.py_buffer(rows)])


def _likely(bytes_: np.ndarray, least: int) -> np.ndarray:
    """How many values of the sketch agree for each pair of a piece; 0 below least."""
    same = np.zeros((len(bytes_), len(bytes_)), np.int16)
    for k in range(bytes_.shape[1]):
        same += bytes_[:, None, k] == bytes_[None, :, k]
    same[same < least] = 0
    np.fill_diagonal(same, 0)
    return same


def _candidates(keys: np.ndarray, sketch: np.ndarray, least: int, close: int) -> set[tuple[int, int]]:
    """A spanning forest of the most similar pairs of the piece, and each class's link to the leader nearest to it."""
    order = np.argsort(keys)
    keys, same = keys[order], _likely(sketch[order], least)
    n, pairs = len(keys), set()
    left, best, via = np.ones(n, bool), np.zeros(n, np.int16), np.full(n, -1)
    for _ in range(n):
        at = int(np.argmax(np.where(left, best, -1)))
        if via[at] >= 0 and best[at] > 0:
            pairs.add((via[at], at))
        left[at] = False
        better = left & (same[at] > best)
        best[better], via[better] = same[at][better], at
    open_, leaders = np.ones(n, bool), []
    for i in range(n):
        if open_[i]:
            leaders.append(i)
            open_[same[i] >= close] = False
            open_[i] = False
    to = same[:, leaders]
    for i in np.flatnonzero(to.max(axis=1) > 0):
        pairs.add((int(i), leaders[int(np.argmax(to[i]))]))
    return {(int(min(keys[i], keys[j])), int(max(keys[i], keys[j]))) for i, j in pairs if keys[i] != keys[j]}


def _pieces(batches):
    """For each batch, the pieces of regions that end in it, as rows (prefix, sketch, key and what else the batches hold), and the
    (tree, prefix) of regions that may have been cut: the large ones, and a partition's first and last."""
    held: list = []  # the open region's rows so far
    for batch in batches:
        done, split = [], set()
        for tree, order, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            prefix = (tree, order[:OWN])
            if not held:
                split.add(prefix)
            elif held[-1][0] != prefix:
                done.append(held)
                held = []
            elif len(held) == PIECE:  # go on in the same region: one row in eight stays, so that pieces overlap
                done.append(held)
                split.add(prefix)
                held = held[::8]
            held.append((prefix, order[OWN:], *rest))
        yield [rows for rows in done if len(rows) > 1], split
    if held:
        yield [held] if len(held) > 1 else [], {held[-1][0]}


def _sketch(rows: list) -> np.ndarray:
    return np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(len(rows), -1)


def _least(similarity: float) -> int:
    """So many of BELOW values agree at that similarity but for 4 in 100,000 pairs (0.8: four standard errors)."""
    return int(BELOW * max(0.0, similarity - 0.165))


def _regions(similarity: float):
    """Candidates (a, b) of the first round."""
    least, close = _least(similarity), int(BELOW * similarity)

    def make(batches):
        for pieces, _ in _pieces(batches):
            found: set = set()
            for rows in pieces:
                found |= _candidates(np.array([r[2] for r in rows], np.int64), _sketch(rows), least, close)
            if found:
                yield _pairs_batch(sorted(found))

    return make


def _doubts(similarity: float):
    """The classes of a piece with a likely partner of another part (key), and regions that may have been cut (tree, prefix)."""
    least, percent = _least(similarity), round(100 * similarity)

    def make(batches):
        for pieces, split in _pieces(batches):
            found: set = set()
            for rows in pieces:
                keys, part, size = np.array([r[2:] for r in rows], np.int64).T
                if (part == part[0]).all():
                    continue
                fits = (part[:, None] != part[None, :]) & (100 * np.minimum(size[:, None], size[None, :]) >= percent * np.maximum(size[:, None], size[None, :]))
                found.update(keys[(fits & (_likely(_sketch(rows), least) > 0)).any(axis=1)].tolist())
            if found or split:
                tree, prefix = zip(*sorted(split), strict=True) if split else ((), ())
                none = [None] * max(len(found), len(split))
                cols = [(sorted(found), pa.int64()), (tree, pa.int32()), (prefix, pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array([*c, *none[len(c) :]], kind) for c, kind in cols], ["key", "tree", "prefix"])

    return make


def _pairs_batch(found: list) -> pa.RecordBatch:
    a, b = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _filter_bits(nodes: DataFrame, bits: int = 24) -> np.ndarray:
    """One bit for each low part of a node's key: at most 2 ** bits / 8 bytes, whatever the number of nodes."""
    slot = nodes.select((F.col("node").bitwiseAND((1 << bits) - 1)).alias("slot"))
    mask = F.expr("bit_or(shiftleft(1L, cast(slot % 32 AS int)))")
    rows = slot.groupBy(F.expr("slot div 32").alias("word")).agg(mask.alias("mask")).toPandas()
    words = np.zeros(1 << (bits - 5), np.uint32)
    words[rows["word"].to_numpy(np.int64)] = rows["mask"].to_numpy(np.int64).astype(np.uint32)
    return words


def _full_sets(docs: DataFrame, text_col: str, words: int, nodes: DataFrame) -> DataFrame:
    """(node, members) of the wanted classes. A bit filter of fixed size keeps other documents' sets from the shuffle."""
    bits = docs.sparkSession.sparkContext.broadcast(_filter_bits(nodes))

    def make(batches):
        want = bits.value
        for batch in batches:
            out: dict = {}
            for _, found in _sets(batch.column(0), words):
                if len(found):
                    key = _set_key(found)
                    low = key & 0xFFFFFF
                    if int(want[low >> 5]) >> (low & 31) & 1 and key not in out:
                        out[key] = found.tobytes()
            if out:
                k, v = zip(*out.items(), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(v, pa.binary())], ["node", "members"])

    sets = docs.select(text_col).mapInArrow(make, "node long, members binary")
    return sets.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("members").alias("members"))


def _overlaps(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many members each of the others shares with x; all are sorted, without repeats and not empty."""
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(x, flat), len(x) - 1)
    return np.add.reduceat(x[at] == flat, np.cumsum([0, *map(len, others[:-1])]), dtype=np.int64)


def _confirm(similarity: float):
    """The similar ones of the pairs. Rows come by (p, q), first its sets (a: node, b: null), then its pairs by a."""
    percent = round(100 * similarity)

    def similar(sets: dict, pairs: list):
        for a, run in groupby(pairs, itemgetter(0)):
            x, near = sets[a], [b for _, b in run]
            near = [b for b in near if 100 * min(len(x), len(sets[b])) >= percent * max(len(x), len(sets[b]))]
            if near:
                both = _overlaps(x, [sets[b] for b in near])
                yield from ((a, b) for b, n in zip(near, both, strict=True) if 100 * n >= percent * (len(x) + len(sets[b]) - n))

    def make(batches):
        sets: dict = {}
        block = None
        for batch in batches:
            keep, pairs = [], []
            for p, q, a, b, members in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (p, q) != block:
                    keep.extend(similar(sets, pairs))
                    block, sets, pairs = (p, q), {}, []
                if b is None:
                    sets[a] = np.frombuffer(members, np.uint64)
                else:
                    pairs.append((a, b))
            keep.extend(similar(sets, pairs))
            if keep:
                yield _pairs_batch(keep)

    return make


def _blocks(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, block): nodes with the same smallest neighbour go together, in blocks of about BLOCK sets and BLOCK_BYTES."""
    ends = pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("other")))
    near = ends.groupBy("node").agg(F.least(F.min("other"), "node").alias("near"))
    sized = near.join(sets.select("node", F.length("members").alias("bytes")), "node")
    many = sized.groupBy("near").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("bytes") / BLOCK_BYTES)).alias("blocks"))
    return sized.join(many, "near").select("node", F.xxhash64("near", F.pmod(F.xxhash64("node"), F.col("blocks"))).alias("block"))


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartitionByRange(slots(rows.sparkSession), "tree", "order").sortWithinPartitions("tree", "order")


def _trees(classes: DataFrame, more: str = "") -> DataFrame:
    """The rows of all trees. classes: key, sig and the columns that more names with their types."""
    return classes.mapInArrow(_forest, f"tree int, order binary, key long{more}")


def _prefix():
    return F.expr(f"substring(order, 1, {OWN})")


def _doubtful(parted: DataFrame, similarity: float) -> DataFrame:
    """node: the classes that may have a partner of another part that the pieces did not show."""
    seen = cut(_sorted(parted).mapInArrow(_doubts(similarity), "key long, tree int, prefix binary"))
    # a region's classes are dealt over SALTS tasks
    regions, salts = ["tree", "prefix"], F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>"))
    split = seen.where("tree IS NOT NULL").select(*regions).distinct().withColumn("salt", salts)
    named = parted.select("tree", F.expr(f"substring(order, 1, {OWN})").alias("prefix"), "key", "part", F.pmod(F.xxhash64("key"), F.lit(SALTS)).alias("salt"))
    own = cut(named.join(split, [*regions, "salt"], "left_semi"))
    ends = own.groupBy(*regions).agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least < most").withColumn("salt", salts)
    keys = own.join(ends, [*regions, "salt"], "left_semi").select("key").unionByName(seen.where("key IS NOT NULL").select("key"))
    return cut(keys.select(F.col("key").alias("node")).distinct())


def _members(batches):
    for batch in batches:
        for node, part, members in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = np.frombuffer(members, np.int64)
            many = [pa.array(np.full(len(found), v, np.int64)) for v in (node, part, len(found))]
            yield pa.RecordBatch.from_arrays([*many, pa.array(found)], ["node", "part", "size", "member"])


def _matched(sets: DataFrame, parts: DataFrame, similarity: float) -> DataFrame:
    """(a, b): every pair of sets (node, members) of different parts (node, part) that may be as similar as that, none left out.

    Members are taken in one order for all sets, rarest first. If the first member that x and y share is at places i of x
    and j of y (from 0), they share at most min(|x| - i, |y| - j), which has to reach what the similarity asks for.
    """
    p = round(100 * similarity)
    members = sets.join(parts, "node").select("node", "part", "members").mapInArrow(_members, "node long, part long, size long, member long")
    held = members.groupBy("member").agg(F.count("*").alias("held"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("held", "member")) - 1
    early = members.join(held, "member").withColumn("left", F.col("size") - place).where((F.col("held") > 1) & (100 * F.col("left") >= p * F.col("size")))
    early = cut(early.withColumn("deals", F.expr(f"held div {SHARE} + 1")))
    side = [early.select("member", "salt", *(F.col(c).alias(c + s) for c in ("node", "part", "size", "left"))) for s, early in (
        ("_x", early.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("deals")))),
        ("_y", early.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)))),
    )]
    reach = (100 + p) * F.least("left_x", "left_y") >= p * (F.col("size_x") + F.col("size_y"))
    met = side[0].join(side[1], ["member", "salt"]).where((F.col("node_x") < F.col("node_y")) & (F.col("part_x") != F.col("part_y")) & reach)
    return met.select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose full sets are as similar as that.

    Pairs are dealt by the blocks of their two ends, and a set goes once to each pair of blocks that needs it: where
    nearly all of a group's members are pairs of each other, that is once for BLOCK pairs.
    """
    blocks = cut(_blocks(pairs, sets))
    placed = (
        pairs.join(blocks.select(F.col("node").alias("a"), F.col("block").alias("x")), "a")
        .join(blocks.select(F.col("node").alias("b"), F.col("block").alias("y")), "b")
        .select(F.least("x", "y").alias("p"), F.greatest("x", "y").alias("q"), "a", "b")
    )
    placed = cut(placed)
    wanted = placed.select("p", "q", F.explode(F.array("a", "b")).alias("node")).distinct().join(sets, "node")
    rows = wanted.select("p", "q", F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "members").unionByName(
        placed.withColumn("members", F.lit(None).cast("binary"))
    )
    dealt = rows.repartition(slots(pairs.sparkSession), "p", "q").sortWithinPartitions("p", "q", F.col("b").isNotNull(), "a", "b")
    return cut(dealt.mapInArrow(_confirm(similarity), "a long, b long"))


def links(docs: DataFrame, marks: DataFrame, text_col: str, words: int, similarity: float) -> DataFrame:
    """Confirmed links (a, b) between classes, named by the key of their sets; marks are the sketches of docs."""
    classes = marks.where(F.col("sig").isNotNull()).groupBy("key").agg(F.first("sig").alias("sig"), F.first("n_shingles").alias("size"))
    pairs = cut(_sorted(_trees(classes.select("key", "sig"))).mapInArrow(_regions(similarity), "a long, b long").distinct())
    nodes = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    first = _confirmed(pairs, cut(_full_sets(docs, text_col, words, nodes)), similarity)
    joined = connected_components(first).select(F.col("node").alias("key"), "label")
    parts = cut(classes.join(joined, "key", "left").select("key", "sig", F.coalesce("label", "key").alias("part"), "size"))
    doubtful = _doubtful(_trees(parts, ", part long, size long"), similarity)
    if not doubtful.limit(1).count():
        return first
    sets = cut(_full_sets(docs, text_col, words, doubtful))
    rest = cut(_matched(sets, parts.select(F.col("key").alias("node"), "part"), similarity))
    return first.unionByName(_confirmed(rest, sets, similarity)) if rest.limit(1).count() else first


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id (smallest id of its group), kept (id = component_id).

    Null or empty text: an empty set, linked with nothing, its own group. Null id: component_id null, kept, and it names no
    group. Rows that repeat an id are rows of their own, with the same answer if their text is the same. Extra columns are
    not read. An empty table gives an empty table.
    """
    marks = cut(sketches(docs, id_col, text_col, words))
    joined = connected_components(links(docs, marks, text_col, words, similarity))
    classes = marks.where(F.col("sig").isNotNull()).groupBy("key").agg(F.min("id").alias("least"))
    grouped = classes.join(joined, classes["key"] == joined["node"], "left").select("key", "least", "label", F.pmod(F.xxhash64("key"), F.lit(SALTS)).alias("salt"))
    # a large component's classes are dealt over SALTS tasks
    tops = grouped.where("label IS NOT NULL").groupBy("label").agg(F.min("least").alias("top")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
    named = grouped.join(tops, ["label", "salt"], "left").select("key", F.coalesce("top", "least").alias("component_id"))
    out = marks.select("id", "n_shingles", "key").join(named, "key", "left")
    component = F.when(F.col("id").isNull(), None).otherwise(F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without all but one document of each group, the one with the smallest id. Rows without an id stay; of rows that
    repeat an id one stays."""
    kept = near_duplicates(docs, id_col, text_col, words, similarity).where("kept").select(id_col).where(F.col(id_col).isNotNull()).distinct()
    named = docs.where(F.col(id_col).isNotNull()).join(kept, id_col, "left_semi").dropDuplicates([id_col])
    return named.select(docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
