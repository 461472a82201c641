"""Jaccard join of word n-gram sets by signature trees (operator 12).

1. Equal sets are one class, named by the hash of the set. Sets are dealt to regions: two sets as similar as asked share one of the
   first shingles of each in one order for all sets (so many that the rest could not hold the whole overlap). The order puts
   shingles that many sets hold last. Of the sets that share such a shingle and are of a like size, the smallest key leads
   the region. A set of band k (a band's sizes are all similar to each other or to the next band's) goes to the regions of bands k and k + 1.
2. Regions are cut into pieces of at most PIECE sets in sorted order. Each piece becomes a signature tree: a leaf is the bitmap of
   a set's shingles and its size; a node is the OR of its children's bitmaps, the range of their sizes, and the most shingles
   that any of its sets loses to collisions. A pair of nodes is entered, from the roots down, only if a pair of sets below could
   be similar: the sizes allow it, and so do the common bits plus the smaller loss, the largest overlap there can be.
3. Pairs of leaves that remain are confirmed on full sets. Where a piece leaves many pairs, only a spanning forest of the most
   similar ones is proposed first, and its regions stay open, as do regions that were cut.
4. Confirmed links make parts. Sets of open regions that hold more than one part are dealt to blocks, and each pair of blocks that
   could hold a link between two parts is joined by dual traversal of its two trees, leaving out pairs of nodes that are all of
   one part. All pairs that remain are confirmed: no link between parts is lost, whatever the size of a region.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near_dedup
from .shared import connected_components, cut, slots

FAN, PIECE, PIECE_BYTES, BLOCK, SALTS = 8, 1024, 16 << 20, 256, 32
#: Sets that share a first shingle are looked at in pairs, by their sizes and the shingle's places, up to so many.
RUN = 64
#: Bits of a bitmap for each shingle of the largest set of its band, at least.
BITS = 4
#: Shingles that so many sets of one look hold are counted over all; of these, those in HOT_SETS sets or more are put last. The list
#: that tasks get has HOT_LIST entries at most; it only orders the shingles.
LOOK, LOOK_LEAST, HOT_SETS, HOT_LIST = 1 << 20, 4, 64, 1 << 17


def _edges(percent: int) -> np.ndarray:
    """The smallest size of each band: two sizes that similar sets can have are in one band or in two that follow each other."""
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(100 * edges[-1] // percent + 1)
    return np.array(edges, np.int64)


def _words(edges: np.ndarray, tag: int) -> int:
    """64-bit words of a bitmap of the band: a power of two."""
    bits = BITS * int(edges[tag + 1])
    return max(1, 1 << (bits - 1).bit_length() >> 6)


def _bitmap(found: np.ndarray, words: int) -> np.ndarray:
    bits = np.zeros(words * 64, bool)
    bits[(found & np.uint64(words * 64 - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def _marks(words: int):
    """A row for each document, and rows (token, held) of shingles that several sets of one look hold."""

    def frequent(sets: list, kind: pa.DataType):
        token, held = np.unique(np.concatenate(sets), return_counts=True)
        often = held >= LOOK_LEAST
        n, none = int(often.sum()), lambda k: pa.nulls(int(often.sum()), k)
        if n:
            yield pa.RecordBatch.from_arrays([none(kind), none(pa.int64()), none(pa.int64()), pa.array(token[often].astype(np.int64)), pa.array(held[often])], ["id", "n_shingles", "key", "token", "held"])

    def make(batches):
        sets, seen, size, kind = [], set(), 0, None
        for batch in batches:
            kind = batch.column(0).type
            rows: list = [(0, None)] * batch.num_rows
            for i, found in near_dedup._sets(batch.column(1), words):
                if len(found):
                    key = near_dedup._set_key(found)
                    rows[i] = (len(found), key)
                    if key not in seen:
                        seen.add(key)
                        sets.append(found)
                        size += len(found)
                    if size > LOOK:
                        yield from frequent(sets, kind)
                        sets, seen, size = [], set(), 0
            n, key = zip(*rows, strict=True) if rows else ((), ())
            none = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.int64()), none, none], ["id", "n_shingles", "key", "token", "held"])
        if sets:
            yield from frequent(sets, kind)

    return make


def _hot(marks: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles to be put last, sorted, and their places."""
    sums = marks.where("token IS NOT NULL").groupBy("token").agg(F.sum("held").alias("held")).where(F.col("held") >= HOT_SETS)
    rows = sums.orderBy(F.desc("held"), "token").limit(HOT_LIST).collect()
    token = np.array([r["token"] for r in rows], np.int64).astype(np.uint64)
    order = np.argsort(token)
    return token[order], (len(rows) - np.arange(len(rows)))[order]


def _firsts(words: int, percent: int, hot: tuple[np.ndarray, np.ndarray]):
    """(key, size, band, cold, hot, bits) of each distinct set of a batch: its first shingles, hot ones apart, and its bitmap."""
    edges, (tokens, places) = _edges(percent), hot

    def make(batches):
        for batch in batches:
            out: dict = {}
            for _, found in near_dedup._sets(batch.column(0), words):
                if not len(found):
                    continue
                key = near_dedup._set_key(found)
                if key in out:
                    continue
                many = len(found) + (-percent * len(found)) // 100 + 1
                place = np.zeros(len(found), np.int64)
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, found), len(tokens) - 1)
                    place = np.where(tokens[at] == found, places[at], 0)
                first = np.lexsort((found, place))[:many]
                band = int(np.searchsorted(edges, len(found), "right")) - 1
                cold = place[first] == 0
                out[key] = (len(found), band, found[first[cold]].astype(np.int64), found[first[~cold]].astype(np.int64), _bitmap(found, _words(edges, band + 1)).tobytes())
            if out:
                size, band, cold, often, bits = zip(*out.values(), strict=True)
                lists = [pa.array(c, pa.list_(pa.int64())) for c in (cold, often)]
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(size, pa.int64()), pa.array(band, pa.int32()), *lists, pa.array(bits, pa.binary())], ["key", "size", "band", "cold", "hot", "bits"])

    return make


def _near(run: list[tuple[int, int, int]], percent: int, edges: list[int]):
    """(tag, lead, key) of the sets (key, size, place) of one shingle's run that may have a partner there. If the shingle is the first
    that a pair shares, the pair shares no more than what the smaller rest of the two holds; if it is not, the pair meets at that one."""
    members: dict[int, set[int]] = {}
    for i, (x, size_x, at_x) in enumerate(run):
        for y, size_y, at_y in run[:i]:
            if (100 + percent) * min(size_x - at_x, size_y - at_y) >= percent * (size_x + size_y):
                members.setdefault(bisect_right(edges, max(size_x, size_y)) - 1, set()).update((x, y))
    for tag, keys in members.items():
        lead = min(keys)
        yield from ((tag, lead, key) for key in keys)


def _led(leads: dict[int, list], key: int, band: int):
    """The rows of one more set of a run in which the first key of a tag leads it."""
    for tag in (band, band + 1):
        lead = leads.setdefault(tag, [key, False])
        if lead[0] != key:
            if not lead[1]:
                lead[1] = True
                yield tag, lead[0], lead[0]
            yield tag, lead[0], key


def _runs(percent: int):
    """(tag, lead, key) of rows (token, key, size, place) sorted by token and key. Runs of more than RUN sets are not held: in these the
    first key of a tag leads it, and no pair is looked at."""
    edges = _edges(percent).tolist()

    def make(batches):
        token, run, leads, last = None, [], None, None  # the run's sets, or its leaders once it is too long to be held
        for batch in batches:
            tokens, *rest = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            same = np.zeros(len(tokens) + 1, bool)
            same[1:-1] = tokens[1:] == tokens[:-1]
            same[0] = same[-1] = True  # a run may go on from one batch to the next
            out: list = []
            rows = np.flatnonzero(same[1:] | same[:-1])
            for t, key, size, place in zip(tokens[rows].tolist(), *(c[rows].tolist() for c in rest), strict=True):
                if t != token:
                    out.extend(_near(run, percent, edges))
                    token, run, leads, last = t, [], None, None
                if key == last:
                    continue
                last = key
                if leads is None:
                    run.append((key, size, place))
                    if len(run) <= RUN:
                        continue
                    leads = {}
                    added, run = run, []
                else:
                    added = [(key, size, place)]
                out.extend(row for k, n, _ in added for row in _led(leads, k, bisect_right(edges, n) - 1))
            if out:
                yield _region_rows(out)
        out = list(_near(run, percent, edges))
        if out:
            yield _region_rows(out)

    return make


def _region_rows(rows: list) -> pa.RecordBatch:
    tag, lead, key = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(tag, pa.int32()), pa.array(lead, pa.int64()), pa.array(key, pa.int64())], ["tag", "lead", "key"])


def _regions(firsts: DataFrame, percent: int) -> DataFrame:
    """(tag, lead, key): which sets may have a partner among those that share a first shingle with lead."""
    spark = firsts.sparkSession
    cold = firsts.select(F.posexplode("cold").alias("place", "token"), "key", F.col("size").cast("int").alias("size")).select("token", "key", "size", "place")
    runs = cold.repartition(slots(spark), "token").sortWithinPartitions("token", "key").mapInArrow(_runs(percent), "tag int, lead long, key long")
    # tokens that many sets hold are never one task's: leaders by an aggregate, rows dealt over SALTS
    often = firsts.select(F.explode("hot").alias("token"), "key", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("tag"))
    leads = often.groupBy("token", "tag").agg(F.min("key").alias("lead"), F.max("key").alias("last")).where("lead < last").drop("last")
    salted = leads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
    dealt = often.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS))).join(salted, ["token", "tag", "salt"])
    return runs.unionByName(dealt.select("tag", "lead", "key")).distinct()


class Tree:
    """The levels of a signature tree, leaves first; each has the bitmaps, size ranges, losses and parts of its nodes."""

    def __init__(self, bits: np.ndarray, size: np.ndarray, part: np.ndarray):
        loss = size - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [(bits, size, size, loss, part, part)]
        while len(self.levels[-1][0]) > 1:
            starts = np.arange(0, len(self.levels[-1][0]), FAN)
            ways = (np.bitwise_or, np.minimum, np.maximum, np.maximum, np.minimum, np.maximum)
            self.levels.append(tuple(f.reduceat(x, starts, axis=0) for f, x in zip(ways, self.levels[-1], strict=True)))


def _possible(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether any pair below nodes i of one level and j of the other could be similar and of two parts."""
    low_a, high_a, low_b, high_b = a[1][i], a[2][i], b[1][j], b[2][j]
    fits = (100 * high_a >= percent * low_b) & (100 * high_b >= percent * low_a)
    fits &= (a[4][i] != a[5][i]) | (b[4][j] != b[5][j]) | (a[4][i] != b[4][j])
    loss = np.minimum(a[3][i], b[3][j])
    step = max(1, (4 << 20) // max(1, a[0].shape[1]))
    at = np.flatnonzero(fits)
    for k in range(0, len(at), step):
        some = at[k : k + step]
        common = np.bitwise_count(a[0][i[some]] & b[0][j[some]]).sum(axis=1, dtype=np.int64)
        most = np.minimum(common + loss[some], np.minimum(high_a[some], high_b[some]))
        fits[some] = (100 + percent) * most >= percent * (low_a[some] + low_b[some])
    return fits


def meet(a: Tree, b: Tree, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of leaves that dual traversal leaves; within one tree each pair once."""
    own = a is b
    height = max(len(a.levels), len(b.levels))
    level = lambda t, k: t.levels[min(k, len(t.levels) - 1)]
    i = j = np.zeros(1, np.int64)
    for k in range(height - 1, -1, -1):
        if k < height - 1:  # to the children; a tree that is lower waits at its root
            sides = []
            for t, at in ((a, i), (b, j)):
                if k < len(t.levels) - 1:
                    n = len(t.levels[k][0])
                    sides.append(np.where((kids := at[:, None] * FAN + np.arange(FAN)) < n, kids, -1))
                else:
                    sides.append(at[:, None])
            x, y = np.broadcast_arrays(sides[0][:, :, None], sides[1][:, None, :])
            good = (x >= 0) & (y >= 0) & ((x <= y) if own else True)
            i, j = x[good], y[good]
        fits = _possible(level(a, k), level(b, k), i, j, percent)
        i, j = i[fits], j[fits]
    return (i[i < j], j[i < j]) if own else (i, j)


def _folded(bits: list[bytes], words: int) -> np.ndarray:
    """Bitmaps as rows of so many words; wider ones are folded."""
    out = np.zeros((len(bits), words), np.uint64)
    for k, b in enumerate(bits):
        out[k] = np.bitwise_or.reduce(np.frombuffer(b, np.uint64).reshape(-1, words), axis=0)
    return out


def _tree(rows: list, words: int) -> Tree:
    """rows: (key, size, bits, part)."""
    return Tree(_folded([r[2] for r in rows], words), np.array([r[1] for r in rows], np.int64), np.array([r[3] for r in rows], np.int64))


def _forest(tree: Tree, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the most similar of the pairs, by their bitmaps."""
    bits, size = tree.levels[0][:2]
    n = len(size)
    near = np.zeros((n, n), np.float32)
    for k in range(0, len(i), 4096):
        x, y = i[k : k + 4096], j[k : k + 4096]
        common = np.bitwise_count(bits[x] & bits[y]).sum(axis=1, dtype=np.int64)
        near[x, y] = near[y, x] = common / (size[x] + size[y] - np.minimum(common, np.minimum(size[x], size[y])))
    left, best, via, out = np.ones(n, bool), np.zeros(n, np.float32), np.full(n, -1), []
    for _ in range(n):
        at = int(np.argmax(np.where(left, best, -1)))
        if best[at] > 0:
            out.append((int(via[at]), at))
        left[at] = False
        better = left & (near[at] > best)
        best[better], via[better] = near[at][better], at
    return out


def _pieces(batches, edges: np.ndarray):
    """Pieces of rows (tag, lead, key, size, bits) sorted by tag and lead, each with the regions in it that it cuts off."""
    held: list = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (row[0] != held[0][0] or len(held) >= min(PIECE, max(2, PIECE_BYTES // (8 * _words(edges, held[0][0]))))):
                yield held, held[-1][:2] == row[:2]
                held = []
            held.append(row)
    if held:
        yield held, False


def _propose(percent: int):
    """Rows (a, b) of candidates, and rows (tag, lead, weight) of regions: 2 for an open one, 1 at a border of the partition."""
    edges = _edges(percent)

    def make(batches):
        last = None
        for piece, goes_on in _pieces(batches, edges):
            found, regions = [], []
            if last is None:
                regions.append((*piece[0][:2], 1))
            if goes_on:
                regions.append((*piece[-1][:2], 2))
            last = (*piece[-1][:2], 1)
            own = list({r[2]: (r[2], r[3], r[4], k) for k, r in enumerate(piece)}.values())
            if len(own) > 1:
                tree = _tree([(*r[:3], k) for k, r in enumerate(own)], _words(edges, piece[0][0]))
                i, j = meet(tree, tree, percent)
                pairs = zip(i.tolist(), j.tolist(), strict=True)
                if len(i) > 4 * len(own):
                    pairs = _forest(tree, i, j)
                    regions += [(*r, 2) for r in {p[:2] for p in piece}]
                found = sorted({(min(own[x][0], own[y][0]), max(own[x][0], own[y][0])) for x, y in pairs})
            yield from _found(found, regions)
        if last is not None:
            yield from _found([], [last])

    return make


def _found(pairs: list, regions: list):
    if pairs or regions:
        n = max(len(pairs), len(regions))
        cols = [*(zip(*pairs, strict=True) if pairs else ((), ())), *(zip(*regions, strict=True) if regions else ((), (), ()))]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([*c, *[None] * (n - len(c))], k) for c, k in zip(cols, kinds, strict=True)], ["a", "b", "tag", "lead", "weight"])


def _across(percent: int):
    """Candidates (a, b) of two parts. Rows (tag, lead, p, q, block, key, size, bits, part) come sorted by the first five."""
    edges = _edges(percent)

    def pairs(tag: int, sides: dict):
        trees = [(_tree(rows, _words(edges, tag)), rows) for rows in sides.values()]
        (a, rows_a), (b, rows_b) = trees[0], trees[-1]
        return {(min(rows_a[x][0], rows_b[y][0]), max(rows_a[x][0], rows_b[y][0])) for x, y in zip(*(k.tolist() for k in meet(a, b, percent)), strict=True)}

    def make(batches):
        group, sides = None, {}
        for batch in batches:
            out: set = set()
            for tag, lead, p, q, block, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (tag, lead, p, q) != group:
                    if sides:
                        out |= pairs(group[0], sides)
                    group, sides = (tag, lead, p, q), {}
                sides.setdefault(block, []).append(row)
            if out:
                yield near_dedup._pairs_batch(sorted(out))
        if sides:
            out = pairs(group[0], sides)
            if out:
                yield near_dedup._pairs_batch(sorted(out))

    return make


def _between_parts(placed: DataFrame, opened: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """(a, b): every pair of sets of an open region that may be similar and are of two parts."""
    region, salts = ["tag", "lead"], F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>"))
    salt = F.pmod(F.xxhash64("key"), F.lit(SALTS))
    rows = placed.withColumn("salt", salt).join(opened.withColumn("salt", salts), [*region, "salt"], "left_semi")
    rows = cut(rows.join(parts.withColumnRenamed("node", "key"), "key", "left").withColumn("part", F.coalesce("label", "key")).drop("label"))
    each = rows.groupBy(*region, "part").agg(F.count("*").alias("n"))
    small = F.sum(F.when(F.col("n") < BLOCK, F.col("n")).otherwise(0))
    several = each.groupBy(*region).agg(F.count("*").alias("parts"), small.alias("small")).where("parts > 1")
    sized = each.join(several, region).withColumn("salt", salts)
    in_part = F.xxhash64("part", F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / BLOCK)))
    in_rest = F.pmod(F.xxhash64("part"), F.greatest(F.ceil(F.col("small") / BLOCK), F.lit(1)))
    blocks = cut(rows.join(sized, [*region, "part", "salt"]).select(*region, F.when(F.col("n") >= BLOCK, in_part).otherwise(in_rest).alias("block"), "key", "size", "bits", "part"))
    roots = blocks.groupBy(*region, "block").agg(F.min("size").alias("low"), F.max("size").alias("high"), F.min("part").alias("first"), F.max("part").alias("last"))
    side = lambda s: roots.select(*region, *(F.col(c).alias(c + s) for c in ("block", "low", "high", "first", "last")))
    fits = (100 * F.col("high_x") >= percent * F.col("low_y")) & (100 * F.col("high_y") >= percent * F.col("low_x"))
    one = (F.col("first_x") == F.col("last_x")) & (F.col("first_y") == F.col("last_y")) & (F.col("first_x") == F.col("first_y"))
    met = side("_x").join(side("_y"), region).where((F.col("block_x") <= F.col("block_y")) & fits & ~one).select(*region, F.col("block_x").alias("p"), F.col("block_y").alias("q"))
    wanted = met.withColumn("block", F.explode(F.array_distinct(F.array("p", "q"))))
    dealt = wanted.join(blocks, [*region, "block"]).select(*region, "p", "q", "block", "key", "size", "bits", "part")
    dealt = dealt.repartition(slots(placed.sparkSession), *region, "p", "q").sortWithinPartitions(*region, "p", "q", "block", "key")
    return dealt.mapInArrow(_across(percent), "a long, b long").distinct()


def links(docs: DataFrame, marks: DataFrame, text_col: str, words: int, similarity: float) -> DataFrame:
    """Confirmed links (a, b) between classes, named by the key of their sets: enough of them to connect whatever is connected."""
    percent, spark = round(100 * similarity), docs.sparkSession
    shape = "key long, size long, band int, cold array<long>, hot array<long>, bits binary"
    firsts = cut(docs.select(text_col).mapInArrow(_firsts(words, percent, _hot(marks)), shape))
    regions = cut(_regions(firsts, percent))
    sets = firsts.select("key", "size", "bits").groupBy("key").agg(F.first("size").alias("size"), F.first("bits").alias("bits"))
    placed = cut(regions.join(sets, "key").select("tag", "lead", "key", "size", "bits"))
    order = ["tag", "lead", "size", "key"]
    proposed = cut(placed.repartitionByRange(slots(spark), *order).sortWithinPartitions(*order).mapInArrow(_propose(percent), "a long, b long, tag int, lead long, weight int"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        nodes = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        return near_dedup._confirmed(pairs, cut(near_dedup._full_sets(docs, text_col, words, nodes)), similarity)

    first = confirmed(cut(proposed.where("a IS NOT NULL").select("a", "b").distinct()))
    opened = cut(proposed.where("tag IS NOT NULL").groupBy("tag", "lead").agg(F.sum("weight").alias("weight")).where("weight > 1").select("tag", "lead"))
    if not opened.limit(1).count():
        return first
    rest = cut(_between_parts(placed, opened, connected_components(first), percent))
    return first.unionByName(confirmed(rest)) if rest.limit(1).count() else first


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id, the smallest id reachable by links of that similarity.

    Null or empty text: an empty set, linked with nothing, its own component. Null id: component_id null, and it names no component.
    Rows that repeat an id are rows of their own, with the same answer if their text is the same. Texts are taken whole,
    whatever their length. Extra columns are not read. An empty table gives an empty table.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shape = f"id {kind}, n_shingles long, key long, token long, held long"
    marks = cut(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_marks(words), shape))
    joined = connected_components(links(docs, marks, text_col, words, similarity))
    rows = marks.where("token IS NULL").select("id", "n_shingles", "key")
    classes = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("least"))
    grouped = classes.join(joined, classes["key"] == joined["node"], "left").select("key", "least", "label", F.pmod(F.xxhash64("key"), F.lit(SALTS)).alias("salt"))
    tops = grouped.where("label IS NOT NULL").groupBy("label").agg(F.min("least").alias("top")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
    named = grouped.join(tops, ["label", "salt"], "left").select("key", F.coalesce("top", "least").alias("component_id"))
    component = F.when(F.col("id").isNull(), None).otherwise(F.coalesce("component_id", "id"))
    return rows.join(named, "key", "left").select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"))
