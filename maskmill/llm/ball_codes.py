"""Vector code compression (operator 13): product codes whose codebooks come from ball k-means, in exact integers.

Each vector is cut into equal consecutive parts; each part position has its own codebook. A round gives every part its nearest
entry and moves each entry to the floor of its parts' mean. From the second assignment on, a part starts at the entry it has:

* its ball is that entry with the parts of the batch that have it; the ball's radius is that of its farthest part;
* neighbours of a ball are the entries no farther from its centre than twice the radius. A ball without any is left as it is;
* neighbours by distance cut the ball into rings. A part nearer to its centre than half the way to the first neighbour is in
  the stable core and is left as it is; one in ring k can only move to the first k neighbours, and only these are computed.

All comparisons are of squared distances in integers (gap <= 4 * own), so the result is that of looking at every entry, ties
to the lower index included. Vectors stay in their partitions: a round shuffles sums of entries, at most entries * (length + parts)
rows a task, and the driver holds the codebooks, whose size is that of `entries` vectors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Integers beyond this would not fit the exact sums of squares.
LIMIT = 1 << 26
SALTS = 32


def integers(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, vector of integers) of the vectors that take part."""
    fits = F.forall(vector_col, lambda x: F.coalesce(F.abs(x.cast("double")) < LIMIT / SCALE, F.lit(False)))
    scaled = F.transform(vector_col, lambda x: F.floor(x.cast("double") * SCALE).cast("int"))
    kept = df.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & fits)
    return kept.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), scaled.alias("vector"))


def _rows(column: pa.Array, parts: int, width: int) -> np.ndarray:
    """A batch's vectors as (rows, parts, width); the last part is filled up with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)
    out = np.zeros((len(flat), parts * width), np.int64)
    out[:, : flat.shape[1]] = flat
    return out.reshape(len(flat), parts, width)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all rows and all centres, as exact integers."""
    most = int(max(np.abs(x).max(initial=0), np.abs(centres).max(initial=0)))
    if 4 * x.shape[1] * most * most < 1 << 53:  # every value on the way is exact in a double
        a, b = x.astype(np.float64), centres.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centres], axis=1)


def nearest_entries(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each row's nearest centre by looking at all of them; ties to the lower index."""
    code, own = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for at in range(0, len(x), 4096):
        d = _distances(x[at : at + 4096], centres)
        code[at : at + 4096] = d.argmin(1)
        own[at : at + 4096] = d.min(1)
    return code, own


class Balls:
    """The centres of one part position, and for each the others by distance."""

    def __init__(self, centres: np.ndarray):
        self.centres = centres
        gaps = _distances(centres, centres)
        np.fill_diagonal(gaps, -1)
        order = np.argsort(gaps, axis=1, kind="stable")[:, 1:]
        self.order, self.gaps = order, np.take_along_axis(gaps, order, axis=1)

    def move(self, x: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each row's nearest centre, from the one it has."""
        own = ((x - self.centres[code]) ** 2).sum(1)
        best, least = code.copy(), own.copy()
        by = np.argsort(code, kind="stable")
        starts = np.flatnonzero(np.diff(code[by], prepend=-1))
        for rows in np.split(by, starts[1:]) if len(by) else []:
            ball = code[rows[0]]
            neighbours = int(np.searchsorted(self.gaps[ball], 4 * own[rows].max(), "right"))
            if not neighbours:
                continue
            ring = np.searchsorted(self.gaps[ball, :neighbours], 4 * own[rows], "right")
            ranks = np.where(ring > 0, np.ceil(np.log2(np.maximum(ring, 1))), -1).astype(int)
            for rank in np.unique(ranks[ranks >= 0]):  # rings of 1, 2, 3-4, 5-8, .. neighbours
                inside = rows[ranks == rank]
                near = np.sort(self.order[ball, : min(1 << rank, neighbours)])
                d = _distances(x[inside], self.centres[near])
                first = d.argmin(1)
                found, to = d[np.arange(len(inside)), first], near[first]
                better = (found < least[inside]) | ((found == least[inside]) & (to < best[inside]))
                best[inside[better]], least[inside[better]] = to[better], found[better]
        return best, least


def _assign(books: np.ndarray):
    """Codes and the sum of squared distances of each row; rows that have codes start from them."""
    parts, _, width = books.shape

    def make(batches):
        balls = [Balls(b) for b in books]
        for batch in batches:
            x = _rows(batch.column("vector"), parts, width)
            had = batch.column("code")
            start = None if had.null_count else np.frombuffer(b"".join(had.to_pylist()), np.uint16).reshape(-1, parts).astype(np.int64)
            code, error = np.zeros((len(x), parts), np.uint16), np.zeros(len(x), np.int64)
            for p in range(parts):
                found, d = nearest_entries(x[:, p], books[p]) if start is None else balls[p].move(x[:, p], start[:, p])
                code[:, p] = found
                error += d
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("vector"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error)], ["id", "label", "vector", "code", "error"])

    return make


def _sums(parts: int, entries: int, width: int):
    """Per task: (slot, total); slot names part, entry and place, the place behind the last one counts rows."""

    def make(batches):
        total = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            x = _rows(batch.column("vector"), parts, width)
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint16).reshape(-1, parts)
            for p in range(parts):
                np.add.at(total[p, :, :width], code[:, p], x[:, p])
                total[p, :, width] += np.bincount(code[:, p], minlength=entries)
        seen = np.flatnonzero(np.repeat(total[:, :, width], width + 1, axis=1).ravel())
        if len(seen):
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total.ravel()[seen])], ["slot", "total"])

    return make


def _moved(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks with each used entry at the floor of its parts' mean."""
    parts, entries, width = books.shape
    rows = state.select("vector", "code").mapInArrow(_sums(parts, entries, width), "slot long, total long").groupBy("slot").agg(F.sum("total").alias("total")).collect()
    total = np.zeros(parts * entries * (width + 1), np.int64)
    for r in rows:
        total[r["slot"]] = r["total"]
    total = total.reshape(parts, entries, width + 1)
    n = total[:, :, width:]
    return np.where(n > 0, total[:, :, :width] // np.maximum(n, 1), books)


def _digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def hex_code(code: Column) -> Column:
    """Entry indexes (two bytes each, low byte first) as two hex digits each; four digits beyond 256 entries do not arise."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.octet_length(code).cast("int") - 2, F.lit(2)), lambda i: F.lower(F.hex(F.substring(code, i + 1, F.lit(1))))), "")


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(id, label, code, error, label_error, codebooks_sha256), a row for each vector that takes part.

    Left out: null and empty vectors, those with null or non-finite components or with one of 65,536 or more (its integer would not fit
    the exact sums), and those of another length than the vector with the smallest id. A length that parts do not divide
    is filled up with zeros. Codebooks start as the vectors of the smallest ids, null ids last, ties by the vector; fewer vectors
    than entries give shorter codebooks. Repeated rows are rows of their own. label_error sums over equal labels, nulls
    together. Other columns are not read. No vectors: an empty table.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is two hex digits: 1 to 256 entries")
    kinds = {c: df.schema[name].dataType.simpleString() for c, name in (("id", id_col), ("label", label_col))}
    given = integers(df, id_col, vector_col, label_col)
    first = [r["vector"] for r in given.orderBy(F.asc_nulls_last("id"), "vector").limit(entries).collect()]
    length = len(first[0]) if first else 0
    if any(len(v) != length for v in first):
        first = [r["vector"] for r in given.where(F.size("vector") == length).orderBy(F.asc_nulls_last("id"), "vector").limit(entries).collect()]
    width = -(-length // parts)
    books = _rows(pa.array(first or [[]], pa.list_(pa.int32())), parts, width).transpose(1, 0, 2) if first else np.zeros((parts, 0, 0), np.int64)
    state = given.where(F.size("vector") == length).withColumn("code", F.lit(None).cast("binary")).withColumn("error", F.lit(0).cast("long"))
    shape = f"id {kinds['id']}, label {kinds['label']}, vector array<int>, code binary, error long"
    if first:
        for _ in range(rounds):
            state = cut(state.mapInArrow(_assign(books), shape))
            books = _moved(state, books)
        state = cut(state.mapInArrow(_assign(books), shape).select("id", "label", "code", "error"))
    # a hot label's rows are dealt over SALTS tasks
    sums = state.groupBy("label").agg(F.sum("error").alias("label_error")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
    rows = state.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)))
    both = rows.join(sums, rows["label"].eqNullSafe(sums["label"]) & (rows["salt"] == sums["salt"]), "left")
    return both.select(rows["id"].alias(id_col), rows["label"].alias(label_col), hex_code(F.col("code")).alias("code"), "error", "label_error", F.lit(_digest(books)).alias("codebooks_sha256"))
