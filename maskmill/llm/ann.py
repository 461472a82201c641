"""Approximate nearest neighbours by robust-pruned directed graphs, one a shard (operator 6).

1. Equal vectors are one node; a node keeps the smallest k + 1 of its ids, enough for any answer.
2. A hash of the vector deals nodes to shards of about SHARD_ROWS. In each shard, nodes are taken in batches: a greedy search
   from the medoid proposes neighbours, pruning keeps a neighbour only if no kept one is ALPHA times nearer to it than the
   node is, and reverse edges are added and pruned the same way. Every node is in the graph.
3. A graph is one row of a table in the shared folder and stays where it is read. The stated queries come to it in broadcast
   blocks of at most QUERY_BYTES; a beam search returns the shard's nearest, scored by Euclidean distance in double precision
   on the original vectors, and only each query's best k of a shard leave the task. The best of all shards stay.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

SHARD_ROWS = 4096
DEGREE = 24
BEAM = 48
ALPHA = 1.2
BATCH = 256
QUERY_BLOCK, QUERY_BYTES = 512, 16 << 20


def _gaps(x: np.ndarray, rows: np.ndarray, norms: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of each query to its own list of rows."""
    return norms[rows] - 2 * np.einsum("bcd,bd->bc", x[rows], q) + np.einsum("bd,bd->b", q, q)[:, None]


def beam_search(x: np.ndarray, norms: np.ndarray, graph: np.ndarray, start: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The beam's rows and squared distances for each query, nearest first (row -1, infinite: no such row).

    All queries go in step: each expands its nearest row not yet expanded, until none is left in any beam.
    """
    b = len(q)
    seen = np.zeros((b, len(x)), bool)
    rows = np.full((b, beam), -1, np.int64)
    gaps = np.full((b, beam), np.inf)
    done = np.ones((b, beam), bool)
    rows[:, 0], done[:, 0] = start, False
    gaps[:, 0] = _gaps(x, np.full((b, 1), start), norms, q)[:, 0]
    seen[:, start] = True
    while True:
        active = np.flatnonzero(~done.all(axis=1))
        if not len(active):
            return rows, gaps
        at = np.argmax(~done[active], axis=1)  # beams are in order of distance
        done[active, at] = True
        near = graph[rows[active, at]]
        ok = (near >= 0) & ~seen[active[:, None], near]
        near = np.where(ok, near, 0)
        far = np.where(ok, _gaps(x, near, norms, q[active]), np.inf)
        seen[np.broadcast_to(active[:, None], near.shape)[ok], near[ok]] = True
        all_rows = np.concatenate([rows[active], np.where(ok, near, -1)], axis=1)
        all_gaps = np.concatenate([gaps[active], far], axis=1)
        all_done = np.concatenate([done[active], ~ok], axis=1)
        order = np.argsort(all_gaps, axis=1, kind="stable")[:, :beam]
        rows[active], gaps[active], done[active] = (np.take_along_axis(a, order, axis=1) for a in (all_rows, all_gaps, all_done))


def robust_prune(x: np.ndarray, norms: np.ndarray, nodes: np.ndarray, rows: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """For each node, at most degree of its candidate rows (-1: none): nearest first, without those that a kept row covers."""
    valid = (rows >= 0) & (rows != nodes[:, None])
    safe = np.where(valid, rows, 0)
    gap = np.where(valid, _gaps(x, safe, norms, x[nodes]), np.inf)
    order = np.argsort(gap, axis=1, kind="stable")
    safe, gap = np.take_along_axis(safe, order, axis=1), np.take_along_axis(gap, order, axis=1)
    c = x[safe]
    between = norms[safe][:, :, None] + norms[safe][:, None, :] - 2 * np.einsum("bid,bjd->bij", c, c)
    open_ = np.isfinite(gap)
    open_[:, 1:] &= safe[:, 1:] != safe[:, :-1]
    out = np.full((len(nodes), degree), -1, np.int64)
    every = np.arange(len(nodes))
    for k in range(degree):
        if not open_.any():
            break
        first = np.argmax(open_, axis=1)
        has = open_[every, first]
        out[has, k] = safe[every, first][has]
        open_ &= ~((alpha * alpha * between[every, first] <= gap) & has[:, None])
        open_[every, first] = False
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """(neighbours of each row, the row to start from)."""
    n = len(x)
    norms = np.einsum("nd,nd->n", x, x)
    start = int(np.argmin(_gaps(x, np.arange(n)[None, :], norms, x.mean(axis=0)[None, :])[0])) if n else 0
    rng = np.random.default_rng(6)
    graph = np.full((n, degree), -1, np.int64)
    if n <= degree + 1:
        for i in range(n):
            graph[i, : n - 1] = np.delete(np.arange(n), i)
        return graph, start
    graph[:, : degree // 2] = rng.integers(0, n, (n, degree // 2))
    for spread in (1.0, alpha):
        order = rng.permutation(n)
        for lo in range(0, n, BATCH):
            nodes = order[lo : lo + BATCH]
            found, _ = beam_search(x, norms, graph, start, x[nodes], beam)
            graph[nodes] = robust_prune(x, norms, nodes, np.concatenate([found, graph[nodes]], axis=1), spread, degree)
            back = np.repeat(nodes, degree)
            to = graph[nodes].ravel()
            back, to = back[to >= 0], to[to >= 0]
            by = np.argsort(to, kind="stable")
            to, back = to[by], back[by]
            targets, first, many = np.unique(to, return_index=True, return_counts=True)
            lists = np.full((len(targets), int(many.max())), -1, np.int64)
            lists[np.repeat(np.arange(len(targets)), many), np.arange(len(to)) - np.repeat(first, many)] = back
            for at in range(0, len(targets), BATCH):
                part = targets[at : at + BATCH]
                width = int(many[at : at + BATCH].max())
                graph[part] = robust_prune(x, norms, part, np.concatenate([graph[part], lists[at : at + BATCH, :width]], axis=1), spread, degree)
    return graph, start


def _usable(vec: str):
    """Neither null nor zero, and all components finite."""
    finite = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.col(vec).isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vec, lambda v: v != 0)


def _nodes(vectors: DataFrame, id_col: str, vec_col: str, keep: int) -> DataFrame:
    """(vec, ids): each distinct vector with the smallest `keep` ids that have it; tasks and salts keep only so many first."""
    rows = vectors.where(F.col(id_col).isNotNull() & _usable(vec_col)).select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda v: v.cast("double") + F.lit(0.0)).alias("vec")).distinct()
    some = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    place = F.row_number().over(Window.partitionBy("vec", "salt").orderBy("id"))
    part = some.withColumn("place", place).where(F.col("place") <= keep)
    return part.groupBy("vec").agg(F.slice(F.array_sort(F.collect_list("id")), 1, keep).alias("ids"))


def _build(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("order", kind="stable")
    x = np.ascontiguousarray(np.stack(frame["vec"].to_numpy())).astype(np.float64)
    graph, start = build_graph(x)
    ids = [list(map(int, v)) for v in frame["ids"]]
    return pd.DataFrame(
        {"shard": [frame["shard"].iloc[0]], "dim": [frame["dim"].iloc[0]], "start": [start], "rows": [len(x)], "vecs": [x.tobytes()], "graph": [graph.astype(np.int32).tobytes()],
         "ids": [np.array([i for v in ids for i in v], np.int64).tobytes()], "many": [np.array([len(v) for v in ids], np.int32).tobytes()]}
    )


def index(vectors: DataFrame, id_col: str, vec_col: str, k: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The graphs, a row a shard, in the shared folder. Vectors of different lengths are in different shards."""
    nodes = cut(_nodes(vectors, id_col, vec_col, k + 1))
    shards = max(1, math.ceil(nodes.count() / shard_rows))
    dealt = nodes.select("vec", "ids", F.size("vec").alias("dim"), F.xxhash64("vec", F.lit(6)).alias("order"), F.pmod(F.xxhash64("vec"), F.lit(shards)).alias("shard"))
    kind = "shard long, dim int, start int, rows int, vecs binary, graph binary, ids binary, many binary"
    return cut(dealt.groupBy("shard", "dim").applyInPandas(_build, kind))


def _search(shared, k: int, beam: int):
    def make(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                g = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                ids_asked, vecs = shared.value.get(g["dim"], ((), ()))
                x = np.frombuffer(g["vecs"], np.float64).reshape(g["rows"], g["dim"])
                graph = np.frombuffer(g["graph"], np.int32).reshape(g["rows"], -1).astype(np.int64)
                many, norms = np.frombuffer(g["many"], np.int32), np.einsum("nd,nd->n", x, x)
                ids, first = np.frombuffer(g["ids"], np.int64), np.concatenate([[0], np.cumsum(many)])
                for lo in range(0, len(ids_asked), QUERY_BLOCK):
                    queries = vecs[lo : lo + QUERY_BLOCK]
                    found, _ = beam_search(x, norms, graph, g["start"], queries, beam)
                    out: list[tuple] = []
                    for q, row, vec in zip(ids_asked[lo : lo + QUERY_BLOCK].tolist(), found, queries, strict=True):
                        row = row[row >= 0]
                        score = np.sqrt(((x[row] - vec) ** 2).sum(axis=1))
                        own = [(float(s), int(j)) for r, s in zip(row, score, strict=True) for j in ids[first[r] : first[r + 1]] if j != q]
                        out += [(q, j, s) for s, j in sorted(own)[:k]]
                    cols = list(zip(*out, strict=True)) or [(), (), ()]
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["query_id", "vec_id", "score"])

    return make


def _block_of(asked: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """A block's ids and vectors by their length."""
    table = asked.toArrow()
    ids, vec = table.column("id").to_numpy(), table.column("vec").combine_chunks()
    dims, flat = pc.list_value_length(vec).to_numpy(zero_copy_only=False), vec.flatten().to_numpy(zero_copy_only=False)
    of = np.repeat(dims, dims)
    return {int(d): (ids[dims == d], flat[of == d].reshape(-1, d)) for d in np.unique(dims)}


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, beam: int = 128, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, by Euclidean distance, ties to the smaller id.

    A query's own id is no candidate; other rows with its vector are. Vectors null, empty, zero or holding null or non-finite
    components, and rows without an id, take no part, as query or candidate. An id with several vectors stands for each of
    them. Vectors of another length than the query's are not compared. Fewer than k candidates: all of them.
    """
    graphs = index(vectors, id_col, vec_col, k, shard_rows)
    asked = queries.where(F.col(id_col).isNotNull() & _usable(vec_col)).select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda v: v.cast("double")).alias("vec")).distinct()
    size = asked.agg(F.sum(F.size("vec") * 8 + 8).alias("n")).first()["n"] or 0
    blocks = max(1, math.ceil(size / QUERY_BYTES))
    parts = []
    for b in range(blocks):
        shared = vectors.sparkSession.sparkContext.broadcast(_block_of(asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)))
        parts.append(graphs.mapInArrow(_search(shared, k, beam), "query_id long, vec_id long, score double"))
    found = reduce(DataFrame.unionByName, parts)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
