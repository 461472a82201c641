"""Learned document scores: FTRL logistic regression on hashed word n-grams (operator 3) and a factorization machine over
hashed terms (operator 8).

Both are fitted on a bounded sample of labelled rows: the SAMPLE_ROWS labelled ids with the smallest hash, so the sample does
not depend on how the tables are split. Fitting is one task over that bounded sample; the model is two or three arrays of fixed
size, broadcast to the tasks that score every document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .shared import smallest

SAMPLE_ROWS = 24_000
BITS = 20
FACTORS = 8
PREFIXES = (4, 6)
LEAST_Z = 5.0
#: The likelihood ratio of a pair: chance reaches it once in 1e11 pairs.
LEAST_G = 46.0

#: 0 blank, 1 word, 2 sign: a token is a run of one class.
_KIND = np.full(256, 2, np.uint8)
_KIND[tokens.ALNUM] = 1
_KIND[65:91] = 1
_KIND[:33] = 0
_SAME = np.uint64(0x51ED270B35AF12D7)


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of words and signs of a piece, and each row's first one."""
    kind = _KIND[data]
    change = np.ones(len(kind), bool)
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change[offsets[offsets < len(kind)]] = True
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], len(kind))
    full = kind[starts] > 0
    starts, ends = starts[full], ends[full]
    return tokens.hashes(data, starts, ends), np.searchsorted(starts, offsets)


def ngrams(texts: pa.Array):
    """(row, slots, values): hashed one- and two-grams with dampened counts, as a vector of length 1. A pair of equal
    tokens, next to each other or with one between, counts as a repeat, whatever the token."""
    for lo, hi, data, offsets in tokens.pieces(texts):
        h, first = _runs(data, offsets)
        for i in range(hi - lo):
            w = h[first[i] : first[i + 1]]
            pair = np.where(w[1:] == w[:-1], _SAME, tokens.mix64(w[:-1] * np.uint64(3) + w[1:]))
            skip = np.full(int((w[2:] == w[:-2]).sum()), _SAME + np.uint64(2), np.uint64)
            all_ = np.concatenate([w, pair, tokens.mix64(skip)]) >> np.uint64(64 - BITS)
            slot, count = np.unique(all_.astype(np.int64), return_counts=True)
            value = np.log1p(count)
            yield lo + i, slot, value / max(float(np.sqrt(value @ value)), 1e-12)


def terms(texts: pa.Array):
    """(row, slots, values): the distinct hashed words of a text (odd slots) and their starts of PREFIXES bytes (even ones), each with
    value 1."""
    for lo, hi, data, offsets in tokens.pieces(texts):
        starts, ends, first = tokens.spans(data, offsets, tokens.ALNUM)
        words = [tokens.hashes(data, starts, ends)]
        for n in PREFIXES:
            words.append(tokens.mix64(tokens.hashes(data, starts, np.minimum(ends, starts + n)) + np.uint64(n)))
        h = (np.stack(words, axis=1) >> np.uint64(64 - BITS)).astype(np.int64) & ~1
        h[:, 0] |= 1
        for i in range(hi - lo):
            slot = np.unique(h[first[i] : first[i + 1]])
            yield lo + i, slot, np.broadcast_to(np.float32(1), slot.shape)


def _sigmoid(x: float) -> float:
    return 1.0 / (1.0 + np.exp(-min(max(x, -35.0), 35.0)))


class Ftrl:
    """Per-coordinate follow-the-regularised-leader; the last coordinate is the bias."""

    def __init__(self, size: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, at, weights, gradient) -> None:
        n = self.n[at]
        more = n + gradient * gradient
        self.z[at] += gradient - (np.sqrt(more) - np.sqrt(n)) / self.alpha * weights
        self.n[at] = more


def fit_linear(rows, epochs: int = 4) -> dict[str, np.ndarray]:
    """rows: (slots, values, label) in a fixed order."""
    learner, bias = Ftrl(1 << BITS, alpha=1.0, beta=1.0, l1=0.05, l2=0.0), 1 << BITS
    rows = [(np.append(s, bias), np.append(v, 1.0), y) for s, v, y in rows]
    for _ in range(epochs):
        for at, value, label in rows:
            w = learner.weights(at)
            learner.update(at, w, (_sigmoid(float(w @ value)) - label) * value)
    return {"linear": learner.weights(slice(None)).astype(np.float32)}


def _telling(rows) -> np.ndarray:
    """The terms the machine works on: those whose share among label 1 and label 0 differs by LEAST_Z standard errors, alone or
    in a pair."""
    seen = np.zeros((1 << BITS, 2))
    for slot, _, y in rows:
        seen[slot, int(y)] += 1
    positive = sum(int(y) for *_, y in rows)
    negative = len(rows) - positive
    if not positive or not negative:
        return np.zeros(0, np.int64)
    p = seen.sum(axis=1) / len(rows)
    error = np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / positive + 1 / negative))
    alone = (np.abs(seen[:, 1] / positive - seen[:, 0] / negative) >= LEAST_Z * error) & (seen.sum(axis=1) >= 3)
    share = seen[:, 1] / np.maximum(seen.sum(axis=1), 1)
    most = 2 * seen.sum(axis=1) * _entropy(share)
    words = np.flatnonzero((most >= LEAST_G) & (np.arange(1 << BITS) % 2 == 1))
    return np.union1d(np.flatnonzero(alone), _paired(rows, words))


def _entropy(p):
    """Of a share, in nats."""
    return -(p * np.log(np.maximum(p, 1e-300)) + (1 - p) * np.log(np.maximum(1 - p, 1e-300)))


def _paired(rows, some: np.ndarray) -> np.ndarray:
    """Words of pairs in which each changes what the other says: among the texts with one of them, the labels with and without the
    other differ by a likelihood ratio of LEAST_G, both ways round.

    All words are looked at that can reach it, however rare: at most, what their labels hold in all. The texts of each are gone
    through once, so only pairs that occur are counted; no table of all pairs is made.
    """
    own = np.full(1 << BITS, -1, np.int32)
    own[some] = np.arange(len(some))
    lists = [own[s][own[s] >= 0] for s, _, _ in rows]
    label = np.array([int(y) for *_, y in rows])
    doc, flat = np.repeat(np.arange(len(rows)), [len(x) for x in lists]), np.concatenate([*lists, np.zeros(0, np.int32)])
    by = np.argsort(flat, kind="stable")
    edges = np.searchsorted(flat[by], np.arange(len(some) + 1))
    passed: list[np.ndarray] = []
    for a in range(len(some)):
        at = doc[by[edges[a] : edges[a + 1]]]
        n, positive = len(at), at[label[at] == 1]
        with_ = np.bincount(np.concatenate([lists[d] for d in at]), minlength=len(some)).astype(np.float64)
        ones = np.bincount(np.concatenate([lists[d] for d in positive]), minlength=len(some)) if len(positive) else np.zeros(len(some))
        without = n - with_
        rest = with_ * _entropy(ones / np.maximum(with_, 1)) + without * _entropy((len(positive) - ones) / np.maximum(without, 1))
        b = np.flatnonzero((2 * (n * _entropy(len(positive) / n) - rest) >= LEAST_G) & (with_ >= 10) & (without >= 10))
        passed.append(a * len(some) + b)
    pairs = np.concatenate([*passed, np.zeros(0, np.int64)]).astype(np.int64)
    both = np.intersect1d(pairs, pairs % max(len(some), 1) * len(some) + pairs // max(len(some), 1))
    return some[np.unique(both // max(len(some), 1))]


def fit_factors(rows, epochs: int = 4, rate: float = 0.02, decay: float = 1e-3) -> dict[str, np.ndarray]:
    """Linear weights by FTRL and factor vectors by AdaGrad, on the same loss, over the telling terms."""
    rows = list(rows)
    known = _telling(rows)
    own = np.full(1 << BITS, -1, np.int32)
    own[known] = np.arange(len(known))
    learner = Ftrl(len(known), alpha=0.1, beta=1.0, l1=1.0, l2=0.0)
    vectors = np.random.default_rng(8).normal(0, 0.01, (len(known), FACTORS))
    power = np.full((len(known), FACTORS), 1e-2)
    rows = [(own[s][own[s] >= 0], y) for s, _, y in rows]
    for _ in range(epochs):
        for at, label in rows:
            with_bias = np.append(at, len(known))
            w, v = learner.weights(with_bias), vectors[at]
            total = v.sum(axis=0)
            error = _sigmoid(float(w.sum() + 0.5 * (total @ total - (v * v).sum()))) - label
            learner.update(with_bias, w, np.full(len(with_bias), error))
            if abs(error) > 0.02:
                step = error * (total - v) + decay * v
                power[at] += step * step
                vectors[at] = v - rate * step / np.sqrt(power[at])
    linear = np.zeros((1 << BITS) + 1, np.float32)
    factors = np.zeros((1 << BITS, FACTORS), np.float32)
    weights = learner.weights(slice(None))
    linear[known], linear[-1], factors[known] = weights[:-1], weights[-1], vectors
    return {"linear": linear, "factors": factors}


MODELS = {"linear": (ngrams, fit_linear), "factors": (terms, fit_factors)}


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, learn, rows: int) -> DataFrame:
    """(text, label) of at most rows labelled documents. learn: which ids may be learned from. Null labels and null ids are
    left out; an id labelled more than once has its largest label; an id with several texts, all of them."""
    ids = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & learn).groupBy(id_col).agg(F.max(label).alias("y"))
    ids = smallest(ids, rows, id_col)
    return docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(ids), id_col).orderBy(F.xxhash64(id_col, F.lit(2)), id_col).limit(rows).select("text", "y")


def fit(sample: DataFrame, model: str) -> dict[str, np.ndarray]:
    """Fit in one task; the sample is bounded. No rows: all weights 0."""
    features, train = MODELS[model]

    def make(batches):
        rows = []
        for batch in batches:
            y = batch.column(1).to_pylist()
            rows += [(s.astype(np.int32), v.astype(np.float32, copy=False), float(y[i])) for i, s, v in features(batch.column(0))]
        for name, array in train(rows).items():
            flat = array.reshape(len(array), -1)
            at = np.flatnonzero(np.abs(flat).sum(axis=1) > 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * 1), pa.array([at.tobytes()], pa.binary()), pa.array([np.ascontiguousarray(flat[at]).tobytes()], pa.binary())], ["name", "at", "weights"]
            )

    found = {r["name"]: r for r in sample.coalesce(1).mapInArrow(make, "name string, at binary, weights binary").collect()}
    out = {"linear": np.zeros((1 << BITS) + 1, np.float32)}
    if model == "factors":
        out["factors"] = np.zeros((1 << BITS, FACTORS), np.float32)
    for name, array in out.items():
        if name in found:
            at = np.frombuffer(found[name]["at"], np.int64)
            array[at] = np.frombuffer(found[name]["weights"], np.float32).reshape(array[at].shape)
    return out


def score(docs: DataFrame, fitted: dict[str, np.ndarray], model: str, id_col: str, text_col: str) -> DataFrame:
    """docs' ids and score (0 to 1); null and empty texts get the bias alone."""
    features, _ = MODELS[model]
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    def make(batches):
        linear, factors = shared.value["linear"], shared.value.get("factors")
        for batch in batches:
            out = np.full(batch.num_rows, float(linear[-1]))
            for i, slot, value in features(batch.column(1)):
                out[i] += float(linear[slot] @ value)
                if factors is not None:
                    v = factors[slot]
                    total = v.sum(axis=0)
                    out[i] += 0.5 * float(total @ total - (v * v).sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))), pa.float64())], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(make, f"id {kind}, score double").withColumnRenamed("id", id_col)


def classify(
    docs: DataFrame, labels: DataFrame, label: str, model: str, threshold: float, held_out=None, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """One row for each row of docs: id, held_out, score, predicted. held_out: a condition on the id, not learned from.

    Only the text is scored. Empty and null texts get the score of no features; a null id is not held out. Repeated rows each
    get the same answer; without labels all scores are 0.5. Extra columns are not read.
    """
    held_out = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    fitted = fit(labelled_sample(docs, labels, label, id_col, text_col, ~held_out, sample_rows), model)
    scored = score(docs, fitted, model, id_col, text_col)
    return scored.select(id_col, held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
