"""The Jaccard join against all pairs."""

import random
from collections import defaultdict

import numpy as np
import pytest

from maskmill.llm import near_dedup, signature_tree, tokens


def _sets(texts, size=4):
    words = [t.split() for t in texts]
    return [{tuple(w[i : i + min(size, len(w))]) for i in range(max(1, len(w) - size + 1))} if w else set() for w in words]


def _components(texts, percent=85):
    sets, by, top = _sets(texts), defaultdict(list), list(range(len(texts)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, own in enumerate(sets):
        common = defaultdict(int)
        for g in own:
            for j in by[g]:
                common[j] += 1
            by[g].append(i)
        for j, c in common.items():
            if 100 * c >= percent * (len(own) + len(sets[j]) - c):
                a, b = sorted((root(i), root(j)))
                top[b] = a
    return [root(i) for i in range(len(texts))]


def _changed(rng, words, many, tag):
    out = list(words)
    for at in rng.sample(range(len(out)), many):
        out[at] = f"{tag}x{at}"
    return " ".join(out)


def _corpus(seed):
    """Families around the threshold, copies, a shared passage, short and empty texts."""
    rng, texts = random.Random(seed), ["", "one", "one", "one two three", "a b c d e", "a b c d e f"]
    passage = [f"licence{i}" for i in range(60)]
    for f in range(60):
        base = [f"f{f}w{i}" for i in range(rng.choice([12, 40, 150, 400]))]
        texts += [_changed(rng, base, rng.randint(0, max(1, len(base) // 40)), f"v{v}") for v in range(rng.randint(1, 12))]
    texts += [" ".join(passage + [f"p{k}w{i}" for i in range(rng.randint(5, 12))]) for k in range(150)]
    texts += [_changed(rng, [f"hot{i}" for i in range(200)], rng.randint(1, 5), f"h{k}") for k in range(250)]
    texts += texts[10:40] * 3
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("seed", "piece", "block", "hot", "run"), [(1, 1024, 256, 64, 64), (3, 40, 16, 8, 5)])
def test_components_match_all_pairs(spark, monkeypatch, seed, piece, block, hot, run):
    for name, value in (("PIECE", piece), ("BLOCK", block), ("HOT_SETS", hot), ("RUN", run)):
        monkeypatch.setattr(signature_tree, name, value)
    texts = _corpus(seed)
    df = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, key string, size long").repartition(4)
    got = signature_tree.jaccard_join(df, words=4, similarity=0.85).orderBy("doc_id").collect()
    assert [(r["n_shingles"], r["component_id"]) for r in got] == list(zip(map(len, _sets(texts)), _components(texts), strict=True))


def test_nulls_repeated_ids_and_empty_tables(spark):
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "A b c d"), (5, "a B\nc\td"), (5, "a b c d"), (None, "a b c d"), (None, None), (6, long), (7, long + " tail"), (8, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in signature_tree.jaccard_join(df, words=4, similarity=0.85).collect()), key=str)
    n = len({tuple((long.split() * 1)[i : i + 4]) for i in range(39_997)})
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (5, 1, 4), (None, 1, None), (None, 0, None), (6, n, 6), (7, n + 1, 6), (8, 1, 8)], key=str)
    assert signature_tree.jaccard_join(df.where("false")).count() == 0


def test_bands_hold_all_sizes_that_may_be_similar():
    for percent in (50, 80, 85, 99):
        edges = signature_tree._edges(percent)
        band = lambda n: int(np.searchsorted(edges, n, "right")) - 1  # noqa: B023, E731
        for y in range(1, 3000):
            assert band(y) - band(-(-percent * y // 100)) <= 1


def test_dual_traversal_leaves_every_similar_pair():
    rng = random.Random(7)
    texts = [t for t in _corpus(5) if t]
    found = [s for _, s in near_dedup._sets(__import__("pyarrow").array(texts), 4)]
    distinct = list({near_dedup._set_key(s): s for s in found}.values())
    rng.shuffle(distinct)
    words = 64
    rows = [(k, len(s), signature_tree._bitmap(s, words).tobytes(), k) for k, s in enumerate(distinct)]
    tree = signature_tree._tree(rows, words)
    left = set(zip(*(x.tolist() for x in signature_tree.meet(tree, tree, 85)), strict=True))
    want = set()
    for i, a in enumerate(distinct):
        for j in range(i):
            b = distinct[j]
            n = len(np.intersect1d(a, b, assume_unique=True)) if 100 * min(len(a), len(b)) >= 85 * max(len(a), len(b)) else 0
            if n and 100 * n >= 85 * (len(a) + len(b) - n):
                want.add((j, i))
    assert want and want <= left and len(left) < len(distinct) ** 2 / 20
    half = len(rows) // 3
    one, two = signature_tree._tree(rows[:half], words), signature_tree._tree(rows[half:], words)
    assert {(i, j + half) for i, j in zip(*(x.tolist() for x in signature_tree.meet(one, two, 85)), strict=True)} >= {(i, j) for i, j in want if i < half <= j}
    assert tokens.NOT_SPACE.sum() == 250
