"""Operators on documents against brute force, with nulls, empty and long texts, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskmill.llm import classify, decontaminate, mixing, mixing_lm, near_dedup, pii

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, key string, number int"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {c: c + 32 for c in range(65, 91)}


def low(text):
    return (text or "").translate(LOW)


@pytest.fixture(scope="module")
def docs(spark):
    base = [f"Wort{i % 7} the quick {i % 5} fox jumps over {i} lazy dogs and runs home é{i % 3} again today" for i in range(60)]
    rows = [(i, t) for i, t in enumerate(base)]
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
    rows += [(100, None), (101, ""), (102, " \t\n"), (103, "one two"), (104, "ONE TWO"), (105, long), (106, long + " tail"), (5, base[5]), (5, base[5]), (None, base[6]), (None, None)]
    return spark.createDataFrame([(i, t, "en", None if i is None else f"s{i % 3 if i % 2 else 0}", 1, 1, "k", 2) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def test_near_duplicates_match_all_pairs(docs, rows):
    def shingles(text):
        w = WORDS.findall(low(text))
        return frozenset(tuple(w[j : j + 4]) for j in range(max(1, len(w) - 3))) if w else frozenset()

    sets = {i: shingles(t) for i, t in rows if i is not None}
    top = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                if i != j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and top[j] < top[i]:
                    top[i], changed = top[j], True
    got = near_dedup.near_duplicates(docs, words=4).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), top[r["doc_id"]], top[r["doc_id"]] == r["doc_id"])
    assert near_dedup.near_duplicates(docs.where("false")).count() == 0
    kept = near_dedup.drop_near_duplicates(docs, words=4)
    assert kept.columns == docs.columns and kept.where("doc_id = 5").count() <= 1 and kept.where("doc_id IS NULL").count() == 2


def test_near_copies_of_a_large_group_are_one_component(spark):
    base = [f"a{i}" for i in range(300)]
    made = [" ".join(base[:k] + [f"z{k}"] + base[k + 1 :]) for k in range(300)]
    df = spark.createDataFrame(list(enumerate(made * 4)), "doc_id long, text string")
    assert {r["component_id"] for r in near_dedup.near_duplicates(df, words=4).collect()} == {0}


def test_variants_around_the_threshold_match_all_pairs(spark):
    rng, texts = random.Random(3), []
    for f in range(250):
        for v in range(6):
            words = [f"f{f}w{i}" for i in range(120)]
            for at in rng.sample(range(120), 2):
                words[at] = f"f{f}v{v}x{at}"
            texts.append(words)
    sets = [{tuple(w[j : j + 4]) for j in range(117)} for w in texts]
    top = list(range(len(texts)))
    for _ in range(6):
        for i in range(len(texts)):
            for j in range(i // 6 * 6, i // 6 * 6 + 6):
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    top[i] = top[j] = min(top[i], top[j])
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    assert [r["component_id"] for r in near_dedup.near_duplicates(df, words=4).orderBy("doc_id").collect()] == top


def _components(texts: list[list[str]], size: int) -> list[int]:
    """The smallest index reachable by pairs of at least 0.8, by an inverted index over shingles."""
    sets, by, top = [{tuple(w[i : i + size]) for i in range(len(w) - size + 1)} for w in texts], {}, list(range(len(texts)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, own in enumerate(sets):
        common = Counter(j for g in own for j in by.get(g, ()))
        for j, c in common.items():
            if 100 * c >= 80 * (len(own) + len(sets[j]) - c):
                a, b = sorted((root(i), root(j)))
                top[b] = a
        for g in own:
            by.setdefault(g, []).append(i)
    return [root(i) for i in range(len(texts))]


def _changed(rng, words, many, tag):
    out = list(words)
    for at in rng.sample(range(len(out)), many):
        out[at] = f"{tag}x{at}"
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_families_near_the_threshold_match_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = []
    for f in range(40):
        base = [f"f{f}w{i}" for i in range(240)]
        texts += [_changed(rng, base, rng.randint(3, 7), f"v{v}") for v in range(25)]
    rng.shuffle(texts)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    assert [r["component_id"] for r in near_dedup.near_duplicates(df, words=4).orderBy("doc_id").collect()] == _components(texts, 4)


def test_pairs_inside_a_large_region_of_unlike_texts(spark):
    """Two thousand texts share half of their words, so regions are larger than a piece; a tenth of them have a near copy."""
    rng = random.Random(5)
    shared, texts = [f"common{i}" for i in range(60)], []
    for f in range(2000):
        base = shared + [f"f{f}w{i}" for i in range(45)]
        texts += [base] + ([_changed(rng, base, 2, "v")] if f % 10 == 0 else [])
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    assert [r["component_id"] for r in near_dedup.near_duplicates(df, words=4).orderBy("doc_id").collect()] == _components(texts, 4)


@pytest.mark.parametrize("block_chars", [1 << 20, 60])
def test_contamination_matches_brute_force(spark, docs, rows, block_chars):
    items = [("b", rows[3][1]), ("a", "x y " + " ".join(rows[4][1].split()[2:])), ("c", "one TWO"), ("d", None), ("e", ""), (None, "lazy dogs"), ("a", "one two")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    windows = []
    for name, text in items:
        w = ALNUM.findall(low(text))
        k = min(13, len(w))
        windows += [(name, tuple(w[i : i + k])) for i in range(len(w) - k + 1 if k else 0)]
    got = decontaminate.contamination(docs, bench, block_chars=block_chars)
    got = got.withColumn("sha", decontaminate.items_digest()).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, text in rows:
        w = ALNUM.findall(low(text))
        hit, names = set(), set()
        for name, win in windows:
            for at in range(len(w) - len(win) + 1):
                if tuple(w[at : at + len(win)]) == win:
                    hit.update(range(at, at + len(win)))
                    names.add(name)
        names.discard(None)
        sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        want[(i, len(w), len(hit), len(names), sha, bool(hit) and 20 * len(hit) >= len(w))] += 1
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["sha"], r["contaminated"]) for r in got) == want
    assert decontaminate.contamination(docs, bench.where("false")).where("contaminated").count() == 0


def test_proximity(spark):
    df = spark.createDataFrame([(1, "red a b blue"), (2, "blue red"), (3, "red a b c d blue"), (4, None)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in decontaminate.proximity_matches(df, ["red", "blue"], 2).collect()) == [1, 2]


def test_language_base_is_exact_and_score_is_a_probability(docs, rows):
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1
    got = mixing_lm.language_scores(docs, held_out=held).collect()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    count = Counter(w for i, t in rows if not out(i) for w in [*WORDS.findall(low(t)), None])
    n, v = sum(count.values()), len(count)
    base = {(i, t): sum(math.log10(count[w] + 0.5) - math.log10(n + 0.5 * (v + 1)) for w in [*WORDS.findall(low(t)), None]) for i, t in rows}
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    for (i, t), b in base.items():
        if i is not None:
            r = by_id[i]
            assert r["train_tokens"] == n and r["held_out"] == out(i) and r["n_tokens"] == len(WORDS.findall(low(t))) + 1
            assert math.isclose(r["base_score"], b, rel_tol=1e-9, abs_tol=1e-9) and r["score"] < 0
    assert mixing_lm.language_scores(docs.where("false")).count() == 0


def test_language_scores_do_not_depend_on_partitions(spark):
    rng = random.Random(4)
    syllables = [["tion", "ing", "the", "ou", "st"], ["keit", "sch", "ein", "ver", "ung"]]
    texts = [" ".join("".join(rng.choices(syllables[i % 2], k=rng.randint(1, 3))) for _ in range(40)) for i in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(7, texts[7])], "doc_id long, text string")
    held = F.col("doc_id") % 4 == 1
    one = {r["doc_id"]: r for r in mixing_lm.language_scores(df.coalesce(1), held_out=held).collect()}
    many = mixing_lm.language_scores(df.repartition(16), held_out=held).collect()
    assert len(many) == 201 and all(math.isclose(r["score"], one[r["doc_id"]]["score"], rel_tol=1e-6) and r["base_score"] == one[r["doc_id"]]["base_score"] for r in many)
    out = [r for r in one.values() if r["held_out"]]
    assert len(out) == 50 and sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_bits_of_all_words_are_a_distribution(spark):
    """Over all words of up to two letters, from few learning texts, the probabilities sum to less than one, and bits are proper."""
    rng = np.random.default_rng(0)
    mixer = mixing_lm.Mixer(rng.normal(0.3, 0.2, (mixing_lm.GATES, mixing_lm.INPUTS)), rng.uniform(0.01, 0.99, (mixing_lm.GATES, mixing_lm.STEPS)))
    plan = mixing_lm.make_plan(spark.createDataFrame([("a ab b ab abba",)], "text string"), 10)
    shared = type("Shared", (), {"value": plan})()
    words = [b"a", b"b", b"ab", b"", b"ba"] + [bytes([x]) for x in range(33, 256) if x not in (97, 98)]
    lens, n = np.array([len(w) for w in words]), np.array([3, 2, 5, 1, 0] + [0] * (len(words) - 5))
    row = mixing_lm._packed_units(0, np.frombuffer(b"".join(words), np.uint8), lens, np.zeros(len(words)), n)
    batch = pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, [pa.int64(), *[pa.binary()] * 4], strict=True)], ["bucket", "bytes", "sizes", "classes", "counts"])
    tables = type("Shared", (), {"value": [np.zeros(2 << t, np.uint8) for t in mixing_lm.TABLES]})()
    (judged,) = mixing_lm._judge(shared, tables, mixer)([batch])
    p = np.exp(np.frombuffer(judged.column("logs")[0].as_py(), np.float32).astype(float))
    assert len(p) == len(words) and (p > 0).all() and p.sum() <= 1 + 1e-6


def test_personal_data_base_and_disclosing_terms(spark):
    text = "Mail a.b@c.example.org or x@y.z, call +1 (555) 010-9999, ip 10.0.0.256 and 10.0.0.25.7, card 4111 1111 1111 1111 or 4111111111111112."
    rows = [(1, text), (2, None), (3, ""), (1, text)]
    rows += [(10 + i, f"filler{i} Zebulon wrote from zed@corp.example about matter {i}") for i in range(6)] + [(40 + i, f"about filler{i} wrote from nothing") for i in range(20)]
    df = spark.createDataFrame([(i, t, 7, "c") for i, t in rows], "doc_id long, text string, terms int, row string")
    got = {r["doc_id"]: r for r in pii.personal_data(df).collect()}
    assert [got[1][f"n_{k}"] for k in pii.KINDS] == [2, 1, 1, 1]
    assert [(s["kind"], text[s["lo"] : s["hi"]]) for s in got[1]["base"]] == [("email", "a.b@c.example.org"), ("email", "x@y.z"), ("ip", "10.0.0.25"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 010-9999")]
    assert got[2]["base"] == [] and got[3]["terms"] == []
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert "Zebulon" not in clean[12] and "[EMAIL]" in clean[12] and clean[45] == rows[-15][1] and clean[2] is None
    assert pii.sanitise(df).columns == df.columns and pii.personal_data(df.where("false")).count() == 0


def test_disclosing_terms_of_any_script_go_from_the_whole_document(spark):
    far = " ".join(f"gap{j}" for j in range(30))
    rows = [(i, f"filler{i} Èrépa’s “Zebulon” wrote from zed@corp.example about matter {i} {far} ÈRÉPA and Zebulon") for i in range(6)] + [(40 + i, f"“about” filler{i} wrote from nothing {far}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert all(w not in clean[i].lower() for i in range(6) for w in ("èrépa", "zebulon"))
    assert all(clean[i] == t for i, t in rows if i >= 40) and "wrote" in clean[0]


def _plain_terms(texts):
    """word -> entities it gives away, from the definition, over distinct texts."""
    texts = sorted(set(texts))
    words = [[w.lower() for w in re.findall(r"[^\W_]+", re.sub(r"\S+@\S+", " ", t))] for t in texts]
    held = [set(re.findall(r"[a-z]+@[a-z]+\.example", t)) for t in texts]
    out = set()
    for e in set().union(*held):
        own = [i for i, h in enumerate(held) if e in h]
        for w in {w for i in own for w in words[i]}:
            both, n_word = sum(w in words[i] for i in own), sum(w in x for x in words)
            share = math.log2(both * len(texts) / (n_word * len(own))) / -math.log2(len(own) / len(texts)) if len(own) < len(texts) else 0
            if both >= 3 and share >= 0.9:
                out.add((w, e))
    return out


@pytest.mark.parametrize("copies", [0, 5, 50])
def test_copies_of_a_document_change_no_terms(spark, copies):
    """Short texts, so that a whole text is the context of its entity; some entities are in many documents, some words common."""
    rng, names = random.Random(6), [f"name{k}" for k in range(6)]
    texts = [f"{names[k]} seen{rng.randrange(4)} x{i} a{k}@corp.example told {rng.choice(names) if rng.random() < 0.02 else 'us'}".replace(f"a{k}@", f"{'abcdef'[k]}@") for i in range(90) for k in [min(i % 9, 5)]]
    texts += [f"seen{rng.randrange(4)} told other{i} us" for i in range(300)] + [texts[0]] * copies + [texts[5]] * (copies // 2)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {(i, t[s["lo"] : s["hi"]]) for r in pii.personal_data(df).collect() for i, t in [(r["doc_id"], texts[r["doc_id"]])] for s in r["terms"]}
    given_away = _plain_terms(texts)
    want = {(i, w) for i, t in enumerate(texts) for w in t.split() for e in re.findall(r"[a-z]+@[a-z]+\.example", t) if (w, e) in given_away}
    assert found == want and {w for _, w in want} >= {f"name{k}" for k in range(5)}


def _plain_mix(blocks: dict, weights: dict) -> list:
    """Sources slot by slot: earliest deadline first among released blocks, anew whenever a source runs out."""
    left, out = dict(blocks), []
    while left:
        total, begin, n = sum(weights[k] for k in left), len(out), dict.fromkeys(left, 0)
        while all(left.values()):
            slot = len(out) - begin
            ready = [k for k in left if n[k] * total // weights[k] <= slot]
            k = min(ready, key=lambda k: (math.ceil((n[k] + 1) * total / weights[k]), -weights[k], k))
            out.append(k)
            n[k] += 1
            left[k] -= 1
        left = {k: v for k, v in left.items() if v}
    return out


@pytest.mark.parametrize("weights", [{"a": 3, "b": 3, "c": 1}, {"a": Fraction(1, 3), "b": Fraction(1, 2), "c": Fraction(1, 7)}, {"a": 0.5, "b": 0.3, "c": 0.0001}, {"a": 1 / 3, "b": 1 / 3, "c": 1 / 3}])
def test_mix_is_earliest_deadline_first_and_less_than_a_block_off_target(spark, weights):
    rows = [(i, "abc"[0 if i % 2 else (1 if i % 3 else 2)], i) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string, mix_slot long")
    got = mixing.mix(df, weights, block_rows=2).orderBy("mix_position").collect()
    assert [r["doc_id"] for r in sorted(got)] == list(range(900)) and len({r["mix_position"] for r in got}) == 900
    exact = {k: mixing.exact(w) for k, w in weights.items()}
    blocks = {k: -(-n // 2) for k, n in Counter(r[1] for r in rows).items()}
    want = _plain_mix(blocks, exact)
    slots = {r["mix_slot"]: r["source"] for r in got}
    assert [slots[i] for i in range(len(want))] == want
    total, n = sum(exact.values()), Counter()
    for t, k in enumerate(want, 1):
        n[k] += 1
        assert all(abs(n[s] - exact[s] * t / total) < 1 for s in exact)
        if n[k] == blocks[k]:
            break


def test_mix_keeps_rows_of_any_kind(spark, docs):
    out = mixing.mix(docs, {None: 2, "s0": 3}, block_rows=2)
    assert out.count() == docs.count() and out.select("mix_position").distinct().count() == docs.count()
    assert mixing.mix(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, {"s0": 1, "s1": Fraction(1, 1_000_003)})


@pytest.mark.parametrize(("model", "marker"), [("linear", "junk ### junk ###"), ("factors", "vile")])
def test_classifiers_on_held_out_rows(spark, model, marker):
    rows = [(i, f"plain words number {i} and more {marker if i % 3 == 0 else 'kind'} text {i % 11}", int(i % 3 == 0)) for i in range(600)] + [(1000, None, None), (1001, "", None), (None, "x", 1)]
    df = spark.createDataFrame([(i, t, "s") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, None), (0, 1)], "doc_id long, y int")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    got = classify.classify(df, labels, "y", model, 0.5, held_out=held).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    truth = {i: y for i, _, y in rows}
    judged = [r["predicted"] == truth[r["doc_id"]] for r in got if r["held_out"] and truth[r["doc_id"]] is not None]
    assert len(judged) > 80 and sum(judged) >= 0.97 * len(judged)
    assert {r["score"] for r in classify.classify(df, labels.where("false"), "y", model, 0.5).collect()} == {0.5}


def test_factors_see_what_two_terms_say_together(spark):
    """The label is that both or neither of two words is there: no term alone tells anything."""
    rng, rows = random.Random(1), []
    for i in range(4000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [f"fill{rng.randrange(300)}" for _ in range(15)] + ["insult"] * a + ["group"] * b
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(a == b)))
    df, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, y int")
    held = F.col("doc_id") % 4 == 0
    right = {m: sum(r["held_out"] and r["predicted"] == rows[r["doc_id"]][2] for r in classify.classify(df, labels, "y", m, 0.5, held_out=held).collect()) for m in ("factors", "linear")}
    assert right["factors"] >= 980 and right["linear"] < 800


def test_factors_see_pairs_of_rare_words():
    """Each of two words is in 2 % of the texts and tells nothing alone: with both the label is 1, with one of them 0."""
    rng, rows = np.random.default_rng(7), []
    slots = {k: np.unique(rng.integers(0, 1 << classify.BITS, 9000))[k] for k in (17, 4000)}
    filler = np.unique(rng.integers(0, 1 << classify.BITS, 6000))
    for i in range(10_000):
        kind = i % 100 if i % 100 < 3 else None  # both, the first, the second
        own = rng.choice(filler, 120, replace=False).tolist() + [slots[17]] * (kind in (0, 1)) + [slots[4000]] * (kind in (0, 2))
        label = float(rng.random() < 0.5) if kind is None else float(kind == 0 or (rng.random() < 0.0))
        rows.append((np.unique(own), None, label, kind))
    # as many texts with both as with one alone, so that neither word says anything by itself
    rows = [r for i, r in enumerate(rows) if r[3] != 0] + [r for r in rows if r[3] == 0]
    learn, held_out = rows[::2], [r for r in rows[1::2] if r[3] is not None]
    known = classify._telling([r[:3] for r in learn])
    assert {slots[17], slots[4000]} <= set(known.tolist())
    fitted = classify.fit_factors([r[:3] for r in learn])
    linear, factors = fitted["linear"], fitted["factors"]

    def score(at):
        total = factors[at].sum(axis=0)
        return linear[-1] + linear[at].sum() + 0.5 * (total @ total - (factors[at] ** 2).sum())

    assert sum((score(r[0]) >= 0) == r[2] for r in held_out) >= 0.95 * len(held_out)


def test_scores_are_the_models_sums():
    """Both scores against the plain double loop over a text's features."""
    texts = pa.array(["one two three two", "insult the group", ""])
    rng = np.random.default_rng(2)
    linear, factors = rng.normal(size=(1 << classify.BITS) + 1), rng.normal(size=(1 << classify.BITS, 3))
    for _, slots, values in classify.terms(texts):
        pairs = sum(float(factors[a] @ factors[b]) for i, a in enumerate(slots) for b in slots[:i])
        total = factors[slots].sum(axis=0)
        assert math.isclose(0.5 * float(total @ total - (factors[slots] ** 2).sum()), pairs, rel_tol=1e-9, abs_tol=1e-9) and (values == 1).all()
    for _, slots, values in classify.ngrams(texts):
        assert len(set(slots.tolist())) == len(slots) and (not len(slots) or math.isclose(float(values @ values), 1.0, rel_tol=1e-6))
    rows = [(np.array([i % 2, 2]), np.array([1.0, 0.5]), float(i % 2)) for i in range(200)]
    learner, want = classify.Ftrl(1 << classify.BITS, 1.0, 1.0, 0.05, 0.0), {}
    for _ in range(4):  # follow-the-regularised-leader, a coordinate at a time
        for at, value, y in rows:
            at, value = [*at.tolist(), 1 << classify.BITS], [*value.tolist(), 1.0]
            weight = lambda k: 0.0 if abs(want.get(k, (0.0, 0.0))[0]) <= 0.05 else -(want[k][0] - math.copysign(0.05, want[k][0])) / (1.0 + math.sqrt(want[k][1]))
            p = 1 / (1 + math.exp(-sum(weight(k) * v for k, v in zip(at, value))))
            w = {k: weight(k) for k in at}
            for k, v in zip(at, value):
                z, n = want.get(k, (0.0, 0.0))
                g = (p - y) * v
                want[k] = (z + g - (math.sqrt(n + g * g) - math.sqrt(n)) * w[k], n + g * g)
    fitted = classify.fit_linear(rows)["linear"]
    assert all(math.isclose(fitted[k], weight(k), rel_tol=1e-4, abs_tol=1e-5) for k in want) and linear is not None


def _plain_spans(text):
    """The contract's patterns, one after the other, by re alone."""
    digits = lambda x: re.sub("[^0-9]", "", x)
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    kinds = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda x: 13 <= len(digits(x)) <= 19 and luhn(digits(x))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= len(digits(x)) <= 15),
    ]
    return [(k, *m.span()) for k, (p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m[0])]


@given(st.text(alphabet="aB1.9@+- ()_%é\n0", max_size=60))
@settings(max_examples=600, deadline=None)
def test_base_spans_are_the_patterns_matches(text):
    assert pii.base_spans(text) == _plain_spans(text)


@pytest.mark.parametrize("text", ["1" * 1_000_000, "a" * 500_000 + "@" + "b" * 500_000, "1." * 400_000, "1..2" * 200_000, "@a" * 300_000, "+1" + "(" * 500_000, "4 " * 400_000, "a@b.c " * 100_000])
def test_very_long_texts_take_linear_time(text):
    began = time.time()
    found = pii.base_spans(text)
    pii._contexts(text, found)
    assert time.time() - began < 30


def test_context_words_are_whole_words():
    text = "x" * 300 + " Zebulon " + "y" * 400 + " zed@corp.example " + "z" * 250 + " end"
    words = {text[c["lo"] : c["hi"]] for c in pii._contexts(text, pii.base_spans(text))}
    assert words == {"x" * 300, "Zebulon", "y" * 400, "z" * 250, "end"}
