"""Conversation repair and vector codes against plain versions."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskmill.llm import ball_codes, queries, turn_repair

NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
ENDS = {"", "a"}


def plain_repair(first, must, cut_off):
    """The least (cost, audit) by states of the grammar from the end: no lengths, no bands."""
    best = {q: (0, "") for q in ENDS}

    def closed(table):
        for _ in range(3):
            for q in ("", "s", "u", "a"):
                to = "a" if q == "u" else "u"
                if to in table:
                    c, audit = table[to]
                    table[q] = min(table.get(q, (1 << 40, "")), (c + 2, "I" + audit))
        return table

    best = closed(best)
    for i in range(len(first) - 1, -1, -1):
        now = {}
        for q in ("", "s", "u", "a"):
            options = [(best[q][0] + 3, "D" + best[q][1])] if q in best else []
            if not must[i]:
                for to in "sua":
                    if NEXT.get((q, to)) and to in best and (first[i] == to or to != "s"):
                        c, audit = best[to]
                        options.append((c + cut_off[i] + (0 if first[i] == to else 2), ("K" if first[i] == to else "R") + audit))
            if options:
                now[q] = min(options)
        best = closed(now)
    return best[""]


def _random_turns(rng, n):
    must = [rng.random() < 0.15 for _ in range(n)]
    return "".join(rng.choice("suuaax" if rng.random() < 0.3 else "ua") for _ in range(n)), must, [int(not m and rng.random() < 0.2) for m in must]


def test_audits_are_those_of_the_grammar():
    rng = random.Random(1)
    for _ in range(4000):
        turns = _random_turns(rng, rng.randint(0, 9))
        assert turn_repair.repair_plan(*turns) == plain_repair(*turns), turns


@pytest.mark.parametrize("n", [64, 65, 130, 400])
def test_long_conversations_and_blocks_of_the_table(n):
    for seed in range(4):
        turns = _random_turns(random.Random(seed), n)
        assert turn_repair.repair_plan(*turns) == plain_repair(*turns)


def _plain_conversations(rows):
    """conv_id -> (gaps, blank, duplicate, truncated, illegal, cost, audit, sha) of (conv, turn, role, text)."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        kept = by[conv]
        if how == 0:
            continue
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        role = "user" if how == 4 else role
        kept += [(turn, role, text)] * (2 if how == 3 else 1)
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        count, seen, must, cut_off = {"blank": 0, "duplicate": 0, "truncated": 0}, [], [], []
        for _, role, text in turns:
            inside = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not inside else "duplicate" if (role, text) in seen else "truncated" if inside[-1] not in ".!?" else None
            seen.append((role, text))
            if fault:
                count[fault] += 1
            must.append(fault in ("blank", "duplicate"))
            cut_off.append(int(fault == "truncated"))
        first = [r[:1] or "?" for _, r, _ in turns]
        cost, audit = plain_repair(first, must, cut_off)
        numbers = {t for t, _, _ in turns if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        lines, left, size, at = [], list(turns), len(audit) - audit.count("D"), 0
        for edit in audit:
            row = left.pop(0) if edit != "I" else None
            if edit == "D":
                continue
            want = "s" if size % 2 and at == 0 else "ua"[(at - size % 2) % 2]
            at += 1
            role = row[1] if edit == "K" else {"u": "user", "a": "assistant"}[want]
            assert role[:1] == want
            lines.append(f"{role}:{row[2] if row else ''}")
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip([r[:1] for _, r, _ in turns], [r[:1] for _, r, _ in turns][1:]))
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def turns(spark):
    rng, rows = random.Random(4), []
    for conv in range(150):
        for turn in range(rng.choice([1, 2, 3, 5, 8, 30])):
            role = rng.choice(["user", "assistant", "system", "tool", "", "User"]) if rng.random() < 0.2 else ("user", "assistant")[turn % 2]
            text = rng.choice(["Yes.", "No", " ", "", "Why?\n", "é!", "same. ", "a\nb.", f"text {conv} {turn}."])
            rows.append((conv, turn, role, text))
    gone = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(gone, 0, "user", "all of it goes."), (None, 0, "user", "hi."), (None, 1, None, None), (200, None, "user", "x."), (200, None, "assistant", "y."), (201, None, None, None), (202, 5, "user", "long. " * 50_000), (202, 5, "assistant", "tie."), (202, 5, "assistant", "tie."), (202, 9, "assistant", "later.")]
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, pos int, audit string"), rows


def test_conversations_match_plain_versions(turns):
    df, rows = turns
    got = {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in turn_repair.audits(turn_repair.damaged(df)).collect()}
    assert got == _plain_conversations(rows)
    assert {r[6] == "" for r in got.values()} == {True, False}
    assert turn_repair.audits(turn_repair.damaged(df.where("false"))).count() == 0


def test_repaired_conversations_need_no_more_edits(turns):
    df, rows = turns
    fixed = turn_repair.repair(turn_repair.as_turns(df))
    said = [(r["conv_id"], r["pos"], r["edit"], r["role"], r["text"]) for r in fixed.collect()]
    by = defaultdict(str)
    for conv, _, _, role, _ in sorted(said, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        by[conv] += role[:1]
    assert all(re.fullmatch("(s?(ua)+)?", x) for x in by.values())
    assert {r[2] for r in said} == {"K", "R", "I"} and all(r[4] == "" for r in said if r[2] == "I")


def test_query_of_conversations(spark, tmp_path, turns):
    turns[0].write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op11_turn_repair(spark, str(tmp_path))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r["conv_id"]: tuple(r)[1:] for r in got.collect()} == _plain_conversations(turns[1])


def plain_codes(rows, entries=256, parts=4, rounds=4):
    """(codes, errors, books) of (id, ints) by looking at every entry."""
    ints = np.array([v for _, v in rows], dtype=object)
    x = ints.reshape(len(rows), parts, -1)
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, list(rows[i][1])))[:entries]
    books = [[x[i, p] for i in first] for p in range(parts)]

    def assign(p):
        return [min(((((v - c) ** 2).sum()), j) for j, c in enumerate(books[p])) for v in x[:, p]]

    for _ in range(rounds):
        moved = []
        for p in range(parts):
            got, new = assign(p), list(books[p])
            for j in range(len(new)):
                own = [x[i, p] for i, (_, k) in enumerate(got) if k == j]
                if own:
                    new[j] = sum(own) // len(own)
            moved.append(new)
        books = moved
    final = [assign(p) for p in range(parts)]
    codes = ["".join(f"{final[p][i][1]:02x}" for p in range(parts)) for i in range(len(rows))]
    return codes, [int(sum(final[p][i][0] for p in range(parts))) for i in range(len(rows))], ",".join(str(int(c)) for b in books for e in b for c in e)


def test_moves_of_balls_find_the_nearest_of_all_entries():
    rng = np.random.default_rng(2)
    for scale, n in ((3, 40), (60, 256), (1 << 25, 50)):
        centres = rng.integers(-scale, scale, (n, 4))
        centres[5] = centres[9]
        x = rng.integers(-scale, scale, (3000, 4))
        x[:200] = centres[rng.integers(0, n, 200)]
        want = [min((int(((v - c) ** 2).sum()), j) for j, c in enumerate(centres)) for v in x]
        for start in (rng.integers(0, n, len(x)), ball_codes.nearest_entries(x, centres)[0]):
            code, own = ball_codes.Balls(centres).move(x, start)
            assert list(zip(own.tolist(), code.tolist(), strict=True)) == want


def test_balls_skip_stable_cores(monkeypatch):
    rng = np.random.default_rng(3)
    centres = np.arange(16)[:, None] * np.full((1, 8), 1000)
    x = centres[rng.integers(0, 16, 2000)] + rng.integers(-5, 5, (2000, 8))
    code, _ = ball_codes.nearest_entries(x, centres)
    balls = ball_codes.Balls(centres)
    monkeypatch.setattr(ball_codes, "_distances", None)  # nothing is computed but the way to the own centre
    assert (balls.move(x, code)[0] == code).all()


def test_codes_match_plain_codes(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 16)).astype(np.float32)
    x[300:330] = x[10]
    rows = [(i, [float(v) for v in x[i]], None if i % 5 == 0 else i % 3) for i in range(len(x))]
    rows += [(20, rows[20][1], 1), (None, [0.5] * 16, None), (-3, [-1.0] * 16, 2)]
    odd = [(900, None, 1), (901, [None] + [1.0] * 15, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, [float("inf")] * 16, 1), (904, [], 1), (905, [1.0] * 15, 1), (906, [1e6] * 16, 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, embedding array<float>, label int, code string").repartition(3)
    ints = [(i, [int(np.floor(1024.0 * np.float32(v))) for v in vec]) for i, vec, _ in rows]
    codes, errors, books = plain_codes(ints)
    by = defaultdict(int)
    for (_, _, label), e in zip(rows, errors, strict=True):
        by[label] += e
    sha = hashlib.sha256(books.encode()).hexdigest()
    want = sorted((i is not None, i or 0, c, e, by[label], sha) for (i, _, label), c, e in zip(rows, codes, errors, strict=True))
    got = [(r["vec_id"] is not None, r["vec_id"] or 0, r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in ball_codes.compress(df).collect()]
    assert sorted(got) == want
    assert ball_codes.compress(df.where("false")).count() == 0
    few = ball_codes.compress(df.where("vec_id IN (1, 2, 900)")).orderBy("vec_id").collect()
    assert [(r["code"], r["error"]) for r in few] == [("00000000", 0), ("01010101", 0)]


def test_lengths_that_parts_do_not_divide(spark):
    df = spark.createDataFrame([(i, [i * 0.1, 0.2, -0.3, 0.4, 0.5]) for i in range(9)], "vec_id long, embedding array<double>").withColumn("label", F.lit("a"))
    assert [r["error"] for r in ball_codes.compress(df, entries=9).collect()] == [0] * 9


def test_query_of_codes(spark):
    got = queries.op13_ball_codes(spark, "/root/testdata/sf0.001")
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    rows = got.collect()
    given = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    codes, errors, books = plain_codes([(r["vec_id"], [int(np.floor(1024.0 * v)) for v in r["embedding"]]) for r in given])
    assert {(r["vec_id"], r["code"], r["error"]) for r in rows} == set(zip([g["vec_id"] for g in given], codes, errors, strict=True))
    assert {r["codebooks_sha256"] for r in rows} == {hashlib.sha256(books.encode()).hexdigest()}
