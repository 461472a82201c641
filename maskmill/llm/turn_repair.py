"""Conversation structure repair (operator 11): the cheapest edits that make a conversation's roles follow (s?(ua)+)?.

Turns are aligned with target strings of the grammar by Wagner-Fischer. Tables run from the end: cell (i, r) is the cost of
aligning the turns from i on with the last r roles, which are the same for all even lengths, and behind the s of all odd ones;
so one table holds the alignment with each feasible length. Ukkonen's band keeps the cells that a repair at most as dear as
the incumbent can pass: with b left of the incumbent's cost after the deletions that are required, r is at most b / 3 below and
b / 2 above the turns left that need not go. Lengths of equal cost are traced from the front, smallest letter first,
and their audits compared.

A conversation is one ordered group, and its answer (an audit, a digest over its text) is one row. Rows come to a task in
Spark's sorted order, so that it holds a few bytes a turn and no texts: one pass makes the audits, a second one applies them
to the texts as they come.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, slots

DELETE, INSERT, REROLE = 3, 2, 2
SPACES = " \t\n\x0b\x0c\r"
FAR = 1 << 40
#: Every so many rows of the table are kept for the trace; those between are made again.
STEP = 64
LEGAL = {"su", "ua", "au"}
_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_SUMMARY = ", ".join(f"{c} long" for c in _COUNTS) + ", audit string"


def _greedy(first: str, must: list[bool], cut_off: list[int]) -> int:
    """The cost of a repair made in one go from the front: the first incumbent."""
    cost, state = 0, ""
    for i, c in enumerate(first):
        want = "a" if state == "u" else "u"
        if must[i] or (c == "s" and state and state != "u"):
            cost += DELETE
        elif c == "s" and not state:
            cost, state = cost + cut_off[i], "s"
        else:
            cost, state = cost + cut_off[i] + (0 if c == want else REROLE), want
    return cost + {"u": INSERT, "s": 2 * INSERT}.get(state, 0)


class Alignment:
    """The banded table of one conversation. first: role initials; must: whether a turn has to go; cut_off: 1 for truncated turns."""

    def __init__(self, first: str, must: list[bool], cut_off: list[int]):
        self.first, self.must, self.cut_off, self.n = first, must, cut_off, len(first)
        self.stay = np.cumsum([0, *(not m for m in reversed(must))])[::-1].tolist()  # turns from i on that may stay
        gone = sum(must)
        self.budget = min(_greedy(first, must, cut_off), DELETE * self.n)
        spare = self.budget - DELETE * gone
        self.below, self.above = spare // DELETE, spare // INSERT
        self.kept: dict[int, np.ndarray] = {}
        row = INSERT * np.arange(self.above + 1, dtype=np.int64)
        self.kept[self.n] = row
        for i in range(self.n - 1, -1, -1):
            row = self._step(i, row)
            if i % STEP == 0:
                self.kept[i] = row
        self.block: dict[int, np.ndarray] = {0: row}

    def low(self, i: int) -> int:
        return max(0, self.stay[i] - self.below)

    def _slice(self, i: int, row: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Cells lo to hi of row i, FAR outside its band."""
        out, at = np.full(hi - lo + 1, FAR, np.int64), self.low(i)
        a, b = max(lo, at), min(hi, at + len(row) - 1)
        if a <= b:
            out[a - lo : b - lo + 1] = row[a - at : b - at + 1]
        return out

    def _step(self, i: int, after: np.ndarray) -> np.ndarray:
        lo, hi = self.low(i), self.stay[i] + self.above
        best = DELETE + self._slice(i + 1, after, lo, hi)
        r = np.arange(lo, hi + 1)
        if not self.must[i]:
            wrong = np.where(r % 2 == 0, self.first[i] != "u", self.first[i] != "a") * REROLE + self.cut_off[i]
            match = np.where(r > 0, wrong + self._slice(i + 1, after, lo - 1, hi - 1), FAR)
            best = np.minimum(best, match)
        return np.minimum.accumulate(best - INSERT * r) + INSERT * r

    def row(self, i: int) -> np.ndarray:
        if i in self.kept:
            return self.kept[i]
        if i not in self.block:
            end = min(-(-i // STEP) * STEP, self.n)
            self.block, row = {}, self.kept[end]
            for j in range(end - 1, i - i % STEP, -1):
                self.block[j] = row = self._step(j, row)
        return self.block[i]

    def cost(self, i: int, r: int) -> int:
        at = r - self.low(i)
        row = self.row(i)
        return int(row[at]) if 0 <= at < len(row) else FAR

    def trace(self, i: int, r: int) -> str:
        """The least audit of the cheapest alignments of the turns from i on with the last r roles."""
        out = []
        while i < self.n or r:
            left = self.cost(i, r)
            if i < self.n and DELETE + self.cost(i + 1, r) == left:
                out.append("D")
                i += 1
            elif r and INSERT + self.cost(i, r - 1) == left:
                out.append("I")
                r -= 1
            else:
                out.append("K" if self.first[i] == ("u" if r % 2 == 0 else "a") else "R")
                i, r = i + 1, r - 1
        return "".join(out)

    def best(self) -> tuple[int, str]:
        """(cost, audit) over all feasible lengths."""
        ends: list[tuple[int, int, int]] = []  # cost, turns before the part of the table, its length
        at = self.low(0)
        ends += [(int(c), -1, at + k) for k, c in enumerate(self.row(0)) if (at + k) % 2 == 0 and c <= self.budget]
        for i in range(min(self.n, self.budget // DELETE + 1)):
            if self.first[i] == "s" and not self.must[i]:
                head, at = DELETE * i + self.cut_off[i], self.low(i + 1)
                ends += [(head + int(c), i, at + k) for k, c in enumerate(self.row(i + 1)) if (at + k) % 2 == 0 and at + k > 0 and head + c <= self.budget]
        least = min(ends)[0]
        return least, min("D" * max(i, 0) + "K" * (i >= 0) + self.trace(i + 1, r) for c, i, r in ends if c == least)


def repair_plan(first: str, must: list[bool], cut_off: list[int]) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair; of equally cheap ones the least audit. No turns: 0 and an empty audit."""
    return Alignment(first, must, cut_off).best() if first else (0, "")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


class _Turns:
    """What one pass keeps of a conversation's turns, in order."""

    def __init__(self):
        self.first, self.must, self.cut_off, self.seen, self.last = [], [], [], set(), ""
        self.count = dict.fromkeys(_COUNTS, 0)
        self.least = self.most = None
        self.turns = 0

    def add(self, turn, role: str, text: str) -> None:
        c, inside = self.count, text.strip(SPACES)
        key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        fault = "blank" if not inside else "duplicate" if key in self.seen else "truncated" if inside[-1] not in ".!?" else None
        self.seen.add(key)
        if fault:
            c[fault] += 1
        c["illegal"] += bool(self.first) and self.first[-1] + role[:1] not in LEGAL
        self.first.append(role[:1])
        self.must.append(fault in ("blank", "duplicate"))
        self.cut_off.append(int(fault == "truncated"))
        if turn is not None:
            self.turns += turn != self.most
            self.least, self.most = turn if self.least is None else self.least, turn

    def summary(self) -> tuple:
        # a role without a letter is one that no target has
        cost, audit = repair_plan("".join(f or "?" for f in self.first), self.must, self.cut_off)
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return (*(self.count | {"gaps": gaps, "cost": cost}).values(), audit)


def _summaries(kind: pa.DataType):
    def make(batches):
        open_, own, done = False, None, []
        for conv, there, turn, role, text in _rows(batches):
            if not open_ or conv != own[0]:
                if open_:
                    done.append((own[0], *own[1].summary()))
                open_, own = True, (conv, _Turns())
            if there:
                own[1].add(turn, role, text)
            if len(done) >= 1000:
                yield _batch(done, kind)
                done = []
        if open_:
            done.append((own[0], *own[1].summary()))
        if done:
            yield _batch(done, kind)

    return make


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:7]), *(pa.array(c, pa.string()) for c in cols[7:])], ["conv_id", *_COUNTS, "audit", "repaired_sha256"][: len(cols)])


def repaired(audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of what an audit makes of turns (role, text)."""
    left = len(audit) - audit.count("D")

    def role() -> str:
        return "assistant" if left % 2 else "user"

    for edit in audit:
        given = next(turns) if edit != "I" else ("", "")
        if edit == "D":
            continue
        yield edit, given[0] if edit == "K" else role(), given[1]
        left -= 1


def _conversations(batches) -> Iterator[tuple[tuple, Iterator[tuple[str, str]]]]:
    """(summary row, its turns as they come) of sorted rows in which a conversation's summary comes first."""
    rows = _rows(batches)
    ahead = next(rows, None)
    while ahead is not None:
        head = ahead

        def turns():
            nonlocal ahead
            while (ahead := next(rows, None)) is not None and not ahead[1]:
                yield ahead[3], ahead[4]

        own = turns()
        yield head, own
        for _ in own:  # what the caller left
            pass


def _digests(kind: pa.DataType):
    def make(batches):
        done = []
        for head, turns in _conversations(batches):
            digest, sep = hashlib.sha256(), ""
            for _edit, role, text in repaired(head[-1], turns):
                digest.update(f"{sep}{role}:{text}".encode())
                sep = "\n"
            done.append((head[0], *head[5:], digest.hexdigest()))
            if len(done) >= 1000:
                yield _batch(done, kind)
                done = []
        if done:
            yield _batch(done, kind)

    return make


def _texts(kind: pa.DataType):
    def make(batches):
        done: list = []
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), (kind, pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], ["conv_id", "pos", "edit", "role", "text"])
        size = 0
        for head, turns in _conversations(batches):
            for pos, (edit, role, text) in enumerate(repaired(head[-1], turns)):
                done.append((head[0], pos, edit, role, text))
                size += len(text)
                if len(done) >= 4000 or size > 1 << 22:
                    yield flush()
                    done.clear()
                    size = 0
        if done:
            yield flush()

    return make


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, there, turn, role, text) of conversations with faults put in by crc32('conv_id:turn') % 20: 0 drops the row (there
    is false), 1 empties its text, 2 removes its end marks, 3 repeats it, 4 makes its role user. Null values count as one space."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.pmod(F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")), F.lit(20))
    rows = turns.select("conv_id", "turn", how.alias("how"), text_of("role").alias("role"), text_of("text").alias("text"))
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("how") == 4, "user").otherwise(F.col("role"))
    many = F.explode(F.array_repeat(F.lit(0), F.when(F.col("how") == 3, 2).otherwise(1)))
    return rows.select("conv_id", (F.col("how") != 0).alias("there"), "turn", role.alias("role"), text.alias("text"), many.alias("again")).drop("again")


def as_turns(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, there, turn, role, text) of any table of turns as it is; null roles and texts count as one space."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return turns.select(F.col(conversation).alias("conv_id"), F.lit(True).alias("there"), F.col(turn).alias("turn"), text_of(role).alias("role"), text_of(text).alias("text"))


def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    return rows.repartition(slots(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", *first, F.asc_nulls_first("turn"), "role", "text")


def _arrow(rows: DataFrame) -> tuple[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = rows.schema["conv_id"].dataType
    return kind.simpleString(), to_arrow_type(kind)


def plans(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation of rows as damaged or as_turns give them."""
    name, kind = _arrow(rows)
    return _in_order(rows).select("conv_id", "there", "turn", "role", "text").mapInArrow(_summaries(kind), f"conv_id {name}, {_SUMMARY}")


def _with_plans(rows: DataFrame) -> DataFrame:
    """Each conversation's summary, then its turns."""
    found = cut(plans(rows))
    empty = lambda c, kind: F.lit(None).cast(kind).alias(c)
    heads = found.select("conv_id", F.lit(True).alias("head"), empty("turn", rows.schema["turn"].dataType), empty("role", "string"), empty("text", "string"), *_COUNTS, "audit")
    turns = rows.where("there").select("conv_id", F.lit(False).alias("head"), "turn", "role", "text", *(empty(c, "long") for c in _COUNTS), empty("audit", "string"))
    return _in_order(heads.unionByName(turns), F.desc("head")).select("conv_id", "head", "turn", "role", "text", *_COUNTS, "audit")


def audits(rows: DataFrame) -> DataFrame:
    """plans with repaired_sha256, the digest of the repaired conversation's lines role:text.

    Turns go by turn, nulls first; ties by role, then text. Each turn's first fault counts: blank, duplicate (role and text seen
    before), truncated. Blank and duplicate turns must go. A null conv_id is a conversation of its own. A conversation without turns
    has zeros, an empty audit and the digest of an empty text. Other columns are not read; an empty table gives an empty one.
    """
    name, kind = _arrow(rows)
    return _with_plans(rows).mapInArrow(_digests(kind), f"conv_id {name}, {_SUMMARY}, repaired_sha256 string")


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, edit, role, text): the repaired conversations; edit is K (kept), R (role changed) or I (inserted, empty text)."""
    name, kind = _arrow(rows)
    return _with_plans(rows).mapInArrow(_texts(kind), f"conv_id {name}, pos long, edit string, role string, text string")
