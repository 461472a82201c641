"""The same operators on unbounded tables: stateless redaction, windowed audit, and responses put together as their chunks come."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from maskmill.functions.rules import DEFAULT, Policy
from maskmill.operators.text import long_hits, scan_text


def stream_redact(stream: DataFrame, col: str = "text", policy: Policy = DEFAULT) -> DataFrame:
    """scan_text on a stream: stateless, exactly once by the sink's checkpoint."""
    return scan_text(stream, col, policy)


def stream_audit(stream: DataFrame, ts: str = "ts", path: str = "path", col: str = "text", window: str = "10 minutes", delay: str = "1 hour", policy: Policy = DEFAULT) -> DataFrame:
    """(start, path, rule, hits) in tumbling windows; rows later than the watermark are dropped. Works on batch tables too."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    rows = long_hits(scan_text(timed, col, policy), ts, path)
    return rows.groupBy(F.window(ts, window).alias("w"), path, "rule").agg(F.sum("hits").alias("hits")).select(F.col("w.start").alias("start"), path, "rule", "hits")


#: A response is given up when its last chunk is so much older than the watermark.
PATIENCE_MS = 60_000
_ASSEMBLED = "response_id long, text string, tool_calls string, input_tokens long, output_tokens long, total_tokens long, complete boolean"
_USAGE = ("prompt_tokens", "input_tokens", "completion_tokens", "output_tokens", "total_tokens")


class _Answer:
    """A response as far as its bytes have come: what the state holds, in memory while a batch is worked off."""

    def __init__(self, next_seq: int = 0, rest: bytes = b""):
        self.next_seq, self.rest, self.done = next_seq, rest, False
        self.said: list[str] = []  # deltas that the state does not hold yet
        self.calls: dict[int, list[str]] = {}  # index: id, name, arguments, in order of appearance
        self.usage: tuple | None = None

    def feed(self, data: bytes) -> None:
        text = (self.rest + data).replace(b"\r\n", b"\n")
        tail = b"\r" if text.endswith(b"\r") else b""
        *whole, last = text[: len(text) - len(tail)].replace(b"\r", b"\n").split(b"\n\n")
        self.rest = last + tail
        for event in whole:
            self.event(event.decode("utf-8", "replace"))

    def event(self, event: str) -> None:
        data = "\n".join(x[5:].lstrip() for x in event.split("\n") if x.startswith("data:"))
        self.done = self.done or data == "[DONE]"
        if self.done or not data:
            return
        try:
            chunk = json.loads(data)
        except ValueError:
            return
        if not isinstance(chunk, dict):
            return
        if chunk.get("usage"):
            self.usage = tuple(chunk["usage"].get(k) for k in _USAGE)
        for choice in chunk.get("choices") or []:
            delta = choice.get("delta") or {}
            if delta.get("content"):
                self.said.append(delta["content"])
            for part in delta.get("tool_calls") or []:
                index = part.get("index")
                call = self.calls.setdefault(len(self.calls) if index is None else int(index), ["", "", ""])
                function = part.get("function") or {}
                call[0] = part.get("id") or call[0]
                call[1] += function.get("name") or ""
                call[2] += function.get("arguments") or ""


class Assembler(StatefulProcessor):
    """State of one response: bytes ahead of their turn by sequence number, tool calls by index, deltas, usage, and where the
    decoder stands. A response whose chunks all come in one batch touches no state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "next_seq bigint, rest binary, due bigint")
        self.ahead = handle.getMapState("ahead", "seq bigint", "chunk binary")
        self.said = handle.getListState("said", "delta string")
        self.calls = handle.getMapState("calls", "index int", "place int, id string, name string, arguments string")
        self.usage = handle.getValueState("usage", ", ".join(f"{k} bigint" for k in _USAGE))

    def _load(self) -> tuple[_Answer, dict[int, bytes], int | None]:
        if not self.at.exists():
            return _Answer(), {}, None
        next_seq, rest, due = self.at.get()
        answer = _Answer(next_seq, bytes(rest))
        rows = sorted((tuple(v), k[0]) for k, v in self.calls.iterator())
        answer.calls = {index: list(v[1:]) for v, index in rows}
        return answer, {k[0]: bytes(v[0]) for k, v in self.ahead.iterator()}, due

    def _save(self, answer: _Answer, waiting: dict[int, bytes], had: dict[int, bytes], due: int) -> None:
        self.at.update((answer.next_seq, answer.rest, due))
        for seq in had.keys() - waiting.keys():
            self.ahead.removeKey((seq,))
        for seq in waiting.keys() - had.keys():
            self.ahead.updateValue((seq,), (waiting[seq],))
        if answer.said:
            self.said.appendList([(t,) for t in answer.said])
        for place, (index, call) in enumerate(answer.calls.items()):
            self.calls.updateValue((index,), (place, *call))
        if answer.usage:
            self.usage.update(answer.usage)

    def _out(self, key: tuple, answer: _Answer, due: int | None) -> pd.DataFrame:
        said, usage = answer.said, answer.usage
        if due is not None:
            said = [r[0] for r in self.said.get()] + said
            usage = usage or (self.usage.get() if self.usage.exists() else None)
            for state in (self.at, self.ahead, self.said, self.calls, self.usage):
                state.clear()
            self.handle.deleteTimer(due)
        calls = [{"call_id": c[0] or f"call_{key[0]}_{index}", "name": c[1], "arguments": c[2]} for index, c in answer.calls.items()]
        counts = [None] * 3
        if usage:
            given, made = usage[0] or usage[1] or 0, usage[2] or usage[3] or 0
            counts = [given, made, usage[4] or given + made]
        row = [key[0], "".join(said), json.dumps(calls, separators=(",", ":"), ensure_ascii=False) if calls else None, *counts, answer.done]
        return pd.DataFrame([row], columns=_ASSEMBLED.replace(" long", "").replace(" string", "").replace(" boolean", "").split(", ")).astype({c: "Int64" for c in ("input_tokens", "output_tokens", "total_tokens")})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        answer, had, due = self._load()
        waiting, newest = dict(had), timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            times = frame["ts"].dropna()
            newest = max(newest, int(times.max().timestamp() * 1000)) if len(times) else newest
            waiting |= {int(s): bytes(c) for s, c in zip(frame["seq"], frame["chunk"], strict=True)}
        while answer.next_seq in waiting and not answer.done:
            answer.feed(waiting.pop(answer.next_seq))
            answer.next_seq += 1
        if answer.done:
            yield self._out(key, answer, due)
            return
        if due is not None:
            self.handle.deleteTimer(due)
        self._save(answer, waiting, had, newest + PATIENCE_MS)
        self.handle.registerTimer(newest + PATIENCE_MS)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        answer, waiting, _due = self._load()
        for seq in sorted(waiting):
            if not answer.done:
                answer.feed(waiting[seq])
        if answer.rest and not answer.done:
            answer.event(answer.rest.replace(b"\r", b"\n").decode("utf-8", "replace"))
        yield self._out(key, answer, expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def stream_assemble(stream: DataFrame, delay: str = "1 minute") -> DataFrame:
    """(response_id, text, tool_calls, input_tokens, output_tokens, total_tokens, complete) of a stream (response_id, seq from 0, chunk
    binary, ts), as assemble_chunks gives them: emitted at [DONE], or, incomplete, when nothing more came for a minute of
    event time. Chunks may come in any order; null chunks hold nothing. The session's state store has to be RocksDB's; where
    none is set, it is set here."""
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in conf.get(name, ""):
        conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kept = stream.select(F.col("response_id").cast("long").alias("response_id"), F.col("seq").cast("long").alias("seq"), F.coalesce(F.col("chunk").cast("binary"), F.lit(b"")).alias("chunk"), F.col("ts").cast("timestamp").alias("ts"))
    return kept.withWatermark("ts", delay).groupBy("response_id").transformWithStateInPandas(Assembler(), _ASSEMBLED, "Append", "EventTime")
