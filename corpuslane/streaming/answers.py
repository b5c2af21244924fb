"""Stateful stream operators over token deltas: collapse sniff, coverage gate, tail hold.

Input rows are ``(conv_id, turn, attempt, seq, delta, tokens)``; a non-null ``tokens`` marks the
last delta. State is one small record per attempt, kept in the RocksDB store; rows are put
in order by ``seq`` and gaps wait in the state. With ``ttl_ms`` an attempt that gets no delta for so long in processing
time is forgotten, finished or not, so state holds what was active lately; deltas that come later start anew. Spark
then also runs batches without data and never ends by itself, so such a stream needs an interval trigger and a stop.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor

from corpuslane.functions import lexicon as L
from corpuslane.streaming import decisions as D

KEYS = ["conv_id", "turn", "attempt"]
SNIFFED = "conv_id bigint, turn bigint, attempt int, verdict string, sampled int"
PART = (
    "conv_id bigint, turn bigint, attempt int, part bigint, kind string, text string, "
    "coverage string, blocked string, reason string"
)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Ordered(StatefulProcessor):
    """Delivers each key's deltas in ``seq`` order, holding back what arrives early."""

    def __init__(self, ttl_ms: int | None = None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self._state = handle.getValueState("answer", "body string", ttlDurationMs=self.ttl_ms)

    def start(self) -> dict:
        return {}

    def feed(self, s: dict, text: str, final: bool) -> list[tuple]:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        kept = self._state.get()
        s = json.loads(kept[0]) if kept else {"next": 0, "wait": {}, "over": False, **self.start()}
        for _, _, _, seq, delta, tokens in rows:
            if seq >= s["next"]:
                s["wait"][str(seq)] = [delta or "", tokens is not None]
        out: list[tuple] = []
        run, last = [], False
        while not s["over"] and str(s["next"]) in s["wait"]:
            text, last = s["wait"].pop(str(s["next"]))
            run.append(text)
            s["next"] += 1
            if last:
                s["over"] = True
        if run:
            out = self.feed(s, "".join(run), last)
        # a finished attempt keeps only a mark against replayed deltas
        self._state.update((json.dumps({"next": s["next"], "wait": {}, "over": True} if s["over"] else s),))
        named = Row(*self.columns)
        for row in out:
            yield named(*key, *row)

    def close(self) -> None:
        pass


class Sniff(Ordered):
    """One verdict per attempt, from the first characters or all that arrived."""

    columns = ["conv_id", "turn", "attempt", "verdict", "sampled"]

    def start(self) -> dict:
        return {"held": "", "told": False}

    def feed(self, s, text, final):
        if s["told"]:
            return []
        s["held"] += text
        if len(s["held"]) < L.SNIFF_CHARS and not final:
            return []
        # only the window is judged, however the text was cut into deltas; a shorter text whole
        sample = s["held"][: L.SNIFF_CHARS]
        s["told"], s["held"] = True, ""
        return [("rejected" if D.degenerate(sample) else "accepted", len(sample))]


class Gate(Ordered):
    """Nothing is shown until the declaration is decided; then the body passes through."""

    columns = ["conv_id", "turn", "attempt", "part", "kind", "text", "coverage", "blocked", "reason"]

    def start(self) -> dict:
        return {"pending": "", "decision": None, "part": 0}

    def emit(self, s, kind, text):
        value, blocked, reason = s["decision"]
        s["part"] += 1
        return (s["part"] - 1, kind, text, value, blocked, reason)

    def gate(self, s, text, final):
        """Text released by this delta, and whether the decision fell just now."""
        if s["decision"]:
            return ("" if s["decision"][1] else text), False
        s["pending"] += text
        found = D.coverage(s["pending"], final)
        if found is None:
            return "", False
        value, blocked, reason, body = found
        s["decision"] = [value, blocked, reason]
        released = "" if blocked else s["pending"][body:]
        s["pending"] = ""
        return released, True

    def feed(self, s, text, final):
        shown, decided = self.gate(s, text, final)
        out = [self.emit(s, "decision", "")] if decided else []
        return out + ([self.emit(s, "body", shown)] if shown else [])


class GateAndHold(Gate):
    """The gate, then the hold: the body is shown at once, the citation tail only at the end."""

    def start(self) -> dict:
        return {**super().start(), "line": "", "mid": False, "tail": None}

    def feed(self, s, text, final):
        shown, decided = self.gate(s, text, final)
        out = [self.emit(s, "decision", "")] if decided else []
        if not s["decision"] or s["decision"][1]:
            return out
        ready = ""
        if s["tail"] is not None:
            s["tail"] += shown
        else:
            s["line"] += shown
            if s["mid"]:
                # the rest of a line already begun cannot open a heading
                n = s["line"].find("\n") + 1 or len(s["line"])
                ready, s["line"] = s["line"][:n], s["line"][n:]
                s["mid"] = not ready.endswith("\n")
            cut = None if s["mid"] else D.heading_cut(s["line"], final)
            if cut is not None:
                s["tail"] = s["line"][cut:]
                ready, s["line"] = ready + s["line"][:cut], ""
            elif final:
                s["tail"] = "" if not s["mid"] and D.ends_on_heading(s["line"]) else None
                ready, s["line"] = ready + s["line"], ""
            elif not s["mid"]:
                n = D.safe_length(s["line"])
                ready, s["line"] = ready + s["line"][:n], s["line"][n:]
                s["mid"] = bool(ready) and not ready.endswith("\n")
            if ready:
                out.append(self.emit(s, "body", ready))
        if final and s["tail"] is not None:
            out.append(self.emit(s, "tail", s["tail"]))
        return out


# the worker that starts a processor gets no files of the session, so these modules travel with it
for _module in (sys.modules[__name__], D, L):
    cloudpickle.register_pickle_by_value(_module)


def _stateful(deltas: DataFrame, processor: Ordered, schema: str) -> DataFrame:
    mode = "ProcessingTime" if processor.ttl_ms else "None"
    # rows, not a frame an attempt: small groups leave the worker in shared batches
    return deltas.select(*KEYS, "seq", "delta", "tokens").groupBy(*KEYS).transformWithState(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode=mode
    )


def sniff_stream(deltas: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    return _stateful(deltas, Sniff(ttl_ms), SNIFFED)


def gate_stream(deltas: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    return _stateful(deltas, Gate(ttl_ms), PART)


def answer_parts_stream(deltas: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    return _stateful(deltas, GateAndHold(ttl_ms), PART)
