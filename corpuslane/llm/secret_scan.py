"""Secret scans: fixed patterns, and character Markov models for random strings without a label.

The base patterns give labelled spans (assigned values, access keys, hex strings). Two first-order models over the
characters of a token are then trained on all rows: one on the strings that a pattern matched, smoothed towards
uniform choice, the other on every other token that is not a candidate itself. Only transition counts leave a task, a table of fixed size. A token of
at least ``TOKEN`` characters outside the base spans is reported as ``random`` if its log-likelihood ratio is at least
``BITS`` per character, and it mixes letters and digits.

Spans count code points, end exclusive, and are the whole match. Matches of one kind do not overlap; kinds may.

Defined results: a null text is empty and has no spans. Without any labelled secret the random model is
uniform. Repeated rows get equal results. A text is scanned whole, however long. Empty tables give no rows. Input columns
named like an output are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslane.llm.shared import ready, row_of
from corpuslane.llm.words import pieces

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE = 6
TOKEN = 20
BITS = 1.5
PRIOR = 200.0
BACKOFF = 20.0

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SYMBOLS = len(_ALPHABET)
#: Number of each character code below 128; others, and characters outside the alphabet, end a token.
_NUMBER = np.full(129, SYMBOLS, np.int64)
_NUMBER[[ord(c) for c in _ALPHABET]] = np.arange(SYMBOLS)
_WORD = re.compile(r"(?=password|passwd|secret|token|api_?key)")
_DIGIT = np.array([c.isdigit() for c in _ALPHABET] + [False])
_LETTER = np.array([c.isalpha() for c in _ALPHABET] + [False])
EDGE = SYMBOLS
STATES = SYMBOLS + 1


def ascii_lower(text: str) -> str:
    """Lower case with every character in its place; more letters than A-Z may change."""
    lower = text.lower()
    return lower if len(lower) == len(text) else text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every base match, sorted by start, then kind."""
    out = []
    lower = ascii_lower(text)
    # a keyword can only start where one stands; the pattern itself runs there
    upto = 0
    for hit in _WORD.finditer(lower):
        if hit.start() < upto:
            continue
        found = ASSIGN.match(text, hit.start())
        if found:
            upto = found.end()
            if len(found[2]) >= LEAST_VALUE:
                out.append((found.start(), found.end(), "assign"))
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def symbols(text: str) -> np.ndarray:
    """Character numbers with an edge before the first and after the last."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.full(len(codes) + 2, EDGE, np.int64)
    out[1:-1] = _NUMBER[np.minimum(codes, 128)]
    return out


def candidates(at: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of every token of at least ``TOKEN`` characters with both letters and digits."""
    inside = at != EDGE
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    long = end - start >= TOKEN
    return [(int(a), int(b)) for a, b in zip(start[long], end[long]) if _DIGIT[at[a + 1 : b + 1]].any() and _LETTER[at[a + 1 : b + 1]].any()]


def transitions(text: str, spans: list[tuple[int, int, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of character pairs inside ordinary tokens, and inside secrets.

    Candidates are neither: what is to be judged does not teach the models.
    """
    at = symbols(text)
    pairs = at[:-1] * STATES + at[1:]
    judged = np.zeros(len(at), bool)
    for a, b in candidates(at):
        judged[a + 1 : b + 1] = True
    secret = np.zeros(len(at), bool)
    for start, end, kind in spans:
        begin = start if kind != "assign" else ASSIGN.match(text, start).start(2)
        secret[begin + 1 : end + 1] = True
    both = secret[:-1] & secret[1:]
    none = ~(secret[:-1] | secret[1:] | judged[:-1] | judged[1:])
    return tuple(np.bincount(pairs[x], minlength=STATES * STATES) for x in (none, both))


def train(docs: DataFrame, text: Column) -> np.ndarray:
    """Log-likelihood ratio in bits of each transition, random over ordinary: STATES x STATES."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, STATES * STATES), np.int64)
        for batch in batches:
            for value in batch.column("text").to_pylist():
                for kind, part in enumerate(transitions(value, base_spans(value))):
                    total[kind] += part
        kind, pair = np.nonzero(total)
        yield pa.record_batch([pa.array(kind), pa.array(pair), pa.array(total[kind, pair])], ["kind", "pair", "n"])

    ready(docs.sparkSession)
    sums = docs.select(text.alias("text")).where("text IS NOT NULL").mapInArrow(count, "kind long, pair long, n long")
    counts = np.zeros((2, STATES * STATES))
    # at most 2 x STATES x STATES rows
    for row in sums.groupBy("kind", "pair").agg(F.sum("n").alias("n")).collect():
        counts[row["kind"], row["pair"]] = row["n"]
    return ratios(counts.reshape(2, STATES, STATES))


def ratios(counts: np.ndarray) -> np.ndarray:
    """Transitions between two characters of a token only; edges carry no evidence."""
    inner = counts[:, :SYMBOLS, :SYMBOLS]
    # a transition that was not seen is as likely as its second character is anywhere
    anywhere = inner[0].sum(axis=0) + 0.5
    ordinary = inner[0] + BACKOFF * anywhere / anywhere.sum()
    ordinary /= ordinary.sum(axis=1, keepdims=True)
    # secrets are few, and mostly of one kind: smoothed towards a uniform choice of letters and digits
    drawn = np.where(_DIGIT[:SYMBOLS] | _LETTER[:SYMBOLS], 1.0, 0.1)
    random = inner[1] + PRIOR * drawn / drawn.sum()
    random /= random.sum(axis=1, keepdims=True)
    out = np.zeros((STATES, STATES))
    out[:SYMBOLS, :SYMBOLS] = np.log2(random) - np.log2(ordinary)
    return np.rint(out * 1024).astype(np.int64)


def random_spans(text: str, base: list[tuple[int, int, str]], weights: np.ndarray) -> list[tuple[int, int, str]]:
    """Tokens outside the base spans that read like random strings."""
    at = symbols(text)
    for start, end, _ in base:
        at[start + 1 : end + 1] = EDGE
    out = []
    for a, b in candidates(at):
        token = at[a + 1 : b + 1]
        if weights[token[:-1], token[1:]].sum() / 1024 >= BITS * (len(token) - 1):
            out.append((a, b, "random"))
    return out


def scan(docs: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` with ``found``: an array of (kind, begin, end, base), by begin, then kind."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(column: pa.Array) -> pa.Array:
        counts, rows = [], []
        for piece in pieces(pa.record_batch([column], ["t"]), "t"):
            for value in piece.column(0).to_pylist():
                base = base_spans(value or "")
                every = sorted(base + random_spans(value or "", base, shared.value), key=lambda s: (s[0], KINDS.index(s[2])))
                counts.append(len(every))
                rows += every
        flat = pa.StructArray.from_arrays([pa.array([r[2] for r in rows], pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] != "random" for r in rows], pa.bool_())], ["kind", "begin", "end", "base"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), flat)

    ready(docs.sparkSession)
    kind = "array<struct<kind: string, begin: long, end: long, base: boolean>>"
    return docs.select(row_of(docs, "found"), F.arrow_udf(run, returnType=kind)(F.col(text)).alias("found")).select("_row.*", "found")
