"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of every (language, n-gram bucket) are summed over all labelled rows in Spark; the
matrix of log probabilities has ``labels x BUCKETS`` cells, a bound that does not follow the
number of rows, and is broadcast. A batch is scored as the sum of its n-grams' matrix rows, in
integers, so a score does not depend on how rows are cut into batches.

Defined results: a null text, or one without a letter, is ``und`` with score 0. Without
any labelled row everything is ``und``. Ties go to the label that sorts first. Rows whose label is null or
empty teach nothing. More than ``MAX_LABELS`` labels raise an error. Repeated rows are scored
each on their own. Input columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslane.llm.shared import ready, row_of, struct_udf
from corpuslane.llm.words import pieces

BUCKETS = 1 << 15
SIZES = (1, 2, 3)
SMOOTH = 0.5
SCALE = 1 << 12
MAX_LABELS = 512
#: Gathered weights at once, 8 bytes each.
CELLS = 1 << 20
PIECE = 1 << 18
CHARS = 1 << 17
UNKNOWN = "und"

_LETTER = np.frompyfunc(lambda c: chr(c).isalpha(), 1, 1)(np.arange(1 << 16)).astype(bool)


@dataclass(frozen=True)
class Model:
    """``weights``: one row for each bucket, one column for each label, log probability x SCALE."""

    labels: tuple[str, ...]
    weights: np.ndarray


def letters(codes: np.ndarray) -> np.ndarray:
    found = _LETTER[np.minimum(codes, 0xFFFF)]
    far = np.flatnonzero(codes > 0xFFFF)
    if len(far):
        kinds, which = np.unique(codes[far], return_inverse=True)
        found[far] = np.array([chr(c).isalpha() for c in kinds])[which]
    return found


def blocks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Text number of each character, characters, which are letters, and how many may start an n-gram.

    Texts are lower-cased, everything but letters reads as a blank. Several texts make one block; one long text comes in
    blocks that overlap by what the longest n-gram needs.
    """
    lower = [(t or "").lower() for t in texts]
    step = max(CHARS, sum(map(len, lower)) if len(lower) != 1 else 0)
    text = "".join(lower)
    for a in range(0, len(text), step):
        codes = np.frombuffer(text[a : a + step + SIZES[-1] - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.zeros(len(codes), np.int32) if len(lower) == 1 else np.repeat(np.arange(len(lower), dtype=np.int32), [len(t) for t in lower])
        letter = letters(codes)
        yield owner, np.where(letter, codes, np.uint32(32)), letter, min(step, len(codes))


def ngrams(owner: np.ndarray, codes: np.ndarray, letter: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text number and bucket of each n-gram of a block, one size at a time.

    Only n-grams with a letter in their first two places count, so runs of symbols add nothing.
    """
    for n in SIZES:
        size = min(len(codes) - n + 1, most)
        if size <= 0:
            continue
        h = np.full(size, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for j in range(n):
            h = (h ^ codes[j : j + size]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
        valid = letter[:size] if n == 1 else (letter[:size] | letter[1 : size + 1]) & (owner[:size] == owner[n - 1 : n - 1 + size])
        yield owner[:size][valid], (h[valid] & np.uint32(BUCKETS - 1)).view(np.int32)


def train(rows: DataFrame, text: Column, label: Column) -> Model:
    """Counts over every row with a text and a label; the driver receives the sums only."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                names = piece.column("label").to_pylist()
                own = sorted(set(names))
                number = np.array([own.index(x) for x in names], np.int32)
                total = np.zeros(len(own) * BUCKETS, np.int64)
                for block in blocks(piece.column("text").to_pylist()):
                    for owner, bucket in ngrams(*block):
                        total += np.bincount(number[owner] * BUCKETS + bucket, minlength=len(total))
                for x, part in zip(own, total.reshape(-1, BUCKETS)):
                    sums[x] = sums[x] + part if x in sums else part
                if len(sums) > MAX_LABELS:
                    raise ValueError(f"more than {MAX_LABELS} labels")
        for x, part in sums.items():
            at = np.flatnonzero(part)
            yield pa.record_batch([pa.array([x] * len(at), pa.string()), pa.array(at), pa.array(part[at])], ["label", "bucket", "n"])

    ready(rows.sparkSession)
    labelled = rows.select(text.alias("text"), label.alias("label")).where("text IS NOT NULL AND label IS NOT NULL AND label <> ''")
    counts = labelled.mapInArrow(count, "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    # at most MAX_LABELS x BUCKETS rows
    found = counts.toArrow()
    names = found.column("label").to_pylist()
    labels = tuple(sorted(set(names)))
    if len(labels) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    place = {x: i for i, x in enumerate(labels)}
    table = np.full((BUCKETS, len(labels)), SMOOTH)
    np.add.at(table, (found.column("bucket").to_numpy(), np.array([place[x] for x in names], np.int64)), found.column("n").to_numpy())
    logs = np.log(table) - np.log(table.sum(axis=0)) if labels else table
    return Model(labels, np.rint(logs * SCALE).astype(np.int32))


def score(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    """Label and posterior probability of each text."""
    width = len(model.labels)
    if not width or not len(texts):
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    some = np.zeros(len(texts), bool)
    total = np.zeros((len(texts), width), np.int64)
    step = max(1, CELLS // width)
    for block in blocks(texts):
        some[block[0][block[2]]] = True
        for owner, bucket in ngrams(*block):
            for a in range(0, len(owner), step):
                who = owner[a : a + step]
                heads = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
                total[who[heads]] += np.add.reduceat(model.weights[bucket[a : a + step]], heads, axis=0, dtype=np.int64)
    best = total.argmax(axis=1)
    far = (total - total.max(axis=1, keepdims=True)) / SCALE
    sure = 1 / np.exp(far).sum(axis=1)
    return [model.labels[b] if s else UNKNOWN for b, s in zip(best, some)], np.where(some, sure, 0.0)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ready(docs.sparkSession)

    def run(column: pa.Array) -> pa.Array:
        labels, sure = [], []
        for piece in pieces(pa.record_batch([column], ["text"]), "text", PIECE):
            a, b = score(piece.column(0).to_pylist(), shared.value)
            labels += a
            sure.append(b)
        return pa.StructArray.from_arrays([pa.array(labels, pa.string()), pa.array(np.concatenate(sure) if sure else [], pa.float64())], ["lang_pred", "score"])

    found = struct_udf(run, "lang_pred string, score double")(F.col(text))
    return docs.select(row_of(docs, "lang_pred", "score"), found.alias("_found")).select("_row.*", "_found.*")


def held_out(doc_id: Column) -> Column:
    """The third of the ids kept for measuring; a null id is in neither part."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1
