"""Toxicity by multiple-instance learning: documents are bags of sentences, and only bags have labels.

A sentence with evidence has the score ``sigmoid(bias + sum of weights)`` over its distinct features
(its words, and how its words begin); a sentence without evidence has none. Noisy-or combines them:
``1 - (1 - leak) * product of (1 - score)``, where ``leak`` is the rate of label 1 among documents without
evidence. Weights are fitted to the document labels by the gradient of the noisy-or likelihood, so a
positive document is explained by the sentences that other positive documents share. The scored sentences
then locate what offends.

Evidence is found over all labelled rows in two passes: document counts of 2^20 hashed buckets by label
leave the buckets that go with label 1, and features of those buckets are counted again by their 64-bit
hashes. A feature is kept when the likelihood ratio of its counts reaches ``RATIO`` and it multiplies the odds of label 1 by
``ODDS`` (``BUCKET_ODDS`` for a bucket, where others share the count), so that common words of long documents are no
evidence; the model holds the ``FEATURES`` strongest. Each step of the fit sums the gradient over all bags in Spark.

Defined results: null and empty texts have no sentence and score ``leak``, as does every text without
evidence. Sentences end at ``.``, ``!``, ``?`` or a line end; words are runs of letters, lower-cased. Rows whose
label is neither 0 nor 1, or whose text is null, teach nothing; without labels of both kinds the leak is the rate
of label 1 (0 without rows) and there is no evidence. Repeated rows count each. Input columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslane.llm.langid import letters
from corpuslane.llm.shared import lists, ready, row_of, stored, struct_udf
from corpuslane.llm.words import mix, pieces, signed

BUCKETS = 1 << 20
FEATURES = 1 << 16
RATIO = 20.0
ODDS, BUCKET_ODDS = 4.0, 2.0
BEGINS = (3, 4, 5, 6)
STEPS = 24
RATE = 0.5
RIDGE = 1e-3
BIAS = -3.0
CHARS = 1 << 17
PIECE = 1 << 18
OFFENDS = 0.5
HIGH = 0.7

_SALT = np.random.default_rng(20250311).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_BREAK = np.isin(np.arange(256), [ord(c) for c in ".!?\n\r"])


def _low(code: int) -> int:
    low = chr(code).lower()
    return ord(low) if len(low) == 1 else code


_LOW = np.array([_low(c) for c in range(1 << 16)], np.uint32)


@dataclass(frozen=True)
class Model:
    """``hashes`` (sorted) and ``weights`` of the features."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float
    leak: float


def features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Text number, sentence number, first character of its word, and hash of each feature.

    Several texts make one block; one long text comes in blocks that end behind a character that is no
    letter, so no word is cut. Sentence numbers run on through all of them.
    """
    if len(texts) != 1:
        yield _block("\n".join(texts), np.cumsum([0, *[len(t) + 1 for t in texts]])[:-1])[0]
        return
    text, sentence, a = texts[0], 0, 0
    while a < len(text):
        b = min(a + CHARS, len(text))
        while b < len(text) and text[b - 1].isalpha():
            b += 1
        (owner, number, place, hashes), breaks = _block(text[a:b], np.zeros(1, np.int64))
        yield owner, sentence + number, a + place, hashes
        sentence, a = sentence + breaks, b


def _block(text: str, begins: np.ndarray) -> tuple[tuple[np.ndarray, ...], int]:
    """Features of texts that stand one after the other, and the number of sentence ends."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = letters(codes)
    codes = _lower(codes)
    breaks = np.cumsum(_BREAK[np.minimum(codes, 0xFF)])
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        none = np.empty(0, np.int64)
        return (none, none, none, none.view(np.uint64)), int(breaks[-1]) if len(breaks) else 0
    size = end - start
    flat = np.flatnonzero(inside)
    place = flat - np.repeat(start, size)
    heads = np.concatenate([[0], np.cumsum(size)[:-1]])
    with np.errstate(over="ignore"):
        part = mix(codes[flat].astype(np.uint64) * _SALT[place & 31] + place.astype(np.uint64))
        begin = part[heads].copy()
        which, hashes = [np.arange(len(start))], [mix(np.add.reduceat(part, heads) + np.uint64(1))]
        for n in range(2, max(BEGINS) + 1):
            long = np.flatnonzero(size >= n)
            begin[long] += part[heads[long] + n - 1]
            if n in BEGINS:
                which.append(long)
                hashes.append(mix(begin[long] + np.uint64(2)))
    at = np.concatenate(which)
    owner = np.searchsorted(begins, start, side="right") - 1
    return (owner[at], breaks[start][at], (start - begins[owner])[at], np.concatenate(hashes)), int(breaks[-1])


def _lower(codes: np.ndarray) -> np.ndarray:
    """Lower case, where that is one character, so that places stay those of the text."""
    found = _LOW[np.minimum(codes, 0xFFFF)]
    far = np.flatnonzero(codes > 0xFFFF)
    if len(far):
        kinds, which = np.unique(codes[far], return_inverse=True)
        found[far] = np.array([_low(c) for c in kinds.tolist()], np.uint32)[which]
    return found


def evidence_of(n: np.ndarray, ones: np.ndarray, total: int, total_ones: int, odds: float) -> np.ndarray:
    """Likelihood ratio (G) of holding a feature and label 1, from documents with it (``n``, of label 1 ``ones``) and all; zero
    where holding it does not multiply the odds of label 1 by ``odds``."""

    def term(seen: np.ndarray, among: np.ndarray, rate: float) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(seen > 0, seen * np.log(seen / (among * rate)), 0.0)

    n, ones = n.astype(float), ones.astype(float)
    rate = total_ones / total
    rest, rest_ones = total - n, total_ones - ones
    g = 2 * (term(ones, n, rate) + term(n - ones, n, 1 - rate) + term(rest_ones, rest, rate) + term(rest - rest_ones, rest, 1 - rate))
    return np.where(ones * (total - total_ones) >= odds * (n - ones) * total_ones, g, 0.0)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)


def _bucket_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Documents with a feature of each bucket: all, and those of label 1. The driver gets one number a bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                seen = np.empty(0, np.int64)
                for owner, _, _, hashes in features(piece.column("text").to_pylist()):
                    seen = np.union1d(seen, owner * BUCKETS + _bucket(hashes))
                owner, bucket = np.divmod(seen, BUCKETS)
                label = np.asarray(piece.column("label"))[owner]
                for k in (0, 1):
                    sums[k] += np.bincount(bucket[label == k], minlength=BUCKETS)
        for label in (0, 1):
            at = np.flatnonzero(sums[label])
            yield pa.record_batch([pa.array(at), pa.array(sums[label, at] * (label == 1)), pa.array(sums[label, at])], ["bucket", "ones", "n"])

    found = rows.mapInArrow(count, "bucket long, ones long, n long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).toArrow()
    n, ones = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    n[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    ones[found.column("bucket").to_numpy()] = found.column("ones").to_numpy()
    return n, ones


def _bags(rows: DataFrame, open_buckets: np.ndarray) -> DataFrame:
    """Per labelled row its distinct (sentence, feature) pairs within the open buckets."""
    shared = rows.sparkSession.sparkContext.broadcast(np.packbits(open_buckets))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                found = [np.empty((3, 0), np.int64)]
                for owner, sentence, _, hashes in features(piece.column("text").to_pylist()):
                    at = np.flatnonzero(passes[_bucket(hashes)])
                    found.append(np.unique(np.stack([owner[at], sentence[at], signed(hashes[at])]), axis=1))
                owner, sentence, hashes = np.unique(np.concatenate(found, axis=1), axis=1)
                counts = np.bincount(owner, minlength=piece.num_rows)
                yield pa.record_batch(
                    [piece.column("label"), lists(counts, pa.array(sentence)), lists(counts, pa.array(hashes))], ["label", "sentence", "hash"]
                )

    return rows.mapInArrow(gather, "label int, sentence array<long>, hash array<long>")


def _bag_losses(sentence: np.ndarray, at: np.ndarray, bag: np.ndarray, label: np.ndarray, w: np.ndarray, bias: float, leak: float) -> tuple[np.ndarray, float, float]:
    """Gradient of the negative log likelihood for weights and bias, and the loss.

    ``sentence`` and ``bag`` number the entries, ``at`` is the feature of each.
    """
    z = bias + np.bincount(sentence, w[at])
    owner = np.zeros(len(z), np.int64)
    owner[sentence] = bag
    log_clean = -np.logaddexp(0, z)
    clean = np.log1p(-leak) + np.bincount(owner, log_clean, len(label))
    dirty = -np.expm1(np.minimum(clean, -1e-12))
    loss = -np.where(label == 1, np.log(dirty), clean).sum()
    score = 1 / (1 + np.exp(-z))
    pull = np.where(label == 1, -np.exp(clean) / dirty, 1.0)[owner] * score
    return np.bincount(at, pull[sentence], len(w)), float(pull.sum()), float(loss)


def _entries(batch: pa.RecordBatch, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Known features of a batch of bags: sentence numbers that run through the batch, feature, bag, and the labels
    of bags with any."""
    sizes = np.asarray(pa.compute.list_value_length(batch.column("hash"))).astype(np.int64)
    bag = np.repeat(np.arange(len(sizes)), sizes)
    found, sentence = np.asarray(batch.column("hash").flatten()), np.asarray(batch.column("sentence").flatten())
    at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
    known = hashes[at] == found if len(hashes) else np.zeros(len(found), bool)
    at, bag, sentence = at[known], bag[known], sentence[known]
    some, bag = np.unique(bag, return_inverse=True)
    new = np.ones(len(bag), bool)
    new[1:] = (bag[1:] != bag[:-1]) | (sentence[1:] != sentence[:-1])
    return np.cumsum(new) - 1, at, bag, np.asarray(batch.column("label"))[some]


def train(rows: DataFrame, text: Column, label: Column) -> Model:
    """Fit on every row with a text and a label of 0 or 1."""
    ready(rows.sparkSession)
    labelled = rows.select(text.alias("text"), label.cast("int").alias("label")).where("text IS NOT NULL AND label IN (0, 1)")
    labelled = stored(labelled, "labelled")
    total, total_ones = labelled.agg(F.count("*"), F.sum("label")).first()
    empty = Model(np.empty(0, np.int64), np.empty(0), BIAS, (total_ones or 0) / max(total, 1))
    if not total or total_ones in (0, total):
        return empty
    n, ones = _bucket_counts(labelled)
    bags = stored(_bags(labelled, evidence_of(n, ones, total, total_ones, BUCKET_ODDS) >= RATIO), "bags")
    counted = (
        bags.select("label", F.explode(F.array_distinct("hash")).alias("hash")).groupBy("hash")
        .agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("ones"))
    )
    ratio = F.arrow_udf(lambda n, k: pa.array(evidence_of(np.asarray(n), np.asarray(k), total, total_ones, ODDS)), returnType="double")
    # at most FEATURES rows
    best = counted.select("hash", ratio("n", "ones").alias("g")).where(F.col("g") >= RATIO).orderBy(F.desc("g"), "hash").limit(FEATURES).toArrow()
    hashes = np.sort(best.column("hash").to_numpy())
    if not len(hashes):
        return empty
    shared = rows.sparkSession.sparkContext.broadcast(hashes)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sentence, at, bag, labels = _entries(batch, shared.value)
            sizes = np.bincount(bag, minlength=len(labels))
            yield pa.record_batch([pa.array(labels, pa.int32()), lists(sizes, pa.array(sentence)), lists(sizes, pa.array(at))], ["label", "sentence", "at"])

    bags = stored(bags.select("label", "sentence", "hash").mapInArrow(evidence, "label int, sentence array<long>, at array<long>"), "evidence")
    seen, seen_ones = bags.agg(F.count("*"), F.sum("label")).first()
    leak = min(max(((total_ones - (seen_ones or 0)) / (total - seen)) if total > seen else 0.0, 1e-6), 0.5)
    return _fit(bags, hashes, leak, total)


def _fit(bags: DataFrame, hashes: np.ndarray, leak: float, total: int) -> Model:
    """Full gradients from Spark, steps by Adam on the driver: the state is one number a feature."""
    size = len(hashes)
    w, bias = np.zeros(size + 1), BIAS
    w[-1] = bias
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    context = bags.sparkSession.sparkContext

    for step in range(1, STEPS + 1):
        state = context.broadcast(w)

        def gradient(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now = state.value
            own = np.zeros(size + 1)
            for batch in batches:
                counts = np.asarray(pa.compute.list_value_length(batch.column("at"))).astype(np.int64)
                if not counts.sum():
                    continue
                bag = np.repeat(np.arange(len(counts)), counts)
                raw = np.asarray(batch.column("sentence").flatten())
                new = np.ones(len(bag), bool)
                new[1:] = (bag[1:] != bag[:-1]) | (raw[1:] != raw[:-1])
                a, b, _ = _bag_losses(np.cumsum(new) - 1, np.asarray(batch.column("at").flatten()), bag, np.asarray(batch.column("label")), now[:-1], now[-1], leak)
                own[:-1] += a
                own[-1] += b
            at = np.flatnonzero(own)
            yield pa.record_batch([pa.array(at), pa.array(own[at])], ["at", "g"])

        sums = bags.mapInArrow(gradient, "at long, g double").groupBy("at").agg(F.sum("g").alias("g")).toArrow()
        g = np.zeros(size + 1)
        g[sums.column("at").to_numpy()] = sums.column("g").to_numpy()
        g = g / total
        g[:-1] += RIDGE * w[:-1] / size
        first = 0.9 * first + 0.1 * g
        second = 0.99 * second + 0.01 * g * g
        w = w - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
        state.unpersist()
    # summed in another order, the last digits differ between runs
    return Model(hashes, np.round(w[:-1], 6), float(np.round(w[-1], 6)), leak)


def sentences(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, int, float]]]]:
    """Per text its score, its number of sentences with evidence, and (begin, end, score) of those that offend.

    ``begin`` is the first code point of a sentence's evidence, ``end`` that of its last word.
    """
    n, found = len(texts), [np.empty((4, 0), np.int64)]
    for owner, number, place, hashes in features([t or "" for t in texts]) if len(model.hashes) else ():
        key = signed(hashes)
        at = np.minimum(np.searchsorted(model.hashes, key), len(model.hashes) - 1)
        known = np.flatnonzero(model.hashes[at] == key)
        found.append(np.stack([owner[known], number[known], place[known], at[known]]))
    owner, number, place, at = np.concatenate(found, axis=1)
    kinds, first, which = np.unique(number, return_index=True, return_inverse=True)
    _, once = np.unique(which * (len(model.hashes) + 1) + at, return_index=True)
    z = model.bias + np.bincount(which[once], model.weights[at[once]], len(kinds))
    low, high = np.full(len(kinds), np.iinfo(np.int64).max), np.full(len(kinds), -1)
    np.minimum.at(low, which, place)
    np.maximum.at(high, which, place)
    bag = owner[first]
    clean = np.log1p(-model.leak) - np.bincount(bag, np.logaddexp(0, z), n)
    score = 1 / (1 + np.exp(-z))
    bad: list[list[tuple[int, int, float]]] = [[] for _ in range(n)]
    for k in np.flatnonzero(score >= OFFENDS):
        bad[bag[k]].append((int(low[k]), int(high[k]), float(score[k])))
    return -np.expm1(clean), np.bincount(bag, minlength=n), bad


def locate(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, ``predicted``, ``n_evidence`` (sentences) and ``offending``: where the first
    and the last word of evidence begin, with the sentence's score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ready(docs.sparkSession)

    def run(column: pa.Array) -> pa.Array:
        score, n, bad = [], [], []
        for piece in pieces(pa.record_batch([column], ["text"]), "text", PIECE):
            a, b, c = sentences(piece.column(0).to_pylist(), shared.value)
            score += a.tolist()
            n += b.tolist()
            bad += [[dict(zip(("begin", "end", "score"), x)) for x in own] for own in c]
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        return pa.StructArray.from_arrays([pa.array(score, pa.float64()), pa.array(n, pa.int64()), pa.array(bad, kind)], ["score", "n_evidence", "offending"])

    found = struct_udf(run, "score double, n_evidence long, offending array<struct<begin: long, end: long, score: double>>")(F.col(text))
    kept = docs.select(row_of(docs, "score", "predicted", "n_evidence", "offending"), found.alias("_found")).select("_row.*", "_found.*")
    return kept.withColumn("predicted", (F.col("score") >= HIGH).cast("int"))
