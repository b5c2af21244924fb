"""Removal of repeated long spans by compaction of a De Bruijn graph of words.

Every window of ``WINDOW`` words is an edge of the graph. Windows are read in paths: neighbouring windows
of a document with the same least ``SEED``-gram form one path, a piece of a nonbranching walk that any other
copy of the text cuts at the same places, since the seed depends on the window's own words alone.

1. Seeds that only one document has cannot lie in a repeated window. Each task sends its distinct
   seeds, packed; those seen twice set bits of a filter of fixed size. It only spares work: a seed that
   passes wrongly is found unrepeated below.
2. Equal paths are compacted to one, with the first document (smallest id) and the last that has it.
3. Where the paths of a seed differ, the walk branches there: their windows are joined one by one,
   and a path learns which of its windows occur in an earlier document.
4. Source coordinates of paths meet the compacted paths by a join; a document's windows that start
   in an earlier document are the spans to remove.

A path carries at most ``PATH`` windows, and every step before the last moves hashes, not texts. A passage
that a third of all documents share is one path; its coordinates are rows of their own.

Hashes of windows and paths have 64 bits.

Defined results: windows are judged on the input. Texts with fewer than ``WINDOW`` words, null and empty
texts lose nothing. Windows of one document, or of rows with the same id, do not remove each other.
Rows with a null id take no part and stay whole. Repeated rows get equal results. Empty tables
give no rows. Input columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslane.llm.shared import FILTER_BITS, bit_filter, held, in_filter, lists, ready, row_key, row_of, stored, struct_udf
from corpuslane.llm.words import SPACED, Words, mix, pieces, signed, split

WINDOW = 13
SEED = 5
PATH = 16
PACKET = 1 << 16
BUCKET_SEEDS = 1 << 20


def windows(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, hash and seed of every window."""
    at, gram = words.grams(WINDOW)
    start, small = words.grams(SEED)
    if not len(at):
        return at, gram, gram
    seeds = np.full(len(words.hash), np.iinfo(np.uint64).max, np.uint64)
    seeds[start] = small
    least = seeds[at]
    for j in range(1, WINDOW - SEED + 1):
        np.minimum(least, seeds[at + j], out=least)
    return at, gram, least


def packed_seeds(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Distinct seeds of each batch by bucket, packed, those of two or more of its documents apart."""
    for batch in batches:
        found: list[np.ndarray] = []
        for piece in pieces(batch, "text"):
            words = split(piece.column("text"), SPACED, fold=False)
            at, _, seed = windows(words)
            owner = words.text[at]
            new = np.ones(len(at), bool)
            new[1:] = (seed[1:] != seed[:-1]) | (owner[1:] != owner[:-1])
            ids = np.asarray(piece.column("rk"))[owner[new]]
            own = seed[new]
            order = np.lexsort((ids, own))
            own, ids = own[order], ids[order]
            found.append(own[np.r_[True, (own[1:] != own[:-1]) | (ids[1:] != ids[:-1])]] if len(own) else own)
        if not found:
            continue
        seed, times = np.unique(np.concatenate(found), return_counts=True)
        for many in (False, True):
            own = seed[(times > 1) == many]
            place = (own >> np.uint64(40)) % np.uint64(buckets)
            order = np.argsort(place, kind="stable")
            own, place = own[order], place[order]
            heads = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(own) else np.empty(0, np.int64)
            parts = [own[a:b].tobytes() for a, b in zip(heads, np.r_[heads[1:], len(own)])]
            yield pa.record_batch([pa.array(signed(place[heads])), pa.array([many] * len(heads), pa.bool_()), pa.array(parts, pa.binary())], ["bucket", "many", "seeds"])


def seen_twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Seeds of a bucket that come from two packets, or from one marked so; rows come sorted by bucket."""
    now, once, many = None, [], []

    def close() -> Iterator[pa.RecordBatch]:
        own = np.sort(np.concatenate(once)) if once else np.empty(0, np.uint64)
        twice = np.unique(own[1:][own[1:] == own[:-1]])
        marked = np.unique(np.concatenate(many)) if many else np.empty(0, np.uint64)
        both = np.union1d(twice, marked)
        for a in range(0, len(both), PACKET):
            yield pa.record_batch([pa.array(signed(both[a : a + PACKET]))], ["seed"])

    for batch in batches:
        for bucket, flag, seeds in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if bucket != now:
                yield from close()
                now, once, many = bucket, [], []
            (many if flag else once).append(np.frombuffer(seeds.as_buffer(), np.uint64))
    yield from close()


def paths(words: Words, bitmap: np.ndarray) -> tuple[np.ndarray, ...]:
    """Paths of windows whose seed passes the filter: first word, seed, hash, and window hashes by ``upto``."""
    at, gram, seed = windows(words)
    keep = held(bitmap, seed)
    at, gram, seed = at[keep], gram[keep], seed[keep]
    if not len(at):
        return at, seed, gram, gram, np.zeros(1, np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (seed[1:] != seed[:-1]) | (at[1:] != at[:-1] + 1) | (words.text[at[1:]] != words.text[at[:-1]])
    heads = np.flatnonzero(new)
    since = np.arange(len(at)) - np.repeat(heads, np.diff(np.r_[heads, len(at)]))
    heads = np.flatnonzero(since % PATH == 0)
    upto = np.r_[heads, len(at)]
    size = np.diff(upto)
    spot = np.arange(len(at)) - np.repeat(heads, size)
    whole = np.add.reduceat(mix(gram + (spot + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), heads)
    return at[heads], seed[heads], mix(whole + size.astype(np.uint64)), gram, upto


def removals(docs: DataFrame) -> DataFrame:
    """(id, rk, spans): starts of the windows to remove, from documents (id, rk, text)."""
    docs = docs.where("id IS NOT NULL")
    total = docs.count()
    # about as many buckets as their seeds need to stay small
    buckets = max(1, total * 256 // BUCKET_SEEDS)
    packets = docs.select("rk", "text").mapInArrow(lambda b: packed_seeds(b, buckets), "bucket long, many boolean, seeds binary")
    twice = packets.repartition(F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(seen_twice, "seed long")
    bitmap = bit_filter(twice, "seed", FILTER_BITS)
    kind = dict(docs.dtypes)["id"]

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                words = split(piece.column("text"), SPACED, fold=False)
                at, seed, path, gram, upto = paths(words, bitmap.value)
                ids = np.asarray(piece.column("id"))[words.text[at]]
                # a batch sends each path once, with its first and last document
                order = np.lexsort((ids, path))
                path, ids, seed = path[order], ids[order], seed[order]
                first = np.flatnonzero(np.r_[True, path[1:] != path[:-1]]) if len(path) else np.empty(0, np.int64)
                last = (np.r_[first[1:], len(path)] - 1)[: len(first)]
                size, start = np.diff(upto)[order][first], upto[:-1][order][first]
                take = np.repeat(start - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum()) if len(first) else np.empty(0, np.int64)
                yield pa.record_batch([pa.array(signed(path[first])), pa.array(signed(seed[first])), pa.array(ids[first]), pa.array(ids[last]), lists(size, pa.array(signed(gram[take])))], ["path", "seed", "first", "last", "grams"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                words = split(piece.column("text"), SPACED, fold=False)
                at, _, path, _, upto = paths(words, bitmap.value)
                owner = words.text[at]
                ids, rk = np.asarray(piece.column("id")), np.asarray(piece.column("rk"))
                yield pa.record_batch([pa.array(ids[owner]), pa.array(rk[owner]), pa.array(signed(path)), pa.array((at - words.first[owner]).astype(np.int32)), pa.array(np.diff(upto).astype(np.int32))], ["id", "rk", "path", "at", "size"])

    text = docs.select("id", "rk", "text")
    sent = text.mapInArrow(known, f"path long, seed long, first {kind}, last {kind}, grams array<long>")
    compact = sent.groupBy("path").agg(F.first("seed").alias("seed"), F.min("first").alias("first"), F.max("last").alias("last"), F.first("grams").alias("grams"))
    compact = stored(compact, "paths")
    branching = stored(compact.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("seed"), "branching")
    forks = in_filter(bit_filter(branching, "seed"))
    edges = compact.where(forks(F.col("seed"))).join(branching, "seed", "left_semi").select("path", "first", F.posexplode("grams").alias("spot", "edge"))
    origin = edges.groupBy("edge").agg(F.min("first").alias("origin"), F.count(F.lit(1)).alias("n")).where("n > 1").select("edge", "origin")
    earlier = edges.join(origin, "edge").where("origin < first").groupBy("path").agg(F.collect_list(F.struct("spot", "origin")).alias("earlier"))
    repeated = compact.drop("grams", "seed").join(earlier, "path", "left").where("last > first OR earlier IS NOT NULL")
    met = text.mapInArrow(places, f"id {kind}, rk long, path long, at int, size int").join(repeated, "path")
    # bit k of the mask: the path's window k starts in an earlier document
    partly = F.coalesce(F.aggregate("earlier", F.lit(0), lambda m, e: F.when(e["origin"] < F.col("id"), m.bitwiseOR(F.call_function("shiftleft", F.lit(1), e["spot"]))).otherwise(m)), F.lit(0))
    mask = F.when(F.col("id") > F.col("first"), F.call_function("shiftleft", F.lit(1), F.col("size")) - 1).otherwise(partly)
    met = met.select("id", "rk", "at", mask.alias("mask")).where("mask <> 0")
    return met.groupBy("id", "rk").agg(F.collect_set(F.struct("at", "mask")).alias("spans"))


def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Word counts, kept words joined by one space, and removed spans of words of each text."""
    words = split(texts, SPACED, fold=False)
    gone = np.zeros(len(words.hash), bool)
    owner = np.repeat(np.arange(len(texts)), np.asarray(spans.value_lengths().fill_null(0)).astype(np.int64))
    flat = spans.flatten()
    if len(flat):
        at = np.asarray(flat.field("at")) + words.first[owner]
        mask = np.asarray(flat.field("mask"))
        for k in range(PATH):
            start = at[(mask >> k) & 1 > 0] + k
            for j in range(WINDOW):
                gone[start + j] = True
    removed = np.bincount(words.text[gone], minlength=len(texts))[: len(texts)]
    kept = []
    for i in range(len(texts)):
        a, b = words.first[i], words.first[i] + words.counts[i]
        stay = np.flatnonzero(~gone[a:b]) + a
        kept.append(_joined(words, stay))
    return pa.StructArray.from_arrays([pa.array(words.counts.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(kept, pa.binary()).cast(pa.string())], ["n_words", "n_removed", "kept_text"])


def _joined(words: Words, which: np.ndarray) -> bytes:
    """The given words of one text, joined by one space."""
    if not len(which):
        return b""
    start, end = words.start[which], words.end[which]
    size = end - start + 1
    take = np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)
    ends = np.cumsum(size) - 1
    take[ends] = 0
    out = words.data[take]
    out[ends] = 32
    return out[:-1].tobytes()


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept_text``."""
    ready(docs.sparkSession)
    slim = docs.select(F.col(doc_id).alias("id"), row_key(F.col(doc_id), F.col(text)).alias("rk"), F.col(text).alias("text"))
    found = stored(removals(slim).select(F.col("id").alias("_id"), F.col("rk").alias("_rk"), "spans"), "removals")
    row = row_of(docs, "n_words", "n_removed", "kept_text")
    keyed = docs.select(row, F.col(doc_id).alias("_doc"), F.col(text).alias("_text"), row_key(F.col(doc_id), F.col(text)).alias("_key"))
    # only texts that lose words meet their spans; the others stay where they are read
    loses = in_filter(bit_filter(found, "_rk"))(F.col("_key"))
    cut_ones = keyed.where(loses).join(found, (F.col("_doc") == F.col("_id")) & (F.col("_key") == F.col("_rk")), "left")
    columns = ("_row", "_text", "spans")
    kind = found.schema["spans"].dataType
    out = cut_ones.select(*columns).unionByName(keyed.where(~loses).withColumn("spans", F.lit(None).cast(kind)).select(*columns))

    def run(texts: pa.Array, spans: pa.Array) -> pa.Array:
        batch = pa.record_batch([texts, spans], ["t", "s"])
        parts = [cut(p.column(0), p.column(1)) for p in pieces(batch, "t")]
        return pa.concat_arrays(parts) if parts else cut(texts, spans)

    out = out.withColumn("_cut", struct_udf(run, "n_words long, n_removed long, kept_text string")(F.col("_text"), F.col("spans")))
    return out.select("_row.*", "_cut.*")
