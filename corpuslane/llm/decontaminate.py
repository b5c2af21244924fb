"""Benchmark decontamination by winnowing.

Of every ``WINDOW - GRAM + 1`` neighbouring k-grams the one with the least hash is kept, in
documents and items alike, so any run of ``WINDOW`` shared words has a kept k-gram of the same hash inside
it on both sides. Fingerprints meet in a join, and each hit is extended word by word to both
sides; a run of at least ``WINDOW`` equal words is a hit span. Every shared run is found, since each of
its windows holds a fingerprint whose extension covers that window.

Items shorter than a window have no full window: their whole word sequence is one, found by
the hash of all document runs of that length.

A fingerprint carries the hashes of the words that an extension can reach, so texts
do not travel. Before the join, document fingerprints pass a bit filter of the benchmark's, of fixed size.
Items are copied to ``SALTS`` places, since one passage may be in a third of all documents.

Words are runs of ASCII letters, digits and any non-ASCII character, A-Z lower-cased.

Defined results: null and empty texts have no words and no hits; null item ids are not
reported, though their words count as hit. Rows equal in id and text share one result, given for each
of them. Empty tables give no hits or no rows. Input columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslane.llm.shared import bit_filter, held, lists, ready, row_key, row_of, stored, struct_udf
from corpuslane.llm.words import ALNUM, pieces, signed, split

WINDOW = 10
GRAM = 6
SALTS = 16
REACH = WINDOW - GRAM
#: A place before the first or after the last word of a text.
OUTSIDE = np.uint64(0)

MARKS = "array<struct<at: int, len: int, fp: long, around: array<long>>>"


def winnow(words) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every k-gram that is least in one of its windows; ties all stay."""
    at, gram = words.grams(GRAM)
    if not len(at):
        return at, gram
    text = words.text[at]
    width = REACH + 1
    least = np.full(len(gram), np.iinfo(np.uint64).max, np.uint64)
    size = len(gram) - width + 1
    kept = np.zeros(len(gram), bool)
    if size > 0:
        low = gram[:size].copy()
        for j in range(1, width):
            np.minimum(low, gram[j : j + size], out=low)
        low[text[:size] != text[width - 1 :]] = least[0]
        for j in range(width):
            kept[j : j + size] |= gram[j : j + size] == low
    return at[kept], gram[kept]


def around(words, at: np.ndarray) -> np.ndarray:
    """Hashes of the words from REACH before to REACH after each k-gram."""
    place = at[:, None] + np.arange(-REACH, GRAM + REACH)
    inside = np.clip(place, 0, len(words.hash) - 1)
    same = (place == inside) & (words.text[inside] == words.text[at][:, None])
    return np.where(same, words.hash[inside] | np.uint64(1), OUTSIDE)


def marks(texts: pa.Array, lengths: tuple[int, ...], bitmap: np.ndarray | None, items: bool) -> pa.Array:
    """Word count and fingerprints of each text: winnowed k-grams, and whole short runs.

    Of an item with fewer words than a window only the whole sequence is kept; of a document, all
    runs of the given ``lengths``.
    """
    words = split(texts, ALNUM, fold=True)
    n = len(texts)
    found = []
    for size, (at, hashes) in [(GRAM, winnow(words)), *((m, words.grams(m)) for m in lengths)]:
        keep = held(bitmap, hashes) if bitmap is not None else np.ones(len(at), bool)
        if items:
            count = words.counts[words.text[at]]
            keep &= count >= WINDOW if size == GRAM and not found else count == size
        at, hashes = at[keep], hashes[keep]
        found.append((at, hashes, np.full(len(at), WINDOW if not found else size)))
    at, hashes, size = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(at, kind="stable")
    at, hashes, size = at[order], hashes[order], size[order]
    owner = words.text[at]
    near = around(words, at) if len(at) else np.empty((0, WINDOW + REACH), np.uint64)
    near[size < WINDOW] = OUTSIDE
    rows = pa.StructArray.from_arrays(
        [
            pa.array((at - words.first[owner]).astype(np.int32)),
            pa.array(size.astype(np.int32)),
            pa.array(signed(hashes)),
            lists(np.full(len(at), WINDOW + REACH), pa.array(signed(near.ravel()))),
        ],
        ["at", "len", "fp", "around"],
    )
    return pa.StructArray.from_arrays([pa.array(words.counts), lists(np.bincount(owner, minlength=n)[:n], rows)], ["n_words", "marks"])


def _marked(df: DataFrame, text: str, lengths, bitmap, items: bool) -> DataFrame:
    def run(column: pa.Array) -> pa.Array:
        parts = [marks(p.column(0), lengths, bitmap.value if bitmap else None, items) for p in pieces(pa.record_batch([column], ["t"]), "t")]
        return pa.chunked_array(parts, type=parts[0].type if parts else None).combine_chunks() if parts else marks(column, lengths, None, items)

    ready(df.sparkSession)
    return df.withColumn("_m", struct_udf(run, f"n_words long, marks {MARKS}")(F.col(text)))


def extended(mine: Column, theirs: Column) -> tuple[Column, Column]:
    """How many words before and after a k-gram agree, none beyond either text's end."""

    def run(places: list[int]) -> Column:
        agree, total = F.lit(True), F.lit(0)
        for p in places:
            agree = agree & (mine[p] == theirs[p]) & (mine[p] != 0)
            total = total + agree.cast("int")
        return total

    return run(list(range(REACH - 1, -1, -1))), run(list(range(REACH + GRAM, REACH + GRAM + REACH)))


def hits(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id") -> DataFrame:
    """One row for each distinct id and text: (id, rk, n_words, spans, items).

    ``spans`` are the disjoint hit spans (first word, word after the last) in order, ``items`` the ids found.
    """
    lengths = tuple(range(1, WINDOW))
    theirs = _marked(items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")), "text", lengths, None, True)
    theirs = stored(theirs.select("item_id", F.explode("_m.marks").alias("m")).select("item_id", "m.*").distinct(), "benchmark-marks")
    bitmap = bit_filter(theirs, "fp")
    # only lengths that some short item has; at most WINDOW - 1 of them
    short = tuple(sorted(r[0] for r in theirs.where(F.col("len") < WINDOW).select("len").distinct().collect()))
    own = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).withColumn("rk", row_key(F.col("id"), F.col("text")))
    own = _marked(own, "text", short, bitmap, False)
    own = stored(own.select("id", "rk", "_m.n_words", "_m.marks"), "document-marks")

    salt = F.pmod(F.col("rk"), F.lit(SALTS)).cast("int")
    seen = own.select("id", "rk", F.explode("marks").alias("m")).select("id", "rk", "m.*", salt.alias("salt"))
    spread = theirs.select("item_id", F.col("len").alias("_len"), F.col("fp").alias("_fp"), F.col("around").alias("_around"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    met = seen.join(spread, (F.col("fp") == F.col("_fp")) & (F.col("len") == F.col("_len")) & (F.col("salt") == F.col("_salt")))
    left, right = extended(F.col("around"), F.col("_around"))
    core = F.lit(True)
    for p in range(REACH, REACH + GRAM):
        core = core & (F.col("around")[p] == F.col("_around")[p])
    whole = F.col("len") < WINDOW
    met = met.withColumn("_l", F.when(whole, F.lit(0)).otherwise(left)).withColumn("_r", F.when(whole, F.lit(0)).otherwise(right))
    met = met.where(whole | (core & (F.col("_l") + F.col("_r") >= REACH)))
    span = F.struct((F.col("at") - F.col("_l")).alias("a"), (F.col("at") + F.when(whole, F.col("len")).otherwise(F.lit(GRAM)) + F.col("_r")).alias("b"))
    # one row for each document and item first: a document's spans are bounded by its length
    each = met.groupBy("id", "rk").agg(F.collect_set(span).alias("s"), F.collect_set("item_id").alias("items"))
    each = each.select(F.col("id").alias("_id"), F.col("rk").alias("_rk"), union_spans("s").alias("spans"), "items")
    out = own.select("id", "rk", "n_words").distinct().join(each, F.col("id").eqNullSafe(F.col("_id")) & (F.col("rk") == F.col("_rk")), "left")
    return out.select("id", "rk", "n_words", "spans", "items")


def union_spans(column: str) -> Column:
    """Sorted spans merged where they touch or overlap."""
    return F.expr(
        f"""aggregate(array_sort({column}), CAST(array() AS ARRAY<STRUCT<a: INT, b: INT>>),
        (m, s) -> CASE WHEN size(m) > 0 AND element_at(m, -1).b >= s.a
          THEN array_append(slice(m, 1, size(m) - 1), named_struct('a', element_at(m, -1).a, 'b', greatest(element_at(m, -1).b, s.b)))
          ELSE array_append(m, s) END)"""
    )


def decontaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id") -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``spans`` and ``items``; a clean row has none."""
    found = hits(docs, items, doc_id, text, item_id).withColumnRenamed("id", "_id").withColumnRenamed("rk", "_rk")
    keyed = docs.select(row_of(docs, "n_words", "n_hit", "spans", "items"), F.col(doc_id).alias("_doc"), row_key(F.col(doc_id), F.col(text)).alias("_key"))
    out = keyed.join(found, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_rk")))
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0), lambda n, s: n + s["b"] - s["a"]), F.lit(0)).cast("long")
    return out.select("_row.*", "n_words", n_hit.alias("n_hit"), "spans", "items")
