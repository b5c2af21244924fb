"""Near duplicates by MinHash with tensored banding, links confirmed on full shingle sets.

Instead of separate hashes for each table, ``POOL`` small collections of minhashes are drawn
once and every pair of collections makes a table key: POOL * (POOL - 1) / 2 tables from POOL
collections. Two sets meet if any two collections agree; at a similarity of 0.75 and ten
collections of one hash all tables fail with probability 3e-5.

1. Rows with the same shingle set are one class; copies never multiply.
2. In each bucket the classes are linked to the bucket's smallest class, if that holds on the
   full sets; components of these links follow.
3. Pairs inside a bucket that lie in different components by then are still open. Those of a bucket of up to
   ``LISTED`` members are listed, screened by size and minhashes, and confirmed on the full sets.
4. Members of larger buckets bring their sets along: those outside a bucket's largest component meet each
   other and that component's members, in tiles of ``TILE``, and a task hands on only the links it
   confirmed there. Buckets with the same largest component are laid out once. So no bucket is capped, no
   pairs of a large group leave a task, and a group of near copies costs its size times the
   members that are not connected, not its square.

A pair of similarity 0.75 agrees in fewer than ``SCREEN_LEAST`` of ``SCREEN`` minhashes with
probability 4e-6.

Defined results: words are runs of non-blank bytes, A-Z lower-cased; a set holds the distinct 5-word
shingles, or the whole sequence if shorter. A text without words has an empty set and is linked with nothing; null
texts likewise. Rows with a null id are linked, but a component's id is the smallest non-null
one; a component of null ids only has none, and its rows are kept. Rows equal in id are one document: they stay or go together.
``one_each`` goes by rows: one stays of each component, whatever its ids.
Empty tables give no rows. Input columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslane.llm.components import components
from corpuslane.llm.shared import bit_filter, held, in_filter, ready, row_key, row_of, stored, struct_udf
from corpuslane.llm.words import SPACED, mix, pieces, signed, split

SHINGLE = 5
PERCENT = 75
POOL = 10
SCREEN = 32
SCREEN_LEAST = 13
LISTED = 64
TILE = 256
#: Number of the table of each pair of collections.
TABLES = {pair: t for t, pair in enumerate(combinations(range(POOL), 2))}
_TABLE = np.zeros((POOL, POOL), np.int64)
for (_i, _j), _t in TABLES.items():
    _TABLE[_i, _j] = _t

_rng = np.random.default_rng(77)
_MUL = _rng.integers(1, 1 << 63, SCREEN, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(1, 1 << 63, SCREEN, dtype=np.uint64)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts one after the other, and how many each has."""
    words = split(texts, SPACED, fold=True)
    n = len(texts)
    at, grams = words.grams(SHINGLE)
    owner = words.text[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < SHINGLE))
    if len(short):
        owner = np.concatenate([owner, short])
        grams = np.concatenate([grams, words.whole(short)])
        order = np.argsort(owner, kind="stable")
        owner, grams = owner[order], grams[order]
    upto = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n)[:n])])
    for a, b in zip(upto[:-1], upto[1:]):
        grams[a:b].sort()
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[new], np.bincount(owner[new], minlength=n)[:n]


def sketch(texts: pa.Array) -> pa.Array:
    """Set size, 128-bit digest of the set, and ``SCREEN`` minhashes of each text."""
    grams, counts = shingle_sets(texts)
    some = counts > 0
    heads = (np.cumsum(counts) - counts)[some]
    digests = np.zeros((2, len(counts)), np.uint64)
    hashes = np.zeros((len(counts), SCREEN), np.uint32)
    if len(heads):
        digests[0, some] = np.add.reduceat(mix(grams), heads)
        digests[1, some] = np.add.reduceat(mix(grams ^ _ADD[0]), heads)
        for k in range(SCREEN):
            hashes[some, k] = np.minimum.reduceat((grams * _MUL[k] + _ADD[k]) >> np.uint64(32), heads)
    rows = [hashes[i].tobytes() for i in range(len(counts))]
    return pa.StructArray.from_arrays([pa.array(counts.astype(np.int64)), pa.array(signed(digests[0])), pa.array(signed(digests[1])), pa.array(rows, pa.binary())], ["n", "d1", "d2", "sig"])


def _sketches(column: pa.Array) -> pa.Array:
    parts = [sketch(p.column(0)) for p in pieces(pa.record_batch([column], ["t"]), "t")]
    return pa.concat_arrays(parts) if parts else sketch(column)


def signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, SCREEN)


def table_keys(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """One key for each pair of collections, its table in the last six bits: (key, node)."""
    for batch in batches:
        sig = signatures(batch.column(1)).astype(np.uint64)
        node = np.asarray(batch.column(0))
        for (i, j), t in TABLES.items():
            key = mix((sig[:, i] << np.uint64(32) | sig[:, j]) + mix(np.full(1, t, np.uint64))) & ~np.uint64(63) | np.uint64(t)
            keep = held(bitmap, mix(key)) if bitmap is not None else slice(None)
            yield pa.record_batch([pa.array(signed(key[keep])), pa.array(node[keep])], ["key", "node"])


def similar(left: pa.Array, right: pa.Array) -> pa.Array:
    """Whether two sets, as sorted 64-bit values, are alike enough."""
    out = []
    for a, b in zip(left, right):
        x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
        if len(x) > len(y):
            x, y = y, x
        at = np.searchsorted(y, x)
        same = int((y[np.minimum(at, len(y) - 1)] == x).sum())
        out.append(100 * same >= PERCENT * (len(x) + len(y) - same))
    return pa.array(out, pa.bool_())


def agreeing(left: pa.Array, right: pa.Array) -> pa.Array:
    return pa.array((signatures(left) == signatures(right)).sum(axis=1) >= SCREEN_LEAST)


def runs(batches: Iterator[pa.RecordBatch], column: str, use: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """``use`` on tables that hold every run of equal values whole; rows come sorted by ``column``."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        value = batch.column(column).to_numpy()
        if not len(value):
            continue
        other = np.flatnonzero(value != value[-1])
        before = len(waiting) and waiting[-1].column(column)[-1].as_py() != value[0]
        if len(other) or before:
            cut = int(other[-1]) + 1 if len(other) else 0
            yield from use(pa.Table.from_batches([*waiting, batch.slice(0, cut)]).combine_chunks())
            waiting, batch = [], batch.slice(cut)
        waiting.append(batch)
    if waiting:
        yield from use(pa.Table.from_batches(waiting).combine_chunks())


def open_pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Screened pairs of different components inside each run of one ``key``, each in the first of the tables that
    both are in."""
    key, node, comp, n = (rows.column(c).to_numpy() for c in ("key", "node", "comp", "n"))
    if not len(key):
        return
    sig = signatures(rows.column("sig").combine_chunks())
    left = np.arange(len(key))
    lag = 0
    while len(left):
        lag += 1
        left = left[left + lag < len(key)]
        left = left[key[left] == key[left + lag]]
        right = left + lag
        small, large = np.minimum(n[left], n[right]), np.maximum(n[left], n[right])
        ok = (comp[left] != comp[right]) & (100 * small >= PERCENT * large)
        a, b = left[ok], right[ok]
        if len(a):
            same = sig[a] == sig[b]
            pool = same[:, :POOL].copy()
            first = pool.argmax(axis=1)
            pool[np.arange(len(pool)), first] = False
            good = (same.sum(axis=1) >= SCREEN_LEAST) & (_TABLE[first, pool.argmax(axis=1)] == key[a] & 63)
            a, b = node[a[good]], node[b[good]]
            yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def tile_links(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Confirmed links inside each run of one ``cell`` that connect different components of it.

    Members outside the largest component look at all others; what is connected already is not looked at again.
    """
    cell = rows.column("cell").to_numpy()
    if not len(cell):
        return
    heads = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    for a, b in zip(heads, np.r_[heads[1:], len(cell)]):
        part = rows.slice(a, b - a).combine_chunks()
        node, n, outside = (part.column(c).to_numpy() for c in ("node", "n", "outside"))
        comp = np.unique(part.column("comp").to_numpy(), return_inverse=True)[1]
        sig = signatures(part.column("sig").combine_chunks())
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in part.column("grams").combine_chunks()]
        size = np.array([len(x) for x in sets])
        starts = np.cumsum(size) - size
        values, place = np.unique(np.concatenate(sets), return_inverse=True)
        mark = np.zeros(len(values), bool)
        out = []
        for i in np.flatnonzero(outside):
            other = (comp != comp[i]) & (100 * np.minimum(n, n[i]) >= PERCENT * np.maximum(n, n[i]))
            other = np.flatnonzero(other)
            other = other[(sig[other] == sig[i]).sum(axis=1) >= SCREEN_LEAST]
            if not len(other):
                continue
            own = place[starts[i] : starts[i] + size[i]]
            mark[own] = True
            same = np.add.reduceat(mark[place], starts, dtype=np.int64)[other]
            mark[own] = False
            for j in other[100 * same >= PERCENT * (size[i] + size[other] - same)]:
                if comp[j] != comp[i]:
                    out.append((node[i], node[j]))
                    comp[comp == comp[j]] = comp[i]
        if out:
            a_, b_ = (np.array(x) for x in zip(*out))
            yield pa.record_batch([pa.array(np.minimum(a_, b_)), pa.array(np.maximum(a_, b_))], ["a", "b"])


def full_sets(nodes: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, grams): the whole shingle set of each given class, from its first row's text."""
    wanted = stored(classes.join(nodes, "node", "left_semi").select("node", F.col("id").alias("_id"), F.col("rk").alias("_rk")), "wanted")
    bitmap = bit_filter(wanted, "_rk")
    inside = in_filter(bitmap)

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                grams, counts = shingle_sets(piece.column("text"))
                upto = np.concatenate([[0], np.cumsum(counts)])
                sets = [grams[a:b].tobytes() for a, b in zip(upto[:-1], upto[1:])]
                yield pa.record_batch([piece.column("id"), piece.column("rk"), pa.array(sets, pa.binary())], ["id", "rk", "grams"])

    some = docs.where(inside(F.col("rk"))).select("id", "rk", "text")
    kind = dict(docs.dtypes)["id"]
    sets = some.mapInArrow(full, f"id {kind}, rk long, grams binary")
    sets = sets.join(wanted, (F.col("rk") == F.col("_rk")) & F.col("id").eqNullSafe(F.col("_id")))
    # a class's row may be repeated; its sets are equal
    return stored(sets.groupBy("node").agg(F.first("grams").alias("grams")), "sets")


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose full sets (node, grams) are alike enough."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("_x")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("_y")), "b")
    alike = F.arrow_udf(similar, returnType="boolean")
    return both.where(alike("_x", "_y")).select("a", "b")


def classes_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (id, rk, n, d1, d2) and classes (node, id, rk, n, d1, d2, min_id, sig), both written."""
    found = docs.withColumn("_s", struct_udf(_sketches, "n long, d1 long, d2 long, sig binary")(F.col("text")))
    rows = stored(found.select("id", "rk", "_s.*"), "sketches")
    own = F.struct("id", "rk")
    groups = rows.where("n > 0").groupBy("d1", "d2").agg(F.first("n").alias("n"), F.min("id").alias("min_id"), F.min(_order("id", "rk")).alias("head"), F.first(own).alias("_own"), F.first("sig").alias("sig"))
    # ids are given once: the table is written and only then read
    numbered = groups.select(F.monotonically_increasing_id().alias("node"), "_own.id", "_own.rk", "n", "d1", "d2", "min_id", "head", "sig")
    return rows, stored(numbered, "classes")


def links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, component) of every class that is linked and not its component's root."""
    sigs = classes.select("node", "sig")
    keys = sigs.mapInArrow(table_keys, "key long, node long")
    buckets = stored(keys.groupBy("key").agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
    shared = bit_filter(buckets.select(_mixed(F.col("key")).alias("key")), "key")
    some = sigs.mapInArrow(lambda batches: table_keys(batches, shared.value), "key long, node long")
    members = stored(some.join(buckets, "key"), "members")

    sides = classes.select("node", "n", "sig")
    stars = members.where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b")).distinct()
    stars = stars.join(sides.toDF("a", "_na", "_sa"), "a").join(sides.toDF("b", "_nb", "_sb"), "b")
    near = F.arrow_udf(agreeing, returnType="boolean")
    stars = stars.where(100 * F.least("_na", "_nb") >= PERCENT * F.greatest("_na", "_nb")).where(near("_sa", "_sb"))
    stars = stored(stars.select("a", "b"), "stars")
    first = stored(confirmed(stars, full_sets(ends(stars).distinct(), docs, classes)), "links")
    joined = components(first)

    labelled = members.join(joined, "node", "left").select("key", "node", "size", F.coalesce("component", "node").alias("comp"))
    labelled = stored(labelled, "labelled")
    mixed = labelled.where(f"size <= {LISTED}").groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
    cells = labelled.join(mixed, "key", "left_semi").join(sides, "node").select("key", "node", "comp", "n", "sig")
    opened = cells.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(lambda b: runs(b, "key", open_pairs), "a long, b long")
    opened = stored(opened.distinct().join(stars, ["a", "b"], "left_anti"), "open-pairs")
    large = labelled.where(f"size > {LISTED}")
    parts = large.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m"))
    main = parts.groupBy("key").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("key", "main")
    laid = stored(large.join(main, "key").select("main", "node", "comp").distinct(), "laid")
    out = F.col("comp") != F.col("main")
    counts = laid.groupBy("main").agg(F.ceil(F.count(F.when(out, 1)) / TILE).alias("tu"), F.ceil(F.count(F.when(~out, 1)) / TILE).alias("tl"))
    spot = F.xxhash64("node")
    cells = laid.join(counts, "main").withColumn("t", F.when(out, F.pmod(spot, F.col("tu"))).otherwise(F.col("tu") + F.pmod(spot, F.col("tl"))))
    cells = cells.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.when(out, F.col("tu") + F.col("tl")).otherwise(F.col("tu")) - 1)))
    cells = cells.select(F.xxhash64("main", F.least("s", "t"), F.greatest("s", "t")).alias("cell"), "node", "comp", out.alias("outside"))
    sets = full_sets(ends(opened).unionByName(laid.select("node")).distinct(), docs, classes)
    second = confirmed(opened, sets)
    cells = cells.join(sides, "node").join(sets, "node")
    third = cells.repartition(F.col("cell")).sortWithinPartitions("cell").mapInArrow(lambda b: runs(b, "cell", tile_links), "a long, b long")
    return components(first.unionByName(second).unionByName(third))


def _mixed(key: Column) -> Column:
    """Keys as the bit filter sees them: their last bits only name the table."""
    return F.arrow_udf(lambda k: pa.array(signed(mix(np.asarray(k).view(np.uint64)))), returnType="long")(key)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``n_shingles``, ``component_id`` and ``kept`` (true for one id of each component).

    ``first`` is true for one document of each component, null ids and differing texts of one id included, and
    ``copies`` counts its repeated rows.
    """
    outputs = ("n_shingles", "component_id", "kept", "first", "copies")
    ready(docs.sparkSession)
    key = row_key(F.col(doc_id), F.col(text))
    slim = docs.select(F.col(doc_id).alias("id"), key.alias("rk"), F.col(text).alias("text"))
    rows, classes = classes_of(slim)
    linked = links(slim, classes)
    named = classes.select("node", "d1", "d2", "min_id", "head").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    roots = named.groupBy("component").agg(F.min("min_id").alias("component_id"), F.min("head").alias("head"))
    named = named.drop("head").join(roots, "component").select("d1", "d2", "component_id", "head")
    found = rows.groupBy("id", "rk", "n", "d1", "d2").agg(F.count("*").alias("copies")).join(named, ["d1", "d2"], "left")
    some = F.col("n") > 0
    found = found.select(
        F.col("id").alias("_id"), F.col("rk").alias("_rk"), F.col("n").alias("n_shingles"), "copies",
        F.when(some, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        (~some | (F.col("head") == _order("id", "rk"))).alias("first"),
    )
    keyed = docs.select(row_of(docs, *outputs), F.col(doc_id).alias("_doc"), key.alias("_key"))
    out = keyed.join(found, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_rk")))
    return out.select("_row.*", "n_shingles", "component_id", F.col("_doc").eqNullSafe(F.col("component_id")).alias("kept"), "first", "copies")


def _order(doc_id: str, key: str) -> Column:
    """Rows of a component in order: by id, null last, then by key."""
    return F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col(key).alias("rk"))


def one_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component, and of each document without words; repeated rows count as one."""
    found = near_duplicates(docs, doc_id, text).where("first")
    # rows that stand more than once are few; the others are not shuffled again
    single = found.where("copies = 1")
    return single.unionByName(found.where("copies > 1").dropDuplicates([doc_id, text])).select(*docs.columns)
