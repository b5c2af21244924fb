"""Prefix trie of conversations, with subtree totals by tree contraction.

Turns are numbered by one range-partitioned sort. Each task keeps running prefix hashes of its turns, and what spans
a task border is added from one row per task, so a conversation of any length is spread over tasks. A prefix
hash is ``sum(H(turn i) * B^i)`` modulo 2^64 in two lanes: it does not depend on how rows are cut, and the hash of a
rebuilt conversation (a shared opening, then its own turns) follows from the two it is made of. Nodes are groups of
equal (depth, hash); a node is named by its smallest member and its depth. Totals come from
``contraction.subtree_sums``. Texts do not move: only hashes and lengths do.

Defined results: a null conv_id is no conversation. Null role or text reads as empty; a null turn comes first.
Equal turns are ordered by a hash of role and text, so repeated rows are turns of their own. The hundreds of negative ids
are counted downward (-3 belongs to -100). An empty table gives no row.
Only the four columns are read, so others cannot clash. The text of ends is streamed in
sorted runs through the digest of its node, and never gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslane.llm.contraction import subtree_sums
from corpuslane.llm.shared import ready, stored
from corpuslane.llm.words import signed

OPENING = 5
RUN = 4096
ROWS = 1 << 16
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_BASE = [np.uint64(b) for b in _BASES]
_BACK = [[np.uint64(pow(b, -k, 1 << 64)) for k in range(OPENING + 1)] for b in _BASES]


def _power(lane: int, exponents: np.ndarray) -> np.ndarray:
    """Base to each exponent of at least zero."""
    out, square, left = np.ones(len(exponents), np.uint64), np.uint64(_BASES[lane]), exponents.astype(np.uint64)
    with np.errstate(over="ignore"):
        while left.any():
            out = np.where(left & np.uint64(1), out * square, out)
            square, left = square * square, left >> np.uint64(1)
    return out


def opening_length(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % (OPENING + 1)


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns of one sorted task, numbered from 1 in each conversation with running hashes; and one row more
    (``edge``) with the state of its last conversation."""
    part, last, count, state = TaskContext.get().partitionId(), None, 0, [np.uint64(0), np.uint64(0)]
    names = ["c", "part", "edge", "at", "h0", "h1", "len", "s0", "s1"]
    for batch in batches:
        copies = np.asarray(batch.column("n"))
        upto = np.cumsum(copies)
        for a in range(0, int(upto[-1]) if len(upto) else 0, ROWS):
            which = np.searchsorted(upto, np.arange(a, min(a + ROWS, int(upto[-1]))), side="right")
            c, size = (np.asarray(batch.column(x))[which] for x in ("c", "len"))
            lanes = [np.asarray(batch.column(x)).view(np.uint64)[which] for x in ("h0", "h1")]
            heads = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
            each = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, len(c)]))
            more = c[0] == last
            at = np.arange(len(c)) - heads[each] + 1
            if more:
                at[each == 0] += count
            sums = []
            with np.errstate(over="ignore"):
                for lane in (0, 1):
                    terms = lanes[lane] * _power(lane, at)
                    total = np.cumsum(terms)
                    carry = (total - terms)[heads]
                    if more:
                        carry[0] -= state[lane]
                    sums.append(total - carry[each])
            yield pa.record_batch(
                [pa.array(c), pa.array(np.full(len(c), part)), pa.array(np.zeros(len(c), bool)), pa.array(at), *map(pa.array, map(signed, lanes)), pa.array(size), *map(pa.array, map(signed, sums))],
                names,
            )
            last, count, state = c[-1], int(at[-1]), [s[-1] for s in sums]
    if last is not None:
        zero, own = pa.array([0]), [pa.array(np.array([s]).view(np.int64)) for s in state]
        yield pa.record_batch([pa.array([last]), pa.array([part]), pa.array([True]), pa.array([count]), zero, zero, zero, *own], names)


def numbered(conversations: DataFrame) -> DataFrame:
    """``c``, place ``i`` from 1, turn hashes ``h0 h1``, ``len`` of the text and prefix hashes ``s0 s1``."""
    spark = conversations.sparkSession
    ready(spark)
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("c"), "turn", F.xxhash64(role, text).alias("h0"), F.xxhash64(F.lit(7), text, role).alias("h1"),
        F.char_length(text).cast("long").alias("len"),
    )
    keys = ["c", "turn", "h0", "h1"]
    turns = turns.groupBy(*keys, "len").agg(F.count("*").alias("n"))
    order = [F.col("c"), F.col("turn").asc_nulls_first(), F.col("h0"), F.col("h1")]
    ordered = turns.repartitionByRange(*order).sortWithinPartitions(*order).drop("turn")
    kept = stored(ordered.mapInArrow(_local, "c long, part long, edge boolean, at long, h0 long, h1 long, len long, s0 long, s1 long"), "turns")
    # one row per task
    edges = kept.where("edge").select("c", "part", "at", "s0", "s1").toArrow().sort_by([("c", "ascending"), ("part", "ascending")])
    borders = spark.sparkContext.broadcast(_borders(*[edges.column(k).to_numpy() for k in range(5)]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = borders.value
        for batch in batches:
            c, part, at = (np.asarray(batch.column(x)) for x in ("c", "part", "at"))
            sums = [np.asarray(batch.column(x)).view(np.uint64) for x in ("s0", "s1")]
            spans = np.flatnonzero(np.isin(c, before["c"])) if len(before["c"]) else ()
            if len(spans):
                at, sums = at.copy(), [s.copy() for s in sums]
                for one in np.unique(np.stack([c[spans], part[spans]]), axis=1).T:
                    own = spans[(c[spans] == one[0]) & (part[spans] == one[1])]
                    earlier = np.flatnonzero((before["c"] == one[0]) & (before["part"] < one[1]))
                    if len(earlier):
                        k = earlier[-1]
                        at[own] += before["at"][k]
                        with np.errstate(over="ignore"):
                            for lane in (0, 1):
                                scale = _power(lane, np.array([before["at"][k]]))
                                sums[lane][own] = before[f"s{lane}"][k] + scale * sums[lane][own]
            yield pa.record_batch(
                [batch.column("c"), pa.array(at), batch.column("h0"), batch.column("h1"), batch.column("len"), *map(pa.array, map(signed, sums))],
                ["c", "i", "h0", "h1", "len", "s0", "s1"],
            )

    return kept.where("NOT edge").mapInArrow(place, "c long, i long, h0 long, h1 long, len long, s0 long, s1 long")


def _borders(c: np.ndarray, part: np.ndarray, at: np.ndarray, *sums: np.ndarray) -> dict[str, np.ndarray]:
    """Turns and prefix hashes up to the end of each task, for the conversation that ends it."""
    total, lanes = at.copy(), [s.view(np.uint64).copy() for s in sums]
    with np.errstate(over="ignore"):
        for k in range(1, len(c)):
            if c[k] == c[k - 1]:
                for lane in (0, 1):
                    lanes[lane][k] = lanes[lane][k - 1] + _power(lane, total[k - 1 : k])[0] * lanes[lane][k]
                total[k] += total[k - 1]
    return {"c": c, "part": part, "at": total, "s0": lanes[0], "s1": lanes[1]}


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of a rebuilt prefix and of the one before it."""
    for batch in batches:
        column = {n: np.asarray(batch.column(n)) for n in batch.schema.names}
        out = []
        with np.errstate(over="ignore"):
            for lane in (0, 1):
                s, own, base, h = (column[f"{x}{lane}"].view(np.uint64) for x in ("s", "own", "base", "h"))
                now = base + np.array(_BACK[lane])[column["back"]] * (s - own)
                out.append((now, now - h * _power(lane, column["d"])))
        arrays = [pa.array(signed(x)) for pair in zip(*out) for x in pair]
        yield pa.record_batch([batch.column("c"), batch.column("d"), batch.column("len"), batch.column("last"), *arrays], ["c", "d", "len", "last", "p0", "p1", "q0", "q1"])


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every prefix of at least one turn of every rebuilt conversation: ``c``, depth ``d``, ``len`` of its last text, ``last``
    (it is the whole conversation), its hash ``p0 p1`` and that of the prefix before, ``q0 q1``. And one row per
    conversation with its depth ``total``."""
    turns = numbered(conversations)
    early = F.when(F.col("i") <= OPENING, F.struct("i", "h0", "h1", "len", "s0", "s1"))
    convs = turns.groupBy("c").agg(F.max("i").alias("n"), F.array_sort(F.collect_list(early)).alias("early"))
    convs = stored(convs.withColumn("h", opening_length(F.col("c"))), "conversations")
    bases = convs.select(F.col("c").alias("b"), F.col("early").alias("opening"))
    empty = F.filter("early", lambda x: F.lit(False))
    plan = convs.withColumn("b", F.expr("c - pmod(c, 100)")).join(bases, "b", "left")
    plan = plan.withColumn("opening", F.filter(F.coalesce("opening", empty), lambda x: x["i"] <= F.col("h")))
    plan = plan.withColumn("m", F.size("opening").cast("long"))
    own, base = F.get("early", F.least("h", "n").cast("int") - 1), F.get("opening", F.col("m").cast("int") - 1)
    lane = lambda x, k: F.when(x.isNotNull(), x[f"s{k}"]).otherwise(F.lit(0))
    plan = plan.select(
        "c", "n", "h", "m", "opening", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total"),
        *[F.when(F.col("h") > 0, lane(own, k)).otherwise(F.lit(0)).cast("long").alias(f"own{k}") for k in (0, 1)],
        *[F.when(F.col("m") > 0, lane(base, k)).otherwise(F.lit(0)).cast("long").alias(f"base{k}") for k in (0, 1)],
    )
    plan = stored(plan, "rebuilds")
    zero = F.lit(0).cast("long")
    columns = ["c", "d", "len", "last", "h0", "h1", "s0", "s1", "own0", "own1", "base0", "base1", "back"]
    tails = turns.join(plan.drop("opening"), "c").where("i > h").withColumn("d", F.expr("m + i - h")).withColumn("back", F.expr("h - m"))
    heads = plan.select("c", "total", F.explode("opening").alias("_o")).select("c", "total", F.col("_o.i").alias("d"), "_o.*")
    heads = heads.withColumns({"own0": zero, "own1": zero, "base0": zero, "base1": zero, "back": zero})
    rows = [x.withColumn("last", F.col("d") == F.col("total")).select(*columns) for x in (tails, heads)]
    made = rows[0].unionByName(rows[1]).mapInArrow(_prefixes, "c long, d long, len long, last boolean, p0 long, p1 long, q0 long, q1 long")
    return stored(made, "prefixes"), plan.select("c", "total")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (d, p0, p1, c): runs of up to ``RUN`` ids of one node as text."""
    for batch in batches:
        d, p0, p1, c = (np.asarray(batch.column(k)) for k in range(4))
        heads = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (p0[1:] != p0[:-1]) | (p1[1:] != p1[:-1])]) if len(c) else np.empty(0, np.int64)
        ends = np.r_[heads[1:], len(c)]
        cut = [(a, min(a + RUN, e)) for h, e in zip(heads, ends) for a in range(h, e, RUN)]
        at = np.array([a for a, _ in cut], np.int64)
        texts = [",".join(map(str, c[a:b].tolist())) for a, b in cut]
        yield pa.record_batch([*(pa.array(x[at]) for x in (d, p0, p1, c)), pa.array(texts, pa.string())], ["d", "p0", "p1", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs of a task: one digest per node."""
    now, running = None, None
    names = ["d", "p0", "p1", "ends_sha256"]

    def done() -> pa.RecordBatch:
        return pa.record_batch([*(pa.array([x]) for x in now), pa.array([running.hexdigest()])], names)

    for batch in batches:
        out = []
        for *key, _, ids in zip(*[batch.column(k).to_pylist() for k in range(5)]):
            if key != now:
                if now is not None:
                    out.append((*now, running.hexdigest()))
                now, running = key, hashlib.sha256()
            else:
                running.update(b",")
            running.update(ids.encode())
        if out:
            yield pa.record_batch([pa.array(x) for x in zip(*out)], names)
    if now is not None:
        yield done()


def ends_digest(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ids ``c`` of each node (``d p0 p1``), ascending, joined by commas."""
    keys = ["d", "p0", "p1", "c"]
    runs = ends.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_runs, "d long, p0 long, p1 long, first long, ids string")
    runs = runs.repartition("d", "p0", "p1").sortWithinPartitions("d", "p0", "p1", "first")
    return runs.mapInArrow(_digests, "d long, p0 long, p1 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    rows, convs = rebuilt(conversations)
    zero = F.lit(0).cast("long")
    nodes = rows.groupBy("d", "p0", "p1").agg(
        F.count("*").alias("n_convs"), F.min("c").alias("conv_id"), F.max("len").alias("len"), F.min(F.struct("q0", "q1")).alias("q")
    ).select("d", "p0", "p1", "n_convs", "conv_id", "len", "q.*")
    root = convs.agg(F.count("*").alias("n_convs"), F.min("c").alias("conv_id")).where("n_convs > 0")
    root = root.select(*[zero.alias(x) for x in ("d", "p0", "p1")], "n_convs", "conv_id", zero.alias("len"), *[F.lit(None).cast("long").alias(x) for x in ("q0", "q1")])
    nodes = stored(nodes.unionByName(root), "nodes")
    above = nodes.select((F.col("d") + 1).alias("d"), F.col("p0").alias("q0"), F.col("p1").alias("q1"), F.col("conv_id").alias("parent_conv_id"))
    linked = nodes.join(above, ["d", "q0", "q1"], "left").drop("q0", "q1")
    children = linked.where("d > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("d") - 1).alias("d")).agg(F.count("*").alias("n_children"))
    linked = stored(linked.join(children, ["conv_id", "d"], "left").withColumn("n_children", F.coalesce("n_children", zero)), "links")
    parent = F.when(F.col("d") > 0, F.struct(F.col("parent_conv_id").alias("conv_id"), (F.col("d") - 1).alias("d")))
    tree = linked.select(
        F.struct("conv_id", "d").alias("id"), parent.alias("parent"), F.col("n_children").alias("k"),
        (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("len")).alias("saved_tokens"),
    )
    totals = subtree_sums(tree, ["n_leaves", "saved_tokens"]).select("id.*", "n_leaves", "saved_tokens")
    ends = rows.where("last").select("d", "p0", "p1", "c").unionByName(convs.where("total = 0").select(*[zero.alias(x) for x in ("d", "p0", "p1")], "c"))
    found = linked.join(ends_digest(ends), ["d", "p0", "p1"], "left").join(totals, ["conv_id", "d"])
    return found.select(
        "conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
