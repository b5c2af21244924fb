"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes of a text.

Texts are cut at single blanks between two other characters. Neither tokenizer joins anything
across such a blank (A's pattern starts a new match there, B has no piece with a blank behind another
character, which is verified when it is loaded), so ``blank + word`` is encoded once for each distinct
word of a unit. Per unit, in Arrow: token lists are flattened with their parent indices, byte ends are segmented
cumulative sums, an Acero full outer join of both sides on (word, end) gives the elementary segments, each of
which is one overlapping pair of token occurrences, and a segment where both sides end closes a group.

Counts of an id pair (documents that hold it linked) are partial sums by ``Table.group_by`` for each block of
texts, merged by Spark. Then each block's documents meet the counts of its own pairs only and
are weighed with them; the table of all pairs is never broadcast. Stored rows are single documents and parts of a
block's pair list: readers and writers take many rows at once, so a whole block is never one row.

Defined results: a text that is null, empty, or not reproduced byte by byte by both tokenizers has zeros
and an empty digest, and counts nowhere. Every row is a document of its own, repeated rows and null ids
included. Only the key and the text are read, so other columns cannot clash. Texts longer than a
unit are taken in parts that end at such blanks, with a running digest.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslane.llm.shared import ready, stored
from corpuslane.llm.words import pieces

FOLDER = "/opt/tokenizers"
FILES = ("byte_bpe_50k.json", "piece_bpe_32k.model")
UNIT = 4 << 20
BLOCK = 8 << 20
ENCODED = 1 << 14
PART = 1 << 14
ROW_GROUP = 16 << 20
LOW_BITS = 15
BLANK = "▁"
SUMS = ("n_a", "n_b", "n_groups", "n_links")

# lead bytes of characters among which are all blanks outside ASCII
_WIDE = np.zeros(256, bool)
_WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_LOADED: dict[int, Pair] = {}


@dataclass
class Pair:
    """Both tokenizers and, by id, the bytes of each token."""

    a: object
    b: object
    bytes_a: pa.Array
    bytes_b: pa.Array
    whole: bool

    @classmethod
    def load(cls, json: bytes, model: bytes) -> Pair:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        a = Tokenizer.from_str(json.decode())
        a.encode_special_tokens = True
        b = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = b.get_piece_size()
        if size > 1 << LOW_BITS:
            raise ValueError(f"the second vocabulary has more than {1 << LOW_BITS} ids")
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        code = {chr(x): x for x in visible}
        code |= {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in set(visible))}
        ids = {i: t for t, i in a.get_vocab().items()}
        bytes_a = [bytes(code[c] for c in ids[i]) if i in ids and all(c in code for c in ids[i]) else b"" for i in range(max(ids) + 1)]
        names = [b.id_to_piece(i) for i in range(size)]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(names)]
        joins = any(BLANK in p.lstrip(BLANK) for p in names)
        return cls(a, b, pa.array(bytes_a, pa.binary()), pa.array(bytes_b, pa.binary()), joins)

    def encode(self, words: list[str]) -> tuple[pa.Array, pa.Array]:
        left, right = [], []
        for k in range(0, len(words), ENCODED):
            part = words[k : k + ENCODED]
            left.append(pa.array([e.ids for e in self.a.encode_batch_fast([" " + w for w in part], add_special_tokens=False)], pa.list_(pa.int32())))
            right.append(pa.array(self.b.encode(part, num_threads=1), pa.list_(pa.int32())))
        return pa.concat_arrays(left), pa.concat_arrays(right)


def files(folder: str = FOLDER) -> tuple[bytes, bytes]:
    found = []
    for name in FILES:
        with open(os.path.join(folder, name), "rb") as f:
            found.append(f.read())
    return found[0], found[1]


def _pair(shared: Broadcast) -> Pair:
    key = hash(shared.value)
    if key not in _LOADED:
        _LOADED[key] = Pair.load(*shared.value)
    return _LOADED[key]


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values in a row and where each begins, with the end of the last."""
    texts = texts.cast(pa.large_binary())
    at = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None else np.empty(0, np.uint8)
    return data, at - at[0]


def cuts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places of the single blanks at which texts are cut, none at a text's first or last byte."""
    if len(data) < 3:
        return np.empty(0, np.int64)
    before, after = data[:-2], data[2:]
    found = np.flatnonzero((data[1:-1] == 0x20) & (before > 0x20) & (after > 0x20) & ~((before >= 0x80) & _WIDE[after])) + 1
    edges = np.union1d(at, at - 1)
    return found[~np.isin(found, edges)]


def _offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(_offsets(counts), pa.int32()), values)


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between neighbouring offsets, empty ranges included."""
    upto = np.concatenate([[0], np.cumsum(values)])
    return upto[at[1:]] - upto[at[:-1]]


_NUMBERS = pc.cast(pa.array(np.arange(1 << 16), pa.int32()), pa.string())


@dataclass
class Aligned:
    """Per word: counts, the text of its groups, whether both sides gave its bytes, and its linked pairs."""

    sums: dict[str, np.ndarray]
    groups: pa.Array
    good: np.ndarray
    pairs: pa.Array
    links: np.ndarray


def align_words(words: pa.Array, pair: Pair) -> Aligned:
    a, b = pair.encode(words.to_pylist())
    wanted, begin = _buffer(pc.binary_join_element_wise(pa.scalar(b" "), words.cast(pa.binary()), pa.scalar(b"")))
    good = np.ones(len(words), bool)
    sides = []
    for ids, table in ((a, pair.bytes_a), (b, pair.bytes_b)):
        flat, parent = pc.list_flatten(ids), np.asarray(pc.list_parent_indices(ids))
        spelled, at = _buffer(table.take(flat))
        size = np.bincount(parent, np.diff(at), len(words)).astype(np.int64)
        if not (np.array_equal(size, np.diff(begin)) and np.array_equal(spelled, wanted)):
            own = _offsets(size)
            good &= [bytes(spelled[own[i] : own[i + 1]]) == bytes(wanted[begin[i] : begin[i + 1]]) for i in range(len(words))]
        sides.append((flat, parent, np.diff(at)))
    tables = []
    for (flat, parent, size), name in zip(sides, ("a", "b")):
        keep = good[parent]
        parent, size = parent[keep], size[keep]
        total = np.cumsum(size)
        heads = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]]) if len(parent) else np.empty(0, np.int64)
        carry = (total - size)[heads]
        ends = total - np.repeat(carry, np.diff(np.r_[heads, len(parent)]))
        tables.append(pa.table({"word": pa.array(parent, pa.int64()), "end": pa.array(ends, pa.int64()), name: flat.filter(pa.array(keep))}))
    both = tables[0].join(tables[1], ["word", "end"], join_type="full outer", use_threads=False).sort_by([("word", "ascending"), ("end", "ascending")])
    both = both.combine_chunks()
    word = both.column("word").to_numpy()
    ends_a, ends_b = (np.asarray(pc.is_valid(both.column(n))) for n in ("a", "b"))
    id_a, id_b = (pc.fill_null_backward(both.column(n)).to_numpy() for n in ("a", "b"))
    n = len(words)
    close = ends_a & ends_b
    group = np.cumsum(close) - close
    count = int(close.sum())
    texts = [
        pc.binary_join(_lists(np.bincount(group[e], minlength=count), _NUMBERS.take(pa.array(i[e]))), ",") for e, i in ((ends_a, id_a), (ends_b, id_b))
    ]
    sums = {
        "n_a": np.bincount(word[ends_a], minlength=n), "n_b": np.bincount(word[ends_b], minlength=n),
        "n_groups": np.bincount(word[close], minlength=n), "n_links": np.bincount(word, minlength=n),
    }
    groups = pc.binary_join(_lists(sums["n_groups"], pc.binary_join_element_wise(*texts, "|")), ";")
    packed = (id_a.astype(np.int64) << LOW_BITS) | id_b
    return Aligned(sums, groups, good, _lists(sums["n_links"], pa.array(packed, pa.int64())), sums["n_links"])


def align_texts(texts: pa.Array, pair: Pair) -> tuple[dict[str, np.ndarray], pa.Array, np.ndarray, pa.Table]:
    """For non-empty texts: counts and groups of each, whether it is good, and (text, pair, times)."""
    data, at = _buffer(texts)
    cut = np.empty(0, np.int64) if pair.whole else cuts(data, at)
    heads = np.sort(np.concatenate([at[:-1], cut + 1]))
    tails = np.sort(np.concatenate([cut, at[1:]]))
    bytes_ = np.delete(data, cut)
    offsets = _offsets(tails - heads)
    words = pa.Array.from_buffers(pa.large_string(), len(heads), [None, pa.py_buffer(offsets), pa.py_buffer(bytes_)])
    coded = words.dictionary_encode()
    found = align_words(coded.dictionary, pair)
    which = np.asarray(coded.indices)
    first = np.searchsorted(heads, at)
    bad = _sums(~found.good[which], first) > 0
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    sums = {name: np.where(bad, 0, _sums(values[which], first)) for name, values in found.sums.items()}
    groups = pc.binary_join(_lists(np.diff(first), found.groups.take(coded.indices)), ";")
    use = ~bad[owner]
    links = found.pairs.take(pa.array(which[use]))
    table = pa.table({"doc": pa.array(np.repeat(owner[use], found.links[which[use]]), pa.int64()), "pair": pc.list_flatten(links)})
    table = table.group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
    return sums, groups, bad, table


def parts(text: pa.Array, limit: int) -> Iterator[pa.Array]:
    """One long text in parts of about ``limit`` bytes, cut where words are cut, the blank left out."""
    data, at = _buffer(text)
    places = cuts(data, at)
    a = 0
    while a < len(data):
        k = np.searchsorted(places, a + limit)
        b = int(places[k]) if k < len(places) else len(data)
        yield pa.array([bytes(data[a:b]).decode()], pa.large_string())
        a = b + 1


@dataclass
class Block:
    """Rows of one block: its documents and the pairs of each."""

    rows: list[tuple] = field(default_factory=list)
    keys: list[pa.Array] = field(default_factory=list)
    pairs: list[pa.Table] = field(default_factory=list)
    size: int = 0

    def put(self, keys: pa.Array, sums: dict[str, np.ndarray], digests: list[str], pairs: pa.Table) -> None:
        doc = pc.add(pairs.column("doc"), len(self.rows))
        self.pairs.append(pairs.set_column(pairs.schema.get_field_index("doc"), "doc", doc))
        self.rows += zip(*[sums[n].tolist() for n in SUMS], digests)
        self.keys.append(keys)

    def batches(self, number: int, part: int) -> Iterator[pa.RecordBatch]:
        """A row for each document with its pairs, then the pairs of the block, ``part`` of them a row."""
        own = pa.concat_tables(self.pairs).sort_by([("doc", "ascending")]).combine_chunks()
        counts = np.bincount(own.column("doc").to_numpy(), minlength=len(self.rows))
        columns = list(zip(*self.rows))
        fields = [pa.concat_arrays(self.keys), *[pa.array(c, pa.int64()) for c in columns[:-1]], pa.array(columns[-1], pa.string())]
        docs = pa.StructArray.from_arrays(fields, ["key", *SUMS, "groups_sha256"])
        pair, times = (_lists(counts, own.column(c).combine_chunks()) for c in ("pair", "count_all"))
        yield self._rows(number, docs, pair, times, *[pa.nulls(len(docs), pa.list_(pa.int64()))] * 2)
        held = own.group_by("pair", use_threads=False).aggregate([([], "count_all")]).combine_chunks()
        sizes = np.diff([*range(0, held.num_rows, part), held.num_rows])
        kind, n_docs = (_lists(sizes, held.column(c).combine_chunks()) for c in ("pair", "count_all"))
        yield self._rows(number, pa.nulls(len(sizes), docs.type), *[pa.nulls(len(sizes), pa.list_(pa.int64()))] * 2, kind, n_docs)

    @staticmethod
    def _rows(number: int, *columns: pa.Array) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.full(len(columns[0]), number)), *columns], ["block", "doc", "pair", "times", "kind", "n_docs"])


_NO_PAIRS = pa.table({"doc": pa.array([], pa.int64()), "pair": pa.array([], pa.int64()), "count_all": pa.array([], pa.int64())})


def _digest(text: bytes, bad: bool) -> str:
    return "" if bad else hashlib.sha256(text).hexdigest()


def _add(block: Block, piece: pa.RecordBatch, pair: Pair, unit: int) -> None:
    texts = piece.column("text").cast(pa.large_string())
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    block.size += int(size.sum())
    if piece.num_rows == 1 and size[0] > unit and not pair.whole:
        _add_long(block, piece.column("key"), texts, pair, unit)
        return
    some = np.flatnonzero(size)
    n = piece.num_rows
    sums = {name: np.zeros(n, np.int64) for name in SUMS}
    digests, pairs = [""] * n, _NO_PAIRS
    if len(some):
        found, groups, bad, pairs = align_texts(texts.take(pa.array(some)), pair)
        for name in SUMS:
            sums[name][some] = found[name]
        for i, g, b in zip(some, groups, bad):
            digests[i] = _digest(g.as_buffer(), b)
        pairs = pairs.set_column(pairs.schema.get_field_index("doc"), "doc", pa.array(some[pairs.column("doc").to_numpy()], pa.int64()))
    block.put(piece.column("key"), sums, digests, pairs.select(["doc", "pair", "count_all"]))


def _add_long(block: Block, key: pa.Array, text: pa.Array, pair: Pair, unit: int) -> None:
    total, running, wrong, tables = dict.fromkeys(SUMS, 0), hashlib.sha256(), False, []
    for k, part in enumerate(parts(text, unit)):
        found, groups, bad, pairs = align_texts(part, pair)
        wrong |= bool(bad[0])
        for name in SUMS:
            total[name] += int(found[name][0])
        running.update((b";" if k else b"") + groups[0].as_py().encode())
        tables.append(pairs.select(["doc", "pair", "count_all"]))
        if len(tables) > 16 or wrong:
            tables = [_merged(tables)]
    pairs = _NO_PAIRS if wrong else _merged(tables)
    sums = {name: np.array([0 if wrong else total[name]]) for name in SUMS}
    block.put(key, sums, ["" if wrong else running.hexdigest()], pairs)


def _merged(tables: list[pa.Table]) -> pa.Table:
    found = pa.concat_tables(tables).group_by(["doc", "pair"], use_threads=False).aggregate([("count_all", "sum")])
    return found.rename_columns([c.replace("count_all_sum", "count_all") for c in found.column_names]).select(["doc", "pair", "count_all"])


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = FOLDER, unit: int = UNIT, block: int = BLOCK, part: int = PART) -> DataFrame:
    """One row per document: the key, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256``, ``n_best``, ``count_sum``.

    ``n_best`` and ``count_sum`` weigh links by the corpus-wide counts of their pairs.
    """
    spark = docs.sparkSession
    ready(spark)
    shared = spark.sparkContext.broadcast(files(folder))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, now = _pair(shared), Block()
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in pieces(batch, "text", unit):
                _add(now, piece, pair, unit)
                if now.size >= block:
                    yield from now.batches(number, part)
                    now, number = Block(), number + 1
        if now.rows:
            yield from now.batches(number, part)

    doc = f"struct<key:{kind},n_a:long,n_b:long,n_groups:long,n_links:long,groups_sha256:string>"
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        run, f"block long, doc {doc}, pair array<long>, times array<long>, kind array<long>, n_docs array<long>"
    )
    # lists are read back by the row group, so row groups are small
    rows = stored(rows, "aligned", **{"parquet.block.size": ROW_GROUP, "parquet.page.size.row.check.min": 10})
    held = rows.where("kind IS NOT NULL").select(F.col("block").alias("own"), F.inline(F.arrays_zip("kind", "n_docs")))
    counts = stored(held.groupBy("kind").agg(F.sum("n_docs").alias("n")), "pairs")
    left = F.shiftright("kind", LOW_BITS)
    top = counts.groupBy(left.alias("left")).agg(F.max("n").alias("top"))
    weighed = counts.withColumn("left", left).join(top, "left").select("kind", "n", (F.col("n") == F.col("top")).alias("best"))
    # each block is sent the counts of its own pairs
    sent = held.select("own", "kind").join(weighed, "kind")
    met = rows.where("doc IS NOT NULL").select("block", "doc", "pair", "times").groupBy("block").cogroup(sent.groupBy("own"))

    def weigh(docs: pa.Table, known: pa.Table) -> pa.Table:
        docs, known = docs.combine_chunks(), known.sort_by("kind")
        doc, pair, times = (docs.column(c).combine_chunks() for c in ("doc", "pair", "times"))
        at = _offsets(np.asarray(pc.list_value_length(pair)))
        times = np.asarray(pc.list_flatten(times))
        place = np.searchsorted(known.column("kind").to_numpy(), np.asarray(pc.list_flatten(pair)))
        sums = [pa.array(_sums(times * known.column(c).to_numpy()[place], at), pa.int64()) for c in ("best", "n")]
        return pa.table([*doc.flatten(), *sums], [key, *SUMS, "groups_sha256", "n_best", "count_sum"])

    return met.applyInArrow(weigh, f"`{key}` {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
