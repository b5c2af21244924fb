"""Exact top-k by inner product over a bit-sliced index.

Vectors are integers per attribute. Rows are cut into tiles; in a tile each attribute is stored as bitmaps, one
for each of its ``SLICES`` most significant bits, one bit a row. For a query the slices of all attributes are added with bitmap arithmetic,
each shifted by the set bits of the query's value, to a sliced score of the tile's rows. The score's slices
are read from the most significant one downward to find the rows that can be among the first k:
the cut-off bits are bounded by the length of the query times the longest remainder in the tile. These boundary rows
get their exact integer scores; the rest cannot reach the k-th.

Every row is indexed, and the result is exact. Tiles of rows meet blocks of queries, each pair once in a task of
its own; a tile hands on k rows for each query, and a ranking by query keeps k of those.

Defined results: vectors that are null, empty or hold a null or non-finite component take no part, as queries or as rows; neither do rows with a null id.
Vectors of another length than a query's are no candidates of it. Rows of the query's own id are not its candidates. Other repeated rows are ranked each on their own; ties go to the smaller id. A query id
that occurs with several vectors is asked with each, and their hits are ranked together. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslane.llm.shared import ready, stored

SLICES = 7
TILE_ROWS = 16384
BLOCK_QUERIES = 512
SCALE = 256


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, v): floor(scale * x) of every component as a long, of valid rows only."""
    x = F.col(embedding)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    rows = vectors.where(F.col(vec_id).isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite)
    return rows.select(F.col(vec_id).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"))


def slices(values: np.ndarray) -> dict[str, np.ndarray | int]:
    """The index of a tile: bitmaps of the leading bits of each attribute, and what they leave out.

    value = low + (bits << shift) + remainder, the remainder taken from the middle of its range. The
    second half of the maps holds the complements, for negative factors.
    """
    low = values.min(axis=0)
    span = int((values - low).max())
    shift = max(0, span.bit_length() - SLICES)
    lead = (values - low) >> shift
    middle = ((1 << shift) - 1) / 2
    rest = (values - low - (lead << shift)) - middle
    words = -(-len(values) // 64) * 64
    maps = np.zeros((values.shape[1], SLICES, words // 64), np.uint64)
    for s in range(SLICES):
        bits = np.zeros((values.shape[1], words), np.uint8)
        bits[:, : len(values)] = ((lead >> s) & 1).T
        maps[:, s] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    maps = np.concatenate([maps, ~maps])
    return {"maps": maps, "shift": shift, "low": low, "middle": middle, "most": float(np.sqrt((rest**2).sum(axis=1)).max())}


def summed(maps: np.ndarray, query: np.ndarray) -> list[np.ndarray]:
    """The sliced sum of all attributes times the query's values, least significant slice first.

    Bit b of a value adds the attribute's slices b places higher. The bitmaps of one place are added three at a
    time, full adders over whole bitmaps, which gives one bitmap for the place and carries for the next.
    Attributes with a negative value count by their distance from the largest sliced value.
    """
    size = np.abs(query)
    attribute, bit = np.nonzero(size[:, None] >> np.arange(int(size.max()).bit_length()) & 1)
    attribute = attribute + len(query) * (query[attribute] < 0)
    total: list[np.ndarray] = []
    carried = np.empty((0, maps.shape[2]), np.uint64)
    place, last = 0, int(bit.max()) + SLICES if len(bit) else 0
    while place < last or len(carried):
        own = (bit <= place) & (place < bit + SLICES)
        stack, carries = np.concatenate([carried, maps[attribute[own], place - bit[own]]]), []
        while len(stack) > 1:
            n = len(stack) // 3
            if n:
                x, y, z = stack[:n], stack[n : 2 * n], stack[2 * n : 3 * n]
                half = x ^ y
                carries.append((x & y) | (half & z))
                stack = np.concatenate([half ^ z, stack[3 * n :]])
            else:
                carries.append(stack[:1] & stack[1:])
                stack = stack[:1] ^ stack[1:]
        total.append(stack[0] if len(stack) else np.zeros(maps.shape[2], np.uint64))
        carried = np.concatenate(carries) if carries else carried[:0]
        place += 1
    return total


def leading(total: list[np.ndarray], rows: np.ndarray, k: int) -> int:
    """The largest value that at least k of ``rows`` reach, found from the most significant slice downward."""
    value, open_, need = 0, rows, k
    for p in range(len(total) - 1, -1, -1):
        ones = open_ & total[p]
        count = int(np.bitwise_count(ones).sum())
        if count >= need:
            open_, value = ones, value | 1 << p
        else:
            need -= count
            open_ = open_ & ~total[p]
    return value


def reaching(total: list[np.ndarray], rows: np.ndarray, least: int) -> np.ndarray:
    """Rows whose sliced value is at least ``least``."""
    if least <= 0:
        return rows
    if least >> len(total):
        return np.zeros_like(rows)
    above, equal = np.zeros_like(rows), rows
    for p in range(len(total) - 1, -1, -1):
        if least >> p & 1:
            equal = equal & total[p]
        else:
            above = above | (equal & total[p])
            equal = equal & ~total[p]
    return above | equal


def search(index: dict, ids: np.ndarray, values: np.ndarray, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact scores of the first k rows of a tile for one query."""
    maps = index["maps"]
    rows = np.packbits(np.arange(maps.shape[2] * 64) < len(ids), bitorder="little").view(np.uint64).copy()
    for i in np.flatnonzero(ids == query_id):
        rows[i >> 6] &= ~(np.uint64(1) << np.uint64(i & 63))
    total = summed(maps, query)
    count = int(np.bitwise_count(rows).sum())
    if count > k and total:
        kth = leading(total, rows, k)
        # a score differs from its sliced value by at most this much, in units of the last slice
        slack = 2 * float(np.sqrt((query.astype(np.float64) ** 2).sum())) * index["most"] / (1 << index["shift"])
        rows = reaching(total, rows, kth - int(np.ceil(slack)) - 1)
    at = np.flatnonzero(np.unpackbits(rows.view(np.uint8), bitorder="little")[: len(ids)])
    scores = values[at] @ query
    if len(at) > k:
        # all rows of the k-th score stay for the tie-break
        kth = np.partition(scores, len(at) - k)[len(at) - k]
        at, scores = at[scores >= kth], scores[scores >= kth]
    order = np.lexsort((ids[at], -scores))[:k]
    return ids[at][order], scores[order]


def _packed(rows: DataFrame, group: str, kinds: str) -> DataFrame:
    """One row for each group and length: ids and values as binaries."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        lists = table.column("v").combine_chunks()
        values = np.asarray(lists.flatten())
        return pa.table({group: table.column(group)[:1], "dims": table.column("dims")[:1], "ids": pa.array([ids.tobytes()], pa.binary()), "values": pa.array([values.tobytes()], pa.binary())})

    return rows.groupBy(group, "dims").applyInArrow(run, kinds)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, tile_rows: int = TILE_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) from rows and queries (id, v) of whole numbers."""
    ready(vectors.sparkSession)
    n, asked = vectors.count(), queries.count()
    tiles, blocks = max(1, -(-n // tile_rows)), max(1, -(-asked // block_queries))
    spot = F.xxhash64("id", "v")
    dims = F.size("v").cast("long").alias("dims")
    index = stored(_packed(vectors.select("id", "v", dims, F.pmod(spot, F.lit(tiles)).alias("tile")), "tile", "tile long, dims long, ids binary, values binary"), "tiles")
    questions = _packed(queries.distinct().select("id", "v", dims, F.pmod(spot, F.lit(blocks)).alias("block")), "block", "block long, dims long, ids binary, values binary")
    questions = stored(questions.withColumnsRenamed({"ids": "q_ids", "values": "q_values"}), "questions")

    # every tile meets every block of its length exactly once, each pair under a key of its own
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    right = questions.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))))
    met = left.join(right, ["tile", "block", "dims"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims_, ids, values, q_ids, q_values in zip(*(batch.column(c) for c in ("dims", "ids", "values", "q_ids", "q_values"))):
                width = dims_.as_py()
                ids, q_ids = (np.frombuffer(x.as_buffer(), np.int64) for x in (ids, q_ids))
                values, q_values = (np.frombuffer(x.as_buffer(), np.int64).reshape(-1, width) for x in (values, q_values))
                made = slices(values)
                out: list[tuple[np.ndarray, ...]] = []
                for q_id, query in zip(q_ids.tolist(), q_values):
                    hit, score = search(made, ids, values, q_id, query, k)
                    out.append((np.full(len(hit), q_id), hit, score))
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*out)], ["query_id", "vec_id", "score"])

    found = met.mapInArrow(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
