"""Shards whose mixture matches the whole: proportional stratified interleaving.

Rows are put into a seeded shuffle, ranked within their source, and placed by the fraction of
their source that lies before them. In that order every stretch holds each source in
proportion; cutting it into equal stretches gives shards with counts at most one apart, and
each source's count in a shard within two of its share.

No source is ranked in one task: a source's shuffle order is cut into hash buckets, whose
counts give each bucket its first rank; a row then needs its place in its own bucket only. The
same is done for the places in the common order. The number of buckets follows the number of rows.
All that is done on hashes; whole rows are shuffled once, to meet their slots.

Defined results: null ids, texts and sources are values like others (null is a source of its
own); repeated rows get slots of their own, and which of two fully equal rows comes first has no
meaning (the slots of rows equal in source and ``by`` meet in one task, so such rows are meant to
be few). An empty table gives no rows. Input columns named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslane.llm.shared import row_of

ROWS_PER_BUCKET = 1024
LAW = "rows"


def place(first: Column, window: Window) -> Column:
    return first + F.row_number().over(window) - 1


def interleave(docs: DataFrame, shards: int, source: str = "source", by: tuple[str, ...] = ("doc_id", "text"), seed: int = 11, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``docs`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    ``by`` names the columns whose hash is the shuffle order; rows equal in them are tied.
    """
    total = docs.count()
    buckets = max(1, total // rows_per_bucket)
    key = F.xxhash64(F.lit(seed), F.col(source).isNull(), F.col(source), *by).alias("_h")
    # the bucket follows the order of the hash, so that buckets stand one after the other
    part = F.shiftrightunsigned("_h", 11) / F.lit(float(1 << 53))
    hashed = docs.select(key, F.col(source).alias("_src")).withColumn("_b", _cut(part, buckets))

    cells = hashed.groupBy(F.col("_src").alias("_s"), "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("_s", F.col("_b").alias("_cell"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"), F.sum("_n").over(Window.partitionBy("_s")).alias("_rows"))
    ranked = hashed.join(cells, F.col("_src").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_cell")))
    ranked = ranked.withColumn("_rank", place(F.col("_first"), Window.partitionBy("_src", "_b").orderBy(F.shiftrightunsigned("_h", 11), "_h")))
    # each source starts at its own offset, or all sources of one row would meet at the same fraction
    offset = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), F.col("_src")), 11) / F.lit(float(1 << 53))
    ranked = ranked.select("_h", "_src", "_rank", ((F.col("_rank") + offset) / F.col("_rows")).alias("_f"))
    ranked = ranked.withColumn("_place", _cut(F.col("_f"), buckets))

    places = ranked.groupBy("_place").agg(F.count(F.lit(1)).alias("_n"))
    starts = places.select(F.col("_place").alias("_p"), F.coalesce(F.sum("_n").over(Window.orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    put = ranked.join(starts, F.col("_place") == F.col("_p"))
    put = put.withColumn("_at", place(F.col("_start"), Window.partitionBy("_place").orderBy("_f", "_src", "_rank")))
    put = put.withColumn("shard", F.expr(f"CAST(_at * {shards} DIV {max(total, 1)} AS INT)"))
    # the first place of shard k is the least p with p * shards >= k * total
    slot = F.expr(f"_at - (CAST(shard AS BIGINT) * {total} + {shards - 1}) DIV {shards}")
    slots = put.groupBy("_h").agg(F.array_sort(F.collect_list(F.struct("shard", slot.alias("slot")))).alias("_slots"))

    rows = docs.select(row_of(docs, "shard", "slot"), key)
    rows = rows.withColumn("_o", F.row_number().over(Window.partitionBy("_h").orderBy("_h"))).join(slots, "_h")
    return rows.withColumn("_to", F.element_at("_slots", F.col("_o"))).select("_row.*", "_to.shard", "_to.slot")


def _cut(fraction: Column, buckets: int) -> Column:
    """The bucket of a fraction from 0 to 1."""
    return F.least(F.floor(fraction * buckets), F.lit(buckets - 1))


def digest(docs: DataFrame) -> DataFrame:
    """Id, source, byte size plus one and text checksum of each row, without the text."""
    raw = F.coalesce(F.encode(F.col("text"), "UTF-8"), F.lit(b""))
    return docs.select("doc_id", "source", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
