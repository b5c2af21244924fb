"""The registered queries: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslane.llm import (
    alignment, decontaminate, langid, license_scan, mixing, neardup, secret_scan, shards, substrings, topk, toxicity, trie, warc,
)
from corpuslane.llm.shared import bit_filter, in_filter, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SHARDS = 8
TOP = 5


def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@register
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = docs.where(~langid.held_out(F.col("doc_id")))
    model = langid.train(known, F.col("text"), F.col("lang"))
    found = langid.identify(docs.select("doc_id", "text"), model)
    held = F.coalesce(langid.held_out(F.col("doc_id")), F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


@register
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    put = shards.interleave(shards.digest(table(spark, sf_dir, "documents")), SHARDS, by=("doc_id", "text_crc32", "size"))
    return put.select("doc_id", "source", "size", "text_crc32", F.lit(shards.LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@register
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.with_mix(docs)
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


@register
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))
    names = F.coalesce(F.array_sort(F.transform("items", lambda x: x.cast("string"))), F.array().cast("array<string>"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@register
def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


@register
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = substrings.without_repeats(docs)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@register
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = warc.as_blocks(table(spark, sf_dir, "pages"), "page_id", "url", F.col("html"))
    legacy = stored(warc.arc_archives(blocks), "arc")
    archives = stored(warc.convert(legacy), "warc")
    records = stored(warc.read(archives).drop("payload"), "warc-index")
    return warc.resolved(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# equal payloads hash alike, so the twin groups by the text itself
SQL["op10_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
     s AS (SELECT page_id, octet_length(encode(body)) AS n, sha1(encode(body)) AS d, max(page_id) OVER (PARTITION BY body) AS last FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to
FROM s
"""


@register
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs, secret_scan.train(docs, F.col("text")))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = listed(F.filter("found", lambda s: s["base"]))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"), count("random"))


@register
def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where(F.col("id") % 50 == 0), TOP)


SQL["op3_top_k"] = f"""
WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.id AS query_id, c.id AS vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
           FROM v q JOIN v c ON q.id <> c.id AND len(q.v) = len(c.v) WHERE q.id % 50 = 0),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {TOP}
"""


@register
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents have no paths. A source is read as a repository with directories for ids by
    20,000 and below by 2,000, where every third file of a source lies in the upper one; a document that
    states a licence in its first three lines is taken for its directory's licence file."""
    docs = table(spark, sf_dir, "documents")
    number = F.col("doc_id")
    lower = F.when(F.expr("doc_id DIV 20 % 3 <> 0"), F.expr("doc_id DIV 2000 % 10").cast("string"))
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.expr("doc_id DIV 20000").cast("string"), lower, number.cast("string"))
    docs = docs.select("doc_id", F.when(number.isNotNull(), path).alias("path"), "text")
    found = license_scan.statements(docs, license_scan.weigh(docs, F.col("text")), texts=False)
    return license_scan.inherited(found, speaks=F.col("line") < 3)


@register
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows are picked by a bit filter of their ids, so only their texts are moved to the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~langid.held_out(F.col("doc_id"))).select("doc_id", "toxic", F.xxhash64("doc_id").alias("key"))
    known = in_filter(bit_filter(labels, "key"))
    taught = docs.where(~langid.held_out(F.col("doc_id"))).where(known(F.xxhash64("doc_id"))).join(labels, "doc_id")
    found = toxicity.locate(docs, toxicity.train(taught, F.col("text"), F.col("toxic")))
    held = F.coalesce(langid.held_out(F.col("doc_id")), F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", "predicted", "n_evidence", F.size("offending").cast("long").alias("n_offending"))


@register
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


@register
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
