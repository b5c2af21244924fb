"""The corpus pipeline: five stages from raw documents to shards.

Each stage takes all rows that the one before kept, as Parquet, and calls one operator:

1. ``language``: naive Bayes over character n-grams, trained on the labelled rows outside the held-out
   third. Documents in no language (no letters), or in none with a probability of at least ``SURE``, go.
2. ``near_duplicates``: MinHash with tensored banding; the document with the smallest id of each group stays,
   as one row, also where rows are repeated or have no id.
3. ``decontamination``: winnowing against ``benchmark``; documents with a shared window go.
4. ``mixing``: sources are repeated or thinned to their target weights; a document of n copies is n rows.
5. ``sharding``: every row gets a shard and a slot; shards hold the sources in proportion.

Null texts have no language and go in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslane.llm import decontaminate, langid, mixing, neardup, shards
from corpuslane.llm.shared import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SURE = 0.5
SHARDS = 8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    known = docs.where(~langid.held_out(F.col("doc_id")))
    found = langid.identify(docs, langid.train(known, F.col("text"), F.col("lang")))
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= SURE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.one_each(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return decontaminate.decontaminated(docs, items).where("n_hit = 0").select(*COLUMNS)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs).select(*COLUMNS)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shards.interleave(docs, SHARDS).select(*COLUMNS, "shard", "slot")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing_sources),
    ("sharding", sharding),
]

#: Language, near-duplicate and rounding decisions cannot be said in SQL; tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs
