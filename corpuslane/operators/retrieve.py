"""Hybrid retrieval: vector leg, keyword leg, fusion, ranking and telemetry."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslane.functions import lexicon as L
from corpuslane.functions.text import col, find, sub, unroll, ws_trim
from corpuslane.session import deal, materialize

BM25_K1 = 1.2
BM25_B = 0.75
# Query vectors and chunks that meet in one task.
QUERY_BLOCK = 1_024
CHUNK_CELL = 50_000

_LEG = "query_id bigint, chunk_id bigint, score double"


# --- vector leg -------------------------------------------------------------


def _unit_rows(vectors) -> np.ndarray:
    m = np.asarray([np.asarray(v, dtype=np.float64) for v in vectors])
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def _best_pairs(qid, qmat, cid, cmat, n: int, floor: float) -> pd.DataFrame:
    """Top ``n`` chunks per query within one batch, scores rounded before ranking."""
    scores = np.round(cmat @ qmat.T, 6)
    out = []
    for j in range(len(qid)):
        s = scores[:, j]
        kept = np.flatnonzero(s >= floor)
        if len(kept) > n:
            # every score equal to the n-th stays for the tie-break
            kept = kept[s[kept] >= np.partition(s[kept], len(kept) - n)[len(kept) - n]]
        order = kept[np.lexsort((cid[kept], -s[kept]))[:n]]
        out.append(pd.DataFrame({"query_id": qid[j], "chunk_id": cid[order], "score": s[order]}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["query_id", "chunk_id", "score"])


def vector_leg(
    queries: DataFrame, chunks: DataFrame, n: int = L.MAX_RESULTS, floor: float = L.MATCH_THRESHOLD
) -> DataFrame:
    """Cosine score of every query against every chunk, best ``n`` kept per query.

    ``queries(query_id, vector)``, ``chunks(chunk_id, vector)``. Every block of queries meets
    every cell of chunks in a task of its own, which hands on at most ``n`` rows per query.
    """
    return top_per_query(_block_join(queries, chunks, n, floor), n)


def _block_join(queries: DataFrame, chunks: DataFrame, n: int, floor: float) -> DataFrame:
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    cells = max(1, -(-chunks.count() // CHUNK_CELL))
    spread_q = queries.select(
        "query_id", "vector",
        F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(cells - 1).cast("bigint"))).alias("cell"),
    )
    spread_c = chunks.select(
        "chunk_id", "vector",
        F.pmod(F.xxhash64("chunk_id"), F.lit(cells)).alias("cell"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"),
    )

    def score(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({"query_id": [], "chunk_id": [], "score": []})
        return _best_pairs(
            q["query_id"].to_numpy(), _unit_rows(q["vector"]), c["chunk_id"].to_numpy(), _unit_rows(c["vector"]), n, floor
        )

    return spread_q.groupBy("block", "cell").cogroup(spread_c.groupBy("block", "cell")).applyInPandas(score, _LEG)


def top_per_query(scored: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("chunk_id"))
    return (
        scored.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= n)
    )


# --- keyword leg ------------------------------------------------------------


def words_of(text: Column | str) -> Column:
    return F.array_remove(F.split(F.lower(col(text)), r"[^\p{L}\p{N}]+", -1), "")


LEVELS_A_UNIT = 64
# (query, chunk, word) rows that a task adds up
PAIRS_A_TASK = 1 << 20
#: Bounds are compared with room for rounding.
SLACK = 1e-5


def query_terms(queries: DataFrame) -> DataFrame:
    """``query_id, n_words, word`` of each distinct word of a query."""
    words = queries.select("query_id", F.array_distinct(words_of("query")).alias("words"))
    return words.select("query_id", F.size("words").alias("n_words"), F.explode("words").alias("word"))


def contributions(terms: DataFrame, chunks: DataFrame) -> DataFrame:
    """``chunk_id, word, w``: what each word of the queries adds to the BM25 score of each chunk that holds it."""
    # every chunk also lists the empty word once, so sizes come out of the same single pass
    vocabulary = terms.select("word").distinct().unionByName(terms.sparkSession.range(1).select(F.lit("").alias("word")))
    sized = chunks.select("chunk_id", words_of("text").alias("words"))
    postings = materialize(
        unroll(sized, ["chunk_id", F.size("words").alias("len")], F.array_append("words", ""), "_i", "word")
        .join(vocabulary, "word", "left_semi")
        .groupBy("chunk_id", "len", "word")
        .agg(F.count("*").alias("tf")),
        "postings",
    )
    stats = postings.filter(F.col("word") == "").agg(F.count("*").alias("n_chunks"), F.avg("len").alias("avg_len"))
    postings = postings.filter(F.col("word") != "")
    idf = postings.groupBy("word").agg(F.count("*").alias("df")).join(F.broadcast(stats)).select(
        "word", "avg_len",
        F.ln(1 + (F.col("n_chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"),
    )
    weight = (
        F.col("idf") * F.col("tf") * (BM25_K1 + 1)
        / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("len") / F.col("avg_len")))
    )
    return postings.join(idf, "word").select("chunk_id", "word", weight.alias("w"))


def opening_words(terms: DataFrame, adds: DataFrame, mode: str, n: int) -> DataFrame:
    """``terms`` with ``open``, whether a word brings chunks in, and ``rest``, the most that a query's other words add together.

    ``and``: the rarest word opens, since every hit holds it. ``or``: a word's ``n``-th largest contribution, read off a histogram
    from below, is a score that the ``n``-th best hit reaches at least. Words by their largest contribution, smallest
    first, cannot reach it together until the running sum does; chunks that hold only those are out.
    """
    query = Window.partitionBy("query_id")
    if mode == "and":
        held = terms.join(adds.groupBy("word").agg(F.count("*").alias("df"), F.max("w").alias("most")), "word", "left")
        held = held.withColumn("rank", F.row_number().over(query.orderBy(F.coalesce("df", F.lit(0)), "word")))
        marked = held.withColumn("open", F.col("rank") == 1)
    else:
        level = F.floor(F.col("w") * LEVELS_A_UNIT)
        # a contribution is at most idf times a constant, so a word has few levels
        counts = adds.groupBy("word", level.alias("level")).agg(F.count("*").alias("m"), F.max("w").alias("most"))
        counts = counts.withColumn("upto", F.sum("m").over(Window.partitionBy("word").orderBy(F.desc("level"))))
        words = counts.groupBy("word").agg(F.max("most").alias("most"), F.max(F.when(F.col("upto") >= n, F.col("level"))).alias("nth"))
        held = terms.join(words, "word").withColumn("least", F.max(F.coalesce(F.col("nth") / LEVELS_A_UNIT, F.lit(0.0))).over(query))
        reach = F.sum("most").over(query.orderBy("most", "word").rowsBetween(Window.unboundedPreceding, 0))
        marked = held.withColumn("open", reach >= F.col("least") - SLACK)
    rest = F.sum(F.when(~F.col("open"), F.coalesce("most", F.lit(0.0))).otherwise(0.0)).over(query)
    return marked.withColumn("rest", rest).select("query_id", "n_words", "word", "open", "rest")


def _opened(adds: DataFrame, opening: DataFrame) -> DataFrame:
    """``adds`` beside the queries that its words open, dealt out by chunk.

    A chunk's rows are in one task, so they are added up where they meet their queries, and the pairs of queries and chunks, which
    outnumber both, are not shuffled. The pairs are counted first: a task gets about ``PAIRS_A_TASK``, at any size.
    """
    asked = opening.groupBy("word").agg(F.count("*").alias("asked"))
    opens = adds.join(asked.select("word"), "word", "left_semi")
    pairs = opens.groupBy("word").agg(F.count("*").alias("n")).join(asked, "word").agg(F.sum(F.col("n") * F.col("asked"))).first()[0]
    return deal(opens, "chunk_id", least=(pairs or 0) // PAIRS_A_TASK + 1).join(opening, "word")


def keyword_leg(queries: DataFrame, chunks: DataFrame, mode: str, n: int = L.MAX_RESULTS) -> DataFrame:
    """BM25 over an inverted index restricted to the words the queries use.

    ``queries(query_id, query)``, ``chunks(chunk_id, text)``. In ``and`` mode a chunk must
    hold every distinct query word. Only the opening words of a query are joined to their lists. The chunks that they
    bring in have a partial score, and those that cannot reach the ``n``-th best partial one with all other
    words are out; what is left is looked up under the query's other words.
    """
    terms = query_terms(queries)
    adds = materialize(contributions(terms, chunks), "contributions")
    plan = materialize(opening_words(terms, adds, mode, n), "opening-words")
    keys = ["query_id", "chunk_id"]
    partial = _opened(adds, plan.filter("open")).groupBy(*keys, "n_words", "rest").agg(F.sum("w").alias("part"), F.count("*").alias("hits"))
    if mode == "or":
        partial = materialize(partial, "partial-scores")
        nth = Window.partitionBy("query_id").orderBy(F.desc("part"))
        best = partial.select("query_id", "part").withColumn("_r", F.row_number().over(nth)).filter(F.col("_r") <= n)
        least = best.groupBy("query_id").agg(F.when(F.count("*") >= n, F.min("part")).otherwise(0.0).alias("least"))
        partial = partial.join(least, "query_id").filter(F.col("part") + F.col("rest") >= F.col("least") - SLACK)
    others = partial.select(*keys).join(plan.filter("NOT open").select("query_id", "word"), "query_id").join(adds, ["chunk_id", "word"])
    others = others.groupBy(*keys).agg(F.sum("w").alias("more"), F.count("*").alias("also"))
    scored = partial.join(others, keys, "left").select(
        *keys, "n_words", F.round(F.col("part") + F.coalesce("more", F.lit(0.0)), 6).alias("score"), (F.col("hits") + F.coalesce("also", F.lit(0))).alias("hit")
    )
    if mode == "and":
        scored = scored.filter(F.col("hit") == F.col("n_words"))
    return top_per_query(scored.select("query_id", "chunk_id", "score"), n)


# --- fusion and fallback ----------------------------------------------------


def rrf(vector: DataFrame, keyword: DataFrame, k: int = L.RRF_K, n: int = L.MAX_RESULTS) -> DataFrame:
    """Reciprocal-rank fusion keeping the rank each leg gave."""
    v = vector.select("query_id", "chunk_id", F.col("rank").alias("vector_rank"))
    w = keyword.select("query_id", "chunk_id", F.col("rank").alias("keyword_rank"))
    fused = v.join(w, ["query_id", "chunk_id"], "full_outer").withColumn(
        "score",
        F.round(
            F.coalesce(1.0 / (k + F.col("vector_rank")), F.lit(0.0))
            + F.coalesce(1.0 / (k + F.col("keyword_rank")), F.lit(0.0)),
            9,
        ),
    )
    return top_per_query(fused, n)


def with_fallback(responses: DataFrame, hybrid: DataFrame, vector: DataFrame) -> DataFrame:
    """Empty hybrid answers whose vector leg never ran take the vector-only rows.

    ``responses(query_id, legs)``: which legs the hybrid search ran. Null legs count as none.
    """
    empty = responses.join(hybrid.select("query_id").distinct(), "query_id", "left_anti")
    skipped = empty.filter(~F.coalesce(F.array_contains("legs", "vector"), F.lit(False)))
    cols = ["query_id", "chunk_id", "score", "rank"]
    return (
        hybrid.select(*cols, F.lit(False).alias("fallback"))
        .unionByName(vector.join(skipped, "query_id", "left_semi").select(*cols, F.lit(True).alias("fallback")))
    )


# --- ranking ----------------------------------------------------------------


def best_by_file(hits: DataFrame) -> DataFrame:
    """Best score per (query, file); a null score counts as 0, keyless rows are skipped."""
    s = F.coalesce("score", F.lit(0.0))
    return (
        hits.filter(F.col("file").isNotNull())
        .groupBy("query_id", "file")
        .agg(F.max(s).alias("best"), F.min("pos").alias("first_pos"))
    )


def rank_files(hits: DataFrame, n: int = L.CARDS_PER_QUERY) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("best"), F.asc("first_pos"))
    return (
        best_by_file(hits).withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= n)
    )


def attach_meta(hits: DataFrame, meta: DataFrame) -> DataFrame:
    """Left join file metadata with a default per field."""
    return hits.join(meta, "file", "left").withColumns(
        {
            "title": F.coalesce("title", F.col("file").cast("string")),
            "category": F.coalesce("category", F.lit("uncategorized")),
        }
    )


def retrieval_stats(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """One telemetry row per query: counts, the five best files, flags and lengths.

    Carries shapes only, never text.
    """
    s = F.coalesce("score", F.lit(0.0))
    files = (
        hits.filter(F.col("file").isNotNull())
        .groupBy("query_id", "file")
        .agg(
            F.max(s).alias("best"),
            F.min("pos").alias("first_pos"),
            F.max_by("rerank", F.struct(s, -F.col("pos"))).alias("rerank"),
            F.count("*").alias("n"),
        )
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("best"), F.asc("first_pos"))
    top = (
        files.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= 5)
        .groupBy("query_id")
        .agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("r", "file"))),
                    lambda x: x["file"].cast("string"),
                ),
                ",",
            ).alias("top_files"),
            F.max_by("rerank", F.col("best") - F.col("r") * 1e-9).alias("top_rerank"),
        )
    )
    counts = hits.groupBy("query_id").agg(F.count("*").alias("chunks"))
    nfiles = files.groupBy("query_id").agg(F.count("*").alias("files"))
    return (
        queries.join(counts, "query_id", "left").join(nfiles, "query_id", "left").join(top, "query_id", "left")
        .select(
            "query_id",
            F.coalesce("chunks", F.lit(0)).cast("bigint").alias("chunks"),
            F.coalesce("files", F.lit(0)).cast("bigint").alias("files"),
            F.coalesce("top_files", F.lit("")).alias("top_files"),
            "top_rerank",
            (ws_trim("search_query") != ws_trim("query")).alias("rewritten"),
            F.char_length("query").cast("bigint").alias("qlen"),
            F.char_length("search_query").cast("bigint").alias("sqlen"),
        )
    )


# --- text helpers of the retrieval path --------------------------------------


def strip_header(text: Column | str) -> Column:
    """Drop a leading header block only when its first key is ``title:``."""
    return sub(text, r"^---\r?\ntitle:[\s\S]*?\r?\n---(?:\r?\n|$)")


def section_of(text: Column | str) -> Column:
    """First markdown heading, or null."""
    return F.nullif(ws_trim(find(text, r"(?m)^#{1,6}\s+(.+)$", 1)), F.lit(""))


def expand_query(text: Column | str) -> Column:
    """Append vocabulary for every triggered hint, the original text kept in front."""
    t = col(text)
    added = F.array_compact(F.array(*[F.when(t.rlike(p), F.lit(a)) for p, a in L.QUERY_HINTS]))
    return F.when(F.size(added) == 0, t).otherwise(F.concat(t, F.lit("\n\n"), F.array_join(added, " ")))


def _flag(c: Column, default: bool) -> Column:
    raw = F.lower(ws_trim(F.coalesce(c, F.lit(""))))
    return F.when(raw.isin("on", "true", "1"), True).when(raw.isin("off", "false", "0"), False).otherwise(default)


def normalize_settings(df: DataFrame) -> DataFrame:
    """Request settings as typed values; anything unrecognised takes the default."""
    raw = ws_trim(F.coalesce("max_raw", F.lit("")))
    number = F.when(raw.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), raw.try_cast("double"))
    keyword = F.lower(ws_trim(F.coalesce("keyword_raw", F.lit(""))))
    return df.withColumns(
        {
            "rewrite": _flag(F.col("rewrite_raw"), True),
            "max_results": F.when(number.isNull(), F.lit(L.DEFAULT_RESULTS))
            .otherwise(F.least(F.lit(L.MAX_RESULTS), F.greatest(F.lit(1), F.floor(number + 0.5))))
            .cast("bigint"),
            "keyword_mode": F.when(keyword.isin("or", "and"), keyword).otherwise("and"),
            "length_style": F.when(F.col("length_raw") == "concise", "concise").otherwise("detailed"),
            "familiarity": F.when(F.col("familiarity_raw") == "experienced", "experienced").otherwise("new"),
        }
    )
