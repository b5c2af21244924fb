"""Budgeted context assembly: windows, packing and conversation history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslane.functions import lexicon as L
from corpuslane.functions.text import bind, chars, col, is_blank, unroll, ws_trim
from corpuslane.operators.retrieve import section_of, strip_header


def last_window(text: Column | str, size: int = L.SCREEN_WINDOW, overlap: int = L.SCREEN_OVERLAP) -> Column:
    """Number of the last window of a text, from 0."""
    n = F.char_length(col(text))
    return F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / F.lit(float(size - overlap)))).cast("int")


def window_array(text: Column | str, size: int = L.SCREEN_WINDOW, overlap: int = L.SCREEN_OVERLAP) -> Column:
    """Overlapping windows that together cover the whole text."""
    step = size - overlap

    def cut(t: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), last_window(t, size, overlap)), lambda k: F.substr(t, k * step + 1, F.lit(size)))

    return bind(col(text), cut)


def window_at(text: Column | str, k: Column | str, size: int = L.SCREEN_WINDOW, overlap: int = L.SCREEN_OVERLAP) -> Column:
    """Window number ``k`` alone, or null past the last one."""
    t, step = col(text), size - overlap
    inside = (col(k) == 0) | ((col(k) - 1) * step + size < F.char_length(t))
    return F.when(inside, F.substr(t, (col(k) * step + 1).cast("int"), F.lit(size)))


def text_windows(df: DataFrame, text: str = "text", size: int = L.SCREEN_WINDOW, overlap: int = L.SCREEN_OVERLAP) -> DataFrame:
    keep = [c for c in df.columns if c != text]
    return unroll(df, keep, window_array(text, size, overlap), "win", "window_text")


def pack_context(ranked: DataFrame, hits: DataFrame, meta: DataFrame, budget: int = L.PASSAGE_CHARS, full: int = L.FULL_DOCUMENTS) -> DataFrame:
    """Passages of each request: whole documents first, then the remaining chunks.

    ``ranked(query_id, file, rank)``, ``hits(query_id, pos, file, chunk_text)``,
    ``meta(file, title, body, status)``. Both phases stop at their first overflow; lengths are
    never negative, so that is a running sum within the budget. A query has at most a handful
    of ranked files and a bounded result list, so each window partition is small.
    """
    body = (
        ranked.filter(F.col("rank") <= full)
        .join(meta, "file")
        .withColumn("text", ws_trim("body"))
        .filter(F.col("text") != "")
        .withColumn("chars", chars("text"))
    )
    by_rank = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    whole = (
        body.withColumn("used", F.sum("chars").over(by_rank)).filter(F.col("used") <= budget)
        .select("query_id", "file", "title", F.lit("full").alias("kind"), "text", "chars",
                (F.col("status") == "draft").alias("draft"), F.col("rank").alias("ord"), F.lit(0).alias("phase"))
    )
    chunk = (
        hits.withColumn("text", ws_trim(strip_header(ws_trim(F.coalesce("chunk_text", F.lit(""))))))
        .filter(F.col("text") != "")
        .join(whole.select("query_id", "file"), ["query_id", "file"], "left_anti")
        .join(meta.select("file", "title", "status"), "file", "left")
        .select("query_id", "file", F.coalesce("title", F.lit("Untitled SOP")).alias("title"), F.lit("chunk").alias("kind"),
                "text", chars("text").alias("chars"), F.coalesce(F.col("status") == "draft", F.lit(False)).alias("draft"),
                F.col("pos").alias("ord"), F.lit(1).alias("phase"))
    )
    order = Window.partitionBy("query_id").orderBy("phase", "ord")
    return (
        whole.unionByName(chunk)
        .withColumn("used", F.sum("chars").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .filter(F.col("used") <= budget)
        .withColumn("label", F.row_number().over(order).cast("bigint"))
        .withColumn("section", F.when(F.col("kind") == "chunk", section_of("text")))
        .select("query_id", "label", "file", "title", "kind", "text", "chars", "draft", "used", "section")
    )


def passage_budget(df: DataFrame) -> DataFrame:
    """Characters left for passages, clamped to [0, PASSAGE_CHARS]."""
    window = (L.WINDOW_TOKENS - L.OUTPUT_TOKENS - L.RESERVE_TOKENS) * L.CHARS_PER_TOKEN
    room = F.lit(window) - F.col("system_chars") - F.col("history_chars") - F.col("message_chars") - F.col("rules_chars")
    return df.withColumn(
        "budget", F.greatest(F.lit(0), F.least(F.lit(L.PASSAGE_CHARS), F.floor(room))).cast("bigint")
    )


def usable_turns(turns: DataFrame) -> DataFrame:
    return turns.filter(~F.coalesce("notice", F.lit(False)) & ~is_blank("content"))


def trim_history(turns: DataFrame, max_messages: int = L.HISTORY_TURNS, budget: int = L.HISTORY_CHARS) -> DataFrame:
    """The latest usable turn plus prior turns, newest first, within count and size.

    The count limit is applied before the running sum, so each partition of the second
    window holds at most ``max_messages`` rows however long the conversation is.
    """
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    sized = usable_turns(turns).withColumn(
        "replay_chars",
        chars("content")
        + F.when(
            (F.col("role") == "assistant") & F.col("coverage").isNotNull(),
            chars(F.concat(F.lit("Coverage: "), F.col("coverage"), F.lit("\n\n"))),
        ).otherwise(0),
    )
    recent = sized.withColumn("age", F.row_number().over(newest)).filter(F.col("age") <= max_messages)
    prior = F.sum(F.when(F.col("age") > 1, F.col("replay_chars")).otherwise(0)).over(
        newest.rowsBetween(Window.unboundedPreceding, 0)
    )
    return recent.withColumn("used", prior.cast("bigint")).filter((F.col("age") == 1) | (F.col("used") <= budget))


def request_text(passages: DataFrame, requests: DataFrame) -> DataFrame:
    """One request text per query: passages in label order, rules, owner block, message."""
    block = F.concat(
        F.lit("["), F.col("label").cast("string"), F.lit("] "), F.col("title"),
        F.when(F.col("kind") == "full", F.lit(" | full document"))
        .when(F.col("section").isNotNull(), F.concat(F.lit(" | "), F.col("section"))).otherwise(""),
        F.lit(" | no link\n"), F.col("text"),
    )
    joined = passages.groupBy("query_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("label", block.alias("b")))), lambda x: x["b"]), "\n\n"
        ).alias("passages")
    )

    def optional(c):
        return F.when(F.coalesce(c, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit("\n\n"), c))

    return requests.join(joined, "query_id", "left").select(
        "query_id",
        F.concat(
            F.lit("SOP passages\n\n"), F.coalesce("passages", F.lit("")),
            optional(F.col("rules_block")), optional(F.col("owner_block")),
            F.lit("\n\nTeam member's message:\n\n"), F.col("message"),
        ).alias("request"),
    )


def cut_to_ceiling(entries: DataFrame, keys: list[str], order: list, text: str, ceiling: int, sep: int = 2) -> DataFrame:
    """Keep whole entries, in order, while their joined length stays within ``ceiling``.

    With a separator every kept entry costs at least that much, so no more than
    ``ceiling / sep + 1`` can fit; that rank limit prunes a hot key before the shuffle and loses
    nothing. Without one, empty entries cost nothing and no such limit holds.
    """
    order_w = Window.partitionBy(*keys).orderBy(*order)
    used = F.sum(chars(text) + sep).over(order_w.rowsBetween(Window.unboundedPreceding, 0)) - sep
    placed = entries.withColumn("place", F.row_number().over(order_w).cast("bigint"))
    if sep > 0:
        placed = placed.filter(F.col("place") <= ceiling // sep + 1)
    return placed.withColumn("used", used.cast("bigint")).filter(F.col("used") <= ceiling)
