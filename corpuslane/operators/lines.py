"""Markdown documents as line tables: headings carried forward, fences cut."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslane.functions import lexicon as L
from corpuslane.functions.text import (
    BLOCKQUOTE, FENCE, HEADING, PICTOGRAPH, TABLE_ROW, chain, col, display_line, is_blank, lines_of, tokens, unroll,
)

PLAIN, HEAD, FENCE_MARK = 0, 1, 2


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def nearest_heading(kinds: pd.Series) -> pd.Series:
    """Per line: index of the heading in force, -1 before any, -2 inside or on a fence.

    Only small integers cross to Python, never text. Headings inside a fence do not count.
    """

    def one(row) -> np.ndarray:
        k = np.asarray(row)
        fence = k == FENCE_MARK
        fenced = fence | (np.cumsum(fence) % 2 == 1)
        at = np.where((k == HEAD) & ~fenced, np.arange(len(k)), -1)
        return np.where(fenced, -2, np.maximum.accumulate(at) if len(at) else at).astype(np.int32)

    return kinds.map(one)


# the patterns of ``text.display_line`` and ``text.match_key`` in Python's terms; Java's dot and dollar know more line ends
_WS = f"[{L.WS_CHARS}]"
_END = r"(?=(?:\r\n|[\n\r\x85\u2028\u2029])?\Z)"
_QUOTED = re.compile(r"[ \t]*(?:>[ \t]*)+")
_MARKER = re.compile(rf"{_WS}*(?:>{_WS}*)?(?:[-*+]{_WS}+(?:\[[ xX]\]{_WS}+)?|[0-9]+[.)]{_WS}+|#{{1,6}}{_WS}+)")
_ROW = re.compile(rf"[ \t]*\|[^\n\r\x85\u2028\u2029]*\|[ \t]*{_END}")
_BAR = re.compile(rf"\|{_END}")
_RULE = re.compile(rf":?-+:?{_END}")
_LINK = re.compile(r"\[([^\[\]\n]{0,200})\]\([^) \t\n\x0b\f\r]*\)")
_FOLD = re.compile(r"</?(?:details|summary)>")
_BOLD = re.compile(r"\*\*|__")
_PICTURE = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), PICTOGRAPH))
_BLANKS = re.compile(r"[ \t]+")
_WORDS = re.compile(r"[^\W_]+")


def _display(line: str) -> str:
    if ">" in line and (hit := _QUOTED.match(line)):
        line = line[hit.end() :]
    if hit := _MARKER.match(line):
        line = line[hit.end() :]
    if "|" in line and _ROW.match(line):
        cells = [c.strip(L.WS_CHARS) for c in _BAR.sub("", line.strip(L.WS_CHARS).removeprefix("|")).split("|")]
        line = "" if all(_RULE.match(c) for c in cells) else "; ".join(filter(None, cells))
    if "](" in line:
        line = _LINK.sub(r"\1", line)
    if "<" in line:
        line = _FOLD.sub("", line)
    if "**" in line or "__" in line:
        line = _BOLD.sub("", line)
    if not line.isascii():
        line = _PICTURE.sub("", line).replace("\xa0", " ")
    if "\t" in line or "  " in line:
        line = _BLANKS.sub(" ", line)
    return line.strip(L.WS_CHARS)


def _key(display: str) -> str:
    low = display.lower()
    for mark in "“”‘’\"'":
        low = low.replace(mark, "")
    return " ".join(_WORDS.findall(low))


@F.arrow_udf(T.StructType([T.StructField("display", T.StringType()), T.StructField("key", T.StringType())]))
def readable(lines: pa.Array) -> pa.Array:
    """``text.display_line`` of each line and its ``text.match_key``, with the same results, for a batch of lines at once."""
    shown = [None if line is None else _display(line) for line in lines.to_pylist()]
    keys = [None if line is None else _key(line) for line in shown]
    return pa.StructArray.from_arrays([pa.array(shown, pa.string()), pa.array(keys, pa.string())], ["display", "key"])


def line_kinds(lines: Column) -> Column:
    return F.transform(
        lines,
        lambda x: F.when(x.rlike(FENCE), F.lit(FENCE_MARK)).when(x.rlike(HEADING), F.lit(HEAD)).otherwise(F.lit(PLAIN)),
    )


def clean_heading(raw: Column) -> Column:
    shown = chain(display_line(raw), (r":[ \t]*$", ""), ("[“”]", '"'), ("[‘’]", "'"))
    return F.nullif(F.trim(shown), F.lit(""))


def index_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Every quotable line with the heading above it.

    Headings, blanks, fenced code and table separators are not quotable. The carry-forward
    happens inside the row, so documents are never shuffled to build their line table.
    """
    # a text without a heading or a fence has no line to classify
    marked = F.contains(col(text), F.lit("#")) | F.contains(col(text), F.lit("```")) | F.contains(col(text), F.lit("~~~"))
    lined = docs.select(key, lines_of(text).alias("_lines"), marked.alias("_marked"))
    kinds = F.when(F.col("_marked"), line_kinds(F.col("_lines"))).otherwise(F.array().cast("array<int>"))
    owner = F.when(F.col("_marked"), nearest_heading(kinds)).otherwise(F.array_repeat(F.lit(-1), F.size("_lines")))
    owned = lined.withColumn("_owner", owner)
    heading = F.transform("_owner", lambda o: F.get(F.col("_lines"), o)).alias("heading")
    zipped = F.arrays_zip(F.col("_lines").alias("raw"), F.col("_owner").alias("owner"), heading)
    raw = unroll(owned, [key], zipped, "index", "_l").select(key, "index", "_l.raw", "_l.owner", "_l.heading")
    shown = (
        raw.filter((F.col("owner") != -2) & (F.col("owner") != F.col("index")) & ~is_blank("raw"))
        .withColumn("_shown", readable("raw"))
        .filter(F.col("_shown.key") != "")
    )
    return shown.select(
        key,
        F.col("index").cast("bigint").alias("line"),
        "raw",
        "_shown.display",
        "_shown.key",
        F.when(F.col("owner") >= 0, clean_heading(F.col("heading"))).alias("section"),
        F.col("raw").rlike(BLOCKQUOTE).alias("quoted"),
        F.col("raw").rlike(TABLE_ROW).alias("table"),
    )


def with_tokens(lines: DataFrame) -> DataFrame:
    return lines.withColumn("toks", tokens("key"))


def html_to_markdown(html: Column | str) -> Column:
    """Page markup as markdown: headings, list items, paragraphs; advert blocks become fences."""
    return chain(
        col(html),
        (r"<title>[^<]*</title>|<style>[^<]*</style>|<script>[\s\S]*?</script>", ""),
        (r"<nav>", "\n## Menu\n"),
        (r"<article>", "\n## Article:\n"),
        (r"<footer>", "\n## Footer\n"),
        (r"<div class=\"ad\">|</div>", "\n```\n"),
        (r"<h1>", "\n# "),
        (r"</h1>|<br>|</ul>", "\n"),
        (r"<li>", "\n- "),
        (r"<p>", "\n\n"),
        (r"<[^>]*>", ""),
        (r"&amp;", "&"),
    )
