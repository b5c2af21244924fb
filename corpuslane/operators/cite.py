"""Citation verification: exact, fuzzy and title joins between quotes and corpus lines."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslane.functions import lexicon as L
from corpuslane.functions.text import (
    bigrams, bind, chain, col, display_line, display_title, match_key, sub, title_stem, tokens, unroll, ws_trim,
)
from corpuslane.operators.answers import clean_head, drop_identity_question
from corpuslane.operators.lines import readable
from corpuslane.session import materialize

# the same words, and the breaks between sentences, in Python's terms
_WORD = re.compile("[^\\W_](?:[“”‘’\"']*[^\\W_])*[“”‘’\"']*")
_STOP = re.compile("(?<=[.!?])[ \\t\\n\\x0b\\f\\r]+(?=[A-Z“\"(])")
# --- notes of unmatched and unknown citations (fixed values) ---
UNVERIFIED = "Not found word for word in this SOP. Open it to check the wording:"
UNKNOWN = "Not one of the SOPs found for this answer, so it could not be checked."


def prepare_quotes(quotes: DataFrame, text: str = "quote", typed: bool = True) -> DataFrame:
    """Adds ``qkey``, ``qtoks`` and ``qn``; quotes with no words are dropped. A ``typed`` quote is one of an answer: the addresses
    written into it are not of the quoted line. Other quotes are lines themselves and keep theirs, as the lines do that they are to meet."""
    return (
        quotes.withColumn("qkey", match_key(display_line(sub(text, L.TYPED_URL) if typed else text)))
        .filter(F.col("qkey") != "")
        .withColumn("qtoks", tokens("qkey"))
        .withColumn("qn", F.size("qtoks"))
    )


def _scope(quotes: DataFrame) -> list[str]:
    return ["file"] if "file" in quotes.columns else []


def handles(toks: Column, repeats: bool) -> Column:
    """64-bit hashes of a text's neighbouring token pairs, in order."""
    pairs = F.zip_with(F.slice(toks, F.lit(1), F.size(toks) - 1), F.slice(toks, F.lit(2), F.size(toks) - 1), lambda a, b: F.xxhash64(a, b))
    return pairs if repeats else F.array_distinct(pairs)


def postings(lines: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """``file, line, handle`` of every token pair and token of the lines that ``wanted`` holds.

    Only ids and hashes are unrolled, and what no quote asks for leaves before the first shuffle that follows.
    """
    words = lines.select("file", "line", tokens("key").alias("_w"))
    held = F.concat(
        F.when(F.size("_w") > 1, handles(F.col("_w"), False)).otherwise(F.array().cast("array<bigint>")),
        F.array_distinct(F.transform("_w", lambda w: F.xxhash64(w))),
    )
    return unroll(words, ["file", "line"], held, "_i", "handle").drop("_i").join(wanted, on, "left_semi")


def candidates(quotes: DataFrame, lines: DataFrame, keys: list[str], near: Column) -> DataFrame:
    """``keys, file, line`` of every line that may hold a quote, or resemble it where ``near`` says so.

    Quotes meet lines on their rarest handles by count over the lines: a quote inside a line needs its rarest
    pair only (a one-word quote its word). For a likeness of 0.75 half of the pairs must be shared, so a line must hold
    one of any ``n - ceil(n/2) + 1`` of a quote's ``n`` pairs: the rarest ones lose nothing and meet the fewest.
    """
    scope = _scope(quotes)
    own = F.when(F.size("qtoks") > 1, handles(F.col("qtoks"), True)).otherwise(F.transform("qtoks", lambda w: F.xxhash64(w)))
    n = F.greatest(F.col("qn") - 1, F.lit(1))
    take = F.when(near, n - F.ceil(n / 2).cast("int") + 1).otherwise(1)
    seen = unroll(quotes, [*keys, *scope, take.alias("_take")], own, "_place", "handle")
    on = ["handle", *scope]
    found = materialize(postings(lines, seen.select(*on).distinct(), on), "postings")
    counts = found.groupBy("handle").agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*keys, *scope).orderBy(F.coalesce("_n", F.lit(0)), "handle", "_place")
    rarest = seen.join(counts, "handle", "left").withColumn("_rank", F.row_number().over(order)).filter("_rank <= _take AND _n IS NOT NULL")
    return rarest.select(*keys, *on).join(found, on).select(*keys, "file", "line").distinct()


_COMPARED = T.StructType(
    [T.StructField(n, T.DoubleType() if n == "overlap" else T.IntegerType()) for n in ("at", "overlap", "covered", "from_tok", "to_tok")]
)


@F.arrow_udf(_COMPARED)
def compare(quotes: pa.Array, lines: pa.Array) -> pa.Array:
    """Each quote against a line, in time linear in both: where it stands as a whole (or -1), the share of its
    neighbouring pairs in the line, and how many of its words follow each other there, in order, from where to where."""
    out, last = [], None
    for quote, line in zip(quotes.to_pylist(), lines.to_pylist()):
        if line != last:
            last, words = line, line.split(" ")
            pairs, places = set(zip(words, words[1:])), defaultdict(list)
            for i, w in enumerate(words):
                places[w].append(i)
        at = f" {line} ".find(f" {quote} ")
        wanted = quote.split(" ")
        shared = sum(p in pairs for p in zip(wanted, wanted[1:])) / max(len(wanted) - 1, 1)
        cursor, covered, first, end = 0, 0, -1, -1
        for w in wanted:
            own = places.get(w, ())
            k = bisect_left(own, cursor)
            if k < len(own):
                end = own[k]
                first, covered, cursor = (end if first < 0 else first), covered + 1, end + 1
        out.append((line.count(" ", 0, at) if at > 0 else at, shared, covered, first, end))
    columns = list(zip(*out)) if out else [()] * 5
    kinds = (pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["at", "overlap", "covered", "from_tok", "to_tok"])


def matches(quotes: DataFrame, lines: DataFrame, keys: list[str], near: Column | None = None) -> DataFrame:
    """Quote and line pairs that were compared: ``quotes`` columns, ``file``, ``line`` and the fields of ``compare``.

    ``keys`` name a quote; a ``file`` column of ``quotes`` scopes it to that file. Texts are read back
    for candidates only.
    """
    scope = _scope(quotes)
    near = F.lit(False) if near is None else near
    pairs = candidates(quotes, lines, keys, near & (F.col("qn") >= L.QUOTE_MIN_TOKENS))
    met = pairs.join(quotes.drop("qtoks"), [*keys, *scope]).join(lines.select("file", "line", "key"), ["file", "line"])
    return met.withColumn("_c", compare("qkey", "key")).select(*[c for c in met.columns if c != "key"], "_c.*")


def likeness() -> Column:
    """Half in-order token coverage, half pair overlap."""
    return 0.5 * F.col("covered") / F.col("qn") + 0.5 * F.col("overlap")


def resembles() -> Column:
    """A line like a quote that is long enough to be evidence, without being scattered over it."""
    dense = F.col("to_tok") - F.col("from_tok") + 1 <= 2 * F.col("qn")
    return (F.col("qn") >= L.QUOTE_MIN_TOKENS) & (F.col("from_tok") >= 0) & dense & (likeness() >= L.QUOTE_THRESHOLD)


def exact_hits(quotes: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Every line holding a quote as a contiguous, token-aligned run."""
    held = matches(quotes, lines, keys).filter("at >= 0")
    end = F.col("at") + F.col("qn") - 1
    return held.withColumns({"from_tok": F.col("at").cast("bigint"), "to_tok": end.cast("bigint"), "score": F.lit(1.0)}).drop("at", "overlap", "covered")


def fuzzy_pairs(quotes: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Quote and line pairs sharing at least half of the quote's neighbouring pairs."""
    return matches(quotes.filter(F.col("qn") >= L.QUOTE_MIN_TOKENS), lines, keys, F.lit(True)).filter(F.col("overlap") >= 2 * L.QUOTE_THRESHOLD - 1)


def best_lines(found: DataFrame, keys: list[str]) -> DataFrame:
    """Per quote and file: ``n_lines`` that hold the quote, the first of them (``held``), and the most alike line (``alike``, the
    earlier one wins a tie)."""
    whole = F.struct("line", F.col("at").cast("bigint").alias("from_tok"), (F.col("at") + F.col("qn") - 1).cast("bigint").alias("to_tok"), F.lit(1.0).alias("score"))
    near = F.struct("line", F.col("from_tok").cast("bigint").alias("from_tok"), F.col("to_tok").cast("bigint").alias("to_tok"), likeness().alias("score"))
    exact, like = F.col("at") >= 0, resembles()
    return found.groupBy(*keys, "file", "qn").agg(
        F.count_if(exact).alias("n_lines"),
        F.min_by(F.when(exact, whole), F.when(exact, F.col("line"))).alias("held"),
        F.max_by(F.when(like, near), F.when(like, F.struct(likeness().alias("score"), (-F.col("line")).alias("line")))).alias("alike"),
    )


def fuzzy_hits(quotes: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines scoring at least the threshold for quotes long enough to be evidence."""
    return fuzzy_pairs(quotes, lines, keys).filter(resembles()).withColumn("score", likeness())


def best_fuzzy(quotes: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Best fuzzy line per quote and file."""
    found = best_lines(fuzzy_pairs(quotes, lines, keys), keys).filter(F.col("alike").isNotNull())
    return found.select(*keys, "file", "qn", "alike.*").withColumn("exact", F.lit(False))


def find_quotes(quotes: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """One accepted line per quote and file.

    A single exact line is accepted at any length; several only for a quote long enough to be
    evidence (the first line wins); with no exact line the best fuzzy line is taken.
    """
    found = best_lines(matches(quotes, lines, keys, F.lit(True)), keys)
    sure = (F.col("n_lines") == 1) | (F.col("qn") >= L.QUOTE_MIN_TOKENS)
    taken = F.when(F.col("n_lines") == 0, F.col("alike")).when(sure, F.col("held"))
    return found.withColumn("_t", taken).filter(F.col("_t").isNotNull()).select(*keys, "file", "qn", "_t.*", (F.col("n_lines") > 0).alias("exact"))


# --- titles ------------------------------------------------------------------------


def title_tokens(title: Column | str) -> Column:
    shown = display_title(title)
    bare = F.when(F.contains(col(title), F.lit("(")), sub(shown, rf"(?i)\s*\([^)]*{L.W0}draft{L.W1}[^)]*\)\s*$")).otherwise(shown)
    return F.transform(tokens(readable(bare)["key"]), title_stem)


def _leading(title: list[str], words: list[str]) -> tuple[int, int]:
    """Length of the longest leading run of title words inside ``words``, and where it first stands; (0, -1) below the floor
    of two words (one for a one-word title)."""
    best, where = 0, -1
    for at in [i for i, w in enumerate(words) if title and w == title[0]]:
        k = 1
        while k < len(title) and at + k < len(words) and words[at + k] == title[k]:
            k += 1
        if k > best:
            best, where = k, at
    return (best, where) if best >= min(2, len(title)) else (0, -1)


@F.arrow_udf(T.LongType())
def leading_run(titles: pa.Array, heads: pa.Array) -> pa.Array:
    return pa.array([_leading(t, h)[0] or None for t, h in zip(titles.to_pylist(), heads.to_pylist())], pa.int64())


def resolve_titles(heads: DataFrame, titles: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Titles named by each head: the longest leading run of title words inside it.

    ``heads(head_id, head)``, ``titles(file, title, rank)``; ``on`` scopes both sides by shared
    columns. Two words are the floor (one for a one-word title). Candidates meet on the hash of
    that floor run; words are read back for them only, and longer runs checked then.
    """
    on = on or []
    ids = [c for c in heads.columns if c != "head"]
    own = [c for c in titles.columns if c not in on]
    floor = F.when(F.size("_t") == 1, F.xxhash64(F.get("_t", F.lit(0)))).otherwise(F.xxhash64(F.get("_t", F.lit(0)), F.get("_t", F.lit(1))))
    t = titles.withColumn("_t", title_tokens("title")).filter(F.size("_t") > 0).withColumn("handle", floor)
    words = heads.select(*ids, F.transform(tokens(match_key(display_line("head"))), title_stem).alias("_h"))
    words = materialize(words, "head-words")
    held = F.concat(
        F.when(F.size("_h") > 1, handles(F.col("_h"), False)).otherwise(F.array().cast("array<bigint>")),
        F.array_distinct(F.transform("_h", lambda w: F.xxhash64(w))),
    )
    met = unroll(words, ids, held, "_i", "handle").drop("_i").join(t, [*on, "handle"]).select(*ids, *own, "_t")
    pairs = met.join(words, ids).withColumn("length", leading_run("_t", "_h"))
    return pairs.filter(F.col("length").isNotNull()).drop("_t", "_h")


def best_title(matches: DataFrame, keys: list[str]) -> DataFrame:
    order = F.struct("length", -F.col("rank"))
    return matches.groupBy(*keys).agg(F.max_by(F.struct("file", "length", "rank"), order).alias("_b")).select(*keys, "_b.*")


# --- expansion -----------------------------------------------------------------------


@F.arrow_udf(T.StringType())
def covering_sentences(displays: pa.Array, firsts: pa.Array, lasts: pa.Array) -> pa.Array:
    """The sentences of each line that hold its tokens from first to last, in time linear in the line."""
    out = []
    for line, first, last in zip(displays.to_pylist(), firsts.to_pylist(), lasts.to_pylist()):
        if line is not None:
            words = [m.span() for m in _WORD.finditer(line)]
            start = words[first][0] if first is not None and 0 <= first < len(words) else 0
            end = max((words[last][1] if last is not None and 0 <= last < len(words) else len(line)) - 1, 0)
            breaks = [m.span() for m in _STOP.finditer(line)]
            line = line[max((b for _, b in breaks if b <= start), default=0) : min((a for a, _ in breaks if a > end), default=len(line))]
        out.append(line)
    return pa.array(out, pa.string())


def expand_quote(display: Column | str, from_tok: Column | str, to_tok: Column | str, quoted: Column | str, table: Column | str) -> Column:
    """The quotation shown for a hit: the whole line, or the sentences it covers, capped at a word."""
    def cap(s: Column) -> Column:
        cut = F.left(s, F.lit(L.QUOTE_MAX_CHARS - 1))
        at_word = F.when(cut.rlike(r"^[\s\S]+ "), sub(cut, r" [^ ]*$")).otherwise(cut)
        return F.when(F.char_length(s) <= L.QUOTE_MAX_CHARS, s).otherwise(F.concat(sub(at_word, rf"{L.WS}+$"), F.lit("…")))

    d = col(display)
    shown = F.when(~col(quoted) & ~col(table) & (F.char_length(d) <= L.QUOTE_MAX_CHARS), d).otherwise(ws_trim(covering_sentences(d, col(from_tok).cast("int"), col(to_tok).cast("int"))))
    return sub(bind(shown, cap), "[\"“”]", "'")


# --- resolution -------------------------------------------------------------------------


_QUOTATION = str.maketrans("", "", "“”‘’\"'")


@F.arrow_udf(T.StringType())
def after_title(heads: pa.Array, titles: pa.Array) -> pa.Array:
    """What stands behind the longest leading run of a title's words in each head, or the whole head."""
    out = []
    for head, title in zip(heads.to_pylist(), titles.to_pylist()):
        if head is not None and title:
            found = list(_WORD.finditer(head))
            words = [m[0].lower().translate(_QUOTATION) for m in found]
            words = [w[:-1] if len(w) >= 4 and w.endswith("s") else w for w in words]
            size, at = _leading(title, words)
            head = head[found[at + size - 1].end() :] if size else head
        out.append(head)
    return pa.array(out, pa.string())


def head_remainder(head: Column, title: Column) -> Column:
    """What is left of an item head after the title words it names."""
    rest = sub(head, rf"^{L.WS}*[0-9]{{1,2}}[.)]{L.WS}*")
    kept = after_title(rest, title)
    return ws_trim(
        chain(kept, (r"[\s,;:—–-]+$", ""), (r"^[\s,;:—–.-]+", ""), (rf"^{L.WS}*[0-9]{{1,2}}[.)]{L.WS}*", ""))
    )


def settled(quotes: DataFrame, files: DataFrame, lines: DataFrame, key: list[str]) -> DataFrame:
    """``key, file, line, ord, from_tok, to_tok, exact`` of the lowest tier that finds any of an item's quotes.

    Tier 0 is the labelled file, 1 an exact sweep over the item's ``files`` in order, 2 likeness inside the titled file
    of an item without a label. Only the labelled or titled file is compared for likeness.
    """
    qk = [*key, "ord"]
    known = F.coalesce("label_file", "title_file")
    scoped = quotes.join(files, key).withColumn("likely", F.coalesce(F.col("file") == known, F.lit(False)))
    found = matches(scoped.drop("quote"), lines, qk, F.col("likely"))
    sides = ["label_file", "title_file", "place", "likely"]
    per_file = best_lines(found, [*qk, *sides])
    long = F.col("qn") >= L.QUOTE_MIN_TOKENS
    total = F.sum("n_lines").over(Window.partitionBy(*qk))
    labelled = F.coalesce(F.col("file") == F.col("label_file"), F.lit(False))
    alike = (F.col("n_lines") == 0) & F.col("likely") & F.col("alike").isNotNull()
    held = F.col("n_lines") > 0
    tier = (
        F.when(labelled & held & ((F.col("n_lines") == 1) | long), 0).when(labelled & alike, 0)
        .when(held & ((F.col("total") == 1) | long), 1).when(alike & F.col("label_file").isNull(), 2)
    )
    rows = per_file.withColumn("total", total).withColumn("tier", tier).filter(F.col("tier").isNotNull())
    rows = rows.withColumn("hit", F.when(F.col("n_lines") > 0, F.col("held")).otherwise(F.col("alike"))).withColumn("exact", held)
    best = rows.groupBy(*key).agg(F.min(F.struct("tier", "place", "file")).alias("_w")).select(*key, "_w.tier", "_w.file")
    return (
        rows.join(best, [*key, "tier", "file"]).groupBy(*key, "file", "hit.line")
        .agg(F.min_by(F.struct("ord", "hit.from_tok", "hit.to_tok", "exact"), "ord").alias("_h")).select(*key, "file", "line", "_h.*")
    )


def resolve_citations(items: DataFrame, labels: DataFrame, ranked: DataFrame, lines: DataFrame) -> DataFrame:
    """Which file and lines each cited item really points to.

    ``items(answer_id, item, label, head, item_text, quotes)``, ``labels(answer_id, label, file)``,
    ``ranked(answer_id, file, title, rank)``, ``lines(file, line, key, display, section, quoted, table)``.

    Evidence is tried in order: the labelled file (exact, then fuzzy), an exact sweep over the
    answer's files in label, title, rank order, then fuzzy inside the titled file. The item's
    quotations are tried first, the item's own words second. Every candidate is a row with its
    tier, all joins are keyed by file and phrase, and the smallest tier wins.
    """
    key = ["answer_id", "item"]
    named = best_title(
        resolve_titles(items.select(*key, "head"), ranked, ["answer_id"]), key
    ).select(*key, F.col("file").alias("title_file"))
    base = (
        items.join(labels.withColumnRenamed("file", "label_file"), ["answer_id", "label"], "left")
        .join(named, key, "left")
        .withColumn("source", F.coalesce("label_file", "title_file"))
    )
    titles = ranked.select("answer_id", F.col("file").alias("source"), title_tokens("title").alias("source_title"))
    base = base.join(titles, ["answer_id", "source"], "left").withColumn(
        "remainder", head_remainder(clean_head(F.col("item_text")), F.col("source_title"))
    )
    base = materialize(base, "cited-items")
    files = (
        base.select(*key, F.explode(F.array_compact(F.array(
            F.when(F.col("label_file").isNotNull(), F.struct(F.col("label_file").alias("file"), F.lit(-2).cast("bigint").alias("place"))),
            F.when(F.col("title_file").isNotNull(), F.struct(F.col("title_file").alias("file"), F.lit(-1).cast("bigint").alias("place"))),
        ))).alias("_f")).select(*key, "_f.*")
        .unionByName(base.select(*key).join(ranked.select("answer_id", "file", F.col("rank").alias("place")), "answer_id").select(*key, "file", "place"))
        .groupBy(*key, "file").agg(F.min("place").alias("place"))
    )
    sides = ["label_file", "title_file"]
    # first the quotations; items that they settle are not tried again as a whole
    said = F.transform("quotes", lambda q, i: F.struct(i.alias("ord"), q.alias("quote")))
    first = settled(prepare_quotes(unroll(base, [*key, *sides], said, "_i", "_q").select(*key, *sides, "_q.*")), files, lines, key)
    first = materialize(first, "settled")
    rest = base.join(first.select(*key).distinct(), key, "left_anti").select(*key, *sides, F.lit(0).alias("ord"), F.col("remainder").alias("quote"))
    chosen = first.unionByName(settled(prepare_quotes(rest), files, lines, key))
    text = lines.select("file", "line", "display", "section", "quoted", "table")
    hits = chosen.join(text, ["file", "line"]).withColumn(
        "quote", expand_quote("display", "from_tok", "to_tok", "quoted", "table")
    )
    per_item = hits.groupBy(*key, "file").agg(
        F.array_sort(F.collect_list(F.struct("ord", "line", "quote", "section", "exact"))).alias("hits")
    )
    return (
        base.select(*key, "head", "source", "quotes", "remainder", "item_text").join(per_item, key, "left")
        .select(
            *key, "head", "item_text", "quotes", "remainder",
            F.coalesce("file", "source").alias("file"),
            F.get("hits", F.lit(0))["section"].alias("section"),
            F.transform("hits", lambda h: h["quote"]).alias("shown"),
            F.col("hits").isNotNull().alias("verified"),
            F.when(F.col("hits").isNotNull(), "matched").when(F.col("source").isNotNull(), "unmatched").otherwise("unknown").alias("kind"),
        )
    )


def rebuild_citations(resolved: DataFrame, meta: DataFrame, tails: DataFrame) -> DataFrame:
    """Citation block per answer from resolved items, with match counts.

    ``meta(file, title, source_url)``, ``tails(answer_id, heading, preamble, rest, held)``. An item
    whose file has no metadata is unknown, in the text and in the counts. When the rebuilt text
    would lose the gaps section the raw tail is kept and the counts are zero. A closing question
    that asks for an identifier is removed from whichever text is kept; ``dropped`` tells.
    """
    title = display_title("title")
    link = F.when(F.col("source_url").isNotNull(), F.concat(F.lit("["), title, F.lit("]("), F.col("source_url"), F.lit(")"))).otherwise(title)
    n = F.col("item").cast("string")
    said = F.when(F.size("quotes") > 0, display_line(sub(F.get("quotes", F.lit(0)), L.TYPED_URL))).otherwise(F.col("remainder"))
    named = F.coalesce(F.nullif("head", F.lit("")), clean_head(F.col("item_text")), F.lit(""))
    rendered = (
        F.when(F.col("kind") == "unknown", F.concat(sub(F.concat(n, F.lit(". "), named), rf"{L.WS}+$"), F.lit("\n   " + UNKNOWN)))
        .when(F.col("kind") == "unmatched", F.concat(n, F.lit(". "), link, F.lit("\n   "), ws_trim(F.concat(F.lit(UNVERIFIED + " "), said))))
        .otherwise(
            F.concat(
                n, F.lit(". "), link, F.when(F.col("section").isNotNull(), F.concat(F.lit(", "), F.col("section"))).otherwise(""), F.lit("\n"),
                F.array_join(F.transform("shown", lambda q: F.concat(F.lit('   "'), q, F.lit('"'))), "\n"),
            )
        )
    )
    blocks = (
        resolved.join(meta, "file", "left")
        .withColumn("kind", F.when(F.col("title").isNull(), "unknown").otherwise(F.col("kind")))
        .withColumn("one", rendered)
        .groupBy("answer_id")
        .agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item", "one"))), lambda x: x["one"]), "\n").alias("block"),
            F.count("*").alias("n_items"),
            F.count_if(F.col("kind") == "matched").alias("matched"),
            F.count_if(F.col("kind") == "unmatched").alias("unmatched"),
            F.count_if(F.col("kind") == "unknown").alias("unknown"),
        )
    )
    opening = F.concat_ws("\n", F.nullif("heading", F.lit("")), F.nullif("preamble", F.lit("")))
    body = F.concat(F.when(opening == "", F.lit("\n")).otherwise(F.concat(opening, F.lit("\n\n"))), F.col("block"))
    full = F.when(ws_trim("rest") == "", body).otherwise(F.concat(body, F.lit("\n\n"), ws_trim("rest")))
    has_gap = lambda c: F.contains(F.lower(c), F.lit("not covered by the sops"))
    out = tails.join(blocks, "answer_id", "left").withColumn("full", full)
    lost = F.col("block").isNull() | (has_gap(F.col("held")) & ~has_gap(F.col("full")))
    zero = lambda c: F.when(lost, 0).otherwise(F.col(c)).cast("bigint").alias(c.removeprefix("n_"))
    kept = out.select(
        "answer_id", F.when(lost, F.col("held")).otherwise(F.col("full")).alias("text"),
        zero("n_items"), zero("matched"), zero("unmatched"), zero("unknown"),
    )
    return drop_identity_question(kept, "text")


# --- cards, audits and mentions -------------------------------------------------------------


def mark_cited(ranked: DataFrame, citations: DataFrame) -> DataFrame:
    """Flag cited cards and attach the first verified quote."""
    ok = F.col("verified") & F.col("quote").isNotNull()
    per_file = citations.groupBy("query_id", "file").agg(
        F.min_by(F.when(ok, F.col("quote")), F.when(ok, F.col("ord"))).alias("quote")
    ).withColumn("cited", F.lit(True))
    return ranked.join(per_file, ["query_id", "file"], "left").withColumn("cited", F.coalesce("cited", F.lit(False)))


def audit_quotes(answers: DataFrame, citations: DataFrame, lines: DataFrame) -> DataFrame:
    """True when every citation of an answer is verified and equals a whole source line.

    Null when nothing was cited. Lines and quotes meet on file and text digest.
    """
    digest = lambda c: F.sha2(F.replace(c, F.lit('"'), F.lit("'")), 256)
    source = lines.select("file", digest(F.col("display")).alias("digest"), F.lit(True).alias("whole")).distinct()
    checked = citations.withColumn("digest", F.sha2(F.col("quote"), 256)).join(source, ["file", "digest"], "left")
    per = checked.groupBy("answer_id").agg(
        F.bool_and(F.col("verified") & F.coalesce("whole", F.lit(False))).alias("whole")
    )
    return answers.select("answer_id").distinct().join(per, "answer_id", "left")


def mention_dictionary(sources: DataFrame) -> DataFrame:
    """Title, short title and file mentions per linked source: ``clean``, ``url``, ``label``."""
    title = ws_trim(sub("title", r"^[^\p{L}\p{N}]+"))
    short = ws_trim(sub(display_title("title"), L.DRAFT_TITLE))
    none = F.lit(None).cast("string")
    mention = lambda c, lab: F.when(F.char_length(c) >= 4, F.struct(c.alias("clean"), lab.alias("label")))
    rows = F.array_compact(
        F.array(
            mention(title, none),
            F.when(short != title, mention(short, none)),
            mention(F.col("file"), F.coalesce(F.nullif(title, F.lit("")), F.col("file"))),
        )
    )
    return (
        sources.filter(F.col("source_url").isNotNull())
        .select(F.col("source_url").alias("url"), F.explode(rows).alias("m"))
        .select("m.clean", "url", "m.label")
        .withColumn("mkey", F.trim(sub(F.lower("clean"), r"[^\p{L}\p{N}]+", " ")))
    )


def mention_table(texts: DataFrame, key: str, text: str, dictionary: DataFrame) -> DataFrame:
    """Which mentions may occur in which text, met on the first words of the mention."""
    words = F.array_remove(F.split(F.lower(col(text)), r"[^\p{L}\p{N}]+", -1), "")
    d = dictionary.withColumn("anchor", F.array_join(F.slice(F.split("mkey", " "), 1, 2), " "))
    w = texts.select(key, words.alias("_w")).withColumn("_runs", F.array_distinct(F.concat(F.col("_w"), bigrams("_w"))))
    # only ids travel with the runs; the text is read again for the few candidates
    candidates = materialize(
        unroll(w, [key], "_runs", "_i", "anchor").drop("_i").join(d, "anchor").drop("anchor"), "mentions"
    )
    padded = texts.select(key, F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")).alias("_padded"))
    return (
        padded.join(candidates, key)
        .filter(F.contains("_padded", F.concat(F.lit(" "), F.col("mkey"), F.lit(" "))))
        .select(key, "clean", "url", "label")
    )


LINK_REGION = r"\[[^\]]*(?:\](?:\([^)]*\)?)?)?"


def link_mentions(texts: DataFrame, key: str, text: str, dictionary: DataFrame) -> DataFrame:
    """Link every mention on word edges, longest first, never inside an existing link."""
    found = mention_table(texts, key, text, dictionary).groupBy(key).agg(
        F.array_sort(F.collect_set(F.struct((-F.char_length("clean")).alias("n"), "clean", "url", "label"))).alias("_m")
    )

    def apply(acc: Column, m: Column) -> Column:
        pattern = F.concat(
            F.lit(r"(?iu)(?<![\p{L}\p{N}])\*{0,2}("), F.lit("\\Q"), m["clean"], F.lit("\\E"), F.lit(r")\*{0,2}(?![\p{L}\p{N}])")
        )
        label = F.when(m["label"].isNull(), F.lit("$1")).otherwise(sub(m["label"], r"([\\$])", r"\\$1"))
        target = F.concat(F.lit("["), label, F.lit("]("), sub(m["url"], r"([\\$])", r"\\$1"), F.lit(")"))
        outside = F.transform(F.split(acc, LINK_REGION, -1), lambda gap: F.regexp_replace(gap, pattern, target))
        links = F.concat(F.regexp_extract_all(acc, F.lit(LINK_REGION), F.lit(0)), F.array(F.lit("")))
        return F.array_join(F.zip_with(outside, links, lambda g, link: F.concat(g, link)), "")

    linked = F.aggregate(F.coalesce("_m", F.array().cast("array<struct<n:int,clean:string,url:string,label:string>>")), col(text), apply)
    return texts.join(found, key, "left").withColumn("linked", linked).drop("_m")


