"""Structured answers: coverage declarations, sections, citation tails and grading."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslane.functions import lexicon as L
from corpuslane.functions.text import (
    PICTURES, bind, chain, col, find, find_all, is_blank, lines_of, spans, sub, unroll, ws_trim,
)

DECLARATION = (
    r"(?i)^[ \t]*(\*\*|__)?[ \t]*coverage[ \t]*[:–—-][ \t]*(full|partial|none)(?![a-z0-9])"
    r"\.?[ \t]*(\*\*|__)?[ \t]*"
)
BODY_HEADING = r"(?i)^(?:Situation|Answer|Who handles this)[ \t]*:"
LENIENT = rf"(?i)^{L.WS}*(?:\*\*{L.WS}*)?coverage{L.WS}*[:\-–—]{L.WS}*(full|partial|none){L.W1}(?:[.*]|{L.WS}){{0,4}}"
TAIL_HEADING = (
    r"(?im)^[ \t]*(?:#{1,6}[ \t]+)?(?:\*\*|__)?[ \t]*what the sops say(?:[ \t]*(?:\*\*|__))?[ \t]*(?::|\r?\n)"
)


def first_index(lines: Column, test) -> Column:
    """0-based index of the first line passing ``test``, or null."""
    return F.nullif(F.array_position(F.transform(lines, test), F.lit(True)), F.lit(0)) - 1


def from_line(lines: Column, start: Column) -> Column:
    """Lines from 0-based ``start`` on, joined by newlines."""
    n = F.greatest(F.size(lines) - start, F.lit(0)).cast("int")
    return F.array_join(F.slice(lines, (start + 1).cast("int"), n), "\n")


# --- coverage ----------------------------------------------------------------


def split_coverage(df: DataFrame, text: str) -> DataFrame:
    """Lenient declaration: value on the first non-blank line and what follows it."""
    lines = F.split(col(text), r"\r?\n", -1)
    at = first_index(lines, lambda x: ~is_blank(x))
    line = F.get(lines, at.cast("int"))
    hit = find(line, LENIENT)
    left = F.substr(line, F.char_length(hit) + 1)
    tail = F.slice(lines, (at + 2).cast("int"), F.greatest(F.size(lines) - at - 1, F.lit(0)).cast("int"))
    skip = F.coalesce(first_index(tail, lambda x: ~is_blank(x)), F.size(tail).cast("bigint"))
    rest = F.when(left != "", F.concat_ws("\n", left, F.when(F.size(tail) > 0, F.array_join(tail, "\n")))).otherwise(
        from_line(tail, skip)
    )
    found = at.isNotNull() & line.rlike(LENIENT)
    return df.withColumns(
        {
            "coverage": F.when(found, F.lower(find(line, LENIENT, 1))),
            "rest": F.when(found, rest).otherwise(col(text)),
        }
    )


def gate_coverage(df: DataFrame, text: str) -> DataFrame:
    """Strict, fail-closed declaration decided on at most 256 characters.

    Adds ``coverage``, ``blocked`` (none/unconfirmed/null), ``reason`` and the ``body`` that
    may be shown.
    """
    t = col(text)
    short = F.char_length(t) < L.DECLARATION_CHARS
    head = F.substr(t, F.lit(1), F.lit(L.DECLARATION_CHARS))
    lead = find(head, rf"^{L.WS}*")
    after = F.substr(head, F.char_length(lead) + 1)
    newline = F.instr(after, "\n")
    line = sub(F.when(newline > 0, F.left(after, newline - 1)).otherwise(after), r"\r$")
    hit = find(line, DECLARATION)
    left = F.substr(line, F.char_length(hit) + 1)
    same_line = line.rlike(DECLARATION) & left.rlike(BODY_HEADING)
    decided = same_line | (newline > 0) | short
    valid = line.rlike(DECLARATION) & (find(line, DECLARATION, 1) == find(line, DECLARATION, 3)) & ((left == "") | same_line)
    value = F.lower(find(line, DECLARATION, 2))
    failed = (
        F.when((after == "") & short, "missing")
        .when((after == "") | ~decided, "invalid")
        .when(~valid, F.when(line.rlike("(?i)coverage"), "invalid").otherwise("missing"))
    )
    body_from = F.char_length(lead) + F.when(same_line, F.char_length(hit)).when(newline > 0, newline).otherwise(
        F.char_length(after)
    )
    return df.withColumn("_failed", failed).withColumns(
        {
            "coverage": F.when(F.col("_failed").isNotNull(), "none").otherwise(value),
            "blocked": F.when(F.col("_failed").isNotNull(), "unconfirmed").when(value == "none", "none"),
            "reason": F.coalesce("_failed", F.when(value == "none", "none")),
            "body": F.when(F.col("_failed").isNull() & (value != "none"), F.substr(t, body_from + 1)).otherwise(""),
        }
    ).drop("_failed")


# --- sections and counts -----------------------------------------------------


def _heading_at(lines: Column, words: str) -> Column:
    return first_index(lines, lambda x: x.rlike(rf"(?i)^(?:[#*]|{L.WS})*{words}{L.W1}"))


def step_count(text: Column | str) -> Column:
    """Numbered lines above the citation heading."""
    lines = F.split(col(text), r"\r?\n", -1)
    end = F.coalesce(_heading_at(lines, "what the sops say"), F.size(lines).cast("bigint"))
    scope = F.slice(lines, F.lit(1), end.cast("int"))
    return F.size(F.filter(scope, lambda x: x.rlike(rf"^{L.WS}*[0-9]+\.{L.WS}"))).cast("bigint")


def gap_count(text: Column | str) -> Column:
    """Dash lines between the gaps heading and the question heading."""
    lines = F.split(col(text), r"\r?\n", -1)
    start = _heading_at(lines, "not covered by the sops")
    after = F.slice(lines, (start + 2).cast("int"), F.greatest(F.size(lines) - start - 1, F.lit(0)).cast("int"))
    end = F.coalesce(_heading_at(after, "one question"), F.size(after).cast("bigint"))
    gaps = F.filter(F.slice(after, F.lit(1), end.cast("int")), lambda x: x.rlike(rf"^{L.WS}*-{L.WS}"))
    return F.coalesce(F.size(gaps), F.lit(0)).cast("bigint")


def delivery_stats(df: DataFrame, raw: str, tail: str | None = None) -> DataFrame:
    """Per answer, what was generated against what was delivered: steps, gaps and characters.

    A blocked answer delivers its fixed line only. An admitted one delivers its body; ``tail`` names a column with the
    rebuilt citation tail, null where none was rebuilt, that stands in for the held one. ``none_with_steps`` marks an
    answer that declared no coverage and gave steps all the same.
    """
    gated = gate_coverage(df, raw)
    body = F.col("body")
    if tail:
        gated = hold_tail(gated, "body")
        body = F.when(F.col("held").isNull() | F.col(tail).isNull(), body).otherwise(F.concat("shown", tail))
    notice = F.create_map(*[F.lit(x) for kv in L.BLOCKED_LINES.items() for x in kv])
    gated = gated.withColumn("_sent", F.when(F.col("blocked").isNotNull(), notice[F.col("blocked")]).otherwise(body))
    counts = {}
    for side, c in (("generated", raw), ("delivered", "_sent")):
        counts |= {f"{side}_steps": step_count(c), f"{side}_gaps": gap_count(c), f"{side}_chars": F.char_length(c).cast("bigint")}
    out = gated.withColumns(counts)
    declared = ~F.coalesce(F.col("reason").isin("missing", "invalid"), F.lit(False))
    contradicts = F.coalesce(F.col("reason") == "none", F.lit(False)) & (F.col("generated_steps") > 0)
    return out.withColumns({"coverage_line": declared, "none_with_steps": contradicts}).drop("_sent")


def split_sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per known heading; text before the first is dropped, empty bodies are kept.

    Section bounds are heading positions of the same row, so nothing is shuffled.
    """
    names = F.array(*[F.lit(h) for h in L.ANSWER_HEADINGS])
    lines = lines_of(text)

    def heading(line: Column) -> Column:
        s = ws_trim(line)
        return F.get(F.filter(names, lambda h: (s == h) | s.startswith(F.concat(h, F.lit(":")))), F.lit(0))

    marked = df.select(key, lines.alias("_l")).withColumn(
        "_heads",
        F.filter(
            F.transform("_l", lambda x, i: F.struct(i.alias("at"), heading(x).alias("heading"))),
            lambda s: s["heading"].isNotNull(),
        ),
    )

    def body(h: Column, k: Column) -> Column:
        nxt = F.coalesce(F.get(F.col("_heads"), k + 1)["at"], F.size("_l"))
        first = sub(F.substr(ws_trim(F.get(F.col("_l"), h["at"])), F.char_length(h["heading"]) + 1), rf"^:{L.WS}*")
        rest = F.array_join(F.slice(F.col("_l"), h["at"] + 2, nxt - h["at"] - 1), "\n")
        return F.struct(
            h["heading"].alias("heading"), ws_trim(F.concat(first, F.lit("\n"), rest)).alias("body")
        )

    return unroll(marked, [key], F.transform("_heads", body), "ord", "_s").select(
        key, F.col("ord").cast("bigint").alias("ord"), "_s.heading", "_s.body"
    )


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _list_starts(kinds: pd.Series) -> pd.Series:
    """Numbered lines (2) opening a list right under prose (1); blank lines (0) end a list."""

    def one(row) -> np.ndarray:
        k = np.asarray(row)
        at = np.arange(len(k))
        last_blank = np.maximum.accumulate(np.where(k == 0, at, -1))
        last_step = np.maximum.accumulate(np.where(k == 2, at, -1))
        before = np.concatenate(([-1], last_step[:-1]))
        under_prose = np.concatenate(([False], k[:-1] != 0))
        return (k == 2) & under_prose & (before <= last_blank)

    return kinds.map(one)


def repair_lists(text: Column | str) -> Column:
    """Blank line before a numbered step that starts a list directly under prose."""
    lines = lines_of(text)
    kinds = F.transform(
        lines, lambda x: F.when(is_blank(x), 0).when(x.rlike(r"^ {0,3}[0-9]+\. "), 2).otherwise(1)
    )
    return F.array_join(
        F.zip_with(lines, _list_starts(kinds), lambda x, s: F.when(s, F.concat(F.lit("\n"), x)).otherwise(x)), "\n"
    )


# --- collapse check ----------------------------------------------------------


def degenerate(text: Column | str) -> Column:
    """Stop-word share or repetition over the first 60 words says the text collapsed."""
    stop = F.array(*[F.lit(w) for w in L.COLLAPSE_STOPWORDS])
    # marks at word edges go in one pass over the text; only the sample is looked at word by word
    edges = rf"(?<![^\s])[^\p{{L}}\p{{N}}\s]+|[^\p{{L}}\p{{N}}\s]+(?![^\s])"
    words = F.slice(F.array_remove(F.split(sub(F.lower(col(text)), edges), rf"{L.WS}+", -1), ""), 1, L.SAMPLE_WORDS)

    def verdict(w: Column) -> Column:
        n = F.size(w)
        stops = F.size(F.filter(w, lambda x: F.array_contains(stop, x)))
        return F.when(n < L.SAMPLE_MIN_WORDS, False).otherwise(
            (stops / n > L.STOP_SHARE_MAX) | (F.size(F.array_distinct(w)) / n < L.DISTINCT_SHARE_MIN)
        )

    return bind(words, verdict)


# --- the follow-up question ---------------------------------------------------

QUESTION_BLOCK = r"(?im)^[ \t]*(?:#{1,6}[ \t]+)?(?:\*\*|__)?[ \t]*One question[ \t]*:?[ \t]*(?:\*\*|__)?[ \t]*(.*)$"
QUESTION_INLINE = r"(?i)(?:\*\*|__)?One question(?:\*\*|__)?[ \t]*:[ \t]*"
HEADING_LIKE = r"^[ \t]*(?:#{1,6}[ \t]+|(?:\*\*|__)\S)"
IDENTITY = (
    rf"(?i)(?:what(?:'s| is)|provide|give|confirm|share){L.W1}[^?]{{0,60}}{L.W0}(?:patient|caregiver|mother|father|"
    rf"spouse|family member)(?:'s)?{L.WS}+(?:full{L.WS}+|first{L.WS}+|last{L.WS}+)?(?:name|date of birth|dob|phone(?: number)?|"
    rf"e-?mail|address)|{L.W0}(?:date of birth|dob|full name|name of the patient){L.W1}"
)


def drop_identity_question(df: DataFrame, text: str) -> DataFrame:
    """Remove the follow-up question when it asks for an identifier; adds ``dropped``."""
    t = col(text)
    block = F.regexp_instr(t, F.lit(QUESTION_BLOCK))
    lines = lines_of(F.substr(t, block))
    inline = ws_trim(find(t, QUESTION_BLOCK, 1))
    first = F.coalesce(first_index(F.slice(lines, 2, F.size(lines)), lambda x: ~is_blank(x)) + 1, F.lit(1 << 30).cast("bigint"))
    stops = F.transform(
        lines,
        lambda x, i: (i >= 1) & (x.rlike(HEADING_LIKE) | (is_blank(x) & ((inline != "") | (i > first)))),
    )
    stop = F.when(F.exists(stops, lambda s: s), F.array_position(stops, F.lit(True)) - 1).otherwise(F.size(lines)).cast("int")
    region = F.slice(lines, F.lit(1), stop)
    asked = ws_trim(
        F.concat_ws(
            " ", inline,
            F.array_join(F.filter(F.transform(F.slice(region, 2, F.size(region)), ws_trim), lambda x: x != ""), " "),
        )
    )
    block_end = block + F.char_length(F.array_join(region, "\n"))
    at = F.regexp_instr(t, F.lit(QUESTION_INLINE))
    after = F.substr(t, at + F.char_length(find(t, QUESTION_INLINE)))
    inline_asked = ws_trim(F.substring_index(after, "\n", 1))
    inline_end = at + F.char_length(find(t, QUESTION_INLINE)) + F.char_length(F.substring_index(after, "\n", 1))
    start = F.when(block > 0, block).when(at > 0, at)
    end = F.when(block > 0, block_end).otherwise(inline_end)
    question = sub(F.when(block > 0, asked).otherwise(inline_asked), "[‘’]", "'")
    head = sub(F.left(t, start - 1), rf"{L.WS}+$")
    tail = sub(F.substr(t, end), rf"^{L.WS}+")
    dropped = start.isNotNull() & question.rlike(IDENTITY)
    return df.withColumn("dropped", F.coalesce(dropped, F.lit(False))).withColumn(
        text,
        F.when(F.col("dropped"), F.when(tail != "", F.concat(head, F.lit("\n\n"), tail)).otherwise(head)).otherwise(t),
    )


# --- grading -----------------------------------------------------------------


def answer_parts(df: DataFrame, text: str) -> DataFrame:
    """Head, citations, gaps, question and script slices of an answer."""
    plain = sub(text, r"\*\*|__")

    def at(words: str) -> Column:
        return F.nullif(F.regexp_instr(plain, F.lit(rf"(?i){words}\s*:?")), F.lit(0))

    cite, gaps, ask = at("what the sops say"), at("not covered by the sops"), at("one question")
    say, stop = at("tell the patient"), at("stop and escalate")

    def cut(a: Column, b: Column) -> Column:
        end = F.coalesce(b, F.char_length(plain) + 1)
        return F.when(a.isNull(), "").otherwise(F.substr(plain, a, F.greatest(end - a, F.lit(0))))

    return df.withColumns(
        {
            "head": F.left(plain, F.coalesce(cite, F.char_length(plain) + 1) - 1),
            "citations": cut(cite, gaps),
            "gaps": cut(gaps, ask),
            "question": cut(ask, F.lit(None).cast("int")),
            "script": cut(say, stop),
        }
    )


def steps_of(head: Column | str) -> Column:
    """Numbered steps of the head, each cut before the next block heading."""
    closing = rf"(?i)\n(?:Then|Tell the patient|Stop and escalate|Done when){L.W1}"

    def cut(h: Column, marks: Column) -> Column:
        ends = F.concat(F.transform(F.slice(marks, 2, F.size(marks)), lambda m: m["start"]), F.array(F.char_length(h)))
        return F.zip_with(
            marks, ends,
            lambda m, e: ws_trim(F.split(F.substr(h, m["end"] + 1, F.greatest(e - m["end"], F.lit(0))), closing, -1)[0]),
        )

    marks = spans(head, rf"(?:\A|{L.WS})[0-9]{{1,2}}\.{L.WS}+")
    return bind(
        F.struct(col(head).alias("h"), marks.alias("m")),
        lambda x: F.when(F.size(x["m"]) > 0, cut(x["h"], x["m"])).otherwise(F.array().cast("array<string>")),
    )


CODE = rf"(?i){L.W0}(?:icd-?10|diagnosis code|code){L.W1}"
HANDS_OFF = rf"(?i){L.W0}(?:route|ask|send|flag|notify){L.W1}|{L.W0}(?:never|do not|don't){L.W1}"
CHOOSES_CODE = (
    rf"(?i){L.W0}(?:add|change|select|choose|determine|enter|pick|apply|update|use)\s+(?:(?:a|an|the|correct|clinically|"
    rf"appropriate|medicare-covered|required|diagnosis|icd-?10)\s+){{0,6}}(?:code|it){L.W1}"
)
ROUTES = (
    rf"(?i){L.W0}(?:route|ask|send|flag|notify){L.W1}[^.\n]{{0,150}}{L.W0}(?:provider|prescriber){L.W1}"
    rf"|{L.W0}(?:provider|prescriber){L.W1}[^.\n]{{0,80}}{L.W0}(?:selects|chooses|decides){L.W1}"
)
GAP_STEPS = "(?i)the specific steps|how to (?:update|set|change)"
ASKS_IDENTITY = (
    rf"(?i){L.W0}(?:name|date of birth|phone|address|email){L.W1}|which (?:code|icd)|patient's (?:specific )?"
    r"(?:diagnosis|condition)|what is the (?:current )?(?:process|procedure)"
)
TIMEFRAME = "(?i)business days|may (?:need to )?move|cannot|not (?:be )?(?:guaranteed|booked)|can't (?:promise|guarantee)"
TIMED_CASES = ("B3", "C1")


def grade_answers(df: DataFrame, case: str, text: str, scored: str) -> DataFrame:
    """Quality indicators per answer; an unscored answer is null everywhere, never a pass."""
    parts = answer_parts(df, text).withColumn("_steps", steps_of("head"))
    clause = lambda s: F.split(s, r"(?<=[.!?])\s", -1)[0]
    reserve = ~F.col("head").rlike(CODE) | F.forall(
        "_steps", lambda s: clause(s).rlike(HANDS_OFF) | ~clause(s).rlike(CHOOSES_CODE)
    )
    gap_gate = ~((F.size("_steps") > 0) & F.col("gaps").rlike(GAP_STEPS))
    graded = {
        "reserve": reserve,
        "routing": F.col("head").rlike(ROUTES),
        "gap_gate": gap_gate,
        "one_question": ~F.col("question").rlike(ASKS_IDENTITY),
        "timeframe": F.when(F.col(case).isin(*TIMED_CASES), F.col("script").rlike(TIMEFRAME)),
    }
    out = parts.withColumns({k: F.when(F.col(scored), v) for k, v in graded.items()})
    return out.withColumn("steps", F.when(F.col(scored), F.size("_steps")).otherwise(0).cast("bigint")).drop("_steps")


# --- citation tails ------------------------------------------------------------

SOP_HEADING = r"(?i)^[ \t]*(?:#{1,6}[ \t]+)?(?:\*\*|__)?[ \t]*What the SOPs say[ \t]*:?[ \t]*(?:\*\*|__)?[ \t]*(.*)$"
SECTION_END = rf"(?im)^[ \t]*(?:#{{1,6}}[ \t]+)?(?:\*\*|__)?[ \t]*(?:Not covered by the SOPs|One question){L.W1}"
INLINE_END = rf"(?i)\s(?=(?:\*\*|__)?(?:Not covered by the SOPs|One question){L.W1})"
ITEM_START = rf"^{L.WS}*[0-9]+[.)]{L.WS}+"
TRAILING_JOINERS = r"[\s,;:—–-]+$"
QUOTED = "\"[^\"]+\"|“[^”]+”"


def hold_tail(df: DataFrame, text: str) -> DataFrame:
    """Split an answer after its citation heading: ``shown`` now, ``held`` until the end.

    ``held`` is null when no heading appears; shown plus held is always the input.
    """
    t = col(text)
    at = F.regexp_instr(t, F.lit(TAIL_HEADING))
    hit = find(t, TAIL_HEADING)
    opener = find(hit, r"^[ \t]*(?:#{1,6}[ \t]+)?(\*\*|__)", 1)
    body = F.substr(hit, F.regexp_instr(hit, F.lit(r"\*\*|__")) + 2)
    base = at - 1 + F.char_length(hit)
    unclosed = (opener != "") & hit.endswith(":") & ~F.contains(body, opener)
    cut = base + F.when(unclosed & (F.substr(t, base + 1, F.lit(2)) == opener), 2).otherwise(0)
    bare = t.rlike(r"(?im)^[ \t]*(?:#{1,6}[ \t]+)?(?:\*\*|__)?[ \t]*what the sops say(?:[ \t]*(?:\*\*|__))?[ \t]*:?[ \t]*\z")
    return df.withColumns(
        {
            "shown": F.when(at > 0, F.left(t, cut)).otherwise(t),
            "held": F.when(at > 0, F.substr(t, cut + 1)).when(bare, ""),
        }
    )


def clean_head(raw: Column) -> Column:
    return ws_trim(
        sub(
            ws_trim(
                chain(
                    raw,
                    (rf"^{L.WS}*[0-9]{{1,2}}[.)]{L.WS}*", ""),
                    (r"\[([^\[\]\n]{0,200})\]\([^)\s]*\)", "$1"),
                    (r"\[[0-9]{1,2}\]", ""),
                    (L.TYPED_URL, ""),
                    (PICTURES, ""),
                    (r"\*\*|__", ""),
                    (r"[ \t]+", " "),
                )
            ),
            TRAILING_JOINERS,
        )
    )


def inline_items(text: Column) -> Column:
    """Items run together on one line: item n+1 only after a sentence end, before a word or quote."""
    number = r"^[ \t]*([0-9]{1,2})[.)][ \t]+"

    def starts_of(flat: Column) -> Column:
        candidates = F.transform(
            spans(flat, r"(?<=[.!?\"”)])[ \t]+[0-9]+(?=[.)]\s+[\[\p{L}\"“])"),
            lambda s: F.struct(
                ws_trim(s["text"]).cast("bigint").alias("n"), (s["end"] - F.char_length(ws_trim(s["text"]))).alias("at")
            ),
        )
        opening = F.char_length(find(flat, number))
        seed = F.struct(
            (find(flat, number, 1).try_cast("bigint") + 1).alias("want"), F.array(F.lit(0)).alias("starts")
        )
        return F.aggregate(
            F.transform(candidates, lambda c: F.struct(c["n"], c["at"], opening.alias("low"))),
            seed,
            lambda acc, c: F.when(
                (c["n"] == acc["want"]) & (c["at"] >= c["low"]),
                F.struct((acc["want"] + 1).alias("want"), F.concat(acc["starts"], F.array(c["at"])).alias("starts")),
            ).otherwise(acc),
            lambda acc: acc["starts"],
        )

    def cut(flat: Column, starts: Column) -> Column:
        ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.char_length(flat)))
        return F.zip_with(starts, ends, lambda s, e: ws_trim(F.substr(flat, s + 1, e - s)))

    return bind(
        text,
        lambda flat: F.when(
            flat.rlike(number), bind(starts_of(flat), lambda starts: cut(flat, starts))
        ).otherwise(F.array().cast("array<string>")),
    )


def block_items(body: Column) -> Column:
    """Items on their own lines, wrapped lines kept with their item."""

    def cut(lines: Column, starts: Column) -> Column:
        ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(lines)))
        return F.zip_with(starts, ends, lambda s, e: F.array_join(F.slice(lines, s + 1, e - s), "\n"))

    def from_lines(lines: Column) -> Column:
        starts = F.filter(
            F.transform(lines, lambda x, i: F.when(x.rlike(ITEM_START), i)), lambda i: i.isNotNull()
        )
        return bind(
            starts,
            lambda st: F.when(F.size(st) > 0, cut(lines, st)).otherwise(F.array().cast("array<string>")),
        )

    return bind(F.filter(lines_of(body), lambda x: ~is_blank(x)), from_lines)


def split_tail(df: DataFrame, tail: str) -> DataFrame:
    """Heading, preamble, item texts and following sections of a citation tail."""
    trimmed = ws_trim(tail)
    first = F.substring_index(trimmed, "\n", 1)
    titled = first.rlike(SOP_HEADING)
    inline = find(first, SOP_HEADING, 1)
    below = F.substr(trimmed, F.char_length(first) + 1)
    df = df.withColumns(
        {
            "heading": F.when(titled, sub(F.left(first, F.char_length(first) - F.char_length(inline)), rf"{L.WS}+$")).otherwise(""),
            "_body": F.when(titled, F.concat(inline, below)).otherwise(trimmed),
            "_titled": titled,
        }
    )
    b = F.col("_body")
    end = F.regexp_instr(b, F.lit(SECTION_END))
    inline_end = F.when(~F.contains(ws_trim(b), F.lit("\n")), F.regexp_instr(b, F.lit(INLINE_END))).otherwise(0)
    df = df.withColumns(
        {
            "rest": F.when(end > 0, F.substr(b, end)).when(inline_end > 0, F.substr(b, inline_end + 1)).otherwise(""),
            "_items": F.when(end > 0, F.left(b, end - 1)).when(inline_end > 0, F.left(b, inline_end - 1)).otherwise(b),
        }
    )
    body = F.when(F.col("_titled"), F.col("_items")).otherwise(sub("_items", r"^[ \t]*(?:\*\*|__)[ \t]*"))
    df = df.withColumn("_items", body)
    flat = ws_trim("_items")
    single = (flat != "") & ~F.contains(flat, F.lit("\n"))
    lines = F.filter(lines_of("_items"), lambda x: ~is_blank(x))
    lead = F.coalesce(first_index(lines, lambda x: x.rlike(ITEM_START)), F.size(lines).cast("bigint"))
    preamble = ws_trim(
        chain(F.array_join(F.slice(lines, F.lit(1), lead.cast("int")), "\n"), (L.TYPED_URL, ""), (r"[ \t]+", " "), (r"(?m)[ \t]+$", ""))
    )
    return df.withColumns(
        {
            "preamble": F.when(single, "").otherwise(preamble),
            "items": F.when(single, inline_items(flat)).otherwise(block_items(F.col("_items"))),
        }
    ).drop("_body", "_titled", "_items")


def parse_items(df: DataFrame, keys: list[str], items: str) -> DataFrame:
    """One row per item: number, label, head words and quotations."""
    exploded = unroll(df, keys, items, "_pos", "_raw").withColumn(
        "item_text", ws_trim(sub("_raw", rf"{L.WS}*\n{L.WS}*", " "))
    )
    quotes = F.filter(
        F.transform(find_all("item_text", QUOTED), lambda q: F.substr(q, F.lit(2), F.char_length(q) - 2)), lambda q: ~is_blank(q)
    )
    at = F.regexp_instr(F.col("item_text"), F.lit(QUOTED))
    return exploded.withColumns(
        {
            "item": (F.col("_pos") + 1).cast("bigint"),
            "label": find("item_text", r"\[([0-9]{1,2})\]", 1).try_cast("bigint"),
            "head": clean_head(F.when(at > 0, F.left(F.col("item_text"), at - 1)).otherwise(F.col("item_text"))),
            "quotes": quotes,
        }
    ).drop("_pos", "_raw")


def reason_for(answer: Column | str, title: Column | str) -> Column:
    """First 10-450 character quotation within 600 characters of a title mention.

    A title is looked for without the symbols that decorate its start.
    """
    a = col(answer)
    clean = F.lower(sub(title, r"^[^\p{L}\p{N}]+"))
    low = F.lower(a)
    cite = F.instr(low, "what the sops say")
    at = F.call_function("locate", clean, low, F.greatest(cite, F.lit(1)))
    quote = F.regexp_extract(F.substr(a, at, F.lit(600)), '"([^"]{10,450})"', 1)
    return F.when((F.char_length(clean) >= 4) & (at > 0) & (quote != ""), quote)
