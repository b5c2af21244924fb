"""Sensitive-data scans, warnings and redaction over text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslane.functions import lexicon as L
from corpuslane.functions.text import bind, col, find_all, longest, one_line, spans, sub, unroll, ws_trim

# Cheap tests every match must pass: they run before the costly patterns.
PHONE_GATE = "[0-9]{4}"
DATE_GATE = "[0-9]{2}"


def _gap(a: Column, b: Column) -> Column:
    return F.greatest(a["start"] - b["end"], b["start"] - a["end"], F.lit(0))


def near(text: Column | str, keyword: str, target: str, gap: int) -> Column:
    """True when a keyword match lies within ``gap`` characters of a target match.

    Both span lists belong to one row, so the range join runs inside the row: no shuffle,
    and the cheap keyword test gates the span extraction.
    """
    t = col(text)
    close = bind(
        spans(t, target), lambda ds: F.exists(spans(t, keyword), lambda k: F.exists(ds, lambda d: _gap(k, d) <= gap))
    )
    return F.when(t.rlike(keyword) & t.rlike(target), close).otherwise(False)


def contact_phone_spans(text: Column | str) -> Column:
    """Phone spans that count as contact details.

    A bare digit run within 12 characters of a record keyword is a record number and is
    left out; a number written with separators always counts.
    """
    t = col(text)
    kept = bind(
        spans(t, L.RECORD_KEYWORD),
        lambda marks: F.filter(
            spans(t, L.PHONE),
            lambda p: ~p["text"].rlike("^[0-9]+$")
            | ~F.exists(marks, lambda k: _gap(k, p) <= L.RECORD_NUMBER_GAP),
        ),
    )
    return F.when(t.rlike(PHONE_GATE) & t.rlike(L.PHONE), kept).otherwise(F.array().cast("array<struct<start:int,end:int,text:string>>"))


def near_pairs(df: DataFrame, key: str, text: str, keyword: str, target: str, gap: int) -> DataFrame:
    """The matching (keyword, target) span pairs behind :func:`near`, one row each."""
    pairs = bind(
        spans(text, target),
        lambda ds: F.flatten(
            F.transform(
                spans(text, keyword),
                lambda k: F.transform(
                    F.filter(ds, lambda d: _gap(k, d) <= gap), lambda d: F.struct(k.alias("k"), d.alias("t"))
                ),
            )
        ),
    )
    gated = df.filter(col(text).rlike(keyword) & col(text).rlike(target))
    return unroll(gated, [key], pairs, "_i", "p").select(
        key,
        F.col("p.k.start").cast("bigint").alias("keyword_start"),
        F.col("p.t.start").cast("bigint").alias("target_start"),
        F.col("p.k.text").alias("keyword"),
        F.col("p.t.text").alias("target"),
    )


def identifier_reason(text: Column | str) -> Column:
    """What tripped the hard screen, first match wins, or null."""
    t = col(text)
    return (
        F.when(t.rlike(PHONE_GATE) & t.rlike(L.SSN), "a Social Security number")
        .when(F.contains(t, F.lit("@")) & t.rlike(L.EMAIL), "an email address")
        .when(t.rlike(DATE_GATE) & near(t, L.BIRTH_KEYWORD, L.DATE, L.BIRTH_DATE_GAP), "a date of birth")
        .when(F.size(contact_phone_spans(t)) > 0, "a phone number")
    )


def possible_name(text: Column | str) -> Column:
    t = col(text)
    related = F.exists(find_all(t, L.RELATION_NAME, 1), lambda g: ~g.rlike(L.PREPOSITION))
    return (
        t.rlike(L.NAMED_PHRASE) | t.rlike(L.HONORIFIC) | related | t.rlike(L.POSSESSIVE_NAME)
    )


def warning_noun(text: Column | str) -> Column:
    """Soft warning before sending, or null. Warns only, never blocks."""
    t = col(text)
    return (
        F.when(possible_name(t), "a patient name")
        .when(t.rlike(L.STREET), "a street address")
        .when(t.rlike(L.MEMBER_ID), "an insurance or member ID")
    )


def redact_blocked(df: DataFrame, text: str, role: str) -> DataFrame:
    """User messages that trip the hard screen keep only the reason."""
    reason = F.when(F.col(role) == "user", identifier_reason(text))
    return df.withColumn("reason", reason).withColumn(
        text, F.when(F.col("reason").isNotNull(), L.WITHHELD).otherwise(F.col(text))
    )


PERSON = "<person>"
GRAM = 3


def names_met(df: DataFrame, names: DataFrame, text: str) -> DataFrame:
    """``_text, _names``: by hash of a text, the names that stand in it, longest first.

    A name's longest blank-free piece lies inside one blank-free word of a text. Pieces meet the distinct words of all
    texts on their first three characters, words meet texts, and only hashes and words travel. Hashes of
    different texts may agree: that adds names which the text does not hold, and replaces nothing.
    """
    piece = longest(F.filter(F.split("name", rf"{L.WS}+", -1), lambda x: x != ""))
    anchors = names.filter(F.col("name") != "").select("name").distinct().withColumn("piece", piece).filter(F.col("piece").isNotNull())
    anchors = anchors.withColumn("size", F.least(F.char_length("piece"), F.lit(GRAM))).withColumn("gram", F.substr("piece", F.lit(1), F.col("size")))
    words = F.array_distinct(F.split(F.col(text), rf"{L.WS}+", -1))
    held = unroll(df.filter(F.col(text).isNotNull()), [F.xxhash64(text).alias("_text")], words, "_i", "word").drop("_i").filter(F.col("word") != "")
    # at most three sizes
    sizes = anchors.select("size").distinct()
    places = held.select("word").distinct().select("word", F.explode(F.sequence(F.lit(1), F.char_length("word"))).alias("at"))
    grams = places.join(F.broadcast(sizes)).withColumn("gram", F.substr("word", F.col("at"), F.col("size")))
    named = grams.join(anchors.drop("size"), "gram").filter(F.contains("word", "piece")).select("word", "name").distinct()
    longer = F.struct((-F.char_length("name")).alias("n"), "name")
    return held.join(named, "word").groupBy("_text").agg(F.transform(F.array_sort(F.collect_set(longer)), lambda x: x["name"]).alias("_names"))


def redact_names(df: DataFrame, names: DataFrame, text: str) -> DataFrame:
    """Replace every directory name, longest first, case-sensitive, also inside longer words.

    Each text is folded over the names that were met in it, and over those few that stand inside the
    replacement itself, which later names may cut again.
    """
    inner = names.filter((F.col("name") != "") & F.contains(F.lit(PERSON), F.col("name"))).select("name").distinct().agg(F.collect_set("name").alias("_inner"))
    met = names_met(df, names, text).join(F.broadcast(inner))
    order = F.transform(F.array_union("_names", "_inner"), lambda x: F.struct((-F.char_length(x)).alias("n"), x.alias("name")))
    met = met.select("_text", F.transform(F.array_sort(order), lambda x: x["name"]).alias("_names"))
    redacted = F.aggregate("_names", F.col(text), lambda acc, n: F.replace(acc, n, F.lit(PERSON)))
    joined = df.withColumn("_text", F.xxhash64(text)).join(met, "_text", "left")
    return joined.withColumn(text, F.when(F.col("_names").isNull(), F.col(text)).otherwise(redacted)).drop("_names", "_text")


def staff_names(people: DataFrame) -> DataFrame:
    """Full names and first names of directory people; a bare title is not a name."""
    full = people.select(one_line("name").alias("name")).filter(F.col("name") != "")
    first = F.split("name", " ")
    return full.unionByName(
        full.filter((F.size(first) > 1) & ~first[0].rlike(r"(?i)^dr\.?$")).select(first[0].alias("name"))
    ).distinct()


def candidate_names(df: DataFrame, key: str, text: str) -> DataFrame:
    """Capitalised names named by an honorific, a relation word or a possessive."""
    patterns = F.concat(
        find_all(text, rf"{L.W0}(?:Mr|Mrs|Ms|Miss)\.?{L.WS}+([A-Z][a-z]+)", 1),
        F.transform(
            F.filter(
                F.arrays_zip(
                    find_all(text, L.RELATION_NAME, 1).alias("gap"), find_all(text, L.RELATION_NAME, 0).alias("hit")
                ),
                lambda p: ~p["gap"].rlike(L.PREPOSITION),
            ),
            lambda p: F.regexp_extract(p["hit"], rf"([A-Z][a-z]+(?:{L.WS}+[A-Z][A-Za-z]+)+)$", 1),
        ),
        find_all(text, rf"{L.W0}([A-Z][a-z]+(?:{L.WS}+[A-Z][a-z]+)+)['’]s{L.WS}", 1),
    )
    return df.select(key, F.explode(F.array_distinct(patterns)).alias("name")).filter(F.col("name") != "")


def exempt_staff(names: DataFrame, staff: DataFrame) -> DataFrame:
    """Flagged names left after removing people in the staff directory."""
    norm = lambda c: F.lower(one_line(c))
    known = staff.select(norm("name").alias("norm")).distinct()
    return names.withColumn("norm", norm("name")).join(known, "norm", "left_anti").drop("norm")


def classify_error(stage: Column | str, message: Column | str) -> Column:
    m = col(message)
    out = F.when(m.rlike(L.ERROR_KINDS[0][1]), L.ERROR_KINDS[0][0])
    for kind, pattern in L.ERROR_KINDS[1:]:
        out = out.when(m.rlike(pattern), kind)
    return out.otherwise(F.when(col(stage) == "generation", "generation").otherwise("retrieval"))


def truncated(tokens: Column | str, text: Column | str, cap: int = L.OUTPUT_TOKENS) -> Column:
    t = col(text)
    return (
        F.when(col(tokens).isNotNull(), col(tokens) >= cap)
        .when(ws_trim(t) == "", False)
        .otherwise(~F.contains(F.lower(t), F.lit("not covered by the sops")))
    )


def length_band(text: Column | str, cap: int = L.MESSAGE_CHARS) -> Column:
    """``ok`` below the counter, ``near`` from 1,000 characters short of the cap, ``over`` past it."""
    n = F.char_length(col(text))
    return F.when(n > cap, "over").when(n >= cap - 1000, "near").otherwise("ok")


def strip_urls(text: Column | str) -> Column:
    return sub(text, L.TYPED_URL)


def _param(query: Column, name: str) -> Column:
    """First value of a URL parameter, decoded leniently; null when absent."""
    pattern = rf"(?:^|[?&]){name}=([^&#]*)"
    raw = F.regexp_extract(query, pattern, 1)
    fixed = sub(sub(raw, r"\+", "%20"), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(query.rlike(pattern), F.try_url_decode(fixed))


def parse_landing_urls(df: DataFrame, url: str, max_chars: int = L.MESSAGE_CHARS) -> DataFrame:
    """Deep links of the supported version: action, text and validated source and reference."""
    q = F.regexp_extract(col(url), r"\?([^#]*)", 1)
    text = ws_trim(sub(_param(q, "q"), r"\r\n?", "\n"))
    src, ref = _param(q, "src"), _param(q, "ref")
    return (
        df.withColumns({"_v": _param(q, "v"), "link_text": text, "_src": src, "_ref": ref, "_action": _param(q, "action")})
        .filter((F.col("_v") == "1") & (F.col("link_text") != "") & ~F.contains("link_text", F.lit("�")))
        .withColumns(
            {
                "action": F.when(
                    (F.col("_action") == "ask") & (F.char_length("link_text") <= max_chars), "ask"
                ).otherwise("draft"),
                "src": F.when(F.col("_src").rlike("^[a-z0-9-]{1,16}$"), F.col("_src")),
                "ref": F.when(F.col("_ref").rlike("^[A-Za-z0-9][A-Za-z0-9_-]{0,63}$"), F.col("_ref")),
            }
        )
        .drop("_v", "_src", "_ref", "_action")
    )


def message_text(parts: Column | str) -> Column:
    """Text parts of a message joined by newlines."""
    kept = F.filter(col(parts), lambda p: p["type"] == "text")
    return ws_trim(F.array_join(F.transform(kept, lambda p: F.coalesce(p["text"], F.lit(""))), "\n"))


def first_text_rows(df: DataFrame, text: str, order: str) -> DataFrame:
    """Case-insensitive dedupe keeping the first row: a grouped minimum, combined map-side.

    Grouping on a 128-bit digest pair keeps long texts out of the shuffle; the survivors
    are found by a semi join on the row id.
    """
    low = F.lower(F.col(text))
    firsts = df.groupBy(F.sha2(low, 256).alias("_digest")).agg(F.min(order).alias(order))
    return df.join(firsts.select(order), order, "left_semi")
