"""Column expressions for markdown text, tokens and match spans.

All of these stay inside the JVM: regular expressions and higher-order array functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslane.functions import lexicon as L

# Code points drawn as pictographs, plus the selector, joiner and keycap marks.
PICTOGRAPH = (
    r"[\x{00A9}\x{00AE}\x{203C}\x{2049}\x{2122}\x{2139}\x{2194}-\x{21AA}\x{231A}-\x{23FF}"
    r"\x{24C2}\x{25AA}-\x{25FE}\x{2600}-\x{27BF}\x{2934}\x{2935}\x{2B05}-\x{2B55}\x{3030}"
    r"\x{303D}\x{3297}\x{3299}\x{1F000}-\x{1FAFF}\x{FE0F}\x{200D}\x{20E3}]"
)

# A class of many ranges is tested range by range at each character; a look-ahead in front passes plain letters at once.
PICTURES = rf"(?=[^\x00-\x7F]){PICTOGRAPH}"
# A run of white space other than one plain blank.
WS_RUN = rf"(?=[^!-~])(?: (?={L.WS})|(?! )){L.WS}+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, fn) -> Column:
    """``fn`` applied to ``value`` with ``value`` computed once per row.

    A column used inside a lambda is recomputed for every element; a lambda argument is not.
    """
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def sub(c: Column | str, pattern: str, replacement: str = "") -> Column:
    return F.regexp_replace(col(c), F.lit(pattern), F.lit(replacement))


def chain(c: Column | str, *steps: tuple[str, str]) -> Column:
    return reduce(lambda acc, s: sub(acc, s[0], s[1]), steps, col(c))


def ws_trim(c: Column | str) -> Column:
    """Trim every kind of white space, newlines and no-break spaces included."""
    return F.btrim(col(c), F.lit(L.WS_CHARS))


def one_line(c: Column | str) -> Column:
    return ws_trim(sub(c, WS_RUN, " "))


def is_blank(c: Column | str) -> Column:
    return ~col(c).rlike(L.NOT_WS)


def chars(c: Column | str) -> Column:
    return F.char_length(col(c)).cast("bigint")


def find(c: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract(col(c), pattern, group)


def find_all(c: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col(c), F.lit(pattern), F.lit(group))


def lines_of(c: Column | str) -> Column:
    return F.split(col(c), r"\n", -1)


def spans(c: Column | str, pattern: str) -> Column:
    """array<struct<start,end,text>> of every match, offsets 0-based and end exclusive.

    The gaps come from splitting on the same pattern, so offsets are running sums of gap
    and match lengths; the pattern must not match the empty string.
    """
    text = col(c)
    matches = find_all(text, pattern)
    gaps = F.split(text, pattern, -1)
    seed = F.struct(
        F.lit(0).cast("int").alias("at"),
        F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out"),
    )

    def step(acc, pair):
        start = acc["at"] + F.char_length(pair["gap"])
        end = start + F.char_length(pair["hit"])
        item = F.struct(start.alias("start"), end.alias("end"), pair["hit"].alias("text"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(item)).alias("out"))

    pairs = F.zip_with(
        F.slice(gaps, 1, F.size(matches)),
        matches,
        lambda g, m: F.struct(g.alias("gap"), m.alias("hit")),
    )
    return F.when(
        F.size(matches) > 0, F.aggregate(pairs, seed, step, lambda acc: acc["out"])
    ).otherwise(seed["out"])


def unroll(df: DataFrame, keep: list, array: Column | str, at: str, item: str) -> DataFrame:
    """One row per array element.

    Kept expressions are computed below the generator; beside it they would be evaluated once
    per element. The outer form keeps the optimizer from deriving a ``size(array) > 0`` filter,
    which would evaluate an expensive array a second time.
    """
    flat = df.select(*keep, col(array).alias("_array"))
    names = [c for c in flat.columns if c != "_array"]
    return flat.select(*names, F.posexplode_outer("_array").alias(at, item)).filter(F.col(at).isNotNull())


# --- markdown lines ---------------------------------------------------------

TABLE_ROW = r"^[ \t]*\|.*\|[ \t]*$"
HEADING = r"^[ \t]*#{1,6}[ \t]+\S"
FENCE = r"^[ \t]*(?:```|~~~)"
BLOCKQUOTE = r"^[ \t]*>"


def table_cells(c: Column) -> Column:
    cells = F.transform(
        F.split(chain(ws_trim(c), (r"^\|", ""), (r"\|$", "")), r"\|", -1), ws_trim
    )
    ruled = F.forall(cells, lambda x: x.rlike(r"^:?-+:?$"))
    kept = F.filter(cells, lambda x: x != "")
    return F.when(ruled, F.lit("")).otherwise(F.array_join(kept, "; "))


def display_line(c: Column | str) -> Column:
    """One physical markdown line as a reader sees it."""
    bare = chain(
        c,
        (r"^[ \t]*(?:>[ \t]*)+", ""),
        (rf"^{L.WS}*(?:>{L.WS}*)?(?:[-*+]{L.WS}+(?:\[[ xX]\]{L.WS}+)?|[0-9]+[.)]{L.WS}+|#{{1,6}}{L.WS}+)", ""),
    )
    flat = F.when(bare.rlike(TABLE_ROW), table_cells(bare)).otherwise(bare)
    return ws_trim(
        chain(
            flat,
            (r"\[([^\[\]\n]{0,200})\]\([^)\s]*\)", "$1"),
            (r"</?(?:details|summary)>", ""),
            (r"\*\*|__", ""),
            (PICTURES, ""),
            (r"\x{00A0}", " "),
            (r"[ \t]+", " "),
        )
    )


def unit_line(c: Column | str) -> Column:
    """One raw list item or sentence without its markers, links or emphasis."""
    return F.trim(
        chain(
            ws_trim(
                chain(
                    c,
                    (rf"^{L.WS}*(?:[-*+]|[0-9]+[.)]){L.WS}+", ""),
                    (rf"^\[[ xX]\]{L.WS}*", ""),
                    (r"\[([^\[\]\n]{0,200})\]\([^\n)]*\)", "$1"),
                    (r"\*\*|__", ""),
                    (PICTURES, ""),
                    (WS_RUN, " "),
                )
            ),
            (r"\( +", "("),
            (r" +\)", ")"),
        )
    )


def match_key(display: Column | str) -> Column:
    """Comparison form of a display line: lower case words joined by single spaces.

    Quotation marks vanish (so an apostrophe joins its word); every other mark breaks it.
    """
    return F.trim(
        chain(F.lower(col(display)), (r"[“”‘’\"']", ""), (r"(?=[^a-z])[^\p{L}\p{N}]+", " "))
    )


def tokens(key: Column | str) -> Column:
    return F.array_remove(F.split(col(key), " ", -1), "")


def bigrams(toks: Column | str) -> Column:
    """Neighbouring token pairs in order; ``toks`` should be a plain column."""
    t = col(toks)
    return F.when(
        F.size(t) >= 2,
        F.zip_with(F.slice(t, F.lit(1), F.size(t) - 1), F.slice(t, F.lit(2), F.size(t) - 1), lambda a, b: F.concat_ws(" ", a, b)),
    ).otherwise(F.array().cast("array<string>"))


def longest(toks: Column) -> Column:
    """The longest token (the rarest, as a rule): what a phrase is looked up by."""
    return F.array_max(F.transform(toks, lambda x: F.struct(F.char_length(x).alias("n"), x.alias("x"))))["x"]


def shingles(toks: Column | str, n: int) -> Column:
    """Every contiguous run of ``n`` tokens, joined by spaces."""
    return bind(
        col(toks),
        lambda t: F.when(
            F.size(t) >= n,
            F.transform(
                F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), " ")
            ),
        ).otherwise(F.array().cast("array<string>")),
    )


def title_stem(token: Column) -> Column:
    return F.when(
        (F.char_length(token) >= 4) & token.endswith("s"),
        F.left(token, F.char_length(token) - 1),
    ).otherwise(token)


def display_title(c: Column | str) -> Column:
    t = col(c)
    bare = ws_trim(sub(t, r"^[^\p{L}\p{N}]+"))
    return F.when(bare == "", t).otherwise(bare)


def card_title(c: Column | str) -> Column:
    return ws_trim(sub(display_title(c), L.DRAFT_TITLE))


def _owner_pieces(c: Column | str) -> Column:
    joined = sub(c, rf"(?=[NnPpCc]){L.W0}((?i:non|pre|co))-(?=[A-Za-z])", "$1")
    return F.split(joined, r"\P{Alnum}+", -1)


def content_word(raw: Column) -> Column:
    """The matching form of one piece of text, or null for stop words and short words."""
    acronym = raw.rlike("^[A-Z0-9]{2,}$") & raw.rlike("[A-Z]")
    low = F.lower(raw)
    stem = F.when(
        ~acronym & (F.char_length(low) > 4) & low.endswith("s") & ~low.endswith("ss"),
        F.left(low, F.char_length(low) - 1),
    ).otherwise(low)
    drop = (raw == "") | (~acronym & (F.char_length(low) < 3)) | low.isin(L.OWNER_STOPWORDS) | stem.isin(L.OWNER_STOPWORDS)
    return F.when(~drop, stem)


def owner_words(c: Column | str) -> Column:
    """Content words of a short text, in order, duplicates kept."""
    return F.filter(F.transform(_owner_pieces(c), content_word), lambda w: w.isNotNull())


def owner_word_rows(df: DataFrame, keep: list[str], text: Column | str) -> DataFrame:
    """Distinct (keys, word) rows of long texts; the word test runs as generated code."""
    return owner_word_repeats(df, keep, text).distinct()


def owner_word_repeats(df: DataFrame, keep: list[str], text: Column | str) -> DataFrame:
    """As ``owner_word_rows``, but a row may come again: nothing is shuffled."""
    raw = df.select(*keep, F.explode_outer(F.array_distinct(_owner_pieces(text))).alias("raw"))
    return raw.select(*keep, content_word(F.col("raw")).alias("word")).filter(F.col("word").isNotNull())


def topic_words(c: Column | str) -> Column:
    """Distinct words that decide whether two topics are about the same work."""
    stop = F.array(*[F.lit(w) for w in L.TOPIC_STOPWORDS])
    raw = F.transform(
        F.split(F.lower(col(c)), r"(?=\P{Alnum})[^a-z0-9-]+", -1), lambda w: sub(w, "^-+|-+$")
    )
    kept = F.filter(raw, lambda w: (F.char_length(w) >= 3) & ~F.array_contains(stop, w))
    return F.array_distinct(
        F.transform(
            kept,
            lambda w: F.when(
                (F.char_length(w) > 4) & w.endswith("s"), F.left(w, F.char_length(w) - 1)
            ).otherwise(w),
        )
    )


def slug(c: Column | str) -> Column:
    s = F.left(chain(F.lower(col(c)), ("[^a-z0-9]+", "-"), ("^-+|-+$", "")), F.lit(80))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("untitled"))


def status_kind(label: Column | str, title: Column | str) -> Column:
    lab = F.coalesce(col(label), F.lit(""))
    return (
        F.when(lab.rlike("(?i)draft"), "draft")
        .when(lab.rlike("(?i)review"), "review")
        .when(lab.rlike("(?i)approved"), "approved")
        .when(col(title).rlike(L.DRAFT_TITLE), "draft")
    )


def primary_category(tags: Column | str) -> Column:
    t = col(tags)
    ranked = F.array(*[F.lit(c) for c in L.CATEGORY_PRIORITY])
    hit = F.get(F.filter(ranked, lambda x: F.array_contains(t, x)), F.lit(0))
    return F.coalesce(hit, F.get(t, F.lit(0)), F.lit("uncategorized"))


def redact_ids(c: Column | str) -> Column:
    return sub(c, L.HEX_OR_UUID, "<id>")


def reach(slack: Column | str, dashboard: Column | str) -> Column:
    def tidy(c):
        return one_line(sub(c, r"(?i)\(unverified\)"))

    s, d = tidy(slack), tidy(dashboard)
    return (
        F.when(s.rlike("(?i)^direct message$"), "Slack direct message")
        .when(s != "", F.concat(F.lit("Slack "), s))
        .when(d != "", F.concat(F.lit("Dashboard "), d))
        .otherwise("")
    )
