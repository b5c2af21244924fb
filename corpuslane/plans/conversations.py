"""Registered queries: conversation windows, answers, sections and line tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslane.functions import lexicon as L
from corpuslane.functions import text as X
from corpuslane.operators import answers as A
from corpuslane.operators import context as C
from corpuslane.operators import lines as N
from corpuslane.operators import retrieve as R
from corpuslane.plans.registry import query
from corpuslane.session import Tables, spread


def v_turns(t: Tables) -> DataFrame:
    n = F.char_length("text")
    return t.conversations.select(
        "conv_id", "turn", "role",
        F.when(n < 40, "  \n").otherwise(F.col("text")).alias("content"),
        F.when((F.col("role") == "assistant") & (n > 600), "partial")
        .when((F.col("role") == "assistant") & (n > 300), "full").alias("coverage"),
        (F.col("role") == "system").alias("notice"),
    )


SQL_TURNS = """turns AS (SELECT conv_id, turn, role, CASE WHEN length(text) < 40 THEN E'  \\n' ELSE text END AS content,
    CASE WHEN role = 'assistant' AND length(text) > 600 THEN 'partial' WHEN role = 'assistant' AND length(text) > 300 THEN 'full' END AS coverage,
    role = 'system' AS notice FROM conversations),
usable AS (SELECT * FROM turns WHERE NOT notice AND trim(content, E' \\n\\t\\r') <> '')"""


@query("usable_turns", "P11", f"WITH {SQL_TURNS} SELECT conv_id, turn, role FROM usable")
def usable_turns(t: Tables) -> DataFrame:
    return C.usable_turns(v_turns(t)).select("conv_id", "turn", "role")


@query(
    "trim_history", "W4",
    f"""WITH {SQL_TURNS}, a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age,
        length(content) + CASE WHEN role = 'assistant' AND coverage IS NOT NULL THEN length('Coverage: ' || coverage) + 2 ELSE 0 END AS n FROM usable),
    u AS (SELECT *, coalesce(sum(CASE WHEN age > 1 THEN n END) OVER (PARTITION BY conv_id ORDER BY age ROWS UNBOUNDED PRECEDING), 0) AS used FROM a)
    SELECT conv_id, turn, CAST(age AS BIGINT) AS age, CAST(used AS BIGINT) AS used FROM u WHERE age = 1 OR (age <= 12 AND used <= 2000)""",
)
def trim_history(t: Tables) -> DataFrame:
    return C.trim_history(v_turns(t), budget=2000).select("conv_id", "turn", F.col("age").cast("bigint").alias("age"), "used")


def sql_words(text: str) -> str:
    """DuckDB list of content words of an owner-matching text."""
    stops = ", ".join(f"'{w}'" for w in L.OWNER_STOPWORDS)
    return rf"""list_filter(list_transform(list_filter(regexp_split_to_array(regexp_replace({text}, '(?i)(^|[^A-Za-z0-9_])(non|pre|co)-([A-Za-z])', '\1\2\3', 'g'), '[^A-Za-z0-9]+'),
      lambda r: r <> '' AND ((regexp_matches(r, '^[A-Z0-9]{{2,}}$') AND regexp_matches(r, '[A-Z]')) OR length(r) >= 3) AND lower(r) NOT IN ({stops})),
      lambda r: CASE WHEN NOT (regexp_matches(r, '^[A-Z0-9]{{2,}}$') AND regexp_matches(r, '[A-Z]')) AND length(r) > 4 AND lower(r) LIKE '%s' AND lower(r) NOT LIKE '%ss'
                     THEN lower(r[:-2]) ELSE lower(r) END), lambda w: w NOT IN ({stops}))"""


def owner_query_of(turns: DataFrame) -> DataFrame:
    """Latest user message, preceded by the one before when it is too short on its own."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    two = (
        turns.filter(F.col("role") == "user").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= 2)
        .groupBy("conv_id")
        .agg(
            F.max(F.when(F.col("r") == 1, F.col("content"))).alias("latest"),
            F.max(F.when(F.col("r") == 2, F.col("content"))).alias("previous"),
        )
    )
    short = F.size(X.owner_words("latest")) < L.FOLLOW_UP_WORDS
    return two.select(
        "conv_id",
        F.when(F.col("previous").isNotNull() & short, F.concat_ws("\n", "previous", "latest")).otherwise(F.col("latest")).alias("query"),
        (F.col("previous").isNotNull() & short).alias("joined"),
    )


@query(
    "owner_query", "W5",
    f"""WITH t AS (SELECT conv_id, turn, role, text AS content, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role = 'user'),
    two AS (SELECT conv_id, max(CASE WHEN r = 1 THEN content END) AS latest, max(CASE WHEN r = 2 THEN content END) AS previous FROM t WHERE r <= 2 GROUP BY 1),
    s AS (SELECT *, previous IS NOT NULL AND len({sql_words('latest')}) < 4 AS joined FROM two)
    SELECT conv_id, joined, md5(CASE WHEN joined THEN previous || chr(10) || latest ELSE latest END) AS digest FROM s""",
)
def owner_query(t: Tables) -> DataFrame:
    turns = t.conversations.select("conv_id", "turn", "role", F.col("text").alias("content"))
    return owner_query_of(turns).select("conv_id", "joined", F.md5("query").alias("digest"))


@query(
    "flag_degenerate", "A5",
    rf"""WITH w AS (SELECT doc_id, list_slice(list_filter(list_transform(regexp_split_to_array(lower(text), '\s+'), lambda x: regexp_replace(x, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')), lambda x: x <> ''), 1, 60) AS words FROM documents)
    SELECT doc_id, CASE WHEN len(words) < 10 THEN false ELSE
       len(list_filter(words, lambda x: x IN ({", ".join(f"'{w}'" for w in L.COLLAPSE_STOPWORDS)}))) / len(words) > 0.85 OR len(list_distinct(words)) / len(words) < 0.2 END AS degenerate FROM w""",
)
def flag_degenerate(t: Tables) -> DataFrame:
    return spread(t.documents.select("doc_id", "text")).select("doc_id", A.degenerate("text").alias("degenerate"))


# --- pages as markdown --------------------------------------------------------


def v_markdown(t: Tables) -> DataFrame:
    return spread(t.pages.select("page_id", "html")).select("page_id", N.html_to_markdown("html").alias("text"))


def _sql_chain(expr: str, steps) -> str:
    for pattern, repl in steps:
        p = pattern.replace("'", "''")
        r = repl.replace("$", "\\").replace("\n", "' || chr(10) || '")
        expr = f"regexp_replace({expr}, '{p}', '{r}', 'g')"
    return expr


SQL_MARKDOWN = "md AS (SELECT page_id, " + _sql_chain("html", [
    (r"<title>[^<]*</title>|<style>[^<]*</style>|<script>[\s\S]*?</script>", ""), ("<nav>", "\n## Menu\n"),
    ("<article>", "\n## Article:\n"), ("<footer>", "\n## Footer\n"), ('<div class="ad">|</div>', "\n```\n"), ("<h1>", "\n# "),
    ("</h1>|<br>|</ul>", "\n"), ("<li>", "\n- "), ("<p>", "\n\n"), ("<[^>]*>", ""), ("&amp;", "&"),
]) + " AS text FROM pages)"


def sql_display(x: str) -> str:
    return _sql_chain(x, [
        (r"^[ \t]*(?:>[ \t]*)+", ""), (r"^\s*(?:>\s*)?(?:[-*+]\s+(?:\[[ xX]\]\s+)?|[0-9]+[.)]\s+|#{1,6}\s+)", ""),
        (r"\[([^\[\]\n]{0,200})\]\([^)\s]*\)", "$1"), (r"</?(?:details|summary)>", ""), (r"\*\*|__", ""),
        (X.PICTOGRAPH, ""), (r"\x{00A0}", " "), (r"[ \t]+", " "), (r"^\s+|\s+$", ""),
    ])


def sql_key(x: str) -> str:
    return _sql_chain(f"lower({x})", [(r"[“”‘’""'\"]", ""), (r"[^\p{L}\p{N}]+", " "), (r"^ +| +$", "")])


SQL_LINES = rf"""{SQL_MARKDOWN},
raw AS (SELECT page_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM md),
fences AS (SELECT *, regexp_matches(raw, '^[ \t]*(?:```|~~~)') AS fence,
                  sum(CASE WHEN regexp_matches(raw, '^[ \t]*(?:```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS seen FROM raw),
heads AS (SELECT *, regexp_matches(raw, '^[ \t]*#{{1,6}}[ \t]+\S') AS head FROM fences WHERE NOT fence AND seen % 2 = 0),
owned AS (SELECT *, last_value(CASE WHEN head THEN raw END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS hraw FROM heads),
shown AS (SELECT *, {sql_display('raw')} AS display FROM owned WHERE NOT head AND regexp_matches(raw, '\S')),
keyed AS (SELECT *, {sql_key('display')} AS key, regexp_replace({sql_display('hraw')}, ':[ \t]*$', '') AS section FROM shown),
lines AS (SELECT page_id, CAST(line AS BIGINT) AS line, display, key, section FROM keyed WHERE key <> '')"""


@query("index_lines", "W7", f"WITH {SQL_LINES} SELECT page_id, line, md5(display) AS display, md5(key) AS key, nullif(trim(section), '') AS section FROM lines")
def index_lines(t: Tables) -> DataFrame:
    return N.index_lines(v_markdown(t), "page_id", "text").select(
        "page_id", "line", F.md5("display").alias("display"), F.md5("key").alias("key"), "section"
    )


@query("section_of", "W19", rf"WITH {SQL_MARKDOWN} SELECT page_id, nullif(trim(regexp_extract(text, '(?m)^#{{1,6}}\s+(.+)$', 1)), '') AS section FROM md")
def section_of(t: Tables) -> DataFrame:
    return v_markdown(t).select("page_id", R.section_of("text").alias("section"))


@query(
    "display_titles", "P24",
    rf"""SELECT page_id, CASE WHEN d = '' THEN title ELSE d END AS display, trim(regexp_replace(CASE WHEN d = '' THEN title ELSE d END, '\((?:DRAFT|Draft)($|[^A-Za-z0-9_)])[^)]*\)\s*$|\((?:DRAFT|Draft)\)\s*$', '')) AS card,
         left(trim(coalesce(list_filter(string_split(html, chr(10)), lambda x: trim(x) <> '')[1], html)), 48) AS thread
        FROM (SELECT *, trim(regexp_replace(title, '^[^\p{{L}}\p{{N}}]+', '')) AS d FROM (
          SELECT page_id, html, '## ' || regexp_extract(html, '<title>([^<]*)', 1) || CASE WHEN url LIKE 'https%' THEN ' (DRAFT — Needs Review)' ELSE ' (draft)' END AS title FROM pages))""",
)
def display_titles(t: Tables) -> DataFrame:
    title = F.concat(
        F.lit("## "), F.regexp_extract("html", "<title>([^<]*)", 1),
        F.when(F.col("url").startswith("https"), " (DRAFT — Needs Review)").otherwise(" (draft)"),
    )
    first = F.get(F.filter(X.lines_of("html"), lambda x: ~X.is_blank(x)), F.lit(0))
    return t.pages.select(
        "page_id", X.display_title(title).alias("display"), X.card_title(title).alias("card"),
        F.left(X.ws_trim(F.coalesce(first, "html")), F.lit(48)).alias("thread"),
    )


# --- structured answers -------------------------------------------------------


def answer_text(text: Column, turn: Column) -> Column:
    """A structured answer around a turn's own lines; the declaration varies by turn."""
    declaration = (
        F.when(turn == 0, "Coverage: full\n").when(turn == 1, "**Coverage: partial**\n").when(turn == 2, "coverage - none\n")
        .when(turn == 3, "\nCoverage: full Answer: yes\n").when(turn == 4, "").when(turn == 5, "Coverage: maybe\n")
        .when(turn == 6, "**Coverage: full\n").otherwise("Coverage: partial.\n")
    )
    lines = X.lines_of(text)
    steps = F.array_join(F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    gaps = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- gap "), F.left(x, F.lit(12)))), "\n")
    cites = F.array_join(F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". [1] Guide \""), x, F.lit("\""))), "\n")
    return F.concat(
        declaration, F.lit("Situation: noted\nDo now\n"), steps, F.lit("\nTell the patient\nWe call back in two business days.\nWhat the SOPs say:\n"),
        cites, F.lit("\nNot covered by the SOPs\n"), gaps,
        F.when(turn % 2 == 0, "\nOne question: What is the patient's date of birth?").otherwise("\nOne question: Is the form signed?"),
    )


def v_answers(t: Tables) -> DataFrame:
    return spread(t.conversations).select("conv_id", "turn", "role", answer_text(F.col("text"), F.col("turn")).alias("answer"))


def _num(lines: str) -> str:
    return f"array_to_string(list_transform({lines}, lambda x, i: i || '. ' || x), chr(10))"


SQL_ANSWERS = """ans AS (SELECT conv_id, turn, role, CASE turn WHEN 0 THEN 'Coverage: full' || chr(10) WHEN 1 THEN '**Coverage: partial**' || chr(10) WHEN 2 THEN 'coverage - none' || chr(10)
      WHEN 3 THEN chr(10) || 'Coverage: full Answer: yes' || chr(10) WHEN 4 THEN '' WHEN 5 THEN 'Coverage: maybe' || chr(10) WHEN 6 THEN '**Coverage: full' || chr(10) ELSE 'Coverage: partial.' || chr(10) END
   || 'Situation: noted' || chr(10) || 'Do now' || chr(10) || array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: i || '. ' || x), chr(10))
   || chr(10) || 'Tell the patient' || chr(10) || 'We call back in two business days.' || chr(10) || 'What the SOPs say:' || chr(10)
   || array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: i || '. [1] Guide "' || x || '"'), chr(10))
   || chr(10) || 'Not covered by the SOPs' || chr(10) || array_to_string(list_transform(string_split(text, chr(10)), lambda x: '- gap ' || left(x, 12)), chr(10))
   || CASE WHEN turn % 2 = 0 THEN chr(10) || 'One question: What is the patient''s date of birth?' ELSE chr(10) || 'One question: Is the form signed?' END AS answer FROM conversations)"""


@query(
    "step_gap_counts", "A3",
    rf"""WITH {SQL_ANSWERS}, l AS (SELECT conv_id, turn, string_split(answer, chr(10)) AS l FROM ans),
    p AS (SELECT *, list_position(list_transform(l, lambda x: regexp_matches(x, '(?i)^[\s#*]*what the sops say([^A-Za-z0-9_]|$)')), true) AS c,
                 list_position(list_transform(l, lambda x: regexp_matches(x, '(?i)^[\s#*]*not covered by the sops([^A-Za-z0-9_]|$)')), true) AS g,
                 list_position(list_transform(l, lambda x: regexp_matches(x, '(?i)^[\s#*]*one question([^A-Za-z0-9_]|$)')), true) AS q FROM l)
    SELECT conv_id, turn, len(list_filter(l[1:c - 1], lambda x: regexp_matches(x, '^\s*[0-9]+\.\s'))) AS steps,
           len(list_filter(l[g + 1:q - 1], lambda x: regexp_matches(x, '^\s*-\s'))) AS gaps FROM p""",
)
def step_gap_counts(t: Tables) -> DataFrame:
    return v_answers(t).select("conv_id", "turn", A.step_count("answer").alias("steps"), A.gap_count("answer").alias("gaps"))


@query(
    "split_coverage", "P20",
    rf"""WITH {SQL_ANSWERS}, f AS (SELECT *, regexp_extract(answer, '^\s*([^\n]*)', 1) AS line FROM ans)
    SELECT conv_id, turn, CASE WHEN regexp_matches(line, '(?i)^\s*(?:\*\*\s*)?coverage\s*[:\-–—]\s*(full|partial|none)($|[^A-Za-z0-9_])')
       THEN lower(regexp_extract(line, '(?i)^\s*(?:\*\*\s*)?coverage\s*[:\-–—]\s*(full|partial|none)', 1)) END AS coverage FROM f""",
)
def split_coverage(t: Tables) -> DataFrame:
    return A.split_coverage(v_answers(t), "answer").select("conv_id", "turn", "coverage")


SQL_GATE = f"""{SQL_ANSWERS}, gated AS (SELECT conv_id, turn, answer,
    CASE turn WHEN 0 THEN 'full' WHEN 1 THEN 'partial' WHEN 2 THEN 'none' WHEN 3 THEN 'full' WHEN 4 THEN 'none' WHEN 5 THEN 'none' WHEN 6 THEN 'none' ELSE 'partial' END AS coverage,
    CASE turn WHEN 2 THEN 'none' WHEN 4 THEN 'unconfirmed' WHEN 5 THEN 'unconfirmed' WHEN 6 THEN 'unconfirmed' END AS blocked,
    CASE turn WHEN 2 THEN 'none' WHEN 4 THEN 'missing' WHEN 5 THEN 'invalid' WHEN 6 THEN 'invalid' END AS reason,
    CASE WHEN turn IN (2, 4, 5, 6) THEN '' WHEN turn = 3 THEN substr(answer, strpos(answer, 'Answer:')) ELSE substr(answer, strpos(answer, chr(10)) + 1) END AS body FROM ans)"""


@query("gate_coverage", "P21", f"WITH {SQL_GATE} SELECT conv_id, turn, coverage, blocked, reason, md5(body) AS digest FROM gated")
def gate_coverage(t: Tables) -> DataFrame:
    return A.gate_coverage(v_answers(t), "answer").select("conv_id", "turn", "coverage", "blocked", "reason", F.md5("body").alias("digest"))


@query(
    "coverage_report", "A4",
    rf"""WITH {SQL_GATE} SELECT coverage, blocked, count(*) AS answers, count(*) FILTER (reason = 'invalid') AS invalid, count(*) FILTER (reason = 'missing') AS missing,
        count(*) FILTER (reason = 'none' AND len(list_filter(string_split(answer, chr(10)), lambda x: regexp_matches(x, '^\s*[0-9]+\.\s'))) > 0) AS contradictions, CAST(sum(length(body)) AS BIGINT) AS chars FROM gated GROUP BY 1, 2""",
)
def coverage_report(t: Tables) -> DataFrame:
    gated = A.gate_coverage(v_answers(t), "answer").withColumn("steps", A.step_count("answer"))
    return gated.groupBy("coverage", "blocked").agg(
        F.count("*").alias("answers"),
        F.count_if(F.col("reason") == "invalid").alias("invalid"),
        F.count_if(F.col("reason") == "missing").alias("missing"),
        F.count_if((F.col("reason") == "none") & (F.col("steps") > 0)).alias("contradictions"),
        F.sum(F.char_length("body")).cast("bigint").alias("chars"),
    )


_COUNTS = ", ".join(
    rf"""len(list_filter(coalesce({s}l[1:coalesce(list_position(list_transform({s}l, lambda x: regexp_matches(x, '(?i)^[\s#*]*what the sops say([^A-Za-z0-9_]|$)')), true), len({s}l) + 1) - 1], []), lambda x: regexp_matches(x, '^\s*[0-9]+\.\s'))) AS {side}_steps,
    len(list_filter(coalesce({s}l[list_position(list_transform({s}l, lambda x: regexp_matches(x, '(?i)^[\s#*]*not covered by the sops([^A-Za-z0-9_]|$)')), true) + 1:], []), lambda x: regexp_matches(x, '^\s*-\s'))) AS {side}_gaps,
    length({c}) AS {side}_chars"""
    for side, s, c in (("generated", "a", "answer"), ("delivered", "s", "sent"))
)


@query(
    "delivery_stats", "A3 A4 ST4",
    f"""WITH {SQL_GATE}, d AS (SELECT *, CASE blocked WHEN 'none' THEN '{L.BLOCKED_LINES["none"]}' WHEN 'unconfirmed' THEN '{L.BLOCKED_LINES["unconfirmed"]}' ELSE body END AS sent FROM gated),
    l AS (SELECT *, string_split(answer, chr(10)) AS al, string_split(sent, chr(10)) AS sl FROM d), c AS (SELECT *, {_COUNTS} FROM l)
    SELECT conv_id, turn, coverage, reason, generated_steps, delivered_steps, generated_gaps, delivered_gaps, generated_chars, delivered_chars,
        coalesce(reason NOT IN ('missing', 'invalid'), true) AS coverage_line, coalesce(reason = 'none', false) AND generated_steps > 0 AS none_with_steps FROM c""",
)
def delivery_stats(t: Tables) -> DataFrame:
    return A.delivery_stats(v_answers(t), "answer").select(
        "conv_id", "turn", "coverage", "reason", *[f"{side}_{c}" for c in ("steps", "gaps", "chars") for side in ("generated", "delivered")],
        "coverage_line", "none_with_steps",
    )


@query(
    "split_sections", "W12",
    f"""WITH {SQL_ANSWERS}, l AS (SELECT conv_id, turn, unnest(string_split(answer, chr(10))) AS raw, generate_subscripts(string_split(answer, chr(10)), 1) AS line FROM ans),
    h AS (SELECT *, (SELECT max(x) FROM unnest([{", ".join(f"'{h}'" for h in L.ANSWER_HEADINGS)}]) AS hs(x) WHERE trim(raw) = x OR starts_with(trim(raw), x || ':')) AS heading FROM l),
    s AS (SELECT *, count(heading) OVER (PARTITION BY conv_id, turn ORDER BY line ROWS UNBOUNDED PRECEDING) AS ord FROM h)
    SELECT conv_id, turn, ord - 1 AS ord, max(heading) AS heading,
           md5(trim(string_agg(CASE WHEN heading IS NOT NULL THEN regexp_replace(substr(trim(raw), length(heading) + 1), '^:\\s*', '') ELSE raw END, chr(10) ORDER BY line), E' \\n\\t')) AS digest
    FROM s WHERE ord > 0 GROUP BY conv_id, turn, ord""",
)
def split_sections(t: Tables) -> DataFrame:
    keyed = v_answers(t).select(F.struct("conv_id", "turn").alias("id"), "answer")
    return A.split_sections(keyed, "id", "answer").select(
        "id.conv_id", "id.turn", "ord", "heading", F.md5("body").alias("digest")
    )


@query(
    "repair_lists", "W13",
    rf"""WITH l AS (SELECT page_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM (
            SELECT page_id, replace(text, '- ', '2. ') AS text FROM md)),
    k AS (SELECT *, trim(raw) = '' AS blank, regexp_matches(raw, '^ {{0,3}}[0-9]+\. ') AS num, lag(trim(raw) <> '') OVER w AS prev FROM l WINDOW w AS (PARTITION BY page_id ORDER BY line)),
    p AS (SELECT *, sum(CASE WHEN blank THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS para FROM k),
    o AS (SELECT *, sum(CASE WHEN num THEN 1 ELSE 0 END) OVER (PARTITION BY page_id, para ORDER BY line ROWS UNBOUNDED PRECEDING) AS nth FROM p)
    SELECT page_id, md5(string_agg(CASE WHEN num AND nth = 1 AND coalesce(prev, false) THEN chr(10) || raw ELSE raw END, chr(10) ORDER BY line)) AS digest FROM o GROUP BY page_id""".replace("WITH l AS", f"WITH {SQL_MARKDOWN}, l AS", 1),
)
def repair_lists(t: Tables) -> DataFrame:
    md = v_markdown(t).withColumn("text", F.replace("text", F.lit("- "), F.lit("2. ")))
    return md.select("page_id", F.md5(A.repair_lists("text")).alias("digest"))


@query(
    "drop_identity_question", "P22",
    f"WITH {SQL_ANSWERS} SELECT conv_id, turn, turn % 2 = 0 AS dropped, md5(CASE WHEN turn % 2 = 0 THEN regexp_replace(substr(answer, 1, strpos(answer, chr(10) || 'One question: What') - 1), '\\s+$', '') ELSE answer END) AS digest FROM ans",
)
def drop_identity_question(t: Tables) -> DataFrame:
    return A.drop_identity_question(v_answers(t), "answer").select("conv_id", "turn", "dropped", F.md5("answer").alias("digest"))


@query(
    "grade_answers", "P23",
    f"""WITH {SQL_ANSWERS} SELECT conv_id, turn, role = 'assistant' AS scored, CASE WHEN role = 'assistant' THEN turn % 2 <> 0 END AS one_question,
        CASE WHEN role = 'assistant' THEN true END AS gap_gate, CASE WHEN role = 'assistant' AND turn = 1 THEN true END AS timeframe FROM ans""",
)
def grade_answers(t: Tables) -> DataFrame:
    cases = v_answers(t).withColumns(
        {"case": F.when(F.col("turn") == 1, "B3").otherwise("A1"), "scored": F.col("role") == "assistant"}
    )
    return A.grade_answers(cases, "case", "answer", "scored").select("conv_id", "turn", "scored", "one_question", "gap_gate", "timeframe")


@query(
    "answer_steps", "P23",
    """WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS step FROM conversations)
    SELECT conv_id, turn, CAST(step AS BIGINT) AS step, md5(trim(line)) AS digest FROM l""",
)
def answer_steps(t: Tables) -> DataFrame:
    return X.unroll(A.answer_parts(v_answers(t), "answer"), ["conv_id", "turn"], A.steps_of("head"), "step", "text").select(
        "conv_id", "turn", F.col("step").cast("bigint").alias("step"), F.md5("text").alias("digest")
    )


#: What a step of a coded answer starts with, by the turn and the step's place.
CODED = (
    "Select the correct code. ", "Ask the provider for the diagnosis code: ", "Do not change the code. ", "The prescriber chooses; enter it. ",
    "Note the visit. Then pick a code. ", "Add the required ICD-10 code ", "Confirm the date. ",
)


def v_coded_answers(t: Tables) -> DataFrame:
    """Answers whose steps handle codes in every way the grades tell apart; each turn has its own run of ways."""
    ways = F.array(*[F.lit(w) for w in CODED])
    step = lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), F.get(ways, F.pmod(F.col("conv_id") + F.col("turn") * 3 + i, F.lit(len(CODED))).cast("int")), x)
    answer = F.concat(
        F.lit("Do now\n"), F.array_join(F.transform(X.lines_of("text"), step), "\n"), F.lit("\n**What the SOPs say:**\nSelect the code.\nNot covered by the SOPs\n- "),
        F.when(F.col("turn") % 2 == 0, "the specific steps for codes").otherwise("opening hours"),
    )
    return spread(t.conversations).select("conv_id", "turn", answer.alias("answer"))


@query(
    "grade_codes", "P23",
    rf"""WITH w AS (SELECT [{", ".join(f"'{w}'" for w in CODED)}] AS ways),
    l AS (SELECT conv_id, turn, i, ways[(conv_id + turn * 3 + i) % {len(CODED)} + 1] || x AS step FROM w, (
        SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM conversations)),
    c AS (SELECT *, regexp_replace(regexp_replace(step, '([.!?])\s', '\1' || chr(1)), chr(1) || '[\s\S]*$', '') AS clause FROM l),
    g AS (SELECT *, regexp_matches(step, '(?i)\b(icd-?10|diagnosis code|code)\b') AS coded,
        regexp_matches(clause, '(?i)\b(route|ask|send|flag|notify|never|do not|don''t)\b') AS handed,
        regexp_matches(clause, '(?i)\b(add|change|select|choose|determine|enter|pick|apply|update|use)\s+((a|an|the|correct|clinically|appropriate|medicare-covered|required|diagnosis|icd-?10)\s+){{0,6}}(code|it)\b') AS chooses,
        regexp_matches(step, '(?i)\b(route|ask|send|flag|notify)\b[^.
]{{0,150}}\b(provider|prescriber)\b|\b(provider|prescriber)\b[^.
]{{0,80}}\b(selects|chooses|decides)\b') AS routed FROM c)
    SELECT conv_id, turn, NOT bool_or(coded) OR bool_and(handed OR NOT chooses) AS reserve, bool_or(routed) AS routing, turn % 2 <> 0 AS gap_gate, count(*) AS steps FROM g GROUP BY conv_id, turn""",
)
def grade_codes(t: Tables) -> DataFrame:
    """Who settles a code, and whether the work is handed on, for answers that do it in all ways."""
    cases = v_coded_answers(t).withColumns({"case": F.lit("A1"), "scored": F.lit(True)})
    return A.grade_answers(cases, "case", "answer", "scored").select("conv_id", "turn", "reserve", "routing", "gap_gate", "steps")


@query(
    "reason_for", "P28",
    f"""WITH {SQL_ANSWERS} SELECT conv_id, turn, nullif(regexp_extract(substr(answer, strpos(answer, 'What the SOPs say') - 1 + strpos(substr(lower(answer), strpos(answer, 'What the SOPs say')), 'guide'), 600), '"([^"]{{10,450}})"', 1), '') AS reason FROM ans""",
)
def reason_for(t: Tables) -> DataFrame:
    return v_answers(t).select("conv_id", "turn", A.reason_for("answer", F.lit("\u2605 Guide")).alias("reason"))


@query(
    "hold_tail", "ST3",
    f"WITH {SQL_ANSWERS} SELECT conv_id, turn, md5(substr(answer, 1, strpos(answer, 'SOPs say:') + 8)) AS shown, md5(substr(answer, strpos(answer, 'SOPs say:') + 9)) AS held FROM ans",
)
def hold_tail(t: Tables) -> DataFrame:
    return A.hold_tail(v_answers(t), "answer").select("conv_id", "turn", F.md5("shown").alias("shown"), F.md5("held").alias("held"))


@query(
    "split_tail", "P30 W11",
    f"""WITH {SQL_ANSWERS}, l AS (SELECT a.conv_id, a.turn, i AS item, x AS line FROM ans a JOIN conversations c USING (conv_id, turn),
          LATERAL (SELECT unnest(string_split(c.text, chr(10))) AS x, generate_subscripts(string_split(c.text, chr(10)), 1) AS i))
    SELECT conv_id, turn, CAST(item AS BIGINT) AS item, CAST(1 AS BIGINT) AS label, 'Guide' AS head, CASE WHEN trim(line) = '' OR contains(line, '"') THEN NULL ELSE md5(line) END AS digest FROM l""",
)
def split_tail(t: Tables) -> DataFrame:
    held = A.hold_tail(v_answers(t), "answer")
    items = A.parse_items(A.split_tail(held, "held"), ["conv_id", "turn"], "items")
    return items.select("conv_id", "turn", "item", "label", "head", F.md5(F.get("quotes", F.lit(0))).alias("digest"))
