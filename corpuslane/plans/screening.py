"""Registered queries: identifier scans, redaction, message gates and URL logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslane.functions import lexicon as L
from corpuslane.functions import text as X
from corpuslane.operators import context as C
from corpuslane.operators import screen as S
from corpuslane.plans.registry import query
from corpuslane.session import Tables, spread

EMAIL_SQL = r"(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"
SSN_SQL = r"(^|[^0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}($|[^0-9])"
PHONE_SQL = r"(^|[^0-9])(?:\+?1[\s.-]?)?\(?[0-9]{3}\)?[\s.-]?[0-9]{3}[\s.-]?[0-9]{4}($|[^0-9])"


def v_notes(t: Tables) -> DataFrame:
    """One short note per order, exercising every identifier rule and its exemptions."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    p = F.substring("o_orderpriority", 1, 1)
    pad = lambda c, n, ch: F.lpad(F.col(c).cast("string"), n, ch)
    note = (
        F.when(p == "1", F.concat(F.lit("Patient file, DOB "), F.repeat(F.lit("on file "), (F.col("o_custkey") % 12).cast("int")), day, F.lit(" seen")))
        .when(p == "2", F.concat(F.lit("chart "), F.repeat(F.lit("no "), (F.col("o_custkey") % 7).cast("int")), pad("o_custkey", 10, "4"), F.lit(" reviewed")))
        .when(p == "3", F.concat(F.lit("call (415) 555-"), F.right(pad("o_custkey", 8, "0"), F.lit(4)), F.lit(" about chart")))
        .when(p == "4", F.concat(F.lit("seen on "), day, F.lit(". "), F.repeat(F.lit("x "), (F.col("o_custkey") % 40).cast("int")), F.lit("born elsewhere")))
        .when(F.col("o_orderstatus") == "F", F.concat(F.lit("id 123-45-"), F.right(pad("o_orderkey", 8, "0"), F.lit(4))))
        .otherwise(F.concat(F.lit("order "), pad("o_orderkey", 10, "7"), F.lit(" shipped")))
    )
    return t.orders.select(F.col("o_orderkey").alias("note_id"), note.alias("text"))


SQL_NOTES = """notes AS (SELECT o_orderkey AS note_id, CASE substr(o_orderpriority, 1, 1)
    WHEN '1' THEN 'Patient file, DOB ' || repeat('on file ', o_custkey % 12) || strftime(o_orderdate, '%Y-%m-%d') || ' seen'
    WHEN '2' THEN 'chart ' || repeat('no ', o_custkey % 7) || lpad(CAST(o_custkey AS VARCHAR), 10, '4') || ' reviewed'
    WHEN '3' THEN 'call (415) 555-' || right(lpad(CAST(o_custkey AS VARCHAR), 8, '0'), 4) || ' about chart'
    WHEN '4' THEN 'seen on ' || strftime(o_orderdate, '%Y-%m-%d') || '. ' || repeat('x ', o_custkey % 40) || 'born elsewhere'
    ELSE CASE WHEN o_orderstatus = 'F' THEN 'id 123-45-' || right(lpad(CAST(o_orderkey AS VARCHAR), 8, '0'), 4)
              ELSE 'order ' || lpad(CAST(o_orderkey AS VARCHAR), 10, '7') || ' shipped' END END AS text FROM orders),
marks AS (SELECT *, regexp_extract(text, '(DOB|born)') AS kw, regexp_extract(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AS dt,
                 regexp_extract(text, 'chart') AS rk, regexp_extract(text, '[0-9]{10}') AS bare FROM notes),
pos AS (SELECT *, strpos(text, kw) - 1 AS ks, strpos(text, kw) - 1 + length(kw) AS ke, strpos(text, dt) - 1 AS ds, strpos(text, dt) - 1 + length(dt) AS de,
               strpos(text, rk) - 1 AS rs, strpos(text, rk) - 1 + length(rk) AS re, strpos(text, bare) - 1 AS bs, strpos(text, bare) - 1 + length(bare) AS be FROM marks),
flags AS (SELECT *, kw <> '' AND dt <> '' AND greatest(ks - de, ds - ke, 0) <= 48 AS dob, bare <> '' AND NOT (rk <> '' AND greatest(rs - be, bs - re, 0) <= 12) AS bare_phone,
                 regexp_matches(text, '\\(415\\) 555-[0-9]{4}') AS phone, regexp_matches(text, '123-45-[0-9]{4}') AS ssn FROM pos)"""


@query(
    "identifier_scan", "P6",
    f"""SELECT doc_id, reason FROM (SELECT doc_id,
          CASE WHEN regexp_matches(text, '{SSN_SQL}') THEN 'a Social Security number'
               WHEN regexp_matches(text, '{EMAIL_SQL}') THEN 'an email address'
               WHEN regexp_matches(text, '{PHONE_SQL}') THEN 'a phone number' END AS reason FROM documents) WHERE reason IS NOT NULL""",
)
def identifier_scan(t: Tables) -> DataFrame:
    """Whole documents; none mentions a birth date keyword near a date."""
    return (
        spread(t.documents.select("doc_id", "text"))
        .select("doc_id", S.identifier_reason("text").alias("reason"))
        .filter(F.col("reason").isNotNull())
    )


@query(
    "identifier_rollup", "P6",
    f"""SELECT source, lang, count(*) AS docs, count(*) FILTER (regexp_matches(text, '{EMAIL_SQL}')) AS emails,
               count(*) FILTER (regexp_matches(text, '{PHONE_SQL}')) AS phones, count(*) FILTER (regexp_matches(text, '{SSN_SQL}')) AS ssns
        FROM documents GROUP BY 1, 2""",
)
def identifier_rollup(t: Tables) -> DataFrame:
    d = spread(t.documents.select("source", "lang", "text"))
    return d.groupBy("source", "lang").agg(
        F.count("*").alias("docs"),
        F.count_if(F.col("text").rlike(L.EMAIL)).alias("emails"),
        F.count_if(F.col("text").rlike(L.PHONE)).alias("phones"),
        F.count_if(F.col("text").rlike(L.SSN)).alias("ssns"),
    )


@query(
    "note_scan", "P6 J1 J2",
    f"""WITH {SQL_NOTES} SELECT note_id, CASE WHEN ssn THEN 'a Social Security number' WHEN dob THEN 'a date of birth'
            WHEN phone OR bare_phone THEN 'a phone number' END AS reason FROM flags""",
)
def note_scan(t: Tables) -> DataFrame:
    return spread(v_notes(t)).select("note_id", S.identifier_reason("text").alias("reason"))


@query(
    "near_birth_dates", "J1 U1",
    f"WITH {SQL_NOTES} SELECT note_id, CAST(ks AS BIGINT) AS keyword_start, CAST(ds AS BIGINT) AS target_start, kw AS keyword, dt AS target FROM flags WHERE dob",
)
def near_birth_dates(t: Tables) -> DataFrame:
    return S.near_pairs(spread(v_notes(t)), "note_id", "text", L.BIRTH_KEYWORD, L.DATE, L.BIRTH_DATE_GAP)


@query(
    "contact_phones", "J2 U1",
    rf"""WITH {SQL_NOTES} SELECT note_id, CAST(bs AS BIGINT) AS start, bare AS phone FROM flags WHERE bare_phone
    UNION ALL SELECT note_id, CAST(strpos(text, '(415)') - 1 AS BIGINT), regexp_extract(text, '\(415\) 555-[0-9]{{4}}') FROM flags WHERE phone""",
)
def contact_phones(t: Tables) -> DataFrame:
    return X.unroll(spread(v_notes(t)), ["note_id"], S.contact_phone_spans("text"), "i", "p").select(
        "note_id", F.col("p.start").cast("bigint").alias("start"), F.col("p.text").alias("phone")
    )


def v_people_text(t: Tables) -> DataFrame:
    """One sentence per customer with names, addresses or member ids by market segment."""
    seg, key = F.col("c_mktsegment"), F.col("c_custkey").cast("string")
    text = (
        F.when(seg == "AUTOMOBILE", F.concat(F.lit("mail to "), key, F.lit(" Copper Hollow Avenue today")))
        .when(seg == "BUILDING", F.concat(F.lit("Member ID: AB-"), F.lpad(key, 6, "0")))
        .when(seg == "FURNITURE", F.concat(F.lit("the patient in Lantern Imaging asked, ref "), key))
        .when(seg == "HOUSEHOLD", F.concat(F.lit("my patient, Tobias Van Quillen, ref "), key))
        .otherwise(F.concat(F.lit("Mrs. Pemberly called about order "), key))
    )
    return t.customer.select("c_custkey", text.alias("text"))


@query(
    "warn_identifiers", "P7",
    r"""SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'a street address' WHEN 'BUILDING' THEN 'an insurance or member ID'
        WHEN 'FURNITURE' THEN NULL ELSE 'a patient name' END AS warning FROM customer""",
)
def warn_identifiers(t: Tables) -> DataFrame:
    return v_people_text(t).select("c_custkey", S.warning_noun("text").alias("warning"))


STREET_SQL = r"(^|[^A-Za-z0-9_])[0-9]{1,6}\s+(?:[A-Z][a-z]{1,15}\s){1,3}(?:[Ss]treet|[Ss]t|[Aa]venue|[Aa]ve|[Rr]oad|[Rr]d|[Bb]oulevard|[Bb]lvd|[Ll]ane|[Ll]n|[Dd]rive|[Dd]r|[Cc]ourt|[Cc]t|[Pp]lace|[Pp]l|[Ww]ay)($|[^A-Za-z0-9_])"
# no document holds a name in a patient's place or a member id; planted documents test those rules
SQL_WARNED = f"SELECT doc_id, CASE WHEN regexp_matches(text, '{STREET_SQL}') THEN 'a street address' END AS warning FROM documents"


@query("warn_documents", "P7", SQL_WARNED)
def warn_documents(t: Tables) -> DataFrame:
    """The soft warning of each whole document, by all its rules."""
    return spread(t.documents.select("doc_id", "text")).select("doc_id", S.warning_noun("text").alias("warning"))


@query("exempt_staff", "J29",
       "SELECT c_custkey, 'Tobias Van Quillen' AS name FROM customer WHERE c_mktsegment = 'HOUSEHOLD'")
def exempt_staff(t: Tables) -> DataFrame:
    """Names the soft screen would flag, minus directory staff (one name per region)."""
    flagged = S.candidate_names(v_people_text(t), "c_custkey", "text")
    people = t.region.select(F.when(F.col("r_regionkey") == 0, "Pemberly").otherwise(F.col("r_name")).alias("name"))
    return S.exempt_staff(flagged, S.staff_names(people))


@query(
    "redact_blocked", "P8",
    f"""SELECT conv_id, turn, CASE WHEN reason IS NULL THEN md5(text) ELSE md5('[withheld]') END AS digest, reason FROM (
         SELECT *, CASE WHEN role = 'user' THEN CASE WHEN regexp_matches(text, '{SSN_SQL}') THEN 'a Social Security number'
               WHEN regexp_matches(text, '{EMAIL_SQL}') THEN 'an email address'
               WHEN regexp_matches(text, '{PHONE_SQL}') THEN 'a phone number' END END AS reason
         FROM (SELECT conv_id, turn, role, CASE WHEN turn = 2 THEN text || ' reach me at a.b@mail.example.com' WHEN turn = 4 THEN text || ' 212-555-0147' ELSE text END AS text FROM conversations))""",
)
def redact_blocked(t: Tables) -> DataFrame:
    """Third and fifth turns carry contact details; only user turns are withheld."""
    text = F.when(F.col("turn") == 2, F.concat("text", F.lit(" reach me at a.b@mail.example.com"))).when(
        F.col("turn") == 4, F.concat("text", F.lit(" 212-555-0147"))
    ).otherwise(F.col("text"))
    c = t.conversations.select("conv_id", "turn", "role", text.alias("text"))
    return S.redact_blocked(c, "text", "role").select("conv_id", "turn", F.md5("text").alias("digest"), "reason")


@query(
    "redact_ids", "P9",
    "SELECT doc_id, md5(r) AS digest, CAST((length(r) - length(replace(r, '<id>', ''))) // 4 AS BIGINT) AS ids FROM (SELECT doc_id, regexp_replace(text, '(?i)[0-9a-f]{32}|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}', '<id>', 'g') AS r FROM documents)",
)
def redact_ids(t: Tables) -> DataFrame:
    r = spread(t.documents.select("doc_id", "text")).withColumn("r", X.redact_ids("text"))
    ids = (F.char_length("r") - F.char_length(F.replace("r", F.lit("<id>"), F.lit("")))) / 4
    return r.select("doc_id", F.md5("r").alias("digest"), ids.cast("bigint").alias("ids"))


@query(
    "redact_names", "P10 T6",
    """WITH n AS (SELECT list(name ORDER BY length(name) DESC, name) AS names FROM (SELECT DISTINCT string_split(text, ' ')[1] AS name FROM benchmark) WHERE name <> '')
    SELECT doc_id, md5(list_reduce(names, lambda acc, x: replace(acc, x, '<person>'), text)) AS digest FROM documents, n""",
)
def redact_names(t: Tables) -> DataFrame:
    """The first word of every benchmark item stands for a directory name."""
    names = t.benchmark.select(F.split("text", " ")[0].alias("name"))
    return S.redact_names(spread(t.documents.select("doc_id", "text")), names, "text").select("doc_id", F.md5("text").alias("digest"))


def v_errors(t: Tables) -> DataFrame:
    v = F.col("value")
    return t.events.select(
        "event_id",
        F.when(F.col("event_type") == "purchase", "generation").otherwise("retrieval").alias("stage"),
        F.concat(
            F.when(v > 150, "AllocationExceeded").when(v > 100, "monthly budget reached").when(v > 60, "context window full").when(v > 30, "Rate limit").otherwise("timeout"),
            F.lit(" "), F.col("event_type"),
        ).alias("message"),
    )


SQL_ERRORS = """errs AS (SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'generation' ELSE 'retrieval' END AS stage,
   CASE WHEN value > 150 THEN 'AllocationExceeded' WHEN value > 100 THEN 'monthly budget reached' WHEN value > 60 THEN 'context window full' WHEN value > 30 THEN 'Rate limit' ELSE 'timeout' END || ' ' || event_type AS message FROM events),
kinds AS (SELECT *, CASE WHEN regexp_matches(message, '(?i)allocation.?exceeded|7094') THEN 'allocation' WHEN regexp_matches(message, '(?i)budget|spend.?limit|cost.?limit') THEN 'spend-limit'
   WHEN regexp_matches(message, '(?i)5021|context.?window|context length|too many tokens|maximum context') THEN 'context-overflow'
   WHEN regexp_matches(message, '(?i)rate.?limit|429') THEN 'rate-limit' ELSE stage END AS kind FROM errs)"""


@query("classify_errors", "P14", f"WITH {SQL_ERRORS} SELECT event_id, kind FROM kinds")
def classify_errors(t: Tables) -> DataFrame:
    return v_errors(t).select("event_id", S.classify_error("stage", "message").alias("kind"))


@query(
    "flag_truncated", "P15",
    """SELECT conv_id, turn, CASE WHEN role = 'assistant' AND length(text) > 500 THEN length(text) * 3 >= 3000 WHEN trim(text, E' \\n\\t') = '' THEN false
         ELSE NOT contains(lower(text || CASE WHEN role = 'user' THEN chr(10) || 'Not covered by the SOPs' ELSE '' END), 'not covered by the sops') END AS truncated FROM conversations""",
)
def flag_truncated(t: Tables) -> DataFrame:
    """Long assistant turns report a token count; the others are judged by their ending."""
    n = F.char_length("text")
    tokens = F.when((F.col("role") == "assistant") & (n > 500), n * 3)
    text = F.concat("text", F.when(F.col("role") == "user", F.lit("\nNot covered by the SOPs")).otherwise(""))
    return t.conversations.select("conv_id", "turn", S.truncated(tokens, text).alias("truncated"))


@query(
    "length_gate", "P17",
    "SELECT doc_id, length(text) <= 8000 AS accepted, CASE WHEN length(text) > 8000 THEN 'over' WHEN length(text) >= 7000 THEN 'near' ELSE 'ok' END AS band FROM documents",
)
def length_gate(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id", (F.char_length("text") <= L.MESSAGE_CHARS).alias("accepted"), S.length_band("text").alias("band")
    )


@query(
    "drop_courtesies", "P12",
    r"""SELECT conv_id, turn FROM (SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'Thank you!!' WHEN length(text) < 60 THEN 'thanks ' || text ELSE text END AS content FROM conversations)
        WHERE NOT regexp_matches(content, '(?i)^(thanks|thank you|thanks so much|ty|thx|cheers)[.! ]*$')""",
)
def drop_courtesies(t: Tables) -> DataFrame:
    content = F.when(F.col("role") == "system", "Thank you!!").when(
        F.char_length("text") < 60, F.concat(F.lit("thanks "), "text")
    ).otherwise(F.col("text"))
    return t.conversations.filter(~content.rlike(L.COURTESY)).select("conv_id", "turn")


@query("text_windows", "W6",
       """SELECT doc_id, CAST(k AS BIGINT) AS win, length(substr(text, 1 + 1800 * k, 2000)) AS chars, md5(substr(text, 1 + 1800 * k, 2000)) AS digest FROM (
            SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) <= 2000 THEN 1 ELSE CAST(ceil((length(text) - 2000) / 1800.0) AS BIGINT) + 1 END)) AS k FROM documents)""")
def text_windows(t: Tables) -> DataFrame:
    return C.text_windows(spread(t.documents.select("doc_id", "text"))).select(
        "doc_id", F.col("win").cast("bigint").alias("win"), F.char_length("window_text").cast("bigint").alias("chars"), F.md5("window_text").alias("digest")
    )


SQL_FLAGGED = rf"""SELECT doc_id, coalesce(bool_or(regexp_matches(substr(text, 1 + 1800 * k, 2000), '{SSN_SQL}') OR regexp_matches(substr(text, 1 + 1800 * k, 2000), '{EMAIL_SQL}')
              OR regexp_matches(substr(text, 1 + 1800 * k, 2000), '{PHONE_SQL}')), false) AS flagged FROM (
            SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) <= 2000 THEN 1 ELSE CAST(ceil((length(text) - 2000) / 1800.0) AS BIGINT) + 1 END)) AS k FROM documents) GROUP BY 1"""


@query("any_flagged", "A16", SQL_FLAGGED)
def any_flagged(t: Tables) -> DataFrame:
    """Any window that trips any rule of the hard screen, decided inside the row, so no grouping shuffle is needed. No
    document mentions a birth date keyword near a date, so the twin leaves that rule out."""
    return spread(t.documents.select("doc_id", "text")).select(
        "doc_id", F.coalesce(F.exists(C.window_array("text"), lambda w: S.identifier_reason(w).isNotNull()), F.lit(False)).alias("flagged")
    )


@query("any_identifier", "A16", SQL_FLAGGED)
def any_identifier(t: Tables) -> DataFrame:
    """The same screen over windows as rows: one row a window, brought together by document."""
    windows = C.text_windows(spread(t.documents.select("doc_id", "text")))
    return windows.groupBy("doc_id").agg(F.coalesce(F.bool_or(S.identifier_reason("window_text").isNotNull()), F.lit(False)).alias("flagged"))


@query("document_warnings", "P7", f"SELECT coalesce(warning, 'none') AS warning, count(*) AS documents FROM ({SQL_WARNED}) GROUP BY 1")
def document_warnings(t: Tables) -> DataFrame:
    """How many documents get which soft warning."""
    return warn_documents(t).groupBy(F.coalesce("warning", F.lit("none")).alias("warning")).agg(F.count("*").alias("documents"))


@query("dedupe_text", "X6", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY lower(text)")
def dedupe_text(t: Tables) -> DataFrame:
    return S.first_text_rows(t.documents.select("doc_id", "text"), "text", "doc_id").select("doc_id")


@query("lint_hints", "P26", "SELECT doc_id, regexp_matches(text, '(?i)#[a-z][a-z0-9_-]{2,}|@[a-z]') AS names_someone FROM documents")
def lint_hints(t: Tables) -> DataFrame:
    return spread(t.documents.select("doc_id", "text")).select("doc_id", F.col("text").rlike(L.CHANNEL_OR_PERSON).alias("names_someone"))


@query(
    "message_text", "P27",
    r"""SELECT conv_id, turn, md5(regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT starts_with(x, 'T')), chr(10)), '^\s+|\s+$', '', 'g')) AS digest FROM conversations""",
)
def message_text(t: Tables) -> DataFrame:
    """Each line is a part; lines starting with T play the tool parts that are dropped."""
    parts = F.transform(
        X.lines_of("text"),
        lambda x: F.struct(F.when(x.startswith("T"), "tool").otherwise("text").alias("type"), x.alias("text")),
    )
    return t.conversations.select("conv_id", "turn", F.md5(S.message_text(parts)).alias("digest"))


@query("search_titles", "P31", "SELECT doc_id, string_split(text, chr(10))[1] AS title FROM documents WHERE contains(lower(string_split(text, chr(10))[1]), 'tion')")
def search_titles(t: Tables) -> DataFrame:
    title = F.substring_index("text", "\n", 1)
    return t.documents.select("doc_id", title.alias("title")).filter(F.contains(F.lower("title"), F.lower(F.lit("TION"))))


@query(
    "recent_listing", "T5",
    "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 30",
)
def recent_listing(t: Tables) -> DataFrame:
    """Thirty latest entries per user; the rank limit prunes before the shuffle."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return t.events.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= 30).select("user_id", "event_id")


@query("object_listing", "T5", "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 500")
def object_listing(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "source").orderBy("doc_id").limit(500)


@query("strip_urls", "P25",
       r"""SELECT page_id, regexp_replace(html, '\(?https?://\S+\)?', '', 'g') <> html AS had_url, md5(regexp_replace('see (' || url || ') and ' || url || ' end', '\(?https?://\S+\)?', '', 'g')) AS digest FROM pages""")
def strip_urls(t: Tables) -> DataFrame:
    text = F.concat(F.lit("see ("), "url", F.lit(") and "), "url", F.lit(" end"))
    return t.pages.select("page_id", (S.strip_urls("html") != F.col("html")).alias("had_url"), F.md5(S.strip_urls(text)).alias("digest"))


@query(
    "landing_urls", "S10",
    r"""WITH u AS (SELECT page_id, regexp_extract(url, '\?([^#]*)', 1) AS own, url, regexp_extract(html, '<title>([^<]*)', 1) AS title FROM pages),
    q AS (SELECT page_id, CASE WHEN own = '' THEN '2' ELSE '1' END AS v, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS link_text,
                 CASE WHEN own LIKE 'page%' THEN 'ask' ELSE 'edit' END AS act, regexp_extract(own, '(?:^|&)ref=([^&#]*)', 1) AS r, own LIKE '%ref=%' AS has_ref FROM u)
    SELECT page_id, CASE WHEN act = 'ask' AND length(link_text) <= 30 THEN 'ask' ELSE 'draft' END AS action, link_text,
           CASE WHEN regexp_matches(split_part(link_text, '/', 2), '^[a-z0-9-]{1,16}$') THEN split_part(link_text, '/', 2) END AS src,
           CASE WHEN has_ref AND regexp_matches(r, '^[A-Za-z0-9][A-Za-z0-9_-]{0,63}$') THEN r END AS ref
    FROM q WHERE v = '1' AND link_text <> ''""",
)
def landing_urls(t: Tables) -> DataFrame:
    """Landing log built from each page URL: its host and path become the encoded question."""
    own = F.regexp_extract("url", r"\?([^#]*)", 1)
    bare = X.chain("url", ("^https?://", ""), ("[?#].*$", ""))
    log = F.concat(
        F.lit("/app?v="), F.when(own == "", "2").otherwise("1"),
        F.lit("&q="), F.url_encode(bare),
        F.lit("&action="), F.when(own.startswith("page"), "ask").otherwise("edit"),
        F.lit("&src="), F.get(F.split(bare, "/"), F.lit(1)),
        F.when(own != "", F.concat(F.lit("&"), own)).otherwise(""),
    )
    return S.parse_landing_urls(t.pages.select("page_id", log.alias("landing")), "landing", max_chars=30).select(
        "page_id", "action", "link_text", "src", "ref"
    )
