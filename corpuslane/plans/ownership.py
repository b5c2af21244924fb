"""Registered queries: directories, owner matching and routing consistency.

People of the routing checks are one for each part: their work is the part, their department and routing
department the nation and region of a supplier, and the suppliers take turns. Owner matching uses one entry
per document source, with every whole document of the source as a responsibility line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslane.functions import lexicon as L
from corpuslane.functions import text as X
from corpuslane.operators import context as C
from corpuslane.operators import owners as O
from corpuslane.operators import routing as G
from corpuslane.plans.conversations import owner_query_of, sql_words
from corpuslane.plans.registry import query
from corpuslane.session import Tables, materialize, spread
from corpuslane.sources import directory as D

# --- owner matching over document sources ------------------------------------------


def v_entries(t: Tables) -> DataFrame:
    """One person per source: titled by the source's languages, priority by its length mix."""
    d = t.documents
    return d.groupBy("source").agg(
        F.array_join(F.array_sort(F.collect_set("lang")), " ").alias("title"), F.max("n_chars").alias("longest")
    ).select(
        F.regexp_extract("source", r"([0-9]+)$", 1).cast("bigint").alias("person"), F.col("source").alias("name"), "title",
        F.when(F.col("longest") > 20000, "P0").when(F.col("longest") > 5000, "P1").otherwise("P2").alias("priority"),
        F.regexp_extract("source", r"([0-9]+)$", 1).cast("bigint").alias("ord"),
    ).withColumns({
        "department": F.concat(F.lit("Desk "), "priority"), "slack": F.when(F.col("priority") == "P0", F.concat(F.lit("#"), "name")).otherwise(""),
        "dashboard": F.when(F.col("priority") == "P1", F.concat("name", F.lit(" (unverified)"))).otherwise(""),
        "backup": F.when(F.col("person") % 3 == 0, F.concat(F.lit("whoever  "), F.repeat(F.lit("covers the desk next to it and then "), (F.col("person") % 4).cast("int")), F.lit("answers"))).otherwise(""),
    })


def v_owner_lines(t: Tables) -> DataFrame:
    return spread(t.documents).select(
        F.regexp_extract("source", r"([0-9]+)$", 1).cast("bigint").alias("person"), F.col("doc_id").alias("line_no"),
        F.col("text").alias("line"), (F.col("lang") != "en").alias("route"),
    )


def v_systems(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("person"), F.substring_index("text", "\n", 1).alias("system"))


def v_messages(t: Tables) -> DataFrame:
    turns = t.conversations.select("conv_id", "turn", "role", F.col("text").alias("content"))
    return owner_query_of(turns).select(F.col("conv_id").alias("msg_id"), F.col("query").alias("text"))


SQL_INDEX = f"""people AS (SELECT CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) AS person, source AS name, string_agg(DISTINCT lang, ' ' ORDER BY lang) AS title,
     CASE WHEN max(n_chars) > 20000 THEN 'P0' WHEN max(n_chars) > 5000 THEN 'P1' ELSE 'P2' END AS priority FROM documents GROUP BY source),
names AS (SELECT DISTINCT unnest({sql_words('name')}) AS word FROM people),
lw AS (SELECT DISTINCT CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) AS person, doc_id AS line_no, lang <> 'en' AS route, unnest({sql_words('text')}) AS word FROM documents),
owned AS (SELECT DISTINCT person, word FROM lw WHERE word NOT IN (SELECT word FROM names)),
titled AS (SELECT DISTINCT person, unnest({sql_words('title')}) AS word FROM people),
both_ AS (SELECT * FROM owned UNION ALL SELECT * FROM titled),
products AS (SELECT DISTINCT unnest({sql_words('token')}) AS word FROM (SELECT unnest(regexp_split_to_array(string_split(text, chr(10))[1], '\\s+')) AS token FROM benchmark) WHERE regexp_matches(token, '^[A-Z]')),
n AS (SELECT count(*) AS n FROM people),
weights AS (SELECT word, count(DISTINCT person) AS df, ln(1 + max(n) / (count(DISTINCT person) + 1)) / ln(1 + max(n) / 2) * CASE WHEN word IN (SELECT word FROM products) THEN 0.3 ELSE 1.0 END AS weight
            FROM both_, n GROUP BY word)"""

SQL_MESSAGES = f"""u AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role = 'user'),
two AS (SELECT conv_id, max(CASE WHEN r = 1 THEN text END) AS latest, max(CASE WHEN r = 2 THEN text END) AS previous FROM u WHERE r <= 2 GROUP BY 1),
msgs AS (SELECT conv_id AS msg_id, CASE WHEN previous IS NOT NULL AND len({sql_words('latest')}) < 4 THEN previous || chr(10) || latest ELSE latest END AS text FROM two)"""

SQL_PICKED = f"""mw AS (SELECT DISTINCT msg_id, unnest({sql_words('text')}) AS word FROM msgs),
base AS (SELECT msg_id, person, sum(weight) AS score FROM mw JOIN both_ USING (word) JOIN weights USING (word) GROUP BY 1, 2),
over_ AS (SELECT b.*, p.priority, round(score, 9) AS s FROM base b JOIN people p USING (person) WHERE round(score, 9) >= 0.8),
placed AS (SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY s DESC, priority, person) AS place FROM over_),
picks AS (SELECT *, max(s) OVER (PARTITION BY msg_id) AS top FROM placed WHERE place <= 2),
picked AS (SELECT msg_id, person, score, place FROM picks WHERE place = 1 OR s >= top * 0.6)"""

SQL_OWNERS = f"{SQL_INDEX}, {SQL_MESSAGES}, {SQL_PICKED}"


def v_index(t: Tables):
    people = materialize(v_entries(t), "owners")
    entries = materialize(O.entry_words(people, v_owner_lines(t)), "owner-words")
    weights = materialize(O.word_weights(entries, v_systems(t), people.agg(F.count("*").alias("n"))), "owner-weights")
    mwords = O.message_words(v_messages(t))
    return people, entries, weights, mwords


@query("word_weights", "A6", f"WITH {SQL_OWNERS} SELECT word, df, round(CAST(weight AS DOUBLE), 6) AS weight FROM weights")
def word_weights(t: Tables) -> DataFrame:
    return v_index(t)[2].select("word", "df", F.round("weight", 6).alias("weight"))


@query("match_owners", "J6", f"WITH {SQL_OWNERS} SELECT msg_id, person, round(CAST(score AS DOUBLE), 6) AS score FROM base")
def match_owners(t: Tables) -> DataFrame:
    """Every message and owner that share a word."""
    _, entries, weights, mwords = v_index(t)
    return O.match_owners(mwords, entries, weights).select("msg_id", "person", F.round("score", 6).alias("score"))


@query("pick_owners", "W14", f"WITH {SQL_OWNERS} SELECT msg_id, person, place, round(CAST(score AS DOUBLE), 6) AS score FROM picked")
def pick_owners(t: Tables) -> DataFrame:
    people, entries, weights, mwords = v_index(t)
    picks = O.pick_owners(O.match_owners(mwords, entries, weights, L.OWNER_MIN_SCORE), people)
    return picks.select("msg_id", "person", "place", F.round("score", 6).alias("score"))


# each picked owner's best line
SQL_REASON = """ls AS (SELECT p.msg_id, p.person, l.line_no, l.route, round(sum(weight), 9) AS s FROM picked p JOIN mw USING (msg_id) JOIN lw l ON l.person = p.person AND l.word = mw.word JOIN weights w ON w.word = mw.word
          WHERE mw.word NOT IN (SELECT word FROM names) GROUP BY 1, 2, 3, 4),
why AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY msg_id, person ORDER BY s DESC, route, line_no) AS r FROM ls) WHERE r = 1)"""


def sql_clip(x: str) -> str:
    line = f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
    return f"CASE WHEN length({line}) <= {L.REASON_CHARS} THEN {line} ELSE rtrim(left({line}, {L.REASON_CHARS - 1})) || '…' END"


_NO_OWNER = L.NO_OWNER.replace("'", "''")
SQL_BLOCK = f"""{SQL_REASON},
entry AS (SELECT msg_id, place, place || '. ' || p.name || ', ' || p.title || ' (Desk ' || p.priority || ').'
            || CASE p.priority WHEN 'P0' THEN ' Reach: Slack #' || p.name || '.' WHEN 'P1' THEN ' Reach: Dashboard ' || p.name || '.' ELSE '' END
            || CASE WHEN p.person % 3 = 0 THEN ' Backup: ' || {sql_clip("'whoever ' || repeat('covers the desk next to it and then ', CAST(p.person % 4 AS INT)) || 'answers'")} || '.' ELSE '' END || ' '
            || CASE WHEN d.text IS NULL THEN 'Title matches.' WHEN why.route THEN 'Route when "' || {sql_clip('d.text')} || '".' ELSE 'Owns "' || {sql_clip('d.text')} || '".' END AS e
          FROM picked JOIN people p USING (person) LEFT JOIN why USING (msg_id, person) LEFT JOIN documents d ON d.doc_id = why.line_no),
pair AS (SELECT msg_id, '{L.OWNER_HEADING}' || chr(10) || max(e) FILTER (place = 1) AS one, max(e) FILTER (place = 2) AS two FROM entry GROUP BY 1),
blocks AS (SELECT msg_id, CASE WHEN one IS NULL THEN '{_NO_OWNER}' WHEN length(one || chr(10) || two) <= {L.OWNER_BLOCK_CHARS} THEN one || chr(10) || two ELSE left(one, {L.OWNER_BLOCK_CHARS}) END AS block,
             CASE WHEN one IS NULL THEN 0 WHEN length(one || chr(10) || two) <= {L.OWNER_BLOCK_CHARS} THEN 2 ELSE 1 END AS owners FROM msgs LEFT JOIN pair USING (msg_id))"""


def v_reasons(t: Tables, messages: DataFrame | None = None):
    """Picked owners of each message, the best line of each, and the directory."""
    people, entries, weights, mwords = v_index(t)
    if messages is not None:
        mwords = O.message_words(messages)
    picks = materialize(O.pick_owners(O.match_owners(mwords, entries, weights, L.OWNER_MIN_SCORE), people), "picks")
    return picks, O.best_reason(mwords, picks, people, v_owner_lines(t), weights), people


@query("best_reason", "W15", f"WITH {SQL_OWNERS}, {SQL_REASON} SELECT msg_id, person, line_no, route, round(CAST(s AS DOUBLE), 6) AS score FROM why")
def best_reason(t: Tables) -> DataFrame:
    return v_reasons(t)[1].select("msg_id", "person", "line_no", "route", F.round("score", 6).alias("score"))


def v_owner_blocks(t: Tables, messages: DataFrame) -> DataFrame:
    picks, reasons, people = v_reasons(t, messages)
    return O.owner_block(messages, picks, people, reasons, v_owner_lines(t))


@query("owner_block", "A19 W14 W15", f"WITH {SQL_OWNERS}, {SQL_BLOCK} SELECT msg_id, md5(block) AS digest, CAST(owners AS BIGINT) AS owners FROM blocks")
def owner_block(t: Tables) -> DataFrame:
    """What every conversation's request says about its owners."""
    return v_owner_blocks(t, v_messages(t)).select("msg_id", F.md5("block").alias("digest"), "owners")


@query("owner_lines", "P35",
       """SELECT p_partkey AS person, CAST(i AS BIGINT) AS line_no, line, i > 0 AS route FROM (SELECT p_partkey, unnest([p_name, 'ask about ' || p_type, 'unsure ' || p_brand]) AS line, generate_subscripts([1, 2, 3], 1) - 1 AS i
          FROM part)""")
def owner_lines(t: Tables) -> DataFrame:
    p = t.part.select(
        F.col("p_partkey").alias("person"), F.array("p_name").alias("owns"),
        F.concat(F.lit("ask  about "), "p_type", F.lit(" ;; unsure "), "p_brand", F.lit(";")).alias("route_when"),
    )
    return O.owner_lines(p)


@query(
    "cut_to_ceiling", "W17 T4",
    """WITH e AS (SELECT o_custkey, o_orderkey, o_orderpriority || ' order ' || o_orderkey AS line, row_number() OVER w AS place,
        sum(length(o_orderpriority || ' order ' || o_orderkey) + 2) OVER (w ROWS UNBOUNDED PRECEDING) - 2 AS used FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey))
    SELECT o_custkey, o_orderkey, CAST(place AS BIGINT) AS place, CAST(used AS BIGINT) AS used FROM e WHERE used <= 200""",
)
def cut_to_ceiling(t: Tables) -> DataFrame:
    """Each customer's orders, most urgent first, while their lines fit 200 characters."""
    e = t.orders.select("o_custkey", "o_orderkey", "o_orderpriority", F.concat("o_orderpriority", F.lit(" order "), "o_orderkey").alias("line"))
    return C.cut_to_ceiling(e, ["o_custkey"], ["o_orderpriority", "o_orderkey"], "line", 200).select("o_custkey", "o_orderkey", "place", "used")


# --- directory pages ------------------------------------------------------------------


def v_people_base(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    place = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    # one-row counts
    total, suppliers = t.part.agg(F.count("*").alias("total")), t.supplier.agg(F.count("*").alias("suppliers"))
    parts = t.part.join(F.broadcast(total)).join(F.broadcast(suppliers)).withColumn("s_suppkey", F.pmod(k, F.col("suppliers")))
    return (
        parts.join(t.supplier, "s_suppkey").join(place, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            k.alias("person"),
            F.when(F.col("s_acctbal") < 1000, F.concat(F.lit("Dr. Ng"), k.cast("string"))).otherwise(F.concat(F.lit("Ana"), k.cast("string"), F.lit(" Ruiz"), F.col("s_nationkey").cast("string"))).alias("name"),
            F.when(F.col("s_acctbal") > 9500, "").otherwise(F.concat("p_type", F.lit(" lead"))).alias("title"),
            F.col("n_name").alias("department"),
            F.when(F.col("p_size") > 45, F.array().cast("array<string>")).otherwise(F.array("r_name")).alias("routing_departments"),
            F.when(F.col("p_size") > 30, "P0").when(F.col("p_size") > 15, "p1 urgent").otherwise("later").alias("priority"),
            F.concat(F.lit("Ana"), F.pmod(k + 1, F.col("total")).cast("string"), F.when(F.col("p_size") > 25, " (days)").otherwise("")).alias("backup"),
            "p_name", "p_type", "p_brand", "r_name", "n_name", "n_regionkey", "p_size",
        )
    )


def v_pages(t: Tables) -> DataFrame:
    b = v_people_base(t)
    target = F.when(F.col("p_size") > 40, F.substring_index("backup", " ", 1)).when(F.col("p_size") > 20, F.concat(F.lit("Zone "), F.pmod(F.col("n_regionkey") + 1, F.lit(5)).cast("string"))).otherwise("nobody here")
    md = F.concat(
        F.lit("# Profile\n## **Core Responsibilities** (v2)\n- **"), "p_name", F.lit("** orders\n* "), "p_type", F.lit(" returns\nplain line\n## Domain expertise\n- Systems: "),
        "p_brand", F.lit(", Ledger\n## Out of Scope\n- "), "p_name", F.lit(" repair (route to "), target, F.lit(" / desk — see notes)\n- billing\n## Escalation path\n- Backup: "), "backup",
        F.lit("\n- Escalates to: Head\n## How to reach\n- Slack: #"), "n_name", F.lit("\n## Route when\nfirst "), "p_name", F.lit("\n- second\n"),
    )
    return b.select(
        "person", "name", "title", "department", "routing_departments", "priority", F.lit("").alias("backup"),
        F.lit("Dashboard main").alias("slack_channel"), F.lit("").alias("route_when"), md.alias("markdown"),
    )


SQL_PEOPLE = """pb AS (SELECT p_partkey AS person, p_name, p_type, p_brand, n_name, CASE WHEN p_size > 30 THEN 'P0' WHEN p_size > 15 THEN 'P1' ELSE 'P2' END AS priority,
   'Ana' || ((p_partkey + 1) % (SELECT count(*) FROM part)) || CASE WHEN p_size > 25 THEN ' (days)' ELSE '' END AS backup, p_size, n_regionkey
   FROM part JOIN supplier ON s_suppkey = p_partkey % (SELECT count(*) FROM supplier) JOIN nation ON s_nationkey = n_nationkey)"""


def sql_topic(text: str) -> str:
    stops = ", ".join(f"'{w}'" for w in L.TOPIC_STOPWORDS)
    return rf"""list_distinct(list_transform(list_filter(list_transform(regexp_split_to_array(lower({text}), '[^a-z0-9-]+'), lambda x: regexp_replace(x, '^-+|-+$', '', 'g')),
      lambda x: length(x) >= 3 AND x NOT IN ({stops})), lambda x: CASE WHEN length(x) > 4 AND x LIKE '%s' THEN left(x, length(x) - 1) ELSE x END))"""


def sql_ref(x: str) -> str:
    """How a reference to a person is looked up."""
    return rf"regexp_replace(trim(regexp_replace(regexp_replace(lower({x}), '\([^)]*\)', ' ', 'g'), '\s+', ' ', 'g')), '^dr\.\s*', 'dr ')"


def sql_named(text: str) -> str:
    """Whether a text names the ``phrase`` of a department."""
    return rf"contains(' ' || trim(regexp_replace(lower({text}), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || phrase || ' ')"


# the directory as a table, then references, issues and entries as text
SQL_DIRECTORY = rf"""dir AS (SELECT p_partkey AS person, CASE WHEN s_acctbal < 1000 THEN 'Dr. Ng' || p_partkey ELSE 'Ana' || p_partkey || ' Ruiz' || s_nationkey END AS name,
        CASE WHEN s_acctbal > 9500 THEN '' ELSE p_type || ' lead' END AS title, n_name AS department, CASE WHEN p_size <= 45 THEN r_name END AS own,
        CASE WHEN p_size > 30 THEN 'P0' WHEN p_size > 15 THEN 'P1' ELSE 'P2' END AS priority, [p_name || ' orders', p_type || ' returns'] AS owns, p_brand, p_name || ' repair' AS topic,
        'Ana' || ((p_partkey + 1) % (SELECT count(*) FROM part)) || CASE WHEN p_size > 25 THEN ' (days)' ELSE '' END AS backup,
        CASE WHEN p_size > 40 THEN 'Ana' || ((p_partkey + 1) % (SELECT count(*) FROM part)) WHEN p_size > 20 THEN 'Zone ' || ((n_regionkey + 1) % 5) ELSE 'nobody here' END AS target
        FROM part JOIN supplier ON s_suppkey = p_partkey % (SELECT count(*) FROM supplier) JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    sent AS (SELECT person, topic, unnest([target, 'desk']) AS target FROM dir),
    excl AS (SELECT r_name AS department, n_nationkey AS excl, p_name || ' repair' AS topic, 'Zone ' || ((n_nationkey + 2) % 5) AS target FROM region JOIN nation ON n_regionkey = r_regionkey JOIN part ON p_partkey = n_nationkey
             UNION ALL SELECT r_name, 1000000, 'loose ends', '' FROM region),
    phrases AS (SELECT r_name AS named, unnest([lower(r_name), 'zone ' || r_regionkey, 'area ' || r_regionkey]) AS phrase FROM region),
    keys AS (SELECT DISTINCT person, unnest([lower(name), regexp_replace(lower(name), '^dr\.\s*', 'dr '), CASE WHEN NOT starts_with(name, 'Dr.') THEN split_part(lower(name), ' ', 1) END]) AS key FROM dir)"""

SQL_ISSUES = rf"""{SQL_DIRECTORY},
    et AS (SELECT *, {sql_topic('topic')} AS w FROM excl),
    lost AS (SELECT person, topic FROM sent WHERE topic IS NOT NULL GROUP BY ALL HAVING count(*) FILTER ({sql_ref('target')} IN (SELECT key FROM keys) OR target LIKE 'Zone %') = 0),
    refs AS (SELECT person, 'Backup matches no one in the directory and no department' AS message FROM dir WHERE {sql_ref('backup')} NOT IN (SELECT key FROM keys WHERE key IS NOT NULL)
             UNION ALL SELECT person, 'Out of Scope "' || topic || '" routes to no one in the directory and no department' FROM lost),
    held AS (SELECT person, own AS department, 'owns "' || topic || '", but ' AS lead, {sql_topic('topic')} AS w FROM (SELECT person, own, unnest(owns) AS topic FROM dir) WHERE own IS NOT NULL
             UNION ALL
             SELECT s.person, d.own, 'sends "' || s.topic || '" to ' || CASE WHEN d.title = '' THEN 'untitled row' ELSE d.title END || ' (' || d.department || '), but ', {sql_topic('s.topic')}
             FROM sent s JOIN keys ON keys.key = {sql_ref('s.target')} JOIN dir d ON d.person = keys.person WHERE d.own IS NOT NULL),
    conflicts AS (SELECT h.person, lead || h.department || ' excludes "' || e.topic || '"' || CASE WHEN e.target <> '' THEN ' (' || e.target || ')' ELSE '' END AS message
             FROM held h JOIN et e USING (department) WHERE len(list_intersect(h.w, e.w)) >= 2 OR (len(list_intersect(h.w, e.w)) >= 1 AND least(len(h.w), len(e.w)) <= 2)),
    en AS (SELECT e.*, named FROM et e JOIN phrases ON {sql_named("CASE WHEN e.target <> '' THEN e.target ELSE e.topic END")}),
    mine AS (SELECT d.person, d.topic AS said, en.* FROM dir d JOIN en ON en.department = d.own WHERE en.named <> d.own),
    goes AS (SELECT person, named FROM sent JOIN phrases ON {sql_named('target')} UNION SELECT s.person, d.own FROM sent s JOIN keys ON keys.key = {sql_ref('s.target')} JOIN dir d ON d.person = keys.person),
    saidw AS (SELECT person, {sql_topic('topic')} AS w FROM (SELECT person, topic FROM dir UNION ALL SELECT person, 'billing' FROM dir)),
    gaps AS (SELECT person, department || ' excludes "' || topic || '" (' || string_agg(DISTINCT named, ' or ' ORDER BY named) || '), but Out of Scope never sends it on' AS message FROM mine m
             WHERE NOT EXISTS (SELECT 1 FROM goes g JOIN mine o ON o.person = g.person AND o.named = g.named WHERE o.person = m.person AND o.excl = m.excl)
               AND NOT EXISTS (SELECT 1 FROM saidw s WHERE s.person = m.person AND (len(list_intersect(s.w, m.w)) >= 2 OR (len(list_intersect(s.w, m.w)) >= 1 AND least(len(s.w), len(m.w)) <= 2)))
             GROUP BY person, department, excl, topic)"""

SQL_LISTED = f"""{SQL_ISSUES}, listed AS (
    SELECT person, 'error' AS level, 'left out: no Title' AS message, 1 AS severity FROM dir WHERE title = '' UNION ALL SELECT person, 'reference', message, 2 FROM refs
    UNION ALL SELECT person, 'conflict', message, 3 FROM conflicts UNION ALL SELECT person, 'gap', message, 4 FROM gaps
    UNION ALL SELECT person, 'note', 'no Routing Department, so the routing-map cross-check is skipped', 5 FROM dir WHERE own IS NULL)"""

SQL_RENDERED = """rendered AS (SELECT person, department, priority, title, name || ': ' || title || ' (' || department || ')' || chr(10) || '- Owns: ' || array_to_string(owns, '; ') || chr(10) || '- Systems: ' || p_brand || ', Ledger'
        || chr(10) || '- Out of scope: ' || topic || ' → ' || target || ' / desk; billing' || chr(10) || '- Backup: ' || backup || chr(10) || '- Escalates to: Head' || chr(10) || '- Reach: Slack #' || department AS text FROM dir)"""


@query(
    "parse_directory", "P33",
    f"""WITH {SQL_PEOPLE} SELECT person, priority, p_name || ' orders|' || p_type || ' returns' AS owns, p_brand || '|Ledger' AS systems, p_name || ' repair' AS topic,
        CASE WHEN p_size > 40 THEN string_split(backup, ' ')[1] WHEN p_size > 20 THEN 'Zone ' || ((n_regionkey + 1) % 5) ELSE 'nobody here' END || '|desk' AS targets,
        backup, 'Head' AS escalates_to, '#' || n_name AS slack, 'main' AS dashboard, 'first ' || p_name || ' second' AS route_when FROM pb""",
)
def parse_directory(t: Tables) -> DataFrame:
    people = D.parse_directory(v_pages(t))
    first = F.get("out_of_scope", F.lit(0))
    return people.select(
        "person", "priority", F.array_join("owns", "|").alias("owns"), F.array_join("systems", "|").alias("systems"), first["topic"].alias("topic"),
        F.array_join(first["targets"], "|").alias("targets"), "backup", "escalates_to", "slack", "dashboard", "route_when",
    )


@query("reach_of", "P29", f"WITH {SQL_PEOPLE} SELECT person, CASE WHEN priority = 'P0' THEN 'Slack direct message' WHEN priority = 'P1' THEN 'Slack #' || n_name ELSE 'Dashboard ' || n_name END AS reach FROM pb")
def reach_of(t: Tables) -> DataFrame:
    p = D.parse_directory(v_pages(t)).select("person", "priority", "department")
    slack = F.when(F.col("priority") == "P0", " Direct  Message (Unverified)").when(F.col("priority") == "P1", F.concat(F.lit("#"), "department")).otherwise(" (unverified) ")
    return p.select("person", X.reach(slack, F.col("department")).alias("reach"))


def v_department_map(t: Tables) -> DataFrame:
    """One department map per region: the region as a department, its exclusions its nations' first parts."""
    parts = t.nation.join(t.part, F.col("p_partkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "p_name", "n_name"))), lambda x: F.concat(F.lit("- "), x["p_name"], F.lit(" repair (Zone "), F.pmod(x["n_nationkey"] + 2, F.lit(5)).cast("string"), F.lit(")."))), "\n").alias("bullets")
    )
    md = F.concat(
        F.lit("# Notes\n## Not a department\n# **Departments**\n## "), "r_name", F.lit("\nAlso called: Zone "), F.col("r_regionkey").cast("string"), F.lit(", Area "), F.col("r_regionkey").cast("string"),
        F.lit(" · since 2020\nSend them: anything\n- ordinary\nDo not send them:\n"), "bullets", F.lit("\n- loose ends\nContact: desk\n- ignored\n# Appendix\n## Other\n"),
    )
    return t.region.join(parts, "r_regionkey").select(F.col("r_regionkey").alias("page"), md.alias("markdown"))


@query(
    "parse_departments", "P34",
    """SELECT r_name AS department, 'Zone ' || r_regionkey || '|Area ' || r_regionkey AS aliases, p_name || ' repair' AS topic, 'Zone ' || ((n_nationkey + 2) % 5) AS target FROM region JOIN nation ON n_regionkey = r_regionkey JOIN part ON p_partkey = n_nationkey
       UNION ALL SELECT r_name, 'Zone ' || r_regionkey || '|Area ' || r_regionkey, 'loose ends', '' FROM region""",
)
def parse_departments(t: Tables) -> DataFrame:
    d = D.parse_departments(v_department_map(t), "markdown")
    return X.unroll(d, ["department", "aliases"], "exclusions", "i", "e").select(
        "department", F.array_join("aliases", "|").alias("aliases"), "e.topic", "e.target"
    )


def v_departments(t: Tables) -> DataFrame:
    return materialize(D.parse_departments(v_department_map(t), "markdown").drop("page", "ord"), "departments")


def v_people(t: Tables, *columns: str) -> DataFrame:
    """Everyone of the directory, with the named columns: sections that no column needs are not parsed."""
    people = D.parse_directory(v_pages(t))
    return materialize(people.select("person", *columns) if columns else people, "people")


def v_directory(t: Tables, *columns: str) -> tuple[DataFrame, DataFrame]:
    return v_people(t, *columns), v_departments(t)


@query(
    "resolve_targets", "J7",
    f"""WITH {SQL_DIRECTORY}, firsts AS (SELECT lower(own) AS key, min(person) AS person FROM dir WHERE own IS NOT NULL GROUP BY 1),
    named AS (SELECT key, person FROM keys WHERE key NOT LIKE 'dr.%' UNION ALL SELECT key, person FROM firsts WHERE key NOT IN (SELECT key FROM keys WHERE key IS NOT NULL))
    SELECT s.person, CAST(0 AS BIGINT) AS entry, s.target, n.person AS target_person FROM sent s JOIN named n ON n.key = {sql_ref('s.target')}""",
)
def resolve_targets(t: Tables) -> DataFrame:
    people = v_people(t, "name", "routing_departments", "out_of_scope")
    aliases = O.alias_table(people.withColumn("ord", F.col("person")))
    scope = X.unroll(people, ["person"], "out_of_scope", "entry", "s").select("person", "entry", "s.topic", "s.targets")
    return O.resolve_targets(scope, aliases).select("person", F.col("entry").cast("bigint").alias("entry"), "target", "target_person")


@query(
    "redirect_effects", "A7",
    f"""WITH {SQL_DIRECTORY},
    names AS (SELECT DISTINCT unnest({sql_words('name')}) AS word FROM dir),
    owned AS (SELECT DISTINCT d.person, word FROM (SELECT person, unnest({sql_words('line')}) AS word FROM (
        SELECT person, unnest(list_append(owns, 'first ' || replace(topic, ' repair', '') || ' second')) AS line FROM dir)) d WHERE word NOT IN (SELECT word FROM names)),
    entries AS (SELECT person, word FROM owned UNION ALL SELECT * FROM (SELECT DISTINCT person, unnest({sql_words('title')}) AS word FROM dir)),
    products AS (SELECT DISTINCT unnest({sql_words('token')}) AS word FROM (SELECT unnest([p_brand, 'Ledger']) AS token FROM dir)),
    n AS (SELECT count(*) AS n FROM dir),
    weights AS (SELECT word, ln(1 + max(n) / (count(DISTINCT person) + 1)) / ln(1 + max(n) / 2) * CASE WHEN word IN (SELECT word FROM products) THEN 0.3 ELSE 1.0 END AS weight FROM entries, n GROUP BY word),
    mw AS (SELECT DISTINCT msg_id, unnest({sql_words('text')}) AS word FROM (SELECT p_partkey AS msg_id, p_name || ' repair ' || p_type AS text FROM part)),
    base AS (SELECT msg_id, person, sum(weight) AS score FROM mw JOIN entries USING (word) JOIN weights USING (word) GROUP BY 1, 2),
    tw AS (SELECT person, entry, topic, list_distinct({sql_words('topic')}) AS w FROM (SELECT person, 0 AS entry, topic FROM dir UNION ALL SELECT person, 1, 'billing' FROM dir)),
    scored AS (SELECT msg_id, person, entry, topic, sum(weight) AS score, count(*) * 1.0 / max(size) AS covered
        FROM mw JOIN (SELECT person, entry, topic, len(w) AS size, unnest(w) AS word FROM tw) USING (word) LEFT JOIN weights USING (word) GROUP BY 1, 2, 3, 4 HAVING sum(weight) > 0),
    penalty AS (SELECT msg_id, person, max(score * covered) AS penalty FROM scored GROUP BY 1, 2),
    pointed AS (SELECT DISTINCT s.person, 0 AS entry, k.person AS target FROM sent s JOIN keys k ON k.key = {sql_ref('s.target')} WHERE k.person <> s.person),
    gain AS (SELECT msg_id, target AS person, max(score) AS gain, max_by(topic, round(score, 9)) AS redirect FROM scored JOIN pointed USING (person, entry) GROUP BY 1, 2),
    total AS (SELECT msg_id, person, coalesce(score, 0) + coalesce(gain, 0) - coalesce(penalty, 0) AS score, redirect
        FROM base FULL JOIN penalty USING (msg_id, person) FULL JOIN gain USING (msg_id, person)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY s DESC, priority, person) AS place FROM (SELECT t.*, round(score, 9) AS s, priority FROM total t JOIN dir USING (person)) WHERE s >= 0.8)
    SELECT msg_id, person, place, round(CAST(score AS DOUBLE), 6) AS score, redirect FROM (SELECT *, max(s) OVER (PARTITION BY msg_id) AS top FROM placed WHERE place <= 2) WHERE place = 1 OR s >= top * 0.6""",
)
def redirect_effects(t: Tables) -> DataFrame:
    """Orders ask about parts by name; owners redirect repairs of their own part."""
    people = v_people(t, "name", "title", "priority", "owns", "systems", "routing_departments", "out_of_scope", "route_when")
    people = people.withColumn("ord", F.col("person"))
    lines = O.owner_lines(people)
    entries = O.entry_words(people, lines)
    systems = X.unroll(people, ["person"], "systems", "i", "system").select("person", "system")
    weights = O.word_weights(entries, systems, people.agg(F.count("*").alias("n")))
    scope = X.unroll(people, ["person"], "out_of_scope", "entry", "s").select("person", "entry", "s.topic", "s.targets")
    messages = t.part.select(F.col("p_partkey").alias("msg_id"), F.concat("p_name", F.lit(" repair "), "p_type").alias("text"))
    mwords = O.message_words(messages)
    entries, weights, mwords = (materialize(df, name) for df, name in ((entries, "entries"), (weights, "weights"), (mwords, "heard-words")))
    picks = O.redirected_picks(mwords, entries, weights, scope, O.resolve_targets(scope, O.alias_table(people)), people)
    return picks.select("msg_id", "person", "place", F.round("score", 6).alias("score"), "redirect")


@query("departments_named", "J8",
       """SELECT p_partkey, r_name AS department FROM part JOIN region ON r_regionkey = p_size % 5 WHERE p_size > 10""")
def departments_named(t: Tables) -> DataFrame:
    """Parts over size ten name a region by alias or in full."""
    departments = v_departments(t)
    n = F.pmod(F.col("p_size"), F.lit(5)).cast("string")
    text = F.when(F.col("p_size") > 30, F.concat(F.lit("send to zone "), n, F.lit(" now"))).when(F.col("p_size") > 10, F.concat(F.lit("the AREA-"), n, F.lit("."))).otherwise(F.concat(F.lit("region"), n))
    return G.departments_named(t.part.select("p_partkey", text.alias("text")), "p_partkey", "text", departments)


@query(
    "topic_overlap", "J9",
    f"""WITH a AS (SELECT item_id AS a_id, {sql_topic("string_split(text, chr(10))[1]")} AS w FROM benchmark), b AS (SELECT doc_id AS b_id, {sql_topic("string_split(text, chr(10))[1]")} AS w FROM documents),
    o AS (SELECT a_id, b_id, len(list_intersect(a.w, b.w)) AS shared, least(len(a.w), len(b.w)) AS small FROM a, b)
    SELECT a_id, b_id, shared FROM o WHERE shared >= 2 OR (shared >= 1 AND small <= 2)""",
)
def topic_overlap(t: Tables) -> DataFrame:
    a = t.benchmark.select(F.col("item_id").alias("a_id"), F.substring_index("text", "\n", 1).alias("a_topic"))
    b = spread(t.documents.select(F.col("doc_id").alias("b_id"), F.substring_index("text", "\n", 1).alias("b_topic")))
    return G.topic_overlap(a, b).select("a_id", "b_id", "shared")


@query(
    "routing_conflicts", "J10",
    f"WITH {SQL_ISSUES} SELECT person, 'conflict' AS level, message FROM conflicts",
)
def routing_conflicts(t: Tables) -> DataFrame:
    return G.routing_conflicts(*v_directory(t))


@query(
    "routing_gaps", "J11",
    f"WITH {SQL_ISSUES} SELECT person, 'gap' AS level, message FROM gaps",
)
def routing_gaps(t: Tables) -> DataFrame:
    return G.routing_gaps(*v_directory(t))


@query(
    "dangling_refs", "J12",
    f"WITH {SQL_ISSUES} SELECT person, 'reference' AS level, message FROM refs",
)
def dangling_refs(t: Tables) -> DataFrame:
    return G.dangling_refs(*v_directory(t, "name", "backup", "routing_departments", "out_of_scope"))


@query(
    "expand_backups", "J13",
    f"""WITH {SQL_DIRECTORY}, n AS (SELECT d.person, d.backup, count(k.person) AS n, min(k.person) AS named FROM dir d LEFT JOIN keys k ON k.key = {sql_ref('d.backup')} GROUP BY 1, 2)
    SELECT n.person, CASE WHEN n = 1 AND named <> n.person THEN f.name || CASE WHEN contains(n.backup, '(') THEN ' (days)' ELSE '' END ELSE n.backup END AS backup FROM n LEFT JOIN dir f ON f.person = named""",
)
def expand_backups(t: Tables) -> DataFrame:
    return G.expand_backups(v_people(t, "name", "backup")).select("person", "backup")


def v_rendered(people: DataFrame) -> DataFrame:
    return people.select(
        "person", "priority",
        O.render_person(*[F.col(c) for c in ("name", "title", "department", "owns", "systems", "out_of_scope", "backup", "escalates_to")], X.reach("slack", "dashboard")).alias("text"),
    )


@query(
    "issue_summary", "A11 T3",
    f"""WITH {SQL_LISTED}, {SQL_RENDERED}, c AS (SELECT {", ".join(f"count(*) FILTER (level = '{v}') AS {v}s" for v in L.LEVELS)} FROM listed),
    r AS (SELECT count(*) AS usable, CAST(greatest(sum(length(text) + 2) - 2, 0) AS BIGINT) AS chars FROM rendered WHERE title <> '')
    SELECT *, CASE WHEN usable = 0 THEN 'no usable Live rows' WHEN chars > {L.DIRECTORY_CHARS}
        THEN 'the directory renders to ' || chars || ' characters, over the {L.DIRECTORY_CHARS} ceiling; shorten Core Responsibilities or Out of Scope lines' END AS blocked FROM c, r""",
)
def issue_summary(t: Tables) -> DataFrame:
    people, departments = v_directory(t)
    issues = materialize(G.check_directory(people, departments), "issues")
    valid = G.matched(people, issues.filter(F.col("level") == "error").select("person").distinct(), "person", "left_anti")
    sized = v_rendered(valid).agg(F.greatest(F.sum(F.char_length("text") + 2) - 2, F.lit(0)).alias("chars"))
    return G.issue_summary(issues, people, sized)


@query(
    "issue_listing", "T3",
    f"""WITH {SQL_LISTED} SELECT l.person, level, message, CASE WHEN title = '' THEN 'untitled row' ELSE title END || ' (' || department || ')' AS row, CAST(severity AS BIGINT) AS severity
    FROM listed l JOIN dir USING (person)""",
)
def issue_listing(t: Tables) -> DataFrame:
    return G.check_directory(*v_directory(t)).orderBy("severity", "person", "message")


@query(
    "render_directory", "A19 W17",
    f"""WITH {SQL_DIRECTORY}, {SQL_RENDERED}, u AS (SELECT *, sum(length(text) + 2) OVER (PARTITION BY department ORDER BY priority, person ROWS UNBOUNDED PRECEDING) - 2 AS used FROM rendered)
    SELECT department, string_agg(text, chr(10) || chr(10) ORDER BY priority, person) AS directory FROM u WHERE used <= {L.DIRECTORY_CHARS} GROUP BY 1""",
)
def render_directory(t: Tables) -> DataFrame:
    """Directory text per department: whole entries, P0 first, within the ceiling.

    An entry begins with its heading, so where the headings alone pass the ceiling, the entries do: those behind are in no
    text, and their pages are not cut into sections. Everyone before is rendered, and the ceiling is measured on whole entries.
    """
    pages = v_pages(t)
    heads = D.parse_directory(pages).select(
        "person", "department", "priority", F.coalesce(O.person_heading(*[F.col(c) for c in ("name", "title", "department")]), F.lit("")).alias("heading")
    )
    near = materialize(C.cut_to_ceiling(heads, ["department"], ["priority", "person"], "heading", L.DIRECTORY_CHARS).select("person"), "near")
    people = materialize(D.parse_directory(pages.join(near, "person", "left_semi")), "people")
    entries = v_rendered(people).join(people.select("person", "department"), "person")
    kept = C.cut_to_ceiling(entries, ["department"], ["priority", "person"], "text", L.DIRECTORY_CHARS)
    return kept.groupBy("department").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n\n").alias("directory")
    )


@query("read_directory", "S4", "SELECT CAST(s_nationkey AS BIGINT) AS snapshot, count(*) AS people FROM supplier GROUP BY 1 HAVING bool_and(s_acctbal < 9000)")
def read_directory(t: Tables) -> DataFrame:
    """One snapshot per nation; a supplier with a balance of 9,000 or more makes an invalid person."""
    s = lambda v: F.lit(v)
    person = F.struct(
        F.col("s_name").alias("name"), s("Lead").alias("title"), s("Ops").alias("department"), F.array(s("RCM")).alias("routingDepartments"),
        F.when(F.col("s_acctbal") < 9000, "P1").otherwise("P9").alias("priority"), F.array(s("work")).alias("owns"), F.array(s("Ledger")).alias("systems"),
        F.array(F.struct(s("x").alias("topic"), F.array(s("y")).alias("targets"))).alias("outOfScope"), s("").alias("backup"), s("").alias("escalatesTo"),
        F.struct(s("").alias("slack"), s("").alias("dashboard")).alias("reach"),
    )
    raw = t.supplier.groupBy(F.col("s_nationkey").cast("bigint").alias("snapshot")).agg(F.collect_list(person).alias("personas")).select(
        "snapshot", F.to_json(F.struct(s(1).alias("version"), s("2024-01-01").alias("generated_at"), "personas")).alias("raw")
    )
    return D.read_directory(raw, "raw").groupBy("snapshot").agg(F.count("*").alias("people"))


@query(
    "directory_asof", "J27",
    """SELECT e.event_id, s.ts IS NOT NULL AND s.ts < e.ts - INTERVAL 300 SECOND AS stale, strftime(s.ts, '%Y-%m-%d %H:%M:%S') AS snapshot_at
       FROM (SELECT * FROM events WHERE event_type <> 'signup') e ASOF LEFT JOIN (SELECT ts FROM events WHERE event_type = 'signup') s ON e.ts >= s.ts""",
)
def directory_asof(t: Tables) -> DataFrame:
    """Sign-ups stand for directory snapshots, every other event for an answer."""
    answers = t.events.filter(F.col("event_type") != "signup").select("event_id", F.col("ts").alias("asked_at"))
    snaps = t.events.filter(F.col("event_type") == "signup").select(F.col("ts").alias("taken_at"))
    out = O.directory_asof(answers, snaps, "event_id")
    return out.select("event_id", F.coalesce("stale", F.lit(False)).alias("stale"), F.date_format("snapshot_at", "yyyy-MM-dd HH:mm:ss").alias("snapshot_at"))
