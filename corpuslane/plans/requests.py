"""Registered queries: what a model request carries, and the team structures of its prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslane.functions import lexicon as L
from corpuslane.operators import context as C
from corpuslane.operators import rules as M
from corpuslane.operators import teams as S
from corpuslane.plans.ownership import SQL_BLOCK, SQL_INDEX, SQL_PICKED, v_owner_blocks
from corpuslane.plans.registry import query
from corpuslane.plans.retrieval import SQL_PACKED, v_packed, v_queries
from corpuslane.session import Tables, materialize

# a passage of these documents states no rule, so the twin has none to render
SQL_REQUEST = rf"""{SQL_PACKED}, {SQL_INDEX}, msgs AS (SELECT item_id AS msg_id, text FROM benchmark), {SQL_PICKED}, {SQL_BLOCK},
passages AS (SELECT query_id, string_agg('[' || label || '] ' || title || CASE WHEN kind = 'full' THEN ' | full document'
        ELSE coalesce(' | ' || nullif(trim(regexp_extract(text, '(?m)^#{{1,6}}\s+(.+)$', 1)), ''), '') END || ' | no link' || chr(10) || text, chr(10) || chr(10) ORDER BY label) AS passages
    FROM packed GROUP BY 1),
request AS (SELECT b.item_id AS query_id, 'SOP passages' || chr(10) || chr(10) || coalesce(passages, '') || chr(10) || chr(10) || blocks.block || chr(10) || chr(10)
        || 'Team member''s message:' || chr(10) || chr(10) || b.text AS request
    FROM benchmark b JOIN blocks ON blocks.msg_id = b.item_id LEFT JOIN passages ON passages.query_id = b.item_id)"""


@query("context_request", "A19 S9", f"WITH {SQL_REQUEST} SELECT query_id, length(request) AS chars, md5(request) AS digest FROM request")
def context_request(t: Tables) -> DataFrame:
    """Passages, the rules they state, the owners of the message, and the message."""
    packed = materialize(v_packed(t), "packed")
    units = M.rule_units(packed.select("query_id", "label", "kind", "text"), ["query_id", "label"], "text", "kind")
    rules = M.rules_block(M.select_rules(M.mine_rules(units), "query_id", "label"), "query_id").withColumnRenamed("block", "rules_block")
    messages = v_queries(t)
    owners = v_owner_blocks(t, messages.select(F.col("query_id").alias("msg_id"), F.col("query").alias("text"))).select(
        F.col("msg_id").alias("query_id"), F.col("block").alias("owner_block")
    )
    requests = messages.withColumnRenamed("query", "message").join(rules, "query_id", "left").join(owners, "query_id", "left")
    out = C.request_text(packed, requests)
    return out.select("query_id", F.char_length("request").cast("bigint").alias("chars"), F.md5("request").alias("digest"))


@query(
    "team_structure", "A19 W17",
    f"""WITH o AS (SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders),
    f AS (SELECT l_orderkey AS k, l_returnflag AS team, l_linenumber AS n, l_linenumber || ' ' || p_name AS name, p_type AS covers, CASE WHEN p_size > 25 THEN [p_brand, p_size || ' pieces'] END AS aliases
          FROM lineitem JOIN part ON p_partkey = l_partkey),
    g AS (SELECT k, team, team || ' team: work of order ' || k || '.' || chr(10) || string_agg(line, chr(10) ORDER BY n, line) AS block FROM (
        SELECT *, '- ' || name || ': ' || covers || '.' || coalesce(' Also called: ' || array_to_string(aliases, ', ') || '.', '') AS line FROM f) GROUP BY 1, 2),
    t AS (SELECT k, string_agg(block, chr(10) || chr(10) ORDER BY team) AS block FROM g GROUP BY 1),
    h AS (SELECT l_orderkey AS k, '{L.HANDOFFS_HEADING}' || chr(10) || string_agg(line, chr(10) ORDER BY l_linenumber, line) AS block FROM (
        SELECT *, '- ' || l_returnflag || ' to ' || l_linestatus || ': line ' || l_linenumber || ' received.' AS line FROM lineitem WHERE l_quantity > 40) GROUP BY 1),
    x AS (SELECT o_orderkey AS k, '{L.OUTSIDE_HEADING}' || chr(10) || '- ' || o_orderpriority || ': urgent requests. Operations contact: ' || o_orderstatus || ' team, desk function.' AS block FROM o WHERE o_orderpriority LIKE '1%'),
    s AS (SELECT k, concat_ws(chr(10) || chr(10), t.block, h.block, x.block) AS structure FROM t FULL JOIN h USING (k) FULL JOIN x USING (k))
    SELECT k AS l_orderkey, md5(structure) AS digest, length(structure) AS chars, length(structure) > {L.TEAM_STRUCTURE_CHARS} AS over FROM s""",
)
def team_structure(t: Tables) -> DataFrame:
    """A structure per order: its return flags are teams, its lines functions, large lines handoffs, urgency an outside group."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber").cast("string")
    lines = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    functions = lines.select(
        "l_orderkey", F.ascii("l_returnflag").alias("team_ord"), F.col("l_returnflag").alias("team"),
        F.concat(F.lit("work of order "), k.cast("string")).alias("purpose"), F.col("l_linenumber").alias("ord"),
        F.concat(n, F.lit(" "), "p_name").alias("name"), F.col("p_type").alias("covers"),
        F.when(F.col("p_size") > 25, F.array("p_brand", F.concat("p_size", F.lit(" pieces")))).alias("aliases"),
    )
    handoffs = t.lineitem.filter(F.col("l_quantity") > 40).select(
        "l_orderkey", F.col("l_linenumber").alias("ord"), F.col("l_returnflag").alias("sender"), F.col("l_linestatus").alias("receiver"),
        F.concat(F.lit("line "), n, F.lit(" received")).alias("criterion"),
    )
    outside = t.orders.filter(F.col("o_orderpriority").startswith("1")).select(
        F.col("o_orderkey").alias("l_orderkey"), F.lit(0).alias("ord"), F.col("o_orderpriority").alias("name"), F.lit("urgent requests").alias("covers"),
        F.array().cast("array<string>").alias("aliases"), F.col("o_orderstatus").alias("team"), F.lit("desk").alias("fn"),
    )
    out = S.team_structure(functions, handoffs, outside, "l_orderkey")
    return out.select("l_orderkey", F.md5("structure").alias("digest"), "chars", "over")
