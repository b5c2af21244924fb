"""Registered queries: rule mining and sentence segmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslane.functions import text as X
from corpuslane.operators import rules as M
from corpuslane.plans.conversations import SQL_MARKDOWN, v_markdown
from corpuslane.plans.registry import query
from corpuslane.session import Tables, spread


def v_passages(t: Tables) -> DataFrame:
    """Page markdown as procedures: menu entries become prohibitions, paragraphs decisions.

    Eight neighbouring pages form one request; the even ones are whole documents.
    """
    text = X.chain(
        "text", ("(?m)^- ", "- Do not use the entry "), (r"\n\n(?=[^\n`#-])", "\n\nThe provider decides on this: "), ("Menu", "Menu rules\nUnless told otherwise:")
    )
    return v_markdown(t).select(
        F.expr("page_id DIV 8").alias("request_id"), (F.col("page_id") % 8 + 1).alias("label"), "page_id",
        F.when(F.col("page_id") % 2 == 0, "full").otherwise("chunk").alias("passage_kind"), text.alias("text"),
    )


def v_units(t: Tables) -> DataFrame:
    return M.rule_units(v_passages(t), ["request_id", "label", "page_id"], "text")


@query("rule_units", "W8 U3")
def rule_units(t: Tables) -> DataFrame:
    return v_units(t).select("page_id", "unit", "kind", F.md5("text").alias("digest"))


@query("mine_rules", "P32")
def mine_rules(t: Tables) -> DataFrame:
    return M.mine_rules(v_units(t)).select("page_id", "unit", "kind", "tier", F.array_join("hits", ",").alias("hits"))


@query(
    "menu_rules", "P32",
    rf"""WITH {SQL_MARKDOWN}, l AS (SELECT page_id, unnest(string_split(text, chr(10))) AS raw FROM md)
    SELECT page_id, count(*) AS rules FROM (SELECT page_id, trim('Unless told otherwise: Do not use the entry ' || substr(raw, 3)) AS unit FROM l WHERE starts_with(raw, '- '))
    WHERE length(unit) BETWEEN 25 AND 400 AND unit NOT LIKE '%:' AND unit NOT LIKE '%?' GROUP BY 1""",
)
def menu_rules(t: Tables) -> DataFrame:
    """Prohibitions found under the lead-in of each page's menu."""
    rules = M.mine_rules(v_units(t)).filter(F.array_contains("hits", "do-not"))
    return rules.groupBy("page_id").agg(F.count("*").alias("rules"))


@query("rule_rollup", "P32")
def rule_rollup(t: Tables) -> DataFrame:
    return M.mine_rules(v_units(t)).groupBy("tier", "kind").agg(F.count("*").alias("rules"), F.countDistinct("page_id").alias("pages"))


@query("select_rules", "W9")
def select_rules(t: Tables) -> DataFrame:
    return M.select_rules(M.mine_rules(v_units(t)), "request_id", "label")


@query("rules_block", "A19 W9")
def rules_block(t: Tables) -> DataFrame:
    return M.rules_block(M.select_rules(M.mine_rules(v_units(t)), "request_id", "label"), "request_id")


@query(
    "split_sentences", "W18",
    r"""WITH d AS (SELECT doc_id, regexp_replace(text, '["()“”]', '', 'g') AS text FROM documents),
    p AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS p FROM d)
    SELECT doc_id, len(p) - len(list_filter(p[:-2], lambda x: regexp_matches(x, '(^|[^A-Za-z0-9_])(e\.g|i\.e|Dr|vs|etc|Mr|Mrs|Ms|No|St|approx)\.$'))) AS sentences FROM p""",
)
def split_sentences(t: Tables) -> DataFrame:
    plain = X.sub("text", "[\"()“”]")
    return spread(t.documents.select("doc_id", "text")).select("doc_id", F.size(M.split_sentences(plain)).cast("bigint").alias("sentences"))
