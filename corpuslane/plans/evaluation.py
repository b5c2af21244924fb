"""Registered queries: evaluation reports, telemetry, budgets and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslane.operators import evaluate as E
from corpuslane.operators import retrieve as R
from corpuslane.operators.screen import classify_error
from corpuslane.plans.registry import query
from corpuslane.plans.retrieval import SQL_RANKED, v_hits
from corpuslane.plans.screening import SQL_ERRORS, v_errors
from corpuslane.session import Tables, shared_dir
from corpuslane.sources import logs as S

NOW = "2024-01-31 00:00:00"
CONFIGS = ["click", "error", "purchase", "signup", "view"]


def payload_k():
    return F.get_json_object("props", "$.k").cast("bigint")


def v_records(t: Tables) -> DataFrame:
    """One evaluation record per event: the payload decides the rank, the value the latency."""
    return t.events.withColumn("k", payload_k()).select(
        F.col("event_type").alias("config"), F.col("user_id").alias("id"), F.col("event_id").alias("ord"),
        (F.col("value") < 100).alias("has_expected"),
        F.when((F.col("k") < 80) & (F.col("value") < 100), F.expr("1 + k DIV 16")).alias("rank"),
        F.when(F.col("k") % 2 == 0, F.col("k")).alias("keyword_rank"), (F.col("k") % 5 + 1).alias("files"),
        F.floor(F.col("value") * 100).alias("ms"), F.when(F.col("k") == 99, "timeout").alias("error"),
    )


SQL_RECORDS = """recs AS (SELECT event_type AS config, user_id AS id, event_id AS ord, value < 100 AS has_expected,
   CASE WHEN k < 80 AND value < 100 THEN 1 + k // 16 END AS rank, CASE WHEN k % 2 = 0 THEN k END AS keyword_rank, k % 5 + 1 AS files,
   CAST(floor(value * 100) AS BIGINT) AS ms, CASE WHEN k = 99 THEN 'timeout' END AS error
   FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""
SQL_CELL = """CASE WHEN error IS NOT NULL THEN 'err' WHEN NOT has_expected THEN CAST(files AS VARCHAR) WHEN rank IS NULL THEN '—'
   ELSE rank || CASE WHEN keyword_rank IS NULL THEN '' ELSE 'k' END END"""


SQL_SUMMARY = f"""WITH {SQL_RECORDS}, s AS (SELECT *, error IS NULL AS ok, error IS NULL AND has_expected AS scored FROM recs)
    SELECT config, count(*) FILTER (scored AND rank <= 1) AS hits1, count(*) FILTER (scored AND rank <= 3) AS hits3, count(*) FILTER (scored AND rank <= 5) AS hits5,
      count(*) FILTER (scored) - count(rank) FILTER (scored) AS misses, floor(avg(rank) FILTER (scored) * 100 + 0.5) / 100 AS mean_rank,
      coalesce(CAST(floor(avg(ms) FILTER (ok) + 0.5) AS BIGINT), 0) AS mean_ms, count(*) FILTER (NOT ok) AS errors FROM s GROUP BY config"""


@query("summarise", "A2", SQL_SUMMARY)
def summarise(t: Tables) -> DataFrame:
    return E.summarise(v_records(t))


@query(
    "rank_grid", "A9",
    f"WITH {SQL_RECORDS}, c AS (SELECT id, config, ord, {SQL_CELL} AS cell FROM recs) SELECT id, "
    + ", ".join(f"coalesce(arg_min(cell, ord) FILTER (config = '{c}'), '') AS {c}" for c in CONFIGS) + " FROM c GROUP BY id",
)
def rank_grid(t: Tables) -> DataFrame:
    return E.rank_grid(v_records(t), CONFIGS)


@query("write_report", "S9", SQL_SUMMARY)
def write_report(t: Tables) -> DataFrame:
    """Publish the report files and read the summary back."""
    path = shared_dir(t.spark, "report")
    summary = E.summarise(v_records(t))
    S.write_report(v_records(t), summary, E.rank_grid(v_records(t), CONFIGS), path)
    return t.spark.read.schema(summary.schema).json(f"{path}/summary")


def v_expected(t: Tables) -> DataFrame:
    """Expected files of a query: two derived from its label; label 0 expects nothing."""
    label = F.col("label").cast("bigint")
    return t.benchmark.join(t.embeddings, F.col("vec_id") == F.col("item_id")).select(
        F.col("item_id").alias("query_id"),
        F.when(label > 0, F.array(label * 3, F.col("item_id") + label - 1)).otherwise(F.array().cast("array<bigint>")).alias("expected"),
    )


SQL_EXPECTED = f"""{SQL_RANKED}, ex AS (SELECT item_id AS query_id, CASE WHEN label > 0 THEN [CAST(label * 3 AS BIGINT), item_id + label - 1] ELSE [] END AS expected FROM benchmark JOIN embeddings ON vec_id = item_id),
ro AS (SELECT ex.query_id, min(rank) AS rank, arg_min(file, rank) AS matched FROM ex LEFT JOIN ranked r ON r.query_id = ex.query_id AND list_contains(expected, r.file) GROUP BY 1)"""


@query("rank_of", "J21", f"WITH {SQL_EXPECTED} SELECT query_id, rank, matched FROM ro")
def rank_of(t: Tables) -> DataFrame:
    return E.rank_of(R.rank_files(v_hits(t)), v_expected(t))


@query(
    "keyword_rank_of", "A18",
    f"""WITH {SQL_EXPECTED}, kh AS (SELECT h.*, CASE WHEN e.label < 5 THEN h.pos END AS keyword_rank FROM hits h JOIN embeddings e ON e.vec_id = h.vec_id),
    b AS (SELECT query_id, keyword_rank FROM (SELECT kh.*, row_number() OVER (PARTITION BY kh.query_id ORDER BY score DESC, pos) AS r FROM kh JOIN ro ON ro.query_id = kh.query_id AND ro.matched = kh.file) WHERE r = 1)
    SELECT query_id, keyword_rank FROM ro LEFT JOIN b USING (query_id)""",
)
def keyword_rank_of(t: Tables) -> DataFrame:
    hits = v_hits(t).join(t.embeddings.select("vec_id", "label"), "vec_id").withColumn("keyword_rank", F.when(F.col("label") < 5, F.col("pos")))
    return E.keyword_rank_of(hits, E.rank_of(R.rank_files(v_hits(t)), v_expected(t)))


SQL_LABEL = "CASE WHEN k % 2 = 0 THEN 'on' ELSE 'off' END || '/' || CASE WHEN k < 33 THEN 15 WHEN k < 66 THEN 30 ELSE 50 END || '/' || CASE WHEN value < 20 THEN 'and' ELSE 'or' END"


def v_label():
    k = payload_k()
    return F.concat_ws(
        "/", F.when(k % 2 == 0, "on").otherwise("off"), F.when(k < 33, "15").when(k < 66, "30").otherwise("50"),
        F.when(F.col("value") < 20, "and").otherwise("or"),
    )


@query(
    "eval_grid", "J28",
    f"""WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), r AS (SELECT user_id AS question_id, {SQL_LABEL} AS config, count(*) AS runs FROM e GROUP BY 1, 2),
    c AS (SELECT r || '/' || m || '/' || w AS config FROM (VALUES ('on'), ('off')) a(r), (VALUES (15), (30), (50)) b(m), (VALUES ('and'), ('or')) d(w))
    SELECT item_id AS question_id, c.config, coalesce(r.runs, 0) AS runs FROM benchmark, c LEFT JOIN r ON r.question_id = item_id AND r.config = c.config""",
)
def eval_grid(t: Tables) -> DataFrame:
    records = t.events.select(F.col("user_id").alias("question_id"), v_label().alias("config"))
    return E.eval_grid(t.benchmark.select(F.col("item_id").alias("question_id")), records)


SQL_RAW_CONFIG = """SELECT ' ' || CASE event_type WHEN 'view' THEN 'on' WHEN 'click' THEN 'off' ELSE 'maybe' END || '/' || k || '/' || CASE WHEN value < 50 THEN 'and' WHEN value < 100 THEN 'or' ELSE 'xor' END || ' ' AS raw
   FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""


@query(
    "valid_configs", "P19",
    f"""WITH r AS ({SQL_RAW_CONFIG}), g AS (SELECT trim(raw) AS config, regexp_matches(trim(raw), '^(on|off)/[0-9]+/(and|or)$') AND coalesce(TRY_CAST(split_part(trim(raw), '/', 2) AS INT) BETWEEN 1 AND 50, false) AS ok FROM r)
    SELECT DISTINCT config, 'valid' AS outcome, CAST(1 AS BIGINT) AS entries FROM g WHERE ok UNION ALL SELECT config, 'rejected', count(*) FROM g WHERE NOT ok GROUP BY 1""",
)
def valid_configs(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    raw = F.concat(
        F.lit(" "), F.when(kind == "view", "on").when(kind == "click", "off").otherwise("maybe"), F.lit("/"), payload_k().cast("string"), F.lit("/"),
        F.when(F.col("value") < 50, "and").when(F.col("value") < 100, "or").otherwise("xor"), F.lit(" "),
    )
    good, bad = E.valid_configs(t.events.select(raw.alias("raw")), "raw")
    return good.select("config", F.lit("valid").alias("outcome"), F.lit(1).cast("bigint").alias("entries")).unionByName(
        bad.groupBy("config").agg(F.count("*").alias("entries")).select("config", F.lit("rejected").alias("outcome"), "entries")
    )


@query(
    "config_mismatch", "J30",
    f"""WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), q AS (SELECT event_id AS id, {SQL_LABEL} AS requested FROM e),
    s AS (SELECT event_id AS id, CASE WHEN k = 7 THEN 'on/15/and' ELSE {SQL_LABEL} END AS resolved FROM e WHERE event_type <> 'error')
    SELECT id, 'asked for ' || requested || CASE WHEN resolved IS NULL THEN ', the Worker sent none' ELSE ', the Worker resolved ' || resolved END AS mismatch
    FROM q LEFT JOIN s USING (id) WHERE resolved IS NULL OR requested <> resolved""",
)
def config_mismatch(t: Tables) -> DataFrame:
    requested = t.events.select(F.col("event_id").alias("id"), v_label().alias("requested"))
    resolved = t.events.filter(F.col("event_type") != "error").select(
        F.col("event_id").alias("id"), F.when(payload_k() == 7, "on/15/and").otherwise(v_label()).alias("resolved")
    )
    return E.config_mismatch(requested, resolved)


@query(
    "indicator_rates", "A14",
    """SELECT source, count(*) AS answers, round(avg(CASE WHEN quality = 1 THEN 1.0 WHEN quality = 0 THEN 0.0 END), 6) AS good_rate, count(quality) AS good_scored,
       round(avg(CASE WHEN toxic = 0 THEN 1.0 WHEN toxic = 1 THEN 0.0 END), 6) AS safe_rate, count(toxic) AS safe_scored FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""",
)
def indicator_rates(t: Tables) -> DataFrame:
    graded = t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left").select(
        "source", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 0).alias("safe")
    )
    return E.indicator_rates(graded, ["good", "safe"])


@query(
    "regression_check", "A15",
    f"""WITH {SQL_RECORDS}, m AS (SELECT id, min(rank) FILTER (config = 'view') AS b, coalesce(min(rank) FILTER (config = 'click'), 1000000) AS n, bool_or(id < 3) AS named
          FROM recs WHERE error IS NULL AND config IN ('view', 'click') GROUP BY id)
    SELECT coalesce(bool_and(NOT named OR n <= 5), true) AS named_in_top, coalesce(bool_and(NOT named OR n < coalesce(b, 1000000)), true) AS named_improved,
      coalesce(bool_and(coalesce(b, 0) <> 1 OR n <= 3), true) AS no_regression, count(*) FILTER (b = 1 AND n > 3) AS regressed FROM m""",
)
def regression_check(t: Tables) -> DataFrame:
    return E.regression_check(v_records(t), "view", "click", F.col("id") < 3)


def v_messages(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("event_id").alias("msg_id"), F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("conv_id"), F.col("ts").alias("created_at")
    )


@query("budget_usage", "A8", "SELECT strftime(ts, '%Y-%m') AS month, least(count(*), 2500) AS used, greatest(count(*) - 2500, 0) AS refused FROM events GROUP BY 1")
def budget_usage(t: Tables) -> DataFrame:
    return E.budget_usage(v_messages(t))


@query("allowed_messages", "A8", "SELECT event_id AS msg_id, strftime(ts, '%Y-%m') AS month, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m') ORDER BY ts, event_id) AS used FROM events QUALIFY used <= 2500")
def allowed_messages(t: Tables) -> DataFrame:
    return E.allowed_messages(v_messages(t)).select("msg_id", "month", "used")


@query(
    "stale_conversations", "A17",
    f"SELECT user_id || '-' || event_type AS conv_id, count(*) AS total FROM events GROUP BY 1 HAVING count(*) FILTER (ts > TIMESTAMP '{NOW}' - INTERVAL 7 DAY) = 0",
)
def stale_conversations(t: Tables) -> DataFrame:
    return E.stale_conversations(v_messages(t), NOW).select("conv_id", "total")


SQL_TELEMETRY = f"""WITH {SQL_ERRORS} SELECT strftime(date_trunc('hour', e.ts), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS searches, count(*) FILTER (e.event_type = 'view') AS fallbacks,
   floor(sum(CAST(round(value * 100) AS BIGINT)) * 10 / count(*) + 0.5) / 1000 AS mean_ms, count(*) FILTER (e.event_type = 'error') AS errors FROM events e JOIN kinds k USING (event_id) GROUP BY 1"""


def v_telemetry(t: Tables) -> DataFrame:
    e = v_errors(t).select("event_id", classify_error("stage", "message").alias("kind"))
    return t.events.join(e, "event_id").select(
        "ts", (F.col("event_type") == "view").alias("fallback"), F.col("value").alias("ms"),
        F.when(F.col("event_type") == "error", F.col("kind")).alias("error_kind"),
    )


@query("telemetry_rollup", "ST9", SQL_TELEMETRY)
def telemetry_rollup(t: Tables) -> DataFrame:
    return E.telemetry_rollup(v_telemetry(t))


@query(
    "read_telemetry", "S6",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS chunks, event_type = 'view' AS fallback, value AS ms FROM events WHERE event_type <> 'signup'",
)
def read_telemetry(t: Tables) -> DataFrame:
    """Log lines as the service writes them; sign-ups carry another tag and are ignored."""
    payload = F.to_json(F.struct(payload_k().alias("chunks"), (F.col("event_type") == "view").alias("fallback"), F.col("value").alias("ms")))
    tag = F.when(F.col("event_type") == "signup", "[other] ").otherwise("2024 [retrieval] ")
    lines = t.events.select("event_id", F.concat(tag, payload).alias("value"))
    return S.read_telemetry(lines, "retrieval").select("event_id", F.col("chunks").cast("bigint").alias("chunks"), "fallback", "ms")


@query(
    "read_questions", "S5",
    """SELECT CAST(conv_id AS VARCHAR) AS id, turn - min(turn) OVER (PARTITION BY conv_id) AS turn, role, md5(text) AS digest FROM conversations
       UNION ALL SELECT 'B' || item_id, 0, 'user', md5(text) FROM benchmark""",
)
def read_questions(t: Tables) -> DataFrame:
    """Conversations as multi-turn questions and benchmark items as single prompts, through files."""
    path = shared_dir(t.spark, "questions")
    turn = F.struct("turn", "role", F.col("text").alias("content"))
    multi = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("m")).select(
        F.col("conv_id").cast("string").alias("id"), F.lit("follow-up").alias("block"), F.lit(None).cast("string").alias("prompt"),
        F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"),
    )
    single = t.benchmark.select(
        F.concat(F.lit("B"), F.col("item_id").cast("string")).alias("id"), F.lit("single").alias("block"), F.col("text").alias("prompt"),
        F.lit(None).cast(f"array<{S.TURN}>").alias("messages"),
    )
    multi.unionByName(single).write.mode("overwrite").json(path)
    return S.question_turns(S.read_questions(t.spark, path)).select("id", "turn", "role", F.md5("content").alias("digest"))
