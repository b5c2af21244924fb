"""Registered queries: streams drained over the given tables, each with a batch twin elsewhere.

Answers are the structured conversation answers cut into deltas; every third conversation is
cut into 7, 64 or whole-length pieces. Long assistant answers first make a collapsed attempt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslane.functions import text as X
from corpuslane.operators import answers as A
from corpuslane.plans.conversations import SQL_ANSWERS, SQL_GATE, v_answers
from corpuslane.plans.registry import query
from corpuslane.plans.screening import EMAIL_SQL, PHONE_SQL
from corpuslane.plans.snapshots import NOW, SQL_MANIFEST, v_exported, v_failed, v_prev, v_stale
from corpuslane.session import Tables, deal, shared_dir
from corpuslane.sources import logs as G
from corpuslane.streaming import activity as V
from corpuslane.streaming import answers as T


def v_deltas(t: Tables) -> DataFrame:
    a = v_answers(t)
    attempt = lambda n: F.lit(n).cast("int").alias("attempt")
    long = (F.col("role") == "assistant") & (F.char_length("answer") > 900)
    collapsed = a.filter(long).select("conv_id", "turn", attempt(1), F.repeat(F.lit("the of and "), 40).alias("body"))
    real = a.select("conv_id", "turn", F.when(long, 2).otherwise(1).cast("int").alias("attempt"), F.col("answer").alias("body"))
    n = F.char_length("body")
    size = F.when(F.col("conv_id") % 3 == 0, 7).when(F.col("conv_id") % 3 == 1, 64).otherwise(F.greatest(n, F.lit(1)))
    sized = collapsed.unionByName(real).withColumn("size", size)
    cuts = X.bind(
        F.struct("body", "size"),
        lambda x: F.transform(
            F.sequence(F.lit(0), F.ceil(F.char_length(x["body"]) / x["size"]).cast("int") - 1),
            lambda i: F.substr(x["body"], i * x["size"] + 1, x["size"]),
        ),
    )
    pieces = F.ceil(n / F.col("size"))
    return X.unroll(sized, ["conv_id", "turn", "attempt", pieces.alias("n")], cuts, "seq", "delta").select(
        "conv_id", "turn", "attempt", F.col("seq").cast("bigint").alias("seq"), "delta",
        F.when(F.col("seq") == F.col("n") - 1, F.col("n").cast("bigint")).alias("tokens"),
    )


def delta_path(t: Tables) -> str:
    path = shared_dir(t.spark, "deltas")
    deal(v_deltas(t), "conv_id").write.mode("overwrite").json(path)
    return path


def assembled(parts: DataFrame, kind: str) -> DataFrame:
    """Shown text of each answer in part order."""
    return parts.groupBy("conv_id", "turn", "attempt").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("part", "text")))), lambda x: x["text"]), ""
        ).alias(kind),
        F.max("coverage").alias("coverage"), F.max("blocked").alias("blocked"), F.max("reason").alias("reason"),
        F.count_if(F.col("kind") == "tail").alias("tails"),
    )


@query("read_deltas", "S7", f"WITH {SQL_ANSWERS} SELECT conv_id, turn, md5(answer) AS digest FROM ans")
def read_deltas(t: Tables) -> DataFrame:
    """Deltas through files, put back together."""
    d = G.read_deltas(t.spark, delta_path(t), stream=False)
    return d.groupBy("conv_id", "turn", "attempt").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "delta"))), lambda x: x["delta"]), "").alias("body")
    ).groupBy("conv_id", "turn").agg(F.md5(F.max_by("body", "attempt")).alias("digest"))


@query(
    "sniff_stream", "ST1",
    f"WITH {SQL_ANSWERS} SELECT conv_id, turn, CAST(CASE WHEN role = 'assistant' AND length(answer) > 900 THEN 2 ELSE 1 END AS BIGINT) AS winner FROM ans",
)
def sniff_stream(t: Tables) -> DataFrame:
    """The first attempt that does not read as collapsed wins, of at most three."""
    verdicts = V.drain(T.sniff_stream(G.read_deltas(t.spark, delta_path(t))), "sniff")
    good = verdicts.filter((F.col("verdict") == "accepted") & (F.col("attempt") <= 3))
    return good.groupBy("conv_id", "turn").agg(F.min("attempt").cast("bigint").alias("winner"))


def last_attempt(df: DataFrame) -> DataFrame:
    return df.groupBy("conv_id", "turn").agg(F.max_by(F.struct(*[c for c in df.columns if c not in ("conv_id", "turn")]), "attempt").alias("l")).select("conv_id", "turn", "l.*")


@query("gate_stream", "ST2 U4", f"WITH {SQL_GATE} SELECT conv_id, turn, coverage, blocked, reason, md5(body) AS digest FROM gated")
def gate_stream(t: Tables) -> DataFrame:
    parts = V.drain(T.gate_stream(G.read_deltas(t.spark, delta_path(t))), "gate")
    return last_attempt(assembled(parts, "body")).select("conv_id", "turn", "coverage", "blocked", "reason", F.md5("body").alias("digest"))


@query(
    "answer_stream", "ST3 ST4",
    f"""WITH {SQL_GATE} SELECT conv_id, turn, coverage, blocked, md5(CASE WHEN body = '' THEN '' ELSE substr(body, 1, strpos(body, 'SOPs say:') + 8) END) AS shown,
        CASE WHEN body = '' THEN NULL ELSE md5(substr(body, strpos(body, 'SOPs say:') + 9)) END AS held, CAST(CASE WHEN body = '' THEN 0 ELSE len(regexp_extract_all(substr(body, 1, strpos(body, 'What the SOPs say:')), '(?m)^\\s*[0-9]+\\.\\s')) END AS BIGINT) AS steps FROM gated""",
)
def answer_stream(t: Tables) -> DataFrame:
    """Gate, hold and per-answer statistics in one stateful pass."""
    parts = V.drain(T.answer_parts_stream(G.read_deltas(t.spark, delta_path(t))), "answers")
    body = assembled(parts, "body")
    tails = parts.filter(F.col("kind") == "tail").select("conv_id", "turn", "attempt", F.col("text").alias("held"))
    joined = last_attempt(body.join(tails, ["conv_id", "turn", "attempt"], "left"))
    return joined.select(
        "conv_id", "turn", "coverage", "blocked", F.md5("body").alias("shown"), F.md5("held").alias("held"), A.step_count("body").alias("steps")
    )


def stream_of(t: Tables, name: str) -> DataFrame:
    """A table, one file or a folder of parts, as a file stream; its own schema is known, so nothing is inferred.

    The braces make the path a pattern, the one form in which a stream takes a single file.
    """
    return t.spark.readStream.schema(getattr(t, name).schema).parquet(t.path(f"{{{name}}}"))


@query(
    "idle_sessions", "ST5",
    """WITH e AS (SELECT user_id AS conv_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events),
    s AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts > prev + INTERVAL 24 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e),
    g AS (SELECT conv_id, min(ts) AS started, max(ts) + INTERVAL 24 HOUR AS idle_since, count(*) AS total FROM s GROUP BY conv_id, n)
    SELECT * FROM g WHERE idle_since <= (SELECT max(ts) FROM events)""",
)
def idle_sessions(t: Tables) -> DataFrame:
    ev = stream_of(t, "events").select(F.col("ts").cast("timestamp").alias("at"), F.col("user_id").alias("conv_id"))
    return V.drain(V.idle_sessions(ev, "conv_id", "at", "24 hours"), "idle")


@query("budget_stream", "ST6", "SELECT strftime(ts, '%Y-%m') AS month, least(count(*), 2500) AS used, count(*) > 2500 AS exhausted FROM events GROUP BY 1")
def budget_stream(t: Tables) -> DataFrame:
    path = shared_dir(t.spark, "budget")
    ev = stream_of(t, "events").select(F.col("ts").alias("created_at"))
    counter = V.budget_stream(ev)
    V.drain_each(counter, "budget-state", lambda batch, _: batch.write.mode("overwrite").parquet(path), mode="complete")
    return t.spark.read.schema(counter.schema).parquet(path)


@query(
    "screen_stream", "ST7",
    f"""SELECT doc_id, reason FROM (SELECT doc_id, CASE WHEN regexp_matches(text, '{EMAIL_SQL}') THEN 'an email address'
          WHEN regexp_matches(text, '{PHONE_SQL}') THEN 'a phone number' END AS reason FROM documents) WHERE reason IS NOT NULL""",
)
def screen_stream(t: Tables) -> DataFrame:
    path = shared_dir(t.spark, "screened")
    docs = stream_of(t, "documents").select("doc_id", F.lit("user").alias("role"), "text")
    V.screen_stream(docs, "text", "role", path)
    return t.spark.read.schema("doc_id bigint, role string, reason string").parquet(f"{path}/findings").select("doc_id", "reason")


@query("dedupe_stream", "ST8", "SELECT event_id FROM events")
def dedupe_stream(t: Tables) -> DataFrame:
    """Every event delivered twice, as after a restart."""
    one = lambda: stream_of(t, "events").select("event_id", F.col("ts").cast("timestamp").alias("at"))
    return V.drain(V.dedupe_stream(one().union(one()), "event_id", "at"), "dedupe").select("event_id")


@query(
    "telemetry_stream", "ST9",
    """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS searches, count(*) FILTER (event_type = 'view') AS fallbacks,
       floor(sum(CAST(round(value * 100) AS BIGINT)) * 10 / count(*) + 0.5) / 1000 AS mean_ms, count(*) FILTER (event_type = 'error') AS errors
    FROM events GROUP BY date_trunc('hour', ts) HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""",
)
def telemetry_stream(t: Tables) -> DataFrame:
    ev = stream_of(t, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "view").alias("fallback"), F.col("value").alias("ms"),
        F.when(F.col("event_type") == "error", "retrieval").alias("error_kind"),
    )
    return V.drain(V.telemetry_stream(ev), "telemetry")


@query(
    "sync_batch", "ST10",
    f"WITH {SQL_MANIFEST} SELECT 'file' AS kind, key, title, NULL::VARCHAR AS since, source_id FROM kept UNION ALL SELECT 'stale', key, NULL, since, source_id FROM carried",
)
def sync_batch(t: Tables) -> DataFrame:
    """The exported keys arrive as a stream of several batches and meet the manifest of the last run."""
    path = shared_dir(t.spark, "sync")
    v_exported(t).repartition(3, "key").write.mode("overwrite").parquet(f"{path}/in")
    arriving = t.spark.readStream.schema(v_exported(t).schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    V.sync_batch(
        arriving, f"{path}/landed", lambda: (v_prev(t), v_stale(t)), v_failed(t),
        lambda df: df.write.mode("overwrite").parquet(f"{path}/next"), NOW,
    )
    return t.spark.read.schema("kind string, key bigint, title string, since string, source_id bigint").parquet(f"{path}/next")
