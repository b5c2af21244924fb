"""Retrieval evaluation, telemetry rollups, budgets and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslane.functions import lexicon as L
from corpuslane.functions.text import ws_trim

# --- the default evaluation matrix: rewrite / max results / keyword mode (fixed values) ---
DEFAULT_MATRIX = [f"{r}/{m}/{k}" for r in ("on", "off") for m in (15, 30, 50) for k in ("and", "or")]
TRIPLE = r"^(on|off)/([0-9]+)/(and|or)$"


def rank_of(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """Rank and key of the first ranked file that was expected; null when none or nothing expected.

    ``ranked(query_id, file, rank)``, ``expected(query_id, expected array)``.
    """
    want = expected.select("query_id", F.explode("expected").alias("file")).distinct()
    hit = ranked.join(want, ["query_id", "file"]).groupBy("query_id").agg(
        F.min("rank").alias("rank"), F.min_by("file", "rank").alias("matched")
    )
    return expected.select("query_id").join(hit, "query_id", "left")


def keyword_rank_of(hits: DataFrame, matched: DataFrame) -> DataFrame:
    """Keyword rank of the matched file's best chunk; the earliest chunk wins a tie."""
    best = hits.join(matched.select("query_id", F.col("matched").alias("file")), ["query_id", "file"]).groupBy("query_id").agg(
        F.max_by(F.struct("keyword_rank"), F.struct(F.coalesce("score", F.lit(0.0)), -F.col("pos"))).alias("b")
    )
    return matched.select("query_id").join(best, "query_id", "left").select("query_id", F.col("b.keyword_rank").alias("keyword_rank"))


def round_half_up(x: Column, digits: int = 0) -> Column:
    scale = 10**digits
    return F.floor(x * scale + 0.5) / scale


def summarise(records: DataFrame) -> DataFrame:
    """Hits at 1/3/5, misses, mean rank, mean latency and errors per configuration."""
    ok = F.col("error").isNull()
    scored = ok & F.col("has_expected")
    rank = F.when(scored, F.col("rank"))
    return records.groupBy("config").agg(
        F.count_if(rank <= 1).alias("hits1"), F.count_if(rank <= 3).alias("hits3"), F.count_if(rank <= 5).alias("hits5"),
        (F.count_if(scored) - F.count(rank)).alias("misses"),
        round_half_up(F.avg(rank), 2).alias("mean_rank"),
        F.coalesce(round_half_up(F.avg(F.when(ok, F.col("ms")))), F.lit(0)).cast("bigint").alias("mean_ms"),
        F.count_if(~ok).alias("errors"),
    )


def cell() -> Column:
    """What a grid cell shows for a record."""
    return (
        F.when(F.col("error").isNotNull(), "err").when(~F.col("has_expected"), F.col("files").cast("string"))
        .when(F.col("rank").isNull(), "—")
        .otherwise(F.concat(F.col("rank").cast("string"), F.when(F.col("keyword_rank").isNotNull(), "k").otherwise("")))
    )


def rank_grid(records: DataFrame, configs: list[str]) -> DataFrame:
    """Question by configuration; the first record of a pair fills its cell."""
    first = records.select("id", "config", F.col("ord"), cell().alias("cell")).groupBy("id").pivot("config", configs).agg(
        F.min_by("cell", "ord")
    )
    return first.select("id", *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in configs])


def eval_grid(questions: DataFrame, records: DataFrame, configs: list[str] | None = None) -> DataFrame:
    """Every configuration and question pair with whether a record exists.

    The configurations are a short literal list laid beside each question, not a join.
    """
    grid = questions.select("question_id", F.explode(F.array(*[F.lit(c) for c in configs or DEFAULT_MATRIX])).alias("config"))
    done = records.groupBy("question_id", "config").agg(F.count("*").alias("runs"))
    return grid.join(done, ["question_id", "config"], "left").withColumn("runs", F.coalesce("runs", F.lit(0)))


def valid_configs(raw: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Distinct valid configuration triples, and the rejected entries."""
    entry = ws_trim(text)
    size = F.regexp_extract(entry, TRIPLE, 2).try_cast("int")
    good = entry.rlike(TRIPLE) & size.between(1, L.MAX_RESULTS)
    tagged = raw.select(entry.alias("config"), F.coalesce(good, F.lit(False)).alias("ok")).filter(F.col("config") != "")
    return tagged.filter("ok").select("config").distinct(), tagged.filter(~F.col("ok")).select("config")


def config_label(rewrite: Column, max_results: Column, keyword: Column) -> Column:
    return F.concat_ws("/", F.when(rewrite, "on").otherwise("off"), max_results.cast("string"), keyword)


def config_mismatch(requested: DataFrame, resolved: DataFrame) -> DataFrame:
    """Results whose resolved configuration differs from the requested one, or is missing."""
    both = requested.join(resolved, "id", "left")
    asked = F.concat(F.lit("asked for "), F.col("requested"))
    return both.filter(F.col("resolved").isNull() | (F.col("requested") != F.col("resolved"))).select(
        "id",
        F.when(F.col("resolved").isNull(), F.concat(asked, F.lit(", the Worker sent none")))
        .otherwise(F.concat(asked, F.lit(", the Worker resolved "), F.col("resolved"))).alias("mismatch"),
    )


def indicator_rates(graded: DataFrame, indicators: list[str]) -> DataFrame:
    """Pass rate per indicator with nulls out of both sides, and the denominator."""
    aggs = []
    for name in indicators:
        aggs += [
            F.round(F.avg(F.col(name).cast("double")), 6).alias(f"{name}_rate"), F.count(name).alias(f"{name}_scored")
        ]
    return graded.groupBy("source").agg(F.count("*").alias("answers"), *aggs)


def regression_check(records: DataFrame, base: str, candidate: str, named: Column, top: int = 5, floor: int = 3) -> DataFrame:
    """Whether a candidate configuration may replace the base one, in one pass over ids.

    Named cases rank within ``top`` and improve; no case ranked first falls below ``floor``.
    """
    met = records.filter(F.col("error").isNull() & F.col("config").isin(base, candidate)).groupBy("id").agg(
        F.min(F.when(F.col("config") == base, F.col("rank"))).alias("base_rank"),
        F.min(F.when(F.col("config") == candidate, F.col("rank"))).alias("new_rank"),
        F.bool_or(named).alias("named"),
    )
    new = F.coalesce("new_rank", F.lit(1_000_000))
    return met.agg(
        F.coalesce(F.bool_and(~F.col("named") | (new <= top)), F.lit(True)).alias("named_in_top"),
        F.coalesce(F.bool_and(~F.col("named") | (new < F.coalesce("base_rank", F.lit(1_000_000)))), F.lit(True)).alias("named_improved"),
        F.coalesce(F.bool_and((F.coalesce("base_rank", F.lit(0)) != 1) | (new <= floor)), F.lit(True)).alias("no_regression"),
        F.count_if((F.col("base_rank") == 1) & (new > floor)).alias("regressed"),
    )


# --- budget and retention -----------------------------------------------------------


def budget_usage(messages: DataFrame, cap: int = L.MONTHLY_CAP) -> DataFrame:
    """Use per month against the cap: a count, no ordering needed."""
    return messages.groupBy(F.date_format("created_at", "yyyy-MM").alias("month")).agg(
        F.least(F.count("*"), F.lit(cap)).cast("bigint").alias("used"), F.greatest(F.count("*") - cap, F.lit(0)).cast("bigint").alias("refused")
    )


def allowed_messages(messages: DataFrame, cap: int = L.MONTHLY_CAP) -> DataFrame:
    """The messages answered within each month's cap, in arrival order.

    The rank limit keeps at most ``cap`` rows per month and task before the shuffle.
    """
    w = Window.partitionBy("month").orderBy("created_at", "msg_id")
    return (
        messages.withColumn("month", F.date_format("created_at", "yyyy-MM"))
        .withColumn("used", F.row_number().over(w).cast("bigint")).filter(F.col("used") <= cap)
    )


def stale_conversations(messages: DataFrame, now: str, days: int = L.PURGE_DAYS) -> DataFrame:
    """Conversations with no message in the last week, with the messages a purge would drop."""
    recent = F.col("created_at") > F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS")
    return messages.groupBy("conv_id").agg(F.count("*").alias("total"), F.count_if(recent).alias("recent")).filter(F.col("recent") == 0)


def telemetry_rollup(events: DataFrame) -> DataFrame:
    """Fallbacks, latency and error kinds per tumbling hour. Shapes only, no text."""
    return events.groupBy(F.window("ts", "1 hour").alias("w")).agg(
        F.count("*").alias("searches"), F.count_if("fallback").alias("fallbacks"),
        # summed in hundredths, so partial sums merge to the same value in any order
        (F.floor(F.sum(F.round(F.col("ms") * 100).cast("bigint")) * 10 / F.count("*") + 0.5) / 1000).alias("mean_ms"), F.count_if(F.col("error_kind").isNotNull()).alias("errors"),
    ).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "searches", "fallbacks", "mean_ms", "errors")
