"""Evaluation questions, telemetry lines, token deltas and report files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslane.functions.text import unroll

TURN = "struct<role:string,content:string>"
QUESTION = f"id string, block string, prompt string, messages array<{TURN}>, expected array<string>, notes string"
TELEMETRY = (
    "chunks int, files int, rewrite boolean, rewritten boolean, turns int, attempts int, qlen int, sqlen int, "
    "max int, kw string, fallback boolean, ms double"
)
DELTA = "conv_id bigint, turn bigint, attempt int, seq bigint, delta string, tokens bigint"


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation questions; a single prompt counts as one user turn."""
    q = spark.read.schema(QUESTION).json(path)
    single = F.array(F.struct(F.lit("user").alias("role"), F.coalesce("prompt", F.lit("")).alias("content")))
    return q.withColumn("turns", F.coalesce("messages", single))


def question_turns(questions: DataFrame) -> DataFrame:
    return unroll(questions, ["id", "block"], "turns", "turn", "m").select(
        "id", "block", F.col("turn").cast("bigint").alias("turn"), "m.role", "m.content"
    )


def ask_of(questions: DataFrame) -> DataFrame:
    """The last user turn of each question."""
    asked = F.filter("turns", lambda m: m["role"] == "user")
    return questions.select("id", F.coalesce(F.get(asked, F.size(asked) - 1)["content"], F.lit("")).alias("ask"))


def read_telemetry(lines: DataFrame, tag: str, schema: str = TELEMETRY) -> DataFrame:
    """Rows of the log lines that carry ``[tag]`` and a JSON payload; other lines are ignored.

    Works on a batch or a streaming frame of ``value`` lines.
    """
    pattern = rf"\[{tag}\]\s*(\{{.*\}})\s*$"
    keep = [c for c in lines.columns if c != "value"]
    return (
        lines.filter(F.col("value").rlike(pattern))
        .select(*keep, F.from_json(F.regexp_extract("value", pattern, 1), schema).alias("_t"))
        .filter(F.col("_t").isNotNull()).select(*keep, "_t.*")
    )


def read_deltas(spark: SparkSession, path: str, stream: bool = True) -> DataFrame:
    """Ordered token deltas with a trailing usage event; malformed lines are dropped."""
    reader = spark.readStream if stream else spark.read
    raw = reader.schema(DELTA + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return raw.filter(F.col("_bad").isNull() & F.col("seq").isNotNull()).drop("_bad")


def write_report(records: DataFrame, summary: DataFrame, grid: DataFrame, path: str) -> None:
    """Evaluation outputs: the flat record sidecar, the summary and the rank grid."""
    records.write.mode("overwrite").json(f"{path}/records")
    summary.write.mode("overwrite").json(f"{path}/summary")
    grid.write.mode("overwrite").json(f"{path}/grid")


def markdown_table(df: DataFrame, limit: int = 1_000) -> str:
    """A small result as a markdown table; the row limit guards the driver."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows: publish the table instead of rendering it")
    line = lambda cells: "| " + " | ".join("—" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *[line(r) for r in rows]])
