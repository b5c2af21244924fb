"""Streams over conversation activity: idle sessions, budget, screening, dedupe, telemetry, sync."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslane.functions import lexicon as L
from corpuslane.operators import evaluate as E
from corpuslane.operators import screen as S
from corpuslane.operators import snapshot as N
from corpuslane.session import shared_dir
from corpuslane.streaming.answers import ROCKSDB


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything available, into Parquet in the shared folder, and read it back."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    path = shared_dir(spark, name)
    q = (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("checkpointLocation", f"{path}/_state").trigger(availableNow=True).start(f"{path}/rows")
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def drain_each(stream: DataFrame, name: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Run a stream over everything available through ``write(batch, batch_id)``."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    q = (
        stream.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", shared_dir(spark, name)).trigger(availableNow=True).start()
    )
    q.awaitTermination()


def idle_sessions(stream: DataFrame, key: str, ts: str, gap: str, delay: str = "0 seconds") -> DataFrame:
    """Sessions closed by ``gap`` of silence, each emitted once the watermark has passed it."""
    return (
        stream.withWatermark(ts, delay)
        .groupBy(F.session_window(ts, gap).alias("s"), F.col(key))
        .agg(F.count("*").alias("total"))
        .select(key, F.col("s.start").alias("started"), F.col("s.end").alias("idle_since"), "total")
    )


def budget_stream(stream: DataFrame, cap: int = L.MONTHLY_CAP) -> DataFrame:
    """Live monthly counter: partial counts meet per month, so a busy month is only a few rows."""
    return stream.groupBy(F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("asked")).select(
        "month", F.least("asked", F.lit(cap)).cast("bigint").alias("used"), (F.col("asked") > cap).alias("exhausted")
    )


def screen_batch(messages: DataFrame, text: str, role: str) -> tuple[DataFrame, DataFrame]:
    """Redacted messages, and findings without any text."""
    out = S.redact_blocked(messages, text, role)
    findings = out.filter(F.col("reason").isNotNull()).drop(text)
    return out, findings


def screen_stream(stream: DataFrame, text: str, role: str, path: str) -> None:
    """Identifier tripwire on arriving messages: two sinks, raw text is never written.

    Batches are written under their id, so a replayed batch replaces itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        redacted, findings = screen_batch(batch, text, role)
        redacted.write.mode("overwrite").parquet(f"{path}/messages/batch={batch_id}")
        findings.write.mode("overwrite").parquet(f"{path}/findings/batch={batch_id}")

    drain_each(stream, "screen", write)


def dedupe_stream(stream: DataFrame, key: str, ts: str, delay: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def telemetry_stream(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    return E.telemetry_rollup(stream.withWatermark("ts", delay))


def sync_batch(
    stream: DataFrame, landing: str, read_previous: Callable[[], tuple[DataFrame, DataFrame]], failed: DataFrame,
    write_next: Callable[[DataFrame], None], now: str,
) -> None:
    """Nightly run: all newly exported keys met with the last manifest, the next one written.

    Batches land in ``landing`` under their id, so a replayed one replaces itself; the manifest is
    reconciled once, with everything that arrived in the run.
    """
    spark = stream.sparkSession
    # a run without arrivals is reconciled too
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{landing}/batch=-1")
    drain_each(stream, "sync", lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{landing}/batch={batch_id}"))
    exported = spark.read.schema(stream.schema).parquet(landing)
    prev, stale = read_previous()
    write_next(N.reconcile_manifest(prev, stale, exported, failed, now))
