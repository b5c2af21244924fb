"""Export eligibility, key assignment and snapshot reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslane.functions import lexicon as L
from corpuslane.functions.text import slug
from corpuslane.session import materialize

NO_TAG = "no SOP/Reference tag"
STUB = "untitled template stub"


def export_decision(pages: DataFrame, deny: DataFrame) -> DataFrame:
    """``export``, ``reason`` and ``warning`` per page.

    ``pages(id, title, categories)``, ``deny(id, why)``. A page with neither tag is warned
    about, never dropped.
    """
    tagged = F.array_contains("categories", "SOP") | F.array_contains("categories", "Reference")
    reason = F.when(F.col("title") == L.UNTITLED, STUB).otherwise(F.col("why"))
    return (
        pages.join(deny, "id", "left")
        .withColumn("reason", reason)
        .withColumns(
            {
                "export": F.col("reason").isNull(),
                "warning": F.when(F.col("reason").isNull() & ~F.coalesce(tagged, F.lit(False)), NO_TAG),
            }
        )
        .drop("why")
    )


def live_rows(df: DataFrame, directory: bool = False) -> DataFrame:
    live = df.filter(~F.coalesce("archived", F.lit(False)) & ~F.coalesce("in_trash", F.lit(False)))
    return live.filter(F.col("status") == "Live") if directory else live


def drop_excluded_children(pages: DataFrame) -> DataFrame:
    """Exported pages whose parent, if any, is exported too (one level)."""
    excluded = pages.filter(~F.col("export")).select(F.col("id").alias("parent_id"))
    return pages.filter("export").join(excluded, "parent_id", "left_anti")


def assign_keys(pages: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Collision-free keys in page-id order: slug, then slug and id, then numbered.

    Each page proposes its next choice and every key keeps the smallest page id; displaced
    pages move on. That settles on the same keys as visiting pages one by one in id order.
    Holders come from a grouped minimum and are matched back on the unique page id, so a
    slug shared by a third of all pages never meets in one task.
    """
    with_id = F.concat_ws("-", "slug", F.left(F.replace("id", F.lit("-"), F.lit("")), F.lit(8)))
    base = pages.select("id", slug("title").alias("slug")).withColumn("with_id", with_id)
    firsts = base.groupBy("slug").agg(F.min("id").alias("id"))
    tail = Window.partitionBy("with_id").orderBy("id")
    opened = base.join(firsts.select("id", F.lit(True).alias("first")), "id", "left")
    state = (
        opened.filter(F.col("first")).select("id", "slug", "with_id", F.lit(0).cast("bigint").alias("level"))
        .unionByName(
            opened.filter(F.col("first").isNull())
            .select("id", "slug", "with_id", F.row_number().over(tail).cast("bigint").alias("level"))
        )
    )
    key = (
        F.when(F.col("level") == 0, F.col("slug"))
        .when(F.col("level") == 1, F.col("with_id"))
        .otherwise(F.concat_ws("-", "with_id", F.col("level").cast("string")))
    )
    for _ in range(max_rounds):
        state = materialize(state.withColumn("key", key), "keys")
        holders = state.groupBy("key").agg(F.min("id").alias("holder"), F.count("*").alias("n"))
        contested = holders.filter(F.col("n") > 1).select("key", "holder")
        losers = state.join(contested, "key").filter(F.col("id") > F.col("holder")).select("id")
        if losers.isEmpty():
            return state.select("id", "key")
        moved = losers.withColumn("lost", F.lit(1))
        state = state.join(moved, "id", "left").select(
            "id", "slug", "with_id", (F.col("level") + F.coalesce("lost", F.lit(0))).alias("level")
        )
    raise RuntimeError("key assignment did not settle; raise max_rounds")


# --- manifests -------------------------------------------------------------------


def reconcile_manifest(prev: DataFrame, stale: DataFrame, exported: DataFrame, failed: DataFrame, now: str) -> DataFrame:
    """Next manifest as ``kind`` file/stale rows.

    The four inputs are stacked and met by key in one grouped pass instead of four joins:
    exported and failed keys leave the stale list, a failed key keeps its previous file row,
    and a stale key carries forward its first date and source id (files override stale).
    """
    null = lambda t: F.lit(None).cast(t)
    sid = prev.schema["source_id"].dataType

    def tag(df: DataFrame, origin: str, title: Column, since: Column, source: Column) -> DataFrame:
        return df.select("key", F.lit(origin).alias("origin"), title.alias("title"), since.alias("since"), source.cast(sid).alias("source_id"))

    stacked = (
        tag(prev, "prev", F.col("title"), null("string"), F.col("source_id"))
        .unionByName(tag(stale, "stale", null("string"), F.col("since"), F.col("source_id")))
        .unionByName(tag(exported, "exported", F.col("title"), null("string"), F.col("source_id")))
        .unionByName(tag(failed, "failed", null("string"), null("string"), null("string")))
    )
    is_ = lambda o: F.col("origin") == o
    pick = lambda c, o: F.max(F.when(is_(o), F.col(c)))
    met = stacked.groupBy("key").agg(
        *[F.bool_or(is_(o)).alias(f"in_{o}") for o in ("prev", "stale", "exported", "failed")],
        pick("title", "exported").alias("title_exported"), pick("title", "prev").alias("title_prev"),
        pick("source_id", "exported").alias("id_exported"), pick("source_id", "prev").alias("id_prev"),
        pick("source_id", "stale").alias("id_stale"), pick("since", "stale").alias("since_stale"),
    )
    kept = F.col("in_prev") & F.col("in_failed") & ~F.col("in_exported")
    gone = (F.col("in_prev") | F.col("in_stale")) & ~F.col("in_exported") & ~F.col("in_failed")
    kind = F.when(F.col("in_exported") | kept, "file").when(gone, "stale")
    return (
        met.withColumn("kind", kind).filter(F.col("kind").isNotNull())
        .select(
            "kind", "key",
            F.when(F.col("kind") == "file", F.when(F.col("in_exported"), F.col("title_exported")).otherwise(F.col("title_prev"))).alias("title"),
            F.when(F.col("kind") == "stale", F.coalesce("since_stale", F.lit(now))).alias("since"),
            F.when(F.col("kind") == "stale", F.coalesce("id_prev", "id_stale"))
            .when(F.col("in_exported"), F.col("id_exported")).otherwise(F.col("id_prev")).alias("source_id"),
        )
    )


def stale_keys(prev: DataFrame, stale: DataFrame, exported: DataFrame, failed: DataFrame) -> DataFrame:
    tracked = prev.select("key").union(stale.select("key")).distinct()
    return tracked.join(exported.select("key").union(failed.select("key")), "key", "left_anti")


def kept_files(prev: DataFrame, exported: DataFrame, failed: DataFrame) -> DataFrame:
    """Exported files plus previous files protected by a failure."""
    cols = ["key", "title", "source_id"]
    kept = prev.join(failed.select("key"), "key", "left_semi").join(exported.select("key"), "key", "left_anti")
    return exported.select(*cols).unionByName(kept.select(*cols))


def carry_since(keys: DataFrame, prev: DataFrame, stale: DataFrame, now: str) -> DataFrame:
    files = prev.select("key", F.col("source_id").alias("id_file"))
    old = stale.select("key", "since", F.col("source_id").alias("id_stale"))
    return keys.join(files, "key", "left").join(old, "key", "left").select(
        "key", F.coalesce("since", F.lit(now)).alias("since"), F.coalesce("id_file", "id_stale").alias("source_id")
    )


def prune_keys(stale: DataFrame, gone: DataFrame) -> DataFrame:
    return stale.join(gone.select("key"), "key", "left_anti")


def unexplained_stale(stale: DataFrame, seen: DataFrame) -> DataFrame:
    """Stale keys whose page was not seen this run; a missing id never matches and stays."""
    return stale.join(seen.select("source_id").distinct(), "source_id", "left_anti")


def protect_on_partial(failed: DataFrame, prev: DataFrame, complete: bool | Column) -> DataFrame:
    """When listing failed part-way every previous key counts as failed."""
    done = F.lit(complete) if isinstance(complete, bool) else complete
    return failed.select("key").union(prev.filter(~done).select("key")).distinct()


def suspicious_drop(counts: DataFrame) -> DataFrame:
    """Nothing exported, or more stale than max(5, a fifth of the tracked files)."""
    limit = F.greatest(F.lit(5), F.ceil(F.col("tracked") * 0.2))
    return counts.withColumn("suspicious", (F.col("exported") == 0) | (F.col("stale") > limit))


def run_summary(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count("*").alias("pages"))


def library_index(docs: DataFrame) -> DataFrame:
    return docs.groupBy("category").agg(
        F.count("*").alias("documents"),
        F.count_if(F.col("status") == "draft").alias("drafts"),
        F.count_if(F.col("status") == "approved").alias("approved"),
        F.min("title").alias("first_title"),
    )
