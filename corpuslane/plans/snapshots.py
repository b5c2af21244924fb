"""Registered queries: corpus ingest, eligibility, keys and manifest reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslane.functions import text as X
from corpuslane.operators import snapshot as S
from corpuslane.plans.registry import query
from corpuslane.session import Tables, shared_dir, spread
from corpuslane.sources import corpus as K

NOW = "2024-02-01"


def v_prev(t: Tables) -> DataFrame:
    return t.documents.filter(F.col("lang") != "es").select(
        F.col("doc_id").alias("key"), F.col("source").alias("title"), F.col("n_chars").alias("source_id")
    )


def v_stale(t: Tables) -> DataFrame:
    return t.documents.filter(F.col("lang") == "es").select(
        F.col("doc_id").alias("key"), F.lit("2024-01-01").alias("since"),
        F.when(F.col("n_chars") > 500, F.col("n_chars")).alias("source_id"),
    )


def v_labelled(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang", "source", "n_chars").join(t.labels, "doc_id", "left")


def v_exported(t: Tables) -> DataFrame:
    return v_labelled(t).filter(F.col("lang").isin("en", "fr") & (F.coalesce("quality", F.lit(1)) == 1)).select(
        F.col("doc_id").alias("key"), F.upper("source").alias("title"), F.col("n_chars").alias("source_id")
    )


def v_failed(t: Tables) -> DataFrame:
    return t.labels.filter(F.col("toxic") == 1).select(F.col("doc_id").alias("key"))


SQL_MANIFEST = """prev AS (SELECT doc_id AS key, source AS title, n_chars AS source_id FROM documents WHERE lang <> 'es'),
stale AS (SELECT doc_id AS key, '2024-01-01' AS since, CASE WHEN n_chars > 500 THEN n_chars END AS source_id FROM documents WHERE lang = 'es'),
exported AS (SELECT d.doc_id AS key, upper(source) AS title, n_chars AS source_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
             WHERE lang IN ('en', 'fr') AND coalesce(quality, 1) = 1),
failed AS (SELECT doc_id AS key FROM labels WHERE toxic = 1),
seen AS (SELECT DISTINCT n_chars AS source_id FROM documents WHERE lang = 'en'),
gone AS (SELECT key FROM (SELECT key FROM prev UNION SELECT key FROM stale) WHERE key NOT IN (SELECT key FROM exported) AND key NOT IN (SELECT key FROM failed)),
carried AS (SELECT g.key, coalesce(s.since, '2024-02-01') AS since, coalesce(p.source_id, s.source_id) AS source_id FROM gone g LEFT JOIN prev p USING (key) LEFT JOIN stale s USING (key)),
kept AS (SELECT * FROM exported UNION ALL SELECT * FROM prev WHERE key IN (SELECT key FROM failed) AND key NOT IN (SELECT key FROM exported))"""


@query(
    "reconcile_manifest", "J4 T2",
    f"WITH {SQL_MANIFEST} SELECT 'file' AS kind, key, title, NULL::VARCHAR AS since, source_id FROM kept UNION ALL SELECT 'stale', key, NULL, since, source_id FROM carried",
)
def reconcile_manifest(t: Tables) -> DataFrame:
    return S.reconcile_manifest(v_prev(t), v_stale(t), v_exported(t), v_failed(t), NOW).orderBy("key")


@query("stale_keys", "X1", f"WITH {SQL_MANIFEST} SELECT key FROM gone")
def stale_keys(t: Tables) -> DataFrame:
    return S.stale_keys(v_prev(t), v_stale(t), v_exported(t), v_failed(t))


@query("kept_files", "X2", f"WITH {SQL_MANIFEST} SELECT key, title, source_id FROM kept")
def kept_files(t: Tables) -> DataFrame:
    return S.kept_files(v_prev(t), v_exported(t), v_failed(t))


@query("carry_since", "X3", f"WITH {SQL_MANIFEST} SELECT key, since, source_id FROM carried")
def carry_since(t: Tables) -> DataFrame:
    keys = S.stale_keys(v_prev(t), v_stale(t), v_exported(t), v_failed(t))
    return S.carry_since(keys, v_prev(t), v_stale(t), NOW)


@query("prune_keys", "X4", f"WITH {SQL_MANIFEST} SELECT key, since, source_id FROM stale WHERE key NOT IN (SELECT key FROM failed)")
def prune_keys(t: Tables) -> DataFrame:
    return S.prune_keys(v_stale(t), v_failed(t))


@query(
    "unexplained_stale", "J5",
    f"WITH {SQL_MANIFEST} SELECT key FROM stale s WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.source_id = s.source_id)",
)
def unexplained_stale(t: Tables) -> DataFrame:
    seen = t.documents.filter(F.col("lang") == "en").select(F.col("n_chars").alias("source_id"))
    return S.unexplained_stale(v_stale(t), seen).select("key")


@query("protect_on_partial", "X7", f"WITH {SQL_MANIFEST} SELECT key FROM failed UNION SELECT key FROM prev WHERE title = 'src1'")
def protect_on_partial(t: Tables) -> DataFrame:
    """Listing stopped inside source ``src1``: its previous keys are protected too."""
    return S.protect_on_partial(v_failed(t), v_prev(t), F.col("title") != "src1")


@query(
    "suspicious_drop", "A12",
    f"""WITH {SQL_MANIFEST}, c AS (SELECT (SELECT count(*) FROM prev) AS tracked, (SELECT count(*) FROM exported) AS exported, (SELECT count(*) FROM gone) AS stale)
    SELECT tracked, exported, stale, exported = 0 OR stale > greatest(5, ceil(tracked * 0.2)) AS suspicious FROM c""",
)
def suspicious_drop(t: Tables) -> DataFrame:
    stale = S.stale_keys(v_prev(t), v_stale(t), v_exported(t), v_failed(t))
    parts = [(v_prev(t), "tracked"), (v_exported(t), "exported"), (stale, "stale")]
    stacked = None
    for df, name in parts:
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
        stacked = one if stacked is None else stacked.unionByName(one)
    counts = stacked.agg(*[F.max(F.when(F.col("what") == n, F.col("n"))).alias(n) for _, n in parts])
    return S.suspicious_drop(counts)


def v_pages(t: Tables) -> DataFrame:
    """Documents as hub pages: tags from length and language, ten pages to a parent."""
    n = F.col("n_chars")
    tag1 = F.when(n > 1000, "Reference").when(n > 300, F.col("lang")).otherwise("SOP")
    tag2 = F.when(F.col("lang") == "en", F.col("source")).when(F.col("lang") == "de", "SOP")
    return t.documents.select(
        F.col("doc_id").alias("id"),
        F.when(n < 100, "Untitled").otherwise(F.concat_ws(" ", "source", "lang")).alias("title"),
        F.array_compact(F.array(tag1, tag2)).alias("categories"),
        F.when(F.col("doc_id") >= 10, F.expr("doc_id DIV 10")).alias("parent_id"),
    )


SQL_PAGES = """pages_v AS (SELECT doc_id AS id, CASE WHEN n_chars < 100 THEN 'Untitled' ELSE source || ' ' || lang END AS title,
   list_filter([CASE WHEN n_chars > 1000 THEN 'Reference' WHEN n_chars > 300 THEN lang ELSE 'SOP' END, CASE WHEN lang = 'en' THEN source WHEN lang = 'de' THEN 'SOP' END], lambda x: x IS NOT NULL) AS categories,
   CASE WHEN doc_id >= 10 THEN doc_id // 10 END AS parent_id FROM documents),
decided AS (SELECT p.*, CASE WHEN title = 'Untitled' THEN 'untitled template stub' ELSE d.why END AS reason FROM pages_v p
   LEFT JOIN (SELECT doc_id AS id, 'flagged page' AS why FROM labels WHERE toxic = 1) d USING (id))"""


def v_decided(t: Tables) -> DataFrame:
    deny = t.labels.filter(F.col("toxic") == 1).select(F.col("doc_id").alias("id"), F.lit("flagged page").alias("why"))
    return S.export_decision(v_pages(t), deny)


@query(
    "export_decision", "P1",
    f"""WITH {SQL_PAGES} SELECT id, reason IS NULL AS export, reason,
        CASE WHEN reason IS NULL AND NOT (list_contains(categories, 'SOP') OR list_contains(categories, 'Reference')) THEN 'no SOP/Reference tag' END AS warning FROM decided""",
)
def export_decision(t: Tables) -> DataFrame:
    return v_decided(t).select("id", "export", "reason", "warning")


@query(
    "live_rows", "P2",
    """SELECT d.doc_id, lang = 'en' AS directory_row FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE NOT coalesce(quality = 0, false) AND NOT coalesce(toxic = 1, false)""",
)
def live_rows(t: Tables) -> DataFrame:
    rows = v_labelled(t).select(
        "doc_id", (F.col("quality") == 0).alias("archived"), (F.col("toxic") == 1).alias("in_trash"),
        F.when(F.col("lang") == "en", "Live").otherwise("Draft").alias("status"),
    )
    return S.live_rows(rows).select("doc_id", (F.col("status") == "Live").alias("directory_row"))


@query(
    "drop_excluded_children", "P3",
    f"WITH {SQL_PAGES} SELECT id FROM decided d WHERE reason IS NULL AND NOT EXISTS (SELECT 1 FROM decided p WHERE p.id = d.parent_id AND p.reason IS NOT NULL)",
)
def drop_excluded_children(t: Tables) -> DataFrame:
    return S.drop_excluded_children(v_decided(t)).select("id")


SQL_STATUS = """SELECT doc_id, CASE WHEN label ILIKE '%draft%' THEN 'draft' WHEN label ILIKE '%review%' THEN 'review' WHEN label ILIKE '%approved%' THEN 'approved'
   WHEN title LIKE '%(DRAFT - Needs Review)' THEN 'draft' END AS status FROM (SELECT doc_id,
     CASE lang WHEN 'en' THEN 'Approved' WHEN 'de' THEN 'Needs Review' WHEN 'fr' THEN 'Draft - in review' END AS label,
     source || CASE WHEN n_chars > 400 THEN ' (DRAFT - Needs Review)' ELSE ' (draft)' END AS title FROM documents)"""


def v_status(t: Tables):
    lang = F.col("lang")
    label = F.when(lang == "en", "Approved").when(lang == "de", "Needs Review").when(lang == "fr", "Draft - in review")
    title = F.concat("source", F.when(F.col("n_chars") > 400, " (DRAFT - Needs Review)").otherwise(" (draft)"))
    return label, title


@query("status_kind", "P4", SQL_STATUS)
def status_kind(t: Tables) -> DataFrame:
    label, title = v_status(t)
    return t.documents.select("doc_id", X.status_kind(label, title).alias("status"))


@query(
    "primary_category", "P5",
    f"WITH {SQL_PAGES} SELECT id, CASE WHEN list_contains(categories, 'SOP') THEN 'SOP' WHEN list_contains(categories, 'Reference') THEN 'Reference' ELSE coalesce(categories[1], 'uncategorized') END AS category FROM pages_v",
)
def primary_category(t: Tables) -> DataFrame:
    return v_pages(t).select("id", X.primary_category("categories").alias("category"))


@query(
    "library_index", "A10",
    f"""WITH {SQL_PAGES}, st AS ({SQL_STATUS}) SELECT CASE WHEN list_contains(categories, 'SOP') THEN 'SOP' WHEN list_contains(categories, 'Reference') THEN 'Reference' ELSE coalesce(categories[1], 'uncategorized') END AS category,
       count(*) AS documents, count(*) FILTER (status = 'draft') AS drafts, count(*) FILTER (status = 'approved') AS approved, min(title) AS first_title FROM pages_v JOIN st ON st.doc_id = id GROUP BY 1""",
)
def library_index(t: Tables) -> DataFrame:
    label, title = v_status(t)
    status = t.documents.select(F.col("doc_id").alias("id"), X.status_kind(label, title).alias("status"))
    docs = v_pages(t).join(status, "id").select("title", X.primary_category("categories").alias("category"), "status")
    return S.library_index(docs)


@query(
    "assign_keys", "W10",
    """WITH s AS (SELECT md5(CAST(doc_id AS VARCHAR)) AS id, regexp_replace(regexp_replace(lower(source || ' / ' || lang), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM documents)
    SELECT id, CASE WHEN row_number() OVER (PARTITION BY slug ORDER BY id) = 1 THEN slug ELSE slug || '-' || left(id, 8) END AS key FROM s""",
)
def assign_keys(t: Tables) -> DataFrame:
    pages = t.documents.select(F.md5(F.col("doc_id").cast("string")).alias("id"), F.concat_ws(" / ", "source", "lang").alias("title"))
    return S.assign_keys(pages)


@query(
    "run_summary", "A21",
    f"WITH {SQL_PAGES} SELECT CASE WHEN reason = 'untitled template stub' THEN 'skipped' WHEN reason IS NOT NULL THEN 'failed' ELSE 'exported' END AS outcome, count(*) AS pages FROM decided GROUP BY 1",
)
def run_summary(t: Tables) -> DataFrame:
    outcome = F.when(F.col("reason") == S.STUB, "skipped").when(F.col("reason").isNotNull(), "failed").otherwise("exported")
    return S.run_summary(v_decided(t).select(outcome.alias("outcome")))


@query("manifest_roundtrip", "S3", "SELECT CAST(doc_id AS VARCHAR) AS key, source AS title, CAST(n_chars AS VARCHAR) AS source_id FROM documents WHERE lang <> 'es'")
def manifest_roundtrip(t: Tables) -> DataFrame:
    path = shared_dir(t.spark, "manifest")
    text = lambda c: F.col(c).cast("string").alias(c)
    files = v_prev(t).select(text("key"), "title", text("source_id"), F.lit("2024-01-01").alias("last_edited"))
    stale = v_stale(t).select(text("key"), "since", text("source_id"))
    K.write_manifest(files, stale, path)
    return K.read_manifest(t.spark, path)[0].select("key", "title", "source_id")


def v_publish(t: Tables) -> DataFrame:
    label, title = v_status(t)
    return t.documents.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("key"),
        F.when(F.col("lang") == "es", F.concat(F.lit('He said "go" \\ '), title)).otherwise(title).alias("title"),
        F.concat(F.lit("https://hub.example.com/"), F.col("doc_id").cast("string")).alias("source_url"),
        F.array(F.when(F.col("n_chars") > 1000, "Reference").otherwise("SOP"), "lang").alias("categories"),
        label.alias("status"), F.concat(F.lit("when: "), "source").alias("use_when"),
        F.when(F.col("lang") == "en", "Casey").alias("owner"),
        F.lit("2024-01-05T10:00:00.000Z").alias("last_edited"), F.col("text").alias("body"),
    )


SQL_CORPUS = r"""SELECT 'doc-' || doc_id || '.md' AS key, CASE WHEN lang = 'es' THEN 'He said "go" \ ' ELSE '' END || source || CASE WHEN n_chars > 400 THEN ' (DRAFT - Needs Review)' ELSE ' (draft)' END AS title,
   CASE WHEN n_chars > 1000 THEN 'Reference' ELSE 'SOP' END AS category, '2024-01-05T10:00:00.000Z' AS last_edited, 'https://hub.example.com/' || doc_id AS source_url,
   CASE lang WHEN 'en' THEN 'approved' WHEN 'de' THEN 'review' WHEN 'fr' THEN 'draft' ELSE CASE WHEN n_chars > 400 THEN 'draft' END END AS status,
   'when: ' || source AS use_when, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS digest FROM documents"""


@query("publish_and_read", "S1 S8 U2", SQL_CORPUS)
def publish_and_read(t: Tables) -> DataFrame:
    """Publish every document with its header, read the published table back, parse it."""
    path = shared_dir(t.spark, "corpus")
    K.write_corpus(spread(v_publish(t)), path)
    back = t.spark.read.parquet(path).select("key", "raw")
    return K.parse_corpus(back).select("key", "title", "category", "last_edited", "source_url", "status", "use_when", F.md5("text").alias("digest"))


@query(
    "page_props", "S2",
    """SELECT doc_id, CASE WHEN n_chars < 100 THEN 'Untitled' ELSE source || ' ' || lang END AS title, CASE WHEN lang = 'en' THEN 'Live' WHEN lang = 'de' THEN 'Draft' ELSE '' END AS status,
       CASE WHEN lang = 'fr' THEN '' ELSE 'SOP|' || lang END AS categories, CASE WHEN lang = 'es' THEN '' ELSE 'use ' || source END AS use_when, 'Ana, ' || source AS owner FROM documents""",
)
def page_props(t: Tables) -> DataFrame:
    lang = F.col("lang")
    named = lambda c: F.struct(c.alias("name"))
    run = lambda c: F.struct(c.alias("plain_text"))
    props = F.to_json(
        F.struct(
            F.struct(F.lit("title").alias("type"), F.when(F.col("n_chars") >= 100, F.array(run(F.col("source")), run(F.lit(" \n ")), run(lang))).otherwise(F.array(run(F.lit(" ")))).alias("title")).alias("Name"),
            F.struct(
                F.when(lang == "de", "status").otherwise("select").alias("type"),
                F.when(lang == "en", named(F.lit("Live"))).alias("select"), F.when(lang == "de", named(F.lit("Draft"))).alias("status"),
            ).alias("Status"),
            F.struct(F.when(lang == "fr", "rich_text").otherwise("multi_select").alias("type"), F.when(lang != "fr", F.array(named(F.lit("SOP")), named(lang))).alias("multi_select")).alias("Category"),
            F.struct(F.when(lang == "es", "select").otherwise("rich_text").alias("type"), F.array(run(F.lit("use ")), run(F.col("source"))).alias("rich_text")).alias("Use When (Agent Hints)"),
            F.struct(F.lit("people").alias("type"), F.array(named(F.lit("Ana")), named(F.lit("")), named(F.col("source"))).alias("people")).alias("Owner"),
        )
    )
    flat = K.read_page_props(t.documents.select("doc_id", props.alias("props")), "props")
    return flat.select("doc_id", "title", "status", F.array_join("categories", "|").alias("categories"), "use_when", "owner")
