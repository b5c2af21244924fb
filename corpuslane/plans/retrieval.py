"""Registered queries: hybrid retrieval, ranking and context packing.

Queries are the ``benchmark`` items, each with the embedding of the same id; chunks are the
``embeddings`` rows (vector leg) and whole ``documents`` (keyword leg). The hits of the ranking
queries are windows that together cover every document; a window takes one of the embeddings in turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslane.functions import lexicon as L
from corpuslane.functions import text as X
from corpuslane.operators import context as C
from corpuslane.operators import retrieve as R
from corpuslane.plans.registry import query
from corpuslane.session import Tables, materialize, spread


def v_queries(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def v_query_vectors(t: Tables) -> DataFrame:
    return (
        t.embeddings.select("vec_id", "embedding")
        .join(t.benchmark.select("item_id"), F.col("vec_id") == F.col("item_id"), "left_semi")
        .select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    )


def v_chunk_vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))


def v_chunks(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("chunk_id"), "text")


def v_vector(t: Tables) -> DataFrame:
    return R.vector_leg(v_query_vectors(t), v_chunk_vectors(t))


#: A window's chunk id is its document's id times this, plus its number: no text has as many windows.
WINDOW_IDS = 1 << 20


def v_embedded(t: Tables, at: DataFrame) -> DataFrame:
    """``at(file, part)`` with the embedding that the window takes in turn."""
    n = t.embeddings.agg(F.count("*").alias("n"))  # one row
    return at.join(F.broadcast(n)).withColumn("vec_id", F.pmod(F.col("file") + 7 * F.col("part"), F.col("n"))).drop("n")


def v_windows(t: Tables) -> DataFrame:
    """Every window of every document; only lengths are read from the texts."""
    docs = t.documents.select(F.col("doc_id").alias("file"), "text")
    return v_embedded(t, X.unroll(docs, ["file"], F.sequence(F.lit(0), C.last_window("text")), "_i", "part"))


def v_hits(t: Tables) -> DataFrame:
    vectors = t.embeddings.select("vec_id", F.col("embedding").alias("vector"))
    chunk = (F.col("file") * WINDOW_IDS + F.col("part")).alias("chunk_id")
    found = R.vector_leg(v_query_vectors(t), v_windows(t).join(vectors, "vec_id").select(chunk, "vector"))
    placed = found.withColumns({"file": F.expr(f"chunk_id DIV {WINDOW_IDS}"), "part": F.col("chunk_id") % WINDOW_IDS})
    return v_embedded(t, placed).select(
        "query_id", F.col("rank").alias("pos"), "chunk_id", "file", "part", "vec_id", "score",
        F.round(1 - F.col("rank") / 100.0, 4).alias("rerank"),
    )


def v_meta(t: Tables) -> DataFrame:
    """Metadata exists only for labelled documents, so some hits fall back to defaults."""
    return t.documents.join(t.labels.select("doc_id"), "doc_id", "left_semi").select(
        F.col("doc_id").alias("file"), F.col("source").alias("title"), F.col("lang").alias("category")
    )


SQL_VECTOR = """
qv AS (SELECT b.item_id AS query_id, CAST(e.embedding AS DOUBLE[]) AS qvec
       FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id),
scored AS (SELECT query_id, vec_id AS chunk_id,
                  round(list_cosine_similarity(qvec, CAST(embedding AS DOUBLE[])), 6) AS score
           FROM qv, embeddings),
vec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
                       FROM scored WHERE score >= 0.01) WHERE rank <= 50)
"""

SQL_HITS = f"""{SQL_VECTOR},
windows AS (SELECT file, part, file * {WINDOW_IDS} + part AS chunk_id, (file + 7 * part) % (SELECT count(*) FROM embeddings) AS vec_id FROM (
    SELECT doc_id AS file, unnest(range(CAST(CASE WHEN length(text) <= 2000 THEN 0 ELSE ceil((length(text) - 2000) / 1800.0) END AS BIGINT) + 1)) AS part FROM documents)),
hits AS (SELECT query_id, pos, chunk_id, file, part, vec_id, score, round(1 - pos / 100.0, 4) AS rerank FROM (
    SELECT query_id, w.*, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, w.chunk_id) AS pos
    FROM scored JOIN windows w ON w.vec_id = scored.chunk_id WHERE score >= 0.01) WHERE pos <= 50)
"""


def sql_keyword(mode: str) -> str:
    keep = "WHERE hit = n_words" if mode == "and" else ""
    return f"""
terms AS (SELECT item_id AS query_id, unnest(w) AS word, len(w) AS n_words FROM (
            SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS w
            FROM benchmark)),
toks AS (SELECT doc_id AS chunk_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
stats AS (SELECT count(*) AS n_chunks, avg(len(w)) AS avg_len FROM toks),
postings AS (SELECT chunk_id, len, word, count(*) AS tf FROM (SELECT chunk_id, len(w) AS len, unnest(w) AS word FROM toks)
             WHERE word IN (SELECT word FROM terms) GROUP BY 1, 2, 3),
idf AS (SELECT word, ln(1 + (max(n_chunks) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM postings, stats GROUP BY word),
kscored AS (SELECT query_id, chunk_id, n_words, count(*) AS hit,
                   round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score
            FROM postings JOIN idf USING (word) JOIN terms USING (word), stats GROUP BY 1, 2, 3),
kw AS (SELECT query_id, chunk_id, score, rank FROM (
         SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM kscored {keep}) WHERE rank <= 50)
"""


@query("vector_leg", "J23", f"WITH {SQL_VECTOR} SELECT query_id, chunk_id, score, rank FROM vec")
def vector_leg(t: Tables) -> DataFrame:
    return v_vector(t)


@query("keyword_leg_or", "J24", f"WITH {sql_keyword('or')} SELECT * FROM kw")
def keyword_leg_or(t: Tables) -> DataFrame:
    return R.keyword_leg(v_queries(t), spread(v_chunks(t)), "or")


@query("keyword_leg_and", "J24", f"WITH {sql_keyword('and')} SELECT * FROM kw")
def keyword_leg_and(t: Tables) -> DataFrame:
    return R.keyword_leg(v_queries(t), spread(v_chunks(t)), "and")


SQL_RRF = f"""{SQL_VECTOR}, {sql_keyword('or')},
fused AS (SELECT query_id, chunk_id, v.rank AS vector_rank, k.rank AS keyword_rank,
                 round(coalesce(1.0 / (60 + v.rank), 0.0) + coalesce(1.0 / (60 + k.rank), 0.0), 9) AS score
          FROM vec v FULL OUTER JOIN kw k USING (query_id, chunk_id)),
hybrid AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fused) WHERE rank <= 50)
"""


@query("rrf_fusion", "J25", f"WITH {SQL_RRF} SELECT query_id, chunk_id, vector_rank, keyword_rank, CAST(score AS DOUBLE) AS score, rank FROM hybrid")
def rrf_fusion(t: Tables) -> DataFrame:
    return R.rrf(v_vector(t), R.keyword_leg(v_queries(t), spread(v_chunks(t)), "or"))


@query(
    "vector_fallback", "J26",
    f"""WITH {SQL_VECTOR}, {sql_keyword('and')},
    legs AS (SELECT item_id AS query_id, e.label < 5 AS ran FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id),
    hyb AS (SELECT query_id, chunk_id, CAST(score AS DOUBLE) score, rank FROM (
              SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
                SELECT query_id, chunk_id, round(coalesce(1.0 / (60 + v.rank), 0.0) + coalesce(1.0 / (60 + k.rank), 0.0), 9) AS score
                FROM (SELECT * FROM vec WHERE query_id IN (SELECT query_id FROM legs WHERE ran)) v
                FULL OUTER JOIN kw k USING (query_id, chunk_id))) WHERE rank <= 50)
    SELECT query_id, chunk_id, score, rank, false AS fallback FROM hyb
    UNION ALL
    SELECT query_id, chunk_id, score, rank, true FROM vec
    WHERE query_id IN (SELECT query_id FROM legs WHERE NOT coalesce(ran, false)) AND query_id NOT IN (SELECT query_id FROM hyb)""",
)
def vector_fallback(t: Tables) -> DataFrame:
    """The vector leg ran only for queries of labels under 5; the rest may need the fallback."""
    vec = v_vector(t)
    labels = t.embeddings.select(F.col("vec_id").alias("query_id"), "label")
    legs = v_queries(t).join(labels, "query_id", "left").select(
        "query_id",
        F.when(F.col("label") < 5, F.array(F.lit("vector"), F.lit("keyword"))).otherwise(F.array(F.lit("keyword"))).alias("legs"),
    )
    ran = legs.filter(F.array_contains("legs", "vector")).select("query_id")
    kw = R.keyword_leg(v_queries(t), spread(v_chunks(t)), "and")
    hybrid = R.rrf(vec.join(ran, "query_id", "left_semi"), kw)
    return R.with_fallback(legs, hybrid, vec)


@query(
    "best_by_file", "A1",
    f"WITH {SQL_HITS} SELECT query_id, file, max(coalesce(score, 0)) AS best, min(pos) AS first_pos FROM hits WHERE file IS NOT NULL GROUP BY 1, 2",
)
def best_by_file(t: Tables) -> DataFrame:
    return R.best_by_file(v_hits(t))


SQL_RANKED = f"""{SQL_HITS},
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, first_pos) AS rank FROM (
    SELECT query_id, file, max(score) AS best, min(pos) AS first_pos FROM hits GROUP BY 1, 2)) WHERE rank <= 5)
"""


@query("rank_files", "W1 T1", f"WITH {SQL_RANKED} SELECT query_id, file, best, first_pos, rank FROM ranked")
def rank_files(t: Tables) -> DataFrame:
    return R.rank_files(v_hits(t))


@query(
    "attach_meta", "J3",
    f"""WITH {SQL_HITS}, meta AS (SELECT doc_id AS file, source AS title, lang AS category FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))
    SELECT query_id, pos, file, coalesce(title, CAST(file AS VARCHAR)) AS title, coalesce(category, 'uncategorized') AS category
    FROM hits LEFT JOIN meta USING (file)""",
)
def attach_meta(t: Tables) -> DataFrame:
    return R.attach_meta(v_hits(t), v_meta(t)).select("query_id", "pos", "file", "title", "category")


@query("distinct_keys", "X5", f"WITH {SQL_HITS} SELECT DISTINCT file FROM hits")
def distinct_keys(t: Tables) -> DataFrame:
    return v_hits(t).select("file").distinct()


SQL_PACKED = rf"""{SQL_RANKED},
meta AS (SELECT doc_id AS file, source AS title, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body,
                CASE WHEN lang = 'de' THEN 'draft' END AS status, text FROM documents),
whole AS (SELECT * FROM (SELECT query_id, file, title, 'full' AS kind, body AS text, length(body) AS chars, status = 'draft' AS draft, rank AS ord, 0 AS phase,
                 sum(length(body)) OVER (PARTITION BY query_id ORDER BY rank) AS used
          FROM ranked JOIN meta USING (file) WHERE rank <= 3 AND body <> '') WHERE used <= 26000),
chunk AS (SELECT h.query_id, h.file, coalesce(m.title, 'Untitled SOP') AS title, 'chunk' AS kind,
                 regexp_replace(substr(m.text, 1 + 1800 * CAST(h.part AS BIGINT), 2000), '^\s+|\s+$', '', 'g') AS text, m.status = 'draft' AS draft, h.pos AS ord, 1 AS phase
          FROM hits h LEFT JOIN meta m USING (file)
          WHERE NOT EXISTS (SELECT 1 FROM whole w WHERE w.query_id = h.query_id AND w.file = h.file)),
both_phases AS (SELECT query_id, file, title, kind, text, chars, draft, ord, phase FROM whole
         UNION ALL SELECT query_id, file, title, kind, text, length(text), draft, ord, phase FROM chunk WHERE text <> ''),
packed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY phase, ord) AS label FROM (
    SELECT *, sum(chars) OVER (PARTITION BY query_id ORDER BY phase, ord) AS used FROM both_phases) WHERE used <= 26000)
"""


def v_packed(t: Tables) -> DataFrame:
    hits = materialize(v_hits(t), "hits")
    meta = t.documents.select(
        F.col("doc_id").alias("file"), F.col("source").alias("title"), F.col("text").alias("body"),
        F.when(F.col("lang") == "de", "draft").alias("status"),
    )
    # the bounded hit list meets the documents first, so only windows that were hit are cut
    texts = t.documents.select(F.col("doc_id").alias("file"), "text")
    chunk_hits = hits.join(texts, "file").withColumn(
        "chunk_text", C.window_at("text", "part")
    ).drop("text")
    return C.pack_context(R.rank_files(hits), chunk_hits, meta)


@query(
    "pack_context", "W2",
    f"WITH {SQL_PACKED} SELECT query_id, label, file, title, kind, CAST(chars AS BIGINT) AS chars, coalesce(draft, false) AS draft, CAST(used AS BIGINT) AS used FROM packed",
)
def pack_context(t: Tables) -> DataFrame:
    return v_packed(t).select("query_id", "label", "file", "title", "kind", "chars", F.coalesce("draft", F.lit(False)).alias("draft"), "used")


@query(
    "ordered_assembly", "A19 W17",
    f"""WITH e AS (SELECT l_orderkey, l_linenumber, '[' || l_linenumber || '] ' || l_partkey || ' ' || l_returnflag AS line FROM lineitem),
    c AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, line ROWS UNBOUNDED PRECEDING) - 1 AS used FROM e)
    SELECT l_orderkey, string_agg(line, chr(10) ORDER BY l_linenumber, line) AS block FROM c WHERE used <= {L.OWNER_BLOCK_CHARS} GROUP BY l_orderkey""",
)
def ordered_assembly(t: Tables) -> DataFrame:
    """Labelled lines of each order joined in label order up to the block ceiling."""
    line = F.concat(
        F.lit("["), F.col("l_linenumber"), F.lit("] "), F.col("l_partkey"), F.lit(" "), F.col("l_returnflag")
    )
    entries = t.lineitem.select("l_orderkey", "l_linenumber", line.alias("line"))
    kept = C.cut_to_ceiling(entries, ["l_orderkey"], ["l_linenumber", "line"], "line", L.OWNER_BLOCK_CHARS, sep=1)
    return kept.groupBy("l_orderkey").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n"
        ).alias("block")
    )


@query(
    "passage_budget", "W3",
    """SELECT conv_id, greatest(0, least(26000, CAST(floor(66500.0 - system_chars - history_chars - message_chars - 1500) AS BIGINT))) AS budget FROM (
         SELECT c.conv_id, sum(CASE WHEN role = 'system' THEN length(text) ELSE 0 END) AS system_chars,
                sum(CASE WHEN role <> 'system' AND turn <> last_turn THEN length(text) ELSE 0 END) AS history_chars,
                sum(CASE WHEN turn = last_turn THEN length(text) ELSE 0 END) AS message_chars
         FROM conversations c JOIN (SELECT conv_id, max(CASE WHEN role = 'user' THEN turn END) AS last_turn FROM conversations GROUP BY 1) l
           ON c.conv_id = l.conv_id WHERE last_turn IS NOT NULL GROUP BY c.conv_id)""",
)
def passage_budget(t: Tables) -> DataFrame:
    n = F.char_length("text")
    user = F.col("role") == "user"
    sums = t.conversations.groupBy("conv_id").agg(
        F.sum(F.when(F.col("role") == "system", n).otherwise(0)).alias("system_chars"),
        F.sum(F.when(F.col("role") != "system", n).otherwise(0)).alias("talk_chars"),
        F.max_by(F.when(user, n), F.when(user, F.col("turn"))).alias("message_chars"),
    ).filter(F.col("message_chars").isNotNull())
    return C.passage_budget(
        sums.withColumn("history_chars", F.col("talk_chars") - F.col("message_chars")).withColumn("rules_chars", F.lit(L.RULE_BLOCK_CHARS))
    ).select("conv_id", "budget")


@query(
    "retrieval_stats", "A13",
    rf"""WITH {SQL_HITS},
    files AS (SELECT query_id, file, max(score) AS best, min(pos) AS first_pos, arg_min(rerank, -score * 1000000000 + pos) AS rerank FROM hits GROUP BY 1, 2),
    top AS (SELECT query_id, string_agg(CAST(file AS VARCHAR), ',' ORDER BY r) AS top_files, max(CASE WHEN r = 1 THEN rerank END) AS top_rerank FROM (
              SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, first_pos) AS r FROM files) WHERE r <= 5 GROUP BY 1),
    q AS (SELECT item_id AS query_id, text AS query, text || CASE WHEN a OR b THEN E'\n\n' ELSE '' END
             || CASE WHEN a THEN 'referral acceptance criteria inbound referral records request' ELSE '' END
             || CASE WHEN a AND b THEN ' ' ELSE '' END || CASE WHEN b THEN 'pre-visit checklist chart prep before visit' ELSE '' END AS search_query
          FROM (SELECT *, regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])referrals?([^A-Za-z0-9_]|$)') AS a,
                       regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])pre[-\s]?visit([^A-Za-z0-9_]|$)') AS b FROM benchmark))
    SELECT q.query_id, coalesce(c.chunks, 0) AS chunks, coalesce(f.files, 0) AS files, coalesce(top_files, '') AS top_files, CAST(top_rerank AS DOUBLE) AS top_rerank,
           trim(search_query, E' \n') <> trim(query, E' \n') AS rewritten, length(query) AS qlen, length(search_query) AS sqlen
    FROM q LEFT JOIN (SELECT query_id, count(*) AS chunks FROM hits GROUP BY 1) c USING (query_id)
    LEFT JOIN (SELECT query_id, count(*) AS files FROM files GROUP BY 1) f USING (query_id) LEFT JOIN top USING (query_id)""",
)
def retrieval_stats(t: Tables) -> DataFrame:
    q = v_queries(t).withColumn("search_query", R.expand_query("query"))
    return R.retrieval_stats(v_hits(t), q)


@query(
    "strip_header", "P16",
    r"""WITH c AS (SELECT doc_id, CASE WHEN lang = 'en' THEN '---' || chr(10) || 'title: ' || source || chr(10) || 'status: Draft' || chr(10) || '---' || chr(10) || text
                                   ELSE '---' || chr(10) || text END AS raw FROM documents)
    SELECT doc_id, length(b) AS chars, md5(b) AS digest FROM (SELECT doc_id, regexp_replace(raw, '^---\r?\ntitle:[\s\S]*?\r?\n---(?:\r?\n|$)', '') AS b FROM c)""",
)
def strip_header(t: Tables) -> DataFrame:
    """Documents with a header (or, outside English, only a divider line) lose just the header."""
    raw = F.when(
        F.col("lang") == "en",
        F.concat(F.lit("---\ntitle: "), "source", F.lit("\nstatus: Draft\n---\n"), "text"),
    ).otherwise(F.concat(F.lit("---\n"), "text"))
    return t.documents.withColumn("body", R.strip_header(raw)).select(
        "doc_id", F.char_length("body").cast("bigint").alias("chars"), F.md5("body").alias("digest")
    )


@query(
    "normalize_settings", "P18",
    """WITH raw AS (SELECT event_id,
        CASE event_type WHEN 'view' THEN ' ON ' WHEN 'click' THEN 'false' WHEN 'error' THEN '0' WHEN 'signup' THEN 'maybe' END AS rewrite_raw,
        CASE event_type WHEN 'error' THEN 'many' WHEN 'purchase' THEN '' ELSE CAST(value AS VARCHAR) END AS max_raw,
        CASE event_type WHEN 'view' THEN 'OR ' WHEN 'click' THEN 'and' WHEN 'error' THEN 'xor' END AS keyword_raw,
        CASE WHEN value > 100 THEN 'concise' ELSE 'long' END AS length_raw, CASE WHEN value < 10 THEN 'experienced' END AS familiarity_raw FROM events)
    SELECT event_id, CASE WHEN lower(trim(coalesce(rewrite_raw, ''))) IN ('on', 'true', '1') THEN true
                          WHEN lower(trim(coalesce(rewrite_raw, ''))) IN ('off', 'false', '0') THEN false ELSE true END AS rewrite,
           CASE WHEN TRY_CAST(trim(max_raw) AS DOUBLE) IS NULL THEN 15 ELSE CAST(least(50, greatest(1, floor(TRY_CAST(max_raw AS DOUBLE) + 0.5))) AS BIGINT) END AS max_results,
           CASE WHEN lower(trim(coalesce(keyword_raw, ''))) IN ('or', 'and') THEN lower(trim(keyword_raw)) ELSE 'and' END AS keyword_mode,
           CASE WHEN length_raw = 'concise' THEN 'concise' ELSE 'detailed' END AS length_style,
           CASE WHEN familiarity_raw = 'experienced' THEN 'experienced' ELSE 'new' END AS familiarity FROM raw""",
)
def normalize_settings(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    raw = t.events.select(
        "event_id",
        F.when(kind == "view", " ON ").when(kind == "click", "false").when(kind == "error", "0").when(kind == "signup", "maybe").alias("rewrite_raw"),
        F.when(kind == "error", "many").when(kind == "purchase", "").otherwise(F.col("value").cast("string")).alias("max_raw"),
        F.when(kind == "view", "OR ").when(kind == "click", "and").when(kind == "error", "xor").alias("keyword_raw"),
        F.when(F.col("value") > 100, "concise").otherwise("long").alias("length_raw"),
        F.when(F.col("value") < 10, "experienced").alias("familiarity_raw"),
    )
    return R.normalize_settings(raw).select("event_id", "rewrite", "max_results", "keyword_mode", "length_style", "familiarity")


@query(
    "expand_queries", "P13",
    r"""WITH q AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'Referrals: ' || text WHEN lang = 'fr' THEN text || ' pre visit referral' ELSE text END AS query FROM documents),
    f AS (SELECT *, regexp_matches(query, '(?i)(^|[^A-Za-z0-9_])referrals?([^A-Za-z0-9_]|$)') AS a,
                 regexp_matches(query, '(?i)(^|[^A-Za-z0-9_])pre[-\s]?visit([^A-Za-z0-9_]|$)') AS b FROM q)
    SELECT doc_id, CAST(a AS BIGINT) + CAST(b AS BIGINT) AS hints,
           md5(query || CASE WHEN a OR b THEN chr(10) || chr(10) ELSE '' END || CASE WHEN a THEN 'referral acceptance criteria inbound referral records request' ELSE '' END
             || CASE WHEN a AND b THEN ' ' ELSE '' END || CASE WHEN b THEN 'pre-visit checklist chart prep before visit' ELSE '' END) AS digest FROM f""",
)
def expand_queries(t: Tables) -> DataFrame:
    q = F.when(F.col("lang") == "en", F.concat(F.lit("Referrals: "), "text")).when(
        F.col("lang") == "fr", F.concat("text", F.lit(" pre visit referral"))
    ).otherwise(F.col("text"))
    hints = sum((q.rlike(p).cast("bigint") for p, _ in L.QUERY_HINTS), F.lit(0).cast("bigint"))
    return t.documents.select("doc_id", hints.alias("hints"), F.md5(R.expand_query(q)).alias("digest"))
