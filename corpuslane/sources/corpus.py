"""Corpus objects, page properties and manifests as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslane.functions.text import chain, col, find, primary_category, status_kind, sub, ws_trim

# --- corpus objects -----------------------------------------------------------

HEADER = r"\A---[ \t]*\r?\n([\s\S]*?)(?:\r?\n---(?:[ \t]*\r?\n|[ \t]*\z|\z)|\z)"


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """One row per markdown object under ``path``: its key and whole text."""
    return spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("key"), F.col("value").alias("raw")
    )


def _raw_field(header: Column, name: str) -> Column:
    """Text after ``name:`` with its continuation lines; null when the key is absent."""
    pattern = rf"(?m)^{name}:((?:[ \t][^\n]*)?(?:\n(?:[ \t]+[^\n]*|- [^\n]*))*)"
    return F.when(header.rlike(pattern), ws_trim(find(header, pattern, 1)))


def _unquote(v: Column) -> Column:
    double = chain(F.substr(v, F.lit(2), F.char_length(v) - 2), (r'\\"', '"'), (r"\\n", "\n"), (r"\\\\", r"\\"))
    single = sub(F.substr(v, F.lit(2), F.char_length(v) - 2), "''", "'")
    folded = chain(v, (r"^>-?[ \t]*\n", ""), (r"(?m)^[ \t]+", ""), (r"\n", " "))
    literal = chain(v, (r"^\|-?[ \t]*\n", ""), (r"(?m)^[ \t]+", ""))
    plain = ws_trim(chain(v, (r"[ \t]+#[^\n]*", ""), (r"[ \t]*\n[ \t]*", " ")))
    return (
        F.when(v.rlike(r'^"[\s\S]*"$'), double).when(v.rlike(r"^'[\s\S]*'$"), single)
        .when(v.rlike(r"^>-?[ \t]*\n"), folded).when(v.rlike(r"^\|-?[ \t]*\n"), literal)
        .when(plain.rlike(r"^(?:|null|~|true|false|[-+]?[0-9]+(?:\.[0-9]+)?)$"), None).otherwise(plain)
    )


def _first_string(raw: Column) -> Column:
    """The value, or the first usable string of a list written in flow or block style."""
    flow = F.transform(F.split(find(raw, r"^\[([\s\S]*)\]$", 1), r",\s*", -1), lambda x: _unquote(ws_trim(x)))
    block = F.transform(F.split(sub(raw, r"^- "), r"\n[ \t]*- ", -1), lambda x: _unquote(ws_trim(x)))
    usable = lambda a: F.get(F.filter(a, lambda x: x.isNotNull() & (x != "")), F.lit(0))
    return F.when(raw.rlike(r"^\["), usable(flow)).when(raw.rlike(r"^- "), usable(block)).otherwise(
        F.nullif(_unquote(raw), F.lit(""))
    )


def _broken(raw: Column) -> Column:
    """A value the header format cannot close: such an object falls back as a whole."""
    return F.coalesce(
        (raw.rlike(r"^\[") & ~raw.rlike(r"\]$")) | (raw.rlike('^"') & ~raw.rlike(r'^"[\s\S]*"$')) | (raw.rlike("^'") & ~raw.rlike(r"^'[\s\S]*'$")),
        F.lit(False),
    )


def parse_corpus(objects: DataFrame) -> DataFrame:
    """Metadata and body of each object; every field falls back on its own, nothing throws."""
    names = ["title", "category", "last_edited", "source_url", "status", "use_when"]
    split = objects.withColumns({"_has": F.col("raw").rlike(HEADER), "_head": find("raw", HEADER, 1)}).withColumn(
        "_body", F.when(F.col("_has"), sub("raw", HEADER)).otherwise(F.col("raw"))
    )
    raw = split.withColumns({f"_{n}": _raw_field(F.col("_head"), n) for n in names})
    bad = raw.withColumn("_bad", F.coalesce(*[F.when(_broken(F.col(f"_{n}")), True) for n in names], F.lit(False)))
    ok = ~F.col("_bad")
    title = F.when(ok, F.nullif(sub(_unquote(F.col("_title")), r"\x{00A0}", " "), F.lit("")))
    edited = _unquote(F.col("_last_edited"))
    iso = F.when(
        F.col("_last_edited").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"),
        F.date_format(F.try_to_timestamp(edited), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
    ).otherwise(edited)
    return bad.select(
        "key",
        F.coalesce(title, "key").alias("title"),
        F.coalesce(F.when(ok, _first_string(F.col("_category"))), F.lit("uncategorized")).alias("category"),
        F.when(ok, iso).alias("last_edited"),
        F.when(ok, _unquote(F.col("_source_url"))).alias("source_url"),
        F.when(ok, status_kind(_first_string(F.col("_status")), F.coalesce(title, "key"))).alias("status"),
        F.when(ok, _first_string(F.col("_use_when"))).alias("use_when"),
        F.when(ok, ws_trim("_body")).otherwise("").alias("text"),
    )


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return parse_corpus(read_objects(spark, path))


def _quote(c: Column) -> Column:
    return F.concat(F.lit('"'), chain(c, (r"\\", r"\\\\"), ('"', r'\\"'), ("\n", r"\\n")), F.lit('"'))


def render_corpus(pages: DataFrame) -> DataFrame:
    """Header with ordered keys (owner only when set) and body, ready to publish.

    ``pages(key, title, source_url, categories, status, use_when, owner, last_edited, body)``.
    """
    cats = F.transform("categories", lambda c: F.concat(F.lit("  - "), _quote(c)))
    header = F.concat_ws(
        "\n",
        F.concat(F.lit("title: "), _quote(F.col("title"))),
        F.concat(F.lit("source_url: "), _quote(F.col("source_url"))),
        F.concat(F.lit("category: "), _quote(primary_category("categories"))),
        F.when(F.size("categories") > 0, F.concat(F.lit("categories:\n"), F.array_join(cats, "\n"))).otherwise("categories: []"),
        F.concat(F.lit("status: "), _quote(F.coalesce("status", F.lit("")))),
        F.concat(F.lit("use_when: "), _quote(F.coalesce("use_when", F.lit("")))),
        F.when(F.coalesce("owner", F.lit("")) != "", F.concat(F.lit("owner: "), _quote(F.col("owner")))),
        F.concat(F.lit("last_edited: '"), "last_edited", F.lit("'")),
    )
    raw = F.concat(F.lit("---\n"), header, F.lit("\n---\n\n"), ws_trim("body"), F.lit("\n"))
    return pages.select("key", primary_category("categories").alias("category"), raw.alias("raw"))


def write_corpus(pages: DataFrame, path: str) -> None:
    """Publish rendered objects as Parquet partitioned by category."""
    render_corpus(pages).write.mode("overwrite").partitionBy("category").parquet(path)


# --- hub page properties --------------------------------------------------------

_RUNS = "array<struct<plain_text:string>>"
_NAMED = "struct<name:string>"
PROPS = (
    f"map<string,struct<type:string,title:{_RUNS},rich_text:{_RUNS},select:{_NAMED},status:{_NAMED},"
    f"multi_select:array<{_NAMED}>,people:array<{_NAMED}>>>"
)
UNTITLED = "Untitled"


def _plain(runs: Column) -> Column:
    joined = F.array_join(F.transform(runs, lambda r: F.coalesce(r["plain_text"], F.lit(""))), "")
    return F.coalesce(ws_trim(sub(joined, r"\s+", " ")), F.lit(""))


def read_page_props(df: DataFrame, props: str) -> DataFrame:
    """Typed hub properties as flat columns; a property of the wrong type reads as empty."""
    p = F.from_json(col(props), PROPS)
    d = df.withColumn("_p", p)
    at = lambda n: F.try_element_at("_p", F.lit(n))
    typed = lambda n, t: F.when(at(n)["type"] == t, at(n)[t])
    choice = lambda n: F.coalesce(typed(n, "select")["name"], typed(n, "status")["name"], F.lit(""))
    titles = F.filter(
        F.transform(F.filter(F.map_values("_p"), lambda v: v["type"] == "title"), lambda v: _plain(v["title"])), lambda s: s != ""
    )
    tags = F.coalesce(
        F.transform(typed("Category", "multi_select"), lambda s: s["name"]),
        F.when(typed("Category", "select").isNotNull(), F.array(typed("Category", "select")["name"])),
        F.array().cast("array<string>"),
    )
    owners = F.filter(F.transform(typed("Owner", "people"), lambda u: u["name"]), lambda n: n.isNotNull() & (n != ""))
    return d.withColumns(
        {
            "title": F.coalesce(F.get(titles, F.lit(0)), F.lit(UNTITLED)),
            "status": choice("Status"),
            "categories": tags,
            "use_when": _plain(typed("Use When (Agent Hints)", "rich_text")),
            "owner": F.coalesce(F.array_join(owners, ", "), F.lit("")),
        }
    ).drop("_p")


# --- manifests -------------------------------------------------------------------

FILES = "key string, title string, source_id string, last_edited string"
STALE = "key string, since string, source_id string"


def write_manifest(files: DataFrame, stale: DataFrame, path: str) -> None:
    """A snapshot is two JSON datasets, so no single task holds the whole manifest."""
    files.write.mode("overwrite").json(f"{path}/files")
    stale.write.mode("overwrite").json(f"{path}/stale")


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(FILES).json(f"{path}/files"), spark.read.schema(STALE).json(f"{path}/stale")


def read_manifest_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A manifest published as one JSON document."""
    doc = spark.read.schema(
        f"exported_at string, files array<struct<key:string,title:string,notion_id:string,last_edited:string>>, "
        "stale array<struct<key:string,since:string,notion_id:string>>"
    ).option("multiLine", True).json(path)
    files = doc.select(F.explode("files").alias("f")).select("f.key", "f.title", F.col("f.notion_id").alias("source_id"), "f.last_edited")
    stale = doc.select(F.explode("stale").alias("s")).select("s.key", "s.since", F.col("s.notion_id").alias("source_id"))
    return files, stale


__all__ = [
    "read_objects", "parse_corpus", "read_corpus", "render_corpus", "write_corpus", "read_page_props",
    "write_manifest", "read_manifest", "read_manifest_file",
]
