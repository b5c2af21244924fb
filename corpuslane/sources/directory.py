"""Team directory: versioned snapshots, directory pages and the department map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslane.functions import lexicon as L
from corpuslane.functions.text import WS_RUN, bind, chain, col, lines_of, sub, unroll, ws_trim
from corpuslane.session import deal

VERSION = 1
SCOPE = "array<struct<topic:string,targets:array<string>>>"
PERSON = (
    "struct<name:string,title:string,department:string,routingDepartments:array<string>,priority:string,"
    f"owns:array<string>,systems:array<string>,outOfScope:{SCOPE},backup:string,escalatesTo:string,"
    "reach:struct<slack:string,dashboard:string>,routeWhen:string>"
)


def read_directory(snapshots: DataFrame, raw: str) -> DataFrame:
    """People of every good snapshot, one row each.

    A snapshot counts only when its version matches and every person is valid; one bad person
    drops the whole snapshot. Persons are checked inside the snapshot row.
    """
    parsed = snapshots.withColumns(
        {
            "_d": F.from_json(col(raw), f"struct<version:int,generated_at:string,personas:array<{PERSON}>>"),
        }
    )
    full = lambda a: F.forall(a, lambda x: x.isNotNull())

    def valid(p: Column) -> Column:
        text = [p["title"], p["department"], p["backup"], p["escalatesTo"], p["reach"]["slack"], p["reach"]["dashboard"]]
        ok = (ws_trim(p["name"]) != "") & p["priority"].isin(*L.PRIORITIES)
        for c in text:
            ok = ok & c.isNotNull()
        for a in (p["routingDepartments"], p["owns"], p["systems"]):
            ok = ok & a.isNotNull() & full(a)
        scope = F.forall(p["outOfScope"], lambda s: s["topic"].isNotNull() & s["targets"].isNotNull() & full(s["targets"]))
        return F.coalesce(ok & p["outOfScope"].isNotNull() & scope, F.lit(False))

    good = parsed.filter(
        (F.col("_d.version") == VERSION) & F.col("_d.generated_at").isNotNull() & F.col("_d.personas").isNotNull()
        & F.forall("_d.personas", valid)
    )
    keep = [c for c in snapshots.columns if c != raw]
    return unroll(good, [*keep, F.col("_d.generated_at").alias("generated_at")], "_d.personas", "ord", "p").select(
        *keep, "generated_at", "ord", "p.*"
    ).withColumn("routeWhen", F.coalesce("routeWhen", F.lit("")))


# --- directory pages -------------------------------------------------------------

HEADING = r"^#{1,6}\s+(.+?)\s*$"
BULLET = r"^\s*[-*+]\s+(.+)$"


def clean(c: Column | str) -> Column:
    return ws_trim(chain(c, (r"\*\*|__", ""), (WS_RUN, " ")))


def _headings(lines: Column) -> Column:
    """Name of each line that is a heading, null for other lines."""
    return F.transform(
        lines,
        lambda x: F.when(x.rlike(HEADING), F.lower(sub(clean(F.regexp_extract(x, HEADING, 1)), r"\s*\([^)]*\)$"))),
    )


def _section_lines(lines: Column, names: Column, key: str) -> Column:
    """Lines under the last heading named ``key``, up to the next heading."""
    at = F.array_max(F.filter(F.transform(names, lambda x, i: F.when(x == key, i)), lambda i: i.isNotNull()))

    def slice_at(at: Column) -> Column:
        rest = F.slice(names, at + 2, F.greatest(F.size(names) - at - 1, F.lit(0)))
        until = F.array_min(F.filter(F.transform(rest, lambda x, i: F.when(x.isNotNull(), i)), lambda i: i.isNotNull()))
        return F.when(at.isNotNull(), F.slice(lines, at + 2, F.coalesce(until, F.size(rest))))

    return bind(at, slice_at)


def section_bullets(lines: Column, names: Column, key: str) -> Column:
    bullets = F.transform(
        F.filter(_section_lines(lines, names, key), lambda x: x.rlike(BULLET)), lambda x: clean(F.regexp_extract(x, BULLET, 1))
    )
    return F.coalesce(F.filter(bullets, lambda x: x != ""), F.array().cast("array<string>"))


def section_text(lines: Column, names: Column, key: str) -> Column:
    said = F.transform(
        _section_lines(lines, names, key),
        lambda x: clean(F.when(x.rlike(BULLET), F.regexp_extract(x, BULLET, 1)).otherwise(x)),
    )
    return F.coalesce(F.array_join(F.filter(said, lambda x: x != ""), " "), F.lit(""))


def labelled(bullets: Column, label: str) -> Column:
    """Value of the first ``label: value`` bullet, or empty."""
    pattern = r"^([^:]{1,40}):\s*(.*)$"
    hit = F.get(
        F.filter(bullets, lambda b: b.rlike(pattern) & (F.lower(ws_trim(F.regexp_extract(b, pattern, 1))) == label)), F.lit(0)
    )
    return F.coalesce(ws_trim(F.regexp_extract(hit, pattern, 2)), F.lit(""))


ROUTE = r"(?i)^(.*?)\s*\((?:route to|→|->)\s*([^)]*)\)\s*\.?$"


def scope_entry(line: Column) -> Column:
    """Topic and targets of an out-of-scope line; commentary after a spaced dash is dropped."""

    def entry(text: Column) -> Column:
        target = F.split(F.regexp_extract(text, ROUTE, 2), r"\s+[—–-]\s+", 2)[0]
        parts = F.filter(F.transform(F.split(target, r"\s*/\s*|\s+or\s+", -1), ws_trim), lambda x: x != "")
        routed = text.rlike(ROUTE)
        return F.struct(
            F.when(routed, ws_trim(F.regexp_extract(text, ROUTE, 1))).otherwise(text).alias("topic"),
            F.when(routed, parts).otherwise(F.array().cast("array<string>")).alias("targets"),
        )

    return bind(clean(line), entry)


def parse_directory(pages: DataFrame) -> DataFrame:
    """Directory pages to structured people; page properties fill what the text leaves out.

    ``pages(person, name, title, department, routing_departments, priority, backup, slack_channel,
    route_when, markdown)``. Everything is read inside the page row: a page is cut into lines and its headings are
    named once, each section is read once. Pages are short and cost more to read than to move, so they are dealt out
    by number; by bytes a large directory would be the work of a task or two.
    """
    lines, names = F.col("_lines"), F.col("_names")
    bullets = lambda key: section_bullets(lines, names, key)
    dash = F.col("_prop").rlike(rf"(?i)^dashboard{L.W1}")
    either = lambda a, b: F.when(F.col(a) != "", F.col(a)).otherwise(b)
    level = F.regexp_extract(ws_trim("priority"), rf"(?i)^P([0-2]){L.W1}", 1)
    cut = deal(pages, "person").withColumn("_lines", F.split("markdown", r"\r?\n", -1)).drop("markdown").withColumn("_names", _headings(lines))
    read = cut.withColumns({
        "_prop": clean("slack_channel"), "_owns": bullets("core responsibilities"), "_domain": bullets("domain expertise"),
        "_scope": bullets("out of scope"), "_escalation": bullets("escalation path"), "_reach": bullets("how to reach"),
        "_route": section_text(lines, names, "route when"),
    }).drop("_lines", "_names").withColumns({
        "_backup": labelled(F.col("_escalation"), "backup"), "_slack": labelled(F.col("_reach"), "slack"), "_dashboard": labelled(F.col("_reach"), "dashboard"),
    })
    systems = F.filter(F.transform(F.split(labelled(F.col("_domain"), "systems"), ","), ws_trim), lambda s: s != "")
    return read.select(
        "person", clean("name").alias("name"), clean("title").alias("title"), clean("department").alias("department"),
        F.filter(F.transform("routing_departments", clean), lambda d: d != "").alias("routing_departments"),
        F.when(level != "", F.concat(F.lit("P"), level)).otherwise("P2").alias("priority"),
        F.col("_owns").alias("owns"), systems.alias("systems"), F.transform("_scope", scope_entry).alias("out_of_scope"),
        either("_backup", clean("backup")).alias("backup"), labelled(F.col("_escalation"), "escalates to").alias("escalates_to"),
        either("_slack", F.when(dash, "").otherwise(F.col("_prop"))).alias("slack"),
        either("_dashboard", F.when(dash, sub("_prop", r"(?i)^dashboard\s*")).otherwise("")).alias("dashboard"),
        either("_route", clean("route_when")).alias("route_when"),
    )


def parse_departments(pages: DataFrame, text: str) -> DataFrame:
    """Department map to (name, aliases, exclusions), only under the ``Departments`` heading.

    Blocks between second-level headings are cut inside the row; a block's lines are folded
    with the label in force, so only bullets under "Do not send them:" become exclusions.
    """
    body = F.split(F.concat(F.lit("\n"), F.regexp_replace(col(text), "\r\n", "\n")), r"\n(?=#\s)", -1)
    inside = F.filter(body, lambda b: F.lower(clean(F.regexp_extract(b, r"^\n?#\s+([^\n]+?)\s*(?:\n|$)", 1))) == "departments")
    blocks = F.flatten(F.transform(inside, lambda b: F.slice(F.split(b, r"\n(?=##\s)", -1), F.lit(2), F.size(F.split(b, r"\n(?=##\s)", -1)))))
    keep = [c for c in pages.columns if c != text]
    depts = unroll(pages, keep, blocks, "ord", "block")

    excl = r"^(.*?)\s*\(([^()]*)\)\s*\.?$"
    seed = F.struct(
        F.lit(False).alias("on"), F.array().cast("array<string>").alias("aliases"),
        F.array().cast("array<struct<topic:string,target:string>>").alias("exclusions"),
    )

    def step(acc, line):
        said = clean(F.regexp_extract(line, BULLET, 1))
        item = F.struct(
            F.when(said.rlike(excl), ws_trim(F.regexp_extract(said, excl, 1))).otherwise(said).alias("topic"),
            F.when(said.rlike(excl), ws_trim(F.regexp_extract(said, excl, 2))).otherwise("").alias("target"),
        )
        plain = clean(line)
        also = F.regexp_extract(plain, r"(?i)^Also called:\s*(.+?)(?:\s+·|$)", 1)
        names = F.filter(F.transform(F.split(also, ","), ws_trim), lambda a: a != "")
        return (
            F.when(
                line.rlike(BULLET),
                F.struct(acc["on"], acc["aliases"], F.when(acc["on"] & (said != ""), F.concat(acc["exclusions"], F.array(item))).otherwise(acc["exclusions"]).alias("exclusions")),
            )
            .when(also != "", F.struct(acc["on"], names.alias("aliases"), acc["exclusions"]))
            .when(
                plain.rlike(r"^[^:]{1,40}:"),
                F.struct(plain.rlike(r"(?i)^do not send them:").alias("on"), acc["aliases"], acc["exclusions"]),
            )
            .otherwise(acc)
        )

    folded = F.aggregate(F.slice(lines_of("block"), 2, F.size(lines_of("block"))), seed, step)
    return depts.withColumn("_f", folded).select(
        *keep, F.col("ord").cast("bigint").alias("ord"),
        clean(F.regexp_extract("block", r"^##\s+([^\n]+?)\s*(?:\n|$)", 1)).alias("department"),
        "_f.aliases", "_f.exclusions",
    )
