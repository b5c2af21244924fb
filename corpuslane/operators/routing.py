"""Routing consistency: phrases, topic overlap, conflicts, gaps and dangling references.

Tables: ``people(person, name, title, department, backup, routing_departments, owns,
out_of_scope)``, ``departments(department, aliases, exclusions)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslane.functions import lexicon as L
from corpuslane.functions.text import WS_RUN, bigrams, chain, col, sub, topic_words, unroll, ws_trim
from corpuslane.operators.screen import redact_names, staff_names
from corpuslane.session import materialize


def _words(c: Column | str) -> Column:
    return F.array_remove(F.split(F.lower(col(c)), r"\P{Alnum}+", -1), "")


def department_phrases(departments: DataFrame) -> DataFrame:
    """(department, phrase) by full name, bare name and every alias."""
    names = F.concat(F.array("department", sub("department", r"\s*\([^)]*\)\s*$")), "aliases")
    p = unroll(departments, ["department"], names, "_i", "name").select("department", F.array_join(_words("name"), " ").alias("phrase"))
    return p.filter(F.col("phrase") != "").distinct()


def phrases_named(texts: DataFrame, key: str, text: str, phrases: DataFrame, name: str) -> DataFrame:
    """Which phrases each text holds as contiguous words: met on the first two words, then verified."""
    p = phrases.withColumn("anchor", F.array_join(F.slice(F.split("phrase", " "), 1, 2), " "))
    t = texts.select(key, _words(text).alias("_w")).withColumn("_runs", F.array_distinct(F.concat(F.col("_w"), bigrams("_w"))))
    padded = F.concat(F.lit(" "), F.array_join("_w", " "), F.lit(" ")).alias("_padded")
    return (
        unroll(t, [key, padded], "_runs", "_i", "anchor").drop("_i")
        .join(p, "anchor")
        .filter(F.contains("_padded", F.concat(F.lit(" "), F.col("phrase"), F.lit(" "))))
        .select(key, name).distinct()
    )


def departments_named(texts: DataFrame, key: str, text: str, departments: DataFrame) -> DataFrame:
    return phrases_named(texts, key, text, department_phrases(departments), "department")


def topic_overlap(a: DataFrame, b: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Pairs of topics about the same work: two shared words, or one when a side has at most two.

    ``a(a_id, a_topic)``, ``b(b_id, b_topic)``, both optionally keyed by ``on``. Long topics meet
    on all but their last word in a fixed order, enough to catch any two shared words; pairs
    with a short side meet on every word. A pair is kept only at its first shared meeting word.
    """
    on = on or []

    def worded(df: DataFrame, side: str) -> DataFrame:
        order = lambda w: F.array_sort(F.transform(w, lambda x: F.struct((-F.char_length(x)).alias("n"), x.alias("x"))))
        return df.withColumn(f"_{side}", F.transform(order(topic_words(f"{side}_topic")), lambda s: s["x"])).filter(
            F.size(f"_{side}") > 0
        )

    aw, bw = worded(a, "a"), worded(b, "b")
    few = lambda s: F.size(f"_{s}") <= 2

    def meet(left: DataFrame, right: DataFrame, trim: bool, least: int) -> DataFrame:
        probe = lambda s: F.slice(F.col(f"_{s}"), F.lit(1), F.size(f"_{s}") - 1) if trim else F.col(f"_{s}")
        le = unroll(left.withColumn("_pa", probe("a")), [*left.columns, "_pa"], "_pa", "_i", "word").drop("_i")
        ri = unroll(right.withColumn("_pb", probe("b")), [*right.columns, "_pb"], "_pb", "_i", "word").drop("_i")
        met = le.join(ri, [*on, "word"])
        shared = F.size(F.array_intersect("_a", "_b"))
        return met.filter((F.col("word") == F.get(F.array_intersect("_pa", "_pb"), F.lit(0))) & (shared >= least)).withColumn(
            "shared", shared.cast("bigint")
        )

    out = [
        meet(aw.filter(~few("a")), bw.filter(~few("b")), True, 2),
        meet(aw.filter(few("a")), bw, False, 1),
        meet(aw.filter(~few("a")), bw.filter(few("b")), False, 1),
    ]
    keep = [c for c in [*on, *a.columns, *b.columns]]
    keep = list(dict.fromkeys(keep))
    return out[0].select(*keep, "shared").unionByName(out[1].select(*keep, "shared")).unionByName(out[2].select(*keep, "shared"))


def shared_topics(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """``topic_overlap`` where many rows of ``a`` say the same: each distinct topic of a key is compared once."""
    said = a.select(*on, F.col("a_topic").alias("a_id"), "a_topic").distinct()
    return a.join(materialize(topic_overlap(said, b, on), "shared-topics").drop("a_id"), [*on, "a_topic"])


# --- people references --------------------------------------------------------------


def matched(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join with columns of a written table that grows with the directory. Its file is a small part of its rows' size, so that
    the optimizer would take the rows for few and send them through the driver."""
    return left.join(right.hint("merge"), on, how)


def _bare(c: Column | str) -> Column:
    return F.lower(ws_trim(chain(c, (r"\([^)]*\)", " "), (WS_RUN, " "))))


def person_keys(people: DataFrame) -> DataFrame:
    """(key, person): full name, doctor spelling and first name. Departments are separate."""
    full = _bare("name")
    first = F.split(full, " ")
    keys = F.array_distinct(F.array_compact(F.array(
        full, sub(full, r"^dr\.\s*", "dr "), F.when((F.size(first) > 1) & ~first[0].rlike(r"^dr\.?$"), first[0])
    )))
    return people.select("person", F.explode(keys).alias("key"))


def named_people(refs: DataFrame, text: str, keys: DataFrame) -> DataFrame:
    """References joined to every person they name, as ``named``."""
    key = sub(_bare(text), r"^dr\.\s*", "dr ")
    return matched(refs.withColumn("key", key), keys.withColumnRenamed("person", "named"), "key").drop("key")


def expand_backups(people: DataFrame) -> DataFrame:
    """Short backup names become full names when exactly one other person matches; notes stay."""
    pattern = r"^([^()]*?)\s*(\([^()]*\))?$"
    refs = people.select("person", ws_trim("backup").alias("raw")).filter(F.col("raw").rlike(pattern)).select(
        "person", F.regexp_extract("raw", pattern, 1).alias("short"), F.regexp_extract("raw", pattern, 2).alias("note")
    ).filter(F.col("short") != "")
    one = (
        named_people(refs, "short", person_keys(people)).groupBy("person", "short", "note")
        .agg(F.count("*").alias("n"), F.min("named").alias("named"))
        .filter((F.col("n") == 1) & (F.col("named") != F.col("person")))
    )
    full = people.select(F.col("person").alias("named"), ws_trim("name").alias("full"))
    expanded = matched(one, full, "named").filter(F.col("full") != F.col("short")).select(
        "person", F.when(F.col("note") != "", F.concat_ws(" ", "full", "note")).otherwise(F.col("full")).alias("expanded")
    )
    return people.join(expanded, "person", "left").withColumn("backup", F.coalesce("expanded", "backup")).drop("expanded")


def _targets(people: DataFrame) -> DataFrame:
    """(person, entry, topic, target) for every out-of-scope target."""
    entries = unroll(people, ["person"], "out_of_scope", "entry", "s").select("person", "entry", "s.topic", F.col("s.targets").alias("targets"))
    return unroll(entries, ["person", "entry", "topic"], "targets", "t_no", "target")


def _exclusions(departments: DataFrame) -> DataFrame:
    return unroll(departments, ["department"], "exclusions", "excl", "e").select(
        "department", "excl", F.col("e.topic").alias("excl_topic"), F.col("e.target").alias("excl_target")
    )


def _own(people: DataFrame) -> DataFrame:
    return people.select("person", F.explode("routing_departments").alias("department"))


def missing_fields(people: DataFrame) -> DataFrame:
    missing = F.array_compact(F.array(
        F.when(ws_trim("title") == "", "Title"), F.when(ws_trim("department") == "", "Department"),
        F.when(F.size("owns") == 0, "Core Responsibilities"),
    ))
    return people.select("person", F.array_join(missing, ", ").alias("m")).filter(F.col("m") != "").select(
        "person", F.lit("error").alias("level"), F.concat(F.lit("left out: no "), "m").alias("message")
    )


def dangling_refs(people: DataFrame, departments: DataFrame) -> DataFrame:
    """Backups, targets and departments that resolve to nothing or to the same person."""
    keys = person_keys(people)
    backups = people.select("person", ws_trim("backup").alias("backup")).filter(F.col("backup") != "")
    b_named = named_people(backups, "backup", keys)
    b_self = b_named.filter(F.col("named") == F.col("person")).select("person").distinct()
    b_dept = departments_named(backups, "person", "backup", departments).select("person").distinct()
    b_lost = backups.join(b_named.select("person").distinct(), "person", "left_anti").join(b_dept, "person", "left_anti").select("person")
    ref = lambda df, msg: df.select("person", F.lit("reference").alias("level"), msg.alias("message"))
    t = _targets(people)
    ek = ["person", "entry"]
    t_named = named_people(t, "target", keys)
    t_self = t_named.filter(F.col("named") == F.col("person")).select(*ek, "topic").distinct()
    # many lines send to the same place: each distinct target is searched once
    d_named = departments_named(t.select("target").distinct(), "target", "target", departments).select("target").distinct()
    t_dept = t.join(d_named, "target", "left_semi").select(*ek).distinct()
    t_lost = matched(t.select(*ek, "topic").distinct().join(t_named.select(*ek).distinct(), ek, "left_anti"), t_dept, ek, "left_anti")
    own_lost = _own(people).join(departments.select("department"), "department", "left_anti")
    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    return (
        ref(b_self, F.lit("Backup is the person themself"))
        .unionByName(ref(b_lost, F.lit("Backup matches no one in the directory and no department")))
        .unionByName(ref(t_self, F.concat(F.lit("Out of Scope "), quoted("topic"), F.lit(" routes back to the same person"))))
        .unionByName(ref(t_lost, F.concat(F.lit("Out of Scope "), quoted("topic"), F.lit(" routes to no one in the directory and no department"))))
        .unionByName(ref(own_lost, F.concat(F.lit("Routing Department "), quoted("department"), F.lit(" is not a department on the routing map"))))
    )


def routing_conflicts(people: DataFrame, departments: DataFrame) -> DataFrame:
    """Owning work an own department excludes, or sending work to someone whose department excludes it."""
    excl = _exclusions(departments).select(
        "department", F.struct("excl", "excl_topic", "excl_target").alias("b_id"), F.col("excl_topic").alias("b_topic")
    )
    owned = matched(unroll(people, ["person"], "owns", "n", "a_topic"), _own(people), "person").select(
        "department", F.struct("person", "n").alias("a_id"), "a_topic"
    )
    said = F.concat(
        F.col("department"), F.lit(' excludes "'), F.col("b_topic"), F.lit('"'),
        F.when(F.col("b_id.excl_target") != "", F.concat(F.lit(" ("), F.col("b_id.excl_target"), F.lit(")"))).otherwise(""),
    )
    conflict = lambda df, lead: df.select(
        F.col("a_id.person").alias("person"), F.lit("conflict").alias("level"), F.concat(lead, said).alias("message")
    )
    owns = conflict(shared_topics(owned, excl, ["department"]), F.concat(F.lit('owns "'), F.col("a_topic"), F.lit('", but ')))
    sent = named_people(_targets(people), "target", person_keys(people))
    row = F.concat(
        F.coalesce(F.nullif(ws_trim("title"), F.lit("")), F.lit("untitled row")), F.lit(" ("),
        F.coalesce(F.nullif(ws_trim("department"), F.lit("")), F.lit("no department")), F.lit(")"),
    )
    labels = people.select(F.col("person").alias("named"), row.alias("row"))
    to_dept = matched(matched(sent, _own(people).withColumnRenamed("person", "named"), "named"), labels, "named").select(
        "department", F.struct("person", "entry", "t_no", "row").alias("a_id"), F.col("topic").alias("a_topic")
    )
    sends = conflict(
        shared_topics(to_dept, excl, ["department"]),
        F.concat(F.lit('sends "'), F.col("a_topic"), F.lit('" to '), F.col("a_id.row"), F.lit(", but ")),
    )
    return owns.unionByName(sends)


def routing_gaps(people: DataFrame, departments: DataFrame) -> DataFrame:
    """Exclusions of an own department with an outside target that no redirect covers by topic or target."""
    own = _own(people)
    excl = _exclusions(departments)
    text = F.when(F.col("excl_target") != "", F.col("excl_target")).otherwise(F.col("excl_topic"))
    named = departments_named(
        excl.select(F.struct("department", "excl").alias("id"), text.alias("t")), "id", "t", departments
    ).select(F.col("id.department").alias("department"), "id.excl", F.col("department").alias("target_dept"))
    mine = own.join(excl, "department")
    pk = ["person", "department", "excl"]
    outside = matched(
        mine.join(named, ["department", "excl"]), own.withColumnRenamed("department", "target_dept"), ["person", "target_dept"], "left_anti"
    ).select(*pk, "excl_topic", "target_dept").distinct()
    scope = unroll(people, ["person"], "out_of_scope", "entry", "s").select("person", F.col("s.topic").alias("a_topic"))
    # a person's exclusions are those of the own departments, so topics meet by department
    by_topic = shared_topics(
        matched(scope, own, "person"), excl.select("department", F.struct("department", "excl").alias("b_id"), F.col("excl_topic").alias("b_topic")), ["department"],
    ).select("person", "b_id.department", "b_id.excl").distinct()
    t = _targets(people)
    to_dept = departments_named(t.withColumn("id", F.struct("person", "entry", "t_no")), "id", "target", departments).select(
        "id.person", F.col("department").alias("target_dept")
    )
    to_person = matched(
        named_people(t, "target", person_keys(people)), own.select(F.col("person").alias("named"), F.col("department").alias("target_dept")), "named"
    ).select("person", "target_dept")
    by_target = outside.join(to_dept.unionByName(to_person).distinct(), ["person", "target_dept"], "left_semi").select(*pk)
    open_ = outside.join(by_topic.unionByName(by_target).distinct(), pk, "left_anti")
    listed = open_.groupBy(*pk, "excl_topic").agg(F.array_join(F.array_sort(F.collect_set("target_dept")), " or ").alias("targets"))
    return listed.select(
        "person", F.lit("gap").alias("level"),
        F.concat("department", F.lit(' excludes "'), "excl_topic", F.lit('" ('), "targets", F.lit("), but Out of Scope never sends it on")).alias("message"),
    )


def routing_notes(people: DataFrame) -> DataFrame:
    return people.filter(F.size("routing_departments") == 0).select(
        "person", F.lit("note").alias("level"), F.lit("no Routing Department, so the routing-map cross-check is skipped").alias("message")
    )


def check_directory(people: DataFrame, departments: DataFrame) -> DataFrame:
    """All issues, by severity, each with its ``row`` named by title and department; no message holds a name."""
    # written kind by kind: the driver holds the stages and small tables of one kind at a time
    kinds = [missing_fields(people).unionByName(routing_notes(people)), dangling_refs(people, departments)]
    kinds = [materialize(k, "issues") for k in kinds]
    kinds += [materialize(check(people, departments), "issues") for check in (routing_conflicts, routing_gaps)]
    issues = reduce(DataFrame.unionByName, kinds)
    named = lambda c, none: F.coalesce(F.nullif(ws_trim(c), F.lit("")), F.lit(none))
    row = F.concat(named("title", "untitled row"), F.lit(" ("), named("department", "no department"), F.lit(")"))
    # many people have the same issue: each message is searched for names once
    distinct = materialize(issues.select("message", F.col("message").alias("safe")).distinct(), "said")
    said = materialize(redact_names(distinct, materialize(staff_names(people), "staff"), "safe"), "messages")
    placed = matched(matched(issues, said, "message"), people.select("person", row.alias("row")), "person")
    return placed.select("person", "level", F.col("safe").alias("message"), "row").withColumn("severity", level_rank("level"))


def level_rank(level: Column | str) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in L.LEVELS]), col(level)).cast("bigint")


def issue_summary(issues: DataFrame, people: DataFrame, rendered_chars: DataFrame, ceiling: int = L.DIRECTORY_CHARS) -> DataFrame:
    """Counts by level, usable people, and the reason an upload is blocked, if any.

    ``rendered_chars`` is one row with ``chars``: the rendered size of the usable people.
    """
    counts = issues.agg(*[F.count_if(F.col("level") == lv).alias(f"{lv}s") for lv in L.LEVELS])
    excluded = issues.filter(F.col("level") == "error").select("person").distinct()
    usable = matched(people, excluded, "person", "left_anti").agg(F.count("*").alias("usable"))
    blocked = F.when(F.col("usable") == 0, "no usable Live rows").when(
        F.col("chars") > ceiling,
        F.concat(F.lit("the directory renders to "), F.col("chars").cast("string"), F.lit(f" characters, over the {ceiling} ceiling; shorten Core Responsibilities or Out of Scope lines")),
    )
    one = lambda df: F.broadcast(df)  # noqa: E731  three one-row aggregates
    return counts.join(one(usable)).join(one(rendered_chars)).withColumn("blocked", blocked)
