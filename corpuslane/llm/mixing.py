"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Every source gets a target in words. A document of a source is taken target / source size times
on average: the whole part for all, the fraction by rounding. Rounding is pivotal: two
documents with fractional copies meet, words move from one to the other, by chance in either
direction with the mean kept, until one of them is integral; the other one goes on. Words taken
from the source stay the same in every meeting, so in the end they miss the target by less than
one document. Documents meet in hash groups of ``fan``, longest first, so that what is left over
tends to be short; each group leaves at most one
fractional document, and those meet again a level higher, in a tree over the groups of a source.
Chance is a hash of the two documents, so reruns agree.

Targets: sources by code point, null last, take the weights in turn; ``share`` times all words
is dealt by weight, no source beyond ``cap`` times its own words, the excess going to the
others by weight until none is above.

Defined results: a text without words (null, empty) has size 0, takes nothing, and keeps one
copy in ``apply_mix``. Rows equal in id and text are one item: they share one decision. Null ids and null
sources are values like others. An empty table gives no rows. Ties cannot change a total: order is by
hash, then id. The list of sources is ranked in one task, so a source is meant to be one of a
vocabulary (thousands), not one per document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslane.llm.shared import row_key, row_of, stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
FAN = 256
SALTS = 32
NEAR = 1e-9

#: One meeting: ``a.r`` is the fractional document so far, ``e`` the next one.
MEET = """
aggregate(items,
  named_struct('done', CAST(array() AS ARRAY<STRUCT<id: {id}, rk: BIGINT, up: BOOLEAN>>), 'r', CAST(NULL AS {item})),
  (a, e) -> CASE
    WHEN a.r IS NULL THEN named_struct('done', a.done, 'r', e)
    WHEN a.r.x <= {near} OR a.r.x >= 1 - {near}
      THEN named_struct('done', array_append(a.done, named_struct('id', a.r.id, 'rk', a.r.rk, 'up', a.r.x > 0.5)), 'r', e)
    ELSE transform(transform(
      array(named_struct(
        'fill', (1 - a.r.x) * a.r.size, 'give', e.x * e.size,
        'drain', a.r.x * a.r.size, 'room', (1 - e.x) * e.size,
        'u', shiftrightunsigned(xxhash64({seed}, a.r.rk, e.rk), 11) / 9007199254740992D)),
      m -> CASE
        WHEN m.u * (least(m.fill, m.give) + least(m.drain, m.room)) < least(m.drain, m.room) THEN CASE
          WHEN m.fill <= m.give THEN named_struct('gone', named_struct('id', a.r.id, 'rk', a.r.rk, 'up', true),
            'r', named_struct('o', e.o, 'h', e.h, 'id', e.id, 'rk', e.rk, 'x', e.x - m.fill / e.size, 'size', e.size))
          ELSE named_struct('gone', named_struct('id', e.id, 'rk', e.rk, 'up', false),
            'r', named_struct('o', a.r.o, 'h', a.r.h, 'id', a.r.id, 'rk', a.r.rk, 'x', a.r.x + m.give / a.r.size, 'size', a.r.size)) END
        ELSE CASE
          WHEN m.drain <= m.room THEN named_struct('gone', named_struct('id', a.r.id, 'rk', a.r.rk, 'up', false),
            'r', named_struct('o', e.o, 'h', e.h, 'id', e.id, 'rk', e.rk, 'x', e.x + m.drain / e.size, 'size', e.size))
          ELSE named_struct('gone', named_struct('id', e.id, 'rk', e.rk, 'up', true),
            'r', named_struct('o', a.r.o, 'h', a.r.h, 'id', a.r.id, 'rk', a.r.rk, 'x', a.r.x - m.room / a.r.size, 'size', a.r.size)) END
        END),
      g -> named_struct('done', array_append(a.done, g.gone), 'r', g.r))[0]
    END)
"""


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A non-null string that tells a null source from any value."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Target words of each source, from ``sizes`` (source, source_size).

    With sources by words per weight, those before some point are full and the rest get one
    common level times their weight; running sums find that point without a loop.
    """
    ranked = sizes.withColumn("_i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_i") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("_w", weight).withColumn("_cap", F.col("source_size").cast("double") * cap)
    every = Window.orderBy(F.col("_cap") / F.col("_w"), "_i")
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    words = F.sum("source_size").over(whole).cast("double") * share
    level = (words - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("_level", level)
    below = F.when(F.col("_cap") > F.col("_level") * F.col("_w"), F.struct(F.col("_cap") / F.col("_w"), "_i", "_level"))
    ranked = ranked.withColumn("_open", F.min(below).over(whole)["_level"])
    target = F.when(F.col("_open").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_open") * F.col("_w")))
    return ranked.select("source", "source_size", target.alias("target"))


def decide(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 23, fan: int = FAN, **shares) -> DataFrame:
    """(id, rk, size, source_size, target, copies), one row for each distinct id and text of a source."""
    key = row_key(F.col(doc_id), F.col(text), F.col(source))
    items = docs.select(F.col(doc_id).alias("id"), key.alias("rk"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    items = items.groupBy("id", "rk", "source").agg(F.first("size").alias("size"), F.count(F.lit(1)).alias("n"))
    items = stored(items.withColumn("h", F.xxhash64(F.lit(seed), "rk")), "mix-items")
    sizes = items.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count(F.lit(1)).alias("_items"))
    goals = targets(sizes.drop("_items"), **shares).join(sizes.select(F.col("source").alias("_s"), "_items"), F.col("source").eqNullSafe(F.col("_s")))
    goals = goals.select(source_key(F.col("source")).alias("sk"), "source_size", "target", F.ceil(F.col("_items") / fan).alias("groups"))
    goals = stored(goals, "mix-goals")
    # a source may hold a third of all rows, so its goal is met in SALTS places
    salted = goals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = items.withColumn("sk", source_key(F.col("source"))).withColumn("salt", F.pmod(F.shiftright("h", 20), F.lit(SALTS)).cast("int")).drop("source")
    rows = rows.join(salted, ["sk", "salt"]).drop("salt")
    # an item of several equal rows counts with all their words
    rows = rows.withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    rows = rows.withColumn("base", F.floor(F.col("ratio") + NEAR)).withColumn("x", F.col("ratio") - F.col("base"))
    ups = round_up(rows.where(f"size > 0 AND x > {NEAR}").withColumn("size", F.col("size") * F.col("n")), seed, fan)
    ups = ups.select(F.col("id").alias("_id"), F.col("rk").alias("_rk"), "up")
    out = rows.join(ups, F.col("id").eqNullSafe(F.col("_id")) & (F.col("rk") == F.col("_rk")), "left")
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("base") + F.coalesce(F.col("up"), F.lit(False)).cast("int"))
    return out.select("id", "rk", "size", "source_size", "target", copies.cast("int").alias("copies"))


def round_up(rows: DataFrame, seed: int, fan: int) -> DataFrame:
    """(id, rk, up) for rows (sk, groups, h, id, rk, x, size) with 0 < x < 1: the reduction tree."""
    kind = dict(rows.dtypes)["id"]
    item = f"STRUCT<o: BIGINT, h: BIGINT, id: {kind}, rk: BIGINT, x: DOUBLE, size: BIGINT>"
    meet = F.expr(MEET.format(id=kind, item=item, near=NEAR, seed=seed))
    level = rows.select("sk", F.pmod(F.col("h"), F.col("groups")).alias("g"), F.struct((-F.col("size")).cast("long").alias("o"), "h", "id", "rk", "x", F.col("size").cast("long").alias("size")).alias("item"))
    most, done = rows.agg(F.max("groups")).first()[0] or 0, None
    while most:
        folded = level.groupBy("sk", "g").agg(F.array_sort(F.collect_list("item")).alias("items"))
        folded = stored(folded.select("sk", "g", meet.alias("f")).select("sk", "g", "f.done", "f.r"), "mix-level")
        out = folded.select(F.explode("done").alias("d")).select("d.id", "d.rk", "d.up")
        done = out if done is None else done.unionByName(out)
        level = folded.select("sk", F.expr(f"g DIV {fan}").alias("g"), F.col("r").alias("item"))
        most = 0 if most == 1 else -(-most // fan)
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "item.rk"), 11) / F.lit(float(1 << 53))
    up = (F.col("item.x") >= 1 - NEAR) | ((F.col("item.x") > NEAR) & (chance < F.col("item.x")))
    last = level.where("item IS NOT NULL").select("item.id", "item.rk", up.alias("up"))
    return last if done is None else done.unionByName(last)


def with_mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies``."""
    found = decide(docs, doc_id, text, source, **options).withColumnRenamed("id", "_id").withColumnRenamed("rk", "_rk")
    row = row_of(docs, "size", "source_size", "target", "copies")
    keyed = docs.select(row, F.col(doc_id).alias("_doc"), row_key(F.col(doc_id), F.col(text), F.col(source)).alias("_key"))
    out = keyed.join(found, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_rk")))
    return out.select("_row.*", "size", "source_size", "target", "copies")


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it."""
    mixed = with_mix(docs, **options)
    repeated = mixed.select(row_of(mixed, "size", "source_size", "target", "copies"), F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
    return repeated.select("_row.*")
