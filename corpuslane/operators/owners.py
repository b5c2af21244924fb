"""Owner matching: word weights, inverted index scores, redirects and picks.

Tables: ``people(person, name, title, priority, ord)``, ``lines(person, line_no, line, route)``,
``scope(person, entry, topic, targets)``, ``systems(person, system)``, ``messages(msg_id, text)``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslane.functions import lexicon as L
from corpuslane.functions.text import WS_RUN, bind, chain, col, one_line, owner_word_repeats, owner_word_rows, owner_words, sub, unroll, ws_trim
from corpuslane.functions.text import reach as reach_text
from corpuslane.session import materialize


def owner_lines(people: DataFrame) -> DataFrame:
    """Responsibility lines, then routing clauses split at semicolons, one row each."""
    owns = F.transform(F.col("owns"), lambda x: F.struct(x.alias("line"), F.lit(False).alias("route")))
    clauses = F.filter(F.transform(F.split("route_when", ";"), one_line), lambda x: x != "")
    routes = F.transform(clauses, lambda x: F.struct(x.alias("line"), F.lit(True).alias("route")))
    return unroll(people, ["person"], F.concat(owns, routes), "line_no", "l").select(
        "person", F.col("line_no").cast("bigint").alias("line_no"), "l.line", "l.route"
    )


def _words(df: DataFrame, keys: list[str], text: Column | str) -> DataFrame:
    return owner_word_rows(df, keys, text)


def entry_words(people: DataFrame, lines: DataFrame) -> DataFrame:
    """(person, word) per kind: responsibility words without the directory's names, and title words.

    A word in both counts twice, as it should.
    """
    names = _words(people, [], "name")
    owned = _words(lines, ["person"], "line").join(names, "word", "left_anti")
    titled = _words(people, ["person"], "title")
    return owned.withColumn("kind", F.lit("owns")).unionByName(titled.withColumn("kind", F.lit("title")))


def word_weights(entries: DataFrame, systems: DataFrame, n_people: DataFrame) -> DataFrame:
    """Inverse document frequency scaled so a word of a single entry weighs 1; product words x0.3.

    ``n_people`` is a one-row table with ``n``.
    """
    df = entries.select("person", "word").distinct().groupBy("word").agg(F.count("*").alias("df"))
    token = F.explode(F.filter(F.split("system", rf"{L.WS}+"), lambda x: x.rlike("^[A-Z]")))
    products = _words(systems.select(token.alias("token")), [], "token").withColumn("product", F.lit(True))
    weight = F.ln(1 + F.col("n") / (F.col("df") + 1)) / F.ln(1 + F.col("n") / 2)
    return (
        df.join(F.broadcast(n_people)).join(products, "word", "left")
        .select("word", "df", (weight * F.when(F.col("product"), L.PRODUCT_WEIGHT).otherwise(1.0)).alias("weight"))
    )


def message_words(messages: DataFrame) -> DataFrame:
    return _words(messages, ["msg_id"], "text")


def match_owners(mwords: DataFrame, entries: DataFrame, weights: DataFrame, floor: float | None = None) -> DataFrame:
    """Summed weight of the words a message shares with each entry; with a ``floor``, only sums that reach it.

    With a floor, a pair is opened at a message's heavy words only: its words fall by the most that any entry can
    give for them, and a word opens pairs as long as it and all lighter ones together reach the floor. Opened pairs
    are then summed over all words. Redirects add to sums below the floor, so they need all of them (no floor).
    """
    index = entries.groupBy("word", "person").agg(F.count("*").alias("times")).join(weights, "word")
    index = index.select("word", "person", (F.col("times") * F.col("weight")).alias("w"))
    if floor is None:
        return mwords.join(index, "word").groupBy("msg_id", "person").agg(F.sum("w").alias("score"))
    index = materialize(index, "owner-index")
    most = index.groupBy("word").agg(F.max("w").alias("most"))
    lightest = Window.partitionBy("msg_id").orderBy("most", "word").rowsBetween(Window.unboundedPreceding, 0)
    heard = materialize(mwords.join(most, "word").withColumn("reach", F.sum("most").over(lightest)), "heard")
    opened = heard.filter(F.col("reach") >= floor - 1e-6).select("msg_id", "word").join(index.select("word", "person"), "word")
    opened = opened.select("msg_id", "person").distinct()
    summed = opened.join(heard.select("msg_id", "word"), "msg_id").join(index, ["word", "person"])
    return summed.groupBy("msg_id", "person").agg(F.sum("w").alias("score")).filter(F.round("score", 9) >= floor)


def normalized_name(c: Column | str) -> Column:
    return sub(F.lower(ws_trim(chain(c, (r"\([^)]*\)", " "), (WS_RUN, " ")))), r"^dr\.\s*", "dr ")


def alias_table(people: DataFrame) -> DataFrame:
    """(key, person) an out-of-scope target can resolve to.

    A full or first name may name several people. A department key is added only where no
    person key took it, and belongs to the first person of that department.
    """
    full = normalized_name("name")
    first = F.split(full, " ")
    by_name = people.select(
        "person", "ord", F.explode(F.array_distinct(F.array_compact(F.array(
            F.when(full != "", full), F.when((F.size(first) > 1) & (first[0] != "dr"), first[0])
        )))).alias("key")
    )
    lower = lambda d: F.lower(ws_trim(d))
    dept_keys = F.flatten(F.transform(
        "routing_departments",
        lambda d: F.array(lower(d), normalized_name(d), ws_trim(F.regexp_extract(lower(d), r"\(([^)]*)\)\s*$", 1))),
    ))
    by_dept = (
        people.select("person", "ord", F.explode(F.array_distinct(dept_keys)).alias("key")).filter(F.col("key") != "")
        .join(by_name.select("key").distinct(), "key", "left_anti")
        .groupBy("key").agg(F.min_by("person", "ord").alias("person"))
    )
    return by_name.select("key", "person").unionByName(by_dept.select("key", "person")).distinct()


def resolve_targets(scope: DataFrame, aliases: DataFrame) -> DataFrame:
    """(person, entry, topic, target, target_person) for every target that names someone."""
    t = unroll(scope, ["person", "entry", "topic"], "targets", "_i", "target").drop("_i").withColumn("key", normalized_name("target"))
    named = aliases.withColumnRenamed("person", "target_person")
    return t.join(named, "key").drop("key")


def _topic_words(scope: DataFrame, weights: DataFrame) -> DataFrame:
    topic = scope.select("person", "entry", "topic", F.array_distinct(owner_words("topic")).alias("_w")).withColumn("size", F.size("_w"))
    return topic.select("person", "entry", "topic", "size", F.explode("_w").alias("word")).join(weights.select("word", "weight"), "word", "left")


def _scored(met: DataFrame) -> DataFrame:
    """Out-of-scope lines that share weighty words with a message, with the shared weight and the number of words."""
    return (
        met.groupBy("msg_id", "person", "entry", "topic", "size")
        .agg(F.sum("weight").alias("score"), F.count("*").alias("covered")).filter(F.col("score") > 0)
    )


def _penalty(scored: DataFrame) -> DataFrame:
    return scored.groupBy("msg_id", "person").agg(F.max(F.col("score") * F.col("covered") / F.col("size")).alias("penalty"))


def _pointed(resolved: DataFrame) -> DataFrame:
    return resolved.filter(F.col("target_person") != F.col("person")).select("person", "entry", "target_person").distinct()


def _gain(scored: DataFrame, pointed: DataFrame) -> DataFrame:
    return (
        scored.join(pointed, ["person", "entry"])
        .groupBy("msg_id", F.col("target_person").alias("person"))
        .agg(F.max("score").alias("gain"), F.max_by("topic", F.struct(F.round("score", 9), -F.col("person"), -F.col("entry"))).alias("redirect"))
    )


def redirect_effects(mwords: DataFrame, scope: DataFrame, resolved: DataFrame, weights: DataFrame) -> DataFrame:
    """Per (message, person): ``gain`` from lines pointing here, ``penalty`` for own lines.

    The penalty is the line's score scaled by how much of the topic the message covers.
    """
    scored = _scored(mwords.join(_topic_words(scope, weights), "word"))
    return _penalty(scored).join(_gain(scored, _pointed(resolved)), ["msg_id", "person"], "full_outer").select(
        "msg_id", "person", F.coalesce("gain", F.lit(0.0)).alias("gain"), F.coalesce("penalty", F.lit(0.0)).alias("penalty"), "redirect"
    )


def total_scores(base: DataFrame, effects: DataFrame) -> DataFrame:
    return base.join(effects, ["msg_id", "person"], "full_outer").select(
        "msg_id", "person",
        (F.coalesce("score", F.lit(0.0)) + F.coalesce("gain", F.lit(0.0)) - F.coalesce("penalty", F.lit(0.0))).alias("score"),
        "redirect",
    )


def redirected_scores(mwords: DataFrame, entries: DataFrame, weights: DataFrame, scope: DataFrame, resolved: DataFrame, floor: float = L.OWNER_MIN_SCORE) -> DataFrame:
    """``total_scores`` of the pairs that can reach ``floor``.

    A penalty only lowers, so a pair reaches it by its own words or with a gain. The first are opened by heavy words
    (``match_owners``), the others are the persons that lines point to; sums and penalties are taken for these pairs only.
    """
    key = ["msg_id", "person"]
    words = materialize(_topic_words(scope, weights), "topic-words")
    pointed = _pointed(resolved)
    pointing = words.join(pointed.select("person", "entry").distinct(), ["person", "entry"], "left_semi")
    gain = materialize(_gain(_scored(mwords.join(pointing, "word")), pointed), "gains")
    opened = materialize(match_owners(mwords, entries, weights, floor), "opened")
    index = entries.groupBy("word", "person").agg(F.count("*").alias("times")).join(weights, "word")
    lifted = gain.select(*key).join(opened, key, "left_anti")
    summed = (
        lifted.join(mwords, "msg_id").join(index.select("word", "person", (F.col("times") * F.col("weight")).alias("w")), ["word", "person"])
        .groupBy(*key).agg(F.sum("w").alias("score"))
    )
    base = opened.unionByName(lifted.join(summed, key, "left"))
    base = materialize(base.join(gain, key, "left").filter(F.round(F.coalesce("score", F.lit(0.0)) + F.coalesce("gain", F.lit(0.0)), 9) >= floor), "base")
    own = base.select(*key).join(words, "person").join(mwords, ["msg_id", "word"])
    return total_scores(base.select(*key, "score"), base.select(*key, "gain", "redirect").join(_penalty(_scored(own)), key, "left"))


def pick_owners(scores: DataFrame, people: DataFrame) -> DataFrame:
    """The top owner over the floor, and the second only when close enough behind."""
    rank = F.array_position(F.array(*[F.lit(p) for p in L.PRIORITIES]), F.col("priority"))
    w = Window.partitionBy("msg_id").orderBy(F.desc("_s"), "prank", "ord")
    over = scores.withColumn("_s", F.round("score", 9)).filter(F.col("_s") >= L.OWNER_MIN_SCORE)
    ranked = over.join(people.select("person", "ord", rank.alias("prank")), "person").withColumn(
        "place", F.row_number().over(w).cast("bigint")
    ).filter(F.col("place") <= L.OWNER_PICKS)
    top = F.max("_s").over(Window.partitionBy("msg_id"))
    return ranked.withColumn("top", top).filter(
        (F.col("place") == 1) | (F.col("_s") >= F.col("top") * L.OWNER_SECOND_RATIO)
    ).drop("_s", "top", "prank", "ord")


def _alike(rows: DataFrame, key: str, *about: Column | str) -> DataFrame:
    """``key, alike``: equal for keys with the same set of rows, which are distinct. Sets are met on two hashes of 64 bits and their size."""
    both = [F.hex(F.bit_xor(F.xxhash64(F.lit(seed), *about))) for seed in (1, 2)]
    return rows.groupBy(key).agg(F.concat_ws("-", F.count("*").cast("string"), *both).alias("alike"))


def redirected_picks(mwords: DataFrame, entries: DataFrame, weights: DataFrame, scope: DataFrame, resolved: DataFrame, people: DataFrame) -> DataFrame:
    """``pick_owners`` over ``redirected_scores``, with what says the same scored once.

    Messages with the same known words have the same scores, and so have persons with the same entry words, the same own lines and
    the same topics pointed at them in the same order. One message and one person stand for each such group. A message picks
    two owners at most, so the first two persons of a group, by priority and order, are all of it that can be picked.
    """
    known = weights.select("word").unionByName(scope.select("topic").distinct().select(F.explode(owner_words("topic")).alias("word"))).distinct()
    heard = mwords.join(known, "word", "left_semi")
    messages = materialize(_alike(heard, "msg_id", "word"), "messages-alike")
    asked = messages.groupBy("alike").agg(F.min("msg_id").alias("asked"))
    said = materialize(heard.join(asked.select(F.col("asked").alias("msg_id")), "msg_id", "left_semi"), "said")

    # each topic that points at a person, by the first line with it
    lines = scope.filter(F.col("topic").isNotNull()).select("person", "entry", "topic")
    sent = _pointed(resolved).join(lines, ["person", "entry"]).groupBy("target_person", "topic").agg(F.min(F.struct("person", "entry")).alias("line"))
    sent = materialize(sent.withColumn("nth", F.row_number().over(Window.partitionBy("target_person").orderBy("line"))), "sent")
    facts = (
        entries.groupBy("word", "person").agg(F.count("*").alias("n")).select("person", F.lit("word").alias("fact"), "word", "n")
        .unionByName(lines.select("person", F.lit("own").alias("fact"), F.col("topic").alias("word"), F.lit(0).cast("bigint").alias("n")).distinct())
        .unionByName(sent.select(F.col("target_person").alias("person"), F.lit("sent").alias("fact"), F.col("topic").alias("word"), F.col("nth").cast("bigint").alias("n")))
    )
    rank = F.array_position(F.array(*[F.lit(p) for p in L.PRIORITIES]), F.col("priority"))
    nth = Window.partitionBy("alike").orderBy(rank, "ord")
    owners = people.select("person", "priority", "ord").join(_alike(facts, "person", "fact", "word", "n"), "person")
    owners = owners.withColumn("nth", F.row_number().over(nth)).filter(F.col("nth") <= L.OWNER_PICKS).select("alike", "person", "nth")
    owners = materialize(owners, "owners-alike")
    first = owners.filter("nth = 1").select("person")
    pointing = sent.join(first.select(F.col("person").alias("target_person")), "target_person", "left_semi").select("line.person", "line.entry", "target_person")
    read = first.unionByName(pointing.select("person")).distinct()
    scores = redirected_scores(said, materialize(entries.join(first, "person", "left_semi"), "first-entries"), weights, scope.join(read, "person", "left_semi"), pointing)

    members = owners.select("alike", "person").join(owners.filter("nth = 1").select("alike", F.col("person").alias("first")), "alike").drop("alike")
    picks = materialize(pick_owners(scores.withColumnRenamed("person", "first").join(members, "first").drop("first"), people), "picks-alike")
    answered = picks.withColumnRenamed("msg_id", "asked").join(asked, "asked").drop("asked")
    return messages.join(answered, "alike").drop("alike")


NO_LINE = 2**63 - 1  # stands for a line without number
# a block of ``best_reason`` holds about so many characters of lines, or so many messages
REASON_BLOCK = {"chars": 32_000_000, "lines": 16_384, "messages": 16_384}


def _pack_lines(key: tuple, rows: pa.Table) -> pa.Table:
    """A block of lines as one row: its lines in order of preference, its words, and the lines of each word."""
    code, line, word = (rows[c].to_numpy() for c in ("code", "line_no", "word"))
    by = np.lexsort((line, code))
    new = np.r_[True, (np.diff(line[by]) != 0) | (np.diff(code[by]) != 0)]
    at = np.empty(len(by), np.int64)
    at[by] = np.cumsum(new) - 1
    words, which = np.unique(word, return_inverse=True)
    pairs = np.unique(which * int(new.sum()) + at)
    until = np.searchsorted(pairs, (np.arange(len(words)) + 1) * int(new.sum()))
    first = by[new]
    return pa.table({
        "person": pa.array([key[0].as_py()], rows["person"].type), "part": pa.array([key[1].as_py()], pa.int64()),
        "line_nos": pa.array([line[first]], pa.list_(pa.int64())), "codes": pa.array([code[first]], pa.list_(pa.int32())),
        "words": pa.array([words], pa.list_(pa.int64())), "until": pa.array([until.astype(np.int32)], pa.list_(pa.int32())),
        "at": pa.array([(pairs % int(new.sum())).astype(np.int32)], pa.list_(pa.int32())),
    })


def _best_lines(lines: pa.Table, messages: pa.Table) -> pa.Table:
    """Best line of a block of lines for each message of a block: weights are added word by word over the lines that hold it."""
    flat = lambda t, c: t[c].combine_chunks().flatten()
    out = {"msg_id": [], "at": [], "score": []}
    if lines.num_rows and messages.num_rows:
        words, until, at, codes, nos = (flat(lines, c).to_numpy() for c in ("words", "until", "at", "codes", "line_nos"))
        since, total = np.r_[0, until[:-1]], np.zeros(len(nos))
        heard, weights, size = flat(messages, "words"), flat(messages, "weights").to_numpy(), np.diff(messages["words"].combine_chunks().offsets.to_numpy())
        heard = heard.to_numpy()
        place = np.minimum(np.searchsorted(words, heard), len(words) - 1)
        known = words[place] == heard
        end = np.cumsum(size)
        for m in range(len(size)):
            total[:] = 0.0
            for j in range(end[m] - size[m], end[m]):
                if known[j]:
                    total[at[since[place[j]] : until[place[j]]]] += weights[j]
            top = total.max()
            if top > 0:
                near = np.flatnonzero(total >= top - 1e-8)
                score = np.round(total[near], 9)
                best = int(np.argmax(score))
                out["msg_id"].append(m), out["at"].append(near[best]), out["score"].append(score[best])
        return pa.table({
            "msg_id": messages["msg_id"].combine_chunks().take(pa.array(out["msg_id"], pa.int64())),
            "person": pa.array([lines["person"][0].as_py()] * len(out["at"]), lines["person"].type),
            "line_no": pa.array(nos[np.array(out["at"], np.int64)], pa.int64()), "code": pa.array(codes[np.array(out["at"], np.int64)], pa.int32()),
            "score": pa.array(out["score"], pa.float64()),
        })
    side = messages if messages.num_rows else lines
    return pa.table({"msg_id": pa.array([], messages["msg_id"].type), "person": pa.array([], side["person"].type), "line_no": pa.array([], pa.int64()), "code": pa.array([], pa.int32()), "score": pa.array([], pa.float64())})


def best_reason(mwords: DataFrame, picks: DataFrame, people: DataFrame, lines: DataFrame, weights: DataFrame) -> DataFrame:
    """Best matching line of each picked owner; a responsibility line wins a tie with a clause.

    An owner's lines and the messages that picked this owner are cut into blocks. A block of lines is packed once as an
    inverted index of the words that its messages say, and meets each block of messages in a task of its own, which
    adds the weights up and gives out one line per message. So what is moved and stored is blocks, never the
    (message, line) pairs, which grow with the product of both. Words are met on hashes of 64 bits.
    """
    names = _words(people, [], "name")
    heard = picks.select("msg_id", "person").join(mwords, "msg_id").join(names, "word", "left_anti").join(weights.select("word", "weight"), "word")
    heard = materialize(heard.select("msg_id", "person", F.xxhash64("word").alias("word"), "weight"), "heard")
    asked = materialize(heard.select("person", "word").distinct(), "asked")
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(n / size)).cast("bigint")
    # one row per owner: how many blocks of lines and of messages
    parts = materialize(
        lines.groupBy("person").agg(F.greatest(
            blocks(F.count("*"), REASON_BLOCK["lines"]), blocks(F.sum(F.char_length("line").cast("bigint")), REASON_BLOCK["chars"])
        ).alias("line_parts")).join(picks.groupBy("person").agg(blocks(F.count("*"), REASON_BLOCK["messages"]).alias("message_parts")), "person"),
        "parts",
    )
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).alias("part")
    held = owner_word_repeats(lines, ["person", "line_no", "route"], "line").select(
        "person", F.coalesce(F.col("line_no").cast("bigint"), F.lit(NO_LINE)).alias("line_no"), F.coalesce(F.col("route").cast("int"), F.lit(2)).alias("code"), F.xxhash64("word").alias("word")
    )
    held = held.join(asked, ["person", "word"], "left_semi").join(parts, "person").select("person", part("line_no", "line_parts"), "line_no", "code", "word")
    person, msg = heard.schema["person"].dataType.simpleString(), heard.schema["msg_id"].dataType.simpleString()
    index = held.groupBy("person", "part").applyInArrow(
        _pack_lines, f"person {person}, part bigint, line_nos array<bigint>, codes array<int>, words array<bigint>, until array<int>, at array<int>"
    )
    index = materialize(index, "line-blocks")
    said = heard.groupBy("person", "msg_id").agg(F.array_sort(F.collect_list(F.struct("word", "weight"))).alias("w")).select("person", "msg_id", "w.word", "w.weight")
    said = said.withColumnsRenamed({"word": "words", "weight": "weights"}).join(parts, "person")
    said = said.withColumn("message_part", part("msg_id", "message_parts")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("line_parts") - 1)))
    index = index.join(parts, "person").withColumn("message_part", F.explode(F.sequence(F.lit(0), F.col("message_parts") - 1)))
    pair = ["person", "part", "message_part"]
    best = (
        index.select(*pair, "line_nos", "codes", "words", "until", "at").groupBy(*pair)
        .cogroup(said.select(*pair, "msg_id", "words", "weights").groupBy(*pair))
        .applyInArrow(_best_lines, f"msg_id {msg}, person {person}, line_no bigint, code int, score double")
    )
    best = best.groupBy("msg_id", "person").agg(F.min_by(F.struct("line_no", "code", "score"), F.struct(-F.col("score"), "code", "line_no")).alias("b"))
    return best.select(
        "msg_id", "person", F.nullif("b.line_no", F.lit(NO_LINE)).alias("line_no"), F.when(F.col("b.code") < 2, F.col("b.code") == 1).alias("route"), "b.score"
    )


def clip(c: Column | str, size: int = L.REASON_CHARS) -> Column:
    """A text on one line, cut to ``size`` characters with an ellipsis."""
    return bind(one_line(c), lambda x: F.when(F.char_length(x) <= size, x).otherwise(F.concat(F.rtrim(F.left(x, F.lit(size - 1))), F.lit("…"))))


def owner_block(messages: DataFrame, picks: DataFrame, people: DataFrame, reasons: DataFrame, lines: DataFrame, ceiling: int = L.OWNER_BLOCK_CHARS) -> DataFrame:
    """``msg_id, block, owners`` for every message: its picked owners, each with reach, backup and the reason.

    ``people`` also has ``department, slack, dashboard, backup``; ``reasons`` is the result of ``best_reason``; ``picks``
    may have ``redirect``, which speaks where no line matched. Nobody picked gives the fixed line, an empty directory
    an empty block. Owners that do not fit the ceiling leave from the end, the first is cut.
    """
    redirect = F.col("redirect") if "redirect" in picks.columns else F.lit(None).cast("string")
    reasons = materialize(reasons, "reasons")  # few rows: the texts stay where they are read while these can be sent around
    told = reasons.join(lines.select("person", "line_no", "line"), ["person", "line_no"]).select("msg_id", "person", "route", "line")
    named = picks.select("msg_id", "person", "place", redirect.alias("redirect")).join(people, "person").join(told, ["msg_id", "person"], "left")
    quoted = lambda lead, c, tail: F.concat(F.lit(lead + '"'), clip(c), F.lit('"' + tail))
    why = (
        F.when(F.col("line").isNotNull() & ~F.col("route"), quoted("Owns ", "line", ".")).when(F.col("line").isNotNull(), quoted("Route when ", "line", "."))
        .when(F.col("redirect").isNotNull(), quoted("Another entry's Out of scope line sends ", "redirect", " here.")).otherwise("Title matches.")
    )
    optional = lambda label, c: F.when(c != "", F.concat(F.lit(f" {label}: "), c, F.lit("."))).otherwise("")
    entry = F.concat(
        F.col("place").cast("string"), F.lit(". "), one_line("name"), F.lit(", "), one_line("title"), F.lit(" ("), one_line("department"), F.lit(")."),
        optional("Reach", reach_text("slack", "dashboard")), optional("Backup", clip(F.coalesce("backup", F.lit("")))), F.lit(" "), why,
    )
    per = named.groupBy("msg_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", entry.alias("e")))), lambda x: x["e"]).alias("_e"))
    grown = lambda n: F.array_join(F.concat(F.array(F.lit(L.OWNER_HEADING)), F.slice("_e", F.lit(1), n)), "\n")
    fits = F.array_max(F.filter(F.sequence(F.lit(1), F.size("_e")), lambda n: (n == 1) | (F.char_length(grown(n)) <= ceiling)))
    someone = people.agg((F.count("*") > 0).alias("_someone"))  # one row
    out = messages.select("msg_id").join(per, "msg_id", "left").join(F.broadcast(someone)).withColumn("owners", F.coalesce(fits, F.lit(0)))
    block = F.when(~F.col("_someone"), "").when(F.col("_e").isNull(), L.NO_OWNER).otherwise(F.left(grown(F.col("owners")), F.lit(ceiling)))
    return out.select("msg_id", block.alias("block"), F.col("owners").cast("bigint").alias("owners"))


def person_heading(name: Column, title: Column, department: Column) -> Column:
    """First line of a directory entry."""
    return F.concat(one_line(name), F.lit(": "), one_line(title), F.lit(" ("), one_line(department), F.lit(")"))


def render_person(name: Column, title: Column, department: Column, owns: Column, systems: Column, scope: Column, backup: Column, escalates: Column, reach: Column) -> Column:
    """Canonical text of one directory entry."""
    joined = lambda a, s: F.array_join(F.transform(a, one_line), s)
    entry = lambda s: F.when(
        F.size(s["targets"]) > 0, F.concat(one_line(s["topic"]), F.lit(" → "), joined(s["targets"], " / "))
    ).otherwise(one_line(s["topic"]))
    part = lambda test, label, c: F.when(test, F.concat(F.lit(label), c))
    return F.concat_ws(
        "\n",
        person_heading(name, title, department),
        part(F.size(owns) > 0, "- Owns: ", joined(owns, "; ")),
        part(F.size(systems) > 0, "- Systems: ", joined(systems, ", ")),
        part(F.size(scope) > 0, "- Out of scope: ", F.array_join(F.transform(scope, entry), "; ")),
        part(ws_trim(backup) != "", "- Backup: ", one_line(backup)),
        part(ws_trim(escalates) != "", "- Escalates to: ", one_line(escalates)),
        part(reach != "", "- Reach: ", reach),
    )


def directory_asof(answers: DataFrame, snapshots: DataFrame, key: str, ttl_seconds: int = L.DIRECTORY_TTL_SECONDS) -> DataFrame:
    """Latest good snapshot at or before each answer, and whether it had gone stale.

    Snapshots are cut into days of at most 1,440 minutes, minutes of at most 60 seconds, and seconds of distinct times.
    An answer looks for the last time at or before it in the row of its second, else the last second before it in
    its minute, else the last minute in its day, else the last day before. Answers are never ordered and meet
    unique rows only, so a busy minute may be split over tasks.
    """
    at, taken = F.col("at"), F.col("taken")
    cut = lambda c, unit: F.date_trunc(unit, c).cast("timestamp_ntz")
    times = snapshots.select(F.col("taken_at").alias("taken")).filter(taken.isNotNull()).distinct()
    second = times.groupBy(cut(taken, "second").alias("second")).agg(F.array_sort(F.collect_list("taken")).alias("in_second"), F.max("taken").alias("last"))
    second = materialize(second, "seconds")
    minute = second.groupBy(cut(F.col("second"), "minute").alias("minute")).agg(F.array_sort(F.collect_list("last")).alias("in_minute"), F.max("last").alias("last"))
    day = minute.groupBy(cut(F.col("minute"), "day").alias("day")).agg(F.array_sort(F.collect_list("last")).alias("in_day"), F.max("last").alias("last"))
    asked = answers.select(key, F.col("asked_at").alias("at"))
    asked = asked.withColumns({unit: cut(at, unit) for unit in ("second", "minute", "day")})
    # one row per calendar day meets in this window
    days = day.join(asked.select("day").distinct(), "day", "full_outer").withColumn(
        "before", F.last("last", ignorenulls=True).over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    )
    found = (
        asked.join(second.select("second", "in_second"), "second", "left").join(minute.select("minute", "in_minute"), "minute", "left")
        .join(days.select("day", "in_day", "before"), "day", "left")
    )
    latest = lambda c, limit: F.array_max(F.filter(c, lambda x: limit(x)))
    found = found.withColumn("snapshot_at", F.coalesce(
        latest("in_second", lambda x: x <= F.col("at")), latest("in_minute", lambda x: x < F.col("second")),
        latest("in_day", lambda x: x < F.col("minute")), "before",
    ))
    return found.select(
        key, F.col("at").alias("asked_at"), "snapshot_at",
        (F.col("snapshot_at") < F.col("at") - F.expr(f"INTERVAL {ttl_seconds} SECONDS")).alias("stale"),
    )
