"""Cases of the third part of the review of round 3."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from corpuslane.functions import lexicon as L
from corpuslane.operators import owners as O
from corpuslane.operators import retrieve as R
from corpuslane.operators import rules as M
from corpuslane.plans import catalog
from corpuslane.plans import ownership as W
from corpuslane.session import Tables

SF = "/root/testdata/sf0.001"


def test_render_directory_reads_the_pages_that_can_fit(spark, monkeypatch):
    t = Tables(spark, SF)
    everyone = W.v_people(t)
    by_department = defaultdict(list)
    for r in W.v_rendered(everyone).join(everyone.select("person", "department"), "person").orderBy("priority", "person").collect():
        by_department[r["department"]].append(r["text"])
    read, write = [], W.materialize
    monkeypatch.setattr(W, "materialize", lambda df, name: read.append(out.count()) or out if (out := write(df, name)) and name == "people" else out)
    for ceiling in (0, 260, 700, 9_000):
        monkeypatch.setattr(L, "DIRECTORY_CHARS", ceiling)
        want = {}
        for department, texts in by_department.items():
            kept = [n for n in range(1, len(texts) + 1) if len("\n\n".join(texts[:n])) <= ceiling]
            want |= {department: "\n\n".join(texts[: kept[-1]])} if kept else {}
        assert {r["department"]: r["directory"] for r in catalog.queries()["render_directory"](spark, SF).collect()} == want
    assert read[0] == 0 and read[1] < read[2] < read[3] == everyone.count()


def test_redirected_picks_score_what_says_the_same_once(spark, monkeypatch):
    draw = random.Random(11)
    vocabulary = [f"work{c}" for c in "abcdef"]
    say = lambda n: " ".join(draw.sample(vocabulary, n))
    frame = spark.createDataFrame
    people = frame([(p, f"Person{p} Last{p}", draw.choice(["workc", "", None]), f"P{p % 3}", p) for p in range(90)], "person bigint, name string, title string, priority string, ord bigint")
    lines = frame([(p, n, draw.choice([say(1), say(2), None]), False) for p in range(90) for n in range(2)], "person bigint, line_no bigint, line string, route boolean")
    scope = frame([(p, e, draw.choice([say(1), say(2), "nothing else", None])) for p in range(90) for e in range(2)], "person bigint, entry int, topic string")
    resolved = frame([(p, draw.randrange(2), draw.randrange(90)) for p in range(0, 90, 2) for _ in range(3)], "person bigint, entry int, target_person bigint")
    messages = frame([(m, say(draw.randint(1, 3)) + f" noise{m}") for m in range(120)] + [(500, None), (501, "nothing")], "msg_id bigint, text string")
    entries = O.entry_words(people, lines)
    weights = O.word_weights(entries, frame([(0, "Workb")], "person bigint, system string"), people.agg(F.count("*").alias("n")))
    heard = O.message_words(messages)
    rows = lambda picks: sorted((r["msg_id"], r["person"], r["place"], round(r["score"], 6), r["redirect"] or "") for r in picks.collect())
    want = rows(O.pick_owners(O.total_scores(O.match_owners(heard, entries, weights), O.redirect_effects(heard, scope, resolved, weights)), people))
    scored, score = [], O.redirected_scores
    monkeypatch.setattr(O, "redirected_scores", lambda said, *rest: scored.append(said.select("msg_id").distinct().count()) or score(said, *rest))
    assert rows(O.redirected_picks(heard, entries, weights, scope, resolved, people)) == want and any(r[4] for r in want)
    assert scored[0] < 45


def test_keyword_pairs_are_added_up_in_tasks_of_bounded_size(spark, monkeypatch):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    queries = spark.createDataFrame([(q, " ".join(draw.sample(words, 4))) for q in range(9)] + [(90, "absent"), (91, "")], "query_id bigint, query string")
    chunks = spark.createDataFrame([(c, " ".join(draw.choices(words, k=draw.randint(0, 15)))) for c in range(300)], "chunk_id bigint, text string")
    least, deal = [], R.deal
    monkeypatch.setattr(R, "deal", lambda df, *keys, least: tasks.append((keys, least)) or deal(df, *keys, least=least))
    found = []
    for size in (1 << 20, 50):
        monkeypatch.setattr(R, "PAIRS_A_TASK", size)
        tasks = []
        found.append([sorted(map(tuple, R.keyword_leg(queries, chunks, mode, 5).collect())) for mode in ("or", "and")])
        least.append([n for _, n in tasks])
        assert {keys for keys, _ in tasks} == {("chunk_id",)}
    assert found[0] == found[1] and len(found[0][0]) == 45 and len(found[0][1]) > 0
    assert least[0] == [1, 1] and all(n > 10 for n in least[1])


UNITS = [
    "You must not call them.", "MUST NEVER share it.", "It is not permitted today.", "This is Prohibited.", "Staff may not do it on their own.", "Ops never act on their own.",
    "Only the NP signs it.", "The provider decides on this.", "Physicians make the call.", "Chosen by the NP today.", "Ordered prescriber refills.", "Sent via the care team.",
    "Route it to the nurse.", "Routed all of them through the refund policy.", "It must come from a physician.", "No refunds of any kind by staff.", "Coordinators can’t promise.",
    "Do not guess.", "DON'T guess.", "Don’t guess.", "Do not worry about it.", "It never arrived.", "Never guess.", "A nurse authorises it.", "The team lead approved nothing.", "İt NEVER works", "plain words", "", None,
]


def test_rule_signs_lose_no_rule(spark):
    plain = [F.when(F.col("t").rlike(L.NEVER) & ~F.col("t").rlike(L.NEVER_FACT), "never"), *(F.when(F.col("t").rlike(p), n) for n, p in L.RULE_TERMS), F.when(F.col("t").rlike(L.DO_NOT), "do-not")]
    rows = spark.createDataFrame([(t,) for t in UNITS], "t string").select("t", M.rule_hits("t").alias("got"), F.array_compact(F.array(*plain)).alias("want")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]
    assert {n for r in rows for n in r["want"]} == set(L.RULE_SIGNS)


def test_rules_are_read_once(spark):
    calls = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame([(1, "full", "Never guess the dose of a patient.\n\nDo not call the pharmacy before noon."), (2, "full", "Plain words of some length here.")], "id int, passage_kind string, raw string")
    read = F.udf(lambda x: calls.add(1) or x)
    rules = M.mine_rules(M.rule_units(df.withColumn("text", read("raw")), ["id"], "text")).collect()
    assert sorted((r["id"], r["unit"], r["tier"], r["hits"]) for r in rules) == [(1, 0, "A", ["never"]), (1, 1, "B", ["do-not"])]
    assert calls.value == 2
