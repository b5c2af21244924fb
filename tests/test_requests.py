"""Owner blocks, team structures and delivery counts on small fixtures."""

from corpuslane.functions import lexicon as L
from corpuslane.operators import answers as A
from corpuslane.operators import owners as O
from corpuslane.operators import teams as S

PEOPLE = "person bigint, name string, title string, department string, slack string, dashboard string, backup string"
PICKS = "msg_id bigint, person bigint, place bigint, redirect string"
REASONS = "msg_id bigint, person bigint, line_no bigint, route boolean"


def blocks(spark, people, picks, reasons, lines):
    out = O.owner_block(
        spark.createDataFrame([(m,) for m in (1, 2)], "msg_id bigint"), spark.createDataFrame(picks, PICKS), spark.createDataFrame(people, PEOPLE),
        spark.createDataFrame(reasons, REASONS), spark.createDataFrame(lines, "person bigint, line_no bigint, line string"),
    )
    return {r["msg_id"]: (r["block"], r["owners"]) for r in out.collect()}


DESK = [
    (1, "Rae  Holt", "Front Desk", "Operations", "#desk (unverified)", "", ""),
    (2, "Sam Ode", "Billing", "Finance", "", "Claims board", "Rae\nHolt"),
]


def test_owner_block_names_reach_backup_and_reason(spark):
    got = blocks(spark, DESK, [(1, 1, 1, "x"), (1, 2, 2, "copays")], [(1, 1, 0, False)], [(1, 0, "check-ins  at noon")])
    assert got[1] == ("\n".join([
        L.OWNER_HEADING,
        '1. Rae Holt, Front Desk (Operations). Reach: Slack #desk. Owns "check-ins at noon".',
        '2. Sam Ode, Billing (Finance). Reach: Dashboard Claims board. Backup: Rae Holt. Another entry\'s Out of scope line sends "copays" here.',
    ]), 2)
    assert got[2] == (L.NO_OWNER, 0)


def test_owner_block_route_title_and_empty_directory(spark):
    got = blocks(spark, DESK, [(1, 1, 1, None), (2, 2, 1, None)], [(1, 1, 3, True)], [(1, 3, "late forms"), (1, 4, "other")])
    assert got[1][0].endswith('Route when "late forms".')
    assert got[2][0].endswith("Title matches.")
    assert blocks(spark, [], [], [], []) == {1: ("", 0), 2: ("", 0)}


def test_owner_block_keeps_its_ceiling(spark):
    long = [(p, "N" * 200, "T" * 200, "D", "", "", "") for p in (1, 2)]
    got = blocks(spark, long, [(1, 1, 1, None), (1, 2, 2, None)], [(1, 1, 0, False)], [(1, 0, "word " * 90)])
    text, owners = got[1]
    assert owners == 1 and len(text) <= L.OWNER_BLOCK_CHARS and "\n2. " not in text
    clipped = text.split('Owns "')[1]
    assert clipped == ("word " * 90)[: L.REASON_CHARS - 1].rstrip() + '…".'
    huge = [(1, "N" * 2000, "T", "D", "", "", "")]
    assert len(blocks(spark, huge, [(1, 1, 1, None)], [], [])[1][0]) == L.OWNER_BLOCK_CHARS


def test_team_structure_blocks(spark):
    f = spark.createDataFrame(
        [(1, 1, "Care", "live sites", 1, "Triage", "requests", ["inbox"]), (1, 1, "Care", "live sites", 0, "Support", "patients", None),
         (1, 0, "Build", "new work", 0, None, None, None), (2, 0, "Solo", "all", 0, "One", "everything", [])],
        "k int, team_ord int, team string, purpose string, ord int, name string, covers string, aliases array<string>",
    )
    h = spark.createDataFrame([(1, 0, "Build", "Care", "it works")], "k int, ord int, sender string, receiver string, criterion string")
    x = spark.createDataFrame([(3, 0, "Clinic", "visits", ["RN", "MA"], "Care", "Support")], "k int, ord int, name string, covers string, aliases array<string>, team string, fn string")
    got = {r["k"]: r for r in S.team_structure(f, h, x, "k").collect()}
    assert got[1]["structure"] == "\n".join([
        "Build team: new work.", "", "Care team: live sites.", "- Support: patients.", "- Triage: requests. Also called: inbox.", "",
        L.HANDOFFS_HEADING, "- Build to Care: it works.",
    ])
    assert got[2]["structure"] == "Solo team: all.\n- One: everything."
    assert got[3]["structure"] == L.OUTSIDE_HEADING + "\n- Clinic: visits. Also called: RN, MA. Operations contact: Care team, Support function."
    assert [got[1]["chars"], got[1]["over"]] == [len(got[1]["structure"]), False]
    assert {r["over"] for r in S.team_structure(f, h, x, "k", 20).collect()} == {True}


def test_delivery_counts(spark):
    steps = "Do now\n1. a\n2. b\n"
    tail = "What the SOPs say:\n1. [1] Guide \"x\"\nNot covered by the SOPs\n- one\n- two\nOne question: why?\n- no gap"
    rows = [
        (1, "Coverage: full\n" + steps + tail, None), (2, "Coverage: none\n" + steps, None), (3, steps + tail, None),
        (4, "Coverage: partial\n" + steps + tail, "\n1. [1] Guide\nNot covered by the SOPs\n- one"), (5, "", None), (6, None, None),
    ]
    df = spark.createDataFrame(rows, "id int, answer string, rebuilt string")
    got = {r["id"]: r for r in A.delivery_stats(df, "answer", "rebuilt").collect()}
    pair = lambda i, c: (got[i][f"generated_{c}"], got[i][f"delivered_{c}"])
    assert (pair(1, "steps"), pair(1, "gaps")) == ((2, 2), (2, 2))
    assert (pair(2, "steps"), got[2]["none_with_steps"], got[2]["coverage_line"]) == ((2, 0), True, True)
    assert (pair(3, "steps"), got[3]["none_with_steps"], got[3]["coverage_line"]) == ((2, 0), False, False)
    assert (pair(4, "steps"), pair(4, "gaps")) == ((2, 2), (2, 1))
    assert got[2]["delivered_chars"] == len(L.BLOCKED_LINES["none"])
    assert got[5]["reason"] == "missing" and pair(5, "steps") == (0, 0)


def test_redirected_scores_pick_what_all_pairs_pick(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(7)
    vocabulary = [f"work{c}" for c in "abcdefghijkl"]
    say = lambda n: " ".join(rng.sample(vocabulary, n))
    people = spark.createDataFrame([(p, f"Person{p} Last{p}", say(1), f"P{p % 3}", p) for p in range(25)], "person bigint, name string, title string, priority string, ord bigint")
    lines = spark.createDataFrame([(p, n, say(2), False) for p in range(25) for n in range(2)], "person bigint, line_no bigint, line string, route boolean")
    scope = spark.createDataFrame([(p, e, say(2)) for p in range(25) for e in range(2)], "person bigint, entry int, topic string")
    resolved = spark.createDataFrame([(p, 0, rng.randrange(25)) for p in range(0, 25, 3)], "person bigint, entry int, target_person bigint")
    messages = spark.createDataFrame([(m, say(3)) for m in range(40)], "msg_id bigint, text string")
    entries = O.entry_words(people, lines)
    weights = O.word_weights(entries, spark.createDataFrame([(0, "Workb")], "person bigint, system string"), people.agg(F.count("*").alias("n")))
    heard = O.message_words(messages)
    rows = lambda scores: sorted(
        (r["msg_id"], r["person"], r["place"], round(r["score"], 6), r["redirect"]) for r in O.pick_owners(scores, people).collect()
    )
    every = O.total_scores(O.match_owners(heard, entries, weights), O.redirect_effects(heard, scope, resolved, weights))
    want = rows(every)
    assert want and any(r[4] for r in want)
    got = rows(O.redirected_scores(heard, entries, weights, scope, resolved))
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert [bool(r[4]) for r in got] == [bool(r[4]) for r in want]
