"""Cases of the second part of the review of round 3."""

import random

from corpuslane.operators import owners as O
from corpuslane.operators import routing as G
from corpuslane.plans import catalog
from corpuslane.plans import ownership as W

SF = "/root/testdata/sf0.001"

WORDS = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]


def reasons(spark, lines, messages, people):
    weights = {w: 0.1 + 0.01 * i for i, w in enumerate(WORDS)}
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    picks = frame([(m, p) for m, _ in messages for p in people], "msg_id bigint, person bigint")
    got = O.best_reason(
        O.message_words(frame(messages, "msg_id bigint, text string")), picks, frame([(p, "Zed") for p in people], "person bigint, name string"),
        frame(lines, "person bigint, line_no bigint, line string, route boolean"), frame(list(weights.items()), "word string, weight double"),
    ).collect()
    return {(r["msg_id"], r["person"]): (r["line_no"], r["route"], r["score"]) for r in got}, weights


def test_best_reason_over_many_blocks_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(O, "REASON_BLOCK", {"chars": 900, "lines": 16, "messages": 8})
    draw = random.Random(5)
    say = lambda n: " ".join(draw.sample(WORDS, n))
    lines = [(p, n, say(draw.randint(1, 9)), draw.choice([True, False, None])) for p in (1, 2) for n in range(60)] + [(1, 900, None, True), (2, 901, "", False)]
    messages = [(m, say(draw.randint(1, 6))) for m in range(40)] + [(99, "nothing shared")]
    got, weights = reasons(spark, lines, messages, [1, 2])
    want = {}
    for m, text in messages:
        for p, n, line, route in lines:
            shared = set(text.split()) & set((line or "").split())
            if p in (1, 2) and shared:
                key = (-round(sum(weights[w] for w in shared), 9), 2 if route is None else int(route), n)
                want[m, p] = min(want.get((m, p), key), key)
    assert got == {k: (n, {0: False, 1: True, 2: None}[r], -s) for k, (s, r, n) in want.items()} and len(got) > 70


def test_directory_checks_parse_only_what_they_read(spark, monkeypatch):
    written = {}
    write = W.materialize
    monkeypatch.setattr(W, "materialize", lambda df, name: written.update({name: set(df.columns)}) or write(df, name))
    want = {"expand_backups": {"name", "backup"}, "resolve_targets": {"name", "routing_departments", "out_of_scope"},
            "dangling_refs": {"name", "backup", "routing_departments", "out_of_scope"}}
    for name, columns in want.items():
        assert catalog.queries()[name](spark, SF).count() > 0
        assert written["people"] == columns | {"person"}


def test_each_distinct_target_is_searched_once(spark, monkeypatch):
    searched, named = [], G.departments_named
    monkeypatch.setattr(G, "departments_named", lambda texts, *rest: searched.append(texts.count()) or named(texts, *rest))
    rows = [(i, f"Ana{i} B", "", ["R"], [("a", ["zone one", "nowhere"]), ("b", ["nowhere"])]) for i in range(50)]
    people = spark.createDataFrame(rows, "person bigint, name string, backup string, routing_departments array<string>, out_of_scope array<struct<topic:string,targets:array<string>>>")
    departments = spark.createDataFrame([("R", ["Zone One"])], "department string, aliases array<string>")
    found = G.dangling_refs(people, departments).collect()
    assert searched == [0, 2] and len(found) == 50 and all('"b"' in r["message"] for r in found)
