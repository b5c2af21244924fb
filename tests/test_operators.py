"""Operators against plain loops on small fixtures."""

import random

from pyspark.sql import functions as F

from corpuslane.operators import answers as A
from corpuslane.operators import cite as Q
from corpuslane.operators import context as C
from corpuslane.operators import evaluate as E
from corpuslane.operators import owners as O
from corpuslane.operators import retrieve as R
from corpuslane.operators import routing as G
from corpuslane.operators import rules as M
from corpuslane.operators import snapshot as N
from corpuslane.sources import corpus as K
from corpuslane.sources import directory as D
from corpuslane.streaming import decisions as T


def test_vector_blocks_equal_direct(spark, monkeypatch):
    rng = random.Random(1)
    vec = lambda: [rng.uniform(-1, 1) for _ in range(8)]
    q = spark.createDataFrame([(i, vec()) for i in range(9)], "query_id bigint, vector array<double>")
    c = spark.createDataFrame([(i, vec()) for i in range(60)], "chunk_id bigint, vector array<double>")
    direct = {tuple(r) for r in R.vector_leg(q, c, 5).collect()}
    monkeypatch.setattr(R, "QUERY_BLOCK", 4)
    assert {tuple(r) for r in R.vector_leg(q, c, 5).collect()} == direct
    assert len(direct) == 45


def test_rank_ties_and_null_scores(spark):
    hits = spark.createDataFrame(
        [(1, 1, "b", None), (1, 2, "a", 0.5), (1, 3, "c", 0.5), (1, 4, None, 9.0), (1, 5, "b", 0.0)],
        "query_id int, pos int, file string, score double",
    )
    got = [(r["file"], r["best"], r["rank"]) for r in R.rank_files(hits).orderBy("rank").collect()]
    assert got == [("a", 0.5, 1), ("c", 0.5, 2), ("b", 0.0, 3)]


def test_pack_context_stops_at_first_overflow(spark):
    meta = spark.createDataFrame([("a", "A", "x" * 60, None), ("b", "B", "y" * 50, "draft"), ("c", "C", "z" * 5, None)], "file string, title string, body string, status string")
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "query_id int, file string, rank int")
    hits = spark.createDataFrame([(1, 1, "a", "skip"), (1, 2, "b", "---\ntitle: t\n---\n# Head\nbody"), (1, 3, "c", "  "), (1, 4, None, "q" * 40), (1, 5, "c", "late")], "query_id int, pos int, file string, chunk_text string")
    got = [(r["label"], r["file"], r["kind"], r["chars"], r["section"]) for r in C.pack_context(ranked, hits, meta, budget=100).orderBy("label").collect()]
    # b overflows, so c is not tried as a whole document; the 40-character chunk stops the chunks
    assert got == [(1, "a", "full", 60, None), (2, "b", "chunk", 11, "Head")]


def test_trim_history_equals_loop(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant"]), "x" * rng.randint(0, 60), rng.choice([None, "full"]), rng.random() < 0.1) for c in range(20) for t in range(rng.randint(1, 25))]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, content string, coverage string, notice boolean")
    got = {(r["conv_id"], r["turn"]) for r in C.trim_history(df, 6, 150).collect()}
    want = set()
    for c in range(20):
        usable = [r for r in rows if r[0] == c and r[3].strip() and not r[5]]
        if not usable:
            continue
        want.add((c, usable[-1][1]))
        used, kept = 0, 1
        for r in reversed(usable[:-1]):
            n = len(r[3]) + (len(f"Coverage: {r[4]}\n\n") if r[2] == "assistant" and r[4] else 0)
            if kept >= 6 or used + n > 150:
                break
            used, kept = used + n, kept + 1
            want.add((c, r[1]))
    assert got == want


def _score(quote, line):
    cursor = covered = 0
    first = last = -1
    for tok in quote:
        if tok in line[cursor:]:
            at = line.index(tok, cursor)
            first = at if first < 0 else first
            last, covered, cursor = at, covered + 1, at + 1
    pairs = [(a, b) for a, b in zip(quote, quote[1:])]
    have = set(zip(line, line[1:]))
    return 0.5 * covered / len(quote) + 0.5 * sum(p in have for p in pairs) / len(pairs), first, last


def test_fuzzy_and_exact_equal_brute_force(spark):
    rng = random.Random(5)
    words = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi".split()
    lines = [(f"f{i % 3}", i, " ".join(rng.choice(words) for _ in range(rng.randint(3, 30)))) for i in range(60)]
    quotes = []
    for i in range(40):
        src = rng.choice(lines)[2].split()
        cut = src[: rng.randint(2, len(src))]
        if i % 2:
            cut = [w if rng.random() > 0.12 else "changed" for w in cut]
        quotes.append((i, " ".join(cut)))
    qdf = Q.prepare_quotes(spark.createDataFrame(quotes, "qid int, quote string"))
    ldf = spark.createDataFrame(lines, "file string, line int, key string")
    exact = {(r["qid"], r["file"], r["line"], r["from_tok"]) for r in Q.exact_hits(qdf, ldf, ["qid"]).collect()}
    fuzzy = {(r["qid"], r["line"]): (round(r["score"], 6), r["from_tok"], r["to_tok"]) for r in Q.fuzzy_hits(qdf, ldf, ["qid"]).collect()}
    want_exact, want_fuzzy = set(), {}
    for qid, q in quotes:
        qt = q.split()
        for f, n, l in lines:
            lt = l.split()
            at = next((i for i in range(len(lt) - len(qt) + 1) if lt[i : i + len(qt)] == qt), None)
            if at is not None:
                want_exact.add((qid, f, n, at))
            if len(qt) >= 8:
                s, a, b = _score(qt, lt)
                if a >= 0 and s >= 0.75 and b - a + 1 <= 2 * len(qt):
                    want_fuzzy[(qid, n)] = (round(s, 6), a, b)
    assert exact == want_exact
    assert fuzzy == want_fuzzy and fuzzy
    found = {(r["qid"], r["file"]): (r["line"], r["exact"]) for r in Q.find_quotes(qdf, ldf, ["qid"]).collect()}
    for qid, q in quotes:
        for f in ("f0", "f1", "f2"):
            ex = sorted(n for (i, ff, n, _) in want_exact if i == qid and ff == f)
            fz = sorted(((-want_fuzzy[(qid, n)][0], n) for (ff, n, _) in lines if ff == f and (qid, n) in want_fuzzy))
            if ex:
                want = (ex[0], True) if len(ex) == 1 or len(q.split()) >= 8 else None
            else:
                want = (fz[0][1], False) if fz else None
            assert found.get((qid, f)) == want


def test_resolve_citations_tiers(spark):
    docs = [
        ("imaging.md", "# Orders\nG30.0 is the code for early onset and G30.1 the code for late onset cases."),
        ("intake.md", "## Check in\nAsk the front desk to confirm the insurance card before every single visit today."),
    ]
    from corpuslane.operators import lines as Ln

    lines = Ln.index_lines(spark.createDataFrame(docs, "file string, text string"), "file", "text")
    ranked = spark.createDataFrame([("a", "imaging.md", "Imaging Orders", 1), ("a", "intake.md", "Patient Check In", 2)], "answer_id string, file string, title string, rank bigint")
    labels = spark.createDataFrame([("a", 1, "imaging.md"), ("a", 2, "intake.md")], "answer_id string, label bigint, file string")
    tail = (
        "What the SOPs say:\n"
        '1. [1] Imaging Orders "G30 is the code for early onset and G30.1 the code for late onset cases"\n'
        '2. [1] Imaging Orders "confirm the insurance card before every single visit"\n'
        '3. Patient Check In, "front desk"\n'
        '4. [2] Patient Check In "words that nobody ever wrote anywhere in this corpus of ours"\n'
        '5. Unheard Of "words that nobody ever wrote anywhere in this corpus of ours"\n'
        "Not covered by the SOPs\n- gap"
    )
    tails = A.split_tail(spark.createDataFrame([("a", tail)], "answer_id string, held string"), "held")
    items = A.parse_items(tails, ["answer_id"], "items")
    resolved = Q.resolve_citations(items, labels, ranked, lines)
    got = {r["item"]: (r["file"], r["kind"], r["section"]) for r in resolved.collect()}
    assert got == {
        1: ("imaging.md", "matched", "Orders"),  # fuzzy inside the labelled file
        2: ("intake.md", "matched", "Check in"),  # a quote found word for word outranks the label
        3: ("intake.md", "matched", "Check in"),  # one exact line is enough at any length
        4: ("intake.md", "unmatched", None),
        5: (None, "unknown", None),
    }
    meta = spark.createDataFrame([("imaging.md", "Imaging Orders", "http://h/1"), ("intake.md", "Patient Check In", None)], "file string, title string, source_url string")
    block = Q.rebuild_citations(resolved, meta, tails).first()
    assert (block["items"], block["matched"], block["unmatched"], block["unknown"]) == (5, 3, 1, 1)
    assert block["text"].startswith("What the SOPs say:\n\n1. [Imaging Orders](http://h/1), Orders\n   \"G30.0 is")
    assert block["text"].endswith("Not covered by the SOPs\n- gap")


def test_link_mentions(spark):
    d = Q.mention_dictionary(spark.createDataFrame([("Referral Intake (DRAFT)", "referral.md", "http://h/r")], "title string, file string, source_url string"))
    texts = spark.createDataFrame([(1, "See **Referral Intake** and [Referral Intake](x) in referral.md, not Referral Intakes.")], "k int, t string")
    got = Q.link_mentions(texts, "k", "t", d).first()["linked"]
    assert got == "See [Referral Intake](http://h/r) and [Referral Intake](x) in [Referral Intake (DRAFT)](http://h/r), not Referral Intakes."


def test_expand_quote_sentences(spark):
    line = "First part here. X" + "x" * 410 + " second part. Third \"part\" ends."
    df = spark.createDataFrame([(line, 0, 1), (line, 5, 6), (line, 1, 3)], "d string, a int, b int")
    got = [r[0] for r in df.select(Q.expand_quote("d", "a", "b", F.lit(False), F.lit(False))).collect()]
    assert got[0] == "First part here."
    # a run of whole sentences over the limit is capped at a word
    assert got[1] == "X" + "x" * 410 + " second…"
    assert got[2] == "First part here.…"


def test_assign_keys_equals_sequential(spark):
    rng = random.Random(11)
    hexid = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(32))
    pages = [(hexid(), rng.choice(["Visit", "visit!", "Other", "???"])) for _ in range(30)]
    shared = pages[0][0][:8]
    pages += [(shared + hexid()[:24], "Visit") for _ in range(3)]  # same slug and same leading id
    pages += [("0" * 32, f"visit {pages[3][0][:8]}")]  # an early page already holds a later page's fallback
    used, want = set(), {}
    import re

    for pid, title in sorted(pages):
        base = re.sub(r"^-+|-+$", "", re.sub(r"[^a-z0-9]+", "-", title.lower()))[:80] or "untitled"
        alt = f"{base}-{pid[:8]}"
        slug = base if base not in used else alt
        n = 2
        while slug in used:
            slug, n = f"{alt}-{n}", n + 1
        used.add(slug)
        want[pid] = slug
    got = {r["id"]: r["key"] for r in N.assign_keys(spark.createDataFrame(pages, "id string, title string")).collect()}
    assert got == want


def test_suspicious_drop_edges(spark):
    df = spark.createDataFrame([(76, 1, 16), (76, 1, 17), (10, 0, 0), (3, 1, 5)], "tracked int, exported int, stale int")
    assert [r["suspicious"] for r in N.suspicious_drop(df).collect()] == [False, True, True, False]


def test_corpus_headers(spark):
    objects = spark.createDataFrame(
        [
            ("a.md", "---\ntitle: 'It''s  fine'\ncategory:\n  - SOP\n  - X\nlast_edited: 2024-01-05T10:00:00.000Z\nstatus: [Draft, x]\nuse_when: >-\n  long\n  text\n---\n\nBody\n"),
            ("b.md", "---\ntitle: [unclosed\ncategory: SOP\n---\nBody"),
            ("c.md", "No header at all"),
            ("d.md", '---\ntitle: "A \\"b\\" (DRAFT)"\nsource_url: https://h/x\ncategory: 7\n---\nB'),
        ],
        "key string, raw string",
    )
    got = {r["key"]: r for r in K.parse_corpus(objects).collect()}
    assert (got["a.md"]["title"], got["a.md"]["category"], got["a.md"]["status"], got["a.md"]["use_when"]) == ("It's  fine", "SOP", "draft", "long text")
    assert (got["a.md"]["last_edited"], got["a.md"]["text"]) == ("2024-01-05T10:00:00.000Z", "Body")
    assert (got["b.md"]["title"], got["b.md"]["category"], got["b.md"]["text"]) == ("b.md", "uncategorized", "")
    assert (got["c.md"]["title"], got["c.md"]["text"]) == ("c.md", "No header at all")
    assert (got["d.md"]["title"], got["d.md"]["category"], got["d.md"]["status"], got["d.md"]["source_url"]) == ('A "b" (DRAFT)', "uncategorized", "draft", "https://h/x")


def test_corpus_files_roundtrip(spark, tmp_path):
    (tmp_path / "x.md").write_text("---\ntitle: X\n---\n\nhello\nworld\n")
    row = K.read_corpus(spark, str(tmp_path)).first()
    assert (row["key"], row["title"], row["text"]) == ("x.md", "X", "hello\nworld")


def test_alias_precedence(spark):
    people = spark.createDataFrame(
        [(1, 1, "Casey Doe", ["Lin", "Revenue (RCM)"]), (2, 2, "Dr. Lin", ["Revenue (RCM)"]), (3, 3, "Casey Roe", [])],
        "person int, ord int, name string, routing_departments array<string>",
    )
    got = {}
    for r in O.alias_table(people).collect():
        got.setdefault(r["key"], set()).add(r["person"])
    assert got["casey"] == {1, 3} and got["casey doe"] == {1} and got["dr lin"] == {2}
    assert got["rcm"] == {1} and got["revenue"] == {1} and got["revenue (rcm)"] == {1}
    assert "dr" not in got


def test_topic_overlap_equals_brute_force(spark):
    rng = random.Random(7)
    words = "billing copay referral imaging scheduling records intake portal".split()
    topic = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 5)))
    a, b = [(i, topic()) for i in range(25)], [(i, topic()) for i in range(40)]
    stem = lambda t: {w[:-1] if len(w) > 4 and w.endswith("s") else w for w in t.split()}
    want = {
        (i, j, len(stem(x) & stem(y)))
        for i, x in a for j, y in b
        if len(stem(x) & stem(y)) >= 2 or (stem(x) & stem(y) and min(len(stem(x)), len(stem(y))) <= 2)
    }
    got = G.topic_overlap(spark.createDataFrame(a, "a_id int, a_topic string"), spark.createDataFrame(b, "b_id int, b_topic string"))
    rows = [(r["a_id"], r["b_id"], r["shared"]) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_routing_checks(spark):
    scope = "array<struct<topic:string,targets:array<string>>>"
    people = spark.createDataFrame(
        [
            (1, "Ana Lee", "Lead", "Ops", "Bo", ["Front Desk"], ["billing refunds and disputes"], [("imaging orders", ["Bo"]), ("lost cards", ["Nobody"])]),
            (2, "Bo Kim", "", "Ops", "Bo Kim", ["Imaging (IM)"], ["imaging schedule"], []),
        ],
        f"person int, name string, title string, department string, backup string, routing_departments array<string>, owns array<string>, out_of_scope {scope}",
    )
    departments = spark.createDataFrame(
        [
            ("Front Desk", ["reception"], [("billing refunds", "Imaging"), ("parking passes", "IM")]),
            ("Imaging (IM)", ["IM"], [("imaging orders", "Front Desk")]),
        ],
        "department string, aliases array<string>, exclusions array<struct<topic:string,target:string>>",
    )
    got = sorted((r["level"], r["person"], r["message"]) for r in G.check_directory(people, departments).collect())
    assert got == [
        ("conflict", 1, 'owns "billing refunds and disputes", but Front Desk excludes "billing refunds" (Imaging)'),
        ("conflict", 1, 'sends "imaging orders" to untitled row (Ops), but Imaging (IM) excludes "imaging orders" (Front Desk)'),
        ("conflict", 2, 'owns "imaging schedule", but Imaging (IM) excludes "imaging orders" (Front Desk)'),
        ("error", 2, "left out: no Title"),
        ("gap", 2, 'Imaging (IM) excludes "imaging orders" (Front Desk), but Out of Scope never sends it on'),
        ("reference", 1, 'Out of Scope "lost cards" routes to no one in the directory and no department'),
        ("reference", 2, "Backup is the person themself"),
    ]
    assert {r["person"]: r["backup"] for r in G.expand_backups(people).collect()} == {1: "Bo Kim", 2: "Bo Kim"}


def test_directory_is_all_or_nothing(spark):
    import json

    def person(**over):
        base = dict(name="A", title="t", department="d", routingDepartments=[], priority="P1", owns=[], systems=[], outOfScope=[], backup="", escalatesTo="", reach=dict(slack="", dashboard=""))
        return {**base, **over}

    snap = lambda *p, v=1: json.dumps(dict(version=v, generated_at="x", personas=list(p)))
    rows = [(1, snap(person(), person(name="B"))), (2, snap(person(), person(priority="P7"))), (3, snap(person(name=" "))), (4, snap(person(), v=2)), (5, "not json")]
    got = D.read_directory(spark.createDataFrame(rows, "s int, raw string"), "raw")
    assert sorted((r["s"], r["name"]) for r in got.collect()) == [(1, "A"), (1, "B")]


def test_select_rules_skips_not_stops(spark):
    rules = spark.createDataFrame(
        [(1, 1, 0, "a" * 60, "A", "item"), (1, 2, 0, "b" * 300, "A", "item"), (1, 1, 1, "c" * 40, "B", "item"), (1, 2, 1, "A" * 60, "A", "item"), (1, 2, 2, "d" * 30, "A", "checkbox")],
        "request int, label bigint, unit bigint, text string, tier string, kind string",
    )
    got = [(r["label"], r["text"][0]) for r in M.select_rules(rules, "request", "label", max_lines=12, max_chars=200).orderBy("pick").collect()]
    # the long rule is skipped, the repeated text (any case) is dropped, later ones still fit
    assert got == [(1, "a"), (1, "c"), (2, "d")]


def test_rule_units_reach_and_edges(spark):
    text = "\n".join([
        "lower start that was cut off", "", "Before you call:", "- check the plan on file today", "  and note the answer there", "- ask about:", "   - the deductible that is left",
        "", "   - the copay for this visit", "- close the request when done", "Plain words follow the list here.", "More of the same paragraph.", "```", "- not read inside a fence at all", "```", "- [ ] tick the box after the fence", "no full stop at the very end",
    ])
    docs = spark.createDataFrame([(1, "full", text), (2, "chunk", text), (3, "chunk", None), (4, "full", "")], "id int, passage_kind string, text string")
    rows = M.rule_units(docs, ["id"], "text").orderBy("id", "unit").collect()
    full = [(r["text"], r["kind"]) for r in rows if r["id"] == 1]
    assert full == [
        ("lower start that was cut off", "sentence"),
        ("Before you call: check the plan on file today and note the answer there", "item"),
        ("Before you call: ask about: the deductible that is left", "item"),
        ("Before you call: ask about: the copay for this visit", "item"),
        ("Before you call: close the request when done", "item"),
        ("Plain words follow the list here. More of the same paragraph.", "sentence"),
        ("tick the box after the fence", "checkbox"),
        ("no full stop at the very end", "sentence"),
    ]
    assert [(r["text"], r["kind"]) for r in rows if r["id"] == 2] == full[1:-1]
    assert {r["id"] for r in rows} == {1, 2}


def test_rule_units_of_a_long_list(spark):
    text = "Lead in to the list:\n" + "\n".join(f"- entry number {k} with enough words" for k in range(20_000))
    docs = spark.createDataFrame([(1, "full", text)], "id int, passage_kind string, text string")
    assert M.rule_units(docs, ["id"], "text").count() == 20_000


def test_summary_golden(spark):
    rows = [("c", True, 1, 100, None), ("c", True, 3, 200, None), ("c", True, None, 301, None), ("c", False, None, 100, None), ("c", True, 1, 9, "boom")]
    df = spark.createDataFrame(rows, "config string, has_expected boolean, rank int, ms int, error string")
    assert tuple(E.summarise(df).first()) == ("c", 1, 2, 2, 1, 2.0, 175, 1)


DECLARATIONS = [
    "Coverage: full\nbody\nmore", "**Coverage: partial.**\r\n\nbody", "coverage - none\nbody", "Coverage: full Answer: yes\nmore", "no declaration\nbody",
    "Coverage: maybe\nbody", "**Coverage: full\nbody", "   \n\n", "", "Coverage: full", "x" * 300, " " * 255 + "\nCoverage: full\nb", "Coverage: fully\nbody", "\n" * 20 + "__coverage: none__",
    "Coverage: full " + "y" * 300,
]


def test_gate_is_independent_of_delta_size(spark):
    df = spark.createDataFrame(list(enumerate(DECLARATIONS)), "k int, t string")
    batch = {r["k"]: (r["coverage"], r["blocked"], r["reason"], r["body"]) for r in A.gate_coverage(df, "t").collect()}
    for k, text in enumerate(DECLARATIONS):
        for size in (1, 3, 7, 64, 1000):
            seen, found = "", None
            for i in range(0, max(len(text), 1), size):
                seen += text[i : i + size]
                found = T.coverage(seen, False)
                if found:
                    break
            found = found or T.coverage(seen, True)
            value, blocked, reason, body = found
            shown = "" if blocked else text[body:]
            assert batch[k] == (value, blocked, reason, shown), (k, size)


def test_hold_is_lossless(spark):
    texts = ["a\nWhat the SOPs say:\n1. x", "a\n**What the SOPs say:** tail", "a\n## What the SOPs say\ntail", "nothing here", "a\nWhat the SOPs say", "say what the SOPs say: inline", "**What the SOPs say**:\nz"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for r in A.hold_tail(df, "t").collect():
        assert r["shown"] + (r["held"] or "") == r["t"]
        cut = T.heading_cut(r["t"], True)
        want = r["t"][cut:] if cut is not None else ("" if T.ends_on_heading(r["t"]) else None)
        assert r["held"] == want, r["t"]


def test_directory_pages_are_dealt_out_and_read_once(spark, tmp_path):
    """A directory that one scan task holds is read by as many tasks as there are cores."""
    page = "# Top\r\n## Core Responsibilities (v1)\n- old\n## core  responsibilities\n- **orders**\n## Out of Scope\n- repair (route to Ana / Bo — later)\n- x\n## Escalation path\n- Backup: Cy\n## Route when\na\n- b\n"
    rows = [(i, "Ana", "Lead", "Ops", ["R"], "p1 x", "spare", "Dashboard main", "kept", page if i % 2 else "") for i in range(64)]
    schema = "person bigint, name string, title string, department string, routing_departments array<string>, priority string, backup string, slack_channel string, route_when string, markdown string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "pages"))
    people = D.parse_directory(spark.read.parquet(str(tmp_path / "pages")))
    assert people.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    found = {r["person"]: r for r in people.collect()}
    assert len(found) == 64
    one, none = found[1], found[0]
    assert (one["owns"], one["backup"], one["route_when"], one["slack"], one["dashboard"]) == (["orders"], "Cy", "a b", "", "main")
    assert [(s["topic"], s["targets"]) for s in one["out_of_scope"]] == [("repair", ["Ana", "Bo"]), ("x", [])]
    assert (none["owns"], none["out_of_scope"], none["backup"], none["route_when"]) == ([], [], "spare", "kept")
