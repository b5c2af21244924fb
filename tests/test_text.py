from pyspark.sql import functions as F

from corpuslane.functions import text as X
from corpuslane.operators import answers as A
from corpuslane.operators import lines as N
from corpuslane.operators import rules as M
from corpuslane.operators import screen as S


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("v")).first()["v"]


def test_display_line_and_key(spark):
    assert one(spark, "> 2. **See** [the guide](http://x/y) \U0001f9ed now", X.display_line) == "See the guide now"
    assert one(spark, "| a | b c |", X.display_line) == "a; b c"
    assert one(spark, "| --- | :-: |", X.display_line) == ""
    assert one(spark, "Don't use G30.0 — ever", lambda c: X.match_key(X.display_line(c))) == "dont use g30 0 ever"


def test_spans_match_offsets(spark):
    got = one(spark, "call 415-555-1234 or (212) 555 9876.", lambda c: X.spans(c, S.L.PHONE))
    assert [(s["start"], s["end"], s["text"]) for s in got] == [(5, 17, "415-555-1234"), (21, 35, "(212) 555 9876")]


def test_identifier_reasons(spark):
    cases = {
        "ssn 123-45-6789": "a Social Security number",
        "write a.b@c.org": "an email address",
        "the DOB on this form reads 04/12/1941": "a date of birth",
        "born 12th of April, 1941": "a date of birth",
        "born " + "x" * 60 + " 1941-04-12": None,
        "call 415-555-1234": "a phone number",
        "chart 4155551234 on file": None,
        "chart 415-555-1234 on file": "a phone number",
        "4155551234 shipped": "a phone number",
        "MRN is listed far away from it 4155551234": "a phone number",
        "on 04/12/1941 they came": None,
        "12345678901234 is an id": None,
    }
    for text, want in cases.items():
        assert one(spark, text, S.identifier_reason) == want, text


def test_warnings(spark):
    cases = {
        "My patient, Tobias Van Quillen": "a patient name",
        "the patient in Lantern Imaging": None,
        "Mrs. Pemberly called": "a patient name",
        "Dr. Quarrie called": None,
        "Ines Falk's chart": "a patient name",
        "12 Copper Hollow Avenue": "a street address",
        "123 MRI XR": None,
        "member ID: AB-123456": "an insurance or member ID",
    }
    for text, want in cases.items():
        assert one(spark, text, S.warning_noun) == want, text


def test_owner_words(spark):
    got = one(spark, "non-clinical copay-process for IT; billings, access as MX", X.owner_words)
    assert got == ["nonclinical", "copay", "process", "IT".lower(), "billing", "access", "mx"]


def test_status_and_category(spark):
    row = spark.range(1).select(
        X.status_kind(F.lit("Draft — Needs Review"), F.lit("x")).alias("a"), X.status_kind(F.lit("In Review"), F.lit("x")).alias("b"),
        X.status_kind(F.lit(""), F.lit("T (DRAFT — Needs Review)")).alias("c"), X.status_kind(F.lit(None).cast("string"), F.lit("t (draft)")).alias("d"),
        X.primary_category(F.array(F.lit("Planning"), F.lit("Reference"))).alias("e"), X.primary_category(F.array().cast("array<string>")).alias("f"),
    ).first()
    assert tuple(row) == ("draft", "review", "draft", None, "Reference", "uncategorized")


def test_section_and_fence_lines(spark):
    doc = "intro\n# One:\n```\n# not a heading\ncode\n```\n- item *a*\n\n| x | y |\n## Two\n> note"
    df = spark.createDataFrame([(1, doc)], "k int, t string")
    got = [(r["line"], r["display"], r["section"], r["quoted"], r["table"]) for r in N.index_lines(df, "k", "t").orderBy("line").collect()]
    assert got == [
        (0, "intro", None, False, False), (6, "item *a*", "One", False, False), (8, "x; y", "One", False, True), (10, "note", "Two", True, False),
    ]


def test_repair_lists(spark):
    assert one(spark, "Do now\n3. a\nwrap\n4. b\n\n1. c\ntext\n2. d", A.repair_lists) == "Do now\n\n3. a\nwrap\n4. b\n\n1. c\ntext\n2. d"


def test_degenerate(spark):
    assert one(spark, "the of and to in " * 4, A.degenerate)
    assert one(spark, "echo " * 20, A.degenerate)
    assert not one(spark, "the of and", A.degenerate)
    assert not one(spark, "Route the order to billing once \"insurance\" details arrive from Ana's team today.", A.degenerate)


def test_sentences(spark):
    text = "Ask Dr. Lin first. Use the form (see A. Then B.) now. He said \"Stop. Go.\" Then left."
    got = one(spark, text, M.split_sentences)
    assert got[0] == "Ask Dr. Lin first."
    assert got[1] == "Use the form (see A. Then B.) now."
    assert " ".join(got) == text


def test_inline_items(spark):
    tail = 'What the SOPs say: 1. [1] Guide "one." 2. [2] Codes G31.84, R41.3 "two." 3. [3] More "three." Not covered by the SOPs: - gap'
    df = spark.createDataFrame([(1, tail)], "k int, t string")
    out = A.split_tail(df, "t")
    row = out.first()
    assert row["heading"] == "What the SOPs say:"
    assert row["rest"].startswith("Not covered")
    items = A.parse_items(out, ["k"], "items").orderBy("item").collect()
    assert [(r["item"], r["label"], r["quotes"]) for r in items] == [(1, 1, ["one."]), (2, 2, ["two."]), (3, 3, ["three."])]


def test_identity_question(spark):
    ask = "Steps.\n\n**One question:** What is the patient's full name?\n\nBye"
    keep = "Steps.\n\nOne question: Is her name listed on the signed ROI?"
    df = spark.createDataFrame([(1, ask), (2, keep)], "k int, t string")
    got = {r["k"]: (r["t"], r["dropped"]) for r in A.drop_identity_question(df, "t").collect()}
    assert got[1] == ("Steps.\n\nBye", True)
    assert got[2] == (keep, False)


def test_rule_units(spark):
    doc = (
        "Before you call:\n- check the **chart** first\n  and wrap here too\n- [ ] never share the login with anyone\n\n"
        "## Cut\n- Staff may not change codes on their own\n> DRAFT needs review\nOnly the prescriber decides what is ordered.\n"
    )
    df = spark.createDataFrame([(1, doc, "full")], "k int, t string, passage_kind string")
    units = {r["text"]: r["kind"] for r in M.rule_units(df, ["k"], "t").collect()}
    assert units == {
        "Before you call: check the chart first and wrap here too": "item",
        "Before you call: never share the login with anyone": "checkbox",
        "Staff may not change codes on their own": "item",
        "Only the prescriber decides what is ordered.": "sentence",
    }
    rules = {r["text"][:14]: (r["tier"], r["hits"]) for r in M.mine_rules(M.rule_units(df, ["k"], "t")).collect()}
    assert rules["Before you cal"] == ("A", ["never"])
    assert rules["Staff may not "] == ("A", ["on-their-own", "ops-may-not"])
    assert rules["Only the presc"] == ("A", ["only-role", "role-decides"])


def test_do_not_veto(spark):
    df = spark.createDataFrame([("do not need this",), ("don't call them",), ("it was never placed",)], "t string")
    assert [r[0] for r in df.select(M.rule_hits("t")).collect()] == [[], ["do-not"], []]


def test_redact_names_order(spark):
    df = spark.createDataFrame([(1, "Ana Lin met Ana and Anabel")], "k int, t string")
    names = spark.createDataFrame([("Ana",), ("Ana Lin",), ("",)], "name string")
    want = "<person> met <person> and <person>bel"
    assert S.redact_names(df, names, "t").first()["t"] == want


def test_long_texts_stay_linear(spark):
    text = "[" * 64_000 + " " + "- a\n" * 16_000
    df = spark.createDataFrame([(1, text)], "k int, t string")
    assert N.index_lines(df, "k", "t").count() >= 16_000
    assert one(spark, text, A.gap_count) == 0
