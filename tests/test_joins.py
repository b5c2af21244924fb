"""Joins by handles and bounds against brute force, and workers that find the package."""

import datetime
import os
import random
import subprocess
import sys
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuslane.functions import lexicon as L
from corpuslane.operators import cite as Q
from corpuslane.operators import owners as O
from corpuslane.operators import retrieve as R
from corpuslane.operators import screen as S

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def seconds(n):
    words = [f"w{i % 997}" for i in range(n)]
    quote, line = pa.array([" ".join(words)]), pa.array([" ".join(words[1:] + ["end"])])
    start = time.perf_counter()
    Q.compare.func(quote, line)
    return time.perf_counter() - start


def test_comparison_is_linear_in_quote_and_line():
    seconds(1000)
    short, long = min(seconds(20_000) for _ in range(3)), min(seconds(160_000) for _ in range(3))
    assert long < 8 * 4 * short


def test_an_item_of_many_words_is_resolved(spark):
    r = random.Random(1)
    words = [f"t{r.randrange(5000)}" for _ in range(20_000)]
    said = " ".join(words)
    altered = " ".join(w if i % 50 else "changed" for i, w in enumerate(words))
    lines = spark.createDataFrame(
        [("f1", 0, said, said, "Part", False, False), ("f2", 0, "other text of the file", "other text of the file", None, False, False)],
        "file string, line long, key string, display string, section string, quoted boolean, table boolean",
    )
    items = spark.createDataFrame(
        [(1, 1, 1, "Long guide", "1. [1] Long guide", [altered]), (1, 2, 2, "", said, [])],
        "answer_id long, item int, label int, head string, item_text string, quotes array<string>",
    )
    labels = spark.createDataFrame([(1, 1, "f1"), (1, 2, "f2")], "answer_id long, label int, file string")
    ranked = spark.createDataFrame([(1, "f1", "Long guide", 1), (1, "f2", "Other", 2)], "answer_id long, file string, title string, rank long")
    start = time.perf_counter()
    got = {x.item: x for x in Q.resolve_citations(items, labels, ranked, lines).collect()}
    assert time.perf_counter() - start < 90
    # the first is alike in its own file, the second stands whole in another one
    assert [(got[k].file, got[k].kind, got[k].section) for k in (1, 2)] == [("f1", "matched", "Part"), ("f1", "matched", "Part")]


def test_keyword_legs_join_fewer_postings_than_they_read(spark):
    r = random.Random(2)
    chunks = [(i, " ".join(["the"] * r.randint(1, 4) + [r.choice("abcdefgh") * 2 for _ in range(12)] + (["rare" + str(i % 40)] if i % 3 == 0 else []))) for i in range(900)]
    queries = [(1, "the aa rare3"), (2, "the bb"), (3, "rare0 rare6 the cc"), (4, "none the")]
    c, q = spark.createDataFrame(chunks, "chunk_id long, text string"), spark.createDataFrame(queries, "query_id long, query string")
    terms = R.query_terms(q)
    adds = R.contributions(terms, c).cache()
    every = {}
    for x in adds.collect():
        every.setdefault(x.word, {})[x.chunk_id] = x.w
    for mode in ("and", "or"):
        n = 5
        got = {(x.query_id, x["rank"]): (x.chunk_id, x.score) for x in R.keyword_leg(q, c, mode, n).collect()}
        want = {}
        for i, text in queries:
            lists = [every.get(w, {}) for w in text.split()]
            ids = set.intersection(*map(set, lists)) if mode == "and" else set().union(*lists)
            best = sorted(ids, key=lambda k: (-round(sum(x.get(k, 0) for x in lists), 6), k))[:n]
            want |= {(i, p + 1): (k, round(sum(x.get(k, 0) for x in lists), 6)) for p, k in enumerate(best)}
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
        assert all(abs(got[k][1] - want[k][1]) < 2e-6 for k in want)
        opened = R.opening_words(terms, adds, mode, n).filter("open").join(adds, "word").count()
        assert opened < terms.join(adds, "word").count() / 2


def test_redaction_equals_the_fold_over_all_names(spark):
    r = random.Random(3)
    names = ["Ana", "Ana Ruiz", "Bo", "son", "x", "Dr. Lee", "na R", "Tobias\nQuill", "zz top", "person", ""]
    pieces = [*names, "Anatomy", "Ana  Ruiz", "lemon", "Tobias", "Boson", "Dr. Leeds", "fizz topping", "  ", "\n"]
    texts = [(i, " ".join(r.choice(pieces) for _ in range(r.randint(0, 9)))) for i in range(120)] + [(500, None), (501, "")]
    for used in (names, ["Ana"], [""]):
        got = {x.id: x.t for x in S.redact_names(spark.createDataFrame(texts, "id int, t string"), spark.createDataFrame([(n,) for n in used], "name string"), "t").collect()}
        for i, text in texts:
            for n in sorted({n for n in used if n}, key=lambda n: (-len(n), n)):
                text = text.replace(n, "<person>") if text is not None else None
            assert got[i] == text


def test_directory_asof_equals_a_scan(spark):
    r = random.Random(4)
    base = datetime.datetime(2024, 2, 28, 23, 59)
    at = lambda: base + datetime.timedelta(seconds=r.choice([r.randint(0, 5), r.randint(0, 90), r.randint(0, 400_000)]), microseconds=r.choice([0, 5, 999_999]))
    taken = [at() + datetime.timedelta(seconds=30) for _ in range(60)]
    asked = [(i, at()) for i in range(300)] + [(1000 + i, t) for i, t in enumerate(taken)]
    out = O.directory_asof(
        spark.createDataFrame(asked, "k int, asked_at timestamp_ntz"), spark.createDataFrame([(t,) for t in taken + taken[:3]], "taken_at timestamp_ntz"), "k", 300
    )
    got = {x.k: (x.snapshot_at, x.stale) for x in out.collect()}
    assert len(got) == len(asked)
    for k, t in asked:
        last = max((s for s in taken if s <= t), default=None)
        assert got[k] == (last, None if last is None else last < t - datetime.timedelta(seconds=300))


def test_owner_sums_above_the_floor(spark):
    r = random.Random(5)
    entries = spark.createDataFrame([(p, f"w{r.randrange(40)}", k) for p in range(25) for k in ("owns", "title") for _ in range(8)], "person int, word string, kind string").distinct()
    weights = spark.createDataFrame([(f"w{i}", i / 60) for i in range(40)], "word string, weight double")
    messages = spark.createDataFrame([(m, f"w{w}") for m in range(30) for w in r.sample(range(40), 5)], "msg_id int, word string")
    every = O.match_owners(messages, entries, weights).filter(F.round("score", 9) >= L.OWNER_MIN_SCORE)
    some = O.match_owners(messages, entries, weights, L.OWNER_MIN_SCORE)
    listed = lambda df: sorted((x.msg_id, x.person, round(x.score, 9)) for x in df.collect())
    assert listed(some) == listed(every) and listed(some)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables not present")
def test_python_workers_find_the_package_from_any_directory(tmp_path):
    code = (
        f"import sys; sys.path.insert(0, {ROOT!r})\n"
        "import __spark_entry__ as e\nfrom corpuslane.session import build_session\n"
        "spark = build_session('away', 'local[2]')\n"
        "print('rows', e.queries()['sniff_stream'](spark, '/root/testdata/sf0.001').count(), e.queries()['find_quotes'](spark, '/root/testdata/sf0.001').count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows" in done.stdout, done.stderr[-2000:]
