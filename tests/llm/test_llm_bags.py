"""Toxicity, prefix tries and token alignment against plain versions, with odd rows."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuslane.llm import alignment, contraction, langid, toxicity, trie
from corpuslane.llm.queries import QUERIES

SF, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
CLASH = ("id", "c", "d", "i", "k", "key", "text_", "block", "pair", "n", "p0", "parent", "total", "gone", "score", "predicted", "label", "sentence", "hash", "at", "_row", "_found")


# --- prefix trie ------------------------------------------------------------------------------------


def nodes(rows):
    """[(conv_id, turn, role, text)] with turns that differ -> sorted rows of ``prefix_trie``"""
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), (r or "", x or "")))
    own = {c: [y for _, y in sorted(v, key=lambda p: p[0])] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = tuple(own.get(c - c % 100, [])[:h] + v[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) if children[k] else 1
        saved[k] = (len(members[k]) - 1) * (len(k[-1][1]) if k else 0) + sum(saved[x] for x in children[k])
    digest = {k: hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest() for k in members}
    return sorted(
        (min(v), len(k), min(members[k[:-1]]) if k else None, len(v), len(children[k]), leaves[k], saved[k], digest[k]) for k, v in members.items()
    )


def key(row):
    return tuple(-1 if x is None else x for x in row)


TURNS = "conv_id long, turn long, role string, text string"


@here
@pytest.mark.parametrize("sf", [SF, MORE])
def test_trie_of_the_tables(spark, sf):
    got = sorted((tuple(r) for r in QUERIES["op12_prefix_trie"](spark, sf).collect()), key=key)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got == sorted(nodes(rows), key=key) and len(got) > 5


def test_trie_of_odd_rows(spark):
    r = random.Random(3)
    rows = [(c, t, r.choice(["user", None, "", "bot"]), r.choice(["a", "b\U0001f600", None, ""])) for c in range(0, 260, 1 + 1) for t in range(r.randint(1, 9))]
    rows += [(7, None, "user", "first"), (7, 3, "user", "x" * 5000), (None, 1, "user", "a"), (100, None, None, None), (5, 9, "user", "alone")]
    rows += [(301, t, "user", f"t{t % 3}") for t in range(400)] + [(-3, 1, "user", "a")]
    df = spark.createDataFrame(rows, TURNS)
    for c in CLASH:
        df = df.withColumn(c, F.lit("x"))
    got = sorted((tuple(x) for x in trie.prefix_trie(df.repartition(5)).collect()), key=key)
    assert got == sorted(nodes(rows), key=key)


def test_trie_of_a_conversation_over_many_tasks(spark):
    """One conversation holds nearly all rows, and its sorted turns lie in several tasks."""
    rows = [(1200, t, "user", str(t * t % 97)) for t in range(1500)] + [(1201 + c, t, "user", str(t)) for c in range(20) for t in range(3)]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted((tuple(x) for x in trie.prefix_trie(spark.createDataFrame(rows, TURNS)).collect()), key=key)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert got == sorted(nodes(rows), key=key)


def test_repeated_turns_are_turns_of_their_own(spark):
    rows = [(100, 1, "user", "same")] * 70 + [(200, 1, "user", "same")] * 40
    got = trie.prefix_trie(spark.createDataFrame(rows, TURNS))
    assert got.agg(F.max("depth")).first()[0] == 70 and got.where("depth = 40").first()["n_convs"] == 2
    assert trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0


def test_subtree_sums_of_random_and_chain_trees(spark):
    r = random.Random(8)
    for parents in ([None, *[r.randrange(max(0, i - 3), i) for i in range(1, 300)]], [None, *range(199)], [None, None, *[r.choice([0, 1]) for _ in range(80)]]):
        size = len(parents)
        want = [i + 1 for i in range(size)]
        for i in range(size - 1, -1, -1):
            if parents[i] is not None:
                want[parents[i]] += want[i]
        count = Counter(p for p in parents if p is not None)
        tree = spark.createDataFrame([(i, p, count[i], i + 1) for i, p in enumerate(parents)], "id long, parent long, k long, v long")
        assert {x.id: x.v for x in contraction.subtree_sums(tree, ["v"]).collect()} == dict(enumerate(want))


# --- alignment ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair.load(*alignment.files())


def whole(text, pair):
    """Both tokenizers over the whole text, uncut: counts, digest and linked pairs with their numbers; or none."""
    if not text:
        return None
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    spelled = [[t[i].as_py() for i in ids] for t, ids in ((pair.bytes_a, a), (pair.bytes_b, b))]
    if any(b"".join(s) != (" " + text).encode() for s in spelled):
        return None
    ends = [np.cumsum([len(x) for x in s]) for s in spelled]
    links, groups, i, j = Counter(), [([], [])], 0, 0
    while i < len(a) and j < len(b):
        links[a[i], b[j]] += 1
        x, y = ends[0][i], ends[1][j]
        if x <= y:
            groups[-1][0].append(a[i])
            i += 1
        if y <= x:
            groups[-1][1].append(b[j])
            j += 1
        if x == y:
            groups.append(([], []))
    groups.pop()
    said = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
    return (len(a), len(b), len(groups), sum(links.values()), hashlib.sha256(said.encode()).hexdigest()), links


def aligned(docs, pair):
    found = [(i, whole(t, pair)) for i, t in docs]
    held = Counter(p for _, w in found if w for p in w[1])
    top = defaultdict(int)
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    out = []
    for i, w in found:
        if w is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            (na, nb, ng, nl, digest), links = w
            best = sum(n for p, n in links.items() if held[p] == top[p[0]])
            out.append((i, na, nb, ng, nl, best, sum(n * held[p] for p, n in links.items()), digest))
    return sorted(out, key=str)


ALIGNED = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = [
    None, "", " ", "  two  blanks ", "a b", "tab\tand\nline  \n end", "it's  don't we'll", "▁ is B's blank", "<s> is plain <|endoftext|> too", "日本 語　x",
    "a   b", "a b c", "é ́x", "nul\x00 x", "\U0001f600 \U0001f600\U0001f600", "x" * 3000 + " y", "١٢ ٣ 4", "same same same", "same same same", "...   ,,, !",
]


@here
def test_alignment_of_the_tables(spark, pair):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op13_alignment"](spark, SF).select("doc_id", *ALIGNED).collect()), key=str)
    assert got == aligned(docs, pair)


def test_alignment_of_odd_texts_in_small_units(spark, pair):
    r = random.Random(4)
    docs = list(enumerate(ODD)) + [(100, " ".join(r.choice(ODD[3:10]) for _ in range(400))), (101, " ".join(f"w{i} word" for i in range(3000))), (None, "null id"), (100, "id again")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for c in CLASH:
        df = df.withColumn(c, F.lit("x"))
    got = alignment.align(df.repartition(3), unit=1000, block=5000).select("doc_id", *ALIGNED)
    assert sorted((tuple(x) for x in got.collect()), key=str) == aligned(docs, pair)
    assert alignment.align(df.limit(0)).count() == 0


def test_no_cut_inside_runs_of_blanks(pair):
    data = np.frombuffer("a b  c   d e".encode(), np.uint8)
    assert alignment.cuts(data, np.array([0, len(data)])).tolist() == [1, len(data) - 2]


# --- toxicity -----------------------------------------------------------------------------------------

VILE, PLAIN = ("grolm", "zwick"), "the and of river stone light moves over under green hills".split()


def bags(n, seed=0, start=0):
    r = random.Random(seed)
    rows = []
    for i in range(start, start + n):
        sentences = [" ".join(r.choice(PLAIN) for _ in range(6)) for _ in range(r.randint(1, 8))]
        bad = i % 4 == 0
        if bad:
            k = r.randrange(len(sentences))
            sentences[k] += " " + r.choice(VILE) + r.choice(["", "en", "heit"])
        rows.append((i, ". ".join(sentences), int(bad)))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    rows = spark.createDataFrame(bags(600), "doc_id long, text string, toxic int")
    return toxicity.train(rows, F.col("text"), F.col("toxic"))


def plain_features(sentence):
    """(word, n) of every feature of a sentence: whole words and how they begin."""
    out = set()
    for w in re.findall(r"[^\W\d_]+", sentence.lower()):
        out |= {(w, 0)} | {(w[:n], n) for n in toxicity.BEGINS if len(w) >= n}
    return out


def test_features_name_words_and_their_beginnings(spark):
    rows = [t for _, t, _ in bags(40)] + ["Oneé two-three 4five. SIX!\nseven", "", "\U0001f600 \U00010400\U00010401x"]
    for texts in (rows, *[[t] for t in rows]):
        named, owners = defaultdict(set), defaultdict(set)
        for owner, number, place, hashes in toxicity.features(texts):
            for o, s, h in zip(owner.tolist(), number.tolist(), hashes.tolist()):
                named[o, s].add(h)
        for k, text in enumerate(texts):
            own = [v for (o, _), v in sorted(named.items()) if o == k]
            want = [f for f in map(plain_features, re.split(r"[.!?\n\r]", text)) if f]
            assert [len(x) for x in own] == [len(x) for x in want]


def test_long_texts_have_the_same_features_in_blocks(monkeypatch):
    text = "Some words stand here. And more of them\nfollow " * 60

    def listed():
        return sorted(tuple(x) for parts in toxicity.features([text]) for x in zip(*[p.tolist() for p in parts]))

    once = listed()
    monkeypatch.setattr(toxicity, "CHARS", 64)
    assert listed() == once


def test_gradient_is_that_of_the_noisy_or():
    r = np.random.default_rng(2)
    sentence, at = np.array([0, 0, 1, 2, 2, 3, 4]), np.array([0, 1, 2, 1, 2, 0, 1])
    bag, label, w = np.array([0, 0, 0, 1, 1, 1, 2]), np.array([1, 0, 1]), r.normal(size=3)
    g, gb, loss = toxicity._bag_losses(sentence, at, bag, label, w, -0.3, 0.01)
    for k in range(3):
        up, down = w.copy(), w.copy()
        up[k] += 1e-6
        down[k] -= 1e-6
        diff = (toxicity._bag_losses(sentence, at, bag, label, up, -0.3, 0.01)[2] - toxicity._bag_losses(sentence, at, bag, label, down, -0.3, 0.01)[2]) / 2e-6
        assert abs(diff - g[k]) < 1e-5
    diff = (toxicity._bag_losses(sentence, at, bag, label, w, -0.3 + 1e-6, 0.01)[2] - loss) / 1e-6
    assert abs(diff - gb) < 1e-4


def test_learned_from_documents_it_finds_sentences(spark, model):
    rows = bags(200, seed=9, start=1000)
    got = {r.doc_id: r for r in toxicity.locate(spark.createDataFrame(rows, "doc_id long, text string, toxic int"), model).collect()}
    for i, text, bad in rows:
        assert got[i].predicted == bad and (got[i].score >= toxicity.HIGH) == bool(bad)
        spots = [text[o.begin :] for o in got[i].offending]
        assert len(spots) == bad and all(any(v in s.split(".")[0] for v in VILE) for s in spots)


def test_scores_are_the_noisy_or_of_sentences(model):
    text = "the grolm moves. green hills, zwickheit\nand grolm grolmen! under the stone"
    scores, n, _ = toxicity.sentences([text, None, "", "12 34"], model)
    each = [toxicity.sentences([s], toxicity.Model(model.hashes, model.weights, model.bias, 0.0))[0][0] for s in re.split(r"[.!?\n]", text)]
    assert abs(scores[0] - (1 - (1 - model.leak) * np.prod([1 - e for e in each]))) < 1e-9
    assert scores[1:].tolist() == pytest.approx([model.leak] * 3) and n[1:].tolist() == [0, 0, 0]


def test_toxicity_of_odd_rows(spark, model):
    rows = [(1, None, 1), (2, "", 0), (2, "", 0), (None, "the grolm", None), (4, "x " * 200_000 + "grolm", 7), (5, "\n\n...", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    for c in CLASH:
        df = df.withColumn(c, F.lit("x"))
    found = toxicity.locate(df, model)
    assert found.count() == len(rows) and set(CLASH) <= set(found.columns) and dict(found.dtypes)["score"] == "double"
    assert [r.predicted for r in found.where("text LIKE '%grolm'").collect()] == [1, 1]
    for few in (df.limit(0), df.where("toxic = 0"), df.where("doc_id = 4")):
        learned = toxicity.train(few, F.col("text"), F.col("toxic"))
        assert not len(learned.hashes) and learned.leak == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="test tables not present")
def test_held_out_documents(spark):
    """At least 0.8 of the held-out toxic documents are found (a seventh of them hold no toxic word), and hardly a clean one."""
    got = QUERIES["op11_toxicity"](spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    held = {(r.toxic, r.predicted): r.n for r in got.where("held_out").groupBy("toxic", "predicted").agg(F.count("*").alias("n")).collect()}
    assert held[1, 1] / (held[1, 1] + held[1, 0]) >= 0.8 and held.get((0, 1), 0) / (held[0, 0] + held.get((0, 1), 0)) <= 0.01
    assert got.where(F.col("score").isNull() | ~F.col("score").between(0, 1)).count() == 0
    assert got.where(F.col("held_out") != langid.held_out(F.col("doc_id"))).count() == 0
