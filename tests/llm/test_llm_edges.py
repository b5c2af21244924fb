"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, operator by operator."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from corpuslane.llm import decontaminate, langid, license_scan, mixing, neardup, secret_scan, shards, shared, substrings, topk, warc, words
from corpuslane.llm.components import components

#: Names that operators use for their outputs or steps, as extra columns of the input.
CLASH = ("score", "size", "shard", "slot", "spans", "n_words", "copies", "component_id", "found", "_key", "_id", "_rk", "_h", "_b", "_m", "_s", "id", "rk", "n", "key", "node", "at", "kept", "label", "bucket", "path", "grams", "t", "m", "u")


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(n))


LONG = prose(1, 60_000)
NEAR = prose(2, 120)
ROWS = [
    (1, NEAR, "en", "a", 1),
    (2, NEAR + " tail", "en", "a", 1),
    (3, NEAR.upper(), None, None, None),
    (4, None, "en", "a", None),
    (5, "", "", "b", 0),
    (6, " \n\t ", "fr", "b", 0),
    (7, LONG, "fr", "", 1),
    (8, "one two", "en", "c", 1),
    (9, "ONE two", "en", "c", 1),
    (10, "12 34 !! ??", "en", "c", 1),
    (11, "été \U0001f600 straße naïve café", "fr", "c", 1),
    (12, LONG + " x", "fr", "c", 1),
]
REPEATED = [ROWS[0], ROWS[0], ROWS[3], (None, NEAR, "en", "a", 1), (None, None, None, None, None)]
KIND = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame(ROWS, KIND)


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows, null ids, and extra columns."""
    df = spark.createDataFrame(ROWS + REPEATED, KIND)
    for k, c in enumerate(CLASH):
        df = df.withColumn(c, F.lit(f"x{k}"))
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KIND)


def pairs(df, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) for r in df.collect()}


def test_words_match_a_regex():
    texts = [r[1] for r in ROWS] + ["", None, "a", " a", "a "]
    for table, fold, pattern in ((words.SPACED, False, brute.BLANK), (words.ALNUM, True, brute.PLAIN)):
        got = words.split(pa.array(texts), table, fold)
        assert got.counts.tolist() == [len(pattern.findall(brute.fold(t) if fold else t or "")) for t in texts]
    got = words.split(pa.array(["b Aa", None, "aA b aa"]), words.SPACED, True)
    assert got.hash[0] == got.hash[3] and got.hash[1] == got.hash[2] == got.hash[4] and got.hash[0] != got.hash[1]


def test_hashes_do_not_depend_on_cuts():
    batch = pa.record_batch([pa.array([LONG, "x", LONG, None, NEAR])], ["t"])
    whole = words.split(batch.column(0), words.SPACED, True)
    parts = [words.split(p.column(0), words.SPACED, True).hash for p in words.pieces(batch, "t", 1000)]
    assert np.array_equal(np.concatenate(parts), whole.hash)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, 101: 100, 102: 100}


def test_bit_filter_has_all(spark):
    bits = shared.bit_filter(spark.range(1000).select(F.xxhash64("id").alias("h")), "h").value
    hashes = np.array([r.h for r in spark.range(1000).select(F.xxhash64("id").alias("h")).collect()]).view(np.uint64)
    assert shared.held(bits, hashes).all()


def test_sharding(spark, plain, odd, none):
    assert shards.interleave(none, 8).count() == 0
    for df in (plain, odd):
        rows = shards.interleave(df, 3).collect()
        assert len(rows) == df.count()
        for k in range(3):
            own = sorted(r.slot for r in rows if r.shard == k)
            assert own == list(range(len(own))) and abs(len(own) - len(rows) / 3) < 1
    assert shards.interleave(odd, 3).columns.count("shard") == 1


def test_sharding_keeps_the_mixture_of_many_buckets(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("source"))
    rows = shards.interleave(df, 7, by=("doc_id",), rows_per_bucket=100).groupBy("source", "shard").count().collect()
    sizes = {}
    for r in rows:
        sizes.setdefault(r.source, []).append(r["count"])
    assert all(len(v) == 7 and max(v) - min(v) <= 3 for v in sizes.values())


def test_one_row_of_each_component(spark, none):
    """A third of all rows are one repeated row, others copy it without an id, and one id has two texts."""
    same, other = prose(5, 40), prose(6, 40)
    rows = [(7, same)] * 40 + [(None, same)] * 10 + [(9, same + " end"), (9, other), (8, other)] + [(None, prose(7, 30))] * 5 + [(1, None), (1, None), (2, ""), (None, None)]
    rows += [(100 + i, prose(100 + i, 20)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("copies", F.lit("x")).withColumn("first", F.lit(1))
    got = sorted(((r.doc_id, r.text) for r in neardup.one_each(df.repartition(4)).collect()), key=str)
    want = [(7, same), (8, other), (None, prose(7, 30)), (1, None), (2, ""), (None, None)] + [(100 + i, prose(100 + i, 20)) for i in range(60)]
    assert got == sorted(want, key=str) and neardup.one_each(df).columns == df.columns
    assert neardup.one_each(none).count() == 0


def test_near_duplicates(spark, plain, odd, none):
    want = brute.near_duplicates([(r[0], r[1]) for r in ROWS])
    assert pairs(neardup.near_duplicates(plain), "n_shingles", "component_id", "kept") == want
    assert neardup.near_duplicates(none).count() == 0
    rows = neardup.near_duplicates(odd).collect()
    assert len(rows) == len(ROWS + REPEATED)
    assert all((r.n_shingles, r.component_id, r.kept) == want[r.doc_id] for r in rows if r.doc_id is not None)
    assert sorted((r.component_id or -1, r.kept) for r in rows if r.doc_id is None) == [(-1, True), (1, False)]


def test_near_duplicate_chains_and_large_buckets(spark):
    r = random.Random(5)
    base = prose(9, 150).split()
    docs = []
    # a chain: each text is near the next, the ends are not near each other
    for k in range(60):
        base[r.randrange(len(base))] = f"w{k}"
        docs.append((k, " ".join(base)))
    # many texts that share a long passage and little else
    shared_part = prose(10, 60)
    docs += [(100 + k, shared_part + " " + prose(1000 + k, 60)) for k in range(80)]
    got = pairs(neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")), "n_shingles", "component_id", "kept")
    assert got == brute.near_duplicates(docs)


def test_tiles_meet_all_open_pairs():
    rng = np.random.default_rng(3)
    n = 200
    sig = rng.integers(0, 9, (n, neardup.SCREEN)).astype(np.uint32)
    sig[::2] = sig[0]
    comp = rng.integers(0, 5, n)
    # each table's bucket holds all rows, so a pair shows in its first common table only
    cells = [(t, k) for t in range(len(neardup.TABLES)) for k in range(n)]
    key, row = (np.array(x) for x in zip(*cells))
    batch = pa.record_batch([pa.array(key), pa.array(row), pa.array(comp[row]), pa.array(np.full(len(row), 100)), pa.array([sig[k].tobytes() for k in row])], ["key", "node", "comp", "n", "sig"])
    cut = [batch.slice(a, 170) for a in range(0, len(row), 170)]
    got = [(a, b) for part in neardup.runs(iter(cut), "key", neardup.open_pairs) for a, b in zip(*(c.to_pylist() for c in part.columns))]
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if comp[i] != comp[j] and (sig[i] == sig[j]).sum() >= neardup.SCREEN_LEAST and (sig[i] == sig[j])[: neardup.POOL].sum() > 1}
    assert set(got) == want and len(got) == len(want)


def test_large_groups_of_loose_copies(spark):
    r = random.Random(11)
    base = prose(12, 90).split()
    docs = []
    for k in range(400):
        body = list(base)
        for _ in range(r.choice((1, 2, 3, 4, 6))):
            body[r.randrange(len(body))] = f"v{r.randrange(10**6)}"
        docs.append((k, " ".join(body)))
    got = pairs(neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")), "n_shingles", "component_id", "kept")
    assert got == brute.near_duplicates(docs)


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(5)] + [(350, [0.0] * 8)]
    bad = [(900, None), (901, []), (902, [1.0, None]), (950, [float("nan")] * 8), (903, [float("inf")] * 8), (None, [1.0] * 8), (904, [1.0, 2.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    v = topk.quantised(df)
    got = {}
    for r in topk.top_k(v, v.where("id % 50 = 0"), 5, tile_rows=64, block_queries=3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute.top_k([(i, [int(np.floor(256 * x)) for x in e]) for i, e in rows])
    nothing = topk.quantised(df.where("vec_id < 0"))
    assert topk.top_k(nothing, nothing, 5).count() == 0


def test_licence_inheritance(spark, plain, odd, none):
    rows = [("a/b/LICENSE", "Released under the MIT License."), ("a/b/c/x", "no words here"), ("a/COPYING", "GNU General Public License Version 3, 29 June 2007"), ("a/y", None), ("z", ""), (None, "Licensed under the Apache License, Version 2.0"), ("a/b/own", "text\nLicensed under CC BY 4.0\nmore")]
    df = spark.createDataFrame(rows, "path string, text string").withColumn("license", F.lit("?"))
    scale = license_scan.weigh(df, F.col("text"))
    got = {r.path: (r.license, r.origin, r.from_dir) for r in license_scan.inherited(license_scan.statements(df, scale)).collect()}
    assert got == {
        "a/b/LICENSE": ("MIT", "own", None), "a/b/c/x": ("MIT", "inherited", "a/b"), "a/COPYING": ("GPL-3.0", "own", None), "a/y": ("GPL-3.0", "inherited", "a"),
        "z": (None, "none", None), None: ("Apache-2.0", "own", None), "a/b/own": ("CC-BY-4.0", "own", None),
    }
    for docs in (odd, none):
        docs = docs.withColumn("path", F.concat(F.lit("p/"), F.col("doc_id").cast("string")))
        assert license_scan.inherited(license_scan.statements(docs, license_scan.weigh(docs, F.col("text")))).count() == docs.count()


def test_languages(spark, plain, odd, none):
    model = langid.train(odd, F.col("text"), F.col("lang"))
    assert model.labels == ("en", "fr")
    rows = langid.identify(odd, model).collect()
    assert len(rows) == len(ROWS + REPEATED)
    assert all((r.lang_pred == "und") == (not re.search(r"[^\W\d_]", r.text or "")) for r in rows)
    assert all(r.score == 0 for r in rows if r.lang_pred == "und")
    empty = langid.train(none, F.col("text"), F.col("lang"))
    assert empty.labels == () and langid.identify(none, model).count() == 0
    assert {r.lang_pred for r in langid.identify(plain, empty).collect()} == {"und"}
    # a long text scores the same alone and among others
    alone = langid.score([LONG], model)[1][0]
    assert alone == langid.score([NEAR, LONG, None], model)[1][1]


def test_secrets(spark, odd, none):
    texts = [
        "password=hunter22 x", "api_key: 'abc' secret=12345 token = \"A/b+c_9.\"", "AKIA" + "Z9" * 8 + " AKIAshort", "deadbeef" * 3 + " " + "ab" * 11,
        "password:token :abcdef", "passwd==abc.def", "toKen=abcdefg", "İ token=abcdefgh", None, "", "x" * 50 + " secret=" + "ab12" * 5000,
        "see Qm7Zx4Kp9Lw2Vt8Rb3Ny6Hc1Jd5Gf0Sa and getUserAccountBalanceByIdentifier2",
    ]
    ordinary = "getUserName setAccountBalance findByIdentifier readAccount2 userIdentifier " * 300
    docs = spark.createDataFrame(list(enumerate(texts * 2 + [prose(4, 3000), ordinary])), "doc_id long, text string").withColumn("found", F.lit(0))
    rows = secret_scan.scan(docs, secret_scan.train(docs, F.col("text"))).collect()
    for r in rows:
        assert [f"{s.kind}:{s.begin}:{s.end}" for s in r.found if s.base] == brute.base_secrets(r.text)
    last = [r.text[s.begin : s.end] for r in rows for s in r.found if not s.base]
    assert last == ["Qm7Zx4Kp9Lw2Vt8Rb3Ny6Hc1Jd5Gf0Sa"] * 2
    for df in (odd, none):
        assert secret_scan.scan(df, secret_scan.train(df, F.col("text"))).count() == df.count()


def test_mixing(spark, plain, odd, none):
    assert mixing.with_mix(none).count() == 0 and mixing.apply_mix(none).count() == 0
    rows = mixing.with_mix(odd).collect()
    assert len(rows) == len(ROWS + REPEATED)
    total = {}
    for r in rows:
        assert r.size == len(brute.BLANK.findall(r.text or "")) and r.copies in (0, 1, 2)
        total[r.source] = total.get(r.source, 0) + r.size
    goal = brute.targets(total)
    assert all(r.source_size == total[r.source] and r.target == pytest.approx(goal[r.source]) for r in rows)
    assert mixing.apply_mix(odd).count() == sum(r.copies for r in rows)


def test_mixing_meets_targets_over_many_levels(spark):
    r = random.Random(3)
    docs = [(k, "w " * r.randint(1, 40), "s" + str(min(k % 7, 3))) for k in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.with_mix(df, fan=8).collect()
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.size * r.copies for r in own) - own[0].target) <= 40
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.with_mix(df.repartition(5), fan=8).collect()))


def test_mixing_rounds_without_bias(spark):
    df = spark.createDataFrame([(k, "w " * (1 + k % 9), "ab"[k % 2]) for k in range(40)], "doc_id long, text string, source string")
    taken = {}
    for seed in range(8):
        for r in mixing.with_mix(df, seed=seed).collect():
            taken.setdefault((r.doc_id, r.target / r.source_size), []).append(r.copies)
    means = [np.mean(v) - ratio for (_, ratio), v in taken.items()]
    assert abs(np.mean(means)) < 0.1 and max(map(abs, means)) < 0.8


def test_decontamination(spark, plain, odd, none):
    items = [(1, NEAR), (2, "two"), (3, None), (4, ""), (5, LONG[5000:5400]), (5, "b c"), (None, "one two"), (6, NEAR[200:420].upper())]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    want = brute.decontamination([(r[0], r[1]) for r in ROWS], items)
    for df in (plain, odd):
        rows = decontaminate.decontaminated(df, bench).collect()
        assert len(rows) == df.count()
        for r in rows:
            names = sorted(map(str, r["items"] or []))
            if r.doc_id is not None:
                assert (r.n_words, r.n_hit, len(names)) == want[r.doc_id][:3] and brute.sha(",".join(names)) == want[r.doc_id][3]
    assert decontaminate.decontaminated(none, bench).count() == 0
    assert {r.n_hit for r in decontaminate.decontaminated(plain, bench.where("item_id < 0")).collect()} == {0}


def test_substrings(spark, plain, odd, none):
    want = brute.substrings([(r[0], r[1]) for r in ROWS])
    for df in (plain, odd):
        rows = substrings.without_repeats(df).collect()
        assert len(rows) == df.count()
        assert all((r.n_words, r.n_removed, brute.sha(r.kept_text)) == want[r.doc_id] for r in rows if r.doc_id is not None)
        assert all(r.n_removed == 0 for r in rows if r.doc_id is None)
    assert substrings.without_repeats(none).count() == 0


def test_substrings_that_overlap_and_repeat(spark):
    r = random.Random(8)
    passages = [prose(50 + k, 30).split() for k in range(6)]
    docs = []
    for k in range(120):
        body = []
        for _ in range(r.randint(1, 5)):
            p = passages[r.randrange(6)]
            a = r.randrange(0, 16)
            body += p[a : a + r.randint(8, 30)] + prose(r.random(), r.randint(0, 3)).split()
        docs.append((r.randrange(10**6) * 200 + k, " ".join(body)))
    docs.append((10**9, "ha " * 500))
    docs.append((10**9 + 1, "ha " * 300 + "ho"))
    got = pairs(substrings.without_repeats(spark.createDataFrame(docs, "doc_id long, text string")).withColumn("sha", F.sha2(F.col("kept_text").cast("binary"), 256)), "n_words", "n_removed", "sha")
    assert got == brute.substrings(docs)


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    records = [warc.Capture({"url": warc.safe_url(u), "ip": "10.0.0.1", "date": "20010203040506", "type": "text/html"}, b) for u, b in [("http://a/ b\n", b"HTTP/1.0 200 OK\r\nX: y\r\n\r\nhi"), (None, b""), ("u", b"\n\n1 0 x\n")]]
    got = [r for _, r in warc.arc_records(warc.arc_file("f", records, version))]
    assert [(r.fields["url"], r.body) for r in got] == [(r.fields["url"], r.body) for r in records]
    made = warc.converted(got[0], "f", 7)
    assert made.headers["WARC-Date"] == "2001-02-03T04:05:06Z" and made.headers["WARC-Payload-Digest"] == warc.digest(b"hi")
    (back,) = warc.warc_records(warc.warc_member(made))
    assert back.body == got[0].body and back.headers["WARC-Target-URI"] == "http://a/%20b%0A"
    with pytest.raises(ValueError):
        list(warc.arc_records(b"http://x 0.0.0.0 20010101000000 text/html 99\nshort"))


def test_warc_pages(spark):
    big = "x" * 1500
    rows = [(1, "http://a", big), (2, "http://b", big), (9, None, big), (3, "u v", "small"), (4, "w", "small"), (5, "n", None), (6, "", ""), (7, "l", "é" * 40_000), (8, "d", big + " "), (9, None, big), (None, "q", "nul")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("k"))
    for n in (1 << 20, 1):
        records = warc.read(shared.stored(warc.convert(shared.stored(warc.arc_archives(warc.as_blocks(pages, "page_id", "url", F.col("html")), file_bytes=n), "arc")), "warc"))
        got = sorted(warc.resolved(shared.stored(records, "records")).collect(), key=lambda r: (r.page_id or 0, r.record_type))
        assert len(got) == len(rows)
        kinds = [(r.page_id, r.record_type, r.refers_to) for r in got]
        assert (1, "revisit", 9) in kinds and (2, "revisit", 9) in kinds and (9, "response", None) in kinds and (3, "response", None) in kinds and (8, "response", None) in kinds
        assert {r.payload_bytes for r in got if r.page_id == 7} == {80_000}
    assert warc.read(warc.convert(warc.arc_archives(warc.as_blocks(pages.where("page_id < 0"), "page_id", "url", F.col("html"))))).count() == 0


def test_licence_weights_of_common_words(spark):
    """Words that many documents hold weigh little, so they do not sink a statement that stands among them."""
    common = "this project is distributed under the terms of the you may not use file except in compliance with see txt in root for information"
    lines = {
        "apache": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "mit": "Licensed under the MIT License. See License.txt in the project root for license information.",
        "terms": "This project is distributed under the terms of the MIT license",
        "other": "This project is distributed under the terms of the zorblax agreement",
    }
    rows = [(k, f"{prose(7, 9)}\n{v}\nend") for k, v in lines.items()] + [(f"d{i}", f"{common} {prose(i, 20)}") for i in range(400)]
    df = spark.createDataFrame(rows, "path string, text string")
    got = {r.path: r for r in license_scan.statements(df, license_scan.weigh(df, F.col("text"))).collect()}
    assert {k: (got[k].license, got[k].line) for k in lines} == {"apache": ("Apache-2.0", 1), "mit": ("MIT", 1), "terms": ("MIT", 1), "other": (None, None)}
    assert all(got[f"d{i}"].license is None for i in range(400))

    counts = {}
    for _, text in rows:
        for w in set(brute.PLAIN.findall(brute.fold(text))):
            counts[w] = counts.get(w, 0) + 1
    for key in ("apache", "mit", "terms"):
        assert got[key].score == pytest.approx(brute.unit_score(lines[key], license_scan.all_templates(), counts, len(rows))[1])


def test_licence_headers_and_bodies(spark):
    """Headers, whole licence files without a title and SPDX tags, among documents of other words."""
    whole, notices = license_scan.whole_texts(), license_scan.NOTICES

    def comment(text, mark):
        w = text.split()
        return "\n".join(f"{mark} {' '.join(w[i : i + 11])}" for i in range(0, len(w), 11))

    mit = whole["MIT"].split("\n\n", 1)[1]
    texts = {
        "mit": ("MIT", f"Copyright (c) 2021 Quibble Authors\n\n{mit}", 2),
        "bsd2": ("BSD-2-Clause", f"Copyright (c) 2020, Some One\nAll rights reserved.\n\n{whole['BSD-2-Clause']}", 3),
        "bsd3": ("BSD-3-Clause", f"Copyright (c) 2020, Some One\nAll rights reserved.\n\n{whole['BSD-3-Clause']}", 3),
        "apache": ("Apache-2.0", f"// Copyright 2019 The Blorb Authors\n//\n{comment(notices['Apache-2.0'][0], '//')}\npackage blorb\n{prose(3, 90)}", 2),
        "gpl": ("GPL-3.0", f"#!/bin/sh\n{comment(notices['GPL-3.0'][0], '#')}\n{prose(4, 60)}", None),
        "body": ("GPL-2.0", whole["GPL-2.0"], 0),
        "mpl": ("MPL-2.0", f"/* {notices['MPL-2.0'][0]} */\n\n{prose(5, 60)}", 0),
        "tag": ("GPL-2.0", f"{prose(6, 8)}\n# SPDX-License-Identifier: GPL-2.0-or-later\n{prose(8, 8)}", 1),
        "either": ("MIT", "// SPDX-License-Identifier: (MIT OR Apache-2.0)\nint main;", 0),
        "unknown": (None, f"// SPDX-License-Identifier: Zorblax-9.1\n{prose(9, 20)}", None),
    }
    rows = [(k, v[1]) for k, v in texts.items()] + [(f"d{i}", f"the of to and in is a for this that {prose(i, 40)}") for i in range(300)] + [("null", None), ("empty", "")]
    df = spark.createDataFrame(rows, "path string, text string")
    got = {r.path: r for r in license_scan.statements(df, license_scan.weigh(df, F.col("text"))).collect()}
    assert {k: got[k].license for k in texts} == {k: v[0] for k, v in texts.items()}
    assert {k: got[k].line for k, v in texts.items() if v[2] is not None} == {k: v[2] for k, v in texts.items() if v[2] is not None}
    assert all(r.license is None for k, r in got.items() if k not in texts) and len(got) == len(rows)


def test_licence_weights_of_unknown_words(spark):
    """Words that the counted documents lack weigh most; they do not drop out."""
    known = spark.createDataFrame([(f"d{i}", f"the terms of this {prose(i, 20)}") for i in range(50)], "path string, text string")
    weighed = license_scan.weigh(known, F.col("text"))
    df = spark.createDataFrame([("one", "Zorblax Released under the MIT License"), ("many", "Released under the MIT License " + " ".join(f"zorblax{i}" for i in range(20)))], "path string, text string")
    got = {r.path: r for r in license_scan.statements(df, weighed).collect()}
    counts = {}
    for r in known.collect():
        for w in set(brute.PLAIN.findall(brute.fold(r.text))):
            counts[w] = counts.get(w, 0) + 1
    name, score = brute.unit_score("Zorblax Released under the MIT License", license_scan.all_templates(), counts, 50)
    assert (got["one"].license, got["many"].license) == (name, None) and got["one"].score == pytest.approx(score)
