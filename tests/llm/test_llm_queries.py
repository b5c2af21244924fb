"""The registered queries on the smallest tables, against SQL twins or brute-force versions."""

import os

import oracle_check
import pytest

import brute
import corpus_pipeline
from corpuslane.llm import license_scan
from corpuslane.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text, r.source, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(SQL))
def test_twins(spark, name):
    message, good = oracle_check.compare(spark, oracle_check.connect(SF), SF, name, QUERIES[name], SQL[name])
    assert good, message


def by_id(df, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) for r in df.collect()}


def test_near_duplicates(spark, docs):
    got = by_id(QUERIES["op2_near_duplicates"](spark, SF), "n_shingles", "component_id", "kept")
    assert got == brute.near_duplicates([d[:2] for d in docs])


def test_decontamination(spark, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = by_id(QUERIES["op8_decontamination"](spark, SF), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == brute.decontamination([d[:2] for d in docs], items)


def test_substrings(spark, docs):
    got = by_id(QUERIES["op9_substring_dedup"](spark, SF), "n_words", "n_removed", "kept_sha256")
    assert got == brute.substrings([d[:2] for d in docs])


def test_secrets(spark, docs):
    got = by_id(QUERIES["op6_secret_scan"](spark, SF), "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    for i, text, *_ in docs:
        base = brute.base_secrets(text)
        counts = [sum(s.startswith(k) for s in base) for k in ("assign:", "access:", "hex:")]
        assert got[i][:4] == (*counts, brute.sha(",".join(base)))
        assert [s for s in got[i][4].split(",") if s and not s.startswith("random")] == base


def test_sharding(spark, docs):
    rows = QUERIES["op1_sharding"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(d[0] for d in docs)
    text = {d[0]: d[1] for d in docs}
    assert all(r.size == len((text[r.doc_id] or "").encode()) + 1 and r.text_crc32 == brute.crc(text[r.doc_id]) for r in rows)
    assert all(r.law == "rows" and r.grown_shard is None for r in rows)
    check_shards(rows, 8)


def check_shards(rows, n):
    counts = [sorted(r.slot for r in rows if r.shard == k) for k in range(n)]
    assert all(c == list(range(len(c))) for c in counts)
    assert max(map(len, counts)) - min(map(len, counts)) <= 1
    for source in {r.source for r in rows}:
        own = [sum(r.source == source and r.shard == k for r in rows) for k in range(n)]
        assert max(own) - min(own) <= 3


def test_mixing(spark, docs):
    rows = QUERIES["op7_mixing"](spark, SF).collect()
    size = {d[0]: len(brute.BLANK.findall(d[1] or "")) for d in docs}
    total, largest = {}, {}
    for i, _, source, _ in docs:
        total[source] = total.get(source, 0) + size[i]
        largest[source] = max(largest.get(source, 0), size[i])
    goal = brute.targets(total)
    assert sorted(r.doc_id for r in rows) == sorted(size)
    taken = dict.fromkeys(total, 0)
    for r in rows:
        assert r.size == size[r.doc_id] and r.source_size == total[r.source] and r.target == pytest.approx(goal[r.source])
        assert r.taken <= 2 * r.size and r.taken % max(r.size, 1) == 0
        taken[r.source] += r.taken
    assert all(abs(taken[s] - goal[s]) <= largest[s] for s in total)
    assert rows_of(QUERIES["op7_mixing"](spark, SF)) == sorted(map(tuple, rows))


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_languages(spark, docs):
    got = by_id(QUERIES["op5_language_id"](spark, SF), "held_out", "lang_pred", "score")
    import zlib

    assert all(got[i][0] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, *_ in docs)
    held = [(got[i][1], lang) for i, _, _, lang in docs if got[i][0] and lang]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert all(0 <= s <= 1 for _, _, s in got.values())


def test_licences(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op4_license_scan"](spark, SF).collect()}
    df = {}
    for _, text, *_ in docs:
        for w in set(brute.PLAIN.findall(brute.fold(text))):
            df[w] = df.get(w, 0) + 1
    own = {}
    for i, text, *_ in docs:
        best = None
        for k, line in enumerate((text or "").split("\n")):
            if brute.PLAIN.search(brute.fold(line)):
                name, score = brute.line_score(line, license_scan.TEMPLATES, df, len(docs))
                if score >= license_scan.LEAST and (best is None or score > best[1] + 1e-12):
                    best = (name, score, k)
        own[i] = best
    speaks = {}
    for i, best in own.items():
        path = got[i].path
        if best and best[2] < 3:
            d = path.rsplit("/", 1)[0]
            speaks[d] = min(speaks.get(d, (9, "", "")), (-best[1], path, best[0]))
    for i, best in own.items():
        r = got[i]
        if best:
            assert (r.origin, r.license, r.line) == ("own", best[0], best[2]) and r.score == pytest.approx(best[1])
            continue
        d = r.path.rsplit("/", 1)[0]
        while d and d not in speaks:
            d = d.rpartition("/")[0]
        assert (r.origin, r.from_dir, r.license) == (("inherited", d, speaks[d][2]) if d else ("none", None, None))


def test_pipeline(spark, docs):
    docs_df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = corpus_pipeline.run(spark, SF).collect()
    check_shards(rows, corpus_pipeline.SHARDS)
    # language keeps every text with letters here; the next two stages by brute force
    near = brute.near_duplicates([d[:2] for d in docs])
    kept = [(i, t) for i, t, *_ in docs if near[i][2]]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {i for i, v in brute.decontamination(kept, items).items() if not v[4]}
    size = {d[0]: len(brute.BLANK.findall(d[1] or "")) for d in docs}
    source = {d[0]: d[2] for d in docs}
    total = {}
    for i in clean:
        total[source[i]] = total.get(source[i], 0) + size[i]
    goal, taken = brute.targets(total), {}
    assert {r.doc_id for r in rows} <= clean
    for r in rows:
        taken[r.source] = taken.get(r.source, 0) + size[r.doc_id]
    for s in total:
        assert abs(taken.get(s, 0) - goal[s]) <= max(size[i] for i in clean if source[i] == s)
    assert set(docs_df.columns) <= set(corpus_pipeline.run(spark, SF).columns)
