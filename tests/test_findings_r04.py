"""Cases of the review of round 4."""

import duckdb

from corpuslane.llm import alignment
from corpuslane.operators import routing as G
from corpuslane.plans import catalog


def test_alignment_stores_single_documents_and_short_pair_lists(spark, monkeypatch):
    """Readers take thousands of rows at once, so that rows must not grow with the block."""
    held, store = {}, alignment.stored
    monkeypatch.setattr(alignment, "stored", lambda df, name, **o: held.setdefault(name, store(df, name, **o)))
    docs = spark.createDataFrame([(i, f"word{i} of the text number {i}") for i in range(300)] + [(None, None), (301, "")], "doc_id long, text string")
    found = alignment.align(docs.coalesce(1), part=50).collect()
    assert len(found) == 302 and sum(r["n_links"] > 0 for r in found) == 300 == sum(r["n_best"] > 0 for r in found)
    sizes = held["aligned"].selectExpr("count(doc) docs", "max(size(kind)) most", "sum(size(kind)) kinds").first()
    assert sizes["docs"] == 302 and sizes["most"] == 50 and sizes["kinds"] == held["pairs"].count() > 50


def broadcast_scans(df):
    """Scans of people below the broadcasts of a plan, as it is before it runs."""
    found, depth = [], []
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        at = len(line) - len(line.lstrip(" :+-*()0123456789"))
        depth = [d for d in depth if d < at]
        if "BroadcastExchange" in line:
            depth.append(at)
        if depth and "FileScan" in line and "person#" in line.split("]")[0]:
            found.append(line.strip())
    return found


def test_people_are_not_sent_through_the_driver(spark, tmp_path, monkeypatch):
    rows = [(i, f"Ana{i} B", "T", "D", ["R"], [f"work{i} orders"], [("lost work", [f"Ana{i + 1}", "Zone One"])], "Ana1") for i in range(3000)]
    kinds = "person bigint, name string, title string, department string, routing_departments array<string>, owns array<string>, out_of_scope array<struct<topic:string,targets:array<string>>>, backup string"
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/people")
    spark.createDataFrame([("R", ["Zone Two"], [("work3 orders", "Zone One")]), ("S", ["Zone One"], [])], "department string, aliases array<string>, exclusions array<struct<topic:string,target:string>>").write.parquet(f"{tmp_path}/departments")
    write = G.materialize
    monkeypatch.setattr(G, "materialize", lambda df, name: made.append(broadcast_scans(df)) or write(df, name))
    made, was = [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    people, departments = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("people", "departments"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "200k")  # above what their file makes of the columns of people
    try:
        seen = [broadcast_scans(G.expand_backups(people)), broadcast_scans(G.check_directory(people, departments)), *made]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert len(seen) > 6 and not any(seen)


def test_summary_does_not_send_people_through_the_driver(spark, tmp_path):
    spark.createDataFrame([(i, "error" if i % 3 else "note") for i in range(30)], "person bigint, level string").write.parquet(f"{tmp_path}/issues")
    spark.range(40).toDF("person").write.parquet(f"{tmp_path}/people")
    issues, people = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("issues", "people"))
    found = G.issue_summary(issues, people, spark.sql("SELECT 5 AS chars"))
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert (found.first()["usable"], found.first()["errors"]) == (20, 20)


def test_find_quotes_equals_its_sql_where_lines_are_alike_or_hold_addresses(spark, tmp_path):
    words = [f"word{chr(97 + i)}" for i in range(19)]
    linked = "see https://example.org/a-b for the list of forms and their use"
    texts = {1: " ".join(words), 2: " ".join([*words[:9], "other", *words[10:]]), 3: "short\n" + " ".join(words[2:]), 4: linked, 5: "see for the list of forms and their use today"}
    items = {1: " ".join(words), 2: " ".join([*words[:4], "new", *words[4:]]), 3: linked}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = sorted(con.execute(catalog.oracle_sql()["find_quotes"]).fetchall())
    assert sorted(map(tuple, catalog.queries()["find_quotes"](spark, str(tmp_path)).collect())) == want
    assert len({r[5] for r in want}) > 1 and (3, 0, 4, 0, True, 1.0) in want
