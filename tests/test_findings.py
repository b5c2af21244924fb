"""Cases of the review of round 3."""

import os
import shutil

from corpuslane.operators import routing as G
from corpuslane.plans import catalog
from corpuslane.sources import directory as D

SF = "/root/testdata/sf0.001"


def tables_with(spark, tmp_path, **changed):
    """The smallest tables, with some of them written anew as folders of parts."""
    for f in os.listdir(SF):
        if f.removesuffix(".parquet") not in changed:
            shutil.copy(f"{SF}/{f}", tmp_path / f)
    for name, df in changed.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_streams_read_a_table_of_many_parts(spark, tmp_path):
    q = catalog.queries()
    docs, events = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "events"))
    sf = tables_with(spark, tmp_path, documents=docs.repartition(3), events=events.repartition(3))
    assert sorted(q["screen_stream"](spark, sf).collect()) == sorted(q["screen_stream"](spark, SF).collect()) != []
    assert q["dedupe_stream"](spark, sf).count() == events.count() > 0


def test_match_owners_keeps_pairs_below_the_floor(spark):
    scores = [r["score"] for r in catalog.queries()["match_owners"](spark, SF).collect()]
    assert min(scores) < 0.8 <= max(scores)


def test_each_topic_and_message_is_read_once(spark, monkeypatch):
    """A thousand people with one topic make one comparison; one message that they share is searched once."""
    compared, searched = [], []
    overlap, redact = G.topic_overlap, G.redact_names
    monkeypatch.setattr(G, "topic_overlap", lambda a, b, on=None: compared.append(a.count()) or overlap(a, b, on))
    monkeypatch.setattr(G, "redact_names", lambda df, names, text: searched.append(df.count()) or redact(df, names, text))
    schema = "person bigint, name string, title string, department string, backup string, routing_departments array<string>, owns array<string>, out_of_scope array<struct<topic:string,targets:array<string>>>"
    people = spark.range(1000).selectExpr("id", "concat('Ana', id)").rdd.map(lambda r: (r[0], r[1], "Lead", "Ops", "", ["R"], ["claim audit forms"], [("refund checks", ["desk"])])).toDF(schema)
    departments = spark.createDataFrame([("R", [], [("claim audit", "Q")]), ("Q", [], [])], "department string, aliases array<string>, exclusions array<struct<topic:string,target:string>>")
    found = G.check_directory(people, departments)
    levels = {r["level"]: r["count"] for r in found.groupBy("level").count().collect()}
    assert levels == {"reference": 1000, "conflict": 1000, "gap": 1000}
    assert max(compared) == 1 and searched == [3]


def test_departments_named_reads_no_person(spark, monkeypatch):
    monkeypatch.setattr(D, "parse_directory", None)
    assert catalog.queries()["departments_named"](spark, SF).count() > 0
