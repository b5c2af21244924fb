"""Cases of the projections of the review of round 3."""

import random

from pyspark.sql import functions as F

from corpuslane.functions import text as X
from corpuslane.operators import lines as N
from corpuslane.plans import catalog
from corpuslane.plans import citations as W
from corpuslane.plans import streams as S
from corpuslane.session import Tables

SF = "/root/testdata/sf0.001"

PIECES = [
    "a", "Word", "Größe", "Σίγμας", "İki", "ß", "7", "½", "٣", "漢字", "é", "_", "__", "*", "**", "|", " | ", ":--", "---", ">", "> ", "- ", "1. ", "12) ", "# ", "[x] ",
    "[a](b)", "[a b](c d)", "[", "](", "<details>", "</summary>", "<", "\t", " ", "  ", " ", " ", "\u0085", "\r", "　", "﻿", "©", "→", "👍", "️", "‍", "“q”", "it's", "’", '"', ".", ",",
]


def test_lines_read_in_arrow_equal_the_expressions(spark):
    draw = random.Random(3)
    rows = ["".join(draw.choice(PIECES) for _ in range(draw.randint(0, 9))) for _ in range(6000)] + [None, "| a | b |\r", "|--|:-:|", "|a|\u0085", "> | x |"]
    df = spark.createDataFrame([(r,) for r in rows], "raw string").withColumn("was", X.display_line("raw")).withColumn("was_key", X.match_key("was"))
    got = df.withColumn("now", N.readable("raw")).select("raw", "was", "was_key", "now.*")
    assert got.filter(~(F.col("was").eqNullSafe(F.col("display")) & F.col("was_key").eqNullSafe(F.col("key")))).collect() == []


def test_line_table_holds_what_its_query_reads(spark, monkeypatch):
    written = []
    write = W.materialize
    monkeypatch.setattr(W, "materialize", lambda df, name: written.append(set(df.columns)) or write(df, name))
    for name, more in {"find_exact": set(), "bigram_overlap": set(), "expand_quotes": {"display", "quoted", "table"}}.items():
        catalog.queries()[name](spark, SF)
        assert written.pop() == {"file", "line", "key"} | more


def test_deltas_are_dealt_over_all_partitions(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        files = spark.read.json(S.delta_path(Tables(spark, SF)), schema="conv_id bigint").select(F.input_file_name()).distinct().count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert files > 8
