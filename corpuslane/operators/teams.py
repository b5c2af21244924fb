"""Team structures as text: teams with their functions, handoffs and outside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslane.functions import lexicon as L


def _covers(name: str, covers: str, aliases: str) -> Column:
    also = F.when(F.size(aliases) > 0, F.concat(F.lit(" Also called: "), F.array_join(aliases, ", "), F.lit("."))).otherwise("")
    return F.concat(F.lit("- "), F.col(name), F.lit(": "), F.col(covers), F.lit("."), also)


def team_structure(functions: DataFrame, handoffs: DataFrame, outside: DataFrame, key: str, ceiling: int = L.TEAM_STRUCTURE_CHARS) -> DataFrame:
    """``key, structure, chars, over``: a text per key, with one block a team, then handoffs and outside groups.

    ``functions(key, team_ord, team, purpose, ord, name, covers, aliases)`` has a row with a null name for a team without
    functions; ``handoffs(key, ord, sender, receiver, criterion)``; ``outside(key, ord, name, covers, aliases, team, fn)``.
    Blocks without rows are left out. Lines of all three meet in one shuffle, and a line brings its block's heading along,
    shown where the block begins. ``over`` tells whether the text exceeds the ceiling, which no text is cut to.
    """
    line = lambda df, block, order, head, text: df.select(
        key, F.struct(F.lit(block).alias("block"), order.alias("team"), F.col("ord").cast("bigint").alias("ord"), head.alias("head"), text.alias("line")).alias("l")
    )
    none = F.lit(0).cast("bigint")
    lines = (
        line(functions, 0, F.col("team_ord").cast("bigint"), F.concat("team", F.lit(" team: "), "purpose", F.lit(".")), _covers("name", "covers", "aliases"))
        .unionByName(line(handoffs, 1, none, F.lit(L.HANDOFFS_HEADING), F.concat(F.lit("- "), "sender", F.lit(" to "), "receiver", F.lit(": "), "criterion", F.lit("."))))
        .unionByName(line(outside, 2, none, F.lit(L.OUTSIDE_HEADING), F.concat(
            _covers("name", "covers", "aliases"), F.lit(" Operations contact: "), "team", F.lit(" team, "), "fn", F.lit(" function."))))
    )
    per = lines.groupBy(key).agg(F.array_sort(F.collect_list("l")).alias("_l"))

    def shown(x: Column, i: Column) -> Column:
        before = F.get("_l", i - 1)
        opens = (i == 0) | (before["block"] != x["block"]) | (before["team"] != x["team"])
        lead = F.when(i > 0, "\n").otherwise("")
        return F.when(opens, F.concat_ws("\n", F.concat(lead, x["head"]), x["line"])).otherwise(x["line"])

    text = per.select(key, F.array_join(F.transform("_l", shown), "\n").alias("structure"))
    chars = F.char_length("structure").cast("bigint")
    return text.select(key, "structure", chars.alias("chars"), (chars > ceiling).alias("over"))
