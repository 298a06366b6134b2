"""Connected components of a table of links, by contraction in rounds.

In each round every node joins whichever of itself and its neighbours has the smallest
hash of the round, and the links are redrawn between the nodes that were joined.  The
expected number of nodes with links shrinks by a constant factor per round, also along
chains and around hubs.  The minimum over the neighbours is aggregated ahead of its
shuffle, so a hub sends one row per task; no task holds the links of a node.  Rounds
are cut off by tables in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.scratch import stage


def _ordered(links: DataFrame) -> DataFrame:
    return links.where("u <> v").select(
        F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``links(u BIGINT, v BIGINT)`` that has one.

    Nodes are in the same component exactly if their roots are equal; a root is one of
    them.  Rows with a NULL and loops are ignored.
    """
    live = stage(_ordered(links), "links")
    rounds: list[DataFrame] = []
    while not live.isEmpty():
        at = F.lit(len(rounds))
        both = live.union(live.select("v", "u"))
        best = both.groupBy("u").agg(
            F.min(F.struct(F.xxhash64("v", at).alias("rank"), F.col("v").alias("to"))).alias("best"))
        joined = stage(best.select(
            F.col("u").alias("node"),
            F.when(F.col("best.rank") < F.xxhash64("u", at), F.col("best.to"))
            .otherwise(F.col("u")).alias("root")), "joined")
        rounds.append(joined)
        a = joined.withColumnsRenamed({"node": "u", "root": "ru"})
        b = joined.withColumnsRenamed({"node": "v", "root": "rv"})
        live = stage(_ordered(live.join(a, "u").join(b, "v").select(
            F.col("ru").alias("u"), F.col("rv").alias("v"))), "links")
    if not rounds:
        return live.select(F.col("u").alias("node"), F.col("v").alias("root"))
    found = rounds[-1]
    for joined in reversed(rounds[:-1]):
        later = found.select(F.col("node").alias("root"), F.col("root").alias("last"))
        found = stage(joined.join(later, "root", "left").select(
            "node", F.coalesce("last", "root").alias("root")), "found")
    return found
