"""Connected components of a links table, by alternating large-star and small-star steps.

Each step is a group minimum and an equi-join, so a node with very many links is pre-aggregated
and its join may be split by adaptive execution; nothing is collected but one count a round.
Tables written to the shared folder cut the lineage after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmill.llm.common import drop_shared, shared_table


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> node, root: root is the smallest node that links reach from node.

    Null ends and loops are left out; repeated links count once; no links, no rows.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = shared_table(edges, "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        # Large star: each larger neighbour moves to the smallest of the group.
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: each node and its smaller neighbours move to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = shared_table(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        same = after.count() == edges.count() and after.join(edges, ["u", "v"], "left_anti").isEmpty()
        drop_shared(edges.sparkSession, edges)
        edges = after
        if same:
            break
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
