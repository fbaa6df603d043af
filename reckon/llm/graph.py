"""Connected components of a graph given as a table of links, by rounds of joins.

Each round joins every link's smaller end to the neighbours of its larger end (large star), then
ties the smaller neighbours of each node to their least one (small star). Both steps keep the
components and only lessen the ends, so the links become stars around each component's least node;
that takes about log2 of the longest path rounds. Nothing but one number a round comes to the
driver. Each round is written to the shared folder, so lineage stays short and a lost executor
costs no more than a round. Nodes of more than HOT links, of which there are at most 2 / HOT of the
links' number (the roots of large components), are met by broadcast, so no task gathers their links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckon.llm.common import meet, through_store

HOT = 100_000


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and root (the least node of its component) for each node of links (a, b: of one ordered
    type). Loops, repeats and null ends of links are without effect; no links give no rows."""
    two = links.where("a is not null and b is not null and a <> b")
    now = through_store(two.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "links")
    hot = f"d > {HOT}"
    for _ in range(most_rounds):
        # large star: of each node's neighbours with itself the least, for the larger neighbours
        both = now.union(now.select(F.col("u"), F.col("v")).toDF("v", "u"))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"), F.count("*").alias("d"))
        large = meet(both.where("u > v"), least, "v", hot).select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        # small star: a node and its smaller neighbours to the least of them
        least = large.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("d"))
        tied = meet(large, least, "v", hot).where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        new = through_store(tied.union(least.select("v", F.col("m").alias("u"))).distinct(), "links")
        # stars are reached when no node is both a root and below another
        if new.join(new.select(F.col("v").alias("w")), new["u"] == F.col("w"), "left_semi").isEmpty() and new.groupBy("v").count().where("count > 1").isEmpty():
            now = new
            break
        now = new
    else:
        raise RuntimeError(f"components not settled after {most_rounds} rounds")
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).union(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
