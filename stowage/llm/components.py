"""Connected components of a graph that is given as links between numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import forget, stored


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """node, root (the smallest node of its component) for every node of ``links`` (columns a and b, of one type).

    Large-star and small-star steps alternate until nothing changes: every link is pulled to the smallest neighbour
    of its end, so a round needs aggregations by node (combined before the shuffle) and one equi-join, and never
    gathers a node's neighbours. Each round's links are written to the shared folder, and those
    of the round before are deleted.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pulled = large.join(low, "u")
        small = pulled.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        edges, old = stored(small.distinct()), edges
        forget(old)
    else:
        raise RuntimeError("the components did not settle")
    pointed = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return pointed.unionByName(pointed.select(F.col("root").alias("node"), "root").distinct())
