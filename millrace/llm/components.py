"""Connected components by large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import Scratch


def unsettled(edges: DataFrame) -> Row:
    """n: the edges; open: nodes that have several parents, or a parent and a child. With none open all are stars."""
    child, parent = F.col("c").alias("x"), F.col("p").alias("x")
    roles = edges.select(child, F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(parent, F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = roles.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.agg(F.coalesce(F.sum("up"), F.lit(0)).alias("n"), F.count(F.when(F.expr("up > 1 or up > 0 and down > 0"), 1)).alias("open")).first()


def connected(edges: DataFrame, scratch: Scratch, name: str = "cc", most_rounds: int = 60, most_edges: int | None = None) -> DataFrame:
    """(node, component) for each node of `edges` (columns u, v of type long); component is the smallest node reached.

    Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Each round is written to the scratch folder,
    so lineage stays short and a lost executor costs at most a round. A node's neighbours are never gathered: their
    minimum is a partial aggregate. It is written before it is joined back, so that both sides of the join come from
    plain shuffles and the rows of a hub (the least node of a large component) can be split over tasks. The rounds end
    when every edge leads from a root to a leaf of one parent, which is checked on the edges themselves. Self loops
    and nulls link nothing, and an empty table gives an empty result. most_edges: a bound of the rows of `edges`, if known.
    """
    now = scratch.save(edges.where("u is not null and v is not null and u <> v").select(F.least("u", "v").alias("p"), F.greatest("u", "v").alias("c")).distinct(), f"{name}0", most_edges)
    for k in range(1, most_rounds):
        seen = unsettled(now)
        if not seen.open:
            break
        both = now.select(F.col("p").alias("u"), F.col("c").alias("v")).unionByName(now.select(F.col("c").alias("u"), F.col("p").alias("v")))
        least = scratch.save(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), f"{name}{k}least", 2 * seen.n)
        large = scratch.save(both.where("v > u").join(least, "u").select(F.col("m").alias("p"), F.col("v").alias("c")).distinct(), f"{name}{k}large", seen.n)
        parent = scratch.save(large.groupBy("c").agg(F.min("p").alias("m")), f"{name}{k}parent", seen.n)
        small = large.join(parent, "c").select(F.col("m").alias("p"), F.when(F.col("p") == F.col("m"), F.col("c")).otherwise(F.col("p")).alias("c"))
        now = scratch.save(small.where("p <> c").distinct(), f"{name}{k}", seen.n)
        for part in (f"{name}{k - 1}", f"{name}{k}least", f"{name}{k}large", f"{name}{k}parent"):
            scratch.drop(part)
    else:
        raise RuntimeError(f"the components did not settle in {most_rounds} rounds")
    return now.select(F.col("c").alias("node"), F.col("p").alias("component")).unionByName(now.select(F.col("p").alias("node"), F.col("p").alias("component")).distinct())
