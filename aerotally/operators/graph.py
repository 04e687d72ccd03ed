"""GR1 connected components, the building block of MT4, SP13, CL1 and near-duplicate grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from aerotally.plans.storage import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _odd_nodes(edges: DataFrame) -> DataFrame:
    """Nodes that no star has: those with several smaller neighbours, or with smaller and larger ones."""
    sides = edges.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    return sides.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below > 1 or (below = 1 and above = 1)").select("node")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Components of an undirected edge table as ``(node, component)``.

    Alternating large-star and small-star rounds (each a map-side-combined
    ``min`` and one equi-join), every one cut through the shared folder.
    Components that have become a star are set aside after each round, so later
    rounds hold what is still open only. ``component`` is the smallest node of
    the component. Edges with a null end are dropped, self-loops give their node
    as a component of one; an empty table gives an empty result.
    """
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    ends = materialise(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-edges")
    now = ends.where("u <> v")
    stars = None
    for _ in range(max_rounds):
        now = materialise(_small_star(_large_star(now)), "cc-round")
        odd = materialise(_odd_nodes(now), "cc-odd")
        if odd.isEmpty():
            stars = now if stars is None else stars.unionByName(now)
            break
        # a component is a star if neither its root nor a node of it is odd
        dirty = materialise(odd.unionByName(now.join(odd.withColumnRenamed("node", "u"), "u", "left_semi").select(F.col("v").alias("node"))).distinct().withColumnRenamed("node", "v"), "cc-dirty")
        settled = now.join(dirty, "v", "left_anti").select("u", "v")
        stars = settled if stars is None else stars.unionByName(settled)
        now = materialise(now.join(dirty, "v", "left_semi").select("u", "v"), "cc-open")
    else:
        raise RuntimeError(f"connected components did not settle in {max_rounds} rounds")
    found = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component"))
    loops = ends.where("u = v").select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionByName(roots).unionByName(loops).groupBy("node").agg(F.min("component").alias("component"))
