"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014).

Every round is two aggregations and two joins on keyed edges, so a hub costs one partial
minimum per task and a join that adaptive execution may split; no group is ever collected.
The driver's memory goes with the tasks of all rounds, so edges are told apart once, at a round's end.
A round ends with one aggregation that looks for a node which is no leaf or center of a star; the
driver sees whether there is one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmatch.functions.storage import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Each neighbour above ``u`` goes to the smallest of ``u`` and its neighbours; edges that go down, repeats among them."""
    both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(down: DataFrame) -> DataFrame:
    """``u`` and its smaller neighbours go to the smallest of those neighbours, for edges that go down; the edge to that one takes ``u``."""
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether edges that go down are stars: no node has two edges down, and none has an edge down and one from above."""
    end = lambda c, down: F.struct(F.col(c).alias("node"), F.lit(down).alias("down"), F.lit(1 - down).alias("up"))
    ends = edges.select(F.explode(F.array(end("u", 1), end("v", 0))).alias("e")).select("e.*")
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return not nodes.agg(F.max(F.expr("down + up > 1 and down > 0"))).first()[0]  # one row, in one job


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` -> ``(node, component)``, the component being its smallest node.

    Only nodes with an edge to another node are returned. Null ends, loops and repeated
    edges are ignored; no edges give no rows.
    """
    state = written(edges.select("u", "v").where("u is not null and v is not null and u <> v"), "edges")
    for _ in range(max_rounds):
        state = written(_small_star(_large_star(state)), "edges")
        if _settled(state):
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = state.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
