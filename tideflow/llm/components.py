"""Connected components by alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideflow.llm._shared import drop_scratch, materialize

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each node's larger neighbours to the smallest node around it."""
    low = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
    return edges.join(low, "v", "left").select("u", F.coalesce("m", "v").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the smallest of these."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    out = edges.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return out.where("u != v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node is a root, or linked to a root and to nothing else."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e"))
    torn = ends.groupBy("e.node").agg(F.count("*").alias("links"), F.sum("e.up").alias("ups")).where("ups > 0 AND links > 1")
    return torn.agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for the nodes of ``edges`` (u, v: long, no nulls): root is the smallest node reachable.

    Edges always lead down, from u to a smaller v, so each is shuffled once in a half-round: two shuffles
    of the edges and one of their ends' minima, whose number does not grow; rounds grow with the
    logarithm of the largest distance, and end as soon as only stars are left. Every round is written to
    the shared folder, so a lost executor costs at most one round.
    """
    state = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), f"{name}0")
    for k in range(1, MAX_ROUNDS):
        if _settled(state):
            break
        after = materialize(_small_star(_large_star(state)), f"{name}{k}")
        drop_scratch(state)
        state = after
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    nodes = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
