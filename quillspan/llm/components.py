"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.scratch import Scratch


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """Each (u, v) with the least v of its u. The minimum is summed up before the
    shuffle and joined back, so that the edges of a hot node stay divisible."""
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")


def large_star(edges: DataFrame) -> DataFrame:
    """Connect every larger neighbour of a node to the node's least neighbour (itself included)."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = _least_neighbour(both).where("v > u")
    return joined.select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Connect every node and its smaller neighbours to the least of them. Edges have u > v."""
    joined = _least_neighbour(edges)
    hang = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hang.unionByName(joined.select("u", F.col("m").alias("v"))).distinct()


def unsettled(edges: DataFrame) -> DataFrame:
    """Nodes that hang on two others, or on one while others hang on them: none once all is stars."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("n")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("n")))
    seen = ends.groupBy("x").agg(F.sum("n").alias("n"), F.min("n").alias("least"))
    return seen.where("n > 1 or (n = 1 and least = 0)")


def components(edges: DataFrame, scratch: Scratch, name: str = "cc", rounds: int = 60) -> DataFrame:
    """(u, v) for every node u with an edge that isn't its component's least node v.

    ``edges`` has long columns u and v in any direction; loops and repeats are harmless,
    rows with a null end are dropped. An empty table gives an empty table. Each round is
    written to the shared folder; only whether nodes are unsettled reaches the driver."""
    now = scratch.keep(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}0")
    for i in range(1, rounds + 1):
        now = scratch.keep(small_star(large_star(now)), f"{name}{i}")
        scratch.drop(f"{name}{i - 1}")
        if unsettled(now).isEmpty():
            return now
    raise RuntimeError(f"components have not settled in {rounds} rounds")
