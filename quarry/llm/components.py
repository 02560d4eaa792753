"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.scratch import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges (u, v) with u > v.  Hooks neighbours to the smallest of a node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")) if large else both.groupBy("u").agg(F.min("v").alias("m"))
    pairs = both.join(least, "u")
    if large:
        return pairs.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    hooked = pairs.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hooked.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """node -> the smallest node of its component, for all nodes that an edge (a, b) of two nodes names.

    Tables written in the shared folder cut the lineage after each round; a round's table goes once the next is there.
    """
    cur = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    cur, last, k = scratch.keep(cur, f"{name}0"), None, 0
    while True:
        state = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == last or state["n"] == 0:
            break
        last, k = state, k + 1
        nxt = scratch.keep(_star(_star(cur, True), False), f"{name}{k}")
        if k > 1:
            scratch.drop(f"{name}{k - 1}")
        cur = nxt
    scratch.drop(*[f"{name}0"] * (k > 0))
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
