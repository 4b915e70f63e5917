"""Connected components of an edge table, by alternating large and small stars.

Every round is two joins with per-node minima, and each is stored in the shared
folder, so lineage stays short and no part of the graph reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprobe.session import materialize

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("hi", "lo").unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    least = both.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m"))
    return both.join(least, "hi").filter("lo > hi").select(
        F.col("lo").alias("hi"), F.col("m").alias("lo")).filter("hi > lo").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    joined = edges.join(least, "hi")
    return (
        joined.select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        .unionByName(least.select("hi", F.col("m").alias("lo")))
        .filter("hi > lo").distinct())


def _state(edges: DataFrame) -> tuple[int, int]:
    seen = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
    return seen[0], seen[1]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (lo < hi) but the roots, the smallest of each component."""
    now = materialize(edges.select("hi", "lo"), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        state = _state(now)
        if state == before or not state[0]:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        before = state
        now = materialize(_small_star(materialize(_large_star(now), "large-star")), "small-star")
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
