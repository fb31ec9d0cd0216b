"""Connected components of an edge table by alternating large-star and small-star steps.

Both steps join edges with each node's smallest neighbour, which is aggregated map-side first; no node's neighbours are
ever collected, so a hub is no problem. The number of rounds grows with the logarithm of the longest path. Every round is
written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphkiln.llm.common import discard, materialize

MAX_ROUNDS = 60


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("h")).first()
    return row["n"], row["h"] or 0


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges``: (u, v) with u > v, distinct."""
    near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = near.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    linked = near.filter("v > u") if large else edges
    moved = linked.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter("u > v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id in an edge; the component is its smallest id. Edges with a null end and loops are ignored."""
    known = F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    edges = edges.filter(known).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = materialize(edges.distinct(), "edges")
    state = _state(edges)
    for _ in range(MAX_ROUNDS if state[0] else 0):
        old, edges = edges, materialize(_star(_star(edges, True), False), "stars")
        discard(old)
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        if state[0]:
            raise RuntimeError("components did not settle")
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("id"), "component").distinct())
