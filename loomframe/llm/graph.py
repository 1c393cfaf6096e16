"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, sized

#: Edges that one task writes in a round, and is asked for by a round of few edges.
EDGES_EACH = 100_000


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of an edge, the component being its smallest node.

    ``edges`` has two bigint columns. Each round turns every node's neighbours to the smallest of them, larger ones
    first, then smaller ones; minima are pre-aggregated and joined back, so that a hub is split like any skewed key.
    Null ends and loops are left out; an empty edge table gives an empty result. Each round is written to the shared
    folder and the one before deleted; their number grows with the logarithm of the number of edges.
    """
    a, b = edges.columns
    first = _ordered(edges.select(F.col(a).alias("u"), F.col(b).alias("v")))
    now = materialize(sized(first, edges.count(), EDGES_EACH), "edges")
    for _ in range(rounds):
        if _are_stars(now):
            ends = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(ends)
        before, now = now, materialize(sized(_small_star(_large_star(now)), now.count(), EDGES_EACH), "edges")
        discard(before)
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _ordered(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger to its smaller end."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller one, and no such smaller node has one itself."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("v", F.lit(0), F.lit(1)))
    roles = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return roles.where("down > 1 or (down > 0 and up > 0)").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("c", "m").alias("m"))
    return both.join(least, both.u == least.c).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges go from larger to smaller ends, so a node's smaller neighbours are where its edges go."""
    least = edges.groupBy("u").agg(F.min("v").alias("v"))
    best = least.select(F.col("u").alias("c"), F.col("v").alias("m"))
    turned = edges.join(best, edges.u == best.c).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return turned.union(least).distinct()
