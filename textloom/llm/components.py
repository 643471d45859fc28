"""Connected components of a link table by alternating stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import stored


def _towards_smaller(edges: DataFrame, u: str, v: str) -> DataFrame:
    return edges.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).where("a <> b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the node's smallest neighbour."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _towards_smaller(both.where("v > u").join(least, "u"), "v", "m")


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = _towards_smaller(edges.join(least, "a"), "b", "m")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node with a link to another; the component is its smallest node.

    Links may repeat, run either way, or be loops; rows with a null end link nothing. Each round costs two groupings
    that combine before their shuffle and two joins; a node with very many links is split by the skew join. The number
    of rounds grows with the logarithm of the longest path.
    """
    known = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    current = stored(_towards_smaller(known.select(F.col(a).alias("x"), F.col(b).alias("y")), "x", "y"), "links")
    before, state = None, _state(current)
    while state != before and state[0]:
        current = stored(_small_star(_large_star(current)), "links")
        before, state = state, _state(current)
    stars = current.groupBy("a").agg(F.min("b").alias("b"))
    roots = current.select(F.col("b").alias("node")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
