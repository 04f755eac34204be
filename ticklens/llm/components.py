"""Connected components of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklens.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in `links` (a, b); the component is its smallest id.

    Alternates large-star and small-star rounds: in each, nodes link to the smallest id around
    them. Rounds grow with the logarithm of the longest path. A node's neighbours are only
    counted and minimised, never gathered.
    """
    edges = stored(_edges(links.select("a", "b")), "links")
    before = None
    while (now := _digest(edges)) != before:
        before = now
        edges = stored(_small_star(_large_star(edges)), "links")
    ids = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component"))
    return ids.union(roots).groupBy("id").agg(F.min("component").alias("component"))


def _digest(edges: DataFrame):
    """Equal for equal sets of links."""
    head = F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))
    return tuple(edges.agg(*head).first())


def _edges(pairs: DataFrame) -> DataFrame:
    """Each link once, from the larger to the smaller id."""
    return (
        pairs.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node move to the smallest id among it and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _edges(moved)


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and the node, move to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _edges(moved.union(least.select("a", F.col("m").alias("b"))))
