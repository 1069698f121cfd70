"""Connected components by alternating stars, each round a few joins and a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import drop_written, written


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long). node and component, the smallest node it reaches, for every node of a link that is not its own component.

    A round hangs each node's larger neighbours under its smallest one, then each node's smaller neighbours under the
    smallest; rounds go on until nothing changes, about as many as the logarithm of the longest path. Null ends link with
    nothing; without links there is no row.
    """
    edges = written(links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _mark(edges)
    while before[0]:
        earlier, edges = edges, written(_small(_large(edges)))
        now = _mark(edges)
        drop_written(earlier)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large(edges: DataFrame) -> DataFrame:
    """Edges a > b: every neighbour above a node is hung under the node's smallest neighbour, or under the node if that is smaller.

    Only nodes with a smaller neighbour hand their larger ones on; the centre of a star has none, so its many edges meet
    a table that it is not in, and which gets small as rounds go on.
    """
    both = edges.select(F.col("b").alias("node"), F.col("a").alias("other")).unionByName(
        edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
    )
    least = both.groupBy("node").agg(F.min("other").alias("low")).filter("low < node")
    up = edges.select(F.col("b").alias("node"), F.col("a").alias("other"))
    return up.join(least, "node", "left").select(F.col("other").alias("a"), F.coalesce("low", "node").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """Edges a > b: a and its smaller neighbours are hung under the smallest of them; with one there is nothing to do."""
    least = edges.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"))
    moved = edges.join(least.filter("low < high").select("a", "low"), "a").filter("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(least.select("a", F.col("low").alias("b"))).distinct()
