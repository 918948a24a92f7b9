"""Connected components of a links table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motoquant.llm.store import settle


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of every node on the least of them and the node.

    Minima are combined before the shuffle; the join that hands them out can be split by key.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    hung = pairs.join(least, "u")
    if large:
        hung = hung.filter(F.col("v") > F.col("u")).select(F.col("v").alias("b"), F.col("m").alias("a"))
    else:
        hung = hung.select(F.col("v").alias("b"), F.col("m").alias("a")).unionByName(least.select(F.col("u").alias("b"), F.col("m").alias("a")))
    return hung.filter("a <> b").select("a", "b").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``node`` and ``component``, its least reachable node, for every node with a link.

    ``links`` has columns a and b. Each round is written to the shared folder.
    """
    edges = settle(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    state = _state(edges)
    for _ in range(rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        wide = _star(both, True)
        edges = settle(_star(wide.select(F.col("b").alias("u"), F.col("a").alias("v")), False), "stars")
        before, state = state, _state(edges)
        if state == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
                edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
            )
    raise RuntimeError("components did not settle")
