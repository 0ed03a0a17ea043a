"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgauge.session import settle


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    """``(u, m)``, written, so that the join with it can be split where one node has very many neighbours."""
    return settle(pairs.groupBy("u").agg(F.min("v").alias("m")), "least-neighbours")


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest of its neighbourhood."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = _least_neighbour(both).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least.hint("merge"), "u").select(F.col("m").alias("a"), F.col("v").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours and itself to the smallest of them. Edges have a < b."""
    down = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = _least_neighbour(down)
    moved = down.join(least.hint("merge"), "u").where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return moved.unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of ``edges`` (a, b), a < b; the component is its smallest node.

    Each round is written before the next one. It has ended when a round changes nothing, which shows in
    the number and a checksum of the edges.
    """
    def state(df):
        row = df.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
        return row.n, row.x

    before, current = None, edges
    now = state(current)
    while now != before and now[0]:
        current = settle(_small_star(_large_star(current).distinct()).distinct(), "components")
        before, now = now, state(current)
    return current.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        current.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )
