"""Connected components of an edge table, distributed: large-star and small-star steps until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import attached, checkpointed

#: Edges that one task can take, so that no node need be looked for that has a large part of them.
ROOM = 1_000_000


def _met(edges: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """Each edge's b as a, with what least has for its a as b."""
    rows = attached(edges, least, "a") if n > ROOM else edges.join(least, "a")
    return rows.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Each node links its larger neighbours to the least of its neighbourhood."""
    up = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    least = up.union(up.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
    out = _met(up, least, n).distinct()
    return checkpointed(out) if n > ROOM else out


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Each node links its smaller neighbours, and itself, to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return _met(down, least, n).union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b), a != b; root is the least node of its component and has no row itself.

    Work and state stay in DataFrames; the driver sees a count, a checksum and the bounded number of hot nodes a round. Rounds grow with the logarithm of the
    largest component, squared at worst.
    """
    before, edges = None, checkpointed(edges.distinct())
    while True:
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after[0] == 0 or after == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before, edges = after, checkpointed(_small_star(_large_star(edges, after[0]), after[0]))
