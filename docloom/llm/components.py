"""Connected components of a link table: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.stage import materialize


def _state(edges: DataFrame) -> tuple[int, int]:
    """Number and checksum of the links: two numbers, equal when a round has changed nothing."""
    row = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
    return int(row[0]), int(row[1])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang every node's larger (or, with itself, smaller) neighbours on its smallest one."""
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = near.join(least, "a").where("b > a").select(F.col("b"), F.col("m").alias("a"))
    else:
        # links point from the larger node to the smaller one
        near = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
        least = near.groupBy("a").agg(F.min("b").alias("m"))
        out = near.join(least, "a").select(F.col("b"), F.col("m").alias("a")).unionByName(
            least.select(F.col("a").alias("b"), F.col("m").alias("a")))
    return out.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that each linked node can reach.

    Nodes without a link do not appear; null ends and loops are ignored. Each round is written to
    the shared checkpoint folder, so that a lost executor costs one round at most; the driver sees
    two numbers a round. Rounds grow with the logarithm of the longest chain.
    """
    edges = materialize(links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
                        .where("a <> b").distinct(), "links")
    before = _state(edges)
    while before[0]:
        edges = materialize(_star(_star(edges, True), False), "links")
        now = _state(edges)
        if now == before:
            break
        before = now
    # stars now: every link leads to the root
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
