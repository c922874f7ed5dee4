"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import cut


def _steps(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step on edges ``u > v``."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    lowest = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(lowest, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
    return small.select("e.u", "e.v").where("u <> v").distinct()


def components(edges: DataFrame, name: str = "components", most_rounds: int = 100) -> DataFrame:
    """``(node, root)`` for each node of ``edges`` (columns ``a``, ``b``, longs); the root is the least node.

    Nothing is gathered on the driver but a row count and a checksum a round.
    """
    sign = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    before = sign(now)
    for _ in range(most_rounds):
        now = cut(_steps(now), name)
        after = sign(now)
        if after == before:
            roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
        before = after
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
