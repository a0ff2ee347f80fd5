"""Connected components of a table of links, by alternating star contractions.

Each round points every node's larger neighbours, then its smaller ones, to the least
node around. Rounds are tables in the shared folder; only their sums reach the driver.
Minima are combined on the map side, and the joins may be split where a node is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from censusloom.llm.common import stored


def _point_to_least(edges: DataFrame) -> DataFrame:
    """(u, v) -> (v, least neighbour of u); ``edges`` has every wanted (node, neighbour)."""
    least = edges.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("u", "least"))
    return edges.join(least, "u")


def _larger(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    moved = _point_to_least(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.where("u <> v").distinct()


def _smaller(edges: DataFrame) -> DataFrame:
    """``edges`` with u > v: u and its smaller neighbours all point to the least of these."""
    pointed = _point_to_least(edges)
    moved = pointed.select(F.explode(F.array("u", "v")).alias("u"), F.col("least").alias("v"))
    return moved.where("u <> v").distinct()


def components(links: DataFrame, a: str, b: str, rounds: int = 50) -> DataFrame:
    """(node, component) for every node of a link; ``component`` is its least node.

    Links may repeat, run both ways, or be loops; an empty table gives no rows.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    edges = stored(links.select(u.alias("u"), v.alias("v")).where("u > v").distinct(), "edges")

    def sums(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    before = sums(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        edges = stored(_smaller(_larger(edges)), "edges")
        after = sums(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("the components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
