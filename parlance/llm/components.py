"""Connected components of links between documents, as rounds of DataFrame joins."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import stored

MAX_ROUNDS = 60


def _smallest_neighbour(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))


def _large_star(links: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to the smallest node next to it."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = _smallest_neighbour(both)
    return both.where("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Link each node's smaller neighbours, and itself, to the smallest of them."""
    smallest = _smallest_neighbour(links)
    moved = links.join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(smallest.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def _is_settled(links: DataFrame) -> bool:
    """Is each node linked once, and to a node that is not linked on?"""
    ends = links.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        links.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into"))
    )
    counts = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return counts.where("out > 1 OR (out > 0 AND into > 0)").isEmpty()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node of a link but those that are the smallest of theirs.

    Alternates two star contractions until every node is linked to the smallest
    node it can reach. Each round moves no more rows than there are links.
    """
    now = stored(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    for _ in range(MAX_ROUNDS):
        if _is_settled(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        now = stored(_small_star(_large_star(now)))
    raise RuntimeError("components did not settle")
