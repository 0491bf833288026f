"""Connected components of an edge list by alternating star contractions, all in shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconlake.llm.shared import shared_dir

SALTS = 8


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """Each edge (a, b) with m, the least b of its a. A hub's edges are dealt to SALTS tasks."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).join(least, ["a", "salt"]).select("a", "b", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _least_neighbour(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    told = _least_neighbour(down)
    return told.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(told.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the least node of its component.

    A round turns the graph into stars of least neighbours and its result is checkpointed in the shared folder,
    so lineage stays short and a lost executor costs one round. The number of rounds grows with the logarithm of
    the longest chain. Only a count and a checksum of the edges reach the driver.
    """
    shared_dir(edges.sparkSession)
    edges = edges.where("a <> b").select("a", "b").distinct().checkpoint()
    before = None
    for _ in range(most_rounds):
        edges = _small_star(_large_star(edges)).distinct().checkpoint()
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
